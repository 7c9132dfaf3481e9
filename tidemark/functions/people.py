"""Role, title and seniority rules over the applications a user touches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Applications that decide a role, first match wins.
ROLE_APPS = [
    ("engineering", ["Azure Portal", "AWS Console", "GitHub"]),
    ("sales_marketing", ["Salesforce", "LinkedIn", "HubSpot"]),
    ("finance", ["SAP", "QuickBooks", "NetSuite"]),
    ("hr", ["Workday", "LinkedIn Recruiter"]),
]
# Fixed values: (role, any of these applications, title), first match wins.
TITLE_RULES = [
    ("engineering", ["GitHub", "AWS Console", "Azure Portal"], "Software Engineer"),
    ("engineering", ["Azure Portal", "Microsoft Intune"], "DevOps Engineer"),
    ("engineering", ["Okta", "ServiceNow", "Microsoft Intune"], "Security Engineer"),
    ("engineering", ["Adobe Creative Cloud"], "UX/UI Designer"),
    ("hr", ["Workday", "ServiceNow"], "HR Manager"),
    ("hr", ["DocuSign", "Workday"], "People Operations"),
    ("sales_marketing", ["Salesforce", "Zoom"], "Account Executive"),
    ("sales_marketing", ["Adobe Creative Cloud", "Slack"], "Marketing Manager"),
    ("general", ["Power BI", "Dynamics 365"], "Business Analyst"),
    ("general", ["Microsoft Teams", "SharePoint", "Microsoft Planner"], "Operations Manager"),
    ("general", ["DocuSign"], "Compliance Analyst"),
]
# Title when no rule matches.
DEFAULT_TITLES = {
    "engineering": "Software Engineer",
    "hr": "HR Specialist",
    "sales_marketing": "Sales Representative",
    "general": "Operations Analyst",
}
SENIORITY = ["Junior", "Mid", "Senior", "Principal"]
PRIVILEGED_APPS = ["Azure Portal", "AWS Console", "Admin Console", "Active Directory"]


def _literal(names: list[str]) -> Column:
    return F.array(*[F.lit(n) for n in names])


def role(apps: Column, rules: list[tuple[str, list[str]]] = ROLE_APPS) -> Column:
    out = F.lit("general")
    for name, wanted in reversed(rules):
        out = F.when(F.arrays_overlap(apps, _literal(wanted)), name).otherwise(out)
    return out


def job_title(role_name: Column, apps: Column) -> Column:
    out = F.lit("Analyst")
    for name, title in DEFAULT_TITLES.items():
        out = F.when(role_name == name, title).otherwise(out)
    for name, wanted, title in reversed(TITLE_RULES):
        out = F.when((role_name == name) & F.arrays_overlap(apps, _literal(wanted)), title).otherwise(out)
    return out


def seniority(username: Column) -> Column:
    """By the md5 number modulo 4, which its last hex digit decides."""
    digit = F.conv(F.right(F.md5(username), F.lit(1)), 16, 10).cast("int")
    return F.element_at(_literal(SENIORITY), digit % 4 + 1)


def privileged(apps: Column) -> Column:
    return F.arrays_overlap(apps, _literal(PRIVILEGED_APPS))
