"""Personal data in whole texts: patterns propose spans, checksums confirm them, context words adjust the score.

Base kinds are e-mail addresses, IPv4 addresses, payment cards (Luhn) and phone numbers; each is found leftmost and
without overlap among its own kind, and a match that fails its check is dropped, not tried again from a later start.
Further kinds (account numbers with mod-97, social security numbers) are added only when their score is enough. An
account number ends at the length of its country, so a capital word or number after it is not taken for its tail.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn")
#: A kind's own score, and what a context word shortly before or after a span adds.
SCORES = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.4}
CONTEXT = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "account", "bank"),
    "ssn": ("ssn", "social security"),
}
CONTEXT_CHARS, CONTEXT_SCORE, ADDED_SCORE = 40, 0.2, 0.6

# Possessive repeats and the look-behind after the first digit only keep long runs linear; they match the same spans.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"[A-Z](?<![A-Za-z0-9][A-Z])[A-Z][0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"[0-9](?<![0-9-][0-9])[0-9]{2}-[0-9]{2}-[0-9]{4}(?![0-9-])")
ACCOUNT = re.compile(r"[A-Z](?<![A-Za-z0-9][A-Z])[A-Z][0-9]{2}")
#: Characters of an account number by country.
ACCOUNT_LENGTHS = {
    country: int(n)
    for n, countries in (line.split(":") for line in (
        "15:NO", "16:BE", "18:DK FI FK FO GL NL SD", "19:MK SI", "20:AT BA EE KZ LT LU MN XK", "21:CH HR LI LV",
        "22:BG BH CR DE GB GE IE ME RS VA", "23:AE GI IL IQ OM SO TL", "24:AD CZ ES MD PK RO SA SE SK TN VG",
        "25:AO CV GW LY MZ PT ST", "26:DZ IR IS TR", "27:BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
        "28:AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN TG", "29:BR EG PS QA UA", "30:JO KW MU YE", "31:MT SC SV",
        "32:LC", "33:RU",
    ))
    for country in countries.split()
}
ACCOUNT_TAILS = {
    n: re.compile(rf"(?:\x20?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (rf"\x20?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") + "(?![A-Za-z0-9])")
    for n in set(ACCOUNT_LENGTHS.values())
}
NOT_DIGIT = re.compile(r"[^0-9]+")

SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
SCHEMA = "id long, spans array<struct<kind:string,start:bigint,end:bigint,score:double>>"


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Every at-sign with a domain after it and a local part before it that no earlier match has used."""
    used, at = 0, text.find("@")
    while at >= 0:
        domain = DOMAIN.match(text, at + 1)
        if domain:
            start = at
            while start > used and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                used = domain.end()
                yield start, used
        at = text.find("@", max(at + 1, used))


def luhn(digits: str) -> bool:
    back = [int(d) for d in reversed(digits)]
    doubled = (2 * d - 9 * (d > 4) for d in back[1::2])
    return (sum(back[::2]) + sum(doubled)) % 10 == 0


def mod97(account: str) -> bool:
    """The check of international account numbers: first four characters last, letters from 10, remainder 1."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def accounts(text: str) -> Iterator[tuple[int, int]]:
    """Account numbers that pass mod-97: cut to the length of their country, else as far as the general pattern goes."""
    head = ACCOUNT.search(text)
    while head:
        start, at = head.start(), head.end()
        length = ACCOUNT_LENGTHS.get(head[0][:2])
        tail = length and ACCOUNT_TAILS[length].match(text, at)
        whole = IBAN.match(text, start)
        for end in [m.end() for m in (tail, whole) if m]:
            account = text[start:end].replace(" ", "")
            if 15 <= len(account) <= 34 and mod97(account):
                yield start, end
                at = end
                break
        head = ACCOUNT.search(text, at)


def small_part(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and int(part) <= 255


def proposed(text: str) -> Iterator[tuple[str, int, int]]:
    """Confirmed spans of all kinds, before scores."""
    for start, end in emails(text):
        yield "email", start, end
    for m in IP.finditer(text):
        if all(map(small_part, m[0].split("."))):
            yield "ip", m.start(), m.end()
    for m in CARD.finditer(text):
        if 12 <= m.end() - m.start():
            digits = NOT_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield "card", m.start(), m.end()
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                yield "phone", m.start(), m.end()
    for start, end in accounts(text):
        yield "iban", start, end
    for m in SSN.finditer(text):
        area, group, serial = m[0].split("-")
        if area not in ("000", "666") and area[0] != "9" and group != "00" and serial != "0000":
            yield "ssn", m.start(), m.end()


def find(text: str) -> list[dict]:
    """Spans by start, then kind as listed; offsets in code points, end exclusive."""
    spans = []
    for kind, start, end in proposed(text):
        sides = text[max(0, start - CONTEXT_CHARS) : start].lower(), text[end : end + CONTEXT_CHARS].lower()
        score = SCORES[kind] + CONTEXT_SCORE * any(word in side for word in CONTEXT[kind] for side in sides)
        if kind in BASE_KINDS or score >= ADDED_SCORE:
            spans.append({"kind": kind, "start": start, "end": end, "score": round(score, 2)})
    return sorted(spans, key=lambda s: (s["start"], KINDS.index(s["kind"])))


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans), one row per input row; no spans for null and empty texts.

    Rows are independent, so ties and repeated rows are answered alike; an empty table gives no rows.
    """

    def scan(batches):
        for batch in batches:
            texts = batch.column("text")
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([find(t.as_py()) for t in texts], pa.list_(SPAN))], ["id", "spans"]
            )

    return common.text_rows(docs, id_col, text_col).mapInArrow(scan, SCHEMA)


def masked(text: str, spans: list[dict]) -> str:
    """The text with every span replaced by its kind in brackets; of overlapping spans the first counts."""
    out, at = [], 0
    for s in spans:
        if s["start"] >= at:
            out += [text[at : s["start"]], f"[{s['kind']}]"]
            at = s["end"]
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) with personal data masked; a null text becomes empty."""

    def scan(batches):
        for batch in batches:
            texts = [t.as_py() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([masked(t, find(t)) for t in texts], pa.string())], ["id", "text"]
            )

    return common.text_rows(docs, id_col, text_col).mapInArrow(scan, "id long, text string")


def joined(spans):
    """kind:start:end of each span, comma-joined."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")
