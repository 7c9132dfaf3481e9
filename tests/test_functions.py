"""Known answers of column functions."""

import math
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from tidemark.functions import logs, net, people, remediation, risk, text as tx, urls
from tidemark.operators import scoring, schema as sc, snapshots, travel


def one(df):
    return df.first()


def test_ip_classes(spark):
    known = {
        "192.168.0.1": "private", "10.0.0.1": "private", "172.31.255.255": "private", "172.32.0.0": "global",
        "192.0.0.7": "private", "192.0.0.8": "global", "192.0.0.170": "private", "192.0.0.172": "global",
        "198.19.0.1": "private", "203.0.113.9": "private", "100.64.0.1": "shared", "207.46.13.151": "global", "127.0.0.1": "private",
    }
    rows = spark.createDataFrame([(k,) for k in known], "ip string").select(
        "ip", net.is_private(F.col("ip")).alias("p"), net.is_global(F.col("ip")).alias("g")
    )
    for r in rows.collect():
        want = known[r["ip"]]
        assert (r["p"], r["g"]) == (want == "private", want == "global"), r


def test_ip_numbers(spark):
    rows = spark.createDataFrame([("192.168.0.1",), ("10.123.0",), ("256.1.1.1",)], "ip string")
    got = rows.select(net.ip_to_int(F.col("ip")).alias("n"), net.is_ip(F.col("ip")).alias("v")).collect()
    assert [tuple(r) for r in got] == [(3232235521, True), (None, False), (None, False)]
    r = one(rows.limit(1).select(net.netmask(16).alias("n"), net.hostmask(16).alias("h"), net.mask(F.col("ip"), F.lit("255.255.0.0")).alias("m")))
    assert tuple(r) == ("255.255.0.0", "0.0.255.255", "192.168.0.0")


def test_urls(spark):
    rows = spark.createDataFrame(
        [("http://www.google.com",), ("gmail.com",), ("https://pandas.pydata.org",), ("http://a.b.bbc.co.uk/x",), ("http://localhost.nowhere/",), ("com",)],
        "url string",
    )
    suffixes = spark.createDataFrame([("com",), ("org",), ("uk",), ("co.uk",)], "suffix string")
    got = {r["url"]: (r["hostname"], r["subdomain"], r["domain"], r["suffix"]) for r in urls.parse(rows, "url", suffixes).collect()}
    assert got["http://www.google.com"] == ("www.google.com", "www", "google", "com")
    assert got["gmail.com"] == ("gmail.com", "", "gmail", "com")
    assert got["https://pandas.pydata.org"] == ("pandas.pydata.org", "pandas", "pydata", "org")
    assert got["http://a.b.bbc.co.uk/x"] == ("a.b.bbc.co.uk", "a.b", "bbc", "co.uk")
    assert got["http://localhost.nowhere/"] == ("localhost.nowhere", "", "", "")


@pytest.mark.parametrize(
    ("score", "severity", "compressed"),
    [(5.0, "HIGH", 5.0), (5.01, "CRITICAL", 5.01), (3.0, "HIGH", 3.0), (2.5, "MEDIUM", 2.5), (2.0, "NONE", 2.0), (2.01, "LOW", 2.01),
     (8.0, "CRITICAL", round(8 + 8 * math.log10(9) / 15, 4)), (1e30, "CRITICAL", 15.99), (-1.0, "NONE", 0.0)],
)
def test_severity_and_compression(spark, score, severity, compressed):
    r = one(spark.createDataFrame([(score,)], "s double").select(risk.severity(F.col("s")).alias("v"), risk.compress_score(F.col("s")).alias("c")))
    assert (r["v"], r["c"]) == (severity, compressed)


def test_root_cause_order(spark):
    known = {
        "travel_speed_kmph=2723 (z=18.06), appDisplayName=x (z=1.0)": ("Geographic Anomaly", "Impossible Travel"),
        "appDisplayName=Mail (z=2.0), locationcity=Oslo (z=1.0)": ("Account Takeover", "Multi-Factor Anomaly"),
        "deviceDetailbrowser=Edge (z=2.0), locationcountry=NO (z=1.0)": ("Geographic Anomaly", "Location with Unusual Device"),
        "deviceDetaildisplayName=unknown (z=2.0)": ("Unmanaged Device", "Unknown Device"),
        "appDisplayName=Mail (z=2.0)": ("Unauthorized Application Access", "Unusual Application"),
        "deviceDetailoperatingSystem=Linux (z=2.0)": ("OS Anomaly", "Unusual Operating System"),
        "logcount=9 (z=2.0)": ("Account Takeover", "Broad Deviation"),
    }
    rows = spark.createDataFrame([(k,) for k in known], "t string").select("t", risk.root_cause(F.col("t")).alias("v"))
    assert {r["t"]: tuple(r["v"]) for r in rows.collect()} == known


def test_confidence_and_votes(spark):
    r = one(spark.range(1).select(
        risk.confidence_blend(F.lit(80.0), F.lit(4.0), F.lit(0.9)).alias("a"),
        risk.confidence_blend(F.lit(80.0), F.lit(4.0), F.lit(None).cast("double")).alias("b"),
        risk.ensemble_vote({"llm": (F.lit(True), F.lit(0.70)), "graph": (F.lit(True), F.lit(0.75))}).alias("c"),
        risk.ensemble_vote({"llm": (F.lit(True), F.lit(0.70))}).alias("d"),
    ))
    assert r["a"]["confidence"] == 0.72 and r["b"]["confidence"] == 0.695
    assert round(r["c"]["score"], 3) == 0.714 and r["c"]["is_anomaly"] is True
    assert r["d"]["is_anomaly"] is None and r["d"]["human_review_recommended"]


def test_parse_top_features(spark):
    text = "travel_speed_kmph=2723 (z=18.06), logcount=12 (z=3.80), broken"
    got = one(spark.createDataFrame([(text,)], "t string").select(logs.parse_top_features(F.col("t")).alias("f")))["f"]
    assert [tuple(f) for f in got] == [("travel_speed_kmph", "2723", 18.06, "location"), ("logcount", "12", 3.8, "activity")]


def test_windows_events_and_notables(spark):
    rows = spark.createDataFrame([(r"EventCode=4624\r\nAccount Name:\tBob",), ("EventCode=1",)], "raw string")
    regexes = {4624: {"account": r"account name:(\w+)", "code": r"eventcode=(\d+)"}, 4625: {"failure": r"reason:(\w+)"}}
    got = logs.parse_windows_events(rows, "raw", regexes).collect()
    assert [(r["account"], r["code"], r["failure"]) for r in got] == [("bob", "4624", "")]
    notes = spark.createDataFrame([('src=\\"\\" alt=\\"1.2.3.4\\"',)], "raw string")
    patterns = {"src_ip": r'src="([\d.]*)"', "src_ip2": r'alt="([\d.]+)"'}
    assert one(logs.parse_notables(notes, "raw", patterns))["src_ip"] == "1.2.3.4"


def test_half_even_document_risk(spark):
    rows = spark.createDataFrame([(1, "email", 1.0), (1, "phone_number", 1.0), (2, "ssn", 0.5), (2, "other", 1.0)], "d int, data_type string, confidence double")
    got = {r["d"]: (r["risk_score"], r["risk_level"], r["num_medium"], r["num_critical"]) for r in tx.document_risk(rows, "d").collect()}
    assert got == {1: (42, "Medium", 2, 0), 2: (49, "Medium", 1, 1)}


def test_truncate_bytes_keeps_characters_whole(spark):
    words = ["abcdef", "aé€😀z", "ééé", "😀😀"]
    rows = spark.createDataFrame([(w,) for w in words], "t string")
    for limit in range(4, 9):
        for r in rows.select("t", sc.truncate_bytes(F.col("t"), limit).alias("c")).collect():
            assert r["c"] == r["t"].encode()[:limit].decode("utf-8", "ignore"), (r["t"], limit)


def test_chunks_cover_text():
    text = "para one is here.\n\npara two is a bit longer than that.\nline\n\n" + "x" * 45 + " tail words follow on"
    chunks = tx._pack(tx._split_on(text, ("\n\n", "\n", " ", ""), 30), 30, 8)
    assert all(len(c) <= 30 for c in chunks)
    joined = "".join(chunks)
    assert set("".join(text.split())) <= set(joined) and len(joined) >= len("".join(text.split()))


def test_labels_and_clean_up(spark):
    rows = spark.createDataFrame(
        [(["192", ".", "168", "##1", "bob"], ["B-ip", "O", "I-ip", "O", "B-user"])], "tok array<string>, lab array<string>"
    )
    m = one(tx.tokens_by_label(rows, "tok", "lab", "m"))["m"]
    assert m == {"B-ip": "192 .", "I-ip": "168 ##1", "B-user": "bob"}
    out = tx.tokens_by_label(rows, "tok", "lab", "m").select(tx.entity_text(F.col("m"), "ip").alias("t"))
    assert one(out)["t"] == "192.1681"


def test_recipients_and_scores(spark):
    r = one(spark.createDataFrame([("a@x, b@y", "", "c@z", "hi")], "a string, b string, c string, m string").select(
        *[c.alias(n) for n, c in tx.recipient_features(F.col("a"), F.col("b"), F.col("c"), F.col("m")).items()]
    ))
    assert r["total_recipients"] == 3 and r["data"] == "2[SEP]0[SEP]1[SEP]3[SEP]hi"
    probs = spark.createDataFrame([([0.2, 0.7],), ([0.1, 0.3],)], "p array<double>")
    assert [r[0] for r in probs.select(tx.best_label(F.col("p"), ["x", "y"])).collect()] == ["y", "none"]
    with pytest.raises(Exception, match="fewer outputs"):
        probs.select(*tx.named_scores(F.col("p"), ["a", "b", "c"]).values()).collect()


def test_people_and_remediation(spark):
    r = one(spark.createDataFrame([(["GitHub", "Zoom"],)], "a array<string>").select(
        people.role(F.col("a")).alias("role"), people.job_title(F.lit("engineering"), F.col("a")).alias("title"), people.privileged(F.col("a")).alias("p"),
    ))
    assert tuple(r) == ("engineering", "Software Engineer", False)
    rows = spark.createDataFrame([("Brute Force", "HIGH"), ("Strange", "LOW")], "c string, s string")
    got = {r["c"]: ([a["priority"] for a in r["actions"]], len(r["compliance_flags"])) for r in remediation.advise(rows, F.col("c"), F.col("s")).collect()}
    assert got == {"Brute Force": ([1, 2, 3], 4), "Strange": ([1, 2, 3], 0)}


@pytest.mark.parametrize(
    ("a", "b", "km"), [((51.5074, -0.1278), (48.8566, 2.3522), 344), ((51.5074, -0.1278), (35.6762, 139.6503), 9559), ((1.0, 1.0), (1.0, 1.0), 0), ((95.0, 0.0), (0.0, 0.0), 0)]
)
def test_haversine(spark, a, b, km):
    got = one(spark.range(1).select(travel.haversine_km(*[F.lit(float(x)) for x in (*a, *b)])))[0]
    assert abs(got - km) < 3


def test_inverse_normal(spark):
    ps = [1e-6, 0.01, 0.02425, 0.3, 0.5, 0.9, 0.999]
    rows = spark.createDataFrame([(p,) for p in ps], "p double").select("p", scoring.inverse_normal(F.col("p")).alias("z"))
    for r in rows.collect():
        assert abs(r["z"] - NormalDist().inv_cdf(r["p"])) < 1e-7


def test_double_extensions(spark):
    rows = spark.createDataFrame([("a\\b.docx.lock",), ("b.txt",), ("c.x.docx",), ("d.docx.a.b",)], "n string")
    got = [r[0] for r in rows.select(snapshots.double_extension(F.col("n"), ["docx", "txt"])).collect()]
    assert got == [4, None, None, 3]
