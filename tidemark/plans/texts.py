"""Sensitive-data detection, chunking, markup, URL, address and log-text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import logs, net, risk, text as tx, urls
from tidemark.plans.base import DETECTIONS_SQL, K_SQL, detections, events, keyed_events
from tidemark.registry import query
from tidemark.session import spread, table

# Detection patterns of the query below; a caller passes its own table of types.
PATTERNS = {
    "email": [r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"],
    "ipv4": [r"\b(?:\d{1,3}\.){3}\d{1,3}\b"],
    "phone_number": [r"\(\d{3}\)\s?\d{3}-\d{4}", r"\b\d{3}-\d{3}-\d{4}\b"],
    "date": [r"\b\d{1,2}[\/\-\.]\d{1,2}[\/\-\.]\d{2,4}\b", r"\b\d{4}[\/\-\.]\d{2}[\/\-\.]\d{2}\b"],
    "url": [r"\bhttps?:\/\/[^\s]+\b", r"\bwww\.[A-Za-z0-9\-\.]+\.[a-z]{2,}\b"],
    "api_key": [r"\b[A-Za-z0-9]{32,}\b"],
    "credit_card_number": [r"\b\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}\b"],
}
LINES_SQL = r"""(
  SELECT doc_id AS original_source_index, unnest(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10))) AS source_text,
         unnest(range(len(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10))))) AS line_no FROM documents)"""
HITS_SQL = (
    "(SELECT original_source_index, line_no, source_text, list_filter(["
    + ", ".join(f"CASE WHEN regexp_matches(source_text, '{tx.combined(p)}') THEN '{n}' END" for n, p in PATTERNS.items())
    + f"], lambda x: x IS NOT NULL) AS types FROM {LINES_SQL})"
)


def lines(spark, sf_dir):
    return tx.paragraphs(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "text", "doc_id")


@query("paragraphs", f"SELECT original_source_index, count(*) AS lines, max(line_no) AS last_line, CAST(sum(length(source_text)) AS BIGINT) AS chars FROM {LINES_SQL} GROUP BY 1")
def paragraphs(spark, sf_dir):
    return lines(spark, sf_dir).groupBy("original_source_index").agg(
        F.count(F.lit(1)).alias("lines"), F.max("line_no").alias("last_line"),
        F.sum(F.char_length("source_text")).cast("bigint").alias("chars"),
    )


@query("dlp_detect", f"SELECT original_source_index, line_no, array_to_string(types, ', ') AS labels FROM {HITS_SQL} WHERE len(types) > 0")
def dlp_detect(spark, sf_dir):
    return tx.detect(lines(spark, sf_dir), "source_text", PATTERNS).select("original_source_index", "line_no", "labels")


WEIGHT_SQL = "CASE t WHEN 'email' THEN 40 WHEN 'ipv4' THEN 30 WHEN 'phone_number' THEN 45 WHEN 'date' THEN 20 WHEN 'api_key' THEN 80 WHEN 'credit_card_number' THEN 90 ELSE 50 END"


@query(
    "dlp_risk",
    f"""
    WITH f AS (SELECT original_source_index, unnest(types) AS t, CASE WHEN length(source_text) > 200 THEN 0.75 ELSE 1.0 END AS confidence FROM {HITS_SQL}),
    w AS (SELECT *, {WEIGHT_SQL} AS w FROM f),
    s AS (SELECT original_source_index, CAST(round_even(least(100, sum(w * CAST(confidence AS DOUBLE)) / count(*)), 0) AS INTEGER) AS risk_score, max(CAST(confidence AS DOUBLE)) AS highest_confidence,
            array_to_string(list_sort(list(DISTINCT t)), ',') AS data_types_found, count(*) FILTER (WHERE w < 20) AS num_minimal,
            count(*) FILTER (WHERE w >= 20 AND w < 40) AS num_low, count(*) FILTER (WHERE w >= 40 AND w < 60) AS num_medium,
            count(*) FILTER (WHERE w >= 60 AND w < 80) AS num_high, count(*) FILTER (WHERE w >= 80) AS num_critical FROM w GROUP BY 1)
    SELECT *, CASE WHEN risk_score >= 80 THEN 'Critical' WHEN risk_score >= 60 THEN 'High' WHEN risk_score >= 40 THEN 'Medium' WHEN risk_score >= 20 THEN 'Low' ELSE 'Minimal' END AS risk_level FROM s
    """,
)
def dlp_risk(spark, sf_dir):
    found = tx.detect(lines(spark, sf_dir), "source_text", PATTERNS).select(
        "original_source_index", F.explode("types").alias("data_type"),
        F.when(F.char_length("source_text") > 200, 0.75).otherwise(1.0).alias("confidence"),
    )
    out = tx.document_risk(found, "original_source_index")
    return out.withColumn("data_types_found", F.array_join("data_types_found", ","))


@query(
    "chunk_text",
    """
    WITH d AS (SELECT doc_id, text, greatest(0, CAST(ceil((length(text) - 64) / 448.0) AS INTEGER) - 1) AS last FROM documents WHERE length(text) > 0)
    SELECT doc_id, i AS chunk_no, substring(text, i * 448 + 1, 512) AS chunk FROM (SELECT doc_id, text, unnest(range(last + 1)) AS i FROM d)
    """,
)
def chunk_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.posexplode(tx.window_chunks(F.col("text"), 512, 64)).alias("chunk_no", "chunk")
    )


@query("chunk_separators")
def chunk_separators(spark, sf_dir):
    chunker = tx.separator_chunks(512, 51)
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", F.posexplode(chunker(F.col("text"))).alias("chunk_no", "chunk")
    )


@query(
    "strip_markup",
    r"""
    SELECT page_id, replace(replace(replace(replace(replace(replace(
      regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<[!/a-zA-Z?][^>]*>', '', 'gs'),
      '&nbsp;', chr(160)), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS content FROM pages
    """,
)
def strip_markup(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.strip_markup(F.col("html")).alias("content"))


@query(
    "page_chunks",
    r"""
    WITH p AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<[!/a-zA-Z?][^>]*>', '', 'gs'), '[ \t\r\n]+', ' ', 'g')) AS content FROM pages),
    d AS (SELECT page_id, content, greatest(0, CAST(ceil((length(content) - 30) / 170.0) AS INTEGER) - 1) AS last FROM p WHERE length(content) > 0)
    SELECT page_id, i AS chunk_no, md5(substring(content, i * 170 + 1, 200)) AS chunk_hash FROM (SELECT page_id, content, unnest(range(last + 1)) AS i FROM d)
    """,
)
def page_chunks(spark, sf_dir):
    bare = F.regexp_replace(F.regexp_replace("html", r"(?s)<!--.*?-->", ""), r"(?s)<[!/a-zA-Z?][^>]*>", "")
    content = F.trim(F.regexp_replace(bare, r"[ \t\r\n]+", " "))
    rows = table(spark, sf_dir, "pages").select("page_id", content.alias("content"))
    return rows.select("page_id", F.posexplode(tx.window_chunks(F.col("content"), 200, 30)).alias("chunk_no", "c")).select(
        "page_id", "chunk_no", F.md5("c").alias("chunk_hash")
    )


SUFFIXES = ["com", "org", "net", "io", "co.uk", "example.com"]


@query(
    "url_parts",
    r"""
    WITH h AS (SELECT page_id, regexp_extract(regexp_extract(url, '([\w]+[\.].*[^/]|[\-\w]+[\.].*[^/])', 1), '([\w\.\-]+)', 1) AS hostname FROM pages),
    s AS (SELECT * FROM (VALUES ('com'), ('org'), ('net'), ('io'), ('co.uk'), ('example.com')) t(suffix)),
    m AS (SELECT page_id, hostname, suffix, row_number() OVER (PARTITION BY page_id ORDER BY length(suffix) DESC) AS r,
                 string_split(hostname, '.') AS l, len(string_split(suffix, '.')) AS n FROM h JOIN s ON ends_with(hostname, '.' || suffix))
    SELECT h.page_id, h.hostname, coalesce(array_to_string(l[1:len(l) - n - 1], '.'), '') AS subdomain, coalesce(l[len(l) - n], '') AS domain, coalesce(suffix, '') AS suffix
    FROM h LEFT JOIN m ON m.page_id = h.page_id AND m.r = 1
    """,
)
def url_parts(spark, sf_dir):
    suffixes = spark.createDataFrame([(s,) for s in SUFFIXES], "suffix string")
    return urls.parse(table(spark, sf_dir, "pages"), "url", suffixes).select(
        "page_id", "hostname", "subdomain", "domain", "suffix"
    )


IP_SQL = f"(SELECT event_id, a || '.' || b || '.' || c || '.' || d AS ip, a * 16777216 + b * 65536 + c * 256 + d AS n FROM (SELECT event_id, [10, 172, 192, 100, 8, 127, 169, 224, 240, 0][{K_SQL} % 10 + 1]::BIGINT AS a, {K_SQL} * 2 AS b, user_id % 256 AS c, event_id % 256 AS d FROM events))"


def addresses(spark, sf_dir):
    first = F.array(*[F.lit(x) for x in (10, 172, 192, 100, 8, 127, 169, 224, 240, 0)])
    return keyed_events(spark, sf_dir).select(
        "event_id",
        F.concat_ws(
            ".", F.element_at(first, (F.col("k") % 10 + 1).cast("int")).cast("string"), (F.col("k") * 2).cast("string"),
            (F.col("user_id") % 256).cast("string"), (F.col("event_id") % 256).cast("string"),
        ).alias("ip"),
    )


def block_sql(blocks):
    tests = [f"n BETWEEN {net._number(a)} AND {net._number(a) + 2 ** (32 - p) - 1}" for a, p in blocks]
    return "(" + " OR ".join(tests) + ")"


@query(
    "ip_functions",
    f"""
    SELECT event_id, n AS number, ip AS back, regexp_full_match(ip, '([0-9]+[.]){{3}}[0-9]+') AS valid, {block_sql(net.PRIVATE_BLOCKS)} AS private,
      NOT {block_sql(net.PRIVATE_BLOCKS)} AND NOT {block_sql(net.SHARED_BLOCKS)} AS global, {block_sql(net.RESERVED_BLOCKS)} AS reserved,
      {block_sql(net.LOOPBACK_BLOCKS)} AS loopback, {block_sql(net.LINK_LOCAL_BLOCKS)} AS link_local, {block_sql(net.MULTICAST_BLOCKS)} AS multicast,
      ip = '0.0.0.0' AS unspecified, '255.255.0.0' AS netmask, '0.0.255.255' AS hostmask,
      split_part(ip, '.', 1) || '.' || split_part(ip, '.', 2) || '.0.0' AS masked,
      split_part(ip, '.', 1) || '.' || split_part(ip, '.', 2) || '.' || split_part(ip, '.', 3) AS subnet
    FROM {IP_SQL}
    """,
)
def ip_functions(spark, sf_dir):
    ip, number = F.col("ip"), F.col("number")
    return addresses(spark, sf_dir).withColumn("number", net.ip_to_int(ip)).select(
        "event_id", "number", net.int_to_ip(number).alias("back"), net.is_ip(ip).alias("valid"),
        *[c.alias(n) for n, c in net.classes(number).items()],
        net.netmask(16).alias("netmask"), net.hostmask(16).alias("hostmask"),
        net.mask(ip, net.netmask(16)).alias("masked"), net.subnet24(ip).alias("subnet"),
    )


@query(
    "keyword_search",
    """
    SELECT doc_id, n_chars FROM documents WHERE lower(text) LIKE '%license%' OR lower(text) LIKE '%token%' OR lower(source) LIKE '%license%' OR lower(source) LIKE '%token%'
    ORDER BY n_chars DESC, doc_id LIMIT 50
    """,
)
def keyword_search(spark, sf_dir):
    from tidemark.operators import dashboards as dash

    found = dash.keyword_search(
        table(spark, sf_dir, "documents"), ["text", "source"], ["license", "token"], [F.desc("n_chars"), F.asc("doc_id")], 50
    )
    return found.select("doc_id", "n_chars")


TOP_TEXT_SQL = f"(SELECT event_id, ts, user_id, score, severity, CASE event_type WHEN 'error' THEN 'travel_speed_kmph=' || k || ' (z=3.10)' WHEN 'click' THEN 'appDisplayName=Mail (z=2.50), locationcity=c' || k || ' (z=1.25)' WHEN 'view' THEN 'deviceDetailbrowser=Edge (z=4.00)' WHEN 'purchase' THEN 'deviceDetaildisplayName=unknown-laptop (z=2.75)' ELSE 'logcount=' || k || ' (z=5.50)' END AS top FROM {DETECTIONS_SQL})"


def with_top_features(spark, sf_dir):
    kind, k = F.col("event_type"), F.col("k").cast("string")
    top = (
        F.when(kind == "error", F.concat(F.lit("travel_speed_kmph="), k, F.lit(" (z=3.10)")))
        .when(kind == "click", F.concat(F.lit("appDisplayName=Mail (z=2.50), locationcity=c"), k, F.lit(" (z=1.25)")))
        .when(kind == "view", "deviceDetailbrowser=Edge (z=4.00)")
        .when(kind == "purchase", "deviceDetaildisplayName=unknown-laptop (z=2.75)")
        .otherwise(F.concat(F.lit("logcount="), k, F.lit(" (z=5.50)")))
    )
    return detections(spark, sf_dir).withColumn("top", top)


@query(
    "root_cause_rules",
    f"""
    WITH r AS (SELECT event_id, score, CASE WHEN top LIKE 'travel%' THEN 'Geographic Anomaly' WHEN top LIKE 'app%' THEN 'Account Takeover' WHEN top LIKE '%unknown-laptop%' THEN 'Unmanaged Device'
             WHEN top LIKE '%browser%' THEN 'Browser Anomaly' ELSE 'Account Takeover' END AS root_cause,
           CASE WHEN top LIKE 'travel%' THEN 'Impossible Travel' WHEN top LIKE 'app%' THEN 'Multi-Factor Anomaly' WHEN top LIKE '%unknown-laptop%' THEN 'Unknown Device'
             WHEN top LIKE '%browser%' THEN 'Unusual Browser' ELSE 'Broad Deviation' END AS sub_category FROM {TOP_TEXT_SQL})
    SELECT event_id, root_cause, sub_category,
      CASE sub_category WHEN 'Impossible Travel' THEN 'Geographic Anomaly' WHEN 'Multi-Factor Anomaly' THEN 'Multi-Factor Incident' WHEN 'Unknown Device' THEN 'Unmanaged Device'
        WHEN 'Unusual Browser' THEN 'Browser Anomaly' ELSE 'Behavioral Anomaly' END AS coarse_cause,
      CASE WHEN score >= 2.5 THEN 'TRUE_POSITIVE' ELSE 'FALSE_POSITIVE' END AS label,
      CASE WHEN score >= 2.5 AND score < 5 THEN 0.65 ELSE 0.9 END AS confidence FROM r
    """,
)
def root_cause_rules(spark, sf_dir):
    rows = with_top_features(spark, sf_dir).withColumn("v", risk.root_cause(F.col("top")))
    return rows.select(
        "event_id", "v.root_cause", "v.sub_category", risk.root_cause_of(F.col("v.sub_category")).alias("coarse_cause"),
        risk.threshold_label(F.col("score")).alias("label"),
        risk.label_confidence(F.col("score"), (2.5, 5.0)).alias("confidence"),
    )


@query(
    "parsed_features",
    f"""
    WITH f AS (SELECT event_id, unnest(string_split(top, ', ')) AS t FROM {TOP_TEXT_SQL})
    SELECT event_id, split_part(t, '=', 1) AS name, trim(split_part(split_part(t, '=', 2), ' (', 1)) AS value, CAST(regexp_extract(t, 'z=([0-9.]+)', 1) AS DOUBLE) AS z_score,
      CASE WHEN t LIKE 'app%' THEN 'app' WHEN t LIKE 'device%' THEN 'device' WHEN t LIKE 'loc%' OR t LIKE 'travel%' THEN 'location' WHEN t LIKE 'logcount%' THEN 'activity' END AS category FROM f
    """,
)
def parsed_features(spark, sf_dir):
    rows = with_top_features(spark, sf_dir)
    return rows.select("event_id", F.explode(logs.parse_top_features(F.col("top"))).alias("f")).select("event_id", "f.*")


@query(
    "detection_sentences",
    f"""
    SELECT event_id, 'User ' || user_id || ' accessed ' || event_type || ' application from Edge browser on pc-' || user_id || ' device running Windows in c' || k || ', FR (IP: 10.0.0.' || k || ') using web on '
      || dayname(ts) || ' at ' || strftime(ts, '%H') || ':00 triggered ' || severity || ' severity anomaly '
      || CASE severity WHEN 'CRITICAL' THEN '(critical anomaly, score ' WHEN 'HIGH' THEN '(highly unusual, score ' ELSE '(unusual, score ' END || printf('%.1f', floor(score)) || ')' AS sentence,
      md5(user_id || '_' || CAST(event_id AS VARCHAR) || '_' || event_type) AS cache_hash, 8 AS entities
    FROM {DETECTIONS_SQL}
    """,
)
def detection_sentences(spark, sf_dir):
    rows = detections(spark, sf_dir)
    k = F.col("k").cast("string")
    user = F.col("user_id").cast("string")
    event = F.to_json(
        F.struct(
            F.struct(
                F.col("event_type").alias("appDisplayName"),
                F.struct(
                    F.concat(F.lit("pc-"), user).alias("displayName"), F.lit("Edge").alias("browser"), F.lit("Windows").alias("operatingSystem"),
                ).alias("deviceDetail"),
                F.concat(F.lit("10.0.0."), k).alias("ipAddress"), F.lit("web").alias("clientAppUsed"),
            ).alias("properties"),
            F.struct(F.concat(F.lit("c"), k).alias("city"), F.lit("FR").alias("countryOrRegion")).alias("location"),
        )
    )
    rows = rows.withColumn("entities", logs.event_entities(event, F.col("severity")))
    sentence = logs.detection_sentence(F.col("user_id"), F.col("ts"), F.col("severity"), F.floor("score").cast("double"), F.col("entities"))
    key = logs.cache_key(F.col("user_id"), F.col("event_id"), F.col("event_type"))
    return rows.select(
        "event_id", sentence.alias("sentence"), F.substring_index(key, ":", -1).alias("cache_hash"), F.size("entities").alias("entities")
    )


def tokenised(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", F.split("text", " ").alias("tok")
    )


@query(
    "token_windows",
    """
    WITH t AS (SELECT doc_id, string_split(text, ' ') AS tok FROM documents),
    w AS (SELECT doc_id, tok, unnest(range(greatest(0, CAST(ceil((len(tok) - 64) / 48.0) AS INTEGER)) + 1)) AS i FROM t)
    SELECT doc_id, i * 48 AS start, len(tok[i * 48 + 1 : i * 48 + 64]) AS used, md5(array_to_string(tok[i * 48 + 1 : i * 48 + 64], ' ')) AS hash FROM w
    """,
)
def token_windows(spark, sf_dir):
    rows = tokenised(spark, sf_dir).select("doc_id", F.explode(tx.token_windows(F.col("tok"), 64, 48)).alias("w"))
    used = F.aggregate("w.mask", F.lit(0), lambda a, x: a + x)
    return rows.select("doc_id", "w.start", "w.tokens", used.alias("used")).select(
        "doc_id", "start", "used", F.md5(F.array_join(F.slice("tokens", F.lit(1), F.col("used")), " ")).alias("hash")
    )


@query(
    "reassembled_windows",
    "SELECT doc_id, len(string_split(text, ' ')) AS n, md5(text) AS hash FROM documents",
)
def reassembled_windows(spark, sf_dir):
    """Windows without overlap, put together again: the log-parsing re-assembly on whole texts."""
    windows = tokenised(spark, sf_dir).select("doc_id", F.explode(tx.token_windows(F.col("tok"), 64, 64)).alias("w"))
    used = F.aggregate("w.mask", F.lit(0), lambda a, x: a + x)
    slices = windows.select("doc_id", "w.start", F.slice("w.tokens", F.lit(1), used).alias("tokens"))
    out = tx.reassemble_slices(slices, "doc_id", "start", ["tokens"])
    return out.select("doc_id", F.size("tokens").alias("n"), F.md5(F.array_join("tokens", " ")).alias("hash"))


@query(
    "labelled_entities",
    """
    WITH t AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS tok, unnest(range(len(string_split(text, ' ')))) AS pos FROM conversations)
    SELECT conv_id, turn, coalesce(string_agg(tok, ' ' ORDER BY pos) FILTER (WHERE tok <> '' AND tok NOT LIKE '.%' AND length(tok) > 9), '') AS long_words,
           coalesce(string_agg(tok, ' ' ORDER BY pos) FILTER (WHERE tok <> '' AND tok NOT LIKE '.%' AND length(tok) BETWEEN 8 AND 9), '') AS mid_words FROM t GROUP BY 1, 2
    """,
)
def labelled_entities(spark, sf_dir):
    tokens = F.filter(F.split("text", " "), lambda t: (t != "") & ~t.startswith("."))
    labels = F.transform("tok", lambda t: F.when(F.char_length(t) > 9, "B-word").when(F.char_length(t) > 7, "I-word").otherwise("O"))
    rows = spread(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"))
    rows = rows.select("conv_id", "turn", tokens.alias("tok")).withColumn("lab", labels)
    rows = tx.tokens_by_label(rows, "tok", "lab", "m")
    return rows.select(
        "conv_id", "turn", F.coalesce(F.col("m")["B-word"], F.lit("")).alias("long_words"),
        F.coalesce(F.col("m")["I-word"], F.lit("")).alias("mid_words"),
    )


@query(
    "recipient_features",
    """
    SELECT doc_id, len(regexp_extract_all(text, '@')) AS to_count, len(regexp_extract_all(source, '@')) AS bcc_count, len(regexp_extract_all(lang, '@')) AS cc_count,
      len(regexp_extract_all(text, '@')) AS total_recipients, md5(len(regexp_extract_all(text, '@')) || '[SEP]0[SEP]0[SEP]' || len(regexp_extract_all(text, '@')) || '[SEP]' || text) AS data_hash FROM documents
    """,
)
def recipient_features(spark, sf_dir):
    f = tx.recipient_features(F.col("text"), F.col("source"), F.col("lang"), F.col("text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", *[c.alias(n) for n, c in f.items()])
    return rows.withColumn("data_hash", F.md5("data")).drop("data")


@query(
    "prompt_rows",
    "SELECT conv_id, turn, 'Turn ' || turn || ' by ' || role || ': ' || text AS prompt FROM conversations",
)
def prompt_rows(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", tx.fill_template("Turn {turn} by {role}: {text}", ["turn", "role", "text"]).alias("prompt")
    )


@query(
    "named_scores",
    "SELECT vec_id, embedding[1] > 0.1 AS first, embedding[2] > 0.1 AS second, CASE WHEN list_max(embedding[1:3]) >= 0.1 THEN ['a', 'b', 'c'][list_position(embedding[1:3], list_max(embedding[1:3]))] ELSE 'none' END AS best FROM embeddings",
)
def named_scores(spark, sf_dir):
    head = F.slice("embedding", 1, 3)
    flags = tx.named_scores(F.col("embedding"), ["first", "second"], 0.1)
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", *[c.alias(n) for n, c in flags.items()], tx.best_label(head, ["a", "b", "c"], 0.1).alias("best")
    )


@query(
    "numeric_matrix",
    f"SELECT event_id, round(CAST(regexp_extract(CAST(value AS VARCHAR), '([0-9]+[.]?[0-9]*)', 1) AS DOUBLE) + {K_SQL}, 4) AS total FROM events",
)
def numeric_matrix(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", tx.numeric_matrix([F.col("value"), F.col("props")]).alias("x"))
    return rows.select("event_id", F.round(F.col("x")[0] + F.col("x")[1], 4).alias("total"))
