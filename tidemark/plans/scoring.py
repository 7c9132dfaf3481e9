"""Fingerprints, scores, votes, scalers and Spark ML queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import risk
from tidemark.functions.text import window_chunks
from tidemark.operators import graph, learning, scoring as sco, spectral, travel as tr, trees
from tidemark.plans.base import DETECTIONS_SQL, K_SQL, detections, events, keyed_events, with_baseline
from tidemark.plans.sequences import located
from tidemark.registry import query
from tidemark.session import scratch_dir, spread, table

ROWS_SQL = f"(SELECT event_id, user_id, ts, value, {K_SQL} AS k, event_type AS app FROM events)"
SPLIT_SQL = f"(SELECT CAST(user_id AS VARCHAR) AS su, * FROM {ROWS_SQL} UNION ALL SELECT 'generic_user', * FROM {ROWS_SQL})"
MODEL_SQL = f"""
    sp AS (SELECT * FROM {SPLIT_SQL}),
    st AS (SELECT su, count(*) AS n, avg(value) AS mv, coalesce(nullif(stddev_samp(value), 0), 1) AS sv,
                  avg(k) AS mk, coalesce(nullif(stddev_samp(k), 0), 1) AS sk FROM sp GROUP BY 1),
    cc AS (SELECT su, app, count(*) AS c FROM sp GROUP BY 1, 2),
    ct AS (SELECT su, sum(c) AS n, sum(CASE WHEN c < 3 THEN c ELSE 0 END) AS rare, count(*) FILTER (WHERE c >= 3) AS v FROM cc GROUP BY 1),
    cp AS (SELECT cc.su, app, (c + 1) / (n + v + 1) AS p FROM cc JOIN ct ON ct.su = cc.su WHERE c >= 3),
    co AS (SELECT su, (rare + 1) / (n + v + 1) AS po FROM ct)"""
LOSS_SQL = """(SELECT r.*, pow((value - mv) / sv, 2) AS lv, pow((k - mk) / sk, 2) AS lk, -ln(coalesce(cp.p, co.po)) AS la,
      mv AS pv, CASE WHEN cp.p IS NULL THEN '_other' ELSE r.app END AS pa
    FROM {rows} r JOIN st ON st.su = r.su JOIN co ON co.su = r.su LEFT JOIN cp ON cp.su = r.su AND cp.app = r.app)"""
LM_SQL = f"""
    lm AS (SELECT su, avg(lv) AS mlv, stddev_pop(lv) AS slv, avg(lk) AS mlk, stddev_pop(lk) AS slk, avg(la) AS mla, stddev_pop(la) AS sla
           FROM {LOSS_SQL.format(rows="sp")} GROUP BY 1)"""


def feature_rows(spark, sf_dir):
    return keyed_events(spark, sf_dir).withColumnRenamed("event_type", "app")


def fitted(spark, sf_dir):
    return sco.fit(feature_rows(spark, sf_dir), "user_id", ["value", "k"], ["app"], min_cats=3)


@query(
    "fingerprint_fit",
    f"""
    WITH {MODEL_SQL}, {LM_SQL}
    SELECT st.su AS split_user, st.n, 'value' AS feature, round(mv, 6) AS mean, round(sv, 6) AS std, round(mlv, 9) AS loss_mean, round(slv, 5) AS loss_std FROM st JOIN lm ON lm.su = st.su
    UNION ALL SELECT st.su, st.n, 'k', round(mk, 6), round(sk, 6), round(mlk, 9), round(slk, 5) FROM st JOIN lm ON lm.su = st.su
    UNION ALL SELECT st.su, st.n, 'app', 0.0, 0.0, round(mla, 9), round(sla, 5) FROM st JOIN lm ON lm.su = st.su
    """,
)
def fingerprint_fit(spark, sf_dir):
    out = sco.model_rows(fitted(spark, sf_dir)).na.fill(0.0, ["mean", "std"])
    digits = {"mean": 6, "std": 6, "loss_mean": 9, "loss_std": 5}
    return out.select("split_user", "n", "feature", *[F.round(c, d).alias(c) for c, d in digits.items()])


@query(
    "fingerprint_score",
    f"""
    WITH {MODEL_SQL}, {LM_SQL},
    ev AS (SELECT CASE WHEN st.n >= 50 THEN st.su ELSE 'generic_user' END AS su, r.* FROM {ROWS_SQL} r JOIN st ON st.su = CAST(r.user_id AS VARCHAR)),
    z AS (SELECT l.event_id, l.user_id, l.su, pv, pa, lv, la, abs((lv - mlv) / coalesce(nullif(slv, 0), 1)) AS zv, abs((lk - mlk) / coalesce(nullif(slk, 0), 1)) AS zk,
            abs((la - mla) / coalesce(nullif(sla, 0), 1)) AS za FROM {LOSS_SQL.format(rows="ev")} l JOIN lm ON lm.su = l.su)
    SELECT event_id, user_id, su AS split_user, round(pv, 5) AS value_pred, pa AS app_pred, round(lv, 5) AS value_loss, round(la, 5) AS app_loss,
      round(zv, 5) AS value_z_loss, round(greatest(zv, zk, za), 5) AS max_abs_z, round((zv + zk + za) / 3, 5) AS mean_abs_z, 'z' AS z_loss_scaler_type FROM z
    """,
)
def fingerprint_score(spark, sf_dir):
    out = sco.score(feature_rows(spark, sf_dir), "user_id", fitted(spark, sf_dir), min_rows=50)
    numbers = ["value_pred", "value_loss", "app_loss", "value_z_loss", "max_abs_z", "mean_abs_z"]
    return out.select("event_id", "user_id", "split_user", "app_pred", "z_loss_scaler_type", *[F.round(c, 5).alias(c) for c in numbers])


def inverse_normal_sql(p: str) -> str:
    """The normal quantile of a column ``p`` by the published rational approximation, as one expression."""
    # Coefficients of the published approximation, centre and tails.
    a = "-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00"
    b = "-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0"
    c = "-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00"
    d = "7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0"
    poly = lambda k, x: f"list_reduce([{k}]::DOUBLE[], lambda total, factor: total * ({x}) + factor)"
    r, t = f"(({p}) - 0.5) * (({p}) - 0.5)", f"sqrt(-2 * ln(least({p}, 1 - ({p}))))"
    tail = f"{poly(c, t)} / {poly(d, t)}"
    return f"CASE WHEN {p} < 0.02425 THEN {tail} WHEN {p} > 1 - 0.02425 THEN -({tail}) ELSE {poly(a, r)} * (({p}) - 0.5) / {poly(b, r)} END"


EVENT_SQL = f"ev AS (SELECT CASE WHEN st.n >= 50 THEN st.su ELSE 'generic_user' END AS su, r.* FROM {ROWS_SQL} r JOIN st ON st.su = CAST(r.user_id AS VARCHAR))"
FEATURES = {"value": "lv", "k": "lk", "app": "la"}


def fitted_for(spark, sf_dir, scaler):
    """A model fitted for one loss scaler, stored and loaded again, as scoring jobs use it."""
    model = sco.fit(feature_rows(spark, sf_dir), "user_id", ["value", "k"], ["app"], min_cats=3, scalers=(scaler,))
    folder = scratch_dir(spark, "model")
    sco.save_model(model, folder)
    return sco.load_model(spark, folder)


def rounded_scores(spark, sf_dir, scaler, return_abs):
    out = sco.score(feature_rows(spark, sf_dir), "user_id", fitted_for(spark, sf_dir, scaler), return_abs, min_rows=50, scaler=scaler)
    numbers = ["value_z_loss", "k_z_loss", "app_z_loss", "max_abs_z", "mean_abs_z"]
    return out.select("event_id", "split_user", "z_loss_scaler_type", *[F.round(c, 5).alias(c) for c in numbers])


@query(
    "fingerprint_modz",
    f"""
    WITH {MODEL_SQL}, l AS {LOSS_SQL.format(rows="sp")},
    md AS (SELECT su, {", ".join(f"list_sort(list({c}))[(count(*) + 1) // 2] AS d{c}" for c in FEATURES.values())} FROM l GROUP BY 1),
    ma AS (SELECT su, {", ".join(f"list_sort(list(abs({c} - d{c})))[(count(*) + 1) // 2] AS m{c}, coalesce(nullif(avg(abs({c} - d{c})), 0), 1) AS a{c}" for c in FEATURES.values())}
           FROM l JOIN md USING (su) GROUP BY 1),
    {EVENT_SQL},
    z AS (SELECT e.event_id, e.su, {", ".join(f"abs(({c} - d{c}) / CASE WHEN m{c} = 0 THEN 1.253314 * a{c} ELSE 1.486 * m{c} END) AS {f}" for f, c in FEATURES.items())}
          FROM {LOSS_SQL.format(rows="ev")} e JOIN md USING (su) JOIN ma USING (su))
    SELECT event_id, su AS split_user, 'modz' AS z_loss_scaler_type, round(value, 5) AS value_z_loss, round(k, 5) AS k_z_loss, round(app, 5) AS app_z_loss,
           round(greatest(value, k, app), 5) AS max_abs_z, round((value + k + app) / 3, 5) AS mean_abs_z FROM z
    """,
)
def fingerprint_modz(spark, sf_dir):
    return rounded_scores(spark, sf_dir, "modz", True)


@query(
    "fingerprint_gauss_rank",
    f"""
    WITH {MODEL_SQL}, l AS {LOSS_SQL.format(rows="sp")},
    q AS (SELECT su, {", ".join(f"list_transform(quantile_cont({c}, [{', '.join(str(j / 32) for j in range(33))}]), lambda x: round(x, 9)) AS q{c}" for c in FEATURES.values())} FROM l GROUP BY 1),
    {EVENT_SQL},
    o AS (SELECT event_id, su, {", ".join(f"round({c}, 9) AS {c}" for c in FEATURES.values())} FROM {LOSS_SQL.format(rows="ev")}),
    n AS (SELECT e.event_id, e.su, {", ".join(f"{c}, q{c}, len(list_filter(q{c}, lambda x: x < {c})) AS b{c}, len(list_filter(q{c}, lambda x: x <= {c})) AS u{c}" for c in FEATURES.values())}
          FROM o e JOIN q USING (su)),
    p AS (SELECT event_id, su, {", ".join(f'''greatest(1e-7, least(1 - 1e-7, CASE WHEN u{c} > b{c} THEN (b{c} + u{c} - 1) / 2 WHEN b{c} = 0 THEN 0 WHEN b{c} > 32 THEN 32
          ELSE b{c} - 1 + ({c} - q{c}[b{c}]) / (q{c}[b{c} + 1] - q{c}[b{c}]) END / 32)) AS {f}''' for f, c in FEATURES.items())} FROM n),
    z AS (SELECT event_id, su, {", ".join(f"{inverse_normal_sql(f)} AS {f}" for f in FEATURES)} FROM p)
    SELECT event_id, su AS split_user, 'gauss_rank_scaled' AS z_loss_scaler_type, round(value, 5) AS value_z_loss, round(k, 5) AS k_z_loss, round(app, 5) AS app_z_loss,
           round(greatest(value, k, app), 5) AS max_abs_z, round((value + k + app) / 3, 5) AS mean_abs_z FROM z
    """,
)
def fingerprint_gauss_rank(spark, sf_dir):
    return rounded_scores(spark, sf_dir, "gauss_rank_scaled", False)


@query(
    "model_comparison",
    f"""
    WITH {MODEL_SQL}, {LM_SQL},
    ev AS (SELECT CAST(user_id AS VARCHAR) AS su, * FROM {ROWS_SQL} UNION ALL SELECT 'generic_user', * FROM {ROWS_SQL}),
    z AS (SELECT l.user_id, l.su = 'generic_user' AS g, (abs((lv - mlv) / coalesce(nullif(slv, 0), 1)) + abs((lk - mlk) / coalesce(nullif(slk, 0), 1)) + abs((la - mla) / coalesce(nullif(sla, 0), 1))) / 3 AS z
          FROM {LOSS_SQL.format(rows="ev")} l JOIN lm ON lm.su = l.su)
    SELECT user_id, round(avg(z) FILTER (WHERE NOT g), 5) AS own_error, round(avg(z) FILTER (WHERE g), 5) AS generic_error,
           round(avg(z) FILTER (WHERE g) - avg(z) FILTER (WHERE NOT g), 5) AS gain FROM z GROUP BY 1
    """,
)
def model_comparison(spark, sf_dir):
    out = sco.compare_models(feature_rows(spark, sf_dir), "user_id", fitted(spark, sf_dir))
    return out.select("user_id", *[F.round(c, 5).alias(c) for c in ("own_error", "generic_error", "gain")])


@query(
    "baseline_zscore",
    "SELECT event_id, user_id, round((value - m) / sd, 6) AS z FROM events JOIN (SELECT event_type, avg(value) AS m, stddev_pop(value) AS sd FROM events GROUP BY 1) b USING (event_type)",
)
def baseline_zscore(spark, sf_dir):
    return with_baseline(events(spark, sf_dir), ["event_type"], "value").select("event_id", "user_id", F.round("z", 6).alias("z"))


@query(
    "validation_split",
    """
    WITH r AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
    SELECT event_id, user_id, i >= floor(n * 0.8) AS is_validation FROM r
    """,
)
def validation_split(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", "user_id", "ts")
    return sco.validation_split(rows, ["user_id"], "ts", "event_id", 0.2).select("event_id", "user_id", "is_validation")


@query(
    "model_versions",
    """
    WITH a AS (SELECT CAST(user_id AS VARCHAR) AS split_user, ts FROM events UNION ALL SELECT 'generic_user', ts FROM events),
    first AS (SELECT split_user, count(*) AS trained_rows, min(ts) AS min_time, max(ts) AS max_time, 1 AS version FROM a WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1),
    second AS (SELECT split_user, count(*) AS trained_rows, min(ts) AS min_time, max(ts) AS max_time, 2 AS version FROM a GROUP BY 1)
    SELECT split_user, max(version) AS version, arg_max(trained_rows, version) AS trained_rows, arg_max(max_time, version) AS max_time, count(*) AS fits
    FROM (SELECT * FROM first UNION ALL SELECT split_user, trained_rows, min_time, max_time, CASE WHEN split_user IN (SELECT split_user FROM first) THEN 2 ELSE 1 END FROM second) GROUP BY 1
    """,
)
def model_versions(spark, sf_dir):
    rows = events(spark, sf_dir)
    early = rows.filter(F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz"))
    first = sco.register_version(None, sco.training_summary(early, "user_id", "ts", ["value"]))
    models = sco.register_version(first, sco.training_summary(rows, "user_id", "ts", ["value"]))
    return models.groupBy("split_user").agg(
        F.max("version").alias("version"), F.max_by("trained_rows", "version").alias("trained_rows"),
        F.max_by("max_time", "version").alias("max_time"), F.count(F.lit(1)).alias("fits"),
    )


@query(
    "training_gate",
    """
    WITH m AS (SELECT user_id, count(*) AS trained_rows FROM events WHERE ts < TIMESTAMP '2024-01-10' GROUP BY 1), h AS (SELECT user_id, count(*) AS rows FROM events GROUP BY 1)
    SELECT CAST(h.user_id AS VARCHAR) AS split_user, rows, coalesce(trained_rows, 0) AS trained_rows, rows >= coalesce(trained_rows, 0) + 45 AS train FROM h LEFT JOIN m USING (user_id)
    """,
)
def training_gate(spark, sf_dir):
    rows = events(spark, sf_dir)
    early = rows.filter(F.col("ts") < F.lit("2024-01-10").cast("timestamp_ntz"))
    models = sco.register_version(None, sco.training_summary(early, "user_id", "ts", []))
    return sco.training_gate(rows, models, "user_id", 45)


@query("standard_scaler", f"SELECT event_id, round((value - m) / coalesce(nullif(sd, 0), 1), 6) AS scaled FROM events JOIN (SELECT user_id, avg(value) AS m, stddev_pop(value) AS sd FROM events GROUP BY 1) s USING (user_id)")
def standard_scaler(spark, sf_dir):
    out = sco.standard_scaled(events(spark, sf_dir), ["user_id"], "value", "scaled")
    return out.select("event_id", F.round("scaled", 6).alias("scaled"))


@query(
    "modified_scaler",
    """
    WITH m AS (SELECT user_id, quantile_disc(value, 0.5) AS med FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE r = (n + 1) // 2 GROUP BY 1),
    d AS (SELECT e.event_id, e.user_id, value - med AS diff, abs(value - med) AS dev FROM events e JOIN m USING (user_id)),
    a AS (SELECT user_id, max(dev) AS mad FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY dev) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM d) WHERE r = (n + 1) // 2 GROUP BY 1),
    v AS (SELECT user_id, coalesce(nullif(avg(dev), 0), 1) AS mean_ad FROM d GROUP BY 1)
    SELECT event_id, round(diff / CASE WHEN mad = 0 THEN 1.253314 * mean_ad ELSE 1.486 * mad END, 6) AS scaled FROM d JOIN a USING (user_id) JOIN v USING (user_id)
    """,
)
def modified_scaler(spark, sf_dir):
    out = sco.modified_scaled(events(spark, sf_dir), ["user_id"], "value", "scaled")
    return out.select("event_id", F.round("scaled", 6).alias("scaled"))


@query(
    "gauss_rank_scaler",
    f"""
    WITH r AS (SELECT event_id, event_type, value, rank() OVER (PARTITION BY event_type ORDER BY value) AS r,
                      count(*) OVER (PARTITION BY event_type, value) AS c, count(*) OVER (PARTITION BY event_type) AS n FROM events),
    p AS (SELECT event_id, event_type, (r - 1 + c / 2.0) / n AS p FROM r)
    SELECT event_id, event_type, round({inverse_normal_sql("p")}, 6) AS scaled FROM p
    """,
)
def gauss_rank_scaler(spark, sf_dir):
    out = sco.gauss_rank_scaled(events(spark, sf_dir), ["event_type"], "value", "scaled")
    return out.select("event_id", "event_type", F.round("scaled", 6).alias("scaled"))


@query("node_standardise", "SELECT o_orderkey, round((o_totalprice - m) / (0.0001 + sd), 6) AS o_totalprice FROM orders, (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS sd FROM orders)")
def node_standardise(spark, sf_dir):
    out = graph.standardise(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"])
    return out.withColumn("o_totalprice", F.round("o_totalprice", 6))


SUB_SQL = "CASE event_type WHEN 'error' THEN 'Impossible Travel' WHEN 'click' THEN 'Unusual Browser' WHEN 'view' THEN 'Unknown Device' WHEN 'purchase' THEN 'Unusual Application' ELSE 'Elsewhere' END"


def risk_rows(spark, sf_dir):
    kind, k = F.col("event_type"), F.col("k")
    sub = (
        F.when(kind == "error", "Impossible Travel").when(kind == "click", "Unusual Browser").when(kind == "view", "Unknown Device")
        .when(kind == "purchase", "Unusual Application").otherwise("Elsewhere")
    )
    event = F.to_json(
        F.struct(
            F.struct(
                F.struct(
                    (k > 50).alias("isManaged"), (k > 30).alias("isCompliant"),
                    F.when(k > 80, "Azure AD Joined").when(k > 60, "Registered").alias("trustType"),
                    F.when(k > 70, "Android").when(k > 20, "Windows 11").alias("operatingSystem"),
                ).alias("deviceDetail")
            ).alias("properties"),
            F.struct(F.when(k < 25, "Iran").when(k < 75, "France").otherwise("US").alias("countryOrRegion")).alias("location"),
        )
    )
    enrichment = F.to_json(
        F.struct(
            F.struct((k * 20).alias("total_events"), F.when(k > 10, "profile").alias("baseline_source")).alias("user_baseline"),
            F.struct((k % 6).alias("related_anomalies_count")).alias("graph_context"),
            (k < 5).alias("cold_start"),
        )
    )
    raw = F.to_json(F.struct((k % 4 + 1).alias("feature_count")))
    rows = detections(spark, sf_dir).withColumns({"sub": sub, "event": event, "enrichment": enrichment, "raw": raw})
    features = risk.risk_features(
        F.col("event"), F.col("enrichment"), F.col("raw"), F.col("score"), F.col("score"), F.col("sub"), F.col("severity"),
        F.lit(0.9), F.col("k") / 100,
    )
    return rows.select("event_id", "user_id", "k", "severity", "event_type", "score", *[c.alias(f"f_{n}") for n, c in features.items()]), {
        n: F.col(f"f_{n}") for n in features
    }


RISK_SQL = f"""(
  SELECT *, least(greatest(base * (0.5 + 0.5 * least(score / 20, 1)) * boost * 100, 0), 100) AS risk FROM (
    SELECT *, CASE {SUB_SQL} WHEN 'Impossible Travel' THEN 0.9 WHEN 'Unusual Browser' THEN 0.45 WHEN 'Unknown Device' THEN 0.75 WHEN 'Unusual Application' THEN 0.55 ELSE 0.4 END
        * CASE severity WHEN 'CRITICAL' THEN 1.0 WHEN 'HIGH' THEN 0.8 WHEN 'MEDIUM' THEN 0.55 ELSE 0.3 END AS base,
      1 + CASE WHEN k > 50 THEN 0 ELSE 0.2 END + CASE WHEN k > 30 THEN 0 ELSE 0.15 END + CASE WHEN k < 25 THEN 0.25 ELSE 0 END + CASE WHEN k > 10 THEN 0 ELSE 0.1 END
        + CASE WHEN k % 6 > 2 THEN 0.15 ELSE 0 END + CASE WHEN k < 5 THEN 0.05 ELSE 0 END AS boost FROM {DETECTIONS_SQL}))"""


@query(
    "risk_score",
    f"""
    SELECT event_id, round(risk, 4) AS risk_score, k % 4 + 1 AS feature_count, CASE WHEN k > 80 THEN 1.0 WHEN k > 60 THEN 0.5 ELSE 0.0 END AS trust,
      CASE WHEN k > 70 THEN 0.7 WHEN k > 20 THEN 0.3 ELSE 0.5 END AS os_risk, CASE WHEN k < 75 THEN 1 ELSE 0 END AS is_foreign,
      array_to_string(list_filter([CASE WHEN k < 25 THEN 'High-risk country' END, CASE WHEN k <= 50 THEN 'Unmanaged device' END, CASE WHEN k <= 30 THEN 'Non-compliant device' END,
        CASE WHEN score > 5 THEN 'High anomaly score (' || printf('%.1f', score) || ')' END, CASE WHEN k % 6 > 2 THEN 'Repeated anomalies (' || (k % 6) || ' prior)' END,
        CASE WHEN event_type IN ('error', 'view') THEN 'High-risk anomaly category' END], lambda x: x IS NOT NULL), '; ') AS drivers,
      array_to_string(list_filter([CASE WHEN k > 50 THEN 'Managed device' END, CASE WHEN k > 30 THEN 'Compliant device' END, CASE WHEN k > 10 THEN 'Established user baseline' END,
        CASE WHEN k > 80 THEN 'High validation confidence (' || k || '%)' END], lambda x: x IS NOT NULL), '; ') AS mitigators
    FROM {RISK_SQL}
    """,
)
def risk_score(spark, sf_dir):
    rows, f = risk_rows(spark, sf_dir)
    return rows.select(
        "event_id", F.round(risk.heuristic_risk(f), 4).alias("risk_score"), F.col("f_feature_count").cast("bigint").alias("feature_count"),
        F.col("f_trust_score").alias("trust"), F.col("f_os_risk").alias("os_risk"), F.col("f_is_foreign").cast("int").alias("is_foreign"),
        F.array_join(risk.risk_drivers(f), "; ").alias("drivers"), F.array_join(risk.risk_mitigators(f), "; ").alias("mitigators"),
    )


@query(
    "confidence_blend",
    f"""
    WITH c AS (SELECT event_id, round((CASE WHEN k < 20 THEN 0.65 ELSE 0.4 END) * least(greatest(risk / 100, 0), 1), 4) AS r, round(0.35 * least(greatest(score / 8, 0), 1), 4) AS d,
               round(CASE WHEN k < 20 THEN 0 ELSE 0.25 * (k / 100) END, 4) AS m FROM {RISK_SQL})
    SELECT event_id, round(least(1, r + d + m), 4) AS confidence, r AS risk, d AS deviation, m AS model FROM c
    """,
)
def confidence_blend(spark, sf_dir):
    rows, f = risk_rows(spark, sf_dir)
    model = F.when(F.col("k") >= 20, F.col("k") / 100)
    return rows.select("event_id", risk.confidence_blend(risk.heuristic_risk(f), F.col("score"), model).alias("c")).select("event_id", "c.*")


@query(
    "ensemble_vote",
    f"""
    WITH d AS (SELECT * FROM {DETECTIONS_SQL}),
    l AS (SELECT user_id, k // 10 AS band, count(*) FILTER (WHERE score >= 2.5) AS t, count(*) FILTER (WHERE score < 2.5) AS f, avg(score) FILTER (WHERE score >= 2.5) AS m FROM d GROUP BY 1, 2),
    g AS (SELECT user_id, count(*) - 1 AS related FROM d GROUP BY 1),
    v AS (SELECT d.event_id, d.score > 3 AS lv, CASE WHEN k < 30 THEN 0.0 ELSE k / 100 END AS lc, f <= t AS sv,
            CASE WHEN f <= t AND m > 0 THEN round(greatest(t, f) / (t + f) * least(d.score / m, 1), 2) ELSE greatest(t, f) / (t + f) END AS sc,
            related > 0 AS gv, CASE WHEN related > 0 THEN least(related / (related + 5.0), 0.75) ELSE 0 END AS gc
          FROM d JOIN l ON l.user_id = d.user_id AND l.band = d.k // 10 JOIN g ON g.user_id = d.user_id),
    w AS (SELECT event_id, CAST(CASE WHEN lv THEN lc * 0.5 ELSE 0 END + CASE WHEN sv THEN sc * 0.3 ELSE 0 END + CASE WHEN gv THEN gc * 0.2 ELSE 0 END AS DOUBLE) AS ws,
            CAST(CASE WHEN lc > 0 THEN 0.5 ELSE 0 END + CASE WHEN sc > 0 THEN 0.3 ELSE 0 END + CASE WHEN gc > 0 THEN 0.2 ELSE 0 END AS DOUBLE) AS aw,
            CASE WHEN lc > 0 THEN 1 ELSE 0 END + CASE WHEN sc > 0 THEN 1 ELSE 0 END + CASE WHEN gc > 0 THEN 1 ELSE 0 END AS voters FROM v),
    s AS (SELECT *, CASE WHEN aw > 0 THEN ws / aw ELSE 0 END AS score FROM w)
    SELECT event_id, round(score, 6) AS score, round(least(abs(score - 0.65) * 2, 1), 6) AS confidence, voters AS active_methods,
      CASE WHEN score >= 0.65 AND abs(score - 0.65) * 2 < 0.35 AND voters <= 1 THEN 'uncertain' WHEN score >= 0.65 THEN 'anomaly' ELSE 'false positive' END AS verdict FROM s
    """,
)
def ensemble_vote(spark, sf_dir):
    rows = detections(spark, sf_dir).withColumn("band", F.floor(F.col("k") / 10))
    true_case = F.col("score") >= 2.5
    similar = rows.groupBy("user_id", "band").agg(
        F.count_if(true_case).alias("t"), F.count_if(~true_case).alias("f"), F.avg(F.when(true_case, F.col("score"))).alias("m")
    )
    related = rows.groupBy("user_id").agg((F.count(F.lit(1)) - 1).alias("related"))
    joined = rows.join(similar, ["user_id", "band"]).join(related, "user_id")
    votes = {
        "llm": (F.col("score") > 3, F.when(F.col("k") < 30, 0.0).otherwise(F.col("k") / 100)),
        "similarity": risk.similarity_vote(F.col("t"), F.col("f"), F.col("score"), F.col("m")),
        "graph": risk.graph_vote(F.col("related")),
    }
    out = joined.select("event_id", risk.ensemble_vote(votes).alias("v"))
    verdict = F.when(F.col("v.human_review_recommended"), "uncertain").when(F.col("v.is_anomaly"), "anomaly").otherwise("false positive")
    return out.select(
        "event_id", F.round("v.score", 6).alias("score"), F.round("v.confidence", 6).alias("confidence"), "v.active_methods", verdict.alias("verdict")
    )


@query("fft_count_anomalies")
def fft_count_anomalies(spark, sf_dir):
    return spectral.count_anomalies(events(spark, sf_dir), "user_id", "ts", "1 hour", zthresh=3)


@query("fft_velocity_anomalies")
def fft_velocity_anomalies(spark, sf_dir):
    rows = tr.travel_features(located(spark, sf_dir), "user_id", "ts", "event_id", "lat", "lon")
    return spectral.event_anomalies(rows, "user_id", "ts", "event_id", "travel_speed_kmph", zthresh=3)


@query(
    "timeseries_flags",
    """
    -- the reconstruction keeps the strongest tenth of the frequencies; stated as sums over each day's window. Two groups
    -- of users have dense signals, whose frequencies differ in energy by more than rounding
    WITH grouped AS (SELECT event_id, ts, user_id % 2 AS user_id FROM events),
    s AS (SELECT event_id, user_id, CAST(ts AS DATE) AS day, CAST(round(epoch_us(ts) / 1e6) AS BIGINT) AS sec FROM grouped),
    o AS (SELECT user_id, CAST(epoch_us(date_trunc('day', min(ts))) // 1000000 AS BIGINT) AS t0 FROM grouped GROUP BY 1),
    e AS (SELECT event_id, s.user_id, day, (sec - t0) // 3600 AS bin FROM s JOIN o ON o.user_id IS NOT DISTINCT FROM s.user_id),
    c AS (SELECT user_id, bin, count(*)::DOUBLE AS n FROM e GROUP BY 1, 2),
    x AS (SELECT user_id, min(bin) AS first, max(bin) AS last FROM c GROUP BY 1),
    b AS (SELECT user_id, day, min(bin) AS lo, max(bin) AS hi FROM e GROUP BY 1, 2),
    g AS (SELECT b.*, first, last, min(CASE WHEN first <= lo - 12 THEN day END) OVER (PARTITION BY b.user_id) AS since FROM b JOIN x ON x.user_id IS NOT DISTINCT FROM b.user_id),
    w AS (SELECT user_id, day, lo, hi, hi - lo + 25 AS len FROM g WHERE day >= since AND last >= hi + 12),
    v AS (SELECT w.user_id, w.day, w.lo, w.hi, w.len, i.i, coalesce(sum(c.n), 0) AS x
          FROM w CROSS JOIN (SELECT unnest(range(0, 60)) AS i) i LEFT JOIN c ON c.user_id IS NOT DISTINCT FROM w.user_id AND c.bin BETWEEN lo - 12 AND hi + 12
            AND least(c.bin - lo + 13, len - 1) = i.i WHERE i.i < len GROUP BY ALL),
    z AS (SELECT *, avg(x) OVER q AS mu, stddev_pop(x) OVER q AS sd FROM v WINDOW q AS (PARTITION BY user_id, day)),
    k AS (SELECT user_id, day, k, any_value(len) AS len, sum(x * cos(2 * pi() * k * i / len)) AS re, -sum(x * sin(2 * pi() * k * i / len)) AS im,
                 sum((x - mu) * cos(2 * pi() * k * i / len)) AS cr, sum((x - mu) * sin(2 * pi() * k * i / len)) AS ci, any_value(sd) AS sd
          FROM z CROSS JOIN (SELECT unnest(range(0, 31)) AS k) WHERE k <= len // 2 GROUP BY ALL),
    p AS (SELECT *, (cr * cr + ci * ci) / len / (CASE WHEN sd = 0 THEN 1 ELSE sd * sd END) AS energy FROM k),
    t AS (SELECT user_id, day, quantile_cont(energy, 0.9) AS least_energy FROM p GROUP BY ALL),
    r AS (SELECT z.user_id, z.day, z.i, any_value(z.lo) AS lo, any_value(z.hi) AS hi, any_value(z.x) AS x,
                 sum(CASE WHEN p.energy < t.least_energy THEN 0 ELSE (CASE WHEN p.k = 0 OR 2 * p.k = p.len THEN 1 ELSE 2 END)
                     * (p.re * cos(2 * pi() * p.k * z.i / p.len) - p.im * sin(2 * pi() * p.k * z.i / p.len)) END / p.len) AS y
          FROM z JOIN p ON p.user_id IS NOT DISTINCT FROM z.user_id AND p.day = z.day JOIN t ON t.user_id IS NOT DISTINCT FROM z.user_id AND t.day = z.day GROUP BY ALL),
    d AS (SELECT *, abs(y - x) AS err FROM r),
    q AS (SELECT *, avg(err) OVER q AS me, stddev_pop(err) OVER q AS se FROM d WINDOW q AS (PARTITION BY user_id, day)),
    f AS (SELECT user_id, day, lo - 13 + i AS bin FROM q WHERE se > 0 AND abs(err - me) / se >= 3 AND lo - 13 + i BETWEEN lo AND hi)
    SELECT e.event_id, e.user_id, f.bin IS NOT NULL AS ts_anomaly FROM e LEFT JOIN f ON f.user_id IS NOT DISTINCT FROM e.user_id AND f.day = e.day AND f.bin = e.bin
    """,
)
def timeseries_flags(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", (F.col("user_id") % 2).alias("user_id"), "ts", F.to_date("ts").alias("day"))
    out = spectral.timeseries_flags(rows, "user_id", "ts", "day", zthresh=3)
    return out.select("event_id", "user_id", "ts_anomaly")


@query("count_signal", "SELECT user_id, date_trunc('hour', ts) AS bin, count(*) AS n FROM events GROUP BY 1, 2")
def count_signal(spark, sf_dir):
    return spectral.count_signal(events(spark, sf_dir), "user_id", "ts")


@query("representation_pca")
def representation_pca(spark, sf_dir):
    rows = keyed_events(spark, sf_dir).withColumn("hour", F.hour("ts").cast("double"))
    out = learning.row_vectors(rows, ["value", "k", "hour"], 2)
    return out.select("event_id", F.round(F.col("representation")[0], 6).alias("r0"), F.round(F.col("representation")[1], 6).alias("r1"))


@query("text_classifier")
def text_classifier(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", F.lit(0.9).alias("weight")))
    counted = learning.term_counts(docs, "text")
    model = learning.text_classifier("lang", "weight").fit(counted)
    return learning.classify(model, counted).select("doc_id", "lang", "predicted", F.round("confidence", 4).alias("confidence"))


@query("risk_regressor")
def risk_regressor(spark, sf_dir):
    rows, f = risk_rows(spark, sf_dir)
    rows = rows.withColumn("target", risk.heuristic_risk(f))
    names = [f"f_{n}" for n in f]
    model = learning.risk_regressor(rows, names, "target")
    return learning.predict_risk(model, rows).select("event_id", "target", F.round("predicted_risk", 4).alias("predicted_risk"))


@query(
    "document_scores",
    """
    WITH w AS (SELECT doc_id, substring(text, i * 200 + 1, 200) AS part FROM (SELECT doc_id, text, unnest(range(greatest(1, CAST(ceil(length(text) / 200.0) AS INTEGER)))) AS i FROM documents WHERE length(text) > 0))
    SELECT doc_id, round(max(length(regexp_replace(part, '[^0-9]', '', 'g')) / 200.0), 6) AS digits, round(max(length(regexp_replace(part, '[^A-Z]', '', 'g')) / 200.0), 6) AS capitals FROM w GROUP BY 1
    """,
)
def document_scores(spark, sf_dir):
    """Two simple scores per text window, and the document's scores from its windows."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    parts = docs.select("doc_id", F.explode(window_chunks(F.col("text"), 200, 0)).alias("part"))

    def share(pattern):
        return F.char_length(F.regexp_replace("part", pattern, "")) / 200.0

    windows = parts.select("doc_id", F.array(share("[^0-9]"), share("[^A-Z]")).alias("probs"))
    out = learning.document_scores(windows, "doc_id", "probs", 2)
    return out.select("doc_id", F.round(F.col("probs")[0], 6).alias("digits"), F.round(F.col("probs")[1], 6).alias("capitals"))


@query("risk_contributions")
def risk_contributions(spark, sf_dir):
    rows, f = risk_rows(spark, sf_dir)
    rows = rows.withColumn("target", risk.heuristic_risk(f))
    names = ["f_anomaly_score", "f_sub_category_risk", "f_severity_score", "f_is_managed", "f_is_high_risk_country"]
    weights, means = learning.linear_surrogate(rows, names, "target")
    out = sco.contributions(rows, weights, means)
    return out.select("event_id", F.array_join("top_drivers.feature", ",").alias("drivers"), F.array_join("top_mitigators.feature", ",").alias("mitigators"))


@query("daily_counts", f"SELECT CAST(ts AS DATE) AS ds, count(*) AS y FROM {DETECTIONS_SQL} WHERE k > 2 OR (SELECT count(*) FROM {DETECTIONS_SQL} WHERE k > 2) < 500 GROUP BY 1")
def daily_counts(spark, sf_dir):
    rows = detections(spark, sf_dir).withColumn("real", F.col("k") > 2)
    return learning.daily_counts(rows, "ts", "real", only_real=learning.enough_real(rows, "real"))


@query("forecast")
def forecast(spark, sf_dir):
    return learning.forecast(learning.daily_counts(detections(spark, sf_dir), "ts"), 14)


TREE_FEATURES, TREES, TREE_DEPTH = ["value", "k", "hour"], 3, 3


def tree_sql() -> str:
    """The ensemble fitted round by round, its node table, and every event's walk down it."""
    base = f"SELECT event_id, user_id, value, CAST({K_SQL} AS DOUBLE) AS k, CAST(hour(ts) AS DOUBLE) AS hour, CAST(event_type = 'error' AS INT)::DOUBLE AS y FROM events"
    steps, nodes = [f"r0 AS ({base})"], []
    for t in range(TREES):
        asked = [TREE_FEATURES[(t + level) % 3] for level in range(TREE_DEPTH)]
        shares = [(t + 1 + level * TREES) / (TREES * TREE_DEPTH + 1) for level in range(TREE_DEPTH)]
        cell = "1"
        for level, f in enumerate(asked):
            cell = f"2 * ({cell}) + CASE WHEN {f} <= q{level} THEN 0 ELSE 1 END"
        steps += [
            f"c{t} AS (SELECT {', '.join(f'round(quantile_cont({f}, {q}), 6) AS q{level}' for level, (f, q) in enumerate(zip(asked, shares)))} FROM r0)",
            f"s{t} AS (SELECT r{t}.*, {cell} AS cell FROM r{t}, c{t})",
            f"l{t} AS (SELECT cell, 0.5 * sum(y) / (count(y) + 1) AS leaf FROM s{t} GROUP BY 1)",
            f"r{t + 1} AS (SELECT event_id, user_id, value, k, hour, y - leaf AS y FROM s{t} JOIN l{t} USING (cell))",
        ]
        nodes += [f"SELECT {t} AS tree, {n} AS node, '{asked[n.bit_length() - 1]}' AS feature, q{n.bit_length() - 1} AS threshold, NULL::DOUBLE AS leaf FROM c{t}" for n in range(1, 8)]
        nodes.append(f"SELECT {t}, cell, NULL, NULL, leaf FROM l{t}")
    return f"""{", ".join(steps)}, nodes AS ({" UNION ALL ".join(nodes)}),
    w AS (SELECT event_id, tree, 1 AS node FROM r0, (SELECT unnest(range({TREES})) AS tree)
          UNION ALL
          SELECT w.event_id, w.tree, 2 * w.node + CASE WHEN CASE n.feature WHEN 'value' THEN r0.value WHEN 'k' THEN r0.k ELSE r0.hour END <= n.threshold THEN 0 ELSE 1 END
          FROM w JOIN nodes n ON n.tree = w.tree AND n.node = w.node AND n.feature IS NOT NULL JOIN r0 ON r0.event_id = w.event_id),
    scores AS (SELECT w.event_id, sum(n.leaf) AS score FROM w JOIN nodes n ON n.tree = w.tree AND n.node = w.node AND n.feature IS NULL GROUP BY 1)"""


def tree_scored(spark, sf_dir):
    """A boosted ensemble fitted on the events, stored, and walked by all of them."""
    rows = keyed_events(spark, sf_dir).withColumn("hour", F.hour("ts"))
    nodes = trees.fit_oblivious(rows.withColumn("y", (F.col("event_type") == "error").cast("int")), TREE_FEATURES, "y", TREE_DEPTH, TREES)
    return trees.ensemble_scores(rows.select("event_id", "user_id", *TREE_FEATURES), nodes, TREE_FEATURES)


@query("tree_scores", f"WITH RECURSIVE {tree_sql()} SELECT event_id, round(score, 6) AS score, 1 / (1 + exp(-score)) > 0.54 AS score_flag FROM scores")
def tree_scores(spark, sf_dir):
    out = trees.flagged(tree_scored(spark, sf_dir), "score", 0.54)
    return out.select("event_id", F.round("score", 6).alias("score"), "score_flag")


@query(
    "tree_sequence_scores",
    f"WITH RECURSIVE {tree_sql()} SELECT user_id, round(max(score), 6) AS score, count(*) AS rows FROM scores JOIN events USING (event_id) GROUP BY 1",
)
def tree_sequence_scores(spark, sf_dir):
    return trees.sequence_scores(tree_scored(spark, sf_dir), "user_id", "score").withColumn("score", F.round("score", 6))
