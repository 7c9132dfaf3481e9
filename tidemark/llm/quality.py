"""Quality rules with adaptive thresholds: quantile sketches per language and source replace fixed cutoffs.

A sketch counts values in buckets of constant relative width, so sketches merge by adding counts, in any order and
with the same result. They are kept per language and source, per language, and for all rows. What they hold is smoothed:
half a unit is added to a count, so that texts with none differ by how much their length tells, and a rule has a spread
where most counts are zero. A sketch's fence lies beyond its quartile by SPREAD times the distance of that quartile
from the median, on a log scale (log odds for shares); no fence has a fixed part. The fewer rows a sketch has, the more its
fence is drawn to that of the next wider sketch, by n / (n + PRIOR). A row fails a rule when what its text proves (its
count less two standard errors) lies beyond the tightest fence of its group, its language and all rows, so a source that
is mostly junk does not set its own limits. Word length differs between scripts: there, all rows count through the
shrinking only.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import session
from tidemark.llm import common

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\r\x0b\x0c"
WINDOW = 5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: Bucket width of a sketch (a value is known within 0.25 %), and the rows that the next wider sketch counts for in a fence.
GAMMA, PRIOR = 1.005, 10
#: The middle half of a sketch sets its fences, so junk hides only if it is over a quarter of every sketch it is in.
LOW, MIDDLE, HIGH = 0.25, 0.5, 0.75
SPREAD = 6


def share_rule(count: str, of: str, unit: int = 1) -> tuple[str, str | None, str | None]:
    """A rule on count / of, counts coming in clumps of ``unit``: (smoothed value, proven low or None, proven high)."""
    return f"({count} + {unit / 2}) / ({of} + {unit})", None, f"({count} - 2 * sqrt({unit} * {count})) / {of}"


#: rule -> (value for the sketches, what a text is held to at the lower fence, and at the upper one; None: no fence)
RULES = {
    "symbol_share": share_rule("n_symbols", "word_chars"),
    "dup_line_share": share_rule("n_dup_lines", "n_lines"),
    "repeat_share": share_rule("n_repeat_words", "n_words", 2 * WINDOW),
    "upper_share": share_rule("n_upper", "word_chars"),
    "word_length": (
        "word_chars / n_words",
        "word_chars / n_words * (1 + 2 / sqrt(n_words))",
        "word_chars / n_words * (1 - 2 / sqrt(n_words))",
    ),
}
#: Rules whose values depend on the language: a language is not held to the fence of all rows. Others are shares.
BY_LANGUAGE = ("word_length",)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper")
SALT = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
UPPER = bytes(range(65, 91))


def repeated_words(words: list[bytes]) -> int:
    """Words inside 5-word windows that occur twice or more in the text, first occurrences included."""
    n = len(words)
    if n <= WINDOW:
        return 0
    names = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    windows = np.zeros(n - WINDOW + 1, np.uint64)
    for k in range(WINDOW):
        windows += (names[k : n - WINDOW + 1 + k] ^ (names[k : n - WINDOW + 1 + k] >> np.uint64(31))) * SALT[k]
    order = np.sort(windows)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    edge = np.zeros(n + 1, np.int32)
    at = np.flatnonzero(np.isin(windows, twice))
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(edge)[:n]))


def measure(text: str) -> tuple[int, ...]:
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # bytes split at space and \x09-\x0D only
    lines = [line for line in data.split(b"\n") if line.strip()]
    spaces = sum(data.count(bytes([c])) for c in SPACES)
    return (
        len(words),
        len(text) - spaces,
        sum(data.count(bytes([c])) for c in SYMBOLS),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(data) - len(data.translate(None, UPPER)),
    )


def measured(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", source_col="source") -> DataFrame:
    """(id, lang, source, the measures), one row per input row; a null text measures as empty."""

    def scan(batches):
        for batch in batches:
            rows = [measure(t.as_py()) for t in batch.column("text")]
            values = np.array(rows, np.int64).reshape(len(rows), len(MEASURES))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("id", "lang", "source")] + [pa.array(values[:, k]) for k in range(len(MEASURES))],
                ["id", "lang", "source", *MEASURES],
            )

    common.prepare(docs.sparkSession)
    rows = docs.select(
        docs[id_col].cast("long").alias("id"),
        docs[lang_col].cast("string").alias("lang"),
        docs[source_col].cast("string").alias("source"),
        F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"),
    )
    schema = "id long, lang string, source string, " + ", ".join(f"{m} long" for m in MEASURES)
    return rows.mapInArrow(scan, schema)


def sketch_bucket(value):
    """Bucket of a value of at least 0: 0 for zero, else by constant ratio; ``bucket_value`` is its middle."""
    return F.when(value < 1e-6, F.lit(0)).otherwise(F.ceil(F.log(value / 1e-6) / math.log(GAMMA)) + 1).cast("int")


def bucket_value(bucket):
    middle = F.pow(F.lit(GAMMA), bucket - 1) * (2e-6 / (1 + GAMMA))
    return F.when(bucket == 0, F.lit(0.0)).otherwise(middle)


def scaled(rule, value):
    """A value on the scale of fences: log odds of a share, the logarithm of anything else."""
    return F.log(value) if rule in BY_LANGUAGE else F.log(value) - F.log1p(-F.least(value, F.lit(1 - 1e-9)))


def thresholds(rows: DataFrame, rules: dict = RULES) -> DataFrame:
    """(level, lang_key, source_key, n, lo_<rule>, hi_<rule>) from merged sketches, each sketch by itself.

    Level 0 is a language and source, 1 a language, 2 all rows; fences are on the scale of ``scaled``.
    """
    values = F.explode(
        F.array(*[F.struct(F.lit(r).alias("rule"), sketch_bucket(F.expr(e)).alias("bucket")) for r, (e, _, _) in rules.items()])
    )
    fine = (
        rows.filter("n_words > 0")
        .select("lang_key", "source_key", values.alias("v"))
        .groupBy("lang_key", "source_key", "v.rule", "v.bucket")
        .agg(F.count("*").alias("n"))
    )
    fine = session.durable(fine.filter("bucket is not null"))
    by_lang = fine.groupBy("lang_key", F.lit("*").alias("source_key"), "rule", "bucket").agg(F.sum("n").alias("n"))
    whole = fine.groupBy(F.lit("*").alias("lang_key"), F.lit("*").alias("source_key"), "rule", "bucket").agg(F.sum("n").alias("n"))
    out = None
    for level, sketch in enumerate((fine, by_lang, whole)):
        group = Window.partitionBy("lang_key", "source_key", "rule")
        up_to = group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        s = sketch.withColumns({"upto": F.sum("n").over(up_to), "all": F.sum("n").over(group)})
        at = lambda q: bucket_value(F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("bucket"))))
        s = s.groupBy("lang_key", "source_key", "rule").agg(
            F.max("all").alias("n"), at(LOW).alias("low"), at(MIDDLE).alias("middle"), at(HIGH).alias("high")
        )
        fences = []
        for rule, (_, below, above) in rules.items():
            low, middle, high = (scaled(rule, F.col(c)) for c in ("low", "middle", "high"))
            if below is not None:
                fences.append(F.max(F.when(F.col("rule") == rule, low - SPREAD * (middle - low))).alias(f"lo_{rule}"))
            if above is not None:
                fences.append(F.max(F.when(F.col("rule") == rule, high + SPREAD * (high - middle))).alias(f"hi_{rule}"))
        s = s.groupBy("lang_key", "source_key").agg(F.lit(level).alias("level"), F.max("n").alias("n"), *fences)
        out = s if out is None else out.unionByName(s)
    return out


def judged(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", source_col="source", rules: dict = RULES) -> DataFrame:
    """(id, the measures, base_failed, failed_rules, kept), one row per input row.

    Null languages and null sources are groups of their own. A text without words fails the base rule and is in no
    sketch. Repeated rows count each in the sketches; an empty table gives no rows. Thresholds come from all rows, and a
    group of one row is judged as one of a million, only with other weights. A long text is measured whole; its task
    holds that text, its words and eight bytes for each.
    """
    key = lambda c: F.coalesce(F.concat(F.lit("+"), c), F.lit("-"))
    rows = measured(docs, id_col, text_col, lang_col, source_col)
    rows = session.durable(rows.withColumns({"lang_key": key("lang"), "source_key": key("source")}))
    limits = session.durable(thresholds(rows, rules))
    groups = rows.groupBy("lang_key", "source_key").agg(F.count("*").alias("members"))
    bounds = [c for c in limits.columns if c[:3] in ("lo_", "hi_")]
    with_n = lambda name: F.struct("n", *bounds).alias(name)
    own = limits.filter("level = 0").select("lang_key", "source_key", with_n("own"))
    lang = limits.filter("level = 1").select("lang_key", with_n("lang_own"))
    whole = limits.filter("level = 2").select(with_n("whole"), F.lit(1).alias("one"))

    def tightest(bound):
        """Each sketch's fence drawn to the wider one's by its rows, then the tightest; nulls do not count."""
        drawn = [F.col(f"whole.{bound}")]
        for level in ("lang_own", "own"):
            n, wider = F.col(f"{level}.n"), drawn[-1]
            drawn.append(F.coalesce((n * F.col(f"{level}.{bound}") + PRIOR * wider) / (n + PRIOR), wider))
        pick = F.greatest if bound[:3] == "lo_" else F.least
        return pick(*(drawn[1:] if bound[3:] in BY_LANGUAGE else drawn)).alias(bound)

    chosen = (
        groups.join(own, ["lang_key", "source_key"], "left").join(lang, "lang_key", "left")
        .withColumn("one", F.lit(1)).join(F.broadcast(whole), "one", "left")
        .select("lang_key", "source_key", "members", *map(tightest, bounds))
    )
    rows = common.attach(rows, session.durable(chosen), ["lang_key", "source_key"], "members")
    # Bounds of texts without words are not asked for: their division by zero is an error in ANSI mode.
    broken = []
    for rule, (_, below, above) in rules.items():
        beyond = F.lit(False)
        if below is not None:
            beyond = beyond | (scaled(rule, F.expr(below)) < F.col(f"lo_{rule}"))
        if above is not None:
            proven = F.expr(above)
            beyond = beyond | F.when(proven > 0, scaled(rule, proven) > F.col(f"hi_{rule}")).otherwise(False)
        broken.append(F.when(F.col("n_words") > 0, F.when(F.coalesce(beyond, F.lit(False)), F.lit(rule))))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    rows = rows.withColumns({"base_failed": base, "failed_rules": F.array_compact(F.array(*broken))})
    return rows.select(
        "id", "lang", "source", *MEASURES, "base_failed", "failed_rules",
        (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"),
    )
