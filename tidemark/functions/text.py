"""Text clean-up, chunking, sensitive-data detection and token helpers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.risk import risk_level

# Risk weight of a sensitive data type.
TYPE_WEIGHTS = {
    "password": 85,
    "credit_card_number": 90,
    "ssn": 95,
    "street_address": 60,
    "email": 40,
    "phone_number": 45,
    "ipv4": 30,
    "ipv6": 30,
    "date": 20,
    "date_time": 20,
    "time": 20,
    "api_key": 80,
    "customer_id": 65,
    "health_plan_beneficiary_number": 75,
    "medical_record_number": 75,
}
DEFAULT_WEIGHT = 50


def normalise_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def paragraphs(df: DataFrame, text: str, doc: str, split: bool = True) -> DataFrame:
    """One row per line, with ``original_source_index`` and the line number."""
    if not split:
        return df.withColumn(text, normalise_newlines(F.col(text)))
    return df.select(
        F.col(doc).alias("original_source_index"),
        F.posexplode(F.split(normalise_newlines(F.col(text)), "\n")).alias("line_no", "source_text"),
    )


def combined(patterns: Sequence[str]) -> str:
    return patterns[0] if len(patterns) == 1 else "|".join(f"(?:{p})" for p in patterns)


def detect(df: DataFrame, text: str, patterns: Mapping[str, Sequence[str]]) -> DataFrame:
    """Rows matching any type, with ``types`` (array) and ``labels`` (comma text)."""
    hits = [F.when(F.col(text).rlike(combined(p)), F.lit(name)) for name, p in patterns.items()]
    return (
        df.withColumn("types", F.array_compact(F.array(*hits)))
        .filter(F.size("types") > 0)
        .withColumn("labels", F.array_join("types", ", "))
    )


def document_risk(
    findings: DataFrame,
    doc: str,
    data_type: str = "data_type",
    confidence: str = "confidence",
    weights: Mapping[str, int] | None = None,
    default_weight: int = DEFAULT_WEIGHT,
) -> DataFrame:
    """One risk row per document from one row per finding; sums combine before the shuffle."""
    table = weights or TYPE_WEIGHTS
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    weight = F.coalesce(F.create_map(*pairs)[F.col(data_type)], F.lit(default_weight))
    scored = findings.withColumn("_w", weight).withColumn("_level", risk_level(F.col("_w")))
    levels = ["minimal", "low", "medium", "high", "critical"]
    out = scored.groupBy(doc).agg(
        F.sum(F.col("_w") * F.col(confidence)).alias("_total"),
        F.count(F.lit(1)).alias("_n"),
        F.max(confidence).alias("highest_confidence"),
        F.sort_array(F.collect_set(data_type)).alias("data_types_found"),
        *[F.count_if(F.col("_level") == name).alias(f"num_{name}") for name in levels],
    )
    # Python's round is half-to-even, hence bround.
    score = F.bround(F.least(F.lit(100.0), F.col("_total") / F.col("_n")), 0).cast("int")
    return out.select(
        doc,
        score.alias("risk_score"),
        F.initcap(risk_level(score)).alias("risk_level"),
        "data_types_found",
        "highest_confidence",
        *[f"num_{name}" for name in levels],
    )


def window_chunks(text: Column, size: int, overlap: int) -> Column:
    """Array of fixed-size character windows; neighbours share ``overlap`` characters."""
    step = size - overlap
    n = F.char_length(text)
    last = F.greatest(F.lit(0), F.ceil((n - overlap) / step).cast("int") - 1)
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(
        F.transform(
            F.sequence(F.lit(0), last), lambda i: F.substring(text, i * step + 1, F.lit(size))
        )
    )


def _split_on(text: str, separators: Sequence[str], size: int) -> list[str]:
    """Cut a text at the coarsest separator that occurs, and its long parts at finer ones."""
    sep = next((s for s in separators if s and s in text), "")
    finer = separators[list(separators).index(sep) + 1 :] if sep in separators else ()
    parts = text.split(sep) if sep else list(text)
    out: list[str] = []
    for i, part in enumerate(parts):
        piece = (sep + part) if sep and i else part
        if len(piece) > size and sep:
            out.extend(_split_on(piece, finer or ("",), size))
        elif piece:
            out.append(piece)
    return out


def _pack(pieces: Sequence[str], size: int, overlap: int) -> list[str]:
    chunks: list[str] = []
    held: list[str] = []
    length = 0
    for piece in pieces:
        if held and length + len(piece) > size:
            chunks.append("".join(held).strip())
            while held and (length > overlap or length + len(piece) > size):
                length -= len(held.pop(0))
        held.append(piece)
        length += len(piece)
    if held:
        chunks.append("".join(held).strip())
    return [c for c in chunks if c]


def separator_chunks(size: int, overlap: int, separators: Sequence[str] = ("\n\n", "\n", " ", "")):
    """Pandas UDF: chunks cut at separators, coarse ones first, packed up to ``size`` characters."""
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")

    @F.pandas_udf("array<string>")
    def chunk(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [] if t is None else _pack(_split_on(t, separators, size), size, overlap))

    return chunk


# Character references decoded when markup is stripped, in the order they are replaced.
CHARACTER_REFERENCES = [
    ("&nbsp;", "\u00a0"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&amp;", "&"),
]


def strip_markup(html: Column) -> Column:
    """Text content: comments, declarations and tags removed, common references decoded."""
    text = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    text = F.regexp_replace(text, r"(?s)<[!/a-zA-Z?][^>]*>", "")
    for reference, character in CHARACTER_REFERENCES:
        text = F.replace(text, F.lit(reference), F.lit(character))
    return text


def row_text(*columns: Column, sep: str = " ") -> Column:
    return F.concat_ws(sep, *columns)


def recipient_features(to: Column, bcc: Column, cc: Column, message: Column, sep: str = "[SEP]") -> dict[str, Column]:
    counts = {name: F.regexp_count(c, F.lit("@")) for name, c in (("to", to), ("bcc", bcc), ("cc", cc))}
    total = counts["to"] + counts["bcc"] + counts["cc"]
    data = F.concat(
        *[x for c in (*counts.values(), total) for x in (c.cast("string"), F.lit(sep))], message
    )
    return {
        "to_count": counts["to"],
        "bcc_count": counts["bcc"],
        "cc_count": counts["cc"],
        "total_recipients": total,
        "data": data,
    }


# Fixed values: (pattern, replacement) pairs that undo token spacing, applied in this order.
TOKEN_SPACING = [
    (r"\s+##", ""),
    (r"\s+\.+\s", "."),
    (r"\s+:+\s", ":"),
    (r"\s+\|+\s", "|"),
    (r"\s+\++\s", "+"),
    (r"\s+\-+\s", "-"),
    (r"\s+\<", "<"),
    (r"\<+\s", "<"),
    (r"\s+\>", ">"),
    (r"\>+\s", ">"),
    (r"\s+\=+\s", "="),
    (r"\s+\#+\s", "#"),
    (r"\[+\s", "["),
    (r"\s\]", "]"),
    (r"\(+\s", "("),
    (r"\s\)", ")"),
    (r"\s\"", '"'),
    (r"\"+\s", '"'),
    (r"\\+\s", '"'),
    (r"\s+_+\s", "_"),
    (r"\s+/", "/"),
    (r"/+\s", "/"),
    (r"\s+\?+\s", "?"),
    (r"\s+;+\s", "; "),
]


def clean_token_spacing(text: Column) -> Column:
    return reduce(lambda c, rule: F.regexp_replace(c, rule[0], rule[1]), TOKEN_SPACING, text)


def tokens_by_label(df: DataFrame, tokens: str, labels: str, out: str) -> DataFrame:
    """Add a map from label to its space-joined tokens; a sub-word (``##x`` or ``.x``) keeps the last label.

    Each step is its own projection, so that an array is built once per row however often it is used.
    """
    pairs = F.transform(F.arrays_zip(labels, tokens), lambda p: F.struct(p[labels].alias("label"), p[tokens].alias("token")))
    rows = df.withColumn("_pairs", pairs).withColumn("_carried", _carried(F.col("_pairs")))
    rows = rows.withColumn("_names", F.array_distinct("_carried.label"))
    texts = F.transform(
        "_names",
        lambda name: F.struct(
            name.alias("key"),
            F.array_join(
                F.transform(F.filter("_carried", lambda x: x["label"] == name), lambda x: x["token"]), " "
            ).alias("value"),
        ),
    )
    return rows.withColumn(out, F.map_from_entries(texts)).drop("_pairs", "_carried", "_names")


def _carried(indexed: Column) -> Column:
    """Pairs with each sub-word's label replaced by that of the last whole word; leading sub-words drop out."""
    return F.aggregate(
        indexed,
        F.struct(
            F.lit(None).cast("string").alias("last"),
            F.array().cast("array<struct<label:string,token:string>>").alias("out"),
        ),
        lambda acc, x: _carry_label(acc, x),
        lambda acc: acc["out"],
    )


def _carry_label(acc: Column, x: Column) -> Column:
    subword = x["token"].startswith("##") | x["token"].startswith(".")
    label = F.when(subword, acc["last"]).otherwise(x["label"])
    grown = F.array_append(acc["out"], F.struct(label.alias("label"), x["token"].alias("token")))
    return F.struct(label.alias("last"), F.when(label.isNull(), acc["out"]).otherwise(grown).alias("out"))


def entity_text(label_map: Column, entity: str) -> Column:
    """Begin and inside tokens of one entity, cleaned: ``B-x`` text, then ``I-x`` text."""
    begin = label_map[F.lit(f"B-{entity}")]
    inside = F.coalesce(label_map[F.lit(f"I-{entity}")], F.lit(""))
    return clean_token_spacing(F.concat(begin, F.lit(" "), inside))


def token_windows(tokens: Column, length: int, stride: int, pad: str = "[PAD]") -> Column:
    """Array of structs(start, tokens, mask): padded windows of ``length`` tokens every ``stride``.

    ``tokens`` should be a plain column: an expression would be evaluated again for every window.
    """
    n = F.size(tokens)
    last = F.greatest(F.lit(0), F.ceil((n - length) / stride).cast("int"))

    def window(i: Column) -> Column:
        part = F.slice(tokens, i * stride + 1, F.lit(length))
        missing = F.lit(length) - F.size(part)
        return F.struct(
            (i * stride).alias("start"),
            F.concat(part, F.array_repeat(F.lit(pad), missing)).alias("tokens"),
            F.concat(
                F.array_repeat(F.lit(1), F.size(part)), F.array_repeat(F.lit(0), missing)
            ).alias("mask"),
        )

    return F.transform(F.sequence(F.lit(0), last), window)


def reassemble_slices(df: DataFrame, doc: str, start: str, values: Sequence[str]) -> DataFrame:
    """Concatenate per-window array slices of each document in window order."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(start), *values)))
    out = df.groupBy(doc).agg(parts.alias("_p"))
    return out.select(doc, *[F.flatten(F.col("_p")[v]).alias(v) for v in values])


def numeric_matrix(columns: Sequence[Column]) -> Column:
    """Float array; text is reduced to its digits and decimal point first."""
    cleaned = [F.regexp_extract(c.cast("string"), r"(\d+\.?\d*)", 1).try_cast("double") for c in columns]
    return F.array(*cleaned)


def named_scores(probs: Column, names: Sequence[str], threshold: float | None = None) -> dict[str, Column]:
    """Probability array to named columns, or booleans above ``threshold``; too few outputs is an error."""
    checked = F.when(F.size(probs) >= len(names), probs).otherwise(
        F.raise_error(F.lit(f"model gives fewer outputs than the {len(names)} labels"))
    )
    out = {name: F.element_at(checked, i + 1) for i, name in enumerate(names)}
    return out if threshold is None else {n: c > threshold for n, c in out.items()}


def best_label(probs: Column, names: Sequence[str], gate: float = 0.5) -> Column:
    top = F.array_max(probs)
    labels = F.array(*[F.lit(n) for n in names])
    position = F.array_position(probs, top).cast("int")
    return F.when(top >= gate, F.element_at(labels, position)).otherwise("none")


def fill_template(template: str, columns: Sequence[str]) -> Column:
    """Replace ``{column}`` by the row's value."""
    text = F.lit(template)
    for name in columns:
        text = F.replace(text, F.lit("{" + name + "}"), F.coalesce(F.col(name).cast("string"), F.lit("")))
    return text
