"""One query per operator, over the whole ``documents`` table, with its SQL twin where SQL can state it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import session
from tidemark.llm import (
    common, exact, language, licenses, manifest, mixing, neardup, pieces, pii, quality, resampling, suffix, tokens, vectordups,
)

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register


@query(
    "op9_exact_dedup",
    """
    SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
           doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
    """,
)
def op9_exact_dedup(spark, sf_dir):
    groups = exact.exact_groups(common.documents(spark, sf_dir))
    return groups.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


@query("op4_source_mixture")
def op4_source_mixture(spark, sf_dir):
    mixed = mixing.mixture(common.documents(spark, sf_dir))
    return mixed.select(F.col("id").alias("doc_id"), "source", "size", "source_size", "weight", "target", "taken")


@query("op1_pii_spans")
def op1_pii_spans(spark, sf_dir):
    """Counts of the base kinds, a hash of the base spans, and all spans with their scores."""
    found = pii.pii_spans(common.documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE_KINDS))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        F.col("id").alias("doc_id"),
        *[count(k) for k in pii.BASE_KINDS],
        F.sha2(pii.joined(base).cast("binary"), 256).alias("base_sha256"),
        pii.joined(F.col("spans")).alias("spans"),
        F.transform("spans", lambda s: s["score"]).alias("scores"),
    )


@query("op6_token_files")
def op6_token_files(spark, sf_dir):
    """Writes the token files and answers from them."""
    import public_tokenizers

    docs = common.documents(spark, sf_dir)
    folder = session.scratch_dir(spark, "tokens")
    tokens.write_tokens(docs, folder, public_tokenizers.path("byte_bpe_50k.json"), special_as_text=False)
    starts = tokens.token_starts(spark, folder)
    return tokens.digests(spark, folder).join(starts, "at").select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


@query("op8_quality_rules")
def op8_quality_rules(spark, sf_dir):
    judged = quality.judged(common.documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.array_join("failed_rules", ",").alias("failed_rules"),
    )


@query("op10_language_id")
def op10_language_id(spark, sf_dir):
    docs = common.documents(spark, sf_dir)
    held_out = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 4 == 2
    model = language.fit(docs.filter(~held_out & docs["lang"].isNotNull()))
    predicted = language.identified(docs, model).withColumnRenamed("id", "doc_id")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    return predicted.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "coverage")


@query(
    "op5_near_duplicates",
    r"""
    WITH RECURSIVE w AS (
      SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                     'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
    s AS (
      SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]]
                     ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || chr(1) || ws[i + 1]) END) AS sh FROM w),
    n AS (SELECT doc_id, len(sh) AS n_shingles FROM s),
    e AS (SELECT doc_id, unnest(sh) AS g FROM s),
    rare AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id
             GROUP BY ALL),
    l AS (SELECT a, b FROM rare JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
          WHERE 100 * shared >= 80 * (x.n_shingles + y.n_shingles - shared)),
    sym AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
    r AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, sym.b FROM r JOIN sym ON r.seen = sym.a)
    SELECT n.doc_id, n_shingles, min(seen) AS component_id, n.doc_id = min(seen) AS kept
    FROM n JOIN r ON r.node = n.doc_id GROUP BY n.doc_id, n_shingles
    """,
)
def op5_near_duplicates(spark, sf_dir):
    return neardup.near_duplicates(common.documents(spark, sf_dir), words=2).withColumnRenamed("id", "doc_id")


@query("op3_piece_samples")
def op3_piece_samples(spark, sf_dir):
    """Digests of three segmentations of every text, drawn without replacement."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    drawn = pieces.sampled(common.documents(spark, sf_dir), path, keep_ids=False)
    each = lambda name: F.transform("samples", lambda s: s[name]).alias(name)
    return drawn.select(
        F.col("id").alias("doc_id"), F.size("samples").alias("n_samples"),
        each("n_tokens"), each("ids_crc32"), each("log_prob"), each("inclusion"), "round_trip",
    )


@query("op2_repeated_passages")
def op2_repeated_passages(spark, sf_dir):
    return suffix.without_repeats(common.documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


@query("op7_license_scan")
def op7_license_scan(spark, sf_dir):
    """Documents as a tree of their sources: a hundred to a directory, ten of these to the next; each hundredth is
    its directory's license file."""
    docs = common.documents(spark, sf_dir)
    number = docs["doc_id"]
    tenth, hundred = F.floor(number / 1000).cast("string"), F.floor(number / 100).cast("string")
    name = F.when(number % 100 == 0, F.lit("LICENSE")).otherwise(F.concat(number.cast("string"), F.lit(".txt")))
    top = number % 1000 == 0
    path = F.when(top, F.concat_ws("/", docs["source"], tenth, name)).otherwise(F.concat_ws("/", docs["source"], tenth, hundred, name))
    scanned = licenses.license_scan(docs, path).withColumnRenamed("id", "doc_id")
    return scanned.withColumn("license", F.coalesce("license", F.lit("")))


@query(
    "op11_embedding_near_duplicates",
    """
    WITH RECURSIVE v AS (
      SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
          WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
    r AS (SELECT vec_id AS node, vec_id AS seen FROM embeddings UNION SELECT r.node, l.b FROM r JOIN l ON r.seen = l.a),
    c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node)
    SELECT node AS vec_id, (SELECT count(*) FROM l WHERE l.a = node) AS n_links, component_id, node = component_id AS kept FROM c
    """,
)
def op11_embedding_near_duplicates(spark, sf_dir):
    return vectordups.near_vectors(session.table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


#: The unsigned CRC-32 of a text's UTF-8 bytes, by its bitwise definition.
CRC32_MACROS = """
    tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i::UBIGINT] || range(8)::UBIGINT[],
              lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS c FROM range(256) x(i)))
"""


def crc32_sql(text: str) -> str:
    octets = f"list_transform(range(1, octet_length(encode({text})) + 1), lambda k: ('0x' || substr(hex(encode({text})), 2 * k - 1, 2))::UBIGINT)"
    step = "xor(c >> 8, t[(xor(c, b) & 255)::BIGINT + 1])"
    return f"xor(list_reduce([4294967295::UBIGINT] || {octets}, lambda c, b: {step}), 4294967295::UBIGINT)"


LOWER_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""


@query(
    "op12_importance_resampling",
    f"""
    WITH {CRC32_MACROS},
    d AS (SELECT doc_id, {LOWER_WORDS} AS ws FROM documents),
    b AS (SELECT {LOWER_WORDS} AS ws FROM benchmark),
    dw AS (SELECT doc_id, unnest(ws) AS w FROM d), bw AS (SELECT unnest(ws) AS w FROM b),
    words AS (SELECT DISTINCT w FROM (SELECT w FROM dw UNION ALL SELECT w FROM bw)),
    named AS (SELECT w, ({crc32_sql("w")} % 10000)::BIGINT AS bucket FROM words, tab),
    s AS (SELECT bucket, count(*) AS n FROM dw JOIN named USING (w) GROUP BY bucket),
    t AS (SELECT bucket, count(*) AS n FROM bw JOIN named USING (w) GROUP BY bucket),
    g AS (SELECT named.w, floor(1000 * ln(((coalesce(t.n, 0) + 1) * ((SELECT coalesce(sum(n), 0) FROM s) + 10000))::DOUBLE
                 / ((coalesce(s.n, 0) + 1) * ((SELECT coalesce(sum(n), 0) FROM t) + 10000))::DOUBLE))::BIGINT AS gain
          FROM named LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
    m AS (SELECT doc_id, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS mean FROM dw JOIN g USING (w) GROUP BY doc_id),
    h AS (SELECT doc_id, len(ws)::BIGINT AS n_features, coalesce(mean, 0) AS weight,
                 ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT AS h FROM d LEFT JOIN m USING (doc_id)),
    scored AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM h),
    places AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS place,
                      count(*) FILTER (n_features >= 20) OVER () AS able FROM scored)
    SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * able // 100 THEN place END AS rank FROM places
    """,
)
def op12_importance_resampling(spark, sf_dir):
    docs = common.documents(spark, sf_dir)
    drawn = resampling.resampled(docs, session.table(spark, sf_dir, "benchmark")).withColumnRenamed("id", "doc_id")
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def field_sql(value: str) -> str:
    text = f"CAST({value} AS VARCHAR)"
    return f"coalesce(octet_length(encode({text})) || ':' || {text}, '-')"


def leaf_sql(n_chars: str) -> str:
    return f"sha256({' || '.join(field_sql(c) for c in ('doc_id', 'source', 'lang', n_chars, 'text'))})"


@query(
    "op13_merkle_manifest",
    f"""
    WITH RECURSIVE {CRC32_MACROS},
    docs AS (SELECT doc_id, lang, {leaf_sql("n_chars")} AS leaf,
                    CASE WHEN {crc32_sql("doc_id::VARCHAR")} % 7 = 0 THEN {leaf_sql("n_chars + 1")} ELSE {leaf_sql("n_chars")} END AS shown,
                    row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS place FROM documents, tab),
    up AS (SELECT lang, 0 AS level, place AS k, leaf AS digest, count(*) OVER (PARTITION BY lang) AS width FROM docs
           UNION ALL
           SELECT lang, level + 1, k // 2, sha256(string_agg(digest, '' ORDER BY k)), (max(width) + 1) // 2
           FROM up WHERE width > 1 GROUP BY lang, level, k // 2),
    sub AS (SELECT lang, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS k, count(*) OVER () AS width FROM up WHERE width = 1),
    top AS (SELECT 0 AS level, k, subroot AS digest, width FROM sub
            UNION ALL
            SELECT level + 1, k // 2, sha256(string_agg(digest, '' ORDER BY k)), (max(width) + 1) // 2 FROM top WHERE width > 1 GROUP BY level, k // 2),
    proof AS (SELECT doc_id, lang, level, k, p, width, proof, folded FROM (
                SELECT doc_id, d.lang, 0 AS level, place AS k, place AS p, u.width, '' AS proof, shown AS folded
                FROM docs d JOIN (SELECT lang, max(width) AS width FROM up WHERE level = 0 GROUP BY lang) u ON d.lang IS NOT DISTINCT FROM u.lang)
              UNION ALL
              SELECT q.doc_id, q.lang, q.level + 1, q.k // 2, q.p, (q.width + 1) // 2, q.proof || coalesce(n.digest, ''),
                     sha256(CASE WHEN q.k % 2 = 0 THEN q.folded || coalesce(n.digest, '') ELSE n.digest || q.folded END)
              FROM proof q LEFT JOIN up n ON n.lang IS NOT DISTINCT FROM q.lang AND n.level = q.level AND n.k = xor(q.k, 1)
              WHERE q.width > 1),
    ended AS (SELECT proof.doc_id, subroot, sub.k, sub.width, proof, folded FROM proof JOIN sub ON proof.lang IS NOT DISTINCT FROM sub.lang WHERE proof.width = 1),
    last AS (SELECT doc_id, subroot, 0 AS level, k, width, proof, folded FROM ended
             UNION ALL
             SELECT q.doc_id, q.subroot, q.level + 1, q.k // 2, (q.width + 1) // 2, q.proof || coalesce(n.digest, ''),
                    sha256(CASE WHEN q.k % 2 = 0 THEN q.folded || coalesce(n.digest, '') ELSE n.digest || q.folded END)
             FROM last q LEFT JOIN top n ON n.level = q.level AND n.k = xor(q.k, 1) WHERE q.width > 1)
    SELECT docs.doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
    FROM docs JOIN last ON last.doc_id = docs.doc_id AND last.width = 1, (SELECT digest AS root FROM top WHERE width = 1)
    """,
)
def op13_merkle_manifest(spark, sf_dir):
    docs = common.documents(spark, sf_dir)
    when = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 7 == 0
    whole = manifest.manifest(docs, changed={"n_chars": docs["n_chars"] + 1}, when=when).withColumnRenamed("id", "doc_id")
    return whole.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
