"""Vector near-duplicates, importance resampling and the manifest against brute force, and on odd rows."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from tidemark.llm import manifest, resampling, vectordups

VECTORS = "vec_id long, embedding array<float>, label int, id string, unit string, node long"


def clustered(seed=3, dims=24, loose=300):
    """Random vectors, pairs at and around the threshold, tight crowds, a wide crowd, and exact copies."""
    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    parts = [unit(rng.standard_normal((loose, dims)))]
    for cos in (0.88, 0.899, 0.901, 0.93, 0.97):
        away = rng.standard_normal((40, dims))
        base = parts[0][:40]
        away = unit(away - (away * base).sum(1, keepdims=True) * base)
        parts.append(cos * base + math.sqrt(1 - cos * cos) * away)
    for spread, size in ((0.02, 150), (0.05, 90), (0.09, 200)):
        parts.append(unit(unit(rng.standard_normal(dims)) + spread * rng.standard_normal((size, dims))))
    parts.append(np.repeat(parts[-1][:3], 40, axis=0) * 2.0)
    every = np.concatenate(parts).astype(np.float32)
    return every[rng.permutation(len(every))]


def brute_links(rows, cosine=0.9):
    """{vec_id: (n_links, component)} for distinct ids by all pairs in double precision."""
    good = {i: np.array(v, np.float64) for i, v in rows if v is not None and i is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {i: (0, i) for i, _ in rows}
    for dims in {len(v) for v in good.values()}:
        ids = sorted(i for i in good if len(good[i]) == dims)
        x = np.stack([good[i] / np.linalg.norm(good[i]) for i in ids])
        linked = x @ x.T >= cosine
        np.fill_diagonal(linked, False)
        least = np.array(ids)
        while True:
            after = np.array([min(least[k], *least[linked[k]]) if linked[k].any() else least[k] for k in range(len(ids))])
            if (after == least).all():
                break
            least = after
        out |= {i: (int(linked[k].sum()), int(least[k])) for k, i in enumerate(ids)}
    return out


def test_vector_links_equal_all_pairs(spark):
    vectors = clustered()
    rows = [(3 * i + 7, v.tolist()) for i, v in enumerate(vectors)]
    df = spark.createDataFrame([(*r, 1, "x", "x", 5) for r in rows], VECTORS).repartition(5)
    got = {r["id"]: (r["n_links"], r["component_id"]) for r in vectordups.near_vectors(df).collect()}
    expected = brute_links(rows)
    assert got == expected
    assert max(n for n, _ in expected.values()) > 150


@pytest.mark.parametrize("drift", [0.0, 0.6])
def test_tables_find_pairs_at_the_threshold(drift):
    """Share of pairs at cosine 0.9 that meet in a table and pass the code bound, as the number of vectors grows; also
    where all vectors lean towards one direction."""
    rng = np.random.default_rng(11)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    x = unit(unit(rng.standard_normal((1500, 64))) + drift * unit(rng.standard_normal((1, 64))))
    away = rng.standard_normal(x.shape)
    away = unit(away - (away * x).sum(1, keepdims=True) * x)
    y = 0.9 * x + math.sqrt(1 - 0.81) * away
    rate, centre = vectordups.bit_rate(x, 0.9)
    assert centre and rate < 0.3
    for n in (1000, 50_000, 10**6, 10**9):
        width, tables, probes, bits = vectordups.effort(n, rate)
        q = vectordups.Quantiser(x, bits, centre, rounds=15)
        a, b = q.values(x), q.values(y)
        flip = vectordups.flips(width, probes)
        met = np.zeros(len(x), bool)
        for one, other in ((a, b), (b, a)):
            for t in range(tables):
                s = slice(t * width, (t + 1) * width)
                order = np.argsort(np.abs(one[:, s]), axis=1)
                differ = np.take_along_axis((one[:, s] > 0) != (other[:, s] > 0), order, axis=1)
                for row in flip[:2048]:
                    met |= (differ == row).all(axis=1)
        found = met & (((a > 0) != (b > 0)).sum(axis=1) <= vectordups.most_different(bits, rate))
        print(f"{n} vectors, {tables} slices of {width} bits, {probes} cells, {bits} bits: recall {found.mean():.4f} at the threshold")
        assert found.mean() >= 0.99


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]),
        (8, [None, 1.0]), (9, [1.0, 0.01]), (10, [1.0, 0.0, 0.0]), (11, [5.0, 0.0, 0.1]), (12, [-1.0, 0.0]), (None, [1.0, 0.0]), (13, [1e-30, 0.0]),
    ]
    df = spark.createDataFrame([(*r, None, None, None, None) for r in rows], VECTORS)
    got = sorted(map(tuple, vectordups.near_vectors(df).collect()), key=str)
    flat = {1: (3, 1), 2: (3, 1), 9: (3, 1), 13: (3, 1), 10: (1, 10), 11: (1, 10)}
    want = [(i, *flat.get(i, (0, i)), i is None or flat.get(i, (0, i))[1] == i) for i, _ in rows]
    assert got == sorted(want, key=str)
    assert vectordups.near_vectors(df.limit(0)).count() == 0
    assert vectordups.near_vectors(df.filter("vec_id in (3, 5)")).count() == 2


def brute_resampled(docs, target, words, buckets, least, percent, seed):
    def features(text):
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        runs = [" ".join(found[k : k + n]) for n in range(1, words + 1) for k in range(len(found) - n + 1)]
        return len(found), [zlib.crc32(r.encode()) % buckets for r in runs]

    s, t = np.zeros(buckets, int), np.zeros(buckets, int)
    for _, text in docs:
        np.add.at(s, features(text)[1], 1)
    for text in target:
        np.add.at(t, features(text)[1], 1)
    gain = [math.floor(1000 * math.log(((t[b] + 1) * (s.sum() + buckets)) / ((s[b] + 1) * (t.sum() + buckets)))) for b in range(buckets)]
    out = []
    for i, text in docs:
        n, own = features(text)
        weight = sum(gain[b] for b in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    place = {id(r): k + 1 for k, r in enumerate(able[: percent * len(able) // 100])}
    return [(*r, place.get(id(r))) for r in out]


@pytest.mark.parametrize(("words", "percent", "part"), [(1, 10, 1 << 17), (3, 40, 50)])
def test_resampling_equals_brute_force(spark, odd, odd_rows, words, percent, part, monkeypatch):
    monkeypatch.setattr(resampling, "OCCURRENCES", part)
    rows = [(r[0], r[1]) for r in odd_rows] + [(100 + i, f"Dup {i % 3} of the SAME words é1 {'x ' * 30}") for i in range(40)]
    docs = spark.createDataFrame([(*r, None, None, None, "c", "c", 1) for r in rows], odd.schema).repartition(4)
    target = spark.createDataFrame([("the same words of er",), (None,), ("",), ("Dup one",)], "text string")
    got = resampling.resampled(docs, target, words=words, buckets=97, percent=percent, least_words=3)
    got = [tuple(r) for r in got.select("id", "n_words", "n_features", "weight", "score", "rank").collect()]
    want = brute_resampled(rows, ["the same words of er", None, "", "Dup one"], words, 97, 3, percent, resampling.SEED)
    # Rows that repeat an id and a text share a score, so their places may be swapped.
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_interning_verifies_bytes():
    """Equal keys with different bytes take slots of their own."""
    import xxhash

    real = xxhash.xxh64_intdigest
    try:
        xxhash.xxh64_intdigest = lambda b: 7
        texts = ["alpha beta alpha alphabetical alphabetisch alpha " * 3, "beta gamma", None]
        words, features, tables = resampling.interned(texts, 1, 1 << 20)
        [(of, table)] = list(tables)
    finally:
        xxhash.xxh64_intdigest = real
    assert words.tolist() == features.tolist() == [18, 2, 0] and len(table.used) == 5
    found = " ".join(t or "" for t in texts).split()
    assert [int(table.bucket[s]) for s in table.slot] == [zlib.crc32(w.encode()) % (1 << 20) for w in found]
    assert [int(table.count[s]) for s in table.slot] == [found.count(w) for w in found]


def test_resampling_of_empty_tables(spark, odd, empty):
    assert resampling.resampled(empty, odd).count() == 0
    assert {r["weight"] for r in resampling.resampled(odd, empty).filter("n_words = 0").collect()} == {0}


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows, arity, changes):
    """Root, subroots and proofs by plain recursion over (id, source, lang, n_chars, text) rows."""

    def leaf(r):
        return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in r])

    def tree(digests):
        level, proofs, at = list(digests), [""] * len(digests), list(range(len(digests)))
        folds = [[] for _ in digests]
        while len(level) > 1:
            for k, p in enumerate(at):
                first = p // arity * arity
                run = level[first : first + arity]
                proofs[k] += "".join(run[: p - first] + run[p - first + 1 :])
                folds[k].append((run[: p - first], run[p - first + 1 :]))
                at[k] = p // arity
            level = [h(*level[k : k + arity]) for k in range(0, len(level), arity)]
        return level[0], proofs, folds

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for lang in langs:
        groups[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[lang] = tree([leaf(r) for r in groups[lang]])
    root, upper, upper_folds = tree([trees[g][0] for g in langs]) if langs else ("", [], [])
    out = []
    for g, lang in enumerate(langs):
        subroot, proofs, folds = trees[lang]
        for r, proof, fold in zip(groups[lang], proofs, folds):
            now = leaf(changes(r))
            for before, after in fold + upper_folds[g]:
                now = h(*before, now, *after)
            out.append((r[0], leaf(r), subroot, root, h(proof + upper[g]), now, now == root))
    return out


@pytest.mark.parametrize(("arity", "levels"), [(2, 10), (2, 1), (3, 2)])
def test_manifest_equals_recursion(spark, odd, odd_rows, arity, levels):
    from pyspark.sql import functions as F

    rows = [(r[0], r[3], r[2], r[4], r[1]) for r in odd_rows] + [(200 + i, "s", "zz", None if i % 5 == 0 else i, "t") for i in range(37)]
    docs = spark.createDataFrame([(r[0], r[4], r[2], r[1], r[3], "c", "c", 1) for r in rows], odd.schema).repartition(4)
    got = manifest.manifest(docs, changed={"n_chars": docs["n_chars"] + 1}, when=F.col("doc_id") % 3 == 0, arity=arity, levels=levels)
    got = got.select("id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    change = lambda r: (*r[:3], r[3] + 1, r[4]) if r[0] is not None and r[0] % 3 == 0 and r[3] is not None else r
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_manifest(rows, arity, change)))
    assert {r["verified"] for r in got} == {True, False}


def test_manifest_of_few_rows(spark, odd, empty):
    assert manifest.manifest(empty).count() == 0
    one = manifest.manifest(odd.filter("doc_id = 1")).first()
    assert one["leaf"] == one["subroot"] == one["root"] == one["folded_root"] and one["proof"] == "" and one["verified"]
    assert one["proof_sha256"] == hashlib.sha256(b"").hexdigest()


def test_a_worker_keeps_one_operators_store():
    from tidemark.llm import common

    one = common.remembered("a")
    one["x"] = 1
    assert common.remembered("a") is one and common.remembered("a")["x"] == 1
    assert common.remembered("b") == {} and one == {} and list(common.REMEMBERED) == ["b"]
    common.remembered("")
