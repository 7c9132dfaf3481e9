"""Each operator on odd rows, on empty tables and against a brute-force twin."""

import hashlib
import itertools
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark import session
from tidemark.llm import common, exact, language, licenses, mixing, neardup, pieces, pii, quality, suffix, tokens

BYTE_BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def rows_of(df, key="id"):
    out = defaultdict(list)
    for r in df.collect():
        out[r[key]].append(r)
    return out


# exact dedup


@pytest.mark.parametrize("block", [4096, 16])
def test_exact_groups(odd, odd_rows, empty, block):
    got = rows_of(exact.exact_groups(odd, block=block))
    groups = defaultdict(list)
    for i, t, *_ in odd_rows:
        groups[t or ""].append(i)
    for i, t, *_ in odd_rows:
        members = groups[t or ""]
        for r in got[i]:
            assert r.group_size == len(members) and r.keep_id == max(m for m in members if m is not None)
            assert r.text_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert sum(r.kept for rs in got.values() for r in rs) == len(groups)
    assert exact.exact_groups(empty).count() == 0


def test_exact_dedup_keeps_columns(odd, empty):
    got = exact.exact_dedup(odd)
    assert got.columns == odd.columns and got.count() == len({r.text or "" for r in odd.collect()})
    assert exact.exact_dedup(empty).count() == 0


def test_heavy_blocks_get_the_same_names(spark):
    many = spark.range(600).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot" * 50).otherwise(F.concat(F.lit("t"), F.col("id") % 100)).alias("text"))
    got = exact.exact_groups(many, block=32).groupBy("keep_id").agg(F.max("group_size").alias("n"), F.count("*").alias("m")).collect()
    assert all(r.n == r.m for r in got) and max(r.n for r in got) == 200


# mixing


def test_apportionment_is_by_highest_quotients(spark):
    votes = {"a": 503.0, "b": 251.0, "c": 97.0, "d": 0.0, "e": 1.0}
    for seats in (0, 1, 7, 40, 1001):
        df = spark.createDataFrame([(0, k, v, seats) for k, v in votes.items()], "g int, k string, v double, s long")
        got = {r.k: r.quota for r in mixing.apportion(df, "g", "v", "s", "k").collect()}
        quotients = sorted(((-v / (2 * n + 1), k) for k, v in votes.items() if v for n in range(seats)))[:seats]
        assert got == {k: sum(1 for _, q in quotients if q == k) for k in votes}


def test_mixture(odd, odd_rows, empty):
    got = mixing.mixture(odd, block=5).collect()
    assert len(got) == len(odd_rows)
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    words = Counter()
    for _, t, _, s, *_ in odd_rows:
        words[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert size == words and math.isclose(sum(target.values()), 1.5 * sum(size.values()))
    order = sorted((s for s in size if s is not None)) + [None]
    want, free = {}, set(order)
    while True:  # share by weight, stop at twice the size, share the excess again
        left = 1.5 * sum(size.values()) - sum(want.values())
        weight = {s: (5, 2, 1)[order.index(s) % 3] for s in free}
        shares = {s: left * w / sum(weight.values()) for s, w in weight.items()}
        full = [s for s in free if shares[s] > 2 * size[s]]
        if not full:
            want |= shares
            break
        want |= {s: 2.0 * size[s] for s in full}
        free -= set(full)
    for s in order:
        assert math.isclose(target[s], want[s]) and abs(taken[s] - target[s]) <= 15
    again = mixing.mixture(odd, block=5)
    assert sorted((r.id or 0, r.taken) for r in again.collect()) == sorted((r.id or 0, r.taken) for r in got)
    assert mixing.mixture(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
    assert mixing.mixed_documents(odd).columns == odd.columns


def test_short_rows_are_spread_over_shards(spark):
    counts = spark.createDataFrame([(0, 350_000), (10, 100_001), (5_000_000, 10), (0, 1)], "words long, n long")
    assert [r.s for r in counts.select(mixing.shard_count(F.col("words"), F.col("n")).alias("s")).collect()] == [4, 2, 3, 1]
    text = F.when(F.col("id") % 10 == 0, "one two three four five").when(F.col("id") % 2 == 0, "")
    docs = spark.range(400).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("a").alias("source"))
    got = mixing.mixture(docs, block=5, shard_rows=50).collect()
    assert len(got) == 400 and sum(r.taken for r in got) == 300
    assert all(0 <= r.taken <= 2 * r.size for r in got)


# near duplicates


def brute_near(rows, words, percent):
    sets = {}
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w)} if 0 < len(w) < words else {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        return i if root[i] == i else find(root[i])

    for a, b in itertools.combinations([i for i in sets if i is not None], 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates(odd, odd_rows, empty, words):
    want = brute_near(odd_rows, words, 80)
    got = neardup.near_duplicates(odd, words=words).collect()
    assert len(got) == len(odd_rows)
    for r in got:
        assert (r.n_shingles, r.component_id) == want[r.id] and r.kept == (r.id == r.component_id)
    assert neardup.near_duplicates(empty).count() == 0 and neardup.near_dedup(odd).columns == odd.columns


def test_near_duplicates_of_a_crowd(spark, monkeypatch):
    """A large group of edited copies, cut into small tiles, against all pairs."""
    import random

    monkeypatch.setattr(neardup, "TILE", 20)
    monkeypatch.setattr(neardup, "CROWD", 3)
    rng = random.Random(3)
    base = [f"w{rng.randrange(400)}" for _ in range(150)]
    rows = []
    for i in range(150):
        text = list(base)
        for _ in range(rng.randrange(0, 24)):
            text[rng.randrange(150)] = f"z{rng.randrange(10**6)}"
        rows.append((i, " ".join(text)))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=2).collect()
    want = brute_near(rows, 2, 80)
    assert {r.id: (r.n_shingles, r.component_id) for r in got} == want
    assert len({c for _, c in want.values()}) > 3


def test_packed_minima_estimate_similarity(spark):
    a, b = np.arange(0, 1000, dtype=np.uint64), np.arange(200, 1200, dtype=np.uint64)
    low = neardup.packed(neardup.minima([neardup.mixed(a), neardup.mixed(b)])).view(np.int64)
    df = spark.createDataFrame([(low[0].tolist(), low[1].tolist())], "x array<long>, y array<long>")
    estimate = df.select(neardup.similarity(neardup.equal_minima("x", "y"), neardup.MINIMA)).first()[0]
    assert abs(estimate - 800 / 1200) < 0.1
    assert (1 - 0.8**neardup.ROWS) ** neardup.BANDS < 1e-5


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 150), (150, 170)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(chain, "a long, b long"), spark).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 150: 150, 170: 150, 200: 150}


# repeated passages


def brute_repeats(rows, length):
    seen, out = set(), {}
    for i, t in sorted({(i, t or "") for i, t, *_ in rows if i is not None}):
        t = t.encode()
        own = [t[p : p + length] for p in range(len(t) - length + 1)]
        gone = bytearray(len(t))
        for p, w in enumerate(own):
            if w in seen:
                gone[p : p + length] = b"\1" * length
        seen.update(own)
        runs = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(t), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("piece", [2 << 20, 700])
def test_repeated_passages(odd, odd_rows, empty, piece, monkeypatch):
    monkeypatch.setattr(suffix, "PIECE", piece)
    want = brute_repeats(odd_rows, 50)
    got = suffix.without_repeats(odd).collect()
    assert len(got) == len(odd_rows) and sum(w[1] for w in want.values()) > 500
    for r in got:
        if r.id is None:
            assert r.n_removed == 0
        else:
            assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.id]
    assert suffix.without_repeats(empty).count() == 0


@pytest.mark.parametrize("crowd", [20_000, 0])
def test_edges_of_passages_are_compared_without_sending_windows(spark, crowd, monkeypatch):
    """Passages that differ on both sides: a row for each open anchor, and window by window only for crowded names."""
    rng = random.Random(4)
    noise = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    line = noise(140)
    # Cuts of a line in noise, at any length around the wanted one; some shared by few, some by many documents.
    rows = [(i, noise(rng.randrange(40)) + line[(a := rng.randrange(60)) : a + rng.randrange(30, 110)] + noise(rng.randrange(40))) for i in range(120)]
    rows += [(200 + i, line[a : a + 55] + noise(9)) for i, a in enumerate(range(0, 80, 7))]
    monkeypatch.setattr(suffix, "CROWD", crowd)
    sent, single = [], suffix.single_windows
    monkeypatch.setattr(suffix, "single_windows", lambda *args: sent.append(1) or single(*args))
    got = suffix.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    want = brute_repeats(rows, 50)
    assert {r.id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()} == want
    assert bool(sent) == (crowd == 0) and sum(w[1] > 0 for w in want.values()) > 60


def test_an_id_with_two_texts_does_not_crash(spark):
    df = spark.createDataFrame([(1, "x" * 80), (1, "y" * 60), (2, "x" * 80), (3, None)], "doc_id long, text string")
    assert suffix.without_repeats(df).count() == 4


# PII


def test_pii_base_kinds_match_the_patterns(odd, odd_rows, empty):
    def luhn(d):
        return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0

    digits = lambda s: re.sub("[^0-9]", "", s)
    patterns = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    }
    texts = [t or "" for _, t, *_ in odd_rows] + [
        "a@b.c@d.e x@y z@@k.l .@a.b é1@x-y.zz. 1.2.3.4.5 256.1.1.1 01.002.3.255 1..2", "4111 1111 1111 1111 4111-1111 11111112 123456789012345678901",
        "+1 (366) 555-9807 and ++44(0)20.7946.0958) +1-2 +99999999999999999", "@", "12" * 2000, "x@" * 50 + "a.b", "GB82 WEST 1234 5698 7654 32, ssn 078-05-1120",
    ]
    for text in texts:
        want = sorted(
            (m.start(), list(patterns).index(k), k, m.end())
            for k, (p, good) in patterns.items()
            for m in re.finditer(p, text)
            if good(m[0])
        )
        base = [s for s in pii.find(text) if s["kind"] in pii.BASE_KINDS]
        assert [(s["start"], s["kind"], s["end"]) for s in base] == [(a, k, b) for a, _, k, b in want], text
    assert {s["kind"] for s in pii.find(texts[-1])} >= {"iban", "ssn"}
    got = rows_of(pii.pii_spans(odd))
    assert [s.kind for s in got[12][0].spans] == ["email", "phone", "ip"] and got[4][0].spans == []
    assert "anna" not in rows_of(pii.redacted(odd))[12][0].text
    assert pii.pii_spans(empty).count() == 0


@pytest.mark.parametrize(
    "before,span,after,kind",
    [
        ("IBAN ", "BE68 5390 0754 7034", " BIC: X", "iban"), ("", "ES91 2100 0418 4502 0005 1332", " BIC X", "iban"), ("", "BE68539007547034", " EUR 50", "iban"),
        ("to ", "AT61 1904 3002 3457 3201", " 2024", "iban"), ("", "NO93 8601 1117 947", " KID", "iban"), ("", "GB82WEST12345698765432", " GBP 5", "iban"), ("", "DE89 3704 0044 0532 0130 00", "", "iban"),
        ("BE68 5390 0754 7035 ", "BE68 5390 0754 7034", ".", "iban"), ("", "078-05-1120", " is my social security number", "ssn"), ("SSN: ", "078-05-1120", "", "ssn"),
    ],
)
def test_accounts_end_at_their_length_and_context_is_on_both_sides(before, span, after, kind):
    text = before + span + after
    found = [s for s in pii.find(text) if s["kind"] == kind]
    assert [text[s["start"] : s["end"]] for s in found] == [span]
    assert span not in pii.masked(text, pii.find(text))


def test_numbers_without_check_or_context_are_no_accounts():
    assert not [s for s in pii.find("BE68 5390 0754 7035 BIC, part 078-05-1120 of the list") if s["kind"] in ("iban", "ssn")]


# quality


def test_quality_measures_and_verdict(odd, odd_rows, empty):
    for _, t, *_ in odd_rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        often = Counter(windows)
        hit = {k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        got = dict(zip(quality.MEASURES, quality.measure(t)))
        assert got["n_words"] == len(words) and got["word_chars"] == sum(map(len, words))
        assert got["n_symbols"] == len(re.findall(r"[#*$%&|<>]", t)) and got["n_repeat_words"] == len(hit)
        assert got["n_dup_lines"] == len(lines) - len(set(lines))
    got = quality.judged(odd).collect()
    assert len(got) == len(odd_rows)
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.kept and r.base_failed) for r in got)
    assert quality.judged(empty).count() == 0


def fences(rows):
    """Fences by quantiles of all values instead of sketches: {(lang, source): {rule: (low, high)}}, each sketch by itself."""
    out = {}
    for level in (("lang", "source"), ("lang",), ()):
        groups = {}
        for r in rows:
            if r.n_words:
                groups.setdefault(tuple(getattr(r, c) for c in level), []).append(r)
        for key, members in groups.items():
            out[key] = {"n": len(members)}
            for rule in quality.RULES:
                v = sorted(measures_of(r)[rule][0] for r in members)
                low, mid, high = (v[-int(-q * len(v) // 1) - 1] for q in (0.25, 0.5, 0.75))
                low, mid, high = (np.log(x) if rule == "word_length" else np.log(x / (1 - x)) for x in (low, mid, high))
                out[key][rule] = (low - 6 * (mid - low), high + 6 * (high - mid))
    return out


def measures_of(r):
    """rule -> (smoothed value, proven value or None, proven for the lower fence)"""
    share = lambda n, of, unit=1: ((n + unit / 2) / (of + unit), (n - 2 * (unit * n) ** 0.5) / of, None)
    length = r.word_chars / r.n_words
    return {
        "symbol_share": share(r.n_symbols, r.word_chars), "dup_line_share": share(r.n_dup_lines, r.n_lines),
        "repeat_share": share(r.n_repeat_words, r.n_words, 10), "upper_share": share(r.n_upper, r.word_chars),
        "word_length": (length, length * (1 - 2 * r.n_words**-0.5), length * (1 + 2 * r.n_words**-0.5)),
    }


def test_fences_and_verdicts_by_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = quality.judged(docs).collect()
    limits = fences(rows)
    near, by_rule = 0, Counter()
    for r in rows:
        if not r.n_words:
            assert not r.kept
            continue
        failed, close = [], False
        for rule, (_, proven, low_proven) in measures_of(r).items():
            lows, highs = [], []
            for k, key in enumerate(((), (r.lang,), (r.lang, r.source))):
                lo, hi = limits[key][rule]
                n = limits[key]["n"]
                lows.append(lo if not k else (n * lo + quality.PRIOR * lows[-1]) / (n + quality.PRIOR))
                highs.append(hi if not k else (n * hi + quality.PRIOR * highs[-1]) / (n + quality.PRIOR))
            if rule == "word_length":
                lows, highs = lows[1:], highs[1:]
                low = np.log(low_proven) - max(lows)
                close |= abs(low) < 0.04
            else:
                low = 1
            high = -1
            if proven > 0:
                high = (np.log(proven) if rule == "word_length" else np.log(proven / max(1 - proven, 1e-9))) - min(highs)
                # A quarter percent of a quartile counts 13 times at most; log odds of larger shares are steeper.
                close |= abs(high) < (0.04 if rule == "word_length" else 0.1)
            failed += [rule] if low < 0 or high > 0 else []
        near += close
        if not close:
            assert list(r.failed_rules) == failed and r.kept == (not r.base_failed and not failed), r
        by_rule.update(failed if not r.base_failed else [])
    rejected = sum(not r.kept and not r.base_failed for r in rows)
    print(f"{len(rows)} rows, {rejected} rejected by sketches, by rule {dict(by_rule)}, {near} within the sketches' error")
    assert rejected and near <= 0.1 * len(rows)


def test_sketches_merge_and_bound_their_error(spark):
    df = spark.range(1, 5001).select((F.col("id") / 7).alias("v"))
    df = df.select("v", quality.bucket_value(quality.sketch_bucket(F.col("v"))).alias("b"))
    assert df.filter(F.abs(F.col("b") / F.col("v") - 1) > 0.0101).count() == 0


def test_junk_leaves_and_prose_stays(spark):
    words = ["the", "of", "house", "river", "stone", "walk", "green", "seven", "paper", "window", "light", "cat"]
    import random

    rng = random.Random(1)
    clean = [(i, " ".join(rng.choice(words) + str(rng.randrange(99)) for _ in range(60)), "en", "s") for i in range(300)]
    junk = [(i, " ".join(f"{rng.choice(words)}{rng.randrange(999)}###" for _ in range(60)), "en", "s") for i in range(300, 330)]
    got = quality.judged(spark.createDataFrame(clean + junk, "doc_id long, text string, lang string, source string")).collect()
    assert all(r.kept == (r.id < 300) for r in got)


def test_a_bad_source_does_not_set_its_own_limits(spark):
    import random

    rng = random.Random(2)
    words = ["the", "of", "house", "river", "stone", "walk", "green", "seven", "paper", "window", "light", "cat"]
    good = lambda: " ".join(rng.choice(words) + str(rng.randrange(99)) for _ in range(60))
    marks = lambda: " ".join(f"{rng.choice(words)}{rng.randrange(999)}###" for _ in range(60))
    lines = lambda: "\n".join([good()] + [rng.choice(words)] * 30)
    capitals = lambda: good().upper()
    for junk in (marks, lines, capitals):
        bad = [(i, junk() if i % 5 < 2 else good(), "en", "bad") for i in range(300)]
        rest = [(i, good(), "en" if i % 2 else "fr", "rest") for i in range(300, 900)]
        # Long words of another language are no junk, though most rows have short ones.
        long = [(i, good().replace(" ", "longwordsinonepiece "), "xx", "rest") for i in range(900, 1050)]
        got = quality.judged(spark.createDataFrame(bad + rest + long, "doc_id long, text string, lang string, source string")).collect()
        assert all(r.kept == (r.id >= 300 or r.id % 5 >= 2) for r in got)


# language


def held_grams(rows):
    """n-grams of each language by the rule of the filter, from (text, lang) rows, with plain sets and counters."""
    docs, many = {}, Counter(lang for _, lang in rows)
    for text, lang in rows:
        docs.setdefault(lang, Counter()).update(set(language.grams(text).tolist()))
    held = {}
    for lang, counts in docs.items():
        top = lambda g: max(docs[x][g] / many[x] for x in docs)
        held[lang] = {g for g, n in counts.items() if n / many[lang] >= language.LIKE_MOST * top(g)}
    return held


def test_language_counts_by_brute_force(spark):
    rows = [
        (1, "the weather is fine and the wind is low", "en"), (2, "they walk along the river with the dog", "en"),
        (3, "das Wetter ist schön und der Wind ist schwach", "de"), (4, None, "de"), (5, "no label", None), (None, "no id here", "de"),
        (6, "le temps est beau et le vent est faible", "fr"), (6, "le temps est beau et le vent est faible", "fr"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df)
    held = held_grams([(t, g) for _, t, g in [*rows[:3], rows[6]]])
    assert model.languages == sorted(held) and model.usual == "en" and max(model.false_rate) < 1e-6
    texts = ["Das Wetter ist fein", "the river and the wind", "vent du temps", "qqqq wwww", "x " * 700_000 + "the wind is fine"]
    for text in texts:
        total, hits = language.counted(text, model)
        own = np.concatenate([language.grams(p) for p in language.pieces(text)]).tolist()
        assert total == len(own) and hits.tolist() == [sum(g in held[x] for g in own) for x in model.languages]
    # One labelled document is enough for a language; without any n-gram there is no evidence, and the score says so.
    assert language.decide("Der Wind ist schwach", model)[0] == "de" and language.decide("Der Wind ist schwach", model)[1] > 0.6
    assert language.decide("qqqq wwww", model) == ("en", 0.0, 0.0)
    # A filter that is far too small answers by chance for most n-grams; the correction finds the true counts again.
    small = language.fit(df, slots=256)
    assert max(small.false_rate) > 0.01
    text = " ".join(str(t) for _, t, g in rows if g == "en") * 20
    total, hits = language.counted(text, small)
    exact = language.counted(text, model)[1]
    right = (hits - total * small.false_rate) / (1 - small.false_rate)
    assert (np.abs(right - exact) <= 0.1 * total).all() and language.decide(text, small)[0] == "en"


def test_language_sample_is_the_first_ids_of_each_language(spark):
    rows = [(i, f"text {i}", "en" if i % 3 else "de") for i in range(900)] + [(7, "other", "en")] * 50
    df = spark.createDataFrame(rows, "id long, text string, lang string")
    got = language.sampled(df, 40).collect()
    turn = {r.id: r.t for r in spark.range(900).select("id", F.xxhash64(F.lit("lang-sample"), "id").alias("t")).collect()}
    for lang in ("en", "de"):
        ids = sorted({i for i, _, g in rows if g == lang}, key=lambda i: (turn[i] % 2**64, i))[:40]
        assert {r.text for r in got if r.lang == lang} - {"other"} == {f"text {i}" for i in ids} - ({"text 7"} if any(r.text == "other" for r in got) else set())
        assert sum(r.lang == lang for r in got) == 40


def test_language_filter(spark, odd, empty):
    sounds = {"en": ["the", "ing", "tion", "and"], "fr": ["eau", "eux", "ment", "que"], "xx": ["zk", "wrz", "ów", "ść"]}
    import random

    rng = random.Random(2)
    rows = [(i, " ".join("".join(rng.choices(sounds[g], k=2)) for _ in range(60)), g) for i, g in enumerate(rng.choices(list(sounds), k=240))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df.filter("doc_id % 4 <> 2"))
    assert model.languages == ["en", "fr", "xx"] and max(model.false_rate) < 0.01
    got = language.identified(df, model).collect()
    assert sum(r.lang_pred == rows[r.id][2] for r in got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    again = language.fit(df.filter("doc_id % 4 <> 2").repartition(7))
    assert (again.slots == model.slots).all()
    odd_got = rows_of(language.identified(odd, model))
    assert odd_got[4][0].lang_pred == odd_got[5][0].lang_pred == odd_got[6][0].lang_pred == "und" and odd_got[4][0].score == 0
    assert language.identified(empty, model).count() == 0
    nobody = language.fit(empty)
    assert nobody.languages == [] and language.identified(odd, nobody).filter("lang_pred <> 'und'").count() == 0


# tokens


def test_token_files(spark, odd, odd_rows, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTE_BPE)
    t.encode_special_tokens = True
    folder = session.scratch_dir(spark, "tokens")
    tokens.write_tokens(odd, folder, BYTE_BPE)
    files = tokens.digests(spark, folder).join(tokens.token_starts(spark, folder), "at").orderBy("at").collect()
    assert [r.id for r in files] == [None, *sorted(i for i, *_ in odd_rows if i is not None)]
    texts = {i: x or "" for i, x, *_ in odd_rows}
    start = 0
    for r in files:
        ids = t.encode(texts[r.id], add_special_tokens=False).ids + [tokens.END]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), r.id
        start += len(ids)
    assert tokens.read_tokens(spark, folder, "id", "n_tokens").columns == ["id", "n_tokens"]
    nothing = session.scratch_dir(spark, "tokens")
    tokens.write_tokens(empty, nothing, BYTE_BPE)
    assert tokens.digests(spark, nothing).count() == 0 and tokens.token_starts(spark, nothing).count() == 0


def test_units_give_what_whole_texts_give():
    coder = tokens.UnitEncoder(BYTE_BPE)
    texts = ["", " ", "a  b", " x", "x ", "a\n b", "a\tb c d  \n", "don't ,x . y..,", "1,2.3, x!., _. a_.", " x 　y", "Ⅷ. ²,", "é. a", "..."]
    ids, counts = coder.encode(texts)
    want = [e.ids for e in coder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def library_ids(coder, texts):
    return [coder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_word_is_encoded_once_whatever_mark_or_line_follows():
    class Counting:
        def __init__(self, tokenizer):
            self.tokenizer, self.given = tokenizer, []

        def encode_batch_fast(self, units, **options):
            self.given += units
            return self.tokenizer.encode_batch_fast(units, **options)

        def __getattr__(self, name):
            return getattr(self.tokenizer, name)

    coder = tokens.UnitEncoder(BYTE_BPE)
    counting = coder.tokenizer = Counting(coder.tokenizer)
    words = [a + b for a in ("on", "ver", "sch", "the") for b in ("eit", "ing", "ois", "er")]
    marks = [".", ",", "$$$", "!", "?)", "***", "-", "\n"]
    texts = ["x " + " ".join(w + m for w in words) + "x" for m in marks[:-1]] + ["\n".join(words)]
    for part in (texts, texts[::-1]):
        ids, counts = coder.encode(part)
        assert ids.tolist() == sum(library_ids(coder, part), []) and counts.tolist() == list(map(len, library_ids(coder, part)))
    assert len(counting.given) == len(set(counting.given)) < 4 * len(words)


@pytest.mark.parametrize("weak", [False, True])
def test_units_of_odd_texts_also_where_keys_are_equal(weak, monkeypatch):
    import random

    if weak:
        monkeypatch.setattr(tokens, "mixed", lambda h: h & np.uint64(7))
    monkeypatch.setattr(tokens, "REMEMBERED", 300)
    rng, coder = random.Random(3), tokens.UnitEncoder(BYTE_BPE)
    parts = [*"ab1.,'\"\n\t\r$_é \u3000²Ⅷ日\x00\x1c\x85א٣ª😀\u0301\u200b\ufeff", " ", " ", "  ", "'ll", "the", " the", "<|endoftext|>"]
    for _ in range(20):
        texts = ["".join(rng.choices(parts, k=rng.randrange(12))) for _ in range(100)]
        ids, counts = coder.encode(texts)
        want = library_ids(coder, texts)
        assert counts.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])
    ids, counts = coder.encode([])
    assert not len(ids) and not len(counts)


def test_added_tokens_are_what_the_untouched_library_gives(spark, odd, odd_rows, tmp_path):
    from tokenizers import Tokenizer

    from tidemark.llm import plans

    t = Tokenizer.from_file(BYTE_BPE)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x.<|endoftext|>  y", "<|endoftext|><|endoftext|>\n", "<|endof text|>", "a b"]
    ids, counts = tokens.UnitEncoder(BYTE_BPE).encode(texts)
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert counts.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]
    odd.repartition(1).write.parquet(str(tmp_path / "documents.parquet"))
    start, by_id = 0, {i: x or "" for i, x, *_ in odd_rows}
    for r in plans.op6_token_files(spark, str(tmp_path)).orderBy("start").collect():
        ids = t.encode(by_id[r.doc_id], add_special_tokens=False).ids + [tokens.END]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), r.doc_id
        start += len(ids)


# pieces


def every_path(store, unit):
    def go(node, p, ids):
        for e in range(store.first[node], store.first[node + 1]):
            more = (p * store.share[e], ids + tuple(store.ids_of(np.array([e])).tolist()))
            yield from [more[::-1]] if store.to[e] < 0 else go(store.to[e], *more)

    store.learn([unit])
    yield from go(store.start[unit], 1.0, ())


def test_samples_follow_the_lattice_without_replacement():
    store = pieces.store_of(PIECES, 0.3)
    text = "the ab\n"
    paths = {}
    for combination in itertools.product(*[list(every_path(store, u)) for u in pieces.units_of(text)]):
        paths[sum((ids for ids, _ in combination), ())] = math.prod(p for _, p in combination)
    assert math.isclose(sum(paths.values()), 1)
    n, first, second, weighted = 6000, Counter(), Counter(), 0.0
    for k in range(0, n, 1000):
        for found in pieces.sample([text] * 1000, list(range(k, k + 1000)), store, 3):
            ids = [tuple(f[0].tolist()) for f in found]
            assert len(set(ids)) == 3 and found[0][2] > found[1][2] > found[2][2]
            assert all(math.isclose(math.log(paths[i]), f[1], abs_tol=1e-6) for i, f in zip(ids, found))
            first[ids[0]] += 1
            second[ids[1]] += 1
            weighted += sum(paths[i] / f[3] for i, f in zip(ids, found)) / n
    for path, p in paths.items():
        after = sum(q * p / (1 - q) for other, q in paths.items() if other != path)
        for seen, expected in ((first[path], p), (second[path], after)):
            assert abs(seen / n - expected) < 5 * math.sqrt(expected * (1 - expected) / n) + 1 / n
    assert abs(weighted - 1) < 0.05  # inclusion scores make the samples unbiased


def test_units_that_end_alike_share_their_nodes():
    store = pieces.Store(pieces.store_of(PIECES, 1.0).vocabulary, 1.0)
    store.learn(["▁walking"])
    assert store.nodes == 8
    store.learn(["▁talking", "▁walking", "▁talking", "king"])
    assert store.nodes == 10  # the two endings that begin before "alking"
    assert store.start["king"] in store.to[: store.edges].tolist()
    alone = pieces.Store(store.vocabulary, 1.0)
    for unit in ("▁talking", "king"):
        assert sorted(every_path(store, unit)) == sorted(every_path(alone, unit))
    # Far fewer nodes than characters where words are made of the same endings.
    heads = [a + b for a in "bcdfghklmnprst" for b in ("a", "e", "i", "o", "u", "an", "er", "in", "on", "un")]
    text = " ".join(a + b for a in heads for b in heads[::7])
    store.clear()
    pieces.sample([text], [1], store, 3)
    assert store.nodes < len(text) / 2


def test_samples_do_not_depend_on_what_the_store_knows():
    vocabulary = pieces.store_of(PIECES, 1.0).vocabulary
    texts = ["", " ", "\n\n a  b \n", "c▁d\t\r\n", "x" * 300, "one\ntwo  three ", "▁▁ a\x00b \x00the", "日本語😀", "the cat then the cats"]
    codes, begin, units = pieces.laid_out(texts)
    assert units.tolist() == [len(pieces.units_of(t)) for t in texts]
    assert np.diff(begin, append=len(codes)).tolist() == [len(u) for t in texts for u in pieces.units_of(t)]
    together = pieces.sample(texts, list(range(len(texts))), pieces.Store(vocabulary, 1.0), 3)
    for k, (text, found) in enumerate(zip(texts, together)):
        alone = pieces.sample([text], [k], pieces.Store(vocabulary, 1.0), 3)[0]
        assert [(a.tolist(), *x) for a, *x in found] == [(b.tolist(), *y) for b, *y in alone]
        assert all(vocabulary.decode(ids.tolist()) == text for ids, *_ in found), text
        wanted = b" " + text.encode() if text else b""
        assert list(vocabulary.decode_all([ids for ids, *_ in found])) == [wanted] * len(found)
    assert list(vocabulary.decode_all([])) == []


def test_samples_of_odd_rows(odd, odd_rows, empty):
    got = pieces.sampled(odd, PIECES).collect()
    assert len(got) == len(odd_rows) and all(r.round_trip for r in got)
    by_id = rows_of(pieces.sampled(odd.repartition(5), PIECES))
    for r in got:
        assert 1 <= len(r.samples) <= pieces.SAMPLES and len({tuple(s.ids) for s in r.samples}) == len(r.samples)
        assert all(0 <= s.inclusion <= 1 for s in r.samples) and any(x.samples == r.samples for x in by_id[r.id])
    assert [len(r.samples[0].ids) for r in got if r.id in (4, 5)] == [0, 0]
    assert pieces.sampled(empty, PIECES).count() == 0


def test_a_worker_holds_little_whatever_its_batches(monkeypatch):
    class Rows:
        def mapInArrow(self, run, schema):
            return run

    monkeypatch.setattr(common, "text_rows", lambda *a: Rows())
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = [" ".join("".join(rng.choices(letters, k=6)) for _ in range(570)) for _ in range(256)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(256), pa.int64()), pa.array(texts)], ["id", "text"])
    common.remembered("")
    pieces.store_of(PIECES, 1.0)  # its vocabulary and first arrays are not counted
    tracemalloc.start()
    try:
        out = list(pieces.sampled(None, PIECES)([batch] * 2))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    # A million characters in a batch: 304 MB if they are searched at once, 58 MB in slices.
    assert [b.num_rows for b in out] == [256] * 2 and out[0].equals(out[1])
    assert most < 150e6


def test_what_an_array_grows_by_is_not_written():
    def resident():
        return sum(map(int, re.findall(r"\nAnonymous:\s+(\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

    before = resident()
    array = pieces.grown(np.zeros(1 << 25), 0, np.ones(1))  # pages of zeros, none of them written
    array = pieces.grown(array, 1, np.ones(1 << 25))
    assert resident() - before < 400 and array[0] == array[1 << 25] == 1 and len(array) >= 1 << 26


def test_pieces_decode_by_the_library():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    store = pieces.store_of(PIECES, 1.0)
    for text in ("Hello world  twice", "één\nligne", "日本語"):
        for ids, *_ in pieces.sample([text], [3], store, 3)[0]:
            assert model.decode(ids.tolist()).lstrip(" ") == text and store.vocabulary.decode(ids.tolist()) == text


# licenses


def test_license_scan(spark, empty):
    prose = "of the and ing tion er " * 30
    rows = [
        (1, "a/LICENSE", "Licensed under the Apache License, Version 2.0."), (2, "a/b/x.txt", prose), (3, "a/b/c/y.txt", prose + "\nAll rights reserved.\n" + prose),
        (4, "d/z.txt", prose), (5, "a/b/COPYING.md", "licensed under the GNU General Public License, version 3."), (6, None, prose), (7, "a/q.txt", None),
        (8, "a/b/LICENSE", "Licensed under CC BY-NC 4.0."), (9, "top.txt", ""), (9, "top.txt", ""),
    ]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string").withColumn("license", F.lit("clash"))
    got = {r.id: (r.license, r.origin, r.license_dir) for r in licenses.license_scan(df, df["path"]).collect()}
    nearest = "CC-BY-NC-4.0"  # two files of one score: the first by name
    assert got == {
        1: ("Apache-2.0", "own", None), 2: (nearest, "inherited", "a/b"), 3: ("all-rights-reserved", "own", None), 4: (None, "none", None),
        5: ("GPL-3.0", "own", None), 6: (None, "none", None), 7: ("Apache-2.0", "inherited", "a"), 8: (nearest, "own", None), 9: (None, "none", None),
    }
    assert licenses.license_scan(df, df["path"]).count() == len(rows)
    nothing = empty.withColumn("path", F.lit("a/b"))
    assert licenses.license_scan(nothing, nothing["path"]).count() == 0


HEADERS = {
    "MIT": ["Please note: this is licensed under an MIT License", "/* SPDX-License-Identifier: MIT */"],
    "Apache-2.0": [
        'Licensed to the Apache Software Foundation (ASF) under one or more\ncontributor license agreements.  See the NOTICE file distributed with\nthis work for additional information regarding copyright ownership.\nThe ASF licenses this file to You under the Apache License, Version 2.0\n(the "License"); you may not use this file except in compliance with\nthe License.  You may obtain a copy of the License at\n\n   http://www.apache.org/licenses/LICENSE-2.0',
        "# SPDX-License-Identifier: Apache-2.0 WITH LLVM-exception",
    ],
    "GPL-2.0": [
        " * This program is free software; you can redistribute it and/or modify\n * it under the terms of the GNU General Public License version 2 as\n * published by the Free Software Foundation.",
        "// SPDX-License-Identifier: GPL-2.0-or-later", "GNU GENERAL PUBLIC LICENSE\n   Version 2, June 1991\n\n Copyright (C) 1989, 1991 Free Software Foundation, Inc.",
    ],
    "LGPL-2.1": [
        "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.",
    ],
    "AGPL-3.0": ["                    GNU AFFERO GENERAL PUBLIC LICENSE\n                       Version 3, 19 November 2007"],
    "MPL-2.0": ["/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */"],
    "BSD-3-Clause": ["// Use of this source code is governed by a BSD-style license that can be\n// found in the LICENSE file."],
    None: ["SPDX-License-Identifier: MIT-0", "the driver's license of the house was under an old stone"],
}


@pytest.mark.parametrize("size,listed", [(200, 200_000), (20_000, 200_000), (200, 5)])
def test_real_notices_are_found_at_every_corpus_size(spark, size, listed, monkeypatch):
    monkeypatch.setattr(licenses, "LISTED", listed)
    texts = [(name, "the of an in a " + text + " an in the house") for name, all_of in HEADERS.items() for text in all_of]
    plain = "case when id % 5 < 3 then concat('an in the house of a walk ', id) else concat('river stone ', id) end"
    corpus = spark.range(1000, 1000 + size).selectExpr("id as doc_id", f"{plain} as text")
    df = corpus.unionByName(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string"))
    got = {r.id: r.license for r in licenses.license_scan(df, F.lit("a/x.txt")).filter("id < 1000").collect()}
    assert {t: got[i] for i, (_, t) in enumerate(texts)} == {t: name for name, t in texts}
