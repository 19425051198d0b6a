"""Substring dedup, source divergence and whitening against plain computations."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.llm import divergence, substrings, whitening
from strata.llm.base import texts
from tests.llm.conftest import ODD


def plain_substrings(rows, size=13):
    words = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    low = {}
    for d, w in words:
        for i in range(len(w) - size + 1 if d is not None else 0):
            g = tuple(w[i:i + size])
            low[g] = min(d, low.get(g, d))
    out = []
    for d, w in words:
        gone = {i + k for i in range(len(w) - size + 1 if d is not None else 0) if low[tuple(w[i:i + size])] < d for k in range(size)}
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=repr)


def cut(df, **options):
    found = substrings.remove_repeats(texts(df), **options).collect()
    for r in found:  # intervals are maximal: sorted, apart, none empty
        spans = [(x["start"], x["end"]) for x in r["removed"]]
        assert all(s < e for s, e in spans) and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    return sorted(((r["doc_id"], r["n_words"], sum(x["end"] - x["start"] for x in r["removed"]), r["text"]) for r in found), key=repr)


def passages(seed, docs=300):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("abcdefg") + str(rng.randrange(9)) for _ in range(rng.choice([12, 13, 14, 60]))) for _ in range(12)]
    rows = [(rng.randrange(docs), " \t".join(rng.choice([p, p.upper(), f"own{n}", "same same same same"]) for p in rng.sample(pool, 4))) for n in range(docs)]
    rows += [(1000 + i, pool[3] + "\n" + pool[3]) for i in range(200)]  # one passage in very many documents, twice in each
    return rows + [(2000, "x " * 40), (2001, "x " * 14), (2002, "x " * 13), (None, pool[3]), (2003, pool[3]), (2003, pool[3] + " more")] + ODD


@pytest.mark.parametrize("partitions, block, piece", [(1, 1 << 21, 1 << 20), (7, 50, 30), (4, 997, 1 << 20)])
def test_substrings_equal_plain_search(spark, docs, monkeypatch, partitions, block, piece):
    rows = passages(partitions)
    monkeypatch.setattr(substrings, "BLOCK_WINDOWS", block)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert cut(docs(rows)) == plain_substrings(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert cut(docs(rows, clash=False), size=3) == plain_substrings(rows, 3)
    monkeypatch.setattr(substrings, "PIECE_BYTES", piece)
    for _, text in rows:
        text = (text or "").encode()
        whole = [x.tolist() for x in map(np.concatenate, zip(*substrings.windows(text)))] or [[], []]
        assert len(whole[0]) == max(0, len(text.split()) - 12)


def test_windows_do_not_depend_on_pieces_and_rolls(monkeypatch):
    words = [f"w{i % 41}" for i in range(3000)]
    text = " ".join(words).encode()
    once = [np.concatenate(x) for x in zip(*substrings.windows(text))]
    plain = collections.defaultdict(set)
    for i, h in enumerate(once[1].tolist()):
        plain[tuple(words[i:i + 13])].add(h)
    assert all(len(h) == 1 for h in plain.values()) and len(set().union(*plain.values())) == len(plain)
    monkeypatch.setattr(substrings, "ROLL", 100)
    again = [np.concatenate(x) for x in zip(*(w for w in [*substrings.windows(text)]))]
    assert all((a == b).all() for a, b in zip(once, again))
    pieces = list(substrings._pieces(text, 50))
    assert b"".join(pieces) == text and sum(len(p.split()) for p in pieces) == 3000
    cuts = [(0, 14), (20, 21), (22, 1500), (2990, 3000)]
    monkeypatch.setattr(substrings._pieces, "__defaults__", (70,))
    kept = [w for i, w in enumerate(words) if not any(s <= i < e for s, e in cuts)]
    assert substrings.without(text, cuts) == (3000, " ".join(kept).encode())


def test_substrings_merge_holds_little_and_empty(docs, monkeypatch):
    assert cut(docs([])) == []
    monkeypatch.setattr(substrings, "BLOCK_WINDOWS", 5)  # buckets settle again and again
    rows = passages(99, 60)
    assert cut(docs(rows)) == plain_substrings(rows)


def plain_divergence(rows, least=10, top=10):
    rows = [(lang or "", source or "", text or "") for lang, source, text in rows]
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n, df = collections.Counter(), collections.Counter()
    for lang, source, text in rows:
        words = [w.translate(low) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]
        n.update((lang, source, w) for w in words)
        df.update((lang, w) for w in set(words))
    out = []
    for lang in {r[0] for r in rows}:
        kept = [w for (x, w), d in df.items() if x == lang and d >= least]
        sources = sorted({r[1] for r in rows if r[0] == lang}, key=lambda s: s.encode())

        def shares(counts):
            total = sum(counts.values())
            return {w: 1 + 10**9 * (counts[w] + 2) // (total + 2 * len(kept)) for w in kept}

        p = {s: shares({w: n[lang, s, w] for w in kept}) for s in sources}
        q = shares({w: sum(n[lang, s, w] for s in sources) for w in kept})
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(o, sum(f(p[s][w], p[o][w]) for w in kept)) for o in sources if o != s]
            own = [(w, f(p[s][w], q[w])) for w in kept if n[lang, s, w] and p[s][w] > q[w]]
            for part, items in (("pair", pairs), ("term", own)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, r) for r, (i, v) in enumerate(items, 1) if part == "pair" or r <= top]
    return sorted(out)


TRIPLE = "lang string, source string, text string"


@pytest.mark.parametrize("seed, fold, held, per_block", [(1, 1 << 20, 10**6, 512), (2, 3000, 40, 2)])
def test_divergence_equals_plain_counts(spark, monkeypatch, seed, fold, held, per_block):
    rng = random.Random(seed)
    vocabulary = ["Apfel", "apfel", "ÄRGER", "ärger", "naïve", "漢字", "a", "b", "don't", "x1y", " ", "Zeta", "eta", "theta", "😀"]
    rows = []
    for _ in range(400):
        rows.append((rng.choice(["en", "de", None, ""]), rng.choice(["s0", "s0", "s0", "s1", "s2", "S3", "ß", None]),
                     " ".join(rng.choices(vocabulary, range(1, len(vocabulary) + 1), k=rng.randrange(12)))))
    rows += [("en", "s0", "apfel eta eta")] * 200 + [("en", "s1", "apfel eta eta")] * 30 + [("fr", "only", "rare words"), ("fr", "other", None), ("fr", "third", "")]
    rows += [("en", "long", "lang " * 30_000 + "x" * 50_000)] + [("one", "alone", "word word")] * 12
    monkeypatch.setattr(divergence, "FOLD_BYTES", fold)
    monkeypatch.setattr(divergence, "HELD_WORDS", held)
    monkeypatch.setattr(divergence.pair_sums, "__defaults__", (per_block,))
    df = spark.createDataFrame(rows, TRIPLE).repartition(5).selectExpr("*", "1 AS n", "'c' AS item", "2 AS `at`", "3 AS word")
    assert sorted(map(tuple, divergence.source_divergence(df).collect())) == plain_divergence(rows)


def test_divergence_empty_and_large_counts(spark):
    assert divergence.source_divergence(spark.createDataFrame([], TRIPLE)).collect() == []
    big = spark.createDataFrame([(5 * 10**12, 7 * 10**12, 3)], "n long, total long, kept long")
    assert big.select(divergence.share("n", "total")).first()[0] == 1 + 10**9 * (5 * 10**12 + 2) // (7 * 10**12 + 6)
    rng = np.random.default_rng(5)
    p = rng.integers(0, 4, (60, 9)) * rng.integers(1, 10**9, (60, 9))
    p = p[p.any(axis=1)]
    none = rng.integers(1, 1000, 9)
    word, at = np.nonzero(p)
    dense = np.where(p == 0, none, p)
    got, words = divergence.cell_sums(word * 7, at * 2, p[word, at], np.arange(9) * 2, none)
    for i in range(9):
        for j in set(range(9)) - {i}:
            used = (p[:, i] > 0) | (p[:, j] > 0)
            assert words[i, j] == used.sum()
            assert got[i, j] == sum((int(a) - int(b)) ** 2 // (int(a) + int(b)) for a, b in zip(dense[used, i], dense[used, j]))


def plain_whitening(vectors, components=16):
    """x, n, S, exact deviations and the covariance of the distinct vectors, in whole numbers as far as they go."""
    fine = [v for v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [tuple(math.floor(64 * c) + 1_000_000 for c in v) for v in fine]
    listed = sorted(set(x))
    n, sums = len(listed), [sum(c) for c in zip(*listed)]
    off = np.array([[n * a - s for a, s in zip(v, sums)] for v in listed], dtype=object)
    covariance = np.array((off.T @ off).tolist(), dtype=object) / n**3
    return x, n, sums, covariance.astype(float)


def test_whitening_equals_plain_algebra(spark):
    rng = np.random.default_rng(3)
    base = (rng.normal(size=(300, 20)) * np.linspace(0.2, 3, 20)).astype(np.float32)
    rows = [(i, base[i % 250].tolist()) for i in range(600)] + [(700 + i, base[0].tolist()) for i in range(400)]  # a hot vector
    rows += [(None, base[1].tolist()), (5, base[2].tolist()), (800, None), (801, [None] * 20), (802, [float("nan")] * 20), (803, [float("inf")] * 20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4).selectExpr("*", "1 AS x", "2 AS d", "3 AS n", "'w' AS white")
    found = whitening.whiten(whitening.whole_rows(df)).collect()
    x, n, sums, v = plain_whitening([r[1] for r in rows])
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:16], u[:, ::-1][:, :16]
    want = collections.Counter(r[0] for r in rows if r[1] is not None and all(c is not None and math.isfinite(c) for c in r[1]))
    assert collections.Counter(r["vec_id"] for r in found) == want and all(r["n"] == n for r in found)
    of = {i: tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in vec) for i, vec in rows[:600]}
    signs = None
    for r in found:
        if r["vec_id"] is None or r["vec_id"] == 5 or r["vec_id"] >= 600:
            continue
        off = [n * a - s for a, s in zip(of[r["vec_id"]], sums)]
        assert r["deviation"] == sum(o * o for o in off)
        plain = np.array([o / n for o in off]) @ u / np.sqrt(e)
        signs = np.sign(plain * r["white"]) if signs is None else signs
        assert np.allclose(plain * signs, r["white"], rtol=0, atol=1e-9)
    assert np.allclose(found[0]["explained"], e / np.trace(v), rtol=1e-9) and found[0]["identity_error"] < 1e-9


def test_whitening_by_count_odd_lengths_and_huge_entries(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whiten(whitening.whole_rows(spark.createDataFrame([], schema))).collect() == []
    alone = spark.createDataFrame([(1, [0.5, 1.0]), (2, [0.5, 1.0]), (3, [])], schema)
    assert whitening.whiten(whitening.whole_rows(alone)).selectExpr("size(white) AS k").filter("k > 0").count() == 0
    rng = np.random.default_rng(9)
    narrow, wide = rng.normal(size=(40, 3)), rng.normal(size=(30, 5))
    wide[:, 4] = 1.0  # a constant dimension has no component
    rows = [(i, v.tolist()) for i, v in enumerate([*narrow, *narrow[:10], *wide])]
    found = whitening.whiten(whitening.whole_rows(spark.createDataFrame(rows, schema)), by_count=True).collect()
    assert collections.Counter((r["n"], len(r["white"])) for r in found) == {(50, 3): 50, (30, 4): 30}
    white = np.array([r["white"] for r in found if r["n"] == 50])
    assert np.allclose(np.cov(white.T, bias=True), np.eye(3), atol=1e-9) and all(r["identity_error"] < 1e-9 for r in found)
    huge = [(0, [1e307, 0.0]), (1, [-1e307, 1.0]), (2, [0.0, 2.0]), (3, [0.25, 3.0])]
    got = whitening.whiten(whitening.whole_rows(spark.createDataFrame(huge, schema))).collect()
    assert len(got) == 4 and all(math.isfinite(w) for r in got for w in r["white"]) and max(r["deviation"] for r in got) == 2**63 - 1


def test_queries_cover_whole_tables(spark):
    from strata.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = QUERIES["op13_substring_dedup"](spark, sf).collect()
    want = plain_substrings([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got), key=repr) == [
        (d, n, g, hashlib.sha256(t.encode()).hexdigest()) for d, n, g, t in want]
    got = sorted(map(tuple, QUERIES["op12_source_divergence"](spark, sf).select("lang", "source", "part", "item", "value", "rank").collect()))
    assert got == plain_divergence([tuple(r) for r in docs.select("lang", "source", "text").collect()])
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    out = QUERIES["op11_embedding_whitening"](spark, sf)
    assert out.count() == 16 * vectors.count() and out.agg(F.max("identity_error")).first()[0] < 1e-6
