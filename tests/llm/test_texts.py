"""Line dedup, quality rules, SimHash and toxicity against plain computations."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from strata.llm import lines, quality, simhash, toxicity
from strata.llm.base import texts
from tests.llm.conftest import ODD

STRIP = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_line_dedup(rows, least_chars=40, least_docs=5):
    key = lambda line: line.strip(STRIP).translate(LOWER)
    holders = collections.defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if doc is not None and len(key(line)) >= least_chars:
                holders[key(line)].add(doc)
    out = []
    for doc, text in rows:
        all_lines = (text or "").split("\n")
        kept = [x for x in all_lines if doc is None or len(holders.get(key(x), ())) < least_docs or doc == max(holders[key(x)])]
        out.append((doc, len(all_lines), len(all_lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def dedup(rows_df, **options):
    d = texts(rows_df)
    found = lines.kept_texts(lines.with_bitmaps(d, lines.keep_bitmaps(d, **options)))
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in found.collect()), key=repr)


@pytest.mark.parametrize("shuffle_partitions", [1, 4, 23])
def test_line_dedup_with_hot_and_boundary_keys(spark, docs, shuffle_partitions):
    rng = random.Random(shuffle_partitions)
    pool = [f"Line {i} " + "é" * rng.choice([20, 34, 35, 60]) for i in range(30)]
    rows = [(rng.randrange(400), "\n".join(rng.choice(["", " \t", "\r"]) + rng.choice([str.upper, str])(x) for x in rng.sample(pool[: rng.choice([2, 30])], 2)) + "\nown " + str(n))
            for n in range(500)]
    rows += [(1000 + i, pool[0]) for i in range(300)] + [(None, pool[0])] + ODD
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", shuffle_partitions)
    try:
        assert dedup(docs(rows)) == plain_line_dedup(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_line_dedup_empty_and_bits(docs):
    assert dedup(docs([])) == []
    bits = lines.pack_bits(11, [0, 10])
    assert lines.unpack_bits(bits, 11).tolist() == [False] + [True] * 9 + [False]


def plain_statistics(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    each = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = collections.Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(each) - len(set(each)), len(covered)


def test_statistics_equal_plain_counts(docs):
    rng = random.Random(5)
    rows = [(100 + i, "".join(rng.choice(["a", "b", "é😀", "c#", " ", "\n", "\n\n", "\t", "\xa0"]) for _ in range(rng.randrange(80)))) for i in range(400)] + ODD
    got = quality.text_statistics(texts(docs(rows)), "doc_id").collect()
    want = sorted(((i, *plain_statistics(t or "")) for i, t in rows), key=repr)
    assert sorted(((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got), key=repr) == want


def labelled(spark, rng, n=900):
    """Bad documents shout or hold symbols; a tenth of the good ones hold one symbol."""
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(80)]
        bad = i % 3 == 0
        if bad:
            words = [w + "##" for w in words] if i % 2 else [w.upper() for w in words]
        elif i % 10 == 1:
            words[3] += "#"
        rows.append((i, " ".join(words)))
        labels.append((i, 0 if bad else 1, 0))
    return rows, spark.createDataFrame([*labels, (None, 0, 0), (5000, 1, None), (7, None, 1)], "doc_id long, quality int, toxic int")


def test_decision_list_finds_the_planted_rules(spark, docs):
    rows, labels = labelled(spark, random.Random(6))
    d = texts(docs(rows))
    found = quality.learn(d, labels)
    assert 1 <= len(found.rules) <= 4
    verdicts = {r["doc_id"]: (r["kept"], r["rule"]) for r in quality.judge(d, found).collect()}
    assert all(kept == (i % 3 != 0) and (rule is None) == kept for i, (kept, rule) in verdicts.items())
    plan = quality.judge(d, found)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_decision_list_of_nothing(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    found = quality.learn(texts(docs(ODD)), none)
    assert found.rules == ()
    out = quality.judge(texts(docs(ODD)), found).collect()
    assert len(out) == len(ODD) and sum(r["kept"] for r in out) == sum(not (s[0] < 50 or 100 * s[4] > 50 * s[0]) for s in (plain_statistics(t or "") for _, t in ODD))
    assert quality.judge(texts(docs([])), found).count() == 0


def plain_fingerprint(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOWER)) if x]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, fps):
    root = list(range(len(ids)))
    for a in range(len(ids)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 3 and root[a] != root[b]:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if r == old else r for r in root]
    least = {r: min((i for i, q in zip(ids, root) if q == r and i is not None), default=None) for r in set(root)}
    return [least[r] for r in root]


def test_simhash_equals_all_pairs(docs):
    rng = random.Random(7)
    base = [[f"w{rng.randrange(40)}" for _ in range(120)] for _ in range(12)]
    rows = list(ODD)
    for i in range(220):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            w[rng.randrange(120)] = f"New{rng.randrange(9)}"
        rows.append((100 + i, " ".join(w)))
    got = simhash.near_duplicates(texts(docs(rows))).collect()
    fps = [plain_fingerprint(t) for _, t in rows]
    comps = plain_components([i for i, _ in rows], fps)
    want = sorted(((i, f, c) for (i, _), f, c in zip(rows, fps, comps)), key=repr)
    assert sorted(((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in got), key=repr) == want
    assert len({c for c in comps}) < len(rows) - 60
    distinct = set(fps)
    degree = {f: sum(0 < (f ^ g).bit_count() <= 3 for g in distinct) for f in distinct}
    assert all(r["links"] == degree[r["fp"] % (1 << 64)] for r in got)


def test_links_of_planted_distances(spark):
    rng = random.Random(8)
    fps = {rng.getrandbits(64) for _ in range(50)}
    for f in list(fps):
        g = f
        for b in rng.sample(range(64), rng.randrange(1, 6)):
            g ^= 1 << b
        fps.add(g)
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    found = simhash.links(spark.createDataFrame([(signed(f),) for f in fps], "fp long")).collect()
    got = {frozenset((r["a"], r["b"])) for r in found}
    assert got == {frozenset((signed(a), signed(b))) for a in fps for b in fps if 0 < (a ^ b).bit_count() <= 3}


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (300, 200), (400, 500)]
    random.Random(9).shuffle(edges)
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 200: 100, 300: 100, 400: 400, 500: 400}


def test_simhash_of_empty_table(docs):
    assert simhash.near_duplicates(texts(docs([]))).count() == 0


def toxic_rows(rng, n):
    rows, labels = [], []
    for i in range(n):
        w = ["".join(rng.choice("abcdefghijk") for _ in range(4)) for _ in range(60)]
        toxic = i % 5 == 0
        for _ in range(rng.choice([3, 4, 9]) if toxic else 0):
            w[rng.randrange(60)] = rng.choice(["Vile", "awful!", "(rotten)", "nasty***"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_held_out(spark, docs):
    rows, labels = toxic_rows(random.Random(10), 1000)
    d, l = texts(docs(rows)), spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(d, l.filter("doc_id < 700 OR doc_id IS NULL"))
    assert len(model.thresholds) == 3 and (np.diff(model.thresholds) > 0).all()
    out = {r["doc_id"]: r for r in toxicity.grade_documents(d.filter("doc_id >= 700"), model).collect()}
    assert all((out[i]["p_toxic"] >= toxicity.REJECT_AT) == bool(y) for i, y in labels if i >= 700)
    hits = {i: len(re.findall("vile|awful|rotten|nasty", t.lower())) for i, t in rows}
    few, many = ([out[i]["severity"] for i in out if lo <= hits[i] <= hi] for lo, hi in ((1, 3), (7, 9)))
    assert np.mean(few) + 0.5 < np.mean(many) <= 3


def test_ordinal_fit_is_the_gradient_zero():
    """The fitted parameters are a stationary point of the penalised likelihood, checked by finite differences."""
    rng = np.random.default_rng(11)
    n, k = 400, 3
    x = rng.normal(size=(n, k))
    grades = np.digitize(x @ [1.0, -2.0, 0.5] + rng.logistic(size=n), [0.0, 1.5])
    rows, columns = np.repeat(np.arange(n), k), np.tile(np.arange(k), n)
    w, t = toxicity.fit_ordinal(rows, columns, x.ravel(), grades, k, penalty=1e-3, rounds=3000)

    def loss(w, t):
        edges = np.concatenate([[-np.inf], t, [np.inf]])
        s = x @ w
        return -np.log(toxicity.sigmoid(s - edges[grades]) - toxicity.sigmoid(s - edges[grades + 1])).mean() + 5e-4 * (w @ w)

    for i in range(k + 2):
        step = np.zeros(k + 2)
        step[i] = 1e-4
        slope = (loss(w + step[:k], t + step[k:]) - loss(w - step[:k], t - step[k:])) / 2e-4
        assert abs(slope) < 2e-3


def test_toxicity_of_odd_rows(spark, docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(texts(docs(ODD)), none)
    out = toxicity.grade_documents(texts(docs(ODD)), model).collect()
    assert len(out) == len(ODD) and all(r["severity"] == 0 and r["p_toxic"] == 0 for r in out)
    rows, labels = toxic_rows(random.Random(12), 300)
    model = toxicity.train(texts(docs(rows)), spark.createDataFrame(labels, "doc_id long, toxic int"))
    out = toxicity.grade_documents(texts(docs(ODD)), model).collect()
    assert len(out) == len(ODD) and all(r["p_toxic"] < 0.5 for r in out)
