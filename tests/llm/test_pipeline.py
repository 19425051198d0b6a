"""Each stage of the pipeline against its operator done plainly, on one small table with clashing columns."""

import collections
import itertools
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from strata.llm import copies, pii
from strata.llm.queries import QUERIES, SQL
from tests.llm.conftest import ODD
from tests.llm.test_texts import LOWER, plain_line_dedup, toxic_rows


@pytest.fixture
def corpus(spark, tmp_path, docs):
    rng = random.Random(1)
    rows, labels = toxic_rows(rng, 300)
    shared = "This line stands in very many documents of the table, always alike."
    rows = [(i, t + (f"\n{shared}" if i % 3 == 0 else "") + (f"\nmail a{i}@b.org or 10.0.0.{i % 250}" if i % 7 == 0 else "")) for i, t in rows]
    rows += [(1000 + i, rows[1][1]) for i in range(20)] + [(1100 + i, rows[2][1] + " x") for i in range(3)] + [(2000 + (i or 0), t) for i, t in ODD]
    df = docs(rows).selectExpr("*", "'en' AS lang", "'s' AS source", "99L AS n_chars")
    folder = str(tmp_path / "sf")
    df.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in labels], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows, dict(labels)


def test_stages(spark, corpus):
    folder, rows, labels = corpus
    at = spark.read.parquet(f"{folder}/documents.parquet")
    columns = at.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "near_dedup", "pii", "packing"]

    def run(name):
        out = stages[name](spark, at, folder)
        path = f"{folder}/{name}"
        out.write.parquet(path)
        out = spark.read.parquet(path)
        if name != "packing":
            assert out.columns == columns and out.filter("lang <> 'en' OR source <> 's' OR root <> 'r' OR n_chars <> length(text)").count() == 0
        return out

    at = run("toxicity")
    kept = [(i, t or "") for i, t in rows if not labels.get(i)]
    assert sorted((r["doc_id"], r["text"]) for r in at.collect()) == sorted(kept)

    at = run("line_dedup")
    kept = [(i, t) for i, _, _, t in plain_line_dedup(kept)]
    assert sorted((r["doc_id"], r["text"]) for r in at.collect()) == sorted(kept)

    at = run("near_dedup")
    names = plain_near_dedup(kept)
    got = sorted((r["doc_id"], r["text"]) for r in at.collect())
    assert sorted(i for i, _ in got) == names and set(got) <= set(kept) and len(names) < len(kept)
    assert {t for i, t in got if i == 2007} == {t for i, t in kept if i == 2007} and len({t for i, t in kept if i == 2007}) == 2
    kept = got

    at = run("pii")
    got = {(r["doc_id"], r["text"]) for r in at.collect()}
    assert len(got) == len(kept) and all(not pii.base_spans(t) for _, t in got)
    assert {x for x in kept if not pii.base_spans(x[1])} <= got and not {x for x in kept if pii.base_spans(x[1])} & got

    at = run("packing")
    assert {r["doc_id"] for r in at.collect()} == set(names)


def test_pipeline_of_empty_tables(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_registration():
    names = __spark_entry__.queries()
    assert set(QUERIES) < set(names) and "pipeline" in names and "pipeline" not in __spark_entry__.oracle_sql()
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(SQL) == {"op1_secret_scan", "op2_line_dedup", "op7_exact_top_k", "op12_source_divergence", "op13_substring_dedup"} <= set(__spark_entry__.oracle_sql())


def five_words(text):
    w = text.translate(LOWER).split()
    return {" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))}


def plain_near_dedup(rows):
    """Sorted ids of the texts that stay: one, of the smallest id, for each class of texts with 5-word similarity 0.8 or more."""
    rows = sorted(set(rows))
    sets = [five_words(t) for _, t in rows]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if root[a] != root[b] and 5 * shared >= 4 * (len(sets[a]) + len(sets[b]) - shared):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if r == old else r for r in root]
    return sorted(rows[r][0] for r in set(root))


def test_near_copies_of_five_words(spark, docs):
    rng = random.Random(8)
    rows = []
    for g in range(40):  # copies of falling similarity on both sides of 0.8, chains and strangers
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([30, 100, 400]))]
        for c in range(5):
            rows.append((10 * g + c, " ".join(base)))
            for _ in range(rng.randrange(1, 2 + len(base) // 60)):
                base[rng.randrange(len(base))] = f"n{rng.randrange(3000)}"
    passage = " ".join(f"p{i}" for i in range(200))
    rows += [(1000 + i, f"{passage} {' '.join(f'q{i}x{k}' for k in range(rng.choice([1, 60])))}") for i in range(120)]  # one large group, and strangers who share its passage
    want = plain_near_dedup(rows)
    assert 60 < len(want) < len(rows) - 100
    got = corpus_pipeline.drop_near_duplicates(spark, docs(rows), "")
    assert sorted(r["doc_id"] for r in got.collect()) == want


def test_strangers_with_a_common_stock_never_meet(spark, docs):
    """A group in which every text has more than a ninth of its own: no pair of it is compared, but a close pair among them is found."""
    stock = " ".join(f"s{i}" for i in range(300))
    rows = [(i, stock + " " + " ".join(f"own{i}x{k}" for k in range(60))) for i in range(400)]
    rows += [(900, rows[5][1] + " end")]
    sets = copies.shingle_sets(docs(rows).select("doc_id", "text"))
    early = copies.early_shingles(sets)
    most = F.least(F.col("n") - F.col("at"), F.col("n2") - F.col("at2"))
    other = early.select("key", F.col("set_id").alias("id2"), F.col("n").alias("n2"), F.col("at").alias("at2"))
    met = early.join(other, "key").filter("set_id < id2").filter(most * 9 >= (F.col("n") + F.col("n2")) * 4).select("set_id", "id2").distinct()
    assert met.count() == 1
    got = corpus_pipeline.drop_near_duplicates(spark, docs(rows), "")
    assert sorted(r["doc_id"] for r in got.collect()) == [i for i in range(400)]


def test_near_copies_of_the_given_documents_are_found(spark):
    """Every pair at 0.8 or more among all given texts, found through an index of all shingles, lies in one class."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = sorted({r["text"] or "" for r in docs.collect()})
    sets = [five_words(t) for t in texts]
    index = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            index[x].append(i)
    shared = collections.Counter(p for held in index.values() for p in itertools.combinations(held, 2))
    near = [(a, b) for (a, b), n in shared.items() if 5 * n >= 4 * (len(sets[a]) + len(sets[b]) - n)]
    kept = {r["text"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert near and not [(a, b) for a, b in near if texts[a] in kept and texts[b] in kept]
    linked = {i for p in near for i in p}
    assert {t for i, t in enumerate(texts) if i not in linked and sets[i] not in [s for j, s in enumerate(sets) if j != i]} <= kept


def test_near_copies_come_from_multi_index_hashing(spark, docs, monkeypatch):
    """The fingerprints alone find pairs within SEGMENTS - 1 bits always and nine in ten near copies; a bucket gives two pairs a set at most."""
    rng = random.Random(3)
    pairs = []
    for g in range(300):
        base = [f"w{rng.randrange(10 ** 6)}" for _ in range(rng.choice([40, 150, 600]))]
        other = base + ["new"] if g % 5 == 0 else list(base)
        for _ in range((1 + len(base) // 80) * (g % 5 > 0)):
            other[rng.randrange(len(base))] = "new"
        a, b = five_words(" ".join(base)), five_words(" ".join(other))
        if 5 * len(a & b) >= 4 * len(a | b):
            pairs.append((" ".join(base), " ".join(other)))
    texts = [t for p in pairs for t in p]
    bits = copies.segment_bits(10_000)
    rows = [(i, t) for i, t in enumerate(texts)] + [(10_000 + i, f"stranger {i} " + " ".join(f"s{i}x{k}" for k in range(40))) for i in range(500)]
    each = copies.signatures(docs(rows).select("doc_id", "text"), bits).localCheckpoint()
    copy_of = {r["doc_id"]: r["copy"] for r in each.collect()}
    prints = {r["doc_id"]: int.from_bytes(r["print"][:-8], "big") for r in each.collect()}
    got = {frozenset(r) for r in copies.candidates(each, bits).collect()}
    met = [frozenset((copy_of[2 * i], copy_of[2 * i + 1])) in got for i in range(len(pairs))]
    assert len(pairs) > 100 and sum(met) >= 0.9 * len(pairs)
    near = [i for i in range(len(pairs)) if (prints[2 * i] ^ prints[2 * i + 1]).bit_count() < copies.SEGMENTS]
    assert near and all(met[i] for i in near)
    # what the stage links first comes from there: without any shared MinHash key, found pairs still link
    monkeypatch.setattr(copies, "sharing", lambda each: each.select("copy").limit(0))
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs(rows), "").collect()}
    assert not [i for i in range(len(pairs)) if met[i] and {2 * i, 2 * i + 1} <= kept]


def test_a_crowded_segment_gives_two_pairs_a_set(spark, docs):
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base + [f"end{i}"])) for i in range(300)]
    each = copies.signatures(docs(rows).select("doc_id", "text"), 16)
    found = copies.candidates(each, 16).collect()
    assert 299 <= len(found) <= 299 * 2 and not [r for r in found if r["a"] == r["b"]]
