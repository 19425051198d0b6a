r"""Toxicity grades by cumulative-link ordinal regression.

Labels say toxic or not. Features are words and word beginnings; those whose document frequencies differ most between the two classes,
by the log-likelihood ratio and beyond a level that chance hardly reaches, make the vocabulary (a bounded number, counted by Spark
over the labelled sample). The number of a toxic text's words that are features of toxic texts sorts it into
grades 1 to GRADES, and clean texts are grade 0. The model has one weight per feature, shared by all thresholds, and ordered thresholds: P(grade >= j) = sigmoid(w . x - t_j), t_1 < t_2 < ..., fitted by penalised likelihood on at most
`sample` labelled documents. Scoring is one pass that sends no text; severity is the expected grade, the sum of P(grade >= j).

Defined cases: a null or empty text has no words and the severity of the thresholds alone; a label that is null, or whose document or id is
missing, is not used; a document labelled both ways is toxic; without labels of both classes every severity is 0; repeated rows and
null ids are scored like any row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Container, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strata.llm.base import query, schema_text, sliced, table, texts
from strata.session import write_scratch

#: Labelled documents the fit reads at most, features at most, the least log-likelihood ratio of a feature, letters of a beginning.
SAMPLE = 20_000
VOCABULARY = 4096
GRADES = 3
LEAST_RATIO = 18.0
BEGINNING = 5
PENALTY = 1e-5
ROUNDS = 400
#: A document is rejected when P(grade >= 1) is at least this.
REJECT_AT = 0.6

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def features_of(words: list[str], known: Container[str] | None = None) -> dict[str, int]:
    """How often each feature (those in `known`, or all) occurs; a beginning ends in a star."""
    counts: dict[str, int] = {}
    for w in words:
        if known is None or w in known:
            counts[w] = counts.get(w, 0) + 1
        if len(w) > BEGINNING:
            w = w[:BEGINNING] + "*"
            if known is None or w in known:
                counts[w] = counts.get(w, 0) + 1
    return counts


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


@dataclass(frozen=True)
class OrdinalModel:
    """Words with their weights, and ordered thresholds (empty: nothing was learned)."""

    weights: dict[str, float]
    thresholds: np.ndarray

    def score(self, text: str) -> float:
        known = self.weights
        return float(sum(known[w] * np.log1p(n) for w, n in features_of(words_of(text), known).items()))

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= j), one column per threshold."""
        return sigmoid(scores[:, None] - self.thresholds[None, :])


def fit_ordinal(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, grades: np.ndarray, n_words: int,
                penalty: float = PENALTY, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the cumulative-link model for a sparse matrix in coordinates, by Adam on the whole likelihood.

    Thresholds are t_1 and positive steps (exponentials), so they stay ordered.
    """
    n, top = len(grades), int(grades.max())
    share = np.array([(grades >= j).mean() for j in range(1, top + 1)])
    start = -np.log(np.clip(share, 1e-6, 1 - 1e-6) / (1 - np.clip(share, 1e-6, 1 - 1e-6)))
    p = np.concatenate([np.zeros(n_words), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, rounds + 1):
        w, steps = p[:n_words], np.exp(p[n_words + 1:])
        t = np.concatenate([[-np.inf], p[n_words] + np.concatenate([[0.0], np.cumsum(steps)]), [np.inf]])
        s = np.bincount(rows, weights=values * w[columns], minlength=n)
        above, below = sigmoid(s - t[grades]), sigmoid(s - t[grades + 1])  # P(grade >= y), P(grade >= y + 1)
        likely = np.maximum(above - below, 1e-12)
        d_above, d_below = above * (1 - above), below * (1 - below)
        d_s = -(d_above - d_below) / likely / n
        g_t = np.bincount(grades, weights=d_above / likely / n, minlength=top + 1)[1:top + 1] \
            - np.bincount(grades + 1, weights=d_below / likely / n, minlength=top + 2)[1:top + 1]
        g = np.concatenate([np.bincount(columns, weights=values * d_s[rows], minlength=n_words) + penalty * w,
                            [g_t.sum()], [g_t[j:].sum() * steps[j - 1] for j in range(1, top)]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - 0.1 / (1 + step / 100) * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return p[:n_words], p[n_words] + np.concatenate([[0.0], np.cumsum(np.exp(p[n_words + 1:]))])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, vocabulary: int = VOCABULARY, grades: int = GRADES) -> OrdinalModel:
    """Fit on at most `sample` labelled documents, chosen by a hash of their ids; `docs` holds doc_id and text."""
    nothing = OrdinalModel({}, np.empty(0))
    chosen = (labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 100):
            found = [features_of(words_of(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([list(f) for f in found], pa.list_(pa.string())),
                 pa.array([list(f.values()) for f in found], pa.list_(pa.int64()))], ["doc_id", "toxic", "words", "counts"])

    # `chosen` has at most `sample` rows of two numbers
    sampled = write_scratch(
        docs.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "text", "toxic")
        .mapInArrow(counted, "doc_id long, toxic int, words array<string>, counts array<long>"), "labelled-words")
    sizes = {r["toxic"]: r["n"] for r in sampled.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return nothing
    bad, good = sizes[1], sizes[0]
    each = sampled.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(
        F.sum("toxic").cast("double").alias("bad"), F.sum(1 - F.col("toxic")).cast("double").alias("good"))
    expected = (F.col("bad") + F.col("good")) / float(bad + good)

    def part(seen: Column, n: int) -> Column:  # of the log-likelihood ratio, for the documents of one class with and without the word
        def term(count: Column, rate: Column) -> Column:
            return F.when(count > 0, count * F.log(count / (rate * n))).otherwise(0.0)
        return term(seen, expected) + term(n - seen, 1 - expected)

    picked = (each.withColumn("ratio", 2 * (part(F.col("bad"), bad) + part(F.col("good"), good)))
              .withColumn("sign", F.col("bad") * good > F.col("good") * bad).filter(F.col("ratio") >= LEAST_RATIO)
              .orderBy(F.col("ratio").desc(), "word").limit(vocabulary).select("word", "sign").collect())
    if not picked:
        return nothing
    index = {r["word"]: i for i, r in enumerate(picked)}
    typical = {r["word"] for r in picked if r["sign"]}
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((index, typical))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, strong = shared.value
        for batch in sliced(batches, 100):
            columns, values, hits = [], [], []
            for words, counts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                kept = [(place[w], c) for w, c in zip(words, counts) if w in place]
                columns.append([k for k, _ in kept])
                values.append([c for _, c in kept])
                hits.append(sum(c for w, c in zip(words, counts) if w in strong))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(hits, pa.int64()), pa.array(columns, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.int64()))],
                ["doc_id", "toxic", "hits", "columns", "counts"])

    # at most `sample` rows of vocabulary counts; sorted, as the sums below depend on the order
    fit = sampled.mapInArrow(features, "doc_id long, toxic int, hits long, columns array<int>, counts array<long>").toArrow().sort_by("doc_id")
    toxic, hits = np.asarray(fit["toxic"]), np.asarray(fit["hits"])
    lists = fit["columns"].combine_chunks()
    rows = np.repeat(np.arange(len(toxic)), np.diff(np.asarray(lists.offsets)))
    columns, values = np.asarray(lists.flatten()), np.log1p(np.asarray(fit["counts"].combine_chunks().flatten()))
    edges = np.quantile(hits[toxic == 1], np.arange(1, grades) / grades)
    grade = np.where(toxic == 1, 1 + np.searchsorted(np.unique(edges), hits), 0)
    weights, thresholds = fit_ordinal(rows, columns, values, grade, len(index))
    return OrdinalModel({w: float(weights[i]) for w, i in index.items()}, thresholds)


def grade_documents(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """Rows of `docs`, among whose columns is text, with p_toxic (the probability of grade 1 or more) and the expected severity."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            n = batch.num_rows
            tails = fitted.tails(np.array([fitted.score(t) for t in batch.column(at).to_pylist()], dtype=float).reshape(n))
            toxic = tails[:, 0] if tails.shape[1] else np.zeros(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(toxic), pa.array(tails.sum(axis=1))], [*batch.schema.names, "p_toxic", "severity"])

    return docs.mapInArrow(run, f"{schema_text(docs)}, p_toxic double, severity double")


@query("op8_toxicity")
def toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """Expected severity of every document and whether it is rejected."""
    docs = texts(table(spark, sf, "documents"))
    found = grade_documents(docs, train(docs, table(spark, sf, "labels")))
    return found.select("doc_id", "p_toxic", "severity", (F.col("p_toxic") >= REJECT_AT).alias("toxic"))
