r"""Exact top-k inner products by columnar branch and bound.

Vectors and queries are dealt into blocks of bounded size; a cell is one block of vectors against one block of queries, and the
only thing a task holds. Inside a cell the vectors lie dimension by dimension. Inner products grow block of dimensions by
block; what the remaining dimensions can add or take is bounded by the product of the remaining norms (Cauchy-Schwarz),
so each query's k-th best lower bound discards candidates, and once few survive only these are carried on as a compact list.
Every cell returns k rows per query and a window keeps the best k of all cells. Queries are a stated set and meet all rows in
blocks; each vector is sent once per block of queries and each query once per block of vectors.

Components become floor(scale * x); sums of such whole numbers are exact in double precision while they stay below 2^53. Rows so large that they might
not are multiplied as exact integers, apart from the rest of their cell, with scores held to the range of a long.

Defined cases: vectors that are null, hold null, NaN or infinity, or have no id take no part; vectors of other lengths than the query are
not its candidates; rows with the query's id are its own; queries that share an id are answered one by one, each with ranks from 1;
a component that the scale carries beyond the largest double is held there; repeated candidates are ranked each; ties go to the smaller id; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from strata.llm.base import query, table
from strata.session import write_scratch

K = 5
SCALE = 256.0
VECTORS_PER_BLOCK = 4096
QUERIES_PER_BLOCK = 4096
#: Queries whose partial sums are held at once, dimensions added at once, share of survivors below which they are listed.
QUERIES_AT_ONCE = 256
DIMENSIONS = 8
LISTED = 0.1
#: Norm below which products of two rows stay below 2^53.
SMALL = 2.0 ** 26

_LONG = np.iinfo(np.int64)


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products in Python's integers, held to the range of a long."""
    whole = lambda a: np.array([[int(v) for v in row] for row in a], dtype=object).reshape(a.shape)
    return np.clip(whole(q) @ whole(x), _LONG.min, _LONG.max).astype(np.int64)


def _best(qi: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of each query, ties to the smaller id; the arrays list (query, candidate) pairs."""
    # of whole numbers the complement orders backwards, also at the ends of a long's range
    order = np.lexsort((ids, ~score if score.dtype == np.int64 else -score, qi))
    group = qi[order]
    first = np.searchsorted(group, group, side="left")
    return order[np.arange(len(order)) - first < k]


def cell_topk(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of `q`, vector id, score) of the k best of each row of `q` among the columns of `x`."""
    if x.shape[1] == 0 or len(q) == 0:
        return (np.empty(0, np.int64),) * 3
    with np.errstate(over="ignore"):
        small_q, small_x = np.sqrt((q * q).sum(axis=1)) < SMALL, np.sqrt((x * x).sum(axis=0)) < SMALL
    if small_q.all() and small_x.all():
        return _pruned_topk(q, q_ids, x, x_ids, k)
    found = []
    for chosen, columns in ((np.flatnonzero(~small_q), np.arange(x.shape[1])), (np.flatnonzero(small_q), np.flatnonzero(~small_x))):
        score = _exact(q[chosen], x[:, columns])
        qi, ci = np.nonzero(q_ids[chosen][:, None] != x_ids[columns][None, :])
        found.append((chosen[qi], x_ids[columns][ci], score[qi, ci]))
    chosen = np.flatnonzero(small_q)
    qi, ids, score = cell_topk(q[chosen], q_ids[chosen], np.ascontiguousarray(x[:, small_x]), x_ids[small_x], k)
    found.append((chosen[qi], ids, score))
    qi, ids, score = (np.concatenate(column) for column in zip(*found))
    top = _best(qi, ids, score, k)
    return qi[top], ids[top], score[top]


def _pruned_topk(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for rows whose products are exact in double precision."""
    d = x.shape[0]
    order = np.argsort(-(x * x).sum(axis=1), kind="stable")  # heavy dimensions first
    x, q = x[order], q[:, order]
    cuts = list(range(0, d, DIMENSIONS)) or [0]
    left_x = [np.sqrt((x[c:] ** 2).sum(axis=0)) for c in [*cuts, d]]
    left_q = [np.sqrt((q[:, c:] ** 2).sum(axis=1)) for c in [*cuts, d]]
    out: list[tuple] = []
    for s in range(0, len(q), QUERIES_AT_ONCE):
        part, ids = q[s:s + QUERIES_AT_ONCE], q_ids[s:s + QUERIES_AT_ONCE]
        own = ids[:, None] == x_ids[None, :]
        sums = np.zeros((len(part), x.shape[1]))
        pairs = None
        for b, c in enumerate(cuts):
            rest_q, rest_x = left_q[b + 1][s:s + QUERIES_AT_ONCE], left_x[b + 1]
            rows = slice(c, c + DIMENSIONS)
            if pairs is None:
                sums += part[:, rows] @ x[rows]
                slack = rest_q[:, None] * rest_x[None, :]
                low = np.where(own, -np.inf, sums - slack)
                kth = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] >= k else np.full(len(part), -np.inf)
                alive = (sums + slack + 1.0 >= kth[:, None]) & ~own  # one unit for the rounding of the norms
                if b + 1 == len(cuts) or alive.mean() < LISTED:
                    pairs = np.nonzero(alive)
                    partial = sums[pairs]
            else:
                qi, ci = pairs
                partial = partial + np.einsum("ij,ji->i", part[qi, rows], x[rows, ci])
                slack = rest_q[qi] * rest_x[ci]
                # pairs are ordered by query: the k-th best lower bound of each run
                rank = np.lexsort((slack - partial, qi))
                start = np.searchsorted(qi, np.arange(len(part)))
                kth = np.full(len(part), -np.inf)
                n = np.bincount(qi, minlength=len(part))
                many = n >= k
                kth[many] = (partial - slack)[rank[start[many] + k - 1]]
                stay = partial + slack + 1.0 >= kth[qi]
                pairs, partial = (qi[stay], ci[stay]), partial[stay]
        qi, ci = pairs
        top = _best(qi, x_ids[ci], partial, k)
        out.append((s + qi[top], x_ids[ci[top]], partial[top].astype(np.int64)))
    return tuple(np.concatenate(column) for column in zip(*out))


_FOUND = "query_id long, row long, vec_id long, score long"
_LARGEST = float(np.finfo(np.float64).max)


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = SCALE) -> DataFrame:
    """(vec_id, v): usable vectors as whole numbers held in doubles."""
    x = F.col(vector_col).cast("array<double>")
    fine = F.forall(x, lambda c: F.coalesce((F.abs(c) < float("inf")) & ~F.isnan(c), F.lit(False)))
    return (vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).filter(fine)
            .select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: _whole(c, scale)).alias("v")))


def _whole(c, scale: float):
    # rint-free floor that stays a double: Spark's floor() of a double is a long, too narrow for huge components
    scaled = F.greatest(F.least(c * F.lit(scale), F.lit(_LARGEST)), F.lit(-_LARGEST))
    return F.when(F.abs(scaled) < 2.0 ** 53, F.floor(scaled).cast("double")).otherwise(scaled)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all `vectors` for every row of `queries`; both hold vec_id and v."""
    spark = vectors.sparkSession
    n_x = max(1, -(-vectors.count() // VECTORS_PER_BLOCK))
    n_q = max(1, -(-queries.count() // QUERIES_PER_BLOCK))

    def numbered(rows: DataFrame, is_query: bool, own: int) -> DataFrame:
        # the row's number in its partition spreads rows that are alike
        mine = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(own)).cast("int")
        return rows.select("vec_id", F.monotonically_increasing_id().alias("row"), "v", F.size("v").alias("d"), F.lit(is_query).alias("is_query"), mine.alias("own"))

    def run(cell: pa.Table) -> pa.Table:
        cell = cell.combine_chunks()
        d = cell.column("d")[0].as_py()
        flat = np.asarray(cell.column("v").combine_chunks().flatten()).reshape(cell.num_rows, d)
        ids, is_query = np.asarray(cell.column("vec_id")), np.asarray(cell.column("is_query").to_pylist(), dtype=bool)
        qi, found, score = cell_topk(flat[is_query], ids[is_query], np.ascontiguousarray(flat[~is_query].T), ids[~is_query], k)
        row = np.asarray(cell.column("row"))[is_query]
        return pa.table([pa.array(c, pa.int64()) for c in (ids[is_query][qi], row[qi], found, score)], ["query_id", "row", "vec_id", "score"])

    # written once, so that a row keeps its block; only then sent to every block of the other side
    stored = write_scratch(numbered(vectors, False, n_x).union(numbered(queries, True, n_q)), "vector-blocks")
    every = F.explode(F.sequence(F.lit(0), F.when(F.col("is_query"), n_x).otherwise(n_q) - 1))
    rows = stored.withColumn("other", every).select(
        F.when(F.col("is_query"), F.col("other")).otherwise(F.col("own")).alias("block"),
        F.when(F.col("is_query"), F.col("own")).otherwise(F.col("other")).alias("query_block"), "d", "is_query", "vec_id", "row", "v")
    found = rows.groupBy("block", "query_block", "d").applyInArrow(run, _FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id", "row").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


_DUCK = r"""
WITH e AS (
  SELECT vec_id, row_number() OVER () AS n, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, q.n, e.vec_id, CAST(list_dot_product(q.v, e.v) AS BIGINT) AS score FROM e q, e
  WHERE q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query("op7_exact_top_k", _DUCK)
def exact_top_k(spark: SparkSession, sf: str) -> DataFrame:
    vectors = whole_vectors(table(spark, sf, "embeddings"))
    return top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0))
