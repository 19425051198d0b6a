r"""Whitening of embeddings over their distinct vectors.

Components become whole numbers x = floor(64 * c) + 1000000. Equal x vectors are grouped, with their number of rows; a fit gives each distinct vector
weight one (or, by parameter, its number). Sums are exact; the covariance is a matrix product of vectors centred before they are multiplied,
n * x - S as a whole number divided by n, added up per task and then per cell of the matrix. The driver holds one such matrix, decomposes it, and sends the leading
components along. Each distinct vector is projected once and written; rows meet their vector again by an equality join. The
covariance of the whitened vectors is measured on what was written, not derived.

Defined cases: rows whose vector is null or holds null, NaN or infinite entries take no part; an entry beyond 2^52 / 64 is held at that bound, with its sign; vectors
of another length are a fit of their own; an empty vector has no components; components whose eigenvalue is not above 10^-12 of the largest (constant
dimensions, fewer vectors than dimensions, a single vector) are left out, as nothing can be divided by them; equal eigenvalues are numbered as the
decomposition lists them; a deviation beyond the range of a long is held at it; repeated rows and rows without an id are each returned; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from strata.llm.base import query, table
from strata.session import write_scratch

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Least eigenvalue of a component, as a share of the largest.
LEAST_SHARE = 1e-12
BOUND = 1 << 52
_LONG = np.iinfo(np.int64)


@dataclass(frozen=True)
class Fit:
    """One length's fit: sums over the weighted vectors, the components as columns, their eigenvalues and the trace."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    values: np.ndarray
    trace: float


def whole_rows(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(vec_id, x): usable vectors as whole numbers."""
    c = F.col(vector_col).cast("array<double>")
    fine = F.forall(c, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    held = lambda v: F.least(F.greatest(v * F.lit(float(scale)), F.lit(float(-BOUND))), F.lit(float(BOUND)))
    return (vectors.filter(F.col(vector_col).isNotNull()).filter(fine)
            .select(F.col(id_col).cast("long").alias("vec_id"), F.transform(c, lambda v: F.floor(held(v)) + F.lit(shift)).alias("x")))


def centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n * x - sums of each row, exact: longs where they hold it, else Python's whole numbers."""
    if n * int(np.abs(x).max(initial=0)) >= 1 << 62:
        x = x.astype(object)
        return x * n - np.array([int(s) for s in sums], dtype=object)
    return x * n - np.array(sums, np.int64)


def squared(off: np.ndarray) -> np.ndarray:
    """Sum of squares of each row, exact, held to the range of a long."""
    most = max((abs(int(v)) for v in (off.max(initial=0), off.min(initial=0))), default=0)
    if most * most * max(1, off.shape[1]) < 1 << 62:
        return (off * off).sum(axis=1)
    wide = off.astype(object)
    return np.array([min(int(v), _LONG.max) for v in (wide * wide).sum(axis=1)], np.int64)


def _matrix(batch: pa.RecordBatch, column: int) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    lists = batch.column(column)
    return np.asarray(lists.flatten()).reshape(len(lists), -1)


def _by_length(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    for batch in batches:
        sizes = np.asarray(batch.column(0))
        for d in np.unique(sizes).tolist():
            yield d, batch.filter(pa.array(sizes == d))


def _sum_cells(df: DataFrame, run) -> dict[int, np.ndarray]:
    """Matrices per length, given by `run` as (d, i, j, v) once per task and added up by Spark; the upper triangle is sent."""
    cells = df.mapInArrow(run, "d int, i int, j int, v double").groupBy("d", "i", "j").agg(F.sum("v").alias("v"))
    out: dict[int, np.ndarray] = {}
    for d, i, j, v in cells.collect():  # as many rows as the matrix has cells
        m = out.setdefault(d, {})
        m[i, j] = m[j, i] = v
    return {d: np.array([[m[i, j] for j in range(k)] for i in range(k)]) for d, m in out.items() if (k := 1 + max(i for i, _ in m))}


def _triangle(sums: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for d, m in sums.items():
        i, j = np.triu_indices(len(m))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), d), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(m[i, j])], ["d", "i", "j", "v"])


def exact_sums(listed: DataFrame) -> tuple[dict[int, tuple[int, ...]], dict[int, int]]:
    """Per length, the weighted sum of each dimension and the sum of weights, as whole numbers; `listed` holds d, x and weight."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        weights: dict[int, int] = {}
        for d, batch in _by_length(batches):
            x, w = _matrix(batch, 1), np.asarray(batch.column(2))
            if int(np.abs(x).max(initial=0)) * int(w.sum()) >= 1 << 62:
                x = x.astype(object)
            total[d] = total.get(d, 0) + (x * w[:, None]).sum(axis=0).astype(object)
            weights[d] = weights.get(d, 0) + int(w.sum())
        for d, s in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([d] * len(s), pa.int32()), pa.array(range(len(s)), pa.int32()), pa.array([Decimal(int(v)) for v in s], pa.decimal128(38, 0)),
                 pa.array([weights[d]] * len(s), pa.int64())], ["d", "i", "s", "n"])

    added = listed.mapInArrow(run, "d int, i int, s decimal(38,0), n long").groupBy("d", "i").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    sums: dict[int, dict[int, int]] = {}
    n: dict[int, int] = {}
    for d, i, s, count in added.collect():  # as many rows as there are dimensions
        sums.setdefault(d, {})[i] = int(s)
        n[d] = count
    return {d: tuple(of_d[i] for i in range(d)) for d, of_d in sums.items()}, n


def fit(distinct: DataFrame, components: int = COMPONENTS, by_count: bool = False) -> dict[int, Fit]:
    """A fit per length; `distinct` holds d, x and n_rows once per distinct vector."""
    weight = F.col("n_rows") if by_count else F.lit(1).cast("long")
    listed = distinct.filter("d > 0").select("d", "x", weight.alias("weight"))
    sums, n = exact_sums(listed)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, np.ndarray] = {}
        for d, batch in _by_length(batches):
            off = (centred(_matrix(batch, 1), n[d], sums[d]) / n[d]).astype(np.float64)
            out[d] = out.get(d, 0.0) + (off * np.asarray(batch.column(2))[:, None]).T @ off
        yield from _triangle(out)

    fits = {}
    for d, product in _sum_cells(listed, products).items():
        values, vectors = np.linalg.eigh(product / n[d])
        order = [i for i in np.argsort(-values, kind="stable")[:components] if values[i] > LEAST_SHARE * values.max()]
        fits[d] = Fit(n[d], sums[d], np.ascontiguousarray(vectors[:, order]), values[order], float(np.trace(product) / n[d]))
    return fits


def whitened(distinct: DataFrame, fits: dict[int, Fit]) -> DataFrame:
    """(d, x, weight, deviation, white): each distinct vector projected once; `white` is empty where a fit has no component."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d, batch in _by_length(batches):
            f = fits.get(d)
            if f is None:
                continue
            off = centred(_matrix(batch, 1), f.n, f.sums)
            white = (off / f.n).astype(np.float64) @ (f.components / np.sqrt(f.values))
            ends = pa.array(np.arange(batch.num_rows + 1) * white.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(squared(off), pa.int64()), pa.ListArray.from_arrays(ends, pa.array(white.ravel()))],
                ["d", "x", "weight", "deviation", "white"])

    return distinct.mapInArrow(run, "d int, x array<long>, weight long, deviation long, white array<double>")


def identity_errors(white: DataFrame, fits: dict[int, Fit]) -> dict[int, float]:
    """Per length, the largest entry of the whitened vectors' covariance minus the identity, from a pass over them."""
    live = {d: f for d, f in fits.items() if len(f.values)}

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, np.ndarray] = {}
        for d, batch in _by_length(batches):
            if d in live:
                ones = np.c_[_matrix(batch, 1), np.ones(batch.num_rows)]  # the last row and column sum up the vectors themselves
                out[d] = out.get(d, 0.0) + (ones * np.asarray(batch.column(2))[:, None]).T @ ones
        yield from _triangle(out)

    errors = {}
    for d, m in _sum_cells(white.select("d", "white", "weight"), products).items():
        mean = m[-1, :-1] / m[-1, -1]
        errors[d] = float(np.abs(m[:-1, :-1] / m[-1, -1] - np.outer(mean, mean) - np.eye(len(mean))).max())
    return errors


def whiten(rows: DataFrame, components: int = COMPONENTS, by_count: bool = False) -> DataFrame:
    """(vec_id, n, deviation, white, explained, identity_error) of every row of `rows` (vec_id, x) with a component; arrays list the components."""
    spark = rows.sparkSession
    distinct = write_scratch(rows.groupBy("x").agg(F.count("*").alias("n_rows")).select(F.size("x").alias("d"), "x", "n_rows"), "distinct-vectors")
    fits = fit(distinct, components, by_count)
    weight = F.col("n_rows") if by_count else F.lit(1).cast("long")
    white = write_scratch(whitened(distinct.select("d", "x", weight.alias("weight")), fits), "whitened")
    errors = identity_errors(white, fits)
    facts = spark.createDataFrame(  # one row per length of vectors
        [(d, f.n, [float(v) / f.trace for v in f.values], errors[d]) for d, f in fits.items() if d in errors],
        "d int, n long, explained array<double>, identity_error double")
    return (rows.join(white.select("d", "x", "deviation", "white"), "x").join(facts, "d")
            .select("vec_id", "n", "deviation", "white", "explained", "identity_error"))


@query("op11_embedding_whitening")
def embedding_whitening(spark: SparkSession, sf: str) -> DataFrame:
    """Each row's whitened vector, one row per component."""
    found = whiten(whole_rows(table(spark, sf, "embeddings")))
    return (found.select("vec_id", "n", "deviation", "explained", "identity_error", F.posexplode("white").alias("place", "whitened"))
            .select("vec_id", (F.col("place") + 1).cast("int").alias("component"), "n", "deviation", "whitened",
                    F.col("explained")[F.col("place")].alias("explained"), "identity_error"))
