r"""Best-fit packing by patterns.

Documents become token pieces of at most `size` tokens. Only the histogram of piece lengths, at most `size` bins, goes to the driver.
There, patterns of one to three lengths that fill a sequence exactly, plus multiples of one length, are enumerated; non-negative
least squares fits how often each is used, the counts are rounded down, and the pieces left over are packed by
best-fit decreasing, done for whole classes of equal bins at once. The plan has a row per slot of each pattern and its
size depends on `size` alone, so it is broadcast; a piece finds its slot by its length and its rank among pieces
of that length. Ranks come from counts per (length, bucket) and a row number inside a bucket, so a length that a third of all
pieces share is never one task. Offsets follow from the pattern, hence without gaps.

Defined cases: a null or empty text is the end token alone; a null id is packed like any other; repeated rows are packed each; an
empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from strata.llm.base import query, table, texts
from strata.llm.bpe import IdsOnly, definition_of, loaded, tokenizer_path
from strata.session import write_scratch

SIZE = 2048
END_ID = 0
#: Exact patterns tried per longest length, and rounds of the least-squares fit.
PATTERNS_PER_LENGTH = 24
FIT_ROUNDS = 300
#: Pieces a bucket of one length should hold.
BUCKET_PIECES = 20_000

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PLACED = _PIECES + ", sequence_id long, offset long"


def pieces(docs: DataFrame, path: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """Token pieces of every row of doc_id and text, each with the CRC-32 of its little-endian 32-bit ids."""
    shared = docs.sparkSession.sparkContext.broadcast(definition_of(path))
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = loaded(shared.value, IdsOnly)
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc, found in zip(batch.column(0).to_pylist(), coder.encoded(batch.column(1).to_pylist())):
                found.append(end)
                ids = b"".join(found)
                for at in range(0, len(ids), 4 * size):
                    cut = ids[at:at + 4 * size]
                    for column, value in zip(out, (doc, at // (4 * size), at // 4, len(cut) // 4, zlib.crc32(cut))):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, _PIECES)


# -- the plan, made from the histogram ------------------------------------------------------------------------------


def exact_patterns(lengths: np.ndarray, counts: np.ndarray, size: int, per_length: int = PATTERNS_PER_LENGTH) -> list[tuple[int, ...]]:
    """Patterns of two to four pieces, longest first, that add up to `size`; of many, those of common lengths."""
    weight = np.zeros(size + 1)
    weight[lengths] = counts
    there = weight > 0
    found: set[tuple[int, ...]] = set()
    for a in lengths[::-1].tolist():
        rest = size - a
        if rest <= 0:
            continue
        if rest <= a and there[rest]:
            found.add((a, rest))
        # the second of three runs over lengths whose complement exists
        b = lengths[(lengths <= min(a, rest - 1)) & (2 * lengths >= rest)]
        b = b[there[rest - b]]
        if len(b) > per_length:
            b = b[np.argsort(-np.minimum(weight[b], weight[rest - b]), kind="stable")[:per_length]]
        found.update((a, x, rest - x) for x in b.tolist())
        for k in (2, 3):  # several of the same length and one to fill
            if k * a < size and size - k * a <= a and there[size - k * a]:
                found.add((*[a] * k, size - k * a))
    return sorted(found, reverse=True)


def fit_counts(patterns: list[tuple[int, ...]], counts: np.ndarray, rounds: int = FIT_ROUNDS) -> np.ndarray:
    """Non-negative least squares: how often each pattern is used so that the used pieces come close to `counts` by length.

    Accelerated projected gradient on the sparse pattern matrix, scaled by the histogram's largest bin.
    """
    if not patterns:
        return np.zeros(0)
    column = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
    row = np.array([x for p in patterns for x in p])
    scale = float(counts.max()) or 1.0
    target = counts / scale
    # the matrix norm is at most the largest row sum times the largest column sum
    step = 1.0 / (np.bincount(row).max() * max(map(len, patterns)))
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(rounds):
        short = np.bincount(row, weights=y[column], minlength=len(counts)) - target
        new = np.maximum(0.0, y - step * np.bincount(column, weights=short[row], minlength=len(patterns)))
        later = (1 + (1 + 4 * t * t) ** 0.5) / 2
        x, y, t = new, new + (t - 1) / later * (new - x), later
    return x * scale


def best_fit_decreasing(left: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing of `left[length]` pieces: (pattern, number of sequences), for classes of equal bins at once."""
    bins: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)  # free space -> pattern -> number
    for length in np.flatnonzero(left)[::-1].tolist():
        todo = int(left[length])
        for free in sorted(f for f in list(bins) if f >= length):
            each = free // length
            for pattern in list(bins[free]):
                if not todo:
                    break
                n = bins[free].pop(pattern)
                full = min(n, todo // each)
                todo -= full * each
                part = todo if full < n else 0
                for number, k in ((full, each), (1 if part else 0, part), (n - full - (1 if part else 0), 0)):
                    if number:
                        longer = pattern + (length,) * k
                        bins[free - k * length][longer] = bins[free - k * length].get(longer, 0) + number
                todo -= part
            if not todo:
                break
        each = size // length
        for number, k in ((todo // each, each), (1 if todo % each else 0, todo % each)):
            if number:
                new = (length,) * k
                bins[size - k * length][new] = bins[size - k * length].get(new, 0) + number
    return [(p, n) for group in bins.values() for p, n in group.items()]


def make_plan(histogram: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, number of sequences) using every piece of the histogram exactly once."""
    counts = np.zeros(size + 1, dtype=np.int64)
    for length, n in histogram.items():
        counts[length] = n
    plan = [((size,), int(counts[size]))] if counts[size] else []
    left = counts.copy()
    left[size] = 0
    patterns = exact_patterns(np.flatnonzero(left), left[left > 0], size)
    fitted = fit_counts(patterns, left.astype(float))
    for i in np.argsort(-fitted, kind="stable").tolist():
        uses = np.unique(patterns[i], return_counts=True)
        n = min(int(fitted[i]), *(int(left[x] // k) for x, k in zip(*uses)))
        if n > 0:
            for x, k in zip(*uses):
                left[x] -= n * k
            plan.append((patterns[i], n))
    return plan + best_fit_decreasing(left, size)


def slots(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """length -> rows (first rank, first sequence, offset) by rank: the piece of rank r goes to sequence first + (r - rank)."""
    rows: dict[int, list] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    sequence = 0
    for pattern, n in plan:
        offset = 0
        for length in pattern:
            rows[length].append((used[length], sequence, offset))
            used[length] += n
            offset += length
        sequence += n
    return {length: np.array(r, dtype=np.int64) for length, r in rows.items()}


def pack(found: DataFrame, size: int = SIZE) -> DataFrame:
    """`found` (the rows of `pieces`, read from storage) with the sequence and the offset of each piece."""
    spark = found.sparkSession
    histogram = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `size` rows
    buckets = max(64, sum(histogram.values()) // BUCKET_PIECES)
    order = ["doc_id", "piece", "start", "ids_crc32"]
    dealt = found.withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    before = (dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
              .select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before")))
    local = F.row_number().over(Window.partitionBy("length", "bucket").orderBy(*order)) - 1
    ranked = dealt.withColumn("local", local).join(before, ["length", "bucket"])
    ranked = ranked.select(*found.columns, (F.col("local") + F.col("before")).alias("rank"))
    shared = spark.sparkContext.broadcast(slots(make_plan(histogram, size)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_of = shared.value
        for batch in batches:
            length, rank = np.asarray(batch.column(3)), np.asarray(batch.column(5))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length).tolist():
                mine = np.flatnonzero(length == n)
                rows = table_of[n]
                i = np.searchsorted(rows[:, 0], rank[mine], side="right") - 1
                sequence[mine], offset[mine] = rows[i, 1] + rank[mine] - rows[i, 0], rows[i, 2]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, _PLACED)


def pack_documents(docs: DataFrame, path: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    return pack(write_scratch(pieces(docs, path, size, end_id), "pieces"), size)


@query("op10_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return pack_documents(texts(table(spark, sf, "documents")), tokenizer_path())
