r"""Line dedup by range partitions of line hashes.

Each document row yields its distinct long line keys with their positions. Keys are dealt by ranges of (key, document), so a key
that a third of all documents hold spreads over many partitions, and sorted by key, then document, largest first. One pass over
the sorted rows streams: a key's first document keeps its lines, later ones lose them once `least_docs` documents were seen.
At most the first and the last key of a partition may go on in a neighbour; for these the pass leaves a count, the
largest document and at most `least_docs` held-back rows, and a join with the summed counts (two per partition, hence small enough
to broadcast) settles them. The result is one compressed keep bitmap per document row; texts do not travel with the hashes.

Defined cases: a null or empty text is one empty line, which is kept; a row whose id is null keeps all lines and counts for no key;
rows that share an id are one document, told apart by a hash of their text; equal rows share one bitmap; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from strata.llm.base import parts, query, table, texts
from strata.session import write_scratch

LEAST_CHARS = 40
LEAST_DOCS = 5

_LINES = "k1 long, k2 long, doc_id long, row long, positions array<int>"
_DECIDED = "state int, k1 long, k2 long, doc_id long, row long, positions array<int>, n long"
DROP, OPEN, SUMMARY = 0, 1, 2


def line_key(line: bytes, least_chars: int = LEAST_CHARS) -> bytes | None:
    """The stripped line with A-Z lower-cased, or None if it is too short to count."""
    key = line.strip().lower()
    if len(key) < least_chars or (not key.isascii() and len(key.decode("utf-8", "surrogatepass")) < least_chars):
        return None
    return key


def _long_lines(least_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc, row, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                at: dict[bytes, list[int]] = {}
                for i, line in enumerate(text.split(b"\n")):
                    key = line_key(line, least_chars)
                    if key is not None:
                        at.setdefault(hashlib.blake2b(key, digest_size=16).digest(), []).append(i)
                for digest, positions in at.items():
                    for column, value in zip(out, (*struct.unpack("<qq", digest), doc, row, positions)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in out[:4]), pa.array(out[4], pa.list_(pa.int32()))], ["k1", "k2", "doc_id", "row", "positions"])
    return run


class _Key:
    """What the stream knows of the key it is reading."""

    def __init__(self, k1: int, k2: int, first: bool):
        self.k1, self.k2, self.first, self.n, self.top, self.last, self.held = k1, k2, first, 0, None, None, []

    def take(self, doc: int, row: int, positions, least_docs: int, out: list) -> None:
        if doc != self.last:
            self.n, self.last = self.n + 1, doc
            self.top = doc if self.top is None else self.top
        if doc == self.top or self.n < least_docs:
            self.held.append((doc, row, positions))
            return
        out.append((DROP, self.k1, self.k2, doc, row, positions, None))
        if len(self.held) > 1 and self.held[-1][0] != self.top:  # enough documents: what was held goes too, but for the largest document
            out.extend((DROP, self.k1, self.k2, *h, None) for h in self.held if h[0] != self.top)
            self.held = [h for h in self.held if h[0] == self.top]

    def close(self, final: bool, out: list) -> None:
        if self.first or final:  # the key may go on in a neighbouring partition
            out.append((SUMMARY, self.k1, self.k2, self.top, None, None, self.n))
            out.extend((OPEN, self.k1, self.k2, *h, None) for h in self.held)


def _stream(least_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: _Key | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            out: list = []
            k1, k2, doc, row = (np.asarray(batch.column(i)) for i in range(4))
            starts = np.flatnonzero(np.r_[True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])])
            ends = np.r_[starts[1:], len(k1)]
            # A key that begins and ends inside the batch in too few rows cannot reach `least_docs` documents.
            worth = ends - starts >= least_docs
            worth[0] = worth[-1] = True
            for s, e in zip(starts[worth].tolist(), ends[worth].tolist()):
                if key is None or (key.k1, key.k2) != (k1[s], k2[s]):
                    if key is not None:
                        key.close(False, out)
                    key = _Key(int(k1[s]), int(k2[s]), key is None)
                positions = batch.column(4).slice(s, e - s)
                for i in range(s, e):
                    key.take(int(doc[i]), int(row[i]), positions[i - s].as_py(), least_docs, out)
            yield _rows(out)
        if key is not None:
            out = []
            key.close(True, out)
            yield _rows(out)
    return run


def _rows(out: list) -> pa.RecordBatch:
    columns = list(zip(*out)) or [()] * 7
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["state", "k1", "k2", "doc_id", "row", "positions", "n"])


def dropped_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(doc_id, row, positions): lines to drop, several rows per document row possible. `row` is the hash of the text."""
    held = docs.filter("doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("row"), F.col("text").cast("binary").alias("text"))
    lines = write_scratch(held.mapInArrow(_long_lines(least_chars), _LINES), "line-keys")
    dealt = (lines.repartitionByRange(parts(docs.sparkSession), "k1", "k2", "doc_id")
             .sortWithinPartitions("k1", "k2", F.col("doc_id").desc(), "row"))
    decided = write_scratch(dealt.mapInArrow(_stream(least_docs), _DECIDED), "line-decisions")
    total = (decided.filter(F.col("state") == SUMMARY).groupBy("k1", "k2")
             .agg(F.sum("n").alias("docs"), F.max("doc_id").alias("top")).filter(F.col("docs") >= least_docs))
    late = (decided.filter(F.col("state") == OPEN).join(F.broadcast(total), ["k1", "k2"]).filter("doc_id < top"))
    return decided.filter(F.col("state") == DROP).select("doc_id", "row", "positions").union(late.select("doc_id", "row", "positions"))


def pack_bits(n: int, dropped: list[int] | None) -> bytes:
    """Compressed bits, one per line, set where the line stays."""
    keep = np.ones(n, dtype=bool)
    if dropped:
        keep[dropped] = False
    return zlib.compress(np.packbits(keep).tobytes(), 1)


def unpack_bits(bitmap: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), dtype=np.uint8), count=n).astype(bool)


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, dropped = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array([len(x or ()) for x in dropped], pa.int64()),
             pa.array([pack_bits(a, b) for a, b in zip(n, dropped)], pa.binary())],
            ["doc_id", "row", "n_lines", "n_dropped", "keep"])


def keep_bitmaps(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(doc_id, row, n_lines, n_dropped, keep) once per distinct document row; `docs` holds doc_id and text."""
    n_lines = (F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1).cast("long")
    counted = docs.filter("doc_id IS NOT NULL").select(
        "doc_id", F.xxhash64("text").alias("row"), n_lines.alias("n_lines"), F.lit(None).cast("array<int>").alias("positions"))
    dropped = dropped_lines(docs, least_chars, least_docs).select("doc_id", "row", F.lit(None).cast("long").alias("n_lines"), "positions")
    merged = (counted.union(dropped).groupBy("doc_id", "row")
              .agg(F.max("n_lines").alias("n_lines"), F.array_distinct(F.flatten(F.collect_list("positions"))).alias("positions")))
    return merged.mapInArrow(_bitmaps, "doc_id long, row long, n_lines long, n_dropped long, keep binary")


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Each document row beside its bitmap; rows without an id get none."""
    return docs.withColumn("row", F.xxhash64("text")).join(bitmaps, ["doc_id", "row"], "left")


def kept_text(text: str, bitmap: bytes | None, n_dropped: int | None) -> str:
    if not n_dropped:
        return text
    lines = text.split("\n")
    return "\n".join(line for line, keep in zip(lines, unpack_bits(bitmap, len(lines))) if keep)


def kept_texts(found: DataFrame) -> DataFrame:
    """The rows of `with_bitmaps` with every text cut to its kept lines; further columns stay."""
    schema = found.schema
    names = schema.names
    at, bits, gone, total = (names.index(n) for n in ("text", "keep", "n_dropped", "n_lines"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, dropped = batch.column(at).to_pylist(), [n or 0 for n in batch.column(gone).to_pylist()]
            columns = list(batch.columns)
            columns[total] = pa.array([t.count("\n") + 1 for t in text], pa.int64())
            columns[gone] = pa.array(dropped, pa.int64())
            columns[at] = pa.array([kept_text(*x) for x in zip(text, columns[bits].to_pylist(), dropped)], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    return found.mapInArrow(run, schema)


_DUCK = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
each AS (SELECT doc_id, unnest(range(1, len(lines) + 1)) AS i, unnest(lines) AS line FROM d),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM each),
hot AS (SELECT key, max(doc_id) AS top FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT k.*, h.key IS NOT NULL AND k.doc_id < h.top AS gone FROM keyed k LEFT JOIN hot h USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query("op2_line_dedup", _DUCK)
def line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Line counts and the digest of what every document keeps."""
    docs = texts(table(spark, sf, "documents"))
    found = kept_texts(with_bitmaps(docs, keep_bitmaps(docs)))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
