r"""Substring dedup by Rabin-Karp hashes of every window of words.

Each word has two 64-bit hashes; each window of `size` words a rolling polynomial of either, modulo 2^64. The first picks the window's bucket,
the second is its fingerprint there, so two windows of different words pass as equal with a probability of about 10^-13 at any size of
the corpus: a bucket holds a bounded amount of text. Blocks of windows are combined on the map side: a fingerprint leaves a block once, with its
smallest document, and the block's other documents are already known to lose it. Each bucket then merges its blocks and counts a fingerprint's
documents the same way, so a passage that a third of all documents hold costs a bucket one entry per block. What comes back to a document are
the fingerprints it loses; it finds their windows again and merges them into maximal intervals of words to remove.

Fingerprints travel as bytes in document order, 8 bytes a window and about 1 more for whose they are; texts are shuffled once, for the last step.

Defined cases: words are runs between blanks; a null or empty text has none; fewer words than a window lose nothing; rows without an id lose
nothing and count for nothing; rows that share an id are one document, so what only they share stays in all of them; equal rows are each
returned; an empty table gives an empty result; other columns are not read. Texts are split in pieces, so one of any length takes bounded
memory but for itself and its hashes.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from strata.llm.base import parts, query, table, texts

SIZE = 13
#: Windows that a block gathers before it is combined and sent; text that a bucket is made for.
BLOCK_WINDOWS = 1 << 21
BUCKET_BYTES = 16 << 20
#: Text that is split at once, and windows whose hashes are rolled at once.
PIECE_BYTES = 1 << 20
ROLL = 1 << 15

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd, so they have inverses modulo 2^64
_BLANK = re.compile(rb"[ \t-\r]")


def _pieces(text: bytes, size: int = PIECE_BYTES) -> Iterator[bytes]:
    """The text cut at blanks into pieces of about `size` bytes."""
    at = 0
    while len(text) - at > size:
        blank = _BLANK.search(text, at + size)
        end = blank.start() if blank else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def word_hashes(text: bytes) -> Iterator[np.ndarray]:
    """Two hashes of each word of a UTF-8 text, in arrays of two rows, piece by piece."""
    for piece in _pieces(text):
        words = piece.split()  # without arguments bytes.split() cuts at the six blanks of the contract
        if words:
            yield np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), dtype=">u8").astype(np.uint64).reshape(-1, 2).T


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP = [_powers(b, ROLL + 512) for b in _BASES]
_DOWN = [_powers(pow(b, -1, 1 << 64), ROLL + 512) for b in _BASES]


def rolled(words: np.ndarray, which: int, size: int = SIZE) -> np.ndarray:
    """Hash of every window: the sum of word * base^(place from the window's end), from differences of prefix sums."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    if size > 512:
        raise ValueError("windows of at most 512 words")
    out = np.empty(n, np.uint64)
    for at in range(0, n, ROLL):
        part = words[at:at + ROLL + size - 1]
        m = len(part) - size + 1
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * _DOWN[which][:len(part)], out=sums[1:])
        out[at:at + m] = (sums[size:] - sums[:m]) * _UP[which][size - 1:size - 1 + m]
    return out


def windows(text: bytes, size: int = SIZE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket hash, fingerprint) of the windows of a text, in order, in pieces."""
    rest = np.empty((2, 0), np.uint64)
    for words in word_hashes(text):
        words = np.concatenate([rest, words], axis=1)
        if words.shape[1] >= size:
            yield rolled(words[0], 0, size), rolled(words[1], 1, size)
        rest = words[:, max(0, words.shape[1] - size + 1):]


def settle(prints: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of one holder of each fingerprint in its smallest document, and of one in each larger document."""
    order = np.lexsort((docs, prints))
    p, d = prints[order], docs[order]
    first = np.r_[True, p[1:] != p[:-1]][:len(p)]
    again = np.r_[False, (p[1:] == p[:-1]) & (d[1:] == d[:-1])][:len(p)]
    return order[first], order[~first & ~again]


def _owners(docs: np.ndarray) -> bytes:
    """Documents of a run of fingerprints in document order, as steps and counts."""
    at = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]][:len(docs)])
    return zlib.compress(np.diff(docs[at], prepend=np.int64(0)).tobytes() + np.diff(at, append=len(docs)).tobytes(), 1)


def _owned(packed: bytes) -> np.ndarray:
    steps, counts = np.frombuffer(zlib.decompress(packed), dtype=np.int64).reshape(2, -1)
    return np.repeat(np.cumsum(steps), counts)


_BLOCKS = "bucket int, owners binary, prints binary, losers binary, lost binary"


def _block_rows(buckets: int, which: list, prints: list, docs: list, counts: list) -> pa.RecordBatch:
    """One row per bucket: what the block holds once, and what it already knows to be lost."""
    bucket = ((np.concatenate(which) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    prints, docs = np.concatenate(prints), np.repeat(np.array(docs, np.int64), counts)
    sides = []
    for chosen in settle(prints, docs):
        chosen = chosen[np.lexsort((docs[chosen], bucket[chosen]))]
        cuts = np.searchsorted(bucket[chosen], np.arange(buckets + 1))
        sides.append((chosen, cuts))
    columns: tuple[list, ...] = ([], [], [], [], [])
    for b in np.flatnonzero(np.diff(sides[0][1])).tolist():  # a bucket with losers has a holder
        columns[0].append(b)
        for i, (chosen, cuts) in enumerate(sides):
            part = chosen[cuts[b]:cuts[b + 1]]
            columns[1 + 2 * i].append(_owners(docs[part]) if len(part) else None)
            columns[2 + 2 * i].append(prints[part].tobytes() if len(part) else None)
    kinds = [pa.int32(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["bucket", "owners", "prints", "losers", "lost"])


def _blocks(buckets: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, ...] = ([], [], [], [])
        n = 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for which, prints in windows(text.as_py(), size):
                    for column, value in zip(held, (which, prints, doc, len(prints))):
                        column.append(value)
                    n += len(prints)
                    if n >= BLOCK_WINDOWS:
                        yield _block_rows(buckets, *held)
                        held, n = ([], [], [], []), 0
        if n:
            yield _block_rows(buckets, *held)
    return run


def _claims(prints: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
    """One row per document and fingerprint that it loses, in document order, so that a task's rows of a document lie together."""
    order = np.argsort(docs, kind="stable")
    return pa.RecordBatch.from_arrays([pa.array(docs[order], pa.int64()), pa.array(prints[order].view(np.int64))], ["doc_id", "lost"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket: each bucket's fingerprints are merged block by block, and what loses is passed on at once."""
    now, n = None, 0
    held: tuple[list, list] = ([], [])

    def settled():
        prints, docs = map(np.concatenate, held)
        kept, lost = settle(prints, docs)
        return (prints[kept], docs[kept]), _claims(prints[lost], docs[lost])

    for batch in batches:
        for bucket, owners, prints, losers, lost in zip(*(batch.column(i) for i in range(5))):
            if bucket.as_py() != now:
                if held[0]:
                    yield settled()[1]
                now, n, held = bucket.as_py(), 0, ([], [])
            if lost.is_valid:
                yield _claims(np.frombuffer(lost.as_py(), dtype=np.uint64), _owned(losers.as_py()))
            held[0].append(np.frombuffer(prints.as_py(), dtype=np.uint64))
            held[1].append(_owned(owners.as_py()))
            n += len(held[0][-1])
            if n >= 2 * BLOCK_WINDOWS and n >= 2 * len(held[0][0]):  # what was merged before comes first
                (kept, docs), out = settled()
                yield out
                held, n = ([kept], [docs]), len(kept)
    if held[0]:
        yield settled()[1]


def lost_windows(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, lost): fingerprints, as signed longs, of windows that a smaller document holds as well."""
    named = docs.filter("doc_id IS NOT NULL").select("doc_id", F.col("text").cast("binary").alias("text"))
    amount = named.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(parts(docs.sparkSession), -(-amount // BUCKET_BYTES))
    blocks = named.mapInArrow(_blocks(buckets, size), _BLOCKS)
    return (blocks.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket")
            .mapInArrow(_merge, "doc_id long, lost long"))


def intervals(text: bytes, lost: np.ndarray, size: int = SIZE) -> list[tuple[int, int]]:
    """Maximal [start, end) runs of words covered by windows whose fingerprints are lost."""
    if not len(lost):
        return []
    gone = np.unique(lost.view(np.uint64))
    hits, at = [], 0
    for _, prints in windows(text, size):
        place = np.minimum(np.searchsorted(gone, prints), len(gone) - 1)
        hits.append(np.flatnonzero(gone[place] == prints) + at)
        at += len(prints)
    hit = np.concatenate(hits) if hits else np.empty(0, np.int64)
    if not len(hit):
        return []
    new = np.flatnonzero(np.r_[True, hit[1:] > hit[:-1] + size])  # windows that touch or overlap merge
    starts, ends = hit[new], hit[np.r_[new[1:] - 1, len(hit) - 1]] + size
    return list(zip(starts.tolist(), ends.tolist()))


def without(text: bytes, cuts: list[tuple[int, int]]) -> tuple[int, bytes]:
    """Number of words, and the words outside the intervals joined by single spaces."""
    kept, at, i = [], 0, 0
    for piece in _pieces(text):
        words = piece.split()
        start, stop = at, at + len(words)
        out = start
        while i < len(cuts) and cuts[i][0] < stop:
            kept.extend(words[out - start:max(cuts[i][0] - start, out - start)])
            out = max(out, min(cuts[i][1], stop))
            if cuts[i][1] > stop:
                break
            i += 1
        kept.extend(words[out - start:])
        at = stop
    return at, b" ".join(kept)


_CUT = "doc_id long, n_words long, removed array<struct<start:bigint,end:bigint>>, text string"


def remove_repeats(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, n_words, removed, text): the intervals of words that go and the words that stay; `docs` holds doc_id and text."""
    claims = lost_windows(docs, size).groupBy("doc_id").agg(F.collect_list("lost").alias("lost"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            out: tuple[list, ...] = ([], [], [])
            for text, lost in zip(batch.column(1), batch.column(2)):
                text = text.as_py()
                cuts = intervals(text, np.asarray(lost.values, dtype=np.int64) if lost.is_valid else np.empty(0, np.int64), size)
                n, left = without(text, cuts)
                for column, value in zip(out, (n, [{"start": s, "end": e} for s, e in cuts], left)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], span), pa.array(out[2], pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "removed", "text"])

    found = docs.join(claims, "doc_id", "left").select("doc_id", F.col("text").cast("binary").alias("text"), "lost")
    return found.mapInArrow(run, _CUT)


_DUCK = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
n AS (SELECT doc_id, w, len(w) AS n FROM d),
starts AS (SELECT doc_id, w, unnest(range(1, n - 11)) AS i FROM n WHERE n >= 13),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM starts),
low AS (SELECT g, min(doc_id) AS low FROM win GROUP BY g HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT DISTINCT win.doc_id, i FROM win JOIN low USING (g) WHERE win.doc_id > low.low),
gone AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 13)))) AS spots FROM hit GROUP BY doc_id),
words AS (SELECT n.doc_id, unnest(w) AS word, unnest(range(1, n + 1)) AS i FROM n),
cut AS (SELECT doc_id, unnest(spots) AS i FROM gone),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN cut USING (doc_id, i) GROUP BY doc_id)
SELECT n.doc_id, n.n AS n_words, coalesce(len(gone.spots), 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM n LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


@query("op13_substring_dedup", _DUCK)
def substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Words, removed words and the digest of what every document keeps."""
    found = remove_repeats(texts(table(spark, sf, "documents")))
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return found.select("doc_id", "n_words", n_removed.alias("n_removed"), F.sha2("text", 256).alias("kept_sha256"))
