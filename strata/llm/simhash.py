r"""SimHash near-duplicates by multi-index hashing.

A text's fingerprint has a bit set where over half of its shingles' hashes have it. Equal fingerprints collapse to one row first, so
copies never meet as pairs. Two fingerprints within `radius` bits have a segment within radius // SEGMENTS bits (pigeonhole), so
each fingerprint looks up, per 32-bit segment, the segment's own value and every value with up to that many flipped bits; matches
are verified on all 64 bits. A flip is looked up only from the side that lacks the lowest of the differing bits, so a
pair meets once per segment and nothing is kept within a bucket but equal segment values. With 32-bit segments N fingerprints
give about N * 33 look-ups and N * N * 33 / 2^32 chance meetings, below one per look-up up to billions of fingerprints.
Components come from min-label propagation with pointer jumping over the verified links; each round is written to shared storage.

Defined cases: a null or empty text has fingerprint 0 and links like any other; fewer words than a shingle give one shingle of all
words; rows with a null id get a fingerprint and join components but never name one (a component of such rows only has a null
component_id); repeated rows are rows of one component; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strata.llm.base import query, table, texts
from strata.session import write_scratch

WORDS = 3
RADIUS = 3
SEGMENTS = 2
SEED = 42
_BITS = 64 // SEGMENTS


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """Unsigned 64-bit SimHash of a UTF-8 text; bytes.lower() touches A-Z only."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    shingles = (b" ".join(tokens[i:i + words]) for i in range(max(1, len(tokens) - words + 1)))
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):  # bounded memory for very long texts
        octets = hashes[at:at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp): fp holds the fingerprint's bits as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def flip_masks(radius: int, bits: int = _BITS) -> list[int]:
    """All ways to flip up to `radius` of `bits` bits."""
    return [sum(1 << b for b in chosen) for r in range(radius + 1) for chosen in combinations(range(bits), r)]


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b), a < b, each pair of fingerprints within `radius` bits once; `distinct` holds each fingerprint once as fp."""
    masks = F.array(*[F.lit(m).cast("long") for m in flip_masks(radius // SEGMENTS)])

    def segment(fp: Column, s: int) -> Column:
        return F.shiftrightunsigned(fp, s * _BITS).bitwiseAND(F.lit((1 << _BITS) - 1))

    def key(value: Column, s: int) -> Column:  # segments of all kinds share one join
        return value.bitwiseOR(F.lit(s).cast("long") * F.lit(1 << _BITS)) if _BITS < 63 else value

    own = F.explode(F.array(*[key(segment(F.col("fp"), s), s) for s in range(SEGMENTS)]))

    def ball(s: int) -> Column:
        """Values near the segment: only masks whose lowest bit is unset here, as the other side of such a pair holds the set bit."""
        value = segment(F.col("fp"), s)
        free = F.filter(masks, lambda m: value.bitwiseAND(m).bitwiseAND(-m) == 0)
        return F.transform(free, lambda m: key(value.bitwiseXOR(m), s))

    near = F.explode(F.concat(*[ball(s) for s in range(SEGMENTS)]))
    rows = distinct.select(F.col("fp").alias("b"), own.alias("key"))
    probes = distinct.select(F.col("fp").alias("a"), near.alias("key"))
    return (probes.join(rows, "key").filter((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius))
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable over `edges` (a, b), for every node with an edge.

    Each round hooks a node's root under the smallest root next to it and then jumps pointers once, so the number of rounds grows
    with the logarithm of the longest path. Hub nodes are pre-aggregated on the map side.
    """
    both = write_scratch(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "links")
    labels = write_scratch(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"), "labels")
    while True:
        # the smallest label around each node, offered to the node and to the root it points at
        near = (both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("low"))
                .join(labels.withColumnRenamed("node", "a"), "a").select(F.col("a"), F.col("root"), F.least("low", "root").alias("low")))
        offers = near.select(F.col("a").alias("node"), "low").union(near.select(F.col("root").alias("node"), "low"))
        hooked = offers.groupBy("node").agg(F.min("low").alias("root"))
        up = hooked.select(F.col("node").alias("root"), F.col("root").alias("top"))
        jumped = hooked.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
        after = write_scratch(jumped, "labels")
        moved = after.join(labels.withColumnRenamed("root", "before"), "node").filter("root != before").limit(1).count()
        labels = after
        if not moved:
            return labels


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id, links): `links` counts the other fingerprints within `radius`; `docs` holds doc_id and text."""
    each = write_scratch(fingerprints(docs, words), "fingerprints")
    distinct = each.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = write_scratch(links(distinct.select("fp"), radius), "pairs")
    degree = found.select("a").union(found.select("b")).groupBy("a").count()
    rooted = (distinct.join(components(found).withColumnRenamed("node", "fp"), "fp", "left")
              .withColumn("root", F.coalesce("root", "fp")))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = write_scratch(
        rooted.join(least, "root").join(degree.withColumnRenamed("a", "fp"), "fp", "left")
        .select("fp", "component_id", F.coalesce("count", F.lit(0)).alias("links")), "classes")
    return each.join(classes, "fp").select("doc_id", "fp", "component_id", "links")


@query("op4_simhash")
def simhash(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(texts(table(spark, sf, "documents")))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", F.col("links").alias("n_links"))
