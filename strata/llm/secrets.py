r"""Secret scans over a blob ledger.

Every text is a blob, named by the SHA-256 of its bytes. A ledger in shared storage holds the findings of each
(blob, rule version) ever scanned. A run drops repeated blobs, removes pairs the ledger knows, scans the rest, appends
them, and joins findings back to every path, so a text that is copied, moved or seen in an earlier version is
scanned once per rule version. Repeated blobs are dropped on the map side before the shuffle, so a group of copies is
one row per task; the join back is a plain equality join whose hot blobs adaptive execution splits.

Defined cases: a null or empty text has no finding; repeated rows each get the findings of their blob; a null id is kept as
it is; an empty table gives an empty result and leaves the ledger as it was; columns other than the id and the text are not
read. One writer per ledger is assumed; a failed append leaves the ledger unchanged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from strata.llm.base import SPANS_TYPE, query, sha256, span_digest, table, texts
from strata.session import scratch_dir

BASE_KINDS = ("assign", "access", "hex")

# The patterns of the contract, then further kinds. `needs` are strings of which a match must hold one; the
# runs of `access` and `hex` are maximal, so their least lengths can stand in the pattern.
ASSIGN = r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
PATTERNS = (
    ("assign", ASSIGN, (":", "=")),
    ("access", r"AKIA[A-Z0-9]{14,}", ("AKIA",)),
    ("hex", r"[0-9a-f]{16,}", ()),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", ("-----BEGIN ",)),
    ("code_host", r"gh[opsu]_[A-Za-z0-9]{36,}", ("gho_", "ghp_", "ghs_", "ghu_")),
    # only where a run begins, so that each run is read a bounded number of times
    ("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]++", ("eyJ",)),
)
RULES = tuple((kind, re.compile(pattern), needs) for kind, pattern, needs in PATTERNS)
RULE_VERSION = sha256(repr((PATTERNS, ASSIGN_LEAST)))[:16]

LEDGER_SCHEMA = f"blob_id string, rule_version string, findings {SPANS_TYPE}"


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then by the order of the kinds; offsets are code points."""
    found = []
    for rank, (kind, pattern, needs) in enumerate(RULES):
        if needs and not any(n in text for n in needs):
            continue
        for m in pattern.finditer(text):
            if kind != "assign" or m.end(1) - m.start(1) >= ASSIGN_LEAST:
                found.append((m.start(), rank, kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        found = [[dict(zip(("kind", "start", "end"), f)) for f in find_secrets(t)] for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["blob_id", "findings"])


class BlobLedger:
    """Findings by (blob, rule version), kept as Parquet in a folder that every executor can reach."""

    def __init__(self, spark: SparkSession, path: str, rule_version: str = RULE_VERSION):
        self.spark, self.path, self.rule_version = spark, path, rule_version
        spark.createDataFrame([], LEDGER_SCHEMA).write.mode("append").parquet(path)

    def known(self) -> DataFrame:
        return self.spark.read.schema(LEDGER_SCHEMA).parquet(self.path).filter(F.col("rule_version") == self.rule_version)

    def scan(self, versions: DataFrame, text_col: str = "text") -> None:
        """Scan the blobs of `versions` that were never scanned under these rules, and append their findings."""
        text = F.coalesce(F.col(text_col), F.lit(""))
        blobs = versions.select(F.sha2(text, 256).alias("blob_id"), text.alias("text")).dropDuplicates(["blob_id"])
        unseen = blobs.join(self.known().select("blob_id"), "blob_id", "left_anti").select("blob_id", "text")
        (unseen.mapInArrow(_scan, f"blob_id string, findings {SPANS_TYPE}")
         .select("blob_id", F.lit(self.rule_version).alias("rule_version"), "findings").write.mode("append").parquet(self.path))

    def findings(self, versions: DataFrame, text_col: str = "text") -> DataFrame:
        """Every row of `versions` without its text, with the blob and its findings (null: never scanned)."""
        blob = versions.withColumn("blob_id", F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).drop(text_col)
        return blob.join(self.known().select("blob_id", "findings"), "blob_id", "left")


_DUCK = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
p(rank, kind, pattern) AS (VALUES
  (0, 'assign', '(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+'),
  (1, 'access', 'AKIA[A-Z0-9]+'), (2, 'hex', '[0-9a-f]+'), (3, 'private_key', '-----BEGIN [A-Z ]*PRIVATE KEY-----'),
  (4, 'code_host', 'gh[opsu]_[A-Za-z0-9]{36,}'), (5, 'jwt', '\x{10FFFD}{3}[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+')),
-- an eyJ that begins a run is marked by three characters of its own
marked AS (SELECT doc_id, text, regexp_replace(text, '(^|[^A-Za-z0-9_-])eyJ', '\1' || repeat(chr(1114109), 3), 'g') AS begun FROM d),
searched AS (SELECT doc_id, rank, kind, pattern, CASE kind WHEN 'jwt' THEN begun ELSE text END AS text FROM marked, p),
pieces AS (
  SELECT doc_id, rank, kind, regexp_extract_all(text, pattern) AS hits, string_split_regex(text, pattern) AS gaps FROM searched),
each AS (SELECT doc_id, rank, kind, unnest(range(1, len(hits) + 1)) AS i, unnest(hits) AS hit, unnest(gaps[1:len(hits)]) AS gap FROM pieces),
placed AS (
  SELECT doc_id, rank, kind, hit, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, rank ORDER BY i) - length(hit) AS s FROM each),
good AS (
  SELECT doc_id, rank, kind, CAST(s AS BIGINT) AS s, CAST(s + length(hit) AS BIGINT) AS e FROM placed
  WHERE CASE kind WHEN 'assign' THEN length(regexp_replace(hit, '^[A-Za-z_]+["'']?\x20*[:=]\x20*["'']?', '')) >= 12
                  WHEN 'access' THEN length(hit) >= 18 WHEN 'hex' THEN length(hit) >= 16 ELSE true END)
SELECT d.doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
  count(*) FILTER (WHERE kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(concat(kind, ':', s, ':', e), ',' ORDER BY s, rank) FILTER (WHERE rank < 3), '')) AS base_sha256,
  coalesce(string_agg(concat(kind, ':', s, ':', e), ',' ORDER BY s, rank) FILTER (WHERE kind IS NOT NULL), '') AS spans
FROM d LEFT JOIN good g ON g.doc_id = d.doc_id GROUP BY d.doc_id
"""


@query("op1_secret_scan", _DUCK)
def secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Secrets of every document, found through a fresh ledger in the shared scratch folder."""
    docs = texts(table(spark, sf, "documents"))
    ledger = BlobLedger(spark, scratch_dir(spark, "blob-ledger"))
    ledger.scan(docs)
    return ledger.findings(docs).select("doc_id", *span_digest(F.col("findings"), BASE_KINDS))
