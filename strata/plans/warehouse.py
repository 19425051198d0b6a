"""Curated tables: Parquet parts under one root, published by a commit log.

A commit names the folders a table consists of. Data is always written to new folders first; readers see it only once the commit exists, so a
failed job leaves the table as it was. Of two writers of one table exactly one is published and the other is told; writers of different
tables do not disturb each other. Superseded folders stay for readers that began earlier and go after `retain`.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, replace
from datetime import timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from strata.functions.names import check_key, quote, require, split_table
from strata.operators.windows import last_per_key
from strata.plans.commits import CommitLog, LogState, Published, WriteConflict, dropped, older
from strata.session import use_utc

LINEAGE = {"_source_file": T.StringType(), "_fetched_at": T.TimestampType()}
PART = "_part"
_EMPTY_NAME = "__HIVE_DEFAULT_PARTITION__"  # how Spark names the folder of an empty value

#: Tables of the warehouse itself, such as the manifest of raw files it has taken in.
OWN = "_lake."
#: What an upsert did with a row; stored beside the rows it wrote, so that its report is counted from what is there.
CHANGE = "_change"
NEW, UPDATED, KEPT, STALE = "new", "updated", "kept", "stale"


@dataclass(frozen=True)
class UpsertReport:
    new: int
    updated: int
    skipped_no_key: int
    duplicates_in_file: int
    total: int
    stale: int = 0  # rows older than the copy the table already holds

    def as_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(vars(self).values())], ", ".join(f"{c} bigint" for c in vars(self)))


@dataclass(frozen=True)
class Load:
    """One table's part of an upsert."""

    name: str
    incoming: DataFrame
    key: tuple[str, ...]
    order: tuple = ("_row_pos",)
    source_file: str | None = None
    part_by: str | None = None
    parts: int | None = None


#: Rows a hashed part should hold; a table whose parts hold GROWTH times as many is split anew.
ROWS_PER_PART = 2_000_000
GROWTH = 4


def outgrown(layout: str, rows: int) -> bool:
    """True if a table of so many rows has too few hashed parts."""
    return layout.startswith("hash:") and rows > GROWTH * ROWS_PER_PART * int(layout.split(":")[1])


def assert_same_columns(table: DataFrame, incoming: DataFrame, name: str) -> None:
    """Loud schema drift: the column sets must agree, lineage columns aside."""
    a, b = set(table.columns) - set(LINEAGE), set(incoming.columns) - set(LINEAGE)
    require(a == b, f"columns differ from {name}: table has {sorted(a)}, incoming has {sorted(b)}; rebuild the table")


def with_lineage(df: DataFrame, wanted) -> DataFrame:
    return df.withColumns({c: F.lit(None).cast(LINEAGE[c]) for c in wanted if c not in df.columns})


def hash_layout(rows: int, parts: int | None = None) -> str:
    """Parts by key hash: a given number, else about two million rows each, eight at least."""
    return f"hash:{parts or max(8, rows // ROWS_PER_PART)}"


def part_of(layout: str, key: tuple[str, ...], schema: T.StructType) -> Column:
    """Stored part of a row, a function of its key, so a key never moves between parts."""
    if layout.startswith("hash:"):
        floats = {f.name for f in schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
        # Adding zero gives -0.0 and 0.0, which are equal keys, one hash.
        columns = [F.col(k) + F.lit(0.0) if k in floats else F.col(k) for k in key]
        value = F.pmod(F.xxhash64(*columns), F.lit(int(layout.split(":")[1]))).cast("string")
    else:
        value = F.regexp_replace(F.expr(layout).cast("string"), "[^A-Za-z0-9.-]", "_")
    return F.coalesce(value, F.lit("none"))


def merge(old: DataFrame, batch: DataFrame, key, unique: bool = True) -> DataFrame:
    """Both tables' rows with the batch's copy of each key, and in CHANGE what became of each row: one full outer join.

    `batch` holds each key once; so does `old` if `unique`, else its further rows of a key the batch brings are left out. Where both
    have `_fetched_at`, an older fetch does not replace a newer one, and the row that stays counts as stale.
    """
    columns = batch.columns
    left = old.select(F.struct(*columns).alias("old"), *[F.col(k).alias(f"_old_{i}") for i, k in enumerate(key)])
    if not unique:
        left = left.withColumn("first", F.row_number().over(Window.partitionBy(*[f"_old_{i}" for i in range(len(key))]).orderBy("old")) == 1)
    right = batch.select(F.struct(*columns).alias("new"), *[F.col(k).alias(f"_new_{i}") for i, k in enumerate(key)])
    same = reduce(lambda a, b: a & b, [F.col(f"_old_{i}") == F.col(f"_new_{i}") for i in range(len(key))])
    has_old, has_new = F.col("old").isNotNull(), F.col("new").isNotNull()
    late = (F.col("old._fetched_at") > F.col("new._fetched_at")) if "_fetched_at" in columns else F.lit(False)
    change = (F.when(~has_old, NEW).when(~has_new, KEPT).when(F.coalesce(late, F.lit(False)), STALE).otherwise(UPDATED))
    joined = left.join(right, same, "full_outer")
    if not unique:
        joined = joined.filter(~has_old | ~has_new | F.col("first"))
    chosen = F.when(F.col(CHANGE).isin(NEW, UPDATED), F.col("new")).otherwise(F.col("old"))
    return joined.withColumn(CHANGE, change).withColumn("row", chosen).select("row.*", CHANGE)


class Warehouse:
    """Tables under `root`, which must be storage that every executor reaches."""

    def __init__(self, spark: SparkSession, root: str, catalog: bool = True, retain: timedelta = timedelta(days=7), checkpoint_every: int = 50):
        self.spark = use_utc(spark)
        self.root = root.rstrip("/")
        self.catalog = catalog
        self.retain = retain
        self.log = CommitLog(self.spark, f"{self.root}/publications", checkpoint_every)

    # -- reading -------------------------------------------------------------------------------------------------

    def state(self, name: str) -> Published | None:
        """What is published now; None for a table that never existed or was dropped."""
        found = self.log.state().tables.get(name)
        return found if found and found.folders else None

    def tables(self) -> list[str]:
        """Published tables; the warehouse's own bookkeeping is not among them."""
        return sorted(n for n, s in self.log.state().tables.items() if s.folders and not n.startswith(OWN))

    def exists(self, name: str) -> bool:
        return self.state(name) is not None

    def _home(self, name: str) -> str:
        schema, table = split_table(name)
        return f"{self.root}/tables/{schema}/{table}"

    def _read(self, state: Published, folders=None) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(state.columns))
        return self.spark.read.schema(schema).parquet(*[f"{self._home(state.name)}/{f}" for f in folders or state.folders])

    def parts_of(self, name: str, folders: list[str]) -> DataFrame:
        """The rows of some of a table's stored folders, which may be none."""
        state = self.state(name)
        return self._read(state, folders) if folders else self._read(state).limit(0)

    def table(self, name: str) -> DataFrame:
        state = self.state(name)
        if state is None:
            raise LookupError(f"nothing is published as {name} in {self.root}")
        return self._read(state)

    # -- publishing ----------------------------------------------------------------------------------------------

    def _write(self, df: DataFrame, name: str, version: int, key, layout: str) -> list[str]:
        """Write one version beside the live one and return its folders; two writers of one version have folders of their own."""
        home, at = self._home(name), f"v={version}-{uuid.uuid4().hex[:12]}"
        if not layout:
            df.write.parquet(f"{home}/{at}/all")
            return [f"{at}/all"]
        # Rebalancing by part gives every part few files and splits a part that is much larger than the rest.
        parted = df.withColumn(PART, part_of(layout, tuple(key), df.schema)).hint("rebalance", PART)
        parted.write.partitionBy(PART).parquet(f"{home}/{at}")
        folders = [f"{at}/{part}" for part in self._parts(f"{home}/{at}")]
        if not folders:
            df.limit(0).write.parquet(f"{home}/{at}/empty")
            folders = [f"{at}/empty"]
        return folders

    def _parts(self, path: str) -> list[str]:
        return sorted(name for name, _ in self.log.files.names(path) if name.startswith(f"{PART}="))

    def _published(self, df: DataFrame, name: str, version: int, folders, key=(), layout: str = "", n_rows: int | None = None) -> Published:
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema])
        made = Published(name, version, tuple(folders), tuple(key), layout, n_rows or 0, schema.json())
        return made if n_rows is not None else replace(made, n_rows=self._read(made).count())

    def _commit(self, base: LogState, states: list[Published], alone: bool = False) -> None:
        """Publish: one commit, hence all or nothing, also for several tables at once. The loser of a conflict removes what it wrote."""
        try:
            now = self.log.commit(base, states, alone=alone)
        except WriteConflict:
            for s in states:
                before = base.tables[s.name].folders if s.name in base.tables else ()
                for version in {f.split("/")[0] for f in s.folders if f not in before}:
                    self.log.files.remove(f"{self._home(s.name)}/{version}")
            raise
        if self.catalog:
            for s in states:
                if not s.name.startswith(OWN):
                    self._register(s)
        if now.number % self.log.every == 0:
            self.clean_up()

    def clean_up(self, age: timedelta | None = None) -> int:
        """Remove folders superseded longer ago than `age` (by default what the warehouse retains), and leavings of failed loads as old."""
        age = self.retain if age is None else age
        state, files = self.log.state(), self.log.files
        gone = older(state, age)
        for name, folder in gone:
            files.remove(f"{self._home(name)}/{folder}")
        if gone:
            state = self.log.commit(state, removed=gone)
        used = {(t.name, f.split("/")[0]) for t in state.tables.values() for f in t.folders} | {(n, f.split("/")[0]) for n, f, _ in state.retired}
        for name in state.tables:
            for version, changed in files.names(self._home(name)):
                if version.startswith(("v=", "batch-")) and (name, version) not in used and changed <= time.time() - age.total_seconds():
                    files.remove(f"{self._home(name)}/{version}")
        return len(gone)

    def _register(self, s: Published) -> None:
        schema, table = split_table(s.name)
        target = f"{quote(schema)}.{quote(table)}"
        if not s.folders:
            self.spark.sql(f"DROP VIEW IF EXISTS {target}")
            return
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {quote(schema)} LOCATION '{self.root}/catalog/{schema}'")
        columns = ", ".join(quote(c) for c in self._read(s).columns)
        glob = s.folders[0] if len(s.folders) == 1 else "{" + ",".join(s.folders) + "}"
        self.spark.sql(f"CREATE OR REPLACE VIEW {target} AS SELECT {columns} FROM parquet.`{self._home(s.name)}/{glob}`")

    def attach(self) -> list[str]:
        """Make every published table known to this session's catalog."""
        states = [s for s in self.log.state().tables.values() if s.folders and not s.name.startswith(OWN)]
        for s in states:
            self._register(s)
        return sorted(s.name for s in states)

    def publish(self, name: str, df: DataFrame, key=(), part_by: str | None = None, parts: int = 64) -> int:
        """Replace a table as a whole and return its row count."""
        return self.publish_all({name: (df, key, part_by)}, parts)[name]

    def publish_all(self, frames: dict[str, tuple], parts: int = 64, drop_others: bool = False) -> dict[str, int]:
        """Replace several tables in one step: build all of them first, then publish them together."""
        base, fresh = self.log.state(), []
        for name, (df, key, part_by) in frames.items():
            version = base.tables[name].version + 1 if name in base.tables else 1
            layout = (part_by or hash_layout(0, parts)) if key else ""
            fresh.append(self._published(df, name, version, self._write(df, name, version, key, layout), key, layout))
        gone = [dropped(s) for s in base.tables.values() if drop_others and s.folders and s.name not in frames and not s.name.startswith(OWN)]
        if fresh or gone:
            self._commit(base, fresh + gone, alone=drop_others)
        return {s.name: s.n_rows for s in fresh}

    def load_table(self, df: DataFrame, schema: str, table: str) -> int:
        """Create or replace `schema.table` with exactly these rows."""
        return self.publish(".".join(split_table(f"{schema}.{table}")), df)

    # -- keyed upsert --------------------------------------------------------------------------------------------

    def upsert(self, name: str, incoming: DataFrame, key, order=("_row_pos",), source_file: str | None = None,
               part_by: str | None = None, parts: int | None = None) -> UpsertReport:
        """Add rows without losing earlier ones: newest copy of a key wins, the rest of the table stays. See `upsert_all`."""
        return self.upsert_all([Load(name, incoming, tuple([key] if isinstance(key, str) else key), tuple(order), source_file, part_by, parts)])[0]

    def upsert_all(self, loads: list[Load]) -> list[UpsertReport]:
        """Upsert several tables and publish them in one step: readers see all of the loads or none.

        `order` decides which copy of a key inside `incoming` is the last. Only the stored parts that incoming
        keys fall into are rewritten. Where both sides know `_fetched_at`, an older fetch never replaces a newer one.
        """
        base = self.log.state()
        merged = [self._merged(base, load) for load in loads]
        self._commit(base, [published for published, _ in merged])
        return [report for _, report in merged]

    def _merged(self, base: LogState, load: Load) -> tuple[Published, UpsertReport]:
        """The table's next version, written but not published."""
        name, incoming = load.name, load.incoming
        split_table(name)
        key = check_key(load.key, incoming.columns)
        last = base.tables.get(name)
        version = last.version + 1 if last else 1
        state = last if last and last.folders else None
        if load.source_file is not None:
            incoming = incoming.withColumn("_source_file", F.lit(load.source_file))
        incoming = with_lineage(incoming, ["_source_file"])
        stored = [c for c in incoming.columns if c in LINEAGE or not (c.startswith("_") or c == "path")]
        current = None
        if state is not None:
            current = self._read(state)
            assert_same_columns(current, incoming.select(*stored), name)
            full = with_lineage(current, [c for c in stored if c in LINEAGE])
            incoming = with_lineage(incoming, [c for c in full.columns if c in LINEAGE])
            incoming = incoming.withColumns({f.name: F.col(f.name).cast(f.dataType) for f in full.schema})
            stored = full.columns
        has_key = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key])
        # The parts that the keys fall into are found while rows are counted: no other stored part can hold one of them.
        part = part_of(state.layout, key, incoming.schema) if state and state.layout else F.lit(None).cast("string")
        counts = incoming.agg(F.count("*").alias("rows"), F.count_if(has_key).alias("keyed"), F.collect_set(F.when(has_key, part)).alias("parts")).first()
        deduped = last_per_key(incoming, key, list(load.order)).select(*stored)
        layout = (state.layout if state else "") or load.part_by or hash_layout(counts["keyed"], load.parts)
        skipped = counts["rows"] - counts["keyed"]
        if state is not None and state.layout and outgrown(state.layout, state.n_rows + counts["keyed"]):
            layout = hash_layout(state.n_rows + counts["keyed"])  # every row is rewritten once, into more parts
        if state is None:
            made = self._published(deduped, name, version, self._write(deduped, name, version, key, layout), key, layout)
            return made, UpsertReport(made.n_rows, 0, skipped, counts["keyed"] - made.n_rows, made.n_rows)

        touched = {f"{PART}={p or _EMPTY_NAME}" for p in counts["parts"]}
        as_stored = state.layout == layout and set(current.columns) == set(stored)
        live = [f for f in state.folders if not as_stored or f.split("/")[1] in touched]
        kept = [f for f in state.folders if f not in live]
        old = with_lineage(self._read(state, live) if live else current.limit(0), [c for c in stored if c in LINEAGE]).select(*stored)
        # The batch comes out of its choice of rows dealt and sorted by key, so the join sends only the stored rows.
        merged = merge(old, deduped, key, unique=bool(state.layout))
        folders = self._write(merged, name, version, key, layout)
        # One column of the new files says what became of each row.
        found = self.spark.read.schema(f"{CHANGE} string").parquet(*[f"{self._home(name)}/{f}" for f in folders]).groupBy(CHANGE).count().collect()
        n = {r[CHANGE]: r["count"] for r in found}
        new, updated, stale = (n.get(c, 0) for c in (NEW, UPDATED, STALE))
        total = state.n_rows + new if state.layout else sum(n.values())
        made = self._published(merged.select(*stored), name, version, kept + folders, key, layout, total)
        return made, UpsertReport(new, updated, skipped, counts["keyed"] - new - updated - stale, total, stale)

    # -- questions -----------------------------------------------------------------------------------------------

    def query(self, sql: str) -> DataFrame:
        return query(self.spark, sql)

    def ask(self, sql: str, max_rows: int = 50) -> str:
        return ask(self.spark, sql, max_rows)


def query(spark: SparkSession, sql: str) -> DataFrame:
    """A read-only question. As a subquery, anything that is not a SELECT fails to parse."""
    return use_utc(spark).sql(f"SELECT * FROM (\n{sql}\n)")


def ask(spark: SparkSession, sql: str, max_rows: int = 50) -> str:
    """The answer as a small text table. Only the shown rows and the row count reach the driver."""
    answer = query(spark, sql)
    names = answer.columns
    plain = answer.toDF(*[f"c{i}" for i in range(len(names))])  # names may repeat
    cells = [F.coalesce(F.date_format(f.name, "yyyy-MM-dd HH:mm:ssXXX") if isinstance(f.dataType, T.TimestampType) else _as_python(f), F.lit(""))
             for f in plain.schema]
    head = plain.limit(max_rows).select(F.array(*cells).alias("cells")).collect()
    columns = list(zip(names, *[r["cells"] for r in head]))
    text = [[max(map(len, c)), *c] for c in columns]
    body = ["  ".join(c[1 + i].ljust(c[0]) for c in text).rstrip() for i in range(1 + len(head))]
    body.insert(1, "  ".join("-" * c[0] for c in text))
    total = answer.count()
    note = f"({total} {'row' if total == 1 else 'rows'}" + (f", showing {max_rows})" if total > max_rows else ")")
    return "\n".join(body + [note])


def _as_python(f: T.StructField) -> Column:
    """A value spelled as Python spells it where Spark differs: booleans have a capital letter."""
    text = F.col(f.name).cast("string")
    return F.initcap(text) if isinstance(f.dataType, T.BooleanType) else text
