r"""Word use of the sources of a language, compared pair by pair.

Copies of a text are collapsed first: every task folds its identical texts of a language to one row with the number of rows per source, the rows
of a text then meet by hash and are folded again, so even a text that a third of all rows hold is one row per task on the way, and each distinct
text is split into words once. Its counts and document frequencies enter weighted by these numbers. Tasks add up their words before they are
shuffled, and words of too few documents of their language go.

For the pairs, only counts that are not zero travel. The words of a language are dealt into cells; a cell lists, for each source, the words that
it has there. A word that both sources of a pair have is evaluated word by word, a word that one of them has by the number of such words with
the same value, and the words that neither has, in no cell, by how many are left. Cells return sums per pair, which the result holds anyway, and many sources
are cut into blocks, so that a cell holds at most two blocks of sources.

Defined cases: a null text, language or source counts as the empty string; an empty text has no words and still makes its group exist; a
language none of whose words is in enough documents has pairs of value 0 and no words; repeated rows are documents of their own; ties go
to the smaller item in UTF-8 order; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from strata.llm.base import parts, query, table
from strata.session import write_scratch

LEAST_DOCS = 10
TOP = 10
SCALE = 1_000_000_000
#: Text held while copies are folded, entries held while words are added up, counts in a cell, sources in a block.
FOLD_BYTES = 32 << 20
HELD_WORDS = 300_000
CELL_ROWS = 200_000
SOURCES_PER_BLOCK = 512

# all bytes of multi-byte characters are word characters; A-Z become lower case, every other byte outside a-z a blank
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_FOLDED = "lang string, text binary, sources array<string>, n array<long>"
_WORDS = "lang string, source string, term string, n long, docs long"


def terms(text: bytes) -> list[bytes]:
    """The words of a UTF-8 text."""
    return text.translate(_TABLE).split()


def _folded(held: dict) -> pa.RecordBatch:
    langs, bodies = zip(*held) if held else ((), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(langs, pa.string()), pa.array(bodies, pa.binary()), pa.array([list(c) for c in held.values()], pa.list_(pa.string())),
         pa.array([list(c.values()) for c in held.values()], pa.list_(pa.int64()))], ["lang", "text", "sources", "n"])


def _fold_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Identical texts of a language become one row with the number of rows of each source."""
    held: dict[tuple[str, bytes], Counter] = {}
    size = 0
    for batch in batches:
        for lang, source, text in zip(*(batch.column(i) for i in range(3))):
            key = (lang.as_py(), text.as_py())
            if key not in held:
                held[key] = Counter()
                size += len(key[1]) + 200
            held[key][source.as_py()] += 1
            if size >= FOLD_BYTES:
                yield _folded(held)
                held, size = {}, 0
    if held:
        yield _folded(held)


class _Words:
    """Counts and document frequencies per (language, source), added up until there are too many to hold."""

    def __init__(self):
        self.n: dict[tuple[str, str], Counter] = {}
        self.docs: dict[tuple[str, str], Counter] = {}

    def add(self, lang: str, text: bytes, copies: Counter) -> None:
        words = terms(text)
        if not words:
            return
        counted = None if len(copies) == 1 and sum(copies.values()) == 1 else Counter(words)
        for source, times in copies.items():
            n, docs = self.n.setdefault((lang, source), Counter()), self.docs.setdefault((lang, source), Counter())
            if counted is None:
                n.update(words)
                docs.update(set(words))
                continue
            for word, c in counted.items():
                n[word] += c * times
                docs[word] += times

    def full(self) -> bool:
        return sum(map(len, self.n.values())) >= HELD_WORDS

    def rows(self) -> pa.RecordBatch:
        out: tuple[list, ...] = ([], [], [], [], [])
        for (lang, source), n in self.n.items():
            docs = self.docs[(lang, source)]
            for column, values in zip(out, ([lang] * len(n), [source] * len(n), n.keys(), n.values(), [docs[w] for w in n])):
                column.extend(values)
        kinds = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()]
        columns = [pa.array(c, k) for c, k in zip(out, kinds)]
        columns[2] = columns[2].cast(pa.string())
        return pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (language, text): rows of one text are folded once more, then the text is split."""
    words, now, copies = _Words(), None, Counter()
    for batch in batches:
        for lang, text, sources, n in zip(*(batch.column(i) for i in range(4))):
            key = (lang.as_py(), text.as_py())
            if key != now:
                if now is not None:
                    words.add(*now, copies)
                    if words.full():
                        yield words.rows()
                        words = _Words()
                now, copies = key, Counter()
            copies.update(dict(zip(sources.as_py(), n.as_py())))
    if now is not None:
        words.add(*now, copies)
        yield words.rows()


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of all words; `docs` holds lang, source and text without nulls."""
    folded = docs.select("lang", "source", F.col("text").cast("binary").alias("text")).mapInArrow(_fold_rows, _FOLDED)
    met = (folded.withColumn("at", F.xxhash64("lang", "text")).repartition(parts(docs.sparkSession), "at")
           .sortWithinPartitions("at", "lang", "text").select("lang", "text", "sources", "n"))
    return (met.mapInArrow(_count_words, _WORDS).groupBy("lang", "source", "term")
            .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))


def share(n: str, total: str) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * kept)) of named columns; decimals, as the product leaves the range of a long for large counts."""
    wide = "CAST({} AS DECIMAL(20, 0))"
    return F.expr(f"1 + {wide.format(n + ' + 2')} * {SCALE} div {wide.format(total + ' + 2 * kept')}")


def apart(p, q):
    """floor((p - q)^2 / (p + q)) of arrays of whole numbers below 2^31."""
    return (p - q) ** 2 // (p + q)


def kept_words(counts: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, word, all, uses): words in enough documents with a number of their own; `uses` has one entry per source that uses the word."""
    kept = (counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all"), F.collect_list(F.struct("source", "n")).alias("uses"))
            .filter(F.col("docs") >= least_docs).drop("docs"))
    return write_scratch(kept.withColumn("word", F.monotonically_increasing_id()), "kept-words")


def source_groups(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, at, total, lang_total, kept, none): `at` numbers the sources of a language from 0, `none` is the share of a word never used."""
    totals = kept.select("lang", F.explode("uses").alias("use")).groupBy("lang", F.col("use.source").alias("source")).agg(F.sum("use.n").alias("total"))
    of_lang = kept.groupBy("lang").agg(F.sum("all").alias("lang_total"), F.count("*").alias("kept"))
    found = (docs.groupBy("lang", "source").agg(F.count("*").alias("docs")).drop("docs")
             .join(totals, ["lang", "source"], "left").join(of_lang, "lang", "left").fillna(0, ["total", "lang_total", "kept"]))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    zero = F.when(F.col("kept") > 0, share("0", "total"))
    return write_scratch(found.select("*", place.alias("at"), zero.alias("none")), "source-groups")


def cell_sums(word: np.ndarray, at: np.ndarray, p: np.ndarray, sources: np.ndarray, none: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each pair of a cell's sources, the sum of `apart` over the words that either uses, and their number.

    (word, at, p) lists what is used, `none` is each source's share of an unused word.
    """
    order = np.lexsort((word, at))
    codes, word = np.unique(word[order], return_inverse=True)
    s, p = np.searchsorted(sources, at[order]), p[order]
    k, cuts = len(sources), np.searchsorted(s, np.arange(len(sources) + 1))
    either = np.diff(cuts)[:, None] + np.diff(cuts)[None, :]
    out = np.zeros((k, k), np.int64)
    for i in range(k):
        own = slice(cuts[i], cuts[i + 1])
        value, times = np.unique(p[own], return_counts=True)
        alone = (apart(value[:, None], none[None, :]) * times[:, None]).sum(axis=0)
        out[i] += alone
        out[:, i] += alone
        mine = np.zeros(len(codes), np.int64)
        mine[word[own]] = p[own]
        both = np.flatnonzero(mine[word])
        ours, theirs, of = mine[word[both]], p[both], s[both]
        np.add.at(out[i], of, apart(ours, theirs) - apart(ours, none[of]) - apart(none[i], theirs))
        either[i] -= np.bincount(of, minlength=k)
    return out, either


_PAIRS = "lang string, a int, b int, value long, words long"


def pair_sums(kept: DataFrame, groups: DataFrame, used: DataFrame, per_block: int = SOURCES_PER_BLOCK) -> DataFrame:
    """(lang, a, b, value, words), a < b: sum over the words that either source uses, and their number; `used` holds lang, word, at and p."""
    rows = kept.agg(F.sum(F.size("uses"))).first()[0] or 0
    cells = max(parts(kept.sparkSession), -(-rows // CELL_ROWS))
    block = F.floor(F.col("at") / per_block).cast("int")
    last = F.floor(F.max("at").over(Window.partitionBy("lang")) / per_block).cast("int")
    numbered = groups.filter("kept > 0").select("lang", "at", "none", last.alias("last"))
    blocks = numbered.select("lang", "last").distinct()

    def met(df: DataFrame) -> DataFrame:  # a source's block meets every block of the language, itself included
        return (df.withColumn("other", F.explode(F.sequence(F.lit(0), "last")))
                .withColumn("low", F.least(block, "other")).withColumn("high", F.greatest(block, "other")).drop("last", "other"))

    left = met(used.withColumn("cell", F.pmod(F.xxhash64("word"), F.lit(cells)).cast("int")).join(blocks, "lang"))
    right = met(numbered).withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # columns of its own: both sides stem from `groups`

    def run(key: tuple, uses: pa.Table, sources: pa.Table) -> pa.Table:
        if not uses.num_rows:
            return pa.table([pa.array([], pa.string()), *[pa.array([], pa.int32())] * 2, *[pa.array([], pa.int64())] * 2], ["lang", "a", "b", "value", "words"])
        sources = sources.sort_by("at")
        at = np.asarray(sources["at"]).astype(np.int64)
        sums, words = cell_sums(*(np.asarray(uses[c]).astype(np.int64) for c in ("word", "at", "p")), at, np.asarray(sources["none"]))
        low, high = key[2].as_py(), key[3].as_py()
        i, j = np.nonzero((words > 0) & (at[:, None] < at[None, :]) & (at[:, None] // per_block == low) & (at[None, :] // per_block == high))
        return pa.table([pa.array([key[0].as_py()] * len(i), pa.string()), pa.array(at[i], pa.int32()), pa.array(at[j], pa.int32()), pa.array(sums[i, j]), pa.array(words[i, j])],
                        ["lang", "a", "b", "value", "words"])

    keys = ["lang", "cell", "low", "high"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, _PAIRS)
    return found.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("words").alias("words"))


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source is from each other one, and the words it uses more than its language."""
    docs = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    kept = kept_words(word_counts(docs), least_docs)
    groups = source_groups(docs, kept)
    uses = kept.select("lang", "term", "word", "all", F.explode("uses").alias("use")).select("lang", "term", "word", "all", "use.source", "use.n")
    shares = (uses.join(groups, ["lang", "source"])
              .select("lang", "source", "term", "word", "at", share("n", "total").alias("p"), share("`all`", "lang_total").alias("q")))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    words = (shares.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("(p - q) * (p - q) div (p + q)").alias("value"))
             .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top))
    sums = pair_sums(kept, groups, shares.select("lang", "word", "at", "p"))
    sides = groups.select("lang", "source", "at", "kept", "none")
    unused = "coalesce((kept - coalesce(words, 0)) * ((none - none_other) * (none - none_other) div (none + none_other)), 0)"
    pairs = (sides.join(sides.selectExpr("lang", "source AS item", "`at` AS other", "none AS none_other"), "lang").filter(F.col("at") != F.col("other"))
             .withColumn("a", F.least("at", "other")).withColumn("b", F.greatest("at", "other")).join(sums, ["lang", "a", "b"], "left")
             .select("lang", "source", F.lit("pair").alias("part"), "item", F.expr(f"coalesce(value, 0) + {unused}").alias("value"))
             .withColumn("rank", F.row_number().over(order)))
    return pairs.union(words)


_DUCK = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text, row_number() OVER () AS id FROM documents),
each AS (SELECT lang, source, id, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM d),
low AS (SELECT lang, source, id, translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM each),
kept AS (SELECT lang, term FROM low GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM low JOIN kept USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
dense AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN kept k USING (lang) LEFT JOIN c USING (lang, source, term)),
whole AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term),
q AS (SELECT lang, term, CAST(1 + CAST(1000000000 AS HUGEINT) * (n + 2) // (sum(n) OVER (PARTITION BY lang) + 2 * v) AS BIGINT) AS q FROM whole JOIN v USING (lang)),
p AS (SELECT lang, source, term, n, CAST(1 + CAST(1000000000 AS HUGEINT) * (n + 2) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS BIGINT) AS p
  FROM dense JOIN v USING (lang)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
words AS (SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
both_parts AS (SELECT * FROM pairs UNION ALL SELECT * FROM words),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM both_parts)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""


@query("op12_source_divergence", _DUCK)
def divergence_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Distances between the sources of each language, and each source's own words."""
    return source_divergence(table(spark, sf, "documents"))
