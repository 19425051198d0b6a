r"""Quality rules as a learned decision list.

Statistics of every text are DataFrame expressions: words and lines are arrays, and repeated 3-word windows are found by sorting
64-bit keys (36 bits of a window's hash above its position) inside the row, after which windows that share a hash are compared by
their words, so no row is exploded and nothing is shuffled. Labels teach an ordered list of rules by sequential covering: a rule
grows by the threshold that gains most on two thirds of the labelled sample, is pruned on the last third, and
covers its rows; the list ends when no rule keeps the required precision. Each step is one grouped count over binned
statistics. The list is emitted as one Spark CASE expression, first rule first, and applied to all documents.

Defined cases: a null or empty text has no words and fails the base rule; labels that are null, or whose id is null or missing from the
documents, are not used; a document labelled twice takes the lower quality; without labels of both kinds the list is empty
and the base rule decides alone; repeated rows and null ids are judged like any row; an empty table gives an empty
result; other columns are not read. A text can have up to 2^28 words.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strata.llm.base import query, table, texts
from strata.session import write_scratch

#: Labelled documents the list is learned from at most.
SAMPLE = 20_000
BINS = 24
LONGEST_RULE = 3
MOST_RULES = 12
#: A rule must be right on this share of the rows it rejects, grown and pruned, and reject this many of each part.
PRECISION = 0.95
LEAST_COVER = 3

_POSITION_BITS = 28
_BLANK = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]"
_NO_INTS = "CAST(array() AS array<int>)"


def _count_of(kept: str) -> Column:
    """Characters of the class `kept` in the text."""
    return F.length(F.regexp_replace("text", f"[^{kept}]+", "")).cast("long")


def _meeting(rows: str, same) -> Column:
    """The elements of a sorted array that are the `same` as the one before or after them."""
    sorted_rows = F.col(rows)
    return F.filter(sorted_rows, lambda x, i: same(x, F.get(sorted_rows, i - 1)) | same(x, F.get(sorted_rows, i + 1)))


def _indexes(size: Column) -> Column:
    return F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.expr(_NO_INTS))


def text_statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """Rows of `docs` (with a text that is not null) as the columns `keep` and the statistics; see the module."""
    low = F.lit((1 << _POSITION_BITS) - 1).cast("long")
    w = F.col("_w")

    def window_key(i: Column) -> Column:
        return F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long"))

    def same_hash(a: Column, b: Column) -> Column:
        return F.shiftright(a.bitwiseXOR(b), _POSITION_BITS) == 0

    def same_words(a: Column, b: Column) -> Column:
        return a["g"] == b["g"]

    def words_at(i: Column) -> Column:
        return F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("g"), i.alias("p"))

    lines = F.filter(F.split("text", "\n", -1), lambda line: F.rlike(line, F.lit(_WORD)))
    counted = (
        docs.select(*keep, F.filter(F.split("text", f"{_BLANK}+", -1), lambda x: x != "").alias("_w"), lines.alias("_l"),
                    _count_of(r"#*$%&|<>").alias("n_symbols"), _count_of("A-Z").alias("n_upper"), _count_of("!").alias("n_marks"))
        .select(*keep, "n_symbols", "n_upper", "n_marks", "_w", F.size("_w").alias("_n"),
                F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
                (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"))
        .withColumn("_s", F.sort_array(F.transform(_indexes(F.col("_n") - 2), window_key)))
        .withColumn("_t", F.sort_array(F.transform(_meeting("_s", same_hash), lambda k: words_at(k.bitwiseAND(low).cast("int")))))
        .withColumn("_d", F.transform(_meeting("_t", same_words), lambda t: t["p"])))
    covered = F.size(F.array_distinct(F.flatten(F.transform("_d", lambda p: F.array(p, p + 1, p + 2)))))
    return counted.select(*keep, F.col("_n").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines",
                          covered.cast("long").alias("n_repeat_words"), "n_upper", "n_marks")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _share(a: str, b: str) -> Column:
    return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))


def measures() -> dict[str, Column]:
    """What rules may test, as expressions over the statistics."""
    return {
        "word_length": _share("word_chars", "n_words"),
        "symbols": _share("n_symbols", "n_words"),
        "repeats": _share("n_repeat_words", "n_words"),
        "dup_lines": _share("n_dup_lines", "n_words"),
        "capitals": _share("n_upper", "word_chars"),
        "marks": _share("n_marks", "n_words"),
    }


@dataclass(frozen=True)
class Condition:
    """measure > cut (above) or measure <= cut."""

    measure: int
    cut: int
    above: bool

    def on_bins(self) -> Column:
        value = F.get("bins", F.lit(self.measure))
        return value > self.cut if self.above else value <= self.cut

    def on_statistics(self, cuts: list[list[float]]) -> Column:
        value, at = list(measures().values())[self.measure], F.lit(cuts[self.measure][self.cut])
        return value > at if self.above else value <= at

    def text(self, cuts: list[list[float]]) -> str:
        return f"{list(measures())[self.measure]} {'>' if self.above else '<='} {cuts[self.measure][self.cut]:g}"


Rule = tuple[Condition, ...]


def _all(rule: Rule, on) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & on(c)
    return out


@dataclass(frozen=True)
class DecisionList:
    """Ordered rules that reject; what no rule rejects is kept."""

    rules: tuple[Rule, ...]
    cuts: list[list[float]]

    def expression(self) -> Column:
        """The number (from 1) of the first rule that rejects a row, null if none does, as one CASE expression."""
        out = None
        for i, rule in enumerate(self.rules, 1):
            test = _all(rule, lambda c: c.on_statistics(self.cuts))
            out = F.when(test, i) if out is None else out.when(test, i)
        return F.lit(None).cast("int") if out is None else out

    def text(self) -> list[str]:
        return [" and ".join(c.text(self.cuts) for c in rule) for rule in self.rules]


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    """FOIL's gain of narrowing (p0, n0) to (p, n)."""
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else -math.inf


def _grow(rows: DataFrame) -> Rule:
    """Add the best threshold, one grouped count a step, until no good row is covered."""
    rule: Rule = ()
    while len(rule) < LONGEST_RULE:
        covered = rows.filter("growing").filter(_all(rule, Condition.on_bins))
        seen = covered.select("bad", F.posexplode("bins").alias("m", "b")).groupBy("m", "b", "bad").agg(F.count("*").alias("n")).collect()
        if not seen:
            break
        tally: dict[int, dict[int, list[int]]] = {}
        for r in seen:  # at most measures x (BINS + 1) x 2 rows
            tally.setdefault(r["m"], {}).setdefault(r["b"], [0, 0])[0 if r["bad"] else 1] += r["n"]
        p0, n0 = (sum(v[i] for v in tally[0].values()) for i in (0, 1))
        if not p0 or not n0:
            break
        best, best_gain = None, 0.0
        for m, by_bin in sorted(tally.items()):
            p = n = 0
            for b in sorted(by_bin)[:-1]:
                p, n = p + by_bin[b][0], n + by_bin[b][1]
                for c, (cp, cn) in ((Condition(m, b, False), (p, n)), (Condition(m, b, True), (p0 - p, n0 - n))):
                    if cp >= LEAST_COVER and _gain(cp, cn, p0, n0) > best_gain:
                        best, best_gain = c, _gain(cp, cn, p0, n0)
        if best is None:
            break
        rule += (best,)
    return rule


def _prune(rows: DataFrame, rule: Rule) -> tuple[Rule, tuple[int, int, int, int]]:
    """The beginning of the rule that does best on the rows kept from growing, with its counts (bad and good, pruning and growing)."""
    tests = [_all(rule[:i], Condition.on_bins) for i in range(1, len(rule) + 1)]
    parts = [(~F.col("growing")) & F.col("bad"), (~F.col("growing")) & ~F.col("bad"), F.col("growing") & F.col("bad"), F.col("growing") & ~F.col("bad")]
    counts = rows.agg(*[F.count_if(t & part).alias(f"c{i}_{k}") for i, t in enumerate(tests) for k, part in enumerate(parts)]).first()
    scored = [(tuple(counts[f"c{i}_{k}"] for k in range(4)), i + 1) for i in range(len(tests))]
    counts, size = max(scored, key=lambda s: ((s[0][0] - s[0][1]) / (s[0][0] + s[0][1]) if s[0][0] + s[0][1] else -1.0, s[0][0], -s[1]))
    return rule[:size], counts


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DecisionList:
    """Sequential covering on at most `sample` labelled documents, chosen by a hash of their ids; `docs` holds doc_id and text."""
    chosen = (labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((F.min("quality") == 0).alias("bad"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    # `chosen` has at most `sample` rows of two values
    # written before it is filtered, as a filter would be pushed below the statistics and work them out once more
    stats = write_scratch(text_statistics(docs.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]), "doc_id", "bad"), "labelled-statistics")
    measured = write_scratch(stats.filter(~base_failed()).select(
        "bad", (F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(3)) > 0).alias("growing"), F.array(*measures().values()).alias("m")), "labelled-measures")
    names = list(measures())
    at = [i / BINS for i in range(1, BINS)]
    found = measured.agg(*[F.percentile(F.get("m", F.lit(i)), F.array(*map(F.lit, at))).alias(f"q{i}") for i in range(len(names))]).first()
    cuts = [sorted(set(found[f"q{i}"] or [])) for i in range(len(names))]

    def bin_of(i: int) -> Column:  # how many cuts lie below the value
        edges = F.array(*map(F.lit, cuts[i])) if cuts[i] else F.expr("CAST(array() AS array<double>)")
        return F.size(F.filter(edges, lambda c: c < F.get("m", F.lit(i))))

    rows = write_scratch(measured.select("bad", "growing", F.array(*[bin_of(i) for i in range(len(names))]).alias("bins")), "labelled-bins")
    rules: list[Rule] = []
    while len(rules) < MOST_RULES:
        left = rows.filter(~_any(rules))
        rule = _grow(left)
        if not rule:
            break
        rule, (p, n, gp, gn) = _prune(left, rule)
        if min(p, gp) < LEAST_COVER or min(p / (p + n), gp / (gp + gn)) < PRECISION:
            break
        rules.append(rule)
    return DecisionList(tuple(rules), cuts)


def _any(rules: list[Rule]) -> Column:
    out = F.lit(False)
    for rule in rules:
        out = out | _all(rule, Condition.on_bins)
    return out


def judge(docs: DataFrame, decisions: DecisionList) -> DataFrame:
    """Statistics, base_failed, the rejecting rule (null: none) and kept for every row of doc_id and text."""
    stats = text_statistics(docs, "doc_id").withColumn("base_failed", base_failed()).withColumn("rule", decisions.expression())
    return stats.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


@query("op3_quality_rules")
def quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    """The contract's statistics and verdicts under the list learned from the table of labels."""
    docs = texts(table(spark, sf, "documents"))
    found = judge(docs, learn(docs, table(spark, sf, "labels")))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
