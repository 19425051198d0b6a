"""Aggregations, with exact medians and ranking metrics that never gather a group in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from strata.functions.names import require
from strata.session import write_scratch

# Quantile sketches answer within 1/ACCURACY of the true rank; the bracket leaves room on both sides.
ACCURACY = 100_000
SLACK = 4.0 / ACCURACY
#: Rows that the bracket of a group's middle should hold at most, and steps of the sketch that narrows it.
FEW_ROWS = 1_000_000
GRID = 1_000


def count_rows(df: DataFrame, by=()) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def count_where(df: DataFrame, rules: dict[str, Column | str]) -> DataFrame:
    """Total and one conditional count per rule, in a single pass."""
    def column(p):
        return F.expr(p) if isinstance(p, str) else p

    return df.agg(F.count("*").alias("total"), *[F.count_if(column(p)).alias(n) for n, p in rules.items()])


def group_stats(df: DataFrame, by, measures: dict[str, tuple[str, str]]) -> DataFrame:
    """Grouped aggregates: output name -> (column, function), nulls skipped; functions sum, avg, min, max, count."""
    known = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count}
    unknown = sorted({fn for _, fn in measures.values()} - set(known))
    require(not unknown, f"unknown aggregate functions: {unknown}")
    return df.groupBy(*by).agg(*[known[fn](c).alias(name) for name, (c, fn) in measures.items()])


def median_of(df: DataFrame, column: str, by=(), approx: bool = False, name: str = "median") -> DataFrame:
    """(group..., n, median): the interpolated median, NULL values ignored.

    Exact by default: a quantile sketch brackets the middle of every group, brackets of large groups are narrowed, then only the
    few rows inside the bracket are counted per distinct value. Spark's own `median` keeps every distinct value of a group in one
    buffer, which a large group cannot afford.
    """
    by = [by] if isinstance(by, str) else list(by)
    value = df.select(*by, F.col(column).cast("double").alias("_x")).filter(F.col("_x").isNotNull())
    if approx:
        return value.groupBy(*by).agg(F.count("*").alias("n"), F.percentile_approx("_x", 0.5, ACCURACY).alias(name))
    edges = F.percentile_approx("_x", F.array(F.lit(0.5 - SLACK), F.lit(0.5 + SLACK)), ACCURACY)
    brackets = value.groupBy(*by).agg(F.count("*").alias("_n"), edges.alias("_edges")).select(
        *by, "_n", F.col("_edges")[0].alias("_lo"), F.col("_edges")[1].alias("_hi"))
    if by:
        # Written out, so the join knows the real size: few groups are broadcast, many are not.
        brackets = _narrowed_groups(value, write_scratch(brackets, "median"), by)
        renamed = brackets.withColumnsRenamed({g: f"_g_{g}" for g in by})
        same = reduce(lambda a, b: a & b, [value[g].eqNullSafe(renamed[f"_g_{g}"]) for g in by])
        marked = value.join(renamed, same)
    else:
        n, lo, hi = brackets.first()
        lo, hi = _narrowed(value, n, lo, hi)
        marked = value.withColumns({"_n": F.lit(n).cast("bigint"), "_lo": F.lit(lo).cast("double"), "_hi": F.lit(hi).cast("double")})
    # Every value below the bracket shares one bucket, so the shuffle carries the bracket's distinct values only.
    bucket = F.when(F.col("_x") >= F.col("_lo"), F.col("_x"))
    values = marked.filter(F.col("_x") <= F.col("_hi")).groupBy(*by, "_n", bucket.alias("_v")).agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*by).orderBy(F.col("_v").asc_nulls_first()))
    low, high = F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)

    def at(rank: Column) -> Column:
        return F.min(F.when((F.col("_upto") > rank) & F.col("_v").isNotNull(), F.col("_v")))

    out = values.withColumn("_upto", upto).groupBy(*by).agg(
        F.coalesce(F.max("_n"), F.lit(0)).alias("n"), at(low).alias("_a"), at(high).alias("_b"))
    middle = F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(F.col("_a") + (F.col("_b") - F.col("_a")) * 0.5)
    return out.select(*by, "n", middle.alias(name))


def _narrowed_groups(value: DataFrame, brackets: DataFrame, by: list[str]) -> DataFrame:
    """Brackets that hold few rows: those of large groups shrink together, by a sketch of each bracket in every round.

    A round reads the rows of large groups only, and counts and sketches leave its tasks. It stops for a bracket that holds at most
    FEW_ROWS rows, a single value, or too few values to shrink further; what is left is counted per distinct value.
    """
    n, lo, hi = F.col("_n"), F.col("_lo"), F.col("_hi")
    brackets = brackets.withColumn("_open", (n * (2 * SLACK) > FEW_ROWS) & (lo < hi))
    grid = F.array(*[F.lit(i / GRID) for i in range(GRID + 1)])
    while brackets.filter("_open").limit(1).count():
        wide = brackets.filter("_open").withColumnsRenamed({g: f"_g_{g}" for g in by})
        same = reduce(lambda a, b: a & b, [value[g].eqNullSafe(wide[f"_g_{g}"]) for g in by])
        within = F.col("_x") >= lo
        facts = value.join(wide, same).filter(F.col("_x") <= hi).groupBy(*by, "_n", "_lo", "_hi").agg(
            F.count_if(~within).alias("_below"), F.count_if(within).alias("_inside"), F.percentile_approx(F.when(within, F.col("_x")), grid, ACCURACY).alias("_grid"))
        share = lambda rank: (rank - F.col("_below")) / F.col("_inside") * GRID
        first = F.greatest(F.floor(share(F.floor((n - 1) / 2))) - 1, F.lit(0)).cast("int")
        last = F.least(F.ceil(share(F.floor(n / 2))) + 1, F.lit(GRID)).cast("int")
        closer = facts.select(*by, "_n", lo.alias("_before"), hi.alias("_after"), F.col("_grid")[first].alias("_lo"), F.col("_grid")[last].alias("_hi"), "_inside")
        moved = (lo > F.col("_before")) | (hi < F.col("_after"))
        done = closer.select(*by, "_n", "_lo", "_hi", ((F.col("_inside") > FEW_ROWS) & (lo < hi) & moved).alias("_open"))
        brackets = write_scratch(brackets.filter("NOT _open").unionByName(done), "median")
    return brackets.drop("_open")


def _narrowed(value: DataFrame, n: int, lo: float, hi: float, most: int = 1_000_000) -> tuple[float, float]:
    """Shrink the bracket until it holds few rows: one more sketch of the bracket for every factor of ten thousand."""
    low, high = (n - 1) // 2, n // 2
    while n * 2 * SLACK > most and lo < hi:
        c = value.filter(F.col("_x") <= hi).agg(F.count_if(F.col("_x") < lo).alias("below"), F.count_if(F.col("_x") >= lo).alias("inside")).first()
        if c["inside"] <= most:
            break
        cuts = [max(0.0, (low - c["below"]) / c["inside"] - SLACK), min(1.0, (high - c["below"]) / c["inside"] + SLACK)]
        edges = value.filter((F.col("_x") >= lo) & (F.col("_x") <= hi)).agg(F.percentile_approx("_x", cuts, ACCURACY).alias("e")).first()["e"]
        if (edges[0], edges[1]) == (lo, hi):
            break
        lo, hi = edges
    return lo, hi


def worst_severity(results: DataFrame) -> DataFrame:
    """(errors, warnings, code) of rule results with columns severity and flagged: 2 error > 1 warning > 0 clean."""
    hit = F.col("flagged") > 0
    code = F.when(hit & (F.col("severity") == "error"), 2).when(hit & (F.col("severity") == "warning"), 1).otherwise(0)
    return results.agg(
        F.count_if(hit & (F.col("severity") == "error")).alias("errors"),
        F.count_if(hit & (F.col("severity") == "warning")).alias("warnings"),
        F.coalesce(F.max(code), F.lit(0)).alias("code"),
    )


def base_rate(df: DataFrame, label: str) -> DataFrame:
    return df.agg(F.avg(F.col(label).cast("double")).alias("base_rate"))


def _score_steps(df: DataFrame, score: str, label: str, buckets: int) -> DataFrame:
    """One row per distinct score: pos, neg, and the pos/neg totals of all better scores.

    Rows with equal scores collapse first. The running totals use two phases: sums per score range, accumulated
    over at most `buckets` rows, then a window inside each range.
    """
    hit = F.col(label).cast("int")
    value = F.col(score).cast("double")
    cuts = [i / buckets for i in range(1, buckets)]
    edges = df.agg(F.percentile_approx(value, cuts, 10 * buckets).alias("edges")).first()["edges"]
    splits = [float("-inf"), *sorted(set(edges or [])), float("inf")]
    steps = df.groupBy(value.alias("score")).agg(F.sum(hit).alias("pos"), F.sum(1 - hit).alias("neg"))
    if len(splits) > 2:
        steps = Bucketizer(splits=splits, inputCol="score", outputCol="bucket", handleInvalid="keep").transform(steps)
    else:
        steps = steps.withColumn("bucket", F.lit(0.0))
    sums = steps.groupBy("bucket").agg(F.sum("pos").alias("bp"), F.sum("neg").alias("bn"))
    zero = F.lit(0)
    before = Window.orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    # At most `buckets` rows reach this global window and the broadcast.
    offsets = sums.select(
        "bucket", F.coalesce(F.sum("bp").over(before), zero).alias("op"), F.coalesce(F.sum("bn").over(before), zero).alias("on"))
    inside = Window.partitionBy("bucket").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return steps.join(F.broadcast(offsets), "bucket").select(
        "score", "pos", "neg",
        (F.col("op") + F.coalesce(F.sum("pos").over(inside), zero)).alias("pos_before"),
        (F.col("on") + F.coalesce(F.sum("neg").over(inside), zero)).alias("neg_before"),
    )


def ranking_metrics(df: DataFrame, score: str, label: str, buckets: int | None = None) -> DataFrame:
    """One row (n, positives, auc, avg_precision, base_rate) of a 0/1 label ranked by a score.

    AUC is the rank statistic with ties counted half; average precision is the step sum over distinct scores. Unless
    given, the number of score ranges follows the rows, a million to a range.
    """
    rows = df.select(score, label).filter(F.col(score).isNotNull() & F.col(label).isNotNull())
    steps = _score_steps(rows, score, label, buckets or max(16, rows.count() // 1_000_000))
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    tp = F.col("pos_before") + pos
    precision = tp / (tp + F.col("neg_before") + neg)
    sums = steps.agg(
        F.sum(F.col("pos") + F.col("neg")).alias("n"), F.sum("pos").alias("positives"),
        F.sum(neg * (F.col("pos_before") + pos / 2)).alias("_wins"),
        F.sum(pos * precision).alias("_precision"),
    )
    p, q = F.col("positives").cast("double"), (F.col("n") - F.col("positives")).cast("double")
    return sums.select(
        "n", "positives",
        F.try_divide(F.col("_wins"), p * q).alias("auc"),
        F.try_divide(F.col("_precision"), p).alias("avg_precision"),
        F.try_divide(p, p + q).alias("base_rate"),
    )


def roc_auc(df: DataFrame, score: str, label: str) -> float:
    return ranking_metrics(df, score, label).first()["auc"]


def average_precision(df: DataFrame, score: str, label: str) -> float:
    return ranking_metrics(df, score, label).first()["avg_precision"]
