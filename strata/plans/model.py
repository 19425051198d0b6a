"""Which unlabelled rows look like the labelled ones: features, folds, out-of-fold scores, ranking."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from strata.functions.names import require
from strata.operators.aggregates import median_of, ranking_metrics
from strata.operators.joins import label_members, lookup_default
from strata.operators.topk import by_weight, rank_candidates
from strata.plans.astro import COMPANION_AU, match_hosts, nearest_companion, with_abs_mag, with_distance
from strata.session import write_scratch

# Feature order, number of folds, seed.
FEATURES = ("log10_distance_pc", "g_mag", "bp_rp", "abs_g", "no_colour", "has_rv", "has_companion")
FOLDS = 5
SEED = 0


def gap_features(stars: DataFrame, companions: DataFrame | None = None, max_au: float = COMPANION_AU) -> DataFrame:
    """source_id, pc, companion_au and the seven features of every star with a brightness and a positive parallax.

    A missing colour becomes the median colour plus a flag.
    """
    companions = nearest_companion(stars, max_au) if companions is None else companions
    usable = stars.filter("phot_g_mean_mag IS NOT NULL AND parallax > 0")
    middle = median_of(usable, "bp_rp").first()["median"]
    fill = 0.0 if middle is None else middle
    rows = with_abs_mag(with_distance(usable)).select(
        "source_id", "pc", F.col("phot_g_mean_mag").alias("g_mag"), "bp_rp", "abs_g", F.col("radial_velocity").isNotNull().alias("_rv"))
    rows = lookup_default(rows, companions, "source_id", "au", float("inf"))
    return rows.select(
        "source_id", "pc", F.col("au").alias("companion_au"), F.col("bp_rp").alias("colour"),
        F.log10("pc").alias("log10_distance_pc"), "g_mag", F.coalesce("bp_rp", F.lit(fill)).alias("bp_rp"), "abs_g",
        F.col("bp_rp").isNull().cast("double").alias("no_colour"), F.col("_rv").cast("double").alias("has_rv"),
        (F.col("au") < max_au).cast("double").alias("has_companion"),
    )


def assign_folds(df: DataFrame, id_column: str, label: str, k: int = FOLDS, seed: int = SEED, buckets: int = 1024) -> DataFrame:
    """Add `fold` 0..k-1: a repeatable shuffle in which the fold sizes of each label differ by at most one.

    Rows are ranked per label by a hash of their id. The rank is the size of all earlier hash buckets, accumulated
    over at most labels x buckets counts, plus a row number inside the bucket, so no label is ever one window.
    """
    require(k >= 2, "k must be 2 or more")
    spread = F.xxhash64(F.lit(seed), F.col(id_column))
    rows = df.withColumns({"_h": spread, "_bucket": F.pmod(spread, F.lit(buckets))})
    sizes = rows.groupBy(label, "_bucket").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(label).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(label, "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(label, "_bucket").orderBy("_h", id_column)
    ranked = rows.withColumn("_rank", F.row_number().over(inside) - 1).join(offsets, [label, "_bucket"])
    return ranked.withColumn("fold", ((F.col("_offset") + F.col("_rank")) % k).cast("int")).drop("_h", "_bucket", "_n", "_rank", "_offset")


@dataclass(frozen=True)
class Fit:
    """A linear model on the standardised scale: features are centred by `mean` and divided by `scale`."""

    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weight: tuple[float, ...]
    intercept: float

    def score(self, features) -> Column:
        z = F.lit(self.intercept)
        for f, m, s, w in zip(features, self.mean, self.scale, self.weight):
            z = z + F.lit(w) * (F.col(f) - F.lit(m)) / F.lit(s)
        return 1.0 / (1.0 + F.exp(-z))


def _centred(df: DataFrame, features, label: str) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(fold, y, g0..) with every feature centred and scaled over all rows, plus the means and scales used."""
    row = list(df.agg(*[f(c) for c in features for f in (F.avg, F.stddev_pop)]).first())
    mean, scale = np.array(row[0::2]), np.array([s or 1.0 for s in row[1::2]])
    g = [((F.col(c) - F.lit(float(m))) / F.lit(float(s))).alias(f"g{i}") for i, (c, m, s) in enumerate(zip(features, mean, scale))]
    return df.select("fold", F.col(label).cast("double").alias("y"), *g), mean, scale


def _fold_moments(rows: DataFrame, d: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation of g in the training set of each fold model, and of all rows last."""
    sums = np.zeros((k, 1 + 2 * d))
    measures = [F.count("*"), *[F.sum(f"g{i}") for i in range(d)], *[F.sum(F.col(f"g{i}") * F.col(f"g{i}")) for i in range(d)]]
    for r in rows.groupBy("fold").agg(*measures).collect():
        sums[r[0]] = list(r)[1:]
    total = np.vstack([sums.sum(axis=0) - sums, sums.sum(axis=0)])
    mu = total[:, 1:1 + d] / total[:, :1]
    sigma = np.sqrt(np.maximum(total[:, 1 + d:] / total[:, :1] - mu * mu, 0.0))
    return mu, np.where(sigma > 1e-12, sigma, 1.0)


def _newton_pass(rows: DataFrame, beta: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss, gradient and curvature of all models at `beta`, from one aggregation over the data.

    Model m is trained on all folds but m; model k on everything. Sums leave the tasks, never rows.
    """
    d = beta.shape[1] - 1
    # One row per model. As a table rather than as literals, every pass compiles to the same code.
    names = ", ".join(f"b{i} double" for i in range(d + 1))
    params = rows.sparkSession.createDataFrame([(m, *map(float, b)) for m, b in enumerate(beta)], f"model int, {names}")
    spread = rows.selectExpr("y", *[f"g{i}" for i in range(d)], f"explode(filter(sequence(0, {k}), m -> m <> fold)) AS model")
    eta = " + ".join(["b0", *[f"b{i + 1} * g{i}" for i in range(d)]])
    scored = spread.join(F.broadcast(params), "model").selectExpr("model", "y", *[f"g{i}" for i in range(d)], f"{eta} AS eta")
    scored = scored.selectExpr("*", "1.0D / (1.0D + exp(-eta)) AS p").selectExpr("*", "y - p AS r", "p * (1.0D - p) AS v")
    x = ["1.0D", *[f"g{i}" for i in range(d)]]
    pairs = [(i, j) for i in range(d + 1) for j in range(i + 1)]
    sums = ["sum(log1p(exp(-abs(eta))) + greatest(eta, 0.0D) - y * eta)", *[f"sum(r * {c})" for c in x], *[f"sum(v * {x[i]} * {x[j]})" for i, j in pairs]]
    out_loss, gradient, curvature = np.zeros(k + 1), np.zeros((k + 1, d + 1)), np.zeros((k + 1, d + 1, d + 1))
    for r in scored.groupBy("model").agg(*[F.expr(e) for e in sums]).collect():
        m, values = r[0], list(r)[1:]
        out_loss[m], gradient[m] = values[0], values[1:d + 2]
        for (i, j), v in zip(pairs, values[d + 2:]):
            curvature[m, i, j] = curvature[m, j, i] = v
    return out_loss, gradient, curvature


def damped_newton(evaluate, ridge: np.ndarray, steps: int = 100, start: np.ndarray | None = None) -> np.ndarray:
    """Minimise all penalised losses at once, one call of `evaluate` (loss, gradient, curvature of each model) per round.

    Each model keeps its last good point. A trial that is worse is tried again at half the step from that same point; a good
    one becomes the new point and gets a fresh Newton step. A model whose fresh step is tiny has settled; all must.
    """
    good = np.zeros_like(ridge) if start is None else np.array(start, dtype=float)
    value, step = np.full(len(good), np.inf), np.zeros_like(good)
    settled = np.zeros(len(good), dtype=bool)
    for _ in range(steps):
        trial = good + step
        loss, gradient, curvature = evaluate(trial)
        tried = loss + 0.5 * (ridge * trial * trial).sum(axis=1)
        better = ~(tried > value + 1e-9 * np.maximum(1.0, np.abs(value)))
        slope = gradient - ridge * trial
        fresh = np.stack([np.linalg.solve(c + np.diag(r), s) for c, r, s in zip(curvature, ridge, slope)])
        good, value = np.where(better[:, None], trial, good), np.where(better, tried, value)
        step = np.where(better[:, None], fresh, 0.5 * step)
        settled = better & (np.abs(fresh).max(axis=1) < 1e-6)
        # Steps shrink quadratically: after one this small the error is far below rounding.
        if settled.all():
            return good + step
    m = int(np.flatnonzero(~settled)[0])
    raise RuntimeError(f"model {m} has not settled after {steps} rounds; gradient norm {np.linalg.norm(slope[m]):.3g}")


def _fit_all(df: DataFrame, features, label: str, k: int, steps: int = 100) -> list[Fit]:
    """The k fold models and the full one: L2-penalised logistic regression with C = 1 on features standardised inside
    each training set, intercept not penalised.

    All models take their Newton steps together, so a fit is about ten passes over the data whatever k is. In the
    shared scale g the penalty of a model is half of sum((sigma * beta)^2), with sigma the deviation in its training set.
    A fit that has not settled after `steps` passes is an error.
    """
    rows, mean, scale = _centred(df, features, label)
    d = len(features)
    mu, sigma = _fold_moments(rows, d, k)
    ridge = np.hstack([np.zeros((k + 1, 1)), sigma * sigma])
    beta = damped_newton(lambda b: _newton_pass(rows, b, k), ridge, steps)
    fits = []
    for m in range(k + 1):
        weight = sigma[m] * beta[m, 1:]
        intercept = beta[m, 0] + float((beta[m, 1:] * mu[m]).sum())
        fits.append(Fit(tuple(map(float, mean + scale * mu[m])), tuple(map(float, scale * sigma[m])), tuple(map(float, weight)), float(intercept)))
    return fits


def fold_fits(df: DataFrame, features, label: str, k: int = FOLDS) -> tuple[list[Fit], Fit]:
    """The fit of each fold model and of all rows, for rows whose column `fold` says 0..k-1."""
    *fits, full = _fit_all(df, list(features), label, k)
    return fits, full


def oof_scores(df: DataFrame, features, label: str, id_column: str = "source_id", k: int = FOLDS, seed: int = SEED,
               fold: Column | None = None) -> tuple[DataFrame, Fit]:
    """(rows with `fold` and the out-of-fold probability `score`, the fit on all rows).

    Every row is scored by the model that never saw its fold. The k models become column expressions, so all rows are
    scored in one pass. `fold` (0..k-1) replaces the hashed folds.
    """
    features = list(features)
    sizes = df.agg(F.count_if(F.col(label) == 0).alias("zero"), F.count_if(F.col(label) == 1).alias("one"), F.count("*").alias("n")).first()
    require(sizes["zero"] + sizes["one"] == sizes["n"], "labels must be 0 or 1")
    counts = {0: sizes["zero"], 1: sizes["one"]}
    require(min(counts.get(0, 0), counts.get(1, 0)) >= k, f"need at least {k} rows of each label, have {counts}")
    # About 200,000 rows per hash bucket, so buckets stay small windows at any size.
    buckets = max(1024, sum(counts.values()) // 200_000)
    dealt = assign_folds(df, id_column, label, k, seed, buckets) if fold is None else df.withColumn("fold", fold.cast("int"))
    folded = write_scratch(dealt, "folds")
    fits, full = fold_fits(folded, features, label, k)
    score = F.when(F.col("fold") == 0, fits[0].score(features))
    for i in range(1, k):
        score = score.when(F.col("fold") == i, fits[i].score(features))
    return folded.withColumn("score", score), full


def weights(fit: Fit, features, spark) -> DataFrame:
    """(feature, weight), largest absolute weight first."""
    return by_weight(spark.createDataFrame(list(zip(features, fit.weight)), "feature string, weight double"))


@dataclass
class GapModel:
    metrics: DataFrame  # n_stars, n_hosts, skipped, folds, auc, avg_precision, base_rate
    weights: DataFrame
    candidates: DataFrame  # rows without a known planet, best score first


def planet_gaps(stars: DataFrame, planets: DataFrame, positions: DataFrame | None = None, top: int | None = None,
                features=FEATURES, fold: Column | None = None) -> GapModel:
    """Rank stars without a known planet by how much they look like the hosts, by some or all of the features."""
    require(top is None or top >= 1, "top must be 1 or more")
    spark = stars.sparkSession
    hosts = match_hosts(planets, stars, positions).select("source_id")
    table = write_scratch(label_members(gap_features(stars), "source_id", hosts), "features")
    scored, full = oof_scores(table, list(features), "label", fold=fold)
    scored = write_scratch(scored, "scores")
    m = ranking_metrics(scored, "score", "label")
    total = stars.count()
    metrics = m.select(
        F.col("n").alias("n_stars"), F.col("positives").alias("n_hosts"), (F.lit(total) - F.col("n")).alias("skipped"),
        F.lit(FOLDS).alias("folds"), "auc", "avg_precision", "base_rate")
    shown = scored.filter("label = 0").select(
        "source_id", "pc", "g_mag", F.col("colour").alias("bp_rp"), "abs_g", (F.col("has_rv") == 1).alias("has_rv"), "score", "companion_au")
    return GapModel(metrics, weights(full, list(features), spark), rank_candidates(shown, "score", "source_id", top))
