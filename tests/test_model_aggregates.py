import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.operators.aggregates import average_precision, group_stats, median_of, ranking_metrics, roc_auc, worst_severity
from strata.operators.topk import top_k
from strata.plans import model
from tests.conftest import star_frame


@pytest.mark.parametrize("n", [0, 1, 2, 9, 10, 5001])
def test_exact_median(spark, n):
    r = random.Random(n)
    xs = [round(r.gauss(0, 5), 1) for _ in range(n)]
    row = median_of(spark.createDataFrame([(x,) for x in xs + [None]], "x double"), "x").first()
    assert row["n"] == n and (row["median"] is None if not n else math.isclose(row["median"], float(np.median(xs)), abs_tol=1e-12))


def test_exact_median_per_group_with_a_hot_group_and_a_null_group(spark):
    r = random.Random(3)
    rows = [(g, round(r.random() * 100, 1)) for g in (None, 1, 2, 3) for _ in range(37 if g != 2 else 3000)]
    got = {q["g"]: q["median"] for q in median_of(spark.createDataFrame(rows, "g int, x double"), "x", ["g"]).collect()}
    assert got == {g: pytest.approx(float(np.median([x for k, x in rows if k == g]))) for g in (None, 1, 2, 3)}
    approx = median_of(spark.createDataFrame(rows, "g int, x double"), "x", "g", approx=True)
    assert approx.count() == 4


@pytest.mark.parametrize("few", [3, 200])
def test_brackets_of_large_groups_narrow_to_the_exact_median(spark, monkeypatch, few):
    """Ties, infinities, NaN and -0.0 in groups of which one holds nine tenths of all rows, against Spark's own median."""
    from strata.operators import aggregates

    monkeypatch.setattr(aggregates, "FEW_ROWS", few)
    monkeypatch.setattr(aggregates, "SLACK", 0.05)
    r = random.Random(few)
    odd = [float("nan"), float("inf"), float("-inf"), -0.0, 0.0]
    rows = [("hot", r.gauss(0, 3)) for _ in range(9000)] + [("ties", r.choice([1.0, 2.0, 2.0, 2.0, 3.0])) for _ in range(500)]
    rows += [("one", 7.5)] * 400 + [("odd", r.choice([*odd, r.random()])) for _ in range(300)] + [(None, float(i)) for i in range(201)] + [("none", None)] * 5
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    want = {q["g"]: (q["n"], q["m"]) for q in df.groupBy("g").agg(F.count("x").alias("n"), F.median("x").alias("m")).collect() if q["n"]}
    rounds = []
    real = aggregates.write_scratch
    monkeypatch.setattr(aggregates, "write_scratch", lambda d, label: rounds.append(label) or real(d, label))
    got = {q["g"]: (q["n"], q["median"]) for q in median_of(df, "x", "g").collect()}
    assert set(got) == set(want)
    for g, (n, m) in want.items():
        assert got[g][0] == n and (got[g][1] == m or math.isnan(got[g][1]) and math.isnan(m))
    assert len(rounds) >= 2  # the first sketch alone was not enough


def test_ranking_metrics_against_the_definition(spark):
    r = random.Random(1)
    rows = [(round(r.random(), 2), int(r.random() < 0.3)) for _ in range(700)]
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    auc = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    ap, seen, hits = 0.0, 0, 0
    for score in sorted({s for s, _ in rows}, reverse=True):
        here = [y for s, y in rows if s == score]
        seen, hits = seen + len(here), hits + sum(here)
        ap += sum(here) / len(pos) * hits / seen
    df = spark.createDataFrame(rows, "score double, y int")
    for buckets in (4, 256):
        m = ranking_metrics(df, "score", "y", buckets).first()
        assert math.isclose(m["auc"], auc, abs_tol=1e-12) and math.isclose(m["avg_precision"], ap, abs_tol=1e-12)
        assert (m["n"], m["positives"]) == (700, len(pos))
    assert math.isclose(roc_auc(df, "score", "y"), auc) and math.isclose(average_precision(df, "score", "y"), ap)
    one = ranking_metrics(spark.createDataFrame([(0.5, 1), (0.5, 0)], "score double, y int"), "score", "y").first()
    assert (one["auc"], one["avg_precision"]) == (0.5, 0.5)


def test_small_aggregates(spark):
    df = spark.createDataFrame([("error", 0), ("warning", 3)], "severity string, flagged bigint")
    assert tuple(worst_severity(df).first()) == (0, 1, 1)
    assert tuple(worst_severity(df.withColumn("flagged", df.flagged + 1)).first()) == (1, 1, 2)
    with pytest.raises(ValueError):
        group_stats(df, ["severity"], {"x": ("flagged", "mode")})
    with pytest.raises(ValueError):
        top_k(df, "flagged", 0)


def sky(spark, n=400):
    """Near bright stars host planets."""
    r = random.Random(8)
    stars, known = [], []
    for i in range(n):
        near = r.random() < 0.25
        stars.append(dict(source_id=i, ra=r.random() * 360, dec=r.uniform(-80, 80), parallax=r.uniform(80, 200) if near else r.uniform(20, 60), parallax_error=0.05,
                          phot_g_mean_mag=r.uniform(4, 7) if near else r.uniform(9, 14), bp_rp=None if i % 11 == 0 else r.uniform(0.5, 3), pmra=1.0, pmdec=1.0,
                          radial_velocity=1.0 if near or r.random() < 0.3 else None))
        if near and r.random() < 0.6:
            known.append((f"p{i}", "h", f"Gaia DR3 {i}"))
    stars += [dict(source_id=n, parallax=50.0), dict(source_id=n + 1, phot_g_mean_mag=5.0, parallax=-1.0)]
    return star_frame(spark, *stars), spark.createDataFrame(known, "pl_name string, hostname string, gaia_dr3_id string")


def test_gap_model_end_to_end(spark):
    stars, known = sky(spark)
    result = model.planet_gaps(stars, known, top=20)
    m = result.metrics.first()
    assert (m["n_stars"], m["n_hosts"], m["skipped"], m["folds"]) == (400, known.count(), 2, 5)
    assert m["auc"] > 0.8 and m["avg_precision"] > m["base_rate"]
    w = {r["feature"]: r["weight"] for r in result.weights.collect()}
    assert set(w) == set(model.FEATURES) and list(map(abs, w.values())) == sorted(map(abs, w.values()), reverse=True)
    rows = result.candidates.collect()
    hosts = {int(r["gaia_dr3_id"].split()[-1]) for r in known.collect()}
    assert len(rows) == 20 and not hosts & {r["source_id"] for r in rows}
    assert [(-r["score"], r["source_id"]) for r in rows] == sorted((-r["score"], r["source_id"]) for r in rows)
    again = model.planet_gaps(stars.orderBy("ra"), known, top=20).candidates.collect()
    assert [r["source_id"] for r in again] == [r["source_id"] for r in rows]
    with pytest.raises(ValueError, match="at least 5"):
        model.planet_gaps(stars, known.limit(3))


def test_scores_are_out_of_fold_and_equal_the_penalised_optimum(spark):
    rng = np.random.default_rng(0)
    n = 600
    x = np.column_stack([rng.normal(5, 2, n), rng.normal(size=n) * 0.1, np.full(n, 3.0), (rng.random(n) > 0.8).astype(float)])
    y = (rng.random(n) < 1 / (1 + np.exp(-(x[:, 0] - 6)))).astype(int)
    df = spark.createDataFrame([(i, *map(float, x[i]), int(y[i])) for i in range(n)], "source_id int, a double, b double, c double, d double, label int")
    scored, full = model.oof_scores(df, ["a", "b", "c", "d"], "label")
    rows = sorted(scored.collect(), key=lambda r: r["source_id"])
    fold, score = np.array([r["fold"] for r in rows]), np.array([r["score"] for r in rows])

    def optimum(part):
        mean, scale = x[part].mean(0), x[part].std(0)
        scale[scale < 1e-12] = 1
        z = np.hstack([np.ones((part.sum(), 1)), (x[part] - mean) / scale])
        w, ridge = np.zeros(5), np.diag([0, 1, 1, 1, 1])
        for _ in range(60):
            p = 1 / (1 + np.exp(-z @ w))
            w = w + np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + ridge, z.T @ (y[part] - p) - ridge @ w)
        return mean, scale, w

    for f in range(5):
        mean, scale, w = optimum(fold != f)
        here = fold == f
        assert np.allclose(score[here], 1 / (1 + np.exp(-(w[0] + (x[here] - mean) / scale @ w[1:]))), atol=1e-9)
        for label in (0, 1):
            assert abs((here & (y == label)).sum() - (y == label).sum() / 5) < 1
    assert np.allclose(full.weight, optimum(np.ones(n, bool))[2][1:], atol=1e-9)


def test_features(spark):
    stars = star_frame(spark, dict(source_id=1, parallax=10.0, phot_g_mean_mag=5.0, bp_rp=1.2), dict(source_id=2, parallax=100.0, phot_g_mean_mag=6.0, bp_rp=None, radial_velocity=3.0),
                       dict(source_id=3, parallax=1000.0, phot_g_mean_mag=7.0, bp_rp=2.0), dict(source_id=4, parallax=5.0))
    near = spark.createDataFrame([(1, 1000.0), (2, 999.9)], "source_id bigint, au double")
    rows = model.gap_features(stars, near).orderBy("source_id").collect()
    assert [round(r["log10_distance_pc"], 9) for r in rows] == [2, 1, 0]
    assert [r["bp_rp"] for r in rows] == [1.2, 1.6, 2.0] and [r["no_colour"] for r in rows] == [0, 1, 0]
    assert [r["has_companion"] for r in rows] == [0, 1, 0] and [r["has_rv"] for r in rows] == [0, 1, 0]
    assert [r["abs_g"] for r in rows] == [0.0, 6.0, 12.0]


def test_damped_steps_halve_from_the_last_good_point():
    """On log(cosh(x)) a Newton step from 2 overshoots so far that it has to be halved twice in a row."""
    tried = []

    def evaluate(x):
        tried.append(x[0, 0])
        t = np.tanh(x)
        return np.log(np.cosh(x)).sum(axis=1), -t, (1 - t * t)[:, :, None]

    found = model.damped_newton(evaluate, np.zeros((1, 1)), start=np.array([[2.0]]))
    assert abs(found[0, 0]) < 1e-9
    overshoot = tried[1] - tried[0]
    halvings = [(t - tried[0]) / overshoot for t in tried[1:4]]
    assert halvings == pytest.approx([1, 0.5, 0.25])
    with pytest.raises(RuntimeError, match="not settled after 3"):
        model.damped_newton(evaluate, np.zeros((1, 1)), steps=3, start=np.array([[2.0]]))


def test_weights_equal_a_direct_minimiser(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 2)) * [3.0, 0.2] + [1.0, 5.0]
    y = (rng.random(300) < 1 / (1 + np.exp(-(x[:, 0] - 1) + 4 * (x[:, 1] - 5)))).astype(int)
    df = spark.createDataFrame([(i, float(a), float(b), int(c)) for i, ((a, b), c) in enumerate(zip(x, y))], "source_id long, a double, b double, label int")
    _, fit = model.oof_scores(df, ["a", "b"], "label")
    z = np.hstack([np.ones((300, 1)), (x - x.mean(axis=0)) / x.std(axis=0)])
    w = np.array([fit.intercept, *fit.weight])
    gradient = z.T @ (y - 1 / (1 + np.exp(-z @ w))) - [0.0, *fit.weight]
    assert np.abs(gradient).max() < 1e-6


def test_fits_equal_mllib(spark):
    """The fold models and the full one against MLlib's logistic regression on the same standardised training sets."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.sql import functions as F

    rng = np.random.default_rng(12)
    x = rng.normal(size=(600, 3)) * [1.0, 20.0, 0.1] + [0.0, 300.0, -2.0]
    y = (rng.random(600) < 1 / (1 + np.exp(-(x[:, 0] * 1.5 - (x[:, 1] - 300) / 30 - 0.5)))).astype(int)
    df = spark.createDataFrame([(i, int(t), i % 5, *map(float, v)) for i, (t, v) in enumerate(zip(y, x))], "source_id long, label int, fold int, a double, b double, c double").cache()
    names = ["a", "b", "c"]
    fits, full = model.fold_fits(df, names, "label")
    for m, fit in enumerate([*fits, full]):
        rows = df.filter(F.col("fold") != m)
        moments = rows.agg(*[f(n) for n in names for f in (F.avg, F.stddev_pop)]).first()
        assert np.allclose(fit.mean, moments[0::2], rtol=1e-9) and np.allclose(fit.scale, moments[1::2], rtol=1e-9)
        z = rows.select("label", *[((F.col(n) - F.lit(mu)) / F.lit(sd)).alias(n) for n, mu, sd in zip(names, moments[0::2], moments[1::2])])
        learner = LogisticRegression(labelCol="label", regParam=1.0 / rows.count(), elasticNetParam=0.0, standardization=False, tol=1e-14, maxIter=500)
        learned = learner.fit(VectorAssembler(inputCols=names, outputCol="features").transform(z))
        assert np.allclose(fit.weight, learned.coefficients.toArray(), rtol=0, atol=1e-6) and abs(fit.intercept - learned.intercept) < 1e-6
