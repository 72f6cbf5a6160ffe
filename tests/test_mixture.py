import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketframe.operators import mixture as mx


@pytest.mark.parametrize("family", ["normal", "poisson"])
def test_gradient(family):
    shape = mx.Shape(3, 4, 2, family)
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(7, 3)), rng.poisson(3, 7).astype(float)
    theta = shape.first(1)
    loss, g = mx.loss_and_gradient(shape, theta, x, y)
    for i in rng.choice(len(theta), 25, replace=False):
        e = np.zeros_like(theta)
        e[i] = 1e-6
        slope = (mx.loss_and_gradient(shape, theta + e, x, y)[0] - mx.loss_and_gradient(shape, theta - e, x, y)[0]) / 2e-6
        assert g[i] == pytest.approx(slope, rel=1e-4, abs=1e-5)
    assert loss == pytest.approx(mx.loss_and_gradient(shape, theta, x, y, gradient=False)[0])


def frame(spark, n=300, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2))
    y = np.where(x[:, 0] > 0, 3.0, -3.0) + rng.normal(size=n) * 0.5
    return spark.createDataFrame([(i, list(map(float, a)), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "key bigint, features array<double>, y double")


def test_fit_recovers(spark):
    df = frame(spark)
    shape = mx.Shape(2, 6, 2)
    fitted = mx.fit(df, shape, epochs=60, rate=0.05)
    losses = [h["train"][0] for h in fitted.history]
    assert losses[-1] < losses[0] - 0.5
    got = mx.scored(df, fitted).toPandas()
    assert np.abs(got.pred - got.y).mean() < 1.0
    again = mx.fit(df, shape, epochs=2, rate=0.05)
    assert again.history[1]["train"][0] == pytest.approx(losses[1])


def test_early_stop_and_kfold(spark):
    df = frame(spark, 120)
    shape = mx.Shape(2, 4, 2)
    fitted, metrics = mx.kfold(df, shape, "key", k=3, epochs=6, patience=2, rate=0.05)
    assert len(fitted.thetas) == 3 and metrics.count() == 3
    best = [min(h["validation"].get(j, math.inf) for h in fitted.history) for j in range(3)]
    own = {r.fold: r.nll for r in metrics.collect()}
    assert all(own[j] == pytest.approx(best[j], rel=1e-6) for j in range(3))
    out = mx.ensemble_scores(df, fitted, "key")
    assert out.count() == 120
    each = mx.scored(df.where("key = 5"), fitted).toPandas()
    assert out.where("key = 5").first().pred == pytest.approx(each.pred.mean())
    assert mx.averaged_metrics(metrics).first().mae > 0
    with pytest.raises(ValueError):
        mx.scored(df, mx.Fitted(shape, []))


def test_stops_when_worse(spark):
    df = frame(spark, 60).withColumn("fold", (F.col("key") % 2).cast("int"))
    fitted = mx.fit(df, mx.Shape(2, 3, 2), fold="fold", epochs=30, patience=1, rate=5.0)
    assert len(fitted.history) < 30


def test_poisson_and_table(spark, tmp_path):
    df = spark.createDataFrame([(i, [float(i % 3)], float(i % 3 * 2)) for i in range(60)], "key bigint, features array<double>, y double")
    fitted = mx.fit(df, mx.Shape(1, 3, 2, "poisson"), epochs=10, rate=0.05)
    assert fitted.history[-1]["train"][0] < fitted.history[0]["train"][0]
    mx.save(spark, fitted, str(tmp_path / "m"))
    back = mx.load(spark, str(tmp_path / "m"))
    assert back.shape == fitted.shape and np.allclose(back.thetas[0], fitted.thetas[0])
    with pytest.raises(FileNotFoundError):
        mx.load(spark, str(tmp_path / "none"))
    scored = mx.as_normal(mx.scored(df, fitted)).first()
    assert scored.scales == pytest.approx([math.sqrt(m) for m in scored.means])


def test_log_prob_matches_numpy(spark):
    df = frame(spark, 20)
    fitted = mx.fit(df, mx.Shape(2, 3, 2), epochs=1)
    got = mx.log_prob(mx.scored(df, fitted), fitted.shape).toPandas()
    x, y = np.stack(got.features), got.y.to_numpy()
    assert -got.log_prob.sum() == pytest.approx(mx.loss_and_gradient(fitted.shape, fitted.thetas[0], x, y)[0])


def test_folds(spark):
    got = mx.folds(spark.range(1000), "id", 5).groupBy("fold").count().collect()
    assert {r.fold for r in got} == {0, 1, 2, 3, 4} and all(140 < r["count"] < 260 for r in got)


def test_local_steps_are_averaged(spark, monkeypatch):
    """Several tasks: each steps over its own rows, and the weighted mean of what they arrive at goes on."""
    df = frame(spark, 300)
    one = mx.fit(df, mx.Shape(2, 4, 2), epochs=3, rate=0.02, batch=5)
    assert [h["steps"][0] for h in one.history] == [60, 60, 60]
    monkeypatch.setattr(mx, "ROWS", 100)
    three = mx.fit(df, mx.Shape(2, 4, 2), epochs=3, rate=0.02, batch=5)
    assert [h["steps"][0] for h in three.history] == [60, 60, 60]
    assert three.history[-1]["train"][0] < three.history[0]["train"][0] - 0.2
    # steps of no size: the average of equal models is the model
    still = mx.fit(df, mx.Shape(2, 4, 2), epochs=2, rate=0.0)
    assert np.allclose(still.thetas[0], mx.Shape(2, 4, 2).first(42))


def test_moments_of_one_component(spark):
    """A normal component without features has the mean and the deviation of the target in closed form."""
    y = np.random.default_rng(8).normal(2.5, 1.7, 500)
    df = spark.createDataFrame([([0.0], float(v)) for v in y], "features array<double>, y double")
    fitted = mx.fit(df, mx.Shape(1, 2, 1), epochs=2, batch=1000, sweeps=600, rate=0.05, anneal=True)
    got = mx.scored(df, fitted).first()
    assert got.means[0] == pytest.approx(y.mean(), abs=1e-3) and got.scales[0] == pytest.approx(y.std(), abs=1e-3)


def test_no_rows(spark):
    df = frame(spark, 5)
    fitted = mx.fit(df.limit(0), mx.Shape(2, 3, 2), epochs=2)
    assert np.allclose(fitted.thetas[0], mx.Shape(2, 3, 2).first(42)) and math.isnan(fitted.history[0]["train"][0])
