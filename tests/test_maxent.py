"""The maximum entropy fit: its conditions, its independence of the layout, planted responses, odd inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from thalweg.operators import maxent as M


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    a, b = rng.uniform(-2, 8, 3000), rng.uniform(0, 1, 3000)
    here = rng.random(3000) < 0.5 * np.exp(-((a - 3) ** 2)) * b  # likes a near 3 and large b
    data = [(int(h), float(x), float(y), 1.0) for h, x, y in zip(here, a, b, strict=True)]
    data += [(0, float(x), float(y), 1.0) for x, y in zip(a, b, strict=True)] + [(1, None, 0.5, 1.0), (0, 1.0, None, 1.0), (None, 1.0, 1.0, 1.0), (7, 1.0, 1.0, 1.0)]
    return spark.createDataFrame(data, "observed int, a double, b double, same double")


@pytest.fixture(scope="module")
def model(rows):
    return M.fit_maxent(rows, "observed", ["a", "b", "same"], knots=4)


def test_conditions_of_the_minimum(rows, model):
    good = rows.where("observed in (0, 1)").dropna().toPandas()
    x = np.array(rows.where("observed in (0, 1)").dropna().select(F.array(*[M.feature(model.ranges, f) for f in model.features]).alias("x")).toPandas()["x"].tolist())
    y = good["observed"].to_numpy(float)
    w, n = np.where(y == 1, 1.0, 100.0), y.sum()
    p = 1 / (1 + np.exp(-(x @ model.weights + model.intercept)))
    slope = x.T @ (w * (p - y)) / n
    penalty = np.maximum(x[y == 1].std(axis=0), 0.1) / np.sqrt(n)
    on = model.weights != 0
    assert on.any() and not on.all()
    assert np.abs(slope[on] + penalty[on] * np.sign(model.weights[on])).max() < 1e-6
    assert (np.abs(slope[~on]) <= penalty[~on] + 1e-6).all()
    assert abs((w * (p - y)).sum() / n) < 1e-6
    assert set(model.ranges) == {"a", "b"} and len(model.features) == 2 * (2 + 8) + 1


def test_the_layout_does_not_matter(rows, model):
    for parts in (1, 16):
        again = M.fit_maxent(rows.repartition(parts), "observed", ["a", "b", "same"], knots=4)
        assert np.allclose(again.weights, model.weights, atol=1e-7) and abs(again.alpha - model.alpha) < 1e-7


def test_planted_response(spark, rows, model):
    grid = spark.createDataFrame([(3.0, 0.9), (3.0, 0.1), (-1.5, 0.9), (7.5, 0.9), (99.0, 0.9), (None, 0.5)], "a double, b double")
    best, low_b, left, right, beyond, none = [r["suitability"] for r in M.predict_maxent(grid, model).collect()]
    assert none is None and 0 <= min(low_b, left, right) and best <= 1
    assert best > 2 * low_b and best > 5 * left and best > 5 * right
    assert beyond == pytest.approx(M.predict_maxent(grid.limit(1).withColumn("a", F.lit(8.0)), model).first()["suitability"], abs=1e-3)
    raw = M.predict_maxent(rows.where("observed = 0").dropna(), model, "raw").agg(F.sum("suitability")).first()[0]
    assert raw == pytest.approx(1)
    link, logistic = (M.predict_maxent(grid.limit(1), model, k).first()["suitability"] for k in ("link", "logistic"))
    assert logistic == pytest.approx(1 / (1 + np.exp(-(link + model.alpha + model.entropy))))


def test_odd_tables(spark, rows):
    for some in (rows.where("observed = 1"), rows.where("observed = 0"), rows.limit(0)):
        with pytest.raises(ValueError, match="both"):
            M.fit_maxent(some, "observed", ["a"])
    flat = M.fit_maxent(rows, "observed", ["same"])
    assert flat.features == [] and M.predict_maxent(rows.where("observed = 0").limit(1), flat, "raw").first()["suitability"] == pytest.approx(1 / rows.where("observed = 0").count())
