"""Exact quantiles of whole columns that no task sees whole."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.operators import stats


@pytest.mark.parametrize("most", [1, 50, 100_000])
def test_quantiles_against_numpy(spark, most):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=3000), 2)
    y = np.where(rng.random(3000) < 0.9, 7.0, x)
    rows = [(float(a), float(b), None) for a, b in zip(x, y, strict=True)] + [(None, None, None)]
    df = spark.createDataFrame(rows, "x double, y double, z double").repartition(3)
    points = [0.0, 0.001, 0.15, 0.5, 0.999, 1.0]
    got = stats.exact_quantiles(df, {"x": points, "y": [0.001, 0.5], "z": [0.5]}, accuracy=100, most=most)
    assert got["x"] == pytest.approx(np.quantile(x, points)) and got["y"] == pytest.approx(np.quantile(y, [0.001, 0.5])) and got["z"] == [None]


def test_bounds_keep_no_map_of_all_values(spark):
    plan = stats.robust_bounds(spark.range(100).select(F.col("id").cast("double").alias("x")), ["x"])._jdf.queryExecution().toString()
    assert "percentile(" not in plan
