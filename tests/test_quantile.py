"""Exact quantiles without a task that holds the values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from phasorlake import plans
from phasorlake.operators import change, textual


@pytest.mark.parametrize("q", [0.0, 0.3, 0.5, 0.95, 1.0])
def test_quantile(spark, q):
    r = np.random.default_rng(1)
    for x in (r.normal(size=997), r.integers(0, 4, 1000) / 7, np.r_[1e300, r.normal(size=50)], np.full(9, 0.1), np.array([3.0])):
        df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double")
        want = df.agg(F.percentile("v", F.lit(q))).first()[0]
        assert plans.quantile(df, "v", q, 5, 8) == want and plans.quantile(df, "v", q) == want
    assert plans.quantile(df.filter("false"), "v", q) is None


def refuse(*_):
    raise AssertionError("a task would hold all values")


def test_calibration_holds_no_values(spark, monkeypatch):
    """F1: the two quantiles of all scores are not made by one task."""
    monkeypatch.setattr(F, "percentile", refuse)
    rows = [(q, c / 100) for q in range(7) for c in range(q, q + 30)] + [(9, 0.5)]
    got = textual.calibration(spark.createDataFrame(rows, "q int, s double"), "q", "s").first()
    best = {q: max(s for p, s in rows if p == q) for q, _ in rows}
    noise = np.quantile([s for q, s in rows if s < best[q]], 0.95)
    assert np.allclose(list(got), [min(best.values()), np.median(list(best.values())), noise, (min(best.values()) + noise) / 2])


def test_null_threshold_holds_no_values(spark, monkeypatch):
    """the quantile of the pooled maps is not made by one task."""
    monkeypatch.setattr(F, "percentile", refuse)
    x = np.random.default_rng(2).normal(size=300)
    maps = [spark.createDataFrame([(float(v),) for v in part], "v double") for part in np.split(x, 3)]
    assert np.isclose(change.null_threshold(maps, "v", 0.9).first().threshold, np.quantile(np.abs(x), 0.9), rtol=1e-14)
