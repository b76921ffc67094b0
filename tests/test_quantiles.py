from __future__ import annotations

import numpy as np
import pytest

from voxcohort.operators import quantiles, summary


@pytest.mark.parametrize("most", [50, 1000, 10**6])
def test_against_arrays(spark, most):
    """One group of nearly all rows, one value that a third of all rows share, groups of one and two rows, a null group."""
    rng = np.random.default_rng(1)
    big = np.concatenate((rng.normal(size=4000), np.full(3000, 0.25), rng.integers(0, 5, 2000))).tolist()
    rows = [("big", float(v)) for v in big] + [("one", 7.0), ("two", 1.0), ("two", 4.0), (None, -1.0), (None, 3.0), (None, 3.0), ("no", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    shares = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0)
    got = {r.g: (r.total, r.q) for r in quantiles.percentiles(summary.value_table(df, ["g"], "v"), ["g"], shares, most).collect()}
    assert set(got) == {"big", "one", "two", None}
    for g in got:
        values = [v for k, v in rows if k == g]
        assert got[g][0] == len(values)
        assert np.allclose(got[g][1], np.quantile(values, shares), rtol=1e-12)


def test_no_group_and_empty(spark):
    df = spark.range(100_001).selectExpr("cast(id * 7919 % 100001 AS double) AS v")
    counts = summary.value_table(df, [], "v")
    assert quantiles.percentiles(counts, [], [0.5, 0.333], 500).first().q == [50_000.0, pytest.approx(33_300.0)]
    assert quantiles.percentiles(counts.limit(0).selectExpr("'a' AS g", "v", "n"), ["g"], [0.5]).count() == 0


def test_no_task_sorts_a_group(spark, monkeypatch):
    """What is left to be sorted at the end has at most so many values a piece."""
    seen = []
    real = quantiles.stored

    def spy(df, name):
        out = real(df, name)
        if name == "quantile-pieces":
            seen.append(out.agg({"_m": "max"}).first()[0])
        return out

    monkeypatch.setattr(quantiles, "stored", spy)
    counts = spark.range(50_000).selectExpr("cast(sqrt(id) AS double) AS v", "1L AS n")
    quantiles.percentiles(counts, [], [0.5], 200).collect()
    assert seen and seen[-1] <= 200
