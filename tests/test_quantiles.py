"""Quantiles that narrow intervals, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from clusterloom import queries
from clusterloom.operators.quantiles import quantiles


@pytest.mark.parametrize("kind", ["spread", "few", "heavy", "one", "none"])
def test_against_numpy(spark, kind):
    rng = np.random.default_rng(3)
    x = {"spread": rng.normal(size=5000), "few": rng.integers(0, 3, 4000) / 1.0, "heavy": np.concatenate([np.zeros(3000), rng.random(1000)]), "one": np.array([4.5]), "none": np.array([])}[kind]
    rows = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double")
    shares = [0.0, 0.05, 0.2, 0.5, 0.77, 0.95, 1.0]
    got = quantiles(rows, "v", shares, held=50)
    assert got == ([None] * 7 if kind == "none" else pytest.approx(np.quantile(x, shares).tolist(), abs=1e-12))
    if len(x):
        assert got == rows.agg(F.percentile("v", F.array(*[F.lit(q) for q in shares])).alias("q")).first().q


def test_no_aggregate_holds_all_values(spark, sf_dir):
    plan = queries.QUERIES["z5_quantiles"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in plan
