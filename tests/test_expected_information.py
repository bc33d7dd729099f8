import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from clusterloom.operators import metrics


def plain(a, b):
    """Every term of every pair of sizes."""
    n, lg, out = sum(a), lambda v: math.lgamma(v + 1), 0.0
    for x in a:
        for y in b:
            for m in range(max(1, x + y - n), min(x, y) + 1):
                p = lg(x) + lg(y) + lg(n - x) + lg(n - y) - lg(n) - lg(m) - lg(x - m) - lg(y - m) - lg(n - x - y + m)
                out += m / n * math.log(n * m / (x * y)) * math.exp(p)
    return out


def contingency(spark, groups):
    rows = [(g, int(i), int(j), 1) for g, (label, cluster) in groups.items() for i, j in zip(label, cluster, strict=True)]
    return spark.createDataFrame(rows, "g string, label int, cluster int, n bigint").groupBy("g", "label", "cluster").agg(F.sum("n").alias("n"))


@pytest.mark.parametrize("series", [metrics.SERIES, 7])
def test_against_all_terms(spark, series):
    rng = np.random.default_rng(4)
    groups = {"mixed": (rng.integers(0, 6, 500), rng.integers(0, 9, 500)), "skewed": (rng.geometric(0.5, 800), rng.geometric(0.3, 800)), "one": ([0] * 30, rng.integers(0, 3, 30)), "single": ([1], [2])}
    got = {r.g: r.e for r in metrics.expected_mi(contingency(spark, groups), ["g"], series).collect()}
    for g, (label, cluster) in groups.items():
        want = plain(np.unique(label, return_counts=True)[1].tolist(), np.unique(cluster, return_counts=True)[1].tolist())
        assert got[g] == pytest.approx(want, rel=1e-9, abs=1e-12)


def test_large_sizes_and_no_python_worker(spark):
    cont = spark.createDataFrame([(0, 0, 40_000_000), (0, 1, 10_000_000), (1, 0, 20_000_000), (1, 1, 30_000_000)], "label int, cluster int, n bigint")
    e = metrics.expected_mi(cont)
    # For large sizes the expectation tends to (classes - 1)(clusters - 1) / 2n.
    assert e.first().e == pytest.approx(1 / (2 * 100_000_000), rel=0.05)
    plan = metrics.ami(cont)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_same_labels_and_trivial_ones(spark):
    same = contingency(spark, {"g": ([0, 0, 1, 1, 2, 2], [5, 5, 3, 3, 4, 4]), "h": ([0] * 4, [1] * 4)})
    assert {r.g: r.ami for r in metrics.ami(same, ["g"]).collect()} == {"g": pytest.approx(1.0), "h": 1.0}
