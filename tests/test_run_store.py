import os
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest

from clusterloom.operators import run_statistics
from clusterloom.sources import run_store

SCHEMA = "experiment_id string, dataset string, started_at string, ari double"


def runs(spark, *ids):
    return spark.createDataFrame([(i, "d x", "2026-01-01 00:00:00", 0.5) for i in ids], SCHEMA)


def ids(spark, root):
    return sorted((r.experiment_id, r.run_id, r.version) for r in run_store.read_runs(spark, root, SCHEMA).collect())


def test_appends_of_one_second_have_ids_of_their_own(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    assert ids(spark, root) == []
    assert run_store.append(runs(spark, "b", "a"), root) == 1
    first = ids(spark, root)
    assert run_store.append(runs(spark, "0"), root) == 2
    assert ids(spark, root) == [("0", "20260101_000000_d_x_3", 2), *first] and first == [("a", "20260101_000000_d_x", 1), ("b", "20260101_000000_d_x_2", 1)]


def test_what_a_dead_writer_left_is_not_seen(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    run_store.append(runs(spark, "a"), root)
    run_store.stage(runs(spark, "lost"), root)
    open(f"{tmp_path}/store/_versions/000000002.json", "w").close()  # claimed, never finished
    assert [r[0] for r in ids(spark, root)] == ["a"]
    assert run_store.append(runs(spark, "b"), root) == 3
    assert [r[0] for r in ids(spark, root)] == ["a", "b"]


def test_writers_at_once_each_get_a_version(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    folders = [run_store.stage(runs(spark, str(i)), root) for i in range(6)]
    with ThreadPoolExecutor(6) as pool:
        versions = list(pool.map(lambda f: run_store.publish(spark, root, f), folders))
    assert sorted(versions) == [1, 2, 3, 4, 5, 6] and len(os.listdir(f"{tmp_path}/store/_versions")) >= 6
    assert len({r[1] for r in ids(spark, root)}) == 6


def test_draws_are_those_of_resampling(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0.2, 1.0, 400)
    rows = spark.createDataFrame([("d", "s", int(i), None, name, float(v) if name == "a" else 0.0) for i, v in enumerate(x) for name in "ab"], "dataset string, scenario string, seed int, partition_fingerprint string, algorithm string, ari double")
    r = run_statistics.paired_bootstrap(rows, "a", "b").first()
    means = x[rng.integers(0, 400, (5000, 400))].mean(axis=1)
    low, high = np.percentile(means, [2.5, 97.5])
    assert r.n_pairs == 400 and r.mean == pytest.approx(x.mean()) and r.sd == pytest.approx(x.std(ddof=1)) and r.fraction_positive == pytest.approx((x > 0).mean())
    assert r.ci_low == pytest.approx(low, abs=0.01) and r.ci_high == pytest.approx(high, abs=0.01)
    constant = rows.withColumn("ari", rows.algorithm.isin("a").cast("double") * 0.1)
    same = run_statistics.paired_bootstrap(constant, "a", "b").first()
    assert (same.ci_low, same.ci_high) == (pytest.approx(0.1), pytest.approx(0.1))
    assert run_statistics.paired_bootstrap(rows.limit(0), "a", "b").count() == 0


def test_counts_follow_the_poisson_distribution(spark):
    from pyspark.sql import functions as F

    grid = spark.range(200).select(((F.col("id") * 1_000_003) % run_statistics.PLACES).alias("row"), F.explode(F.sequence(F.lit(0), F.lit(999))).alias("draw"))
    place = run_statistics.mixed_place(F.col("row"), F.col("draw").cast("bigint"), 2026)
    times = sum((F.col("place") >= p).cast("int") for p in run_statistics.poisson_places())
    drawn = grid.withColumn("place", place).withColumn("times", times)
    t = drawn.agg(F.avg("times").alias("mean"), F.var_pop("times").alias("var")).first()
    assert t["mean"] == pytest.approx(1, abs=0.02) and t["var"] == pytest.approx(1, abs=0.03)
    # Rows are drawn by themselves: sums over a draw vary as sums of so many Poisson counts do.
    by_draw = drawn.groupBy("draw").agg(F.sum("times").alias("s")).agg(F.var_pop("s")).first()[0]
    assert by_draw == pytest.approx(200, rel=0.25)


def test_no_shuffle_by_append(spark, tmp_path):
    """All rows of an append went to the task of its folder."""
    root = f"file://{tmp_path}/store"
    rows = spark.createDataFrame([(str(i), "2026-01-01 00:00:00", "d") for i in range(5)], "experiment_id string, started_at string, dataset string")
    run_store.append(rows, root)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        read = run_store.read_runs(spark, root, rows.schema)
        assert "SortMergeJoin" not in read._jdf.queryExecution().executedPlan().toString()
        assert read.count() == 5
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
