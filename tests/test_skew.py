"""Steps in which one class, file or cluster must not bring all rows into one task."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from clusterloom.operators import metrics, rounds
from clusterloom.sources import points as sources


@pytest.fixture
def no_automatic_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_stay_where_they_are_when_they_get_classes_and_places(spark, sf_dir, no_automatic_broadcast):
    for rows in (sources.read_line_items(spark, f"{sf_dir}/lineitem.parquet"), sources.from_table(spark, f"{sf_dir}/orders.parquet", "o_orderkey", ["o_totalprice"], "o_orderpriority")):
        assert "SortMergeJoin" not in plan(rows) and "ShuffledHashJoin" not in plan(rows)


def test_classes_beyond_the_bound(spark, monkeypatch):
    rows = spark.createDataFrame([(i, None if i == 3 else f"c{i % 5}") for i in range(40)], "sample_id bigint, y string")
    want = {r.sample_id: r.label for r in sources.class_codes(rows, "y").collect()}
    assert want == {i: None if i == 3 else i % 5 for i in range(40)}
    monkeypatch.setattr(sources, "CLASSES", 3)
    assert {r.sample_id: r.label for r in sources.class_codes(rows, "y").collect()} == want


def test_start_report_counts_without_ranks(spark):
    rows = spark.range(50).select(F.col("id").alias("sample_id"), F.when(F.col("id") < 2, 7).otherwise(1).alias("client_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("features"))
    made = rounds.init_report(rows, 3, 42)
    assert "Window" not in plan(made)
    assert sorted(tuple(r) for r in made.collect()) == [(1, 3, 96), (7, 2, 64)]


def test_no_shuffle_by_cluster_brings_a_cluster_together(spark, no_automatic_broadcast):
    """All rows but a few are one cluster's."""
    rows = spark.range(300).select(F.when(F.col("id") < 290, 0).otherwise(F.col("id")).alias("cluster"), F.array(F.col("id") / 1.0, (F.col("id") % 7) / 1.0).alias("features"))
    centers = metrics.centroids(rows)
    whole, some = metrics.with_centers(rows, centers), metrics.with_centers(rows, centers, hubs=4)
    assert "BroadcastHashJoin" in plan(whole) and "SortMergeJoin" not in plan(whole)
    told = lambda df: sorted((r.cluster, tuple(r.features), tuple(r.center)) for r in df.collect())
    assert told(whole) == told(some) == told(rows.join(centers, "cluster"))
    small = [r for r in metrics.with_centers(rows, centers, hubs=4).filter("cluster > 0").collect()]
    assert len(small) == 10


def test_matched_control_is_scored_without_a_shuffle_by_cluster(spark, monkeypatch, no_automatic_broadcast):
    """Three clusters of unlike sizes, as the control has them."""
    rows = spark.range(90).select(F.col("id").alias("sample_id"), F.when(F.col("id") < 80, 0).otherwise(F.col("id") % 3).cast("int").alias("cluster"), F.array(F.col("id") / 1.0, F.col("id") % 5 / 1.0).alias("features"))
    made = []
    own = metrics.with_centers
    monkeypatch.setattr(metrics, "with_centers", lambda *a: made.append(own(*a)) or made[-1])
    assert metrics.davies_bouldin(rows).first()[0] > 0
    assert len(made) == 1 and "SortMergeJoin" not in plan(made[0])


def test_rows_of_one_group_are_stepped_by_many_tasks(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.1, (2000, 2)) for c in (0, 5, 10)])
    spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "sample_id bigint, features array<double>").coalesce(1).write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    dealt = rounds.spread(rows.select("features"))
    sizes = [r.n for r in dealt.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) == 4 and max(sizes) < 2000
    result = rounds.kmeans(rows, 3, n_init=2)
    assert sorted(np.round(c[0]) for c in result.model["centers"]) == [0, 5, 10]
    labels, d2 = rounds.nearest(np.zeros((3000, 2)), np.array([[1.0, 0.0], [0.0, 0.0], [0.0, 0.0]]))
    assert (labels == 1).all() and (d2 == 0).all()
