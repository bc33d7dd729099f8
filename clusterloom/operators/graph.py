"""Connected components of an edge list (J5), and the shared folder in which tables cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shared_folder(spark) -> str:
    """``spark.checkpoint.dir``. Where it is unset: a temporary folder in local mode, an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialise(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage and survives the loss of executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def told_by_size(rows: DataFrame, table: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """``rows`` with the columns of ``table`` (keys, n, ...); entries of more than ``limit`` rows are broadcast, so no task reads all rows of one."""
    small, large = table.filter(F.col("n") <= limit).hint("merge"), table.filter(F.col("n") > limit)
    if not large.head(1):
        return rows.join(small, keys)
    return rows.join(F.broadcast(large), keys).unionByName(rows.join(F.broadcast(large.select(*keys)), keys, "left_anti").join(small, keys))


#: A node with more than this share of all edges (and so many at least) is a hub; there are 2 / HUB_SHARE at most.
HUB_SHARE, HUB_EDGES = 1 / 1000, 1000


def _told(edges: DataFrame, least: DataFrame, limit: int | None) -> DataFrame:
    """``edges`` (u, v) with m, what ``least`` (u, m, n) says of u; rows of hubs (n above ``limit``) stay where they are, as hubs are few."""
    if limit is None:
        return edges.join(least.select("u", "m"), "u")
    hubs = least.filter(F.col("n") > limit).select("u", "m")
    others = least.filter(F.col("n") <= limit).select("u", "m")
    return edges.join(F.broadcast(hubs), "u").unionByName(edges.join(F.broadcast(hubs.select("u")), "u", "left_anti").join(others, "u"))


def _state(pairs: DataFrame) -> tuple[bool, int | None]:
    """Whether all edges are stars, and above which degree nodes are hubs (None without any); one aggregation."""
    ends = pairs.select(F.col("u").alias("node"), F.col("v").alias("m")).unionByName(pairs.select(F.col("v").alias("node"), F.lit(None).cast(pairs.schema["v"].dataType).alias("m")))
    nodes = ends.groupBy("node").agg(F.min("m").alias("lo"), F.max("m").alias("hi"), F.count("m").alias("up"), F.count(F.lit(1)).alias("n"))
    # A node of a star hangs on one node at most, and nothing hangs on a node that hangs on another.
    wrong = (F.col("lo") != F.col("hi")) | ((F.col("up") > 0) & (F.col("n") > F.col("up")))
    r = nodes.agg(F.count_if(wrong).alias("wrong"), F.sum("up").alias("edges"), F.max("n").alias("degree")).first()
    limit = max(HUB_EDGES, int((r.edges or 0) * HUB_SHARE))
    return r.wrong == 0, limit if (r.degree or 0) > limit else None


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 1000) -> DataFrame:
    """node, component (its smallest node) of every node that has an edge; loops name their node.

    Alternating large-star and small-star rounds: each node learns the least of its neighbours, then edges are moved to
    it. The number of rounds grows with the logarithm of the graph. It ends when all edges are stars: each node but the
    least ones hangs on one node, which hangs on none. An error if ``max_rounds`` don't get there. A round is one
    aggregation that tests the edges and one written table.
    """
    pairs = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).filter("u is not null and v is not null").distinct()
    pairs = materialise(pairs, "components")
    loops = pairs.filter("u = v")
    pairs = pairs.filter("u <> v")
    for _ in range(max_rounds):
        stars, limit = _state(pairs)
        if stars:
            break
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        # Large star: a node's larger neighbours now hang on the least it knows. No node gains edges, so ``limit`` holds.
        large = _told(both.filter("v > u"), least, limit).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: a node and its smaller neighbours hang on the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = _told(large, least, limit).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u <> v")
        pairs = materialise(small.distinct(), "components")
    else:
        raise RuntimeError(f"components are not whole after {max_rounds} rounds")
    # A node of a loop alone is its own component; others have their place in the stars.
    rows = pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    return rows.unionByName(loops.select(F.col("u").alias("node"), F.col("u").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
