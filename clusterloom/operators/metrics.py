"""Scores and diagnostics of clusterings (M1-M19). Undefined metrics are null.

External scores come from the contingency table, one small aggregate; geometry uses assigned rows only. A frame that
holds sample_id, label, cluster (and client_id, features) is scored without any join.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clusterloom.functions.arrays import euclidean, finite, priority
from clusterloom.operators.graph import materialise
from clusterloom.operators.partitioning import fingerprint, hash_rank

SCHEMA_TAG = "clustering_metrics_v3_ami_assigned_only"  # fixed value


def contingency(scored: DataFrame, by: list[str] = ()) -> DataFrame:
    """[by,] label, cluster, n of a frame with both labels."""
    return scored.groupBy(*by, "label", "cluster").agg(F.count(F.lit(1)).alias("n"))


def _margins(cont: DataFrame, by: list[str]) -> DataFrame:
    """Of each group: n, the sums of squares, entropies and the mutual information; counts as doubles, as squares exceed 64 bits."""
    whole = Window.partitionBy(*by)
    rows = cont.withColumn("a", F.sum("n").over(Window.partitionBy(*by, "label"))).withColumn("b", F.sum("n").over(Window.partitionBy(*by, "cluster"))).withColumn("t", F.sum("n").over(whole))
    n, a, b, t = (F.col(c).cast("double") for c in "nabt")
    # Each margin is spread over its cells in proportion, so one aggregate sums cells and margins alike.
    return rows.groupBy(*by).agg(
        F.sum("n").cast("double").alias("n"),
        F.sum(n * n).alias("cells"),
        F.sum(n * a).alias("classes2"),
        F.sum(n * b).alias("clusters2"),
        F.sum(n / t * F.log(t * n / (a * b))).alias("mi"),
        (-F.sum(n / t * F.log(a / t))).alias("h_label"),
        (-F.sum(n / t * F.log(b / t))).alias("h_cluster"),
        F.count_distinct("label").alias("labels"),
        F.count_distinct("cluster").alias("clusters"),
    )


def ari_of(c, a, b, n):
    """Adjusted Rand index from the sums of squared cells (c), class (a) and cluster (b) sizes, in pair-confusion form."""
    tp, fp, fn = c - n, b - c, a - c
    tn = n * n - a - b + c
    value = F.try_divide(2 * (tp * tn - fn * fp), (tp + fn) * (fn + tn) + (tp + fp) * (fp + tn))
    return F.when((fp == 0) & (fn == 0), 1.0).otherwise(value)


def nmi_of(mi, h_label, h_cluster, labels, clusters):
    one = (labels == 1) & (clusters == 1)
    return F.when(one, 1.0).when(mi <= 2.220446049250313e-16, 0.0).otherwise(F.try_divide(mi, (h_label + h_cluster) / 2))


def external(cont: DataFrame, by: list[str] = ()) -> DataFrame:
    """[by,] n, ari, nmi."""
    by = list(by)
    m = _margins(cont, by)
    ari = ari_of(F.col("cells"), F.col("classes2"), F.col("clusters2"), F.col("n"))
    nmi = nmi_of(*[F.col(c) for c in ("mi", "h_label", "h_cluster", "labels", "clusters")])
    return m.select(*by, F.col("n").cast("bigint").alias("n"), ari.alias("ari"), nmi.alias("nmi"))


#: Terms of the hypergeometric series in one range, and how many root sizes from its mean terms are more than 0 in doubles.
SERIES, WIDE = 100_000, 40


def log_factorial(m: Column) -> Column:
    """Of a whole number, not negative: by Stirling's series, small ones from a table."""
    z = m.cast("double") + 1
    series = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * F.pow(z, 3)) + 1 / (1260 * F.pow(z, 5)) - 1 / (1680 * F.pow(z, 7))
    table = F.array(*[F.lit(math.lgamma(i + 1)) for i in range(16)])
    return F.when(m < 16, F.element_at(table, F.least(m, F.lit(15)).cast("int") + 1)).otherwise(series)


def expected_mi(cont: DataFrame, by: list[str] = (), series: int = SERIES) -> DataFrame:
    """[by,] e: the expected mutual information of labelings with the margins of ``cont`` (hypergeometric).

    Pairs of different class and cluster sizes are rows; each has the terms of its series, in ranges of ``series`` terms
    that are dealt anew. By Hoeffding's bound terms more than ``WIDE`` times the root of the lesser size from the mean are
    0 as doubles; they are left out.
    """
    by = [*by, "__all"]
    cont = cont.withColumn("__all", F.lit(0))
    sizes = lambda side, name: cont.groupBy(*by, side).agg(F.sum("n").alias(name)).groupBy(*by, name).agg(F.count(F.lit(1)).alias(f"{name}_times"))
    pairs = sizes("label", "x").join(sizes("cluster", "y"), by).join(cont.groupBy(*by).agg(F.sum("n").alias("n")), by)
    x, y, n = F.col("x"), F.col("y"), F.col("n")
    mean, reach = x * (y / n), WIDE * F.sqrt(F.least(x, y).cast("double")) + 1
    low = F.greatest(F.lit(1), x + y - n, F.floor(mean - reach))
    high = F.least(x, y, F.ceil(mean + reach))
    ranged = pairs.withColumn("high", high).withColumn("low", F.explode(F.when(low <= high, F.sequence(low, high, F.lit(series).cast("bigint")))))
    dealt = ranged.repartition(*by, "x", "y", "low")
    terms = dealt.withColumn("m", F.explode(F.sequence(F.col("low"), F.least(F.col("low") + series - 1, "high"))))
    m, f = F.col("m"), log_factorial
    p = f(x) + f(y) + f(n - x) + f(n - y) - f(n) - f(m) - f(x - m) - f(y - m) - f(n - x - y + m)
    term = F.col("x_times") * F.col("y_times") * (m / n * F.log(n / x * (m / y)) * F.exp(p))
    return terms.groupBy(*by).agg(F.sum(term).alias("e")).drop("__all")


def ami(cont: DataFrame, by: list[str] = ()) -> DataFrame:
    """[by,] ami."""
    by = list(by)
    mi, e = _margins(cont, by), expected_mi(cont, by)
    joined = mi.join(e, by) if by else mi.crossJoin(e)
    value = F.try_divide(F.col("mi") - F.col("e"), (F.col("h_label") + F.col("h_cluster")) / 2 - F.col("e"))
    return joined.select(*by, finite(F.when((F.col("labels") == 1) & (F.col("clusters") == 1), 1.0).otherwise(value)).alias("ami"))


def _defined(k, n, value):
    return F.when((k >= 2) & (k < n), value)


def silhouette(scored: DataFrame, max_points: int = 2000, seed: int = 42, per_point: bool = False) -> DataFrame:
    """silhouette: mean over a fixed set of points, chosen by their ids alone before noise is left out; Euclidean.

    The set has ``max_points`` rows at most, so its broadcast and its pairs are bounded.
    """
    chosen = scored.select("sample_id", "features", "cluster").orderBy(priority(seed, "sample_id"), "sample_id").limit(max_points).filter("cluster <> -1")
    other = chosen.select(F.col("sample_id").alias("o"), F.col("features").alias("of"), F.col("cluster").alias("oc"))
    dist = chosen.crossJoin(F.broadcast(other)).withColumn("d", euclidean("features", "of"))
    means = dist.groupBy("sample_id", "cluster", "oc").agg(F.sum("d").alias("s"), F.count(F.lit(1)).alias("m"))
    a = F.max(F.when(F.col("oc") == F.col("cluster"), F.when(F.col("m") > 1, F.col("s") / (F.col("m") - 1))))
    b = F.min(F.when(F.col("oc") != F.col("cluster"), F.col("s") / F.col("m")))
    points = means.groupBy("sample_id", "cluster").agg(a.alias("a"), b.alias("b"))
    s = F.when(F.col("a").isNull(), 0.0).when(F.greatest("a", "b") == 0, 0.0).otherwise(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")))
    points = points.withColumn("s", s)
    if per_point:
        return points
    return points.agg(F.count_distinct("cluster").alias("k"), F.count(F.lit(1)).alias("n"), F.avg("s").alias("v")).select(_defined(F.col("k"), F.col("n"), F.col("v")).alias("silhouette"))


def silhouettes(labelled: DataFrame, max_points: int = 2000, seed: int = 42) -> DataFrame:
    """candidate (from 0), silhouette, coverage, clusters and assigned of each place in ``labels`` (sample_id, features, labels).

    Silhouettes are those of :func:`silhouette`, for all candidates from one matrix of distances; the set of rows, at most
    ``max_points``, is broadcast. The other figures are over all rows.
    """
    spark = labelled.sparkSession
    chosen = labelled.select("sample_id", "features", "labels").orderBy(priority(seed, "sample_id"), "sample_id").limit(max_points).collect()
    counts = labelled.select(F.posexplode("labels").alias("candidate", "cluster")).groupBy("candidate").agg(
        F.avg((F.col("cluster") >= 0).cast("double")).alias("coverage"), F.count_distinct(F.when(F.col("cluster") >= 0, F.col("cluster"))).alias("clusters"), F.count_if(F.col("cluster") >= 0).alias("assigned"),
    )
    means = sampled_silhouettes(spark, np.array([r.features for r in chosen], dtype=float), np.array([r.labels for r in chosen], dtype=np.int64))
    return counts.join(means, "candidate", "left")


def sampled_silhouettes(spark, x: np.ndarray, labels: np.ndarray) -> DataFrame:
    """candidate (from 0), silhouette of the labels in each column over the same rows, from one matrix of distances."""
    told = spark.sparkContext.broadcast((x, labels))

    def run(batches):
        x, labels = told.value
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            d = np.sqrt(((x[ids][:, None, :] - x[None]) ** 2).sum(axis=2)) if x.shape[1] <= 8 else np.array([np.sqrt(((x[i] - x) ** 2).sum(axis=1)) for i in ids]).reshape(len(ids), len(x))
            for c in range(labels.shape[1]):
                mine, every = labels[ids, c], labels[:, c]
                names = np.unique(every[every >= 0])
                if not len(names):
                    continue
                member = (every[:, None] == names[None, :]).astype(float)
                sums, sizes = d @ member, member.sum(axis=0)
                rows = np.flatnonzero(mine >= 0)
                own = np.searchsorted(names, mine[rows])
                a = sums[rows, own] / np.maximum(sizes[own] - 1, 1)
                others = sums[rows] / sizes[None, :]
                others[np.arange(len(rows)), own] = np.inf
                b = others.min(axis=1, initial=np.inf)
                top = np.maximum(a, b)
                s = np.where((sizes[own] > 1) & (top > 0) & np.isfinite(top), (b - a) / np.where((top > 0) & np.isfinite(top), top, 1.0), 0.0)
                yield pa.RecordBatch.from_arrays([pa.array([c] * len(rows), pa.int32()), pa.array(mine[rows]), pa.array(s)], names=["candidate", "cluster", "s"])

    points = spark.range(len(x), numPartitions=max(1, min(64, len(x) // 32))).mapInArrow(run, "candidate int, cluster bigint, s double")
    means = points.groupBy("candidate").agg(F.count_distinct("cluster").alias("k"), F.count(F.lit(1)).alias("n"), F.avg("s").alias("v"))
    return means.select("candidate", _defined(F.col("k"), F.col("n"), F.col("v")).alias("silhouette"))


def centroids(scored: DataFrame) -> DataFrame:
    """cluster, center, n of assigned rows."""
    cells = scored.filter("cluster <> -1").select("cluster", F.posexplode("features").alias("pos", "x")).groupBy("cluster", "pos").agg(F.avg("x").alias("x"), F.count("x").alias("n"))
    packed = cells.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("p"), F.max("n").alias("n"))
    return packed.select("cluster", F.transform("p", lambda c: c["x"]).alias("center"), "n")


#: Clusters that may be broadcast to their rows; a cluster that isn't then has no more than one in so many rows.
HUBS = 4096


def with_centers(rows: DataFrame, centers: DataFrame, hubs: int = HUBS) -> DataFrame:
    """``rows`` with the center of their cluster (cluster, center, n): those of large clusters are broadcast, so no task reads all of one's rows."""
    whole = centers.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n")).first()
    told = centers.select("cluster", "center", "n")
    if whole.k <= hubs:
        return rows.join(F.broadcast(told.drop("n")), "cluster")
    large, small = told.filter(F.col("n") * hubs > whole.n).drop("n"), told.filter(F.col("n") * hubs <= whole.n).drop("n")
    rest = rows.join(F.broadcast(large.select("cluster")), "cluster", "left_anti")
    return rows.join(F.broadcast(large), "cluster").unionByName(rest.join(small, "cluster"))


def davies_bouldin(scored: DataFrame) -> DataFrame:
    centers = materialise(centroids(scored), "centers")
    rows = with_centers(scored.filter("cluster <> -1").select("cluster", "features"), centers)
    spread = rows.groupBy("cluster").agg(F.avg(euclidean("features", "center")).alias("s"), F.count(F.lit(1)).alias("n")).join(centers.select("cluster", "center"), "cluster")
    other = spread.select(F.col("cluster").alias("o"), F.col("s").alias("os"), F.col("center").alias("oc"))
    gap = euclidean("center", "oc")
    pairs = spread.crossJoin(other).filter("cluster <> o").withColumn("gap", gap)
    worst = pairs.groupBy("cluster", "n").agg(F.max(F.coalesce(F.try_divide(F.col("s") + F.col("os"), F.col("gap")), F.lit(0.0))).alias("r"), F.max("gap").alias("widest"), F.max(F.col("s") + F.col("os")).alias("wide"))
    flat = (F.max("widest") <= 1e-12) | (F.max("wide") <= 1e-12)
    return worst.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.when(flat, 0.0).otherwise(F.avg("r")).alias("v")).select(_defined(F.col("k"), F.col("n"), F.col("v")).alias("davies_bouldin"))


def calinski_harabasz(scored: DataFrame) -> DataFrame:
    """One pass over the cells: sums and sums of squares of each cluster and feature."""
    cells = scored.filter("cluster <> -1").select("cluster", F.posexplode("features").alias("pos", "x"))
    parts = cells.groupBy("cluster", "pos").agg(F.count("x").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    mean = F.sum("s").over(Window.partitionBy("pos")) / F.sum("n").over(Window.partitionBy("pos"))
    parts = parts.withColumn("mean", mean)
    rows = parts.groupBy("cluster").agg(
        F.max("n").alias("n"), F.sum(F.col("n") * (F.col("s") / F.col("n") - F.col("mean")) ** 2).alias("between"), F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n")).alias("within")
    )
    k, n = F.count(F.lit(1)), F.sum("n")
    value = F.when(F.sum("within") <= 0, 1.0).otherwise(F.try_divide(F.try_divide(F.sum("between"), k - 1), F.try_divide(F.sum("within"), n - k)))
    return rows.agg(k.alias("k"), n.alias("n"), value.alias("v")).select(_defined(F.col("k"), F.col("n"), F.col("v")).alias("calinski_harabasz"))


METRICS = {
    "ari": lambda s: external(contingency(s)).select("ari"),
    "nmi": lambda s: external(contingency(s)).select("nmi"),
    "ami": lambda s: ami(contingency(s)),
    "silhouette": silhouette,
    "davies_bouldin": davies_bouldin,
    "calinski_harabasz": calinski_harabasz,
}


def compute_metrics(scored: DataFrame, requested: list[str] | None = None) -> DataFrame:
    """One row with the requested metrics; only these are worked out."""
    requested = list(METRICS) if requested is None else requested
    unknown = set(requested) - set(METRICS)
    if unknown:
        raise ValueError(f"unknown metrics {sorted(unknown)}; known: {sorted(METRICS)}")
    out = None
    for name in requested:
        one = METRICS[name](scored)
        out = one if out is None else out.crossJoin(one)
    return out


def label_diagnostics(predictions: DataFrame, k: int) -> DataFrame:
    """One row: labels, clusters without noise, their difference to ``k``, noise and dominance shares, status."""
    return size_diagnostics(predictions.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")), k)


def size_diagnostics(sizes: DataFrame, k: int, by: list[str] = ()) -> DataFrame:
    """[by,] the figures of :func:`label_diagnostics` from the clusters' sizes ([by,] cluster, n)."""
    by = list(by)
    real = F.col("cluster") != F.lit("-1").cast(sizes.schema["cluster"].dataType)
    d = sizes.groupBy(*by).agg(
        F.count(F.lit(1)).alias("distinct_labels"), F.count(F.when(real, 1)).alias("clusters_found"),
        F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(real, F.col("n"))), F.lit(0)).alias("assigned_count"), F.coalesce(F.max(F.when(real, F.col("n"))), F.lit(0)).alias("largest"),
    )
    share = F.coalesce(F.try_divide(F.col("largest"), F.col("assigned_count")), F.lit(0.0))
    out = d.select(
        *by, "distinct_labels", "clusters_found", (F.col("clusters_found") - k).alias("cluster_delta"),
        (1 - F.col("assigned_count") / F.col("rows")).alias("noise_fraction"), (F.col("assigned_count") / F.col("rows")).alias("assigned_fraction"),
        "assigned_count", share.alias("dominant_cluster_fraction"),
    )
    status = F.when(F.col("clusters_found") < 2, "degenerate").when(F.col("dominant_cluster_fraction") >= 0.95, "near_degenerate").otherwise("ok")
    return out.withColumn("status", status).withColumn("low_coverage", F.col("assigned_fraction") < 0.5)


def canonical_labels(predictions: DataFrame) -> DataFrame:
    """Clusters renumbered by their first id; noise stays -1. One row a cluster is ranked."""
    first = predictions.filter("cluster <> -1").groupBy("cluster").agg(F.min("sample_id").alias("first"))
    number = first.select("cluster", (F.row_number().over(Window.orderBy("first")) - 1).cast("int").alias("canonical"))
    return predictions.join(number, "cluster", "left").select("sample_id", F.coalesce("canonical", F.lit(-1)).alias("cluster"))


def prediction_fingerprint(predictions: DataFrame, raw: bool = False) -> DataFrame:
    """Equal for equal clusterings whatever the clusters' numbers; ``raw``: of the numbers as they are."""
    return fingerprint(predictions if raw else canonical_labels(predictions), "cluster", "sample_id")


def matrix_fingerprint(points: DataFrame, digits: int = 8) -> DataFrame:
    rounded = F.concat_ws(",", F.transform("features", lambda x: F.format_number(x, digits)))
    return fingerprint(points.select("sample_id", rounded.alias("row")), "row", "sample_id")


def client_metrics(scored: DataFrame) -> DataFrame:
    """client_id, n, classes, clusters (no noise), ari, nmi of each client."""
    cont = contingency(scored, ["client_id"])
    counts = cont.groupBy("client_id").agg(F.count_distinct("label").alias("classes"), F.count_distinct(F.when(F.col("cluster") != -1, F.col("cluster"))).alias("clusters"))
    return external(cont, ["client_id"]).join(counts, "client_id").select("client_id", "n", "classes", "clusters", "ari", "nmi")


def client_summary(clients: DataFrame, metrics: tuple[str, ...] = ("ari", "nmi")) -> DataFrame:
    """One row: mean, mean by size, worst and population deviation of each metric over clients."""
    columns = []
    for m in metrics:
        columns += [F.avg(m).alias(f"{m}_mean"), F.try_divide(F.sum(F.col("n") * F.col(m)), F.sum(F.when(F.col(m).isNotNull(), F.col("n")))).alias(f"{m}_weighted"), F.min(m).alias(f"{m}_worst"), F.stddev_pop(m).alias(f"{m}_std")]
    return clients.agg(*columns)


def shuffled_ari(labels: DataFrame, seed: int = 42) -> DataFrame:
    """ari of the labels against the same labels in a random order: rows of equal rank in two orders meet."""
    rows = labels.select("sample_id", "label")
    one = hash_rank(rows, seed).select("rank", "label")
    two = hash_rank(rows, seed + 1, name="rank").select("rank", F.col("label").alias("cluster"))
    return external(contingency(one.join(two, "rank"))).select("ari")


def check_rows(rows: DataFrame) -> DataFrame:
    """Rows that break the bounds of their metrics."""
    bad = F.lit(False)
    for name, lo, hi in (("ari", -1, 1), ("ami", -1, 1), ("nmi", 0, 1), ("assigned_fraction", 0, 1)):
        if name in rows.columns:
            bad = bad | F.coalesce((F.col(name) < lo - 1e-9) | (F.col(name) > hi + 1e-9), F.lit(False))
    if "runtime_sec" in rows.columns:
        bad = bad | F.coalesce(F.col("runtime_sec") <= 0, F.lit(False))
    return rows.filter(bad)


def result_row(scored: DataFrame, algorithm: str, k: int, parameters: dict | None = None, environment: dict | None = None, requested: list[str] | None = None) -> DataFrame:
    """One row: algorithm, metrics, diagnostics, parameters and environment as maps, and the schema tag."""
    as_map = lambda d: F.create_map(*[F.lit(str(x)) for kv in sorted((d or {}).items()) for x in kv]) if d else F.create_map().cast("map<string,string>")
    row = compute_metrics(scored, requested).crossJoin(label_diagnostics(scored, k))
    return row.select(F.lit(algorithm).alias("algorithm"), "*", as_map(parameters).alias("parameters"), as_map(environment).alias("environment"), F.lit(SCHEMA_TAG).alias("metric_schema_version"))
