"""Statistics over result rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clusterloom.functions.arrays import finite


def summarize_metric(rows: DataFrame, metric: str) -> DataFrame:
    """dataset, scenario, algorithm, n, mean, sd (sample; null for one row), min, max; undefined values are left out."""
    v = finite(F.col(metric).cast("double"))
    known = rows.withColumn("__v", v).filter("__v is not null")
    return known.groupBy("dataset", "scenario", "algorithm").agg(F.count("__v").alias("n"), F.avg("__v").alias("mean"), F.when(F.count("__v") > 1, F.stddev_samp("__v")).alias("sd"), F.min("__v").alias("min"), F.max("__v").alias("max"))


def paired_differences(rows: DataFrame, left: str, right: str, metric: str) -> DataFrame:
    """dataset, scenario, seed, diff of runs that share their partition; incomplete pairs drop out."""
    one = lambda name, alias: rows.filter(F.col("algorithm") == name).select("dataset", "scenario", "seed", F.col("partition_fingerprint").alias("fp"), finite(F.col(metric)).alias(alias))
    a, b = one(left, "l").alias("a"), one(right, "r").alias("b")
    on = (F.col("a.dataset") == F.col("b.dataset")) & (F.col("a.scenario") == F.col("b.scenario")) & (F.col("a.seed") == F.col("b.seed")) & F.col("a.fp").eqNullSafe(F.col("b.fp"))
    return a.join(b, on).select("a.dataset", "a.scenario", "a.seed", (F.col("l") - F.col("r")).alias("diff")).filter("diff is not null")


#: A prime: hashes of a row and a draw are places below it, worked out in 64-bit integers that any engine has.
PLACES = 2_147_483_647


def poisson_places(most: int = 12) -> list[int]:
    """A place from the k-th of these on stands for a count above k: the Poisson distribution of mean 1."""
    terms = [math.exp(-1) / math.factorial(k) for k in range(most)]
    return [int(math.fsum(terms[: k + 1]) * PLACES) for k in range(most)]


def mixed_place(row: Column, draw: Column, seed: int) -> Column:
    """A place from a row's number (0 to ``PLACES``) and a draw's."""
    place = (row * 48271 + (draw + 1) * 69621 + seed) % PLACES
    for factor in (16807, 39373):
        place = ((place * place % PLACES) * place + place * factor + row) % PLACES
    return place


def _bootstrap(groups: DataFrame, keys: list[str], draws: int, seed: int) -> DataFrame:
    """Percentile interval of resampled means.

    Each row is taken so many times in each draw as a hash of row and draw says (Poisson of mean 1), so a draw is a sum
    over rows that no task needs together. Rows of one seed and difference are taken together; a draw that takes no row
    doesn't count.
    """
    row = F.pmod(F.col("seed").cast("bigint") * 1_000_003 + F.floor(F.col("diff") * 1e8 + 0.5), F.lit(PLACES))
    drawn = groups.select(*keys, "diff", row.alias("row"), F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    placed = drawn.withColumn("place", mixed_place(F.col("row"), F.col("draw").cast("bigint"), seed))
    times = sum((F.col("place") >= p).cast("int") for p in poisson_places())
    means = placed.withColumn("times", times).groupBy(*keys, "draw").agg(F.sum(F.col("times") * F.col("diff")).alias("s"), F.sum("times").alias("n")).filter("n > 0").withColumn("m", F.col("s") / F.col("n"))
    ends = means.groupBy(*keys).agg(F.percentile("m", F.lit(0.025)).alias("ci_low"), F.percentile("m", F.lit(0.975)).alias("ci_high"))
    plain = groups.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_pairs"), F.avg("diff").alias("mean"), F.when(F.count(F.lit(1)) > 1, F.stddev_samp("diff")).alias("sd"), F.avg((F.col("diff") > 0).cast("double")).alias("fraction_positive"))
    return plain.join(ends, keys, "left").select(*keys, "n_pairs", "mean", "sd", "ci_low", "ci_high", "fraction_positive")


def paired_bootstrap(rows: DataFrame, left: str, right: str, metric: str = "ari", draws: int = 5000, seed: int = 2026) -> DataFrame:
    return _bootstrap(paired_differences(rows, left, right, metric), ["dataset", "scenario"], draws, seed)


def scenario_differences(rows: DataFrame, algorithm: str, before: str, after: str, metric: str = "ari") -> DataFrame:
    own = rows.filter(F.col("algorithm") == algorithm)
    a = own.filter(F.col("scenario") == before).select("dataset", "seed", finite(F.col(metric)).alias("x"))
    b = own.filter(F.col("scenario") == after).select("dataset", "seed", finite(F.col(metric)).alias("y"))
    return a.join(b, ["dataset", "seed"]).select("dataset", "seed", (F.col("y") - F.col("x")).alias("diff")).filter("diff is not null")


def scenario_delta(rows: DataFrame, algorithm: str, before: str, after: str, metric: str = "ari", draws: int = 5000, seed: int = 2026) -> DataFrame:
    return _bootstrap(scenario_differences(rows, algorithm, before, after, metric), ["dataset"], draws, seed)


def scenario_of(rows: DataFrame) -> DataFrame:
    """``rows`` with scenario from mode, cluster_count_mode, partition_mode, dirichlet_alpha and participation_rate."""
    local = F.when(F.col("cluster_count_mode") == "estimated_k", "local_estimated").otherwise("local_known")
    alpha = F.regexp_replace(F.col("dirichlet_alpha").cast("string"), r"\.", "")
    base = F.when(F.col("partition_mode") == "dirichlet", F.concat(F.lit("dirichlet_"), alpha)).otherwise(F.col("partition_mode"))
    part = F.when(F.col("participation_rate") >= 1.0, "_full").otherwise("_partial")
    return rows.withColumn("scenario", F.when(F.col("mode") == "local", local).otherwise(F.concat(base, part)))


def rows_from_history(reports: DataFrame) -> DataFrame:
    """One row for each result of stored reports; an experiment stored twice is an error."""
    twice = reports.groupBy("experiment_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("experiment_id").take(5)
    if twice:
        raise ValueError(f"repeated experiments: {sorted(r.experiment_id for r in twice)}")
    return reports.select("experiment_id", "request.*", F.explode("results").alias("r")).select("*", "r.*").drop("r")


def degenerate_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("dataset", "algorithm").agg(F.count_if(F.col("status") == "degenerate").alias("degenerate"), F.count(F.lit(1)).alias("n"))


def invariance_cases(rows: DataFrame, iid: str = "iid_full", skewed: str = "dirichlet_01_full") -> DataFrame:
    """dataset, seed, algorithm, same_ari, same_hash, js of both: runs that must agree as all clients take part in both."""
    side = lambda name, p: rows.filter(F.col("scenario") == name).select("dataset", "seed", "algorithm", F.col("ari").alias(f"{p}_ari"), F.col("prediction_hash").alias(f"{p}_hash"), F.col("js").alias(f"{p}_js"))
    both = side(iid, "iid").join(side(skewed, "skew"), ["dataset", "seed", "algorithm"])
    close = F.abs(F.col("iid_ari") - F.col("skew_ari")) <= 1e-9 * F.greatest(F.abs("iid_ari"), F.abs("skew_ari"))
    return both.select("dataset", "seed", "algorithm", close.alias("same_ari"), (F.col("iid_hash") == F.col("skew_hash")).alias("same_hash"), "iid_js", "skew_js")


def dp_utility(rows: DataFrame, metric: str = "ari") -> DataFrame:
    """algorithm, epsilon (null: control), mean, loss against the control."""
    means = rows.groupBy("algorithm", "epsilon").agg(F.avg(metric).alias("mean"))
    control = means.filter("epsilon is null").select("algorithm", F.col("mean").alias("control"))
    return means.join(control, "algorithm", "left").select("algorithm", "epsilon", "mean", (F.col("control") - F.col("mean")).alias("loss"))


def dp_utility_wide(rows: DataFrame, epsilons: list[float], metric: str = "ari") -> DataFrame:
    named = rows.withColumn("eps", F.coalesce(F.col("epsilon").cast("string"), F.lit("control")))
    return named.groupBy("algorithm").pivot("eps", ["control", *[str(float(e)) for e in epsilons]]).agg(F.avg(metric))


def capacity_table(rows: DataFrame, local: str, federated: str, metric: str = "ari") -> DataFrame:
    """dataset, local and federated means of one method in both forms, and their difference."""
    pivot = rows.filter(F.col("algorithm").isin(local, federated)).groupBy("dataset").pivot("algorithm", [local, federated]).agg(F.avg(metric))
    return pivot.select("dataset", F.col(f"`{local}`").alias("local"), F.col(f"`{federated}`").alias("federated"), (F.col(f"`{federated}`") - F.col(f"`{local}`")).alias("delta"))


def status_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def best_candidates(rows: DataFrame, by: list[str], order: list) -> DataFrame:
    """The first row of each group by a composite key (W5); Spark drops what can't be first before it shuffles."""
    return rows.withColumn("__place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("__place") <= 1).drop("__place")
