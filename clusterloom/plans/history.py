"""Stored runs as typed views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def newest(history: DataFrame, limit: int | None = None) -> DataFrame:
    rows = history.orderBy(F.desc("started_at"), F.desc("experiment_id"))
    return rows if limit is None else rows.limit(max(limit, 0))


def get_experiment(history: DataFrame, experiment_id: str) -> DataFrame:
    found = history.filter(F.col("experiment_id") == experiment_id)
    if found.isEmpty():
        raise KeyError(f"no experiment {experiment_id!r}")
    return found


def typed_view(history: DataFrame) -> DataFrame:
    """One row a result with defaults for what older files lack; a figure that a file doesn't hold (such as AMI) is null."""
    r = history.select("experiment_id", "started_at", "finished_at", "request", "partition", F.explode("results").alias("r"))
    seconds = (F.unix_micros(F.to_timestamp("finished_at")) - F.unix_micros(F.to_timestamp("started_at"))) / 1e6
    return r.select(
        "experiment_id", F.to_timestamp("started_at").alias("started_at"), seconds.alias("duration_sec"), "request.dataset",
        F.coalesce("request.mode", F.lit("local")).alias("mode"), F.coalesce("request.privacy_mode", F.lit("none")).alias("privacy_mode"),
        F.coalesce("request.participation_rate", F.lit(1.0)).alias("participation_rate"), F.coalesce("request.cluster_count_mode", F.lit("known_k")).alias("cluster_count_mode"),
        "partition.heterogeneity", "r.algorithm", F.coalesce("r.status", F.lit("ok")).alias("status"), "r.ari", "r.nmi", "r.ami", "r.silhouette",
    )
