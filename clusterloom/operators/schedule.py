"""Who takes part in which round (E1-E5, P10, P11). A schedule is round (from 1), client_id, status."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clusterloom.functions.arrays import hash_uniform, priority
from clusterloom.operators.partitioning import fingerprint


def make_schedule(spark: SparkSession, clients: int, rounds: int, rate: float = 1.0, dropout: float = 0.0, seed: int = 0) -> DataFrame:
    """Each round selects ceil(clients * rate) clients by hash order; each is dropped by chance, but never all."""
    if clients < 1 or rounds < 1 or not 0 < rate <= 1 or not 0 <= dropout < 1:
        raise ValueError("a schedule needs clients, rounds, a rate in (0, 1] and a dropout in [0, 1)")
    chosen = max(1, min(clients, math.ceil(clients * rate - 1e-12)))
    grid = spark.range(1, rounds + 1).select(F.col("id").cast("int").alias("round")).crossJoin(F.broadcast(spark.range(clients).select(F.col("id").cast("int").alias("client_id"))))
    draw = F.concat_ws(":", "round", "client_id")
    keyed = grid.withColumn("__key", priority(seed, draw)).withColumn("__place", F.row_number().over(Window.partitionBy("round").orderBy("__key", "client_id")))
    selected = keyed.filter(F.col("__place") <= chosen).withColumn("__drop", hash_uniform(seed + 1, draw) < dropout)
    all_gone = F.min(F.col("__drop").cast("int")).over(Window.partitionBy("round")) == 1
    kept = ~F.col("__drop") | (all_gone & (F.col("__place") == 1))
    return selected.select("round", "client_id", F.when(kept, "successful").otherwise("dropped").alias("status"))


def schedule_wide(schedule: DataFrame) -> DataFrame:
    ids = lambda cond, name: F.array_sort(F.collect_list(F.when(cond, F.col("client_id")))).alias(name)
    return schedule.groupBy("round").agg(ids(F.lit(True), "selected_clients"), ids(F.col("status") == "successful", "successful_clients"), ids(F.col("status") == "dropped", "dropped_clients"))


def active_clients(schedule: DataFrame | None, round_number: int) -> DataFrame | None:
    """client_id of the round's successful clients; rounds beyond the schedule reuse its last, before it its first; none: all."""
    if schedule is None:
        return None
    ends = schedule.agg(F.min("round").alias("lo"), F.max("round").alias("hi"))
    wanted = F.least(F.greatest(F.lit(round_number), F.col("lo")), F.col("hi"))
    return schedule.join(F.broadcast(ends), F.col("round") == wanted).filter("status = 'successful'").select("client_id")


def active_points(points: DataFrame, schedule: DataFrame | None, round_number: int) -> DataFrame:
    """``points`` (with client_id) of the round's active clients."""
    active = active_clients(schedule, round_number)
    return points if active is None else points.join(active, "client_id", "left_semi")


def first_round_clients(schedule: DataFrame) -> DataFrame:
    return active_clients(schedule, 1)


def active_data(assignment: DataFrame, schedule: DataFrame) -> DataFrame:
    """round, active_rows, active_hash: each client is counted and digested once, rounds only combine clients."""
    text = F.sha2(F.col("sample_id").cast("string"), 256)
    # A sum of 52-bit digests doesn't depend on order, so a client of any size is digested by partial sums.
    part = lambda at: F.sum(F.conv(F.substring(text, at, 13), 16, 10).cast("decimal(38,0)"))
    clients = assignment.groupBy("client_id").agg(F.count(F.lit(1)).alias("n"), part(1).alias("a"), part(14).alias("b"))
    taking = schedule.filter("status = 'successful'").select("round", "client_id").distinct().join(clients, "client_id")
    rounds = taking.groupBy("round").agg(F.sum("n").alias("active_rows"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    whole = F.concat_ws(":", F.col("active_rows").cast("string"), F.col("a").cast("string"), F.col("b").cast("string"))
    return rounds.select("round", "active_rows", F.substring(F.sha2(whole, 256), 1, 16).alias("active_hash"))


def schedule_with_activity(schedule: DataFrame, assignment: DataFrame) -> DataFrame:
    return schedule_wide(schedule).join(active_data(assignment, schedule), "round", "left")


def schedule_fingerprint(assignment: DataFrame, schedule: DataFrame) -> DataFrame:
    return fingerprint(active_data(assignment, schedule), "round", "active_hash")


def validate_schedule(schedule: DataFrame, clients: int) -> DataFrame:
    """unknown_clients, empty_rounds: both 0 in a valid schedule."""
    unknown = schedule.agg(F.count(F.when((F.col("client_id") < 0) | (F.col("client_id") >= clients), 1)).alias("unknown_clients"))
    empty = schedule.groupBy("round").agg(F.count(F.when(F.col("status") == "successful", 1)).alias("n")).agg(F.count(F.when(F.col("n") == 0, 1)).alias("empty_rounds"))
    return unknown.join(F.broadcast(empty))
