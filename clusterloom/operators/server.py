"""Federated clusterings with a server stage.

Clients' centres are a table, the server sees a bounded summary of it or finds peaks in it by joins. Where a published
description leaves a detail open, the docstring says what is done.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterloom.operators.client_models import by_client, centers_of, client_lloyd, client_packs, client_starts, features_of, starts_from, summary, weighted_kmeans
from clusterloom.operators.graph import materialise
from clusterloom.operators.rounds import ClusterResult, assign_nearest, nearest
from clusterloom.operators.schedule import active_points
from clusterloom.operators.shared_neighbours import snn_peaks

#: More centres than a client can have: they number all clients' centres.
MOST = 1 << 20


def _weighted(models: DataFrame, weighted: bool = True) -> DataFrame:
    """id (by client and cluster), center, weight."""
    weight = F.greatest("n", F.lit(1e-300)) if weighted else F.lit(1.0)
    return models.select((F.col("client_id").cast("bigint") * MOST + F.col("cluster")).alias("id"), "center", weight.alias("weight"))


def _of(rows: DataFrame, clients: DataFrame, how: str = "left_semi") -> DataFrame:
    return rows.join(clients.select("client_id"), "client_id", how)


def fed_server_kmeans(points: DataFrame, k: int, rounds: int = 10, tol: float = 1e-4, seed: int = 42, schedule: DataFrame | None = None, iter_local: int = 1, drop_empty: bool = True, weighted: bool = True) -> ClusterResult:
    """Clients hold local centres and sizes; each round the server clusters those of active clients and they refit from the
    global centres, ``iter_local`` Lloyd steps; inactive clients keep theirs. Labels by the nearest global centre."""
    packs, steps = client_packs(points), max(1, iter_local)
    everyone = materialise(points.select("client_id").distinct(), "clients")
    models, history, sent, centers = None, [], 0, None
    for turn in range(1, rounds + 1):
        active = active_points(everyone, schedule, turn)
        fresh = active if models is None else _of(active, models, "left_anti")
        if models is None or fresh.head(1):
            own = client_lloyd(_of(packs, fresh), client_starts(_of(points, fresh), k, seed), steps, drop_empty)
            models = own if models is None else materialise(models.unionByName(own), "client-models")
        taking = materialise(_weighted(_of(models, active), weighted), "server-centres")
        x, w = summary(taking, seed)
        sent += 8 * taking.count() * (x.shape[1] + 1)
        new = weighted_kmeans(x, w, k, seed)
        shift = float("inf") if centers is None else float(np.linalg.norm(new[np.lexsort(new.T)] - centers[np.lexsort(centers.T)]))
        centers = new
        history.append({"round": turn, "shift": None if shift == float("inf") else shift, "objective": None})
        sent += 8 * centers.size * active.count()
        if shift < tol:
            break
        if turn < rounds:
            refit = client_lloyd(_of(packs, active), starts_from(active, centers), steps, drop_empty)
            models = refit if schedule is None else materialise(_of(models, active, "left_anti").unionByName(refit), "client-models")
    return ClusterResult(assign_nearest(points, centers).drop("d2"), {"centers": centers}, history, sent)


def fed_snn_peaks(points: DataFrame, k: int, neighbours: int = 20, reps: tuple[int, int] = (2, 50), seed: int = 42, schedule: DataFrame | None = None, steps: int = 5) -> ClusterResult:
    """Each client active in round 1 sends min(rows // reps[0], reps[1]) representatives (its own k-means centres); the
    server picks peaks among them; all rows go to the nearest peak."""
    taking = active_points(points, schedule, 1)
    sent = materialise(_weighted(client_lloyd(client_packs(taking), client_starts(taking, k, seed, reps), steps)), "representatives")
    n = sent.count()
    if n < k:
        raise ValueError(f"{n} representatives for {k} clusters")
    peaks = snn_peaks(sent.select("id", F.col("center").alias("features")), k, neighbours)
    return ClusterResult(assign_nearest(points, peaks).drop("d2"), {"centers": peaks, "representatives": n}, [], 8 * n * peaks.shape[1])


def fed_personalised(points: DataFrame, k: int, max_iters: int = 10, seed: int = 42, schedule: DataFrame | None = None) -> ClusterResult:
    """Global centres from the active clients' local ones, refined by each active client alone; inactive clients use the
    global ones. The model holds each client's mean distance to its centres, and mean, deviation and maximum over clients."""
    packs = client_packs(points)
    active = materialise(active_points(points.select("client_id").distinct(), schedule, 1), "clients")
    taking = _of(packs, active)
    local = _weighted(client_lloyd(taking, client_starts(_of(points, active), k, seed), 5))
    shared = weighted_kmeans(*summary(local, seed), k, seed)
    own = client_lloyd(taking, starts_from(active, shared), max_iters, drop_empty=False)
    keep = [c for c in points.columns if c != "features"]
    table = points.sparkSession.sparkContext.broadcast(shared)

    def run(batches):
        for batch in batches:
            for rows, model in zip(batch.column("rows"), batch.column("model"), strict=True):
                centers = table.value if model.values is None else centers_of(model.values)[1]
                label, d2 = nearest(features_of(rows.values), centers)
                yield pa.RecordBatch.from_arrays([*[rows.values.field(c) for c in keep], pa.array(label.astype(np.int32)), pa.array(np.sqrt(d2))], names=[*keep, "cluster", "distance"])

    kinds = ", ".join([f"`{c}` {points.schema[c].dataType.simpleString()}" for c in keep] + ["cluster int", "distance double"])
    labelled = packs.join(by_client(own), "client_id", "left").select("rows", "model").mapInArrow(run, kinds)
    costs = labelled.groupBy("client_id").agg(F.avg("distance").alias("cost"))
    total = costs.agg(F.avg("cost").alias("mean"), F.stddev_pop("cost").alias("std"), F.max("cost").alias("max")).first()
    sent = 8 * shared.shape[1] * (local.count() + k * active.count())
    cost = total.asDict()
    return ClusterResult(labelled.drop("distance"), {"centers": shared, "client_costs": costs, "cost_mean": cost["mean"], "cost_std": cost["std"], "cost_max": cost["max"]}, [], sent)
