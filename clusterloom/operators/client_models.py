"""Centres of many clients as a table (client_id, cluster, center, n), refitted beside the clients' rows.

Rows are packed once, by client and, where a client has many, by hash into parts, so a hot client is many tasks. A step of
Lloyd joins packs and centres on the client: a pack takes its client's centres once, and hands on sums. What a server
needs of all centres is a summary of at most ``SUMMARY`` weighted ones, merged in a tree; fewer centres are kept as they
are. So neither the driver nor a broadcast holds more when there are more clients.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from clusterloom.functions.arrays import literal, priority
from clusterloom.operators.graph import materialise
from clusterloom.operators.rounds import nearest

#: Rows of a pack (about); centres that a summary keeps, and that one group of the tree hands on.
PACK, SUMMARY, KEEP = 1024, 4096, 1024


def client_packs(points: DataFrame, pack: int = PACK) -> DataFrame:
    """client_id, part, rows (all columns of ``points``)."""
    sizes = points.groupBy("client_id").agg(F.count(F.lit(1)).alias("__n"))
    part = F.pmod(F.xxhash64("sample_id"), F.ceil(F.col("__n") / pack)).cast("int")
    packed = points.join(sizes, "client_id").select("client_id", part.alias("part"), F.struct(*points.columns).alias("row"))
    return materialise(packed.groupBy("client_id", "part").agg(F.collect_list("row").alias("rows")), "client-packs")


def features_of(rows: pa.StructArray) -> np.ndarray:
    return rows.field("features").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), -1)


def centers_of(models: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and centres of a client's packed model."""
    flat = models.field("center").flatten().to_numpy(zero_copy_only=False).astype(float)
    return models.field("cluster").to_numpy(zero_copy_only=False), flat.reshape(len(models), -1)


def by_client(models: DataFrame) -> DataFrame:
    """client_id, model: the client's centres by number."""
    return models.groupBy("client_id").agg(F.sort_array(F.collect_list(F.struct("cluster", "center"))).alias("model"))


def client_starts(points: DataFrame, k: int, seed: int, shares: tuple[int, int] | None = None) -> DataFrame:
    """Each client's first centres: its k rows of least priority; with ``shares`` (s, most) it has min(rows // s, most).

    Tasks drop rows that can't be among a client's first before anything is shuffled.
    """
    keyed = points.withColumn("p", priority(seed, "sample_id"))
    place = F.row_number().over(Window.partitionBy("client_id").orderBy("p", "sample_id"))
    first = keyed.withColumn("place", place).filter(F.col("place") <= (shares[1] if shares else k))
    if shares:
        sizes = points.groupBy("client_id").agg(F.count(F.lit(1)).alias("n"))
        small = [r.client_id for r in sizes.filter(F.col("n") < shares[0]).orderBy("client_id").limit(10).collect()]
        if small:
            raise ValueError(f"clients {small} have fewer than {shares[0]} rows")
        first = first.join(sizes, "client_id").filter(F.col("place") <= F.floor(F.col("n") / shares[0]))
    return first.select("client_id", (F.col("place") - 1).alias("cluster"), F.col("features").cast("array<double>").alias("center"), F.lit(0.0).alias("n"))


def starts_from(clients: DataFrame, centers: np.ndarray) -> DataFrame:
    """The same centres for every client."""
    return clients.select("client_id", F.posexplode(F.array(*[literal(c) for c in centers])).alias("cluster", "center")).withColumn("n", F.lit(0.0))


def client_lloyd(packs: DataFrame, starts: DataFrame, steps: int, drop_empty: bool = True) -> DataFrame:
    """The clients' models after Lloyd steps from ``starts``, written; clusters without rows keep their centre or go."""
    models = materialise(starts.select("client_id", "cluster", "center", "n"), "client-models")
    client = packs.schema["client_id"].dataType
    width = models.select(F.max(F.size("center"))).first()[0] or 0

    def run(batches):
        for batch in batches:
            out = []
            for client_id, rows, model in zip(batch.column("client_id").to_pylist(), batch.column("rows"), batch.column("model"), strict=True):
                x, (numbers, centers) = features_of(rows.values), centers_of(model.values)
                label, _ = nearest(x, centers)
                for j in np.unique(label):
                    mine = x[label == j]
                    out.append((client_id, int(numbers[j]), len(mine), mine.sum(axis=0)))
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (to_arrow_type(client), pa.int32(), pa.int64(), pa.list_(pa.float64())), strict=True)], names=["client_id", "cluster", "rows", "s"])

    for _ in range(steps):
        parts = packs.select("client_id", "rows").join(by_client(models), "client_id").mapInArrow(run, f"client_id {client.simpleString()}, cluster int, rows bigint, s array<double>")
        sums = parts.groupBy("client_id", "cluster").agg(F.sum("rows").cast("double").alias("rows"), F.array(*[F.sum(F.col("s")[i]) for i in range(width)]).alias("s"))
        moved = models.drop("n").join(sums, ["client_id", "cluster"], "left")
        mean = F.transform("s", lambda v: v / F.col("rows"))
        models = materialise(moved.select("client_id", "cluster", F.coalesce(mean, "center").alias("center"), F.coalesce("rows", F.lit(0.0)).alias("n")), "client-models")
    return models.filter("n > 0") if drop_empty else models


def _reduced(x: np.ndarray, w: np.ndarray, keep: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``keep`` weighted centres for many: distance-weighted draws, then the mean and weight of what is nearest."""
    rng = np.random.default_rng(seed)
    chosen = [int(rng.choice(len(x), p=w / w.sum()))]
    d2 = ((x - x[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < min(keep, len(x)) and (d2 * w).sum() > 0:
        chosen.append(int(rng.choice(len(x), p=d2 * w / (d2 * w).sum())))
        d2 = np.minimum(d2, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    label, _ = nearest(x, x[chosen])
    weights = np.bincount(label, weights=w, minlength=len(chosen))
    full = weights > 0
    sums = np.zeros((len(chosen), x.shape[1]))
    np.add.at(sums, label, x * w[:, None])
    return sums[full] / weights[full, None], weights[full]


def summary(centers: DataFrame, seed: int, size: int = SUMMARY, keep: int = KEEP) -> tuple[np.ndarray, np.ndarray]:
    """Centres and weights of ``centers`` (id, center, weight), ``size`` at most.

    Up to ``size`` they are what they were, by id. Beyond, equal centres become one, and groups of some 4 ``keep`` centres
    hand on ``keep``, as often as it takes; weights and weighted sums stay the same. Weights must be positive.
    """
    n, by = centers.count(), "id"
    if n > size:
        centers, by = centers.groupBy("center").agg(F.sum("weight").alias("weight")), "center"
        centers = materialise(centers, "summary")
        n = centers.count()
    while n > size:

        def run(table):
            x = table.column("center").combine_chunks()
            a, b = _reduced(x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1), table.column("weight").to_numpy(), keep, seed)
            return pa.table({"center": pa.array(list(a), pa.list_(pa.float64())), "weight": pa.array(b)})

        group = F.pmod(F.xxhash64("center"), F.lit(math.ceil(n / (4 * keep))))
        centers = materialise(centers.groupBy(group.alias("g")).applyInArrow(run, "center array<double>, weight double"), "summary")
        n = centers.count()
    rows = centers.orderBy(by).collect()
    return np.array([r.center for r in rows], dtype=float).reshape(len(rows), -1), np.array([r.weight for r in rows], dtype=float)


def weighted_kmeans(x: np.ndarray, weights: np.ndarray, k: int, seed: int, steps: int = 100) -> np.ndarray:
    """Lloyd on a summary's weighted centres, started by distance-weighted draws."""
    if len(x) < k:
        raise ValueError(f"{len(x)} local centres for {k} clusters")
    rng = np.random.default_rng(seed)
    centers = x[[rng.choice(len(x), p=weights / weights.sum())]]
    while len(centers) < k:
        d2 = nearest(x, centers)[1] * weights
        centers = np.vstack([centers, x[rng.choice(len(x), p=d2 / d2.sum()) if d2.sum() > 0 else rng.integers(len(x))]])
    for _ in range(steps):
        label, _ = nearest(x, centers)
        new = np.array([np.average(x[label == j], axis=0, weights=weights[label == j]) if (label == j).any() else centers[j] for j in range(k)])
        if np.allclose(new, centers, atol=1e-12):
            break
        centers = new
    return centers
