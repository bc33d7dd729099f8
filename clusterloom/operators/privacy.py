"""Gaussian differential privacy (D1-D11). Noise comes from the operating system, never from a run's seed."""

from __future__ import annotations

import math
import os
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterloom.operators.client_models import summary, weighted_kmeans
from clusterloom.operators.density import axial_neighbours, dense_components
from clusterloom.operators.graph import materialise
from clusterloom.operators.rounds import ClusterResult, assign_nearest, batch_features, data_free_centers, fed_rounds, within_ball
from clusterloom.operators.scaling import clip_l2
from clusterloom.operators.schedule import active_points
from clusterloom.operators.shared_neighbours import snn_peaks


def gaussian_delta(sigma: float, eps: float, sens: float) -> float:
    """The delta that noise of this deviation gives at eps (analytic Gaussian mechanism)."""
    phi = NormalDist().cdf
    a, b = sens / (2 * sigma), eps * sigma / sens
    tail = phi(-a - b)
    return phi(a - b) - (math.exp(eps + math.log(tail)) if tail > 0 else 0.0)


def gaussian_sigma(eps: float, delta: float, sens: float) -> float:
    """The least deviation whose delta is at most ``delta``: doubling, then 90 halvings."""
    if eps <= 0 or not 0 < delta < 1 or sens <= 0:
        raise ValueError("eps and the sensitivity must be positive, delta in (0, 1)")
    low, high = 0.0, sens
    while gaussian_delta(high, eps, sens) > delta:
        low, high = high, high * 2
    for _ in range(90):
        middle = (low + high) / 2
        low, high = (middle, high) if middle <= 0 or gaussian_delta(middle, eps, sens) > delta else (low, middle)
    return high


def system_normal(shape: tuple[int, ...] | int) -> np.ndarray:
    """Standard normals by Box-Muller from the system's random bytes, with uniforms strictly inside (0, 1)."""
    n = int(np.prod(shape))
    half = (n + 1) // 2
    bits = np.frombuffer(os.urandom(16 * half), dtype=np.uint64) >> np.uint64(12)
    u = (bits.astype(np.float64) + 0.5) / 2.0**52
    radius, angle = np.sqrt(-2 * np.log(u[:half])), 2 * np.pi * u[half:]
    return np.concatenate([radius * np.cos(angle), radius * np.sin(angle)])[:n].reshape(shape)


def dp_input(points: DataFrame, eps: float, delta: float, clip: float) -> DataFrame:
    """Clipped rows with noise on every coordinate, released once: written, as a recomputation would draw again."""
    sigma = gaussian_sigma(eps, delta, 2 * clip)
    keep = [c for c in points.columns if c != "features"]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = batch_features(batch)
                noisy = x + sigma * system_normal(x.shape)
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(list(noisy), pa.list_(pa.float64()))], names=[*keep, "features"])

    kinds = ", ".join([f"`{c}` {points.schema[c].dataType.simpleString()}" for c in keep] + ["features array<double>"])
    return materialise(clip_l2(points, clip).select(*keep, "features").mapInArrow(run, kinds), "private-input")


@dataclass(frozen=True)
class AggregateNoise:
    """Adds noise to a round's joint statistics; ``least``: noisy weights at or below it are not trusted."""

    sigma: float
    bound: float
    eps_round: float
    delta_round: float
    sensitivity: float

    @property
    def least(self) -> float:
        return max(1.0, 2 * self.sigma)

    def __call__(self, *statistics: np.ndarray) -> tuple[np.ndarray, ...]:
        return tuple(s + self.sigma * system_normal(s.shape) if self.sigma else s for s in statistics)


def dp_aggregate_config(kind: str, eps: float, delta: float, clip: float, rounds: int, enabled: bool = True) -> AggregateNoise:
    """Sensitivity 2 sqrt(1 + C^2) (k-means, fuzzy) or 2 sqrt(1 + C^2 + C^4) (mixture); eps and delta split over the rounds."""
    if kind not in ("kmeans", "fuzzy", "gmm"):
        raise ValueError(f"no aggregate mechanism for {kind!r}")
    sens = 2 * math.sqrt(1 + clip**2 + (clip**4 if kind == "gmm" else 0))
    sigma = gaussian_sigma(eps / rounds, delta / rounds, sens) if enabled else 0.0
    return AggregateNoise(sigma, clip, eps / rounds, delta / rounds, sens)


def fed_rounds_dp(kind: str, points: DataFrame, k: int, rounds: int, eps: float, delta: float, clip: float, seed: int = 42, schedule: DataFrame | None = None, enabled: bool = True, **how) -> ClusterResult:
    """Rounds on publicly scaled ``points`` with noisy aggregates; ``enabled=False`` is the matched control without noise."""
    d = points.select(F.max(F.size("features"))).first()[0]
    noise = dp_aggregate_config(kind, eps, delta, clip, rounds, enabled)
    return fed_rounds(kind, clip_l2(points, clip), k, rounds=rounds, seed=seed, schedule=schedule, dp=noise, start=data_free_centers(k, d, seed, clip), **how)


def dp_prototypes(points: DataFrame, anchors: np.ndarray, noise: AggregateNoise, clients: list[int] | None = None) -> DataFrame:
    """client_id, center, weight: noisy means of each client's rows at each anchor, where the noisy count is trusted.

    Every client and anchor gets noise, whether rows are there or not; the statistics are clients times anchors rows.
    """
    spark = points.sparkSession
    k, d = anchors.shape
    near = assign_nearest(points.select("client_id", "features"), anchors, keep=["client_id", "features"])
    cells = near.select("client_id", "cluster", F.posexplode("features").alias("pos", "x")).groupBy("client_id", "cluster", "pos").agg(F.sum("x").alias("s"), F.count("x").alias("n"))
    sums = cells.groupBy("client_id", "cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda c: c["s"]).alias("s"), F.max("n").alias("n"))
    ids = points.select("client_id").distinct() if clients is None else spark.createDataFrame([(c,) for c in clients], "client_id int")
    grid = ids.crossJoin(F.broadcast(spark.range(k).select(F.col("id").cast("int").alias("cluster"))))
    zero = F.array_repeat(F.lit(0.0), d)
    full = grid.join(sums, ["client_id", "cluster"], "left").select("client_id", "cluster", F.coalesce("s", zero).alias("features"), F.coalesce("n", F.lit(0)).cast("double").alias("n"))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            s, n = noise(batch_features(batch), batch.column("n").to_numpy(zero_copy_only=False))
            good = n > noise.least
            means = within_ball(s[good] / n[good, None], noise.bound) if good.any() else np.zeros((0, d))
            yield pa.RecordBatch.from_arrays([batch.column("client_id").filter(pa.array(good)), pa.array(list(means), pa.list_(pa.float64())), pa.array(np.maximum(1.0, n[good]))], names=["client_id", "center", "weight"])

    return materialise(full.mapInArrow(run, "client_id int, center array<double>, weight double"), "private-prototypes")


def pad_candidates(centers: np.ndarray, weights: np.ndarray, anchors: np.ndarray, required: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchors, in turn, with weight 1, until there are ``required`` candidates."""
    lack = max(0, required - len(centers))
    more = anchors[np.arange(lack) % len(anchors)]
    return np.vstack([centers.reshape(-1, anchors.shape[1]), more]), np.concatenate([weights, np.ones(lack)])


def private_candidates(points: DataFrame, anchors: np.ndarray, noise: AggregateNoise, required: int) -> DataFrame:
    """id, center, weight of all clients' private prototypes, and of anchors where there are fewer than ``required``."""
    found = dp_prototypes(points, anchors, noise).withColumn("id", F.monotonically_increasing_id()).select("id", "center", "weight")
    lack, d = required - found.count(), anchors.shape[1]
    if lack > 0:
        more = pad_candidates(np.zeros((0, d)), np.zeros(0), anchors, lack)
        rows = [(-1 - i, c.tolist(), float(w)) for i, (c, w) in enumerate(zip(*more, strict=True))]
        found = found.unionByName(points.sparkSession.createDataFrame(rows, "id bigint, center array<double>, weight double"))
    return materialise(found, "candidates")


def fed_server_dp(method: str, points: DataFrame, k: int, eps: float, delta: float, clip: float, rounds: int = 5, seed: int = 42, schedule: DataFrame | None = None, enabled: bool = True) -> ClusterResult:
    """Server methods on private prototypes: ``server_kmeans`` (iterated), ``snn`` (20 neighbours), ``nn`` (2), ``personalised``."""
    d = points.select(F.max(F.size("features"))).first()[0]
    used = rounds if method == "server_kmeans" else 1
    noise = dp_aggregate_config("kmeans", eps, delta, clip, used, enabled)
    rows = clip_l2(points, clip)
    anchors = data_free_centers(max(2 * k, k), d, seed, clip)
    history = []
    if method == "server_kmeans":
        for turn in range(1, used + 1):
            centers = weighted_kmeans(*summary(private_candidates(active_points(rows, schedule, turn), anchors, noise, k), seed), k, seed)
            history.append({"round": turn, "shift": float(np.linalg.norm(anchors[:k] - centers)), "objective": None})
            anchors = centers
    else:
        sent = private_candidates(active_points(rows, schedule, 1), anchors, noise, k)
        if method == "personalised":
            centers = weighted_kmeans(*summary(sent, seed), k, seed)
        elif method in ("snn", "nn"):
            centers = snn_peaks(sent.select("id", F.col("center").alias("features")), k, 20 if method == "snn" else 2)
        else:
            raise ValueError(f"unknown private method {method!r}")
    return ClusterResult(assign_nearest(rows, centers).drop("d2"), {"centers": centers, "eps": eps, "delta": delta}, history)


def public_projection(d: int, seed: int) -> np.ndarray:
    """d by 2 with orthonormal columns, from the seed alone."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, min(2, d))))
    return q * np.sign(np.where(np.diag(r) == 0, 1, np.diag(r)))


def fed_grid_density_dp(points: DataFrame, eps: float, delta: float, clip: float, cell_size: float = 0.75, min_points: int = 4, seed: int = 42, schedule: DataFrame | None = None, k: int = 8, enabled: bool = True) -> ClusterResult:
    """Density cells over a private histogram on a public projection.

    Half the budget releases prototypes; their cells and axial neighbours are the candidates; the other half counts rows
    in these, empty ones as well, so that nothing shows which cells are occupied.
    """
    spark = points.sparkSession
    d = points.select(F.max(F.size("features"))).first()[0]
    rows = clip_l2(points, clip)
    turn = public_projection(d, seed)
    flat = F.array(*[F.aggregate(F.zip_with("features", F.array(*[F.lit(float(v)) for v in turn[:, j]]), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b) for j in range(turn.shape[1])])
    cell = F.transform(flat, lambda x: F.floor(x / cell_size).cast("int"))
    celled = rows.withColumn("cell", cell)
    noise = dp_aggregate_config("kmeans", eps / 2, delta / 2, clip, 1, enabled)
    sent = private_candidates(active_points(rows, schedule, 1), data_free_centers(k, d, seed, clip), noise, k)
    own = materialise(sent.select(F.col("center").alias("features")).select(cell.alias("cell")).distinct(), "private-cells")
    candidates = own.union(axial_neighbours(own).select("neighbour")).distinct()
    counts = active_points(celled, schedule, 1).groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    joined = candidates.join(counts, "cell", "left").select("cell", F.coalesce("n", F.lit(0)).cast("double").alias("n"))
    sigma = gaussian_sigma(eps / 2, delta / 2, 2.0) if enabled else 0.0

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                n = batch.column("n").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([batch.column("cell"), pa.array(n + sigma * system_normal(n.shape) if sigma else n)], names=["cell", "n"])

    released = materialise(joined.mapInArrow(run, "cell array<int>, n double"), "private-histogram")
    labels = dense_components(released, min_points)
    rest = [c for c in points.columns if c != "features"]
    labelled = celled.select(*rest, "cell").join(labels, "cell", "left").select(*rest, F.coalesce("cluster", F.lit(-1)).alias("cluster"))
    return ClusterResult(labelled, {"eps": eps, "delta": delta, "histogram": released})


def dp_ledger(runs: DataFrame) -> DataFrame:
    """Upper bounds by composition over an experiment's algorithms: sums of eps and delta (delta at most 1). The report itself isn't private."""
    return runs.groupBy("experiment_id").agg(F.sum("eps").alias("eps"), F.least(F.lit(1.0), F.sum("delta")).alias("delta"), F.count(F.lit(1)).alias("algorithms")).withColumn("report_is_private", F.lit(False))
