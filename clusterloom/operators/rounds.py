"""Starts, assignment to centres and the round-based clusterings.

A round reads the points once: a numpy kernel turns each Arrow batch into a few rows of sufficient statistics, which are
summed; only the model (k by d) goes between driver and executors. Lineage doesn't grow with the rounds.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clusterloom.functions.arrays import priority
from clusterloom.operators.graph import materialise
from clusterloom.operators.schedule import active_points


@dataclass
class ClusterResult:
    predictions: DataFrame
    model: dict[str, Any]
    history: list[dict] = field(default_factory=list)
    communication_bytes: int = 0


def batch_features(batch: pa.RecordBatch, column: str = "features") -> np.ndarray:
    lists = batch.column(column)
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return values.reshape(len(lists), -1) if len(lists) else np.zeros((0, 1))


def squared_distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """By the expanded product, cut at 0; a row's nearest by this is checked again where two are close."""
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(axis=1)[None, :], 0.0)


def nearest(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre (the lowest of equal ones) and squared distance, by true differences among those that are close."""
    d2 = squared_distances(x, centers)
    best = d2.min(axis=1)
    close = d2 <= best[:, None] + 1e-9 * (1.0 + best[:, None])
    label = d2.argmin(axis=1)
    # Rows with more than one close centre, at most so many at a time.
    ties = np.flatnonzero(close.sum(axis=1) > 1)
    for at in range(0, len(ties), 1024):
        some = ties[at : at + 1024]
        label[some] = ((x[some][:, None, :] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)
    return label, ((x - centers[label]) ** 2).sum(axis=1)


def priority_candidates(points: DataFrame, k: int, seed: int, schedule: DataFrame | None = None) -> DataFrame:
    """Each active client's k rows of least (priority, id)."""
    keyed = active_points(points, schedule, 1).withColumn("priority", priority(seed, "sample_id"))
    place = F.row_number().over(Window.partitionBy("client_id").orderBy("priority", "sample_id"))
    return keyed.withColumn("place", place).filter(F.col("place") <= k).select("client_id", "sample_id", "priority", "features")


def priority_centers(points: DataFrame, k: int, seed: int, schedule: DataFrame | None = None) -> np.ndarray:
    """The k active rows of least (priority, id): the same however rows are dealt to clients.

    The least of all clients' candidates are the least of all rows, so no client needs to be ranked.
    """
    rows = active_points(points, schedule, 1).select(priority(seed, "sample_id").alias("p"), "sample_id", "features").orderBy("p", "sample_id").limit(k).collect()
    if len(rows) < k:
        raise ValueError(f"{len(rows)} candidates for {k} centres")
    return np.array([r.features for r in rows], dtype=float)


def init_report(points: DataFrame, k: int, seed: int, schedule: DataFrame | None = None) -> DataFrame:
    """client_id, candidates, bytes (8 a feature and 16 for id and priority, each candidate).

    A client has as many candidates as rows, ``k`` at most, whichever they are; so rows are counted, not ranked.
    """
    width, n = F.max(F.size("features")), F.least(F.count(F.lit(1)), F.lit(k))
    return active_points(points, schedule, 1).groupBy("client_id").agg(n.alias("candidates"), (n * (8 * width + 16)).alias("bytes"))


def moments_variance(points: DataFrame, schedule: DataFrame | None = None, reg: float = 1e-6) -> np.ndarray:
    """Variance of each feature over active rows from n, sums and sums of squares; at least ``reg``."""
    cells = active_points(points, schedule, 1).select(F.posexplode("features").alias("pos", "x"))
    rows = cells.groupBy("pos").agg(F.count("x").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q")).orderBy("pos").collect()
    return np.array([max(r.q / r.n - (r.s / r.n) ** 2, reg) for r in rows])


def within_ball(rows, bound: float) -> np.ndarray:
    """Rows no longer than ``bound``: only those beyond it are drawn in. What isn't finite counts as 0."""
    out = np.array(rows, dtype=float)
    out[~np.isfinite(out)] = 0.0
    length = np.sqrt(np.einsum("ij,ij->i", out, out))
    beyond = length > bound
    out[beyond] *= (bound / length[beyond])[:, None]
    return out


def data_free_centers(k: int, d: int, seed: int, bound: float) -> np.ndarray:
    """Centres that no row has a part in: normal around 0 with deviation 0.6, within the ball."""
    return within_ball(0.6 * np.random.default_rng(seed).standard_normal((k, d)), bound)


def assign_nearest(points: DataFrame, centers: np.ndarray, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (all but features by default), cluster, d2; the centres are broadcast with the kernel."""
    keep = [c for c in points.columns if c != "features"] if keep is None else keep
    shared = points.sparkSession.sparkContext.broadcast(np.asarray(centers, dtype=float))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            label, d2 = nearest(batch_features(batch), shared.value)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(label.astype(np.int32)), pa.array(d2)], names=[*keep, "cluster", "d2"])

    kinds = ", ".join([f"`{c}` {points.schema[c].dataType.simpleString()}" for c in keep] + ["cluster int", "d2 double"])
    return points.select(*dict.fromkeys([*keep, "features"])).mapInArrow(run, kinds)


def summed_statistics(points: DataFrame, kernel, d: int, moments: int = 1) -> dict[int, tuple]:
    """cluster: (weight, sums [, sums of squares], objective) of all rows.

    ``kernel(x)`` gives weights (clusters), one array (clusters by d) a moment, and the objective of each cluster.
    """
    names = ["cluster", "w", *[f"s{m}" for m in range(moments)], "objective"]

    def run(batches):
        # One set of statistics a task: memory is k by d, whatever the partition.
        whole = None
        for batch in batches:
            if batch.num_rows:
                parts = kernel(batch_features(batch))
                whole = list(parts) if whole is None else [a + b for a, b in zip(whole, parts, strict=True)]
        if whole is not None:
            k = len(whole[0])
            arrays = [pa.array(np.arange(k, dtype=np.int32)), pa.array(whole[0].astype(float)), *[pa.array(list(m), pa.list_(pa.float64())) for m in whole[1:-1]], pa.array(whole[-1].astype(float))]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = "cluster int, w double, " + "".join(f"s{m} array<double>, " for m in range(moments)) + "objective double"
    parts = points.select("features").mapInArrow(run, schema)
    sums = [F.array(*[F.sum(F.col(f"s{m}")[i]) for i in range(d)]).alias(f"s{m}") for m in range(moments)]
    rows = parts.groupBy("cluster").agg(F.sum("w").alias("w"), *sums, F.sum("objective").alias("objective")).collect()
    return {r.cluster: (r.w, *[np.array(r[f"s{m}"]) for m in range(moments)], r.objective) for r in rows}


def _stacked(stats: dict[int, tuple], k: int) -> list[np.ndarray]:
    if not stats:
        raise ValueError("no active rows")
    return [np.array([stats[c][i] for c in range(k)]) for i in range(len(stats[0]))]


def kmeans_kernel(centers: np.ndarray):
    def run(x):
        label, d2 = nearest(x, centers)
        k = len(centers)
        member = np.zeros((k, len(x)))
        member[label, np.arange(len(x))] = 1.0
        return np.bincount(label, minlength=k).astype(float), member @ x, np.bincount(label, weights=d2, minlength=k)

    return run


def fuzzy_kernel(centers: np.ndarray, fuzziness: float):
    def run(x):
        d2 = np.maximum(squared_distances(x, centers), 1e-12)
        log_u = -np.log(d2) / (fuzziness - 1.0)
        u = np.exp(log_u - log_u.max(axis=1, keepdims=True))
        w = (u / u.sum(axis=1, keepdims=True)) ** fuzziness
        return w.sum(axis=0), w.T @ x, (w * d2).sum(axis=0)

    return run


def gmm_log_density(x: np.ndarray, weights: np.ndarray, means: np.ndarray, variances: np.ndarray) -> np.ndarray:
    spread = (x * x) @ (1 / variances).T - 2 * x @ (means / variances).T + (means * means / variances).sum(axis=1)
    return np.log(weights + 1e-15) - 0.5 * (np.log(2 * np.pi * variances).sum(axis=1) + spread)


def gmm_kernel(weights: np.ndarray, means: np.ndarray, variances: np.ndarray):
    def run(x):
        log_p = gmm_log_density(x, weights, means, variances)
        top = log_p.max(axis=1, keepdims=True)
        whole = top + np.log(np.exp(log_p - top).sum(axis=1, keepdims=True))
        r = np.exp(log_p - whole)
        return r.sum(axis=0), r.T @ x, r.T @ (x * x), (r * whole).sum(axis=0)

    return run


def label_by(points: DataFrame, score, keep: list[str] | None = None) -> DataFrame:
    """Columns and the cluster of highest ``score(x)``, the lowest of equal ones."""
    keep = [c for c in points.columns if c != "features"] if keep is None else keep

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                label = score(batch_features(batch)).argmax(axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(label)], names=[*keep, "cluster"])

    kinds = ", ".join([f"`{c}` {points.schema[c].dataType.simpleString()}" for c in keep] + ["cluster int"])
    return points.select(*dict.fromkeys([*keep, "features"])).mapInArrow(run, kinds)


def _participants(schedule: DataFrame | None, points: DataFrame, rounds: int) -> list[tuple[int, int]]:
    """(selected, successful) clients of each round."""
    if schedule is None:
        n = points.select("client_id").distinct().count()
        return [(n, n)] * rounds
    rows = schedule.groupBy("round").agg(F.count(F.lit(1)).alias("s"), F.count(F.when(F.col("status") == "successful", 1)).alias("ok")).orderBy("round").collect()
    return [(rows[min(i, len(rows) - 1)].s, rows[min(i, len(rows) - 1)].ok) for i in range(rounds)]


def message_bytes(kind: str, k: int, d: int) -> tuple[int, int]:
    """(up, down) of one client in one round: 8 bytes a number."""
    if kind == "gmm":
        return 8 * (k + 2 * k * d), 8 * (2 * k * d + k)
    return 8 * (k * d + k), 8 * k * d


def communication_bytes(kind: str, k: int, d: int, participants: list[tuple[int, int]], init_bytes: int = 0, downlink: str = "successful") -> int:
    """Uplink of successful clients, downlink of successful or (``downlink="selected"``) all selected ones, and the start."""
    up, down = message_bytes(kind, k, d)
    return init_bytes + sum(ok * up + (s if downlink == "selected" else ok) * down for s, ok in participants)


def fed_rounds(
    kind: str, points: DataFrame, k: int, rounds: int = 10, tol: float = 1e-4, seed: int = 42, schedule: DataFrame | None = None,
    fuzziness: float = 2.0, reg_covar: float = 1e-6, early_stop: bool = True, downlink: str = "successful", dp=None, start: np.ndarray | None = None,
) -> ClusterResult:
    """Federated k-means (``kmeans``), fuzzy c-means (``fuzzy``) or diagonal Gaussian mixture (``gmm``).

    ``points`` holds sample_id, client_id, features. Only rows of a round's successful clients count in it; all rows are
    labelled by the last model. ``dp`` turns summed statistics into noisy ones (see the privacy module); then nothing
    derived from exact statistics is reported. A cluster without rows keeps its centre.
    """
    if kind == "fuzzy" and fuzziness <= 1:
        raise ValueError("fuzziness must be above 1")
    centers = priority_centers(points, k, seed, schedule) if start is None else np.asarray(start, dtype=float)
    k, d = centers.shape
    weights = np.full(k, 1.0 / k)
    if kind == "gmm":
        variances = np.tile(moments_variance(points, schedule, reg_covar) if dp is None else np.ones(d), (k, 1))
    history = []
    for turn in range(1, rounds + 1):
        rows = active_points(points, schedule, turn)
        if kind == "gmm":
            w, s, q, objective = _stacked(summed_statistics(rows, gmm_kernel(weights, centers, variances), d, 2), k)
            if dp is not None:
                w, s, q = dp(w, s, q)
            reliable = w > (dp.least if dp is not None else 0.0)
            n = np.maximum(w, 1e-12)
            new = np.where(reliable[:, None], s / n[:, None], centers)
            spread = np.where(reliable[:, None], np.maximum(q / n[:, None] - new**2, reg_covar), variances)
            if dp is not None:
                new, spread = within_ball(new, dp.bound), np.clip(spread, max(reg_covar, 0.05), dp.bound**2)
            weights, variances = n / n.sum(), spread
        else:
            w, s, objective = _stacked(summed_statistics(rows, kmeans_kernel(centers) if kind == "kmeans" else fuzzy_kernel(centers, fuzziness), d), k)
            if dp is not None:
                w, s = dp(w, s)
            reliable = w > (dp.least if dp is not None else 0.0)
            new = np.where(reliable[:, None], s / np.where(reliable, w, 1.0)[:, None], centers)
            if dp is not None:
                new = within_ball(new, dp.bound)
        shift = float(np.linalg.norm(new - centers))
        centers = new
        history.append({"round": turn, "shift": shift, "objective": None if dp is not None else float(objective.sum())})
        if early_stop and shift < tol:
            break
    participants = _participants(schedule, points, len(history))
    used = communication_bytes(kind, k, d, participants, downlink=downlink)
    if start is None:
        used += (init_report(points, k, seed, schedule).agg(F.sum("bytes")).first()[0] or 0)
    if kind == "gmm":
        fixed = (weights, centers, variances)
        labelled = label_by(points, lambda x: gmm_log_density(x, *fixed))
        model = {"weights": weights, "means": centers, "variances": variances}
    else:
        labelled = assign_nearest(points, centers).drop("d2")
        model = {"centers": centers}
    return ClusterResult(labelled, model, history, int(used))


def fed_kmeans(points, k, **how) -> ClusterResult:
    return fed_rounds("kmeans", points, k, **how)


def fed_fuzzy_cmeans(points, k, **how) -> ClusterResult:
    return fed_rounds("fuzzy", points, k, **how)


def fed_gmm_diag(points, k, **how) -> ClusterResult:
    return fed_rounds("gmm", points, k, **how)


def history_table(spark, history: list[dict]) -> DataFrame:
    """round, shift, objective and the change of the shift from the round before."""
    rows = spark.createDataFrame([(h["round"], h["shift"], h["objective"]) for h in history], "round int, shift double, objective double")
    return rows.withColumn("shift_change", F.col("shift") - F.lag("shift").over(Window.orderBy("round")))


#: Rows, the first by hash order, from which the starts of central k-means are drawn.
START_ROWS = 4096


def kmeans_starts(points: DataFrame, wanted: list[tuple[int, int]], seed: int = 42) -> list[np.ndarray]:
    """k-means++ starts for each (k, seed), drawn from ``START_ROWS`` rows at most; repeated where there are fewer distinct ones."""
    rows = points.select("sample_id", "features").orderBy(priority(seed, "sample_id"), "sample_id").limit(START_ROWS).collect()
    x, out = np.array([r.features for r in rows], dtype=float), []
    if not len(x):
        raise ValueError("no rows")
    for k, own in wanted:
        rng = np.random.default_rng(own)
        chosen = [int(rng.integers(len(x)))]
        d2 = ((x - x[chosen[0]]) ** 2).sum(axis=1)
        while len(chosen) < k:
            chosen.append(int(rng.choice(len(x), p=d2 / d2.sum()) if d2.sum() > 0 else rng.integers(len(x))))
            d2 = np.minimum(d2, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
        out.append(x[chosen])
    return out


def _statistics_of_many(rows: DataFrame, models: dict[int, np.ndarray]) -> dict[tuple[int, int], tuple]:
    """(model, cluster): (weight, sums, objective) in one pass for all models."""
    told = rows.sparkSession.sparkContext.broadcast(models)
    d = next(iter(models.values())).shape[1]

    def run(batches):
        whole: dict[int, list] = {}
        for batch in batches:
            if batch.num_rows:
                x = batch_features(batch)
                for m, centers in told.value.items():
                    parts = kmeans_kernel(centers)(x)
                    whole[m] = [a + b for a, b in zip(whole[m], parts, strict=True)] if m in whole else list(parts)
        for m, (w, s, objective) in whole.items():
            yield pa.RecordBatch.from_arrays([pa.array([m] * len(w), pa.int32()), pa.array(range(len(w)), pa.int32()), pa.array(w), pa.array(list(s), pa.list_(pa.float64())), pa.array(objective)], names=["model", "cluster", "w", "s", "objective"])

    parts = rows.select("features").mapInArrow(run, "model int, cluster int, w double, s array<double>, objective double")
    sums = parts.groupBy("model", "cluster").agg(F.sum("w").alias("w"), F.array(*[F.sum(F.col("s")[i]) for i in range(d)]).alias("s"), F.sum("objective").alias("objective"))
    return {(r.model, r.cluster): (r.w, np.array(r.s), r.objective) for r in sums.collect()}


#: Rows and numbers of a part that is read again and again: no fewer rows, and about so many numbers.
PART_ROWS, PART_NUMBERS = 1024, 1 << 23


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` (features) dealt evenly over the cores: a file with one group of rows is read by one task, whatever its size."""
    r = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("features")).alias("numbers")).first()
    wanted = max(rows.sparkSession.sparkContext.defaultParallelism, (r.numbers or 0) // PART_NUMBERS)
    return rows.repartition(max(1, min(wanted, r.n // PART_ROWS)))


def kmeans_many(points: DataFrame, starts: list[np.ndarray], max_iter: int = 300, tol: float = 1e-4) -> list[tuple[np.ndarray, float]]:
    """(centres, inertia) from each start; all models take a step in one pass, until no centre of theirs moves by more than ``tol``."""
    rows = materialise(spread(points.select("features")), "kmeans-rows")
    centers, live = [np.array(s, dtype=float) for s in starts], set(range(len(starts)))
    for _ in range(max_iter):
        stats = _statistics_of_many(rows, {m: centers[m] for m in live})
        for m in sorted(live):
            new = np.array([stats[m, j][1] / stats[m, j][0] if stats[m, j][0] > 0 else c for j, c in enumerate(centers[m])])
            if np.sqrt(((new - centers[m]) ** 2).sum(axis=1)).max() <= tol:
                live.discard(m)
            centers[m] = new
        if not live:
            break
    last = _statistics_of_many(rows, dict(enumerate(centers)))
    return [(c, float(sum(last[m, j][2] for j in range(len(c))))) for m, c in enumerate(centers)]


def kmeans(points: DataFrame, k: int, n_init: int = 10, max_iter: int = 300, tol: float = 1e-4, seed: int = 42) -> ClusterResult:
    """Central k-means: the restart of least inertia; all restarts are refitted together."""
    found = kmeans_many(points, kmeans_starts(points, [(k, seed + i) for i in range(n_init)], seed), max_iter, tol)
    centers, inertia = min(found, key=lambda f: f[1])
    return ClusterResult(assign_nearest(points, centers).drop("d2"), {"centers": centers, "inertia": inertia})
