"""Central mixtures and hierarchies."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterloom.operators.rounds import ClusterResult, assign_nearest, batch_features, kmeans, label_by, priority_centers

COVARIANCES = ("full", "diag", "tied", "spherical")


def _log_density(x: np.ndarray, weights: np.ndarray, means: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """``roots``: lower Cholesky factors of the covariances."""
    out = np.empty((len(x), len(means)))
    for j, (m, low) in enumerate(zip(means, roots, strict=True)):
        z = np.linalg.solve(low, (x - m).T)
        out[:, j] = math.log(weights[j] + 1e-300) - 0.5 * (z * z).sum(axis=0) - np.log(np.diag(low)).sum() - 0.5 * x.shape[1] * math.log(2 * math.pi)
    return out


def _m_step(n: np.ndarray, s: np.ndarray, q: np.ndarray, kind: str, reg: float):
    d = s.shape[1]
    n = np.maximum(n, 1e-12)
    means = s / n[:, None]
    cov = q / n[:, None, None] - means[:, :, None] * means[:, None, :]
    if kind == "tied":
        cov = np.tile((cov * n[:, None, None]).sum(axis=0) / n.sum(), (len(n), 1, 1))
    elif kind == "diag":
        cov = cov * np.eye(d)
    elif kind == "spherical":
        cov = np.einsum("kii->k", cov)[:, None, None] / d * np.eye(d)
    return n / n.sum(), means, cov + reg * np.eye(d)


def gmm(points: DataFrame, k: int, covariance_type: str = "full", reg_covar: float = 1e-6, max_iter: int = 100, tol: float = 1e-3, seed: int = 42, start: np.ndarray | None = None) -> ClusterResult:
    """Gaussian mixture by EM. The E-step sends, for each task, k weights, sums and d by d products; it ends when the mean
    log likelihood grows by less than ``tol``. It starts from k-means unless ``start`` gives centres."""
    if covariance_type not in COVARIANCES:
        raise ValueError(f"unknown covariance {covariance_type!r}; known: {COVARIANCES}")
    centers = kmeans(points, k, n_init=1, seed=seed).model["centers"] if start is None else np.asarray(start, dtype=float)
    d = centers.shape[1]

    def hard(x):
        r = np.zeros((len(x), len(centers)))
        r[np.arange(len(x)), ((x[:, None, :] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)] = 1.0
        return r, 0.0

    def soft(model):
        def run(x):
            log_p = _log_density(x, *model)
            top = log_p.max(axis=1, keepdims=True)
            whole = top + np.log(np.exp(log_p - top).sum(axis=1, keepdims=True))
            return np.exp(log_p - whole), float(whole.sum())

        return run

    def sums(responsibilities):
        def run(batches):
            n, s, q, fit, rows = 0.0, 0.0, 0.0, 0.0, 0
            for batch in batches:
                if batch.num_rows:
                    x = batch_features(batch)
                    r, part = responsibilities(x)
                    n, s, q, fit, rows = n + r.sum(axis=0), s + r.T @ x, q + np.einsum("nk,ni,nj->kij", r, x, x, optimize=True), fit + part, rows + len(x)
            if rows:
                flat = [pa.array([np.asarray(v).ravel()], pa.list_(pa.float64())) for v in (n, s, q)]
                yield pa.RecordBatch.from_arrays([*flat, pa.array([fit]), pa.array([rows], pa.int64())], names=["n", "s", "q", "fit", "rows"])

        parts = points.select("features").mapInArrow(run, "n array<double>, s array<double>, q array<double>, fit double, rows bigint")
        # Arrays are added up by place: k, k d and k d d rows. One job a step.
        every = {c: F.col(c) for c in "nsq"} | {c: F.array(F.col(c).cast("double")) for c in ("fit", "rows")}
        cells = parts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("what"), v.alias("v")) for c, v in every.items()])).alias("e")).select("e.what", F.posexplode("e.v").alias("pos", "x"))
        rows = cells.groupBy("what", "pos").agg(F.sum("x").alias("x")).orderBy("what", "pos").collect()
        get = lambda c: np.array([r.x for r in rows if r.what == c])
        return get("n"), get("s").reshape(k, d), get("q").reshape(k, d, d), get("fit")[0] / get("rows")[0]

    n, s, q, _ = sums(hard)
    history, before = [], -np.inf
    for turn in range(1, max_iter + 1):
        weights, means, cov = _m_step(n, s, q, covariance_type, reg_covar)
        model = (weights, means, np.linalg.cholesky(cov))
        n, s, q, fit = sums(soft(model))
        history.append({"round": turn, "shift": abs(fit - before) if before > -np.inf else None, "objective": fit})
        if fit - before < tol:
            break
        before = fit
    return ClusterResult(label_by(points, lambda x: _log_density(x, *model)), {"weights": weights, "means": means, "covariances": cov}, history)


def micro_clusters(points: DataFrame, m: int, seed: int = 42) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Rows with their micro-cluster, the micro-clusters' centres and sizes. At most ``m``; with as many rows or fewer, each row its own."""
    centers = priority_centers(points.withColumn("client_id", F.lit(0)), min(m, points.count()), seed)
    if len(centers) == m:
        for _ in range(3):  # a few Lloyd steps; the merge needs small cells, not best ones
            labelled = assign_nearest(points, centers, keep=["sample_id", "features"])
            cells = labelled.select("cluster", F.posexplode("features").alias("pos", "x")).groupBy("cluster", "pos").agg(F.avg("x").alias("x")).collect()
            for r in cells:
                centers[r.cluster, r.pos] = r.x
    labelled = assign_nearest(points, centers).drop("d2").withColumnRenamed("cluster", "micro")
    sizes = np.zeros(len(centers))
    for r in labelled.groupBy("micro").count().collect():
        sizes[r.micro] = r["count"]
    return labelled, centers, sizes


def merge_tree(centers: np.ndarray, sizes: np.ndarray, k: int, linkage: str = "ward") -> np.ndarray:
    """Label of each weighted point when ``k`` groups are left (Lance-Williams updates; the least pair first)."""
    if linkage not in ("ward", "complete", "average", "single"):
        raise ValueError(f"unknown linkage {linkage!r}")
    m = len(centers)
    d = ((centers[:, None, :] - centers[None]) ** 2).sum(axis=2)
    size = sizes.astype(float).copy()
    if linkage == "ward":
        d = d * (size[:, None] * size[None]) / np.maximum(size[:, None] + size[None], 1e-300)
    else:
        d = np.sqrt(d)
    np.fill_diagonal(d, np.inf)
    alive = np.ones(m, dtype=bool)
    label = np.arange(m)
    for _ in range(m - max(1, k)):
        i, j = divmod(int(d.argmin()), m)
        i, j = min(i, j), max(i, j)
        others = alive.copy()
        others[[i, j]] = False
        di, dj = d[i, others], d[j, others]
        if linkage == "ward":
            so = size[others]
            new = ((size[i] + so) * di + (size[j] + so) * dj - so * d[i, j]) / (size[i] + size[j] + so)
        elif linkage == "complete":
            new = np.maximum(di, dj)
        elif linkage == "single":
            new = np.minimum(di, dj)
        else:
            new = (size[i] * di + size[j] * dj) / (size[i] + size[j])
        d[i, others] = d[others, i] = new
        d[j, :] = d[:, j] = np.inf
        size[i] += size[j]
        alive[j] = False
        label[label == j] = i
    return np.unique(label, return_inverse=True)[1]


def agglomerative(points: DataFrame, k: int, linkage: str = "ward", micro: int = 500, seed: int = 42) -> ClusterResult:
    """Hierarchical clusters of weighted micro-clusters; with ``micro`` rows or fewer exact. The merge is micro by micro."""
    labelled, centers, sizes = micro_clusters(points, micro, seed)
    used = np.flatnonzero(sizes > 0)
    merged = merge_tree(centers[used], sizes[used], k, linkage)
    table = F.broadcast(points.sparkSession.createDataFrame([(int(u), int(c)) for u, c in zip(used, merged, strict=True)], "micro int, cluster int"))
    return ClusterResult(labelled.join(table, "micro").drop("micro"), {"micro": len(used), "linkage": linkage})
