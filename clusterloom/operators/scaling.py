"""Validation and feature preparation (P1, P3-P9, S5). ``points`` holds sample_id, features and whatever else."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterloom.functions.arrays import literal, norm

#: Published medians and interquartile ranges of the full Dry Bean table (Krishnan et al. 2023, table 2).
DRY_BEAN_MEDIANS = [
    52981.50, 911.06, 350.62, 203.69, 1.575, 0.7724, 53858.50, 259.73, 0.7637, 0.9880, 0.866, 0.795, 0.0063, 0.0014, 0.632, 0.996,
]
DRY_BEAN_IQRS = [
    34769.75, 327.30, 137.24, 57.70, 0.284, 0.0945, 35503.50, 82.62, 0.0662, 0.0052, 0.085, 0.073, 0.0016, 0.0010, 0.116, 0.005,
]

#: Centre and scale of data sets that may be scaled without being looked at; an interquartile range is 1.349 deviations.
PUBLIC_SCALES: dict[str, tuple[list[float], list[float]]] = {"dry_bean": (DRY_BEAN_MEDIANS, [v / 1.349 for v in DRY_BEAN_IQRS])}


def validate_points(points: DataFrame) -> dict:
    """Rows, features; an error unless there are 3 rows, one width of at least 1, and only finite values."""
    ok = F.forall("features", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    r = points.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("features")).alias("lo"), F.max(F.size("features")).alias("hi"), F.bool_and(ok).alias("finite"), F.count("features").alias("given")).first()
    if r.n < 3 or r.given < r.n or r.lo != r.hi or r.lo < 1 or not r.finite:
        raise ValueError(f"not a feature table: rows {r.n}, widths {r.lo} to {r.hi}, all finite {r.finite}")
    return {"rows": r.n, "features": r.lo}


def feature_moments(points: DataFrame) -> DataFrame:
    """pos, n, mean, std (population), lo, hi of each feature: one aggregate, as many rows as features."""
    cells = points.select(F.posexplode("features").alias("pos", "x"))
    return cells.groupBy("pos").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("lo"), F.max("x").alias("hi"))


def _affine(points: DataFrame, shift: list[float], divide: list[float]) -> DataFrame:
    centred = F.zip_with("features", literal(shift), lambda x, c: x - c)
    return points.withColumn("features", F.zip_with(centred, literal(divide), lambda x, s: x / s))


def scale_standard(points: DataFrame) -> DataFrame:
    """(x - mean) / population deviation; a constant feature is divided by 1."""
    m = feature_moments(points).orderBy("pos").collect()
    return _affine(points, [r["mean"] for r in m], [r["std"] or 1.0 for r in m])


def scale_minmax(points: DataFrame) -> DataFrame:
    """To [0, 1]; a constant feature becomes 0."""
    m = feature_moments(points).orderBy("pos").collect()
    return _affine(points, [r.lo for r in m], [(r.hi - r.lo) or 1.0 for r in m])


def scale_public(points: DataFrame, centre: list[float], scale: list[float]) -> DataFrame:
    """By published figures alone, so that nothing is learned from the rows."""
    return _affine(points, centre, scale)


def scale_public_named(points: DataFrame, name: str) -> DataFrame:
    if name not in PUBLIC_SCALES:
        raise ValueError(f"no published scale for {name!r}; known: {sorted(PUBLIC_SCALES)}")
    return scale_public(points, *PUBLIC_SCALES[name])


def scale_unit(points: DataFrame, whole: float = 255.0) -> DataFrame:
    return points.withColumn("features", F.transform("features", lambda x: x.cast("double") / whole))


def preprocess(points: DataFrame, mode: str) -> DataFrame:
    modes = {"standard": scale_standard, "minmax": scale_minmax, "raw": lambda p: p}
    if mode not in modes:
        raise ValueError(f"unknown preprocessing {mode!r}; known: {sorted(modes)}")
    return modes[mode](points)


def clip_l2(points: DataFrame, bound: float) -> DataFrame:
    """x * min(1, bound / max(|x|, 1e-12))."""
    by = F.least(F.lit(1.0), F.lit(bound) / F.greatest(norm("features"), F.lit(1e-12)))
    return points.withColumn("__by", by).withColumn("features", F.transform("features", lambda x: x * F.col("__by"))).drop("__by")


def clip_report(points: DataFrame, bound: float) -> DataFrame:
    """clipped_fraction, median_norm, p95_norm, mean_shift of what :func:`clip_l2` would do."""
    n = points.select(norm("features").alias("n"))
    return n.agg(
        F.avg((F.col("n") > bound).cast("double")).alias("clipped_fraction"),
        F.percentile("n", F.lit(0.5)).alias("median_norm"),
        F.percentile("n", F.lit(0.95)).alias("p95_norm"),
        F.avg(F.greatest(F.col("n") - bound, F.lit(0.0))).alias("mean_shift"),
    )


def assigned(predictions: DataFrame) -> DataFrame:
    """Without noise."""
    return predictions.filter("cluster <> -1")
