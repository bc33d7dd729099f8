import numpy as np
import pytest
from pyspark.sql import functions as F

from clusterloom.operators import density, metrics, partitioning, rounds, scaling, tuning


def points(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "sample_id bigint, features array<double>")


def blobs(seed=3, n=240):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(c, 0.4, (n // 3, 2)) for c in ((0, 0), (4, 0), (0, 5))])


def plain_lloyd(x, centers, tol):
    while True:
        label = ((x[:, None] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)
        new = np.array([x[label == j].mean(axis=0) if (label == j).any() else c for j, c in enumerate(centers)])
        done = np.sqrt(((new - centers) ** 2).sum(axis=1)).max() <= tol
        centers = new
        if done:
            return centers, ((x[:, None] - centers[None]) ** 2).sum(axis=2).min(axis=1).sum()


def test_all_models_together_end_where_each_ends_alone(spark):
    x = blobs()
    rows = points(spark, x)
    starts = rounds.kmeans_starts(rows, [(2, 1), (3, 1), (3, 2), (5, 1)])
    assert [len(s) for s in starts] == [2, 3, 3, 5]
    for (centers, inertia), start in zip(rounds.kmeans_many(rows, starts), starts, strict=True):
        want, least = plain_lloyd(x, start, 1e-4)
        assert np.allclose(centers, want) and inertia == pytest.approx(least)
    assert rounds.kmeans(rows, 3).model["inertia"] == pytest.approx(plain_lloyd(x, np.array([[0.0, 0], [4, 0], [0, 5]]), 1e-4)[1])
    few = rounds.kmeans(points(spark, [[1.0, 1.0]] * 4), 3, n_init=2)
    assert few.model["inertia"] == 0 and few.predictions.count() == 4
    with pytest.raises(ValueError, match="no rows"):
        rounds.kmeans_starts(rows.limit(0), [(2, 1)])


def test_silhouettes_of_all_candidates_are_those_of_each(spark):
    x, rng = blobs(), np.random.default_rng(1)
    labels = [[int(i // 80), int(rng.integers(-1, 4)), 0, int(i) if i % 2 else -1, -1] for i in range(len(x))]
    rows = spark.createDataFrame([(i, [float(v) for v in r], own) for i, (r, own) in enumerate(zip(x, labels, strict=True))], "sample_id bigint, features array<double>, labels array<int>")
    got = {r.candidate: r for r in metrics.silhouettes(rows, 200).collect()}
    for c in range(5):
        one = rows.withColumn("cluster", F.col("labels")[c])
        want, d = metrics.silhouette(one, 200).first()[0], metrics.label_diagnostics(one, 0).first()
        assert got[c].silhouette == (None if want is None else pytest.approx(want))
        assert (got[c].coverage, got[c].clusters, got[c].assigned) == (pytest.approx(d.assigned_fraction), d.clusters_found, d.assigned_count)


def test_candidates_of_dbscan_together_are_those_of_each(spark):
    rows = points(spark, blobs(5, 180))
    grid = [(0.15, 3), (0.3, 5), (0.9, 5), (0.01, 4)]
    found = {r.sample_id: r.labels for r in tuning.dbscan_many(rows, grid).collect()}
    for c, (eps, m) in enumerate(grid):
        alone = {r.sample_id: r.cluster for r in density.dbscan(rows, eps, m).predictions.collect()}
        names = {}
        assert all(names.setdefault(alone[i], found[i][c]) == found[i][c] and (alone[i] < 0) == (found[i][c] < 0) for i in found)
        assert len(set(names.values())) == len(names)


def test_choices_at_the_defaults(spark):
    rows = points(spark, blobs(7, 300))
    k, tried = tuning.estimate_k(rows)
    assert k == 3 and len(tried) == 8
    best, tried = tuning.tune_dbscan(rows)
    assert len(tried) == 8 and max(t["score"] for t in tried if t["score"] is not None) == next(t["score"] for t in tried if t["eps"] == best["eps"] and t["min_samples"] == best["min_samples"])


def test_sweep_of_few_features_makes_no_pairs(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(c, 0.2, (40, 2)) for c in (0, 3)])
    rows = spark.createDataFrame([(i, [float(v) for v in r], i // 40) for i, r in enumerate(x)], "sample_id bigint, features array<double>, label int")
    monkeypatch.setattr(tuning, "range_join", lambda *a, **k: pytest.fail("pairs of all rows"))
    out = tuning.density_sensitivity(rows, quantiles=(0.5,))
    assert [r.algorithm for r in out.select("algorithm").collect()] == ["dbscan", "grid_density"]


@pytest.mark.parametrize("width", [2, 4])
def test_sweep_of_all_radii_together_is_that_of_each(spark, width):
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.normal(c, s, (60, width)) for c, s in ((0, 0.2), (3, 0.4), (5, 1.0))])
    rows = spark.createDataFrame([(i, [float(v) for v in r], i // 60) for i, r in enumerate(x)], "sample_id bigint, features array<double>, label int")
    quantiles = (0.2, 0.5, 0.8)
    got = tuning.density_sensitivity(rows, quantiles=quantiles).collect()
    standard, unit = scaling.scale_standard(rows), scaling.scale_minmax(rows)
    dealt = unit.join(partitioning.make_partition(unit, "iid", 5, 42), "sample_id")
    radii = [density.radius_candidates(standard, 5, list(quantiles)), density.radius_candidates(unit, 5, list(quantiles), "chebyshev")]
    alone = [density.dbscan(standard, r, 5).predictions.select("sample_id", "cluster").join(standard, "sample_id") for r in radii[0]]
    alone += [density.fed_grid_density(dealt, r, 5).predictions.select("sample_id", "cluster").join(unit, "sample_id") for r in radii[1]]
    assert [(r.algorithm, r.partition, r.quantile, r.radius) for r in got] == [(a, p, q, pytest.approx(r)) for (a, p), own in zip((("dbscan", "local"), ("grid_density", "iid")), radii, strict=True) for q, r in zip(quantiles, own, strict=True)]
    for r, scored in zip(got, alone, strict=True):
        want = metrics.label_diagnostics(scored, 3).crossJoin(metrics.external(metrics.contingency(scored)).select("ari", "nmi")).crossJoin(metrics.silhouette(scored).withColumnRenamed("silhouette", "silhouette_own_space")).first().asDict()
        assert {k: r[k] for k in want} == {k: v if v is None or isinstance(v, str | bool) else pytest.approx(v) for k, v in want.items()}


def test_more_radii_take_no_more_jobs(spark):
    """Each radius was clustered by itself: 969 jobs over 1500 rows."""
    rng = np.random.default_rng(12)
    rows = spark.createDataFrame([(i, [float(v) for v in r], i % 3) for i, r in enumerate(rng.random((150, 2)))], "sample_id bigint, features array<double>, label int")

    def jobs(quantiles):
        group = f"sweep-{len(quantiles)}"
        spark.sparkContext.setJobGroup(group, group)
        try:
            assert len(tuning.density_sensitivity(rows, quantiles=quantiles).collect()) == 2 * len(quantiles)
            return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

    assert 0 < jobs(tuning.QUANTILES) < 2 * jobs((0.5,))


def test_sweep_of_copies_has_cells_of_the_least_size(spark):
    """Rows with five copies or more have radii of the machine's epsilon, whose cells pass 32 bits."""
    x = np.random.default_rng(13).random((20, 2))
    rows = spark.createDataFrame([(i, [float(v) for v in x[i % 20]], i % 2) for i in range(120)], "sample_id bigint, features array<double>, label int")
    for r in tuning.density_sensitivity(rows, quantiles=(0.2, 0.8)).collect():
        assert r.radius == np.finfo(float).eps and (r.clusters_found, r.assigned_count, r.noise_fraction) == (20, 120, 0.0)
