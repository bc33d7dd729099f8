import numpy as np
import pytest
from pyspark.sql import functions as F

from clusterloom import queries
from clusterloom.operators import cell_graph, density, neighbours, scaling


def points(spark, x):
    return spark.createDataFrame([(int(i) * 3 + 1, [float(v) for v in row]) for i, row in enumerate(x)], "sample_id bigint, features array<double>")


def plain_distances(x, metric):
    gap = np.abs(x[:, None, :] - x[None, :, :])
    return gap.max(axis=2) if metric == "chebyshev" else np.sqrt((gap**2).sum(axis=2))


def grid(rng, n, width):
    """Values with few digits: many ties and equal rows."""
    return rng.integers(0, 12, (n, width)) / 4


@pytest.mark.parametrize(("metric", "width", "m", "part"), [("euclidean", 2, 5, 16), ("chebyshev", 3, 4, 16), ("euclidean", 12, 3, 512), ("euclidean", 1, 40, 8)])
def test_neighbours_against_all_pairs(spark, metric, width, m, part):
    x = grid(np.random.default_rng(width), 300, width)
    x[200:260] = x[0]  # a group of copies larger than m
    d, ids = plain_distances(x, metric), np.arange(len(x)) * 3 + 1
    want = {(int(ids[i]), place + 1): (int(ids[j]), round(float(d[i, j]), 9)) for i in range(len(x)) for place, j in enumerate(np.lexsort((ids, d[i].round(12)))[:m])}
    got = {(r.sample_id, r.place): (r.neighbour, round(r.d, 9)) for r in neighbours.knn(points(spark, x), m, metric, part).collect()}
    assert got == want


def test_neighbours_of_few_rows_and_none(spark):
    few = points(spark, [[0.0, 0.0], [3.0, 4.0]])
    assert sorted((r.sample_id, r.neighbour, r.d, r.place) for r in neighbours.knn(few, 5).collect()) == [(1, 1, 0.0, 1), (1, 4, 5.0, 2), (4, 1, 5.0, 2), (4, 4, 0.0, 1)]
    assert neighbours.knn(few.limit(0), 5).count() == 0
    with pytest.raises(ValueError, match="unknown metric"):
        neighbours.knn(few, 1, "taxi")


def test_few_pairs_are_compared(spark):
    """Customers of the large tables: under a tenth of all pairs, and no cross join."""
    rows = neighbours.materialise(neighbours.vectors(scaling.scale_standard(queries.customers(spark, "/root/testdata/sf0.1")), 5), "vectors").select("id", "features")
    index = neighbours.pivot_index(rows)
    first = neighbours.materialise(neighbours.first_neighbours(index, 5), "first")
    asked = neighbours.asked_parts(index.parts, first)
    size = lambda c: F.size(c).cast("bigint")
    own = index.parts.agg(F.sum(size("rows") * size("rows"))).first()[0]
    others = asked.agg(F.sum(size("rows") * size("asking"))).first()[0]
    n = rows.count()
    print(f"{own + others} of {n * n} pairs compared")
    assert own + others < 0.1 * n * n
    assert "Cartesian" not in asked._jdf.queryExecution().executedPlan().toString()


def plain_clusters(x, eps, least, metric):
    near = plain_distances(x, metric) <= eps
    core = near.sum(axis=1) >= least
    root = np.where(core, np.arange(len(x)), len(x))
    while True:
        new = np.where(core, np.where(near & core[None, :], root[None, :], len(x)).min(axis=1), len(x))
        if (new == root).all():
            break
        root = new
    reach = np.where(near & core[None, :], root[None, :], len(x)).min(axis=1)
    return {i * 3 + 1: int(r) * 3 + 1 for i, r in enumerate(reach) if r < len(x)}


@pytest.mark.parametrize(("metric", "width", "eps", "least"), [("euclidean", 2, 0.07, 4), ("euclidean", 3, 0.2, 5), ("chebyshev", 2, 0.05, 6), ("euclidean", 1, 0.004, 3), ("euclidean", 2, 0.3, 9)])
def test_cells_against_all_pairs(spark, metric, width, eps, least):
    rng = np.random.default_rng(int(eps * 1000))
    x = np.concatenate([rng.random((250, width)), rng.normal(0.5, 0.02, (80, width))])
    x[300:] = x[250]  # a hot cell, split into parts
    got = {r.sample_id: r.component for r in cell_graph.clusters(points(spark, x), eps, least, metric, part=8).collect()}
    assert got == plain_clusters(x, eps, least, metric)


@pytest.mark.parametrize(("metric", "width"), [("euclidean", 2), ("chebyshev", 3)])
def test_cells_of_many_radii_against_all_pairs(spark, metric, width):
    """Points on both sides of block borders, and in more blocks than one for each radius."""
    rng = np.random.default_rng(width)
    x = np.concatenate([rng.random((200, width)) * 2 - 1, np.round(rng.random((100, width)), 1), np.zeros((30, width))])
    radii = [0.02, 0.11, 0.25]
    rows = cell_graph.clusters_many(points(spark, x), radii, 5, metric, part=8).collect()
    for c, eps in enumerate(radii):
        assert {r.sample_id: r.component for r in rows if r.candidate == c} == plain_clusters(x, eps, 5, metric)


def test_cells_that_only_inner_rows_link(spark):
    """The outermost rows of two cells are far from each other, so that the full test must find the link."""
    side = 1 / np.sqrt(2)
    a = [[0.01, 0.01], [0.01, 0.7], [0.35, 0.01], [0.6, 0.35], [0.35, 0.7]]
    b = [[x + 2 * side - 0.02, y] for x, y in [[0.69, 0.01], [0.69, 0.7], [0.4, 0.01], [0.0301, 0.36], [0.4, 0.7]]]
    for x in (np.array(a + b), np.array([[v, w] for v, w in a] + [[v + 3, w] for v, w in b])):
        got = {r.sample_id: r.component for r in cell_graph.clusters(points(spark, x), 1.0, 3).collect()}
        assert got == plain_clusters(x, 1.0, 3, "euclidean")


def test_cells_refuse_many_features_and_take_none(spark):
    with pytest.raises(ValueError, match="at most"):
        cell_graph.clusters(points(spark, [[0.0] * 4]), 1.0, 1)
    assert cell_graph.clusters(points(spark, [[0.0]]).limit(0), 1.0, 1).count() == 0
    same = points(spark, [[1.0, 2.0]] * 20)
    assert {r.cluster for r in density.dbscan(same, 0.0, 20).predictions.collect()} == {0}
    assert {r.cluster for r in density.dbscan(same, 0.0, 21).predictions.collect()} == {-1}


def test_rings_are_no_more_than_parts_and_rows_look_at_blocks_nearby(spark):
    """A cell a little larger than a part was cut into 16 rings, and each row was held against all of them."""
    x = np.random.default_rng(5).random((1500, 2))
    index = neighbours.pivot_index(points(spark, x).withColumnRenamed("sample_id", "id"), part=32)
    cells = np.bincount(index.owner, weights=index.count).astype(int)
    rings = np.bincount(index.owner)
    assert (rings <= np.ceil(cells / 32) + 1).all() and rings.max() > 1
    d = plain_distances(x, "euclidean")
    fifth = float(np.sort(d, axis=1)[:, 4].max())
    seen = [index.around(b, np.array([fifth]), 5) for b in range(len(index.owner))]
    assert np.mean([len(blocks) for blocks, _ in seen]) < len(index.owner) / 2
    assert all(b in blocks and holds > 0 for b, (blocks, holds) in enumerate(seen))
