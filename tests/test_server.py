import numpy as np
import pytest
from pyspark.sql import functions as F

from clusterloom.operators import client_models, neighbours, privacy, server, shared_neighbours


def plain_peaks(x, k, neighbours):
    """All distances and similarities as matrices."""
    m = len(x)
    kappa = min(neighbours, m)
    d = np.sqrt(((x[:, None, :] - x[None]) ** 2).sum(axis=2))
    near = np.argsort(d, axis=1, kind="stable")[:, :kappa]
    member = np.zeros((m, m), dtype=bool)
    member[np.arange(m)[:, None], near] = True
    spread = (member * d) @ member.T
    spread = spread + spread.T
    similar = np.where(member & member.T & (spread > 0), (member.astype(float) @ member.T) ** 2 / np.maximum(spread, 1e-300), 0.0)
    np.fill_diagonal(similar, 0.0)
    rho, reach = similar.sum(axis=1), (member * d).sum(axis=1)
    gap, delta = d * (reach[:, None] + reach[None]), np.zeros(m)
    order = np.lexsort((np.arange(m), -rho))
    for place, i in enumerate(order):
        delta[i] = gap[i, order[:place]].min() if place else 0.0
    delta[order[0]] = delta.max() if m > 1 else 1.0
    return x[np.lexsort((np.arange(m), -(rho * delta)))[:k]]


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id bigint, features array<double>")


@pytest.mark.parametrize(("n", "width", "kappa", "part"), [(1000, 2, 20, 64), (400, 5, 12, 512), (300, 2, 2, 16), (3, 2, 20, 512), (1, 3, 5, 512)])
def test_peaks_against_matrices(spark, n, width, kappa, part):
    rng = np.random.default_rng(n)
    x = np.concatenate([rng.normal(c, 0.3 + 0.1 * c, (n // 4 + 1, width)) for c in range(4)])[:n]
    k = min(6, n)
    assert np.allclose(shared_neighbours.snn_peaks(frame(spark, x), k, kappa, part), plain_peaks(x, k, kappa))


def plain_lloyd(x, centers, steps):
    for _ in range(steps):
        label = ((x[:, None] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)
        n = np.bincount(label, minlength=len(centers))
        centers = np.array([x[label == j].mean(axis=0) if n[j] else centers[j] for j in range(len(centers))])
    return centers, n


def test_lloyd_of_clients_with_a_hot_one(spark):
    rng = np.random.default_rng(7)
    client = np.concatenate([np.zeros(300, int), rng.integers(1, 40, 500)])
    x = rng.normal(client[:, None] % 5, 1.0, (800, 3))
    points = spark.createDataFrame([(i, int(c), [float(v) for v in row]) for i, (c, row) in enumerate(zip(client, x, strict=True))], "sample_id bigint, client_id int, features array<double>")
    packs = client_models.client_packs(points, pack=32)
    assert packs.agg(F.max(F.size("rows"))).first()[0] < 100 and packs.filter("client_id = 0").count() > 5
    starts = client_models.client_starts(points, 3, 1)
    begun = {(r.client_id, r.cluster): r.center for r in starts.collect()}
    got = {(r.client_id, r.cluster): (r.center, r.n) for r in client_models.client_lloyd(packs, starts, 3, drop_empty=False).collect()}
    for c in np.unique(client):
        own = np.array([begun[c, j] for j in range(3) if (c, j) in begun])
        centers, n = plain_lloyd(x[client == c], own, 3)
        for j in range(len(own)):
            assert np.allclose(got[c, j][0], centers[j]) and got[c, j][1] == n[j]


def test_a_summary_keeps_weights_and_sums(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 0.1, (900, 2)), rng.normal(5, 0.1, (600, 2)), np.ones((500, 2))])
    w = rng.integers(1, 9, len(x)).astype(float)
    rows = spark.createDataFrame([(i, [float(v) for v in r], float(n)) for i, (r, n) in enumerate(zip(x, w, strict=True))], "id bigint, center array<double>, weight double")
    same, weights = client_models.summary(rows, 1)
    assert np.allclose(same, x) and np.allclose(weights, w)
    few, weights = client_models.summary(rows, 1, size=100, keep=40)
    assert len(few) <= 100 and np.isclose(weights.sum(), w.sum()) and np.allclose((few * weights[:, None]).sum(axis=0), (x * w[:, None]).sum(axis=0))
    centers = client_models.weighted_kmeans(few, weights, 3, 2)
    assert all(min(np.linalg.norm(c - t) for c in centers) < 0.3 for t in ([0, 0], [5, 5], [1, 1]))


def test_many_clients_without_a_driver_table(spark):
    """Users as clients: server methods run over all of them, and label every row."""
    rng = np.random.default_rng(2)
    rows = [(i, i % 200, [float(v) for v in rng.normal((i % 3) * 4, 0.5, 2)]) for i in range(2400)]
    points = spark.createDataFrame(rows, "sample_id bigint, client_id int, features array<double>")
    for result in (server.fed_server_kmeans(points, 3, rounds=3), server.fed_snn_peaks(points, 3, 10), server.fed_personalised(points, 3, 2)):
        assert result.predictions.count() == 2400
    truth = {i: i % 3 for i, _, _ in rows}
    found = server.fed_server_kmeans(points, 3, rounds=3).predictions.collect()
    assert len({(truth[r.sample_id], r.cluster) for r in found}) == 3
    assert server.fed_personalised(points, 3, 2).model["client_costs"].count() == 200
    with pytest.raises(ValueError, match="fewer than"):
        server.fed_snn_peaks(points.filter("client_id <> 3 or sample_id = 3"), 3)


def test_private_methods_take_few_prototypes(spark):
    points = spark.createDataFrame([(i, i % 4, [float(i % 7), float(i % 5)]) for i in range(80)], "sample_id bigint, client_id int, features array<double>")
    for method in ("server_kmeans", "snn", "nn", "personalised"):
        for eps in (0.01, 50.0):
            assert privacy.fed_server_dp(method, points, 3, eps, 1e-5, 4.0, rounds=2).predictions.count() == 80
    assert neighbours.knn(points.limit(1), 3).count() == 1
