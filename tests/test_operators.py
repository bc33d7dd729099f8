import gzip
import itertools
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from clusterloom.operators import central, density, graph, metrics, partitioning, privacy, rounds, run_statistics, scaling, schedule, server, tuning
from clusterloom.plans import experiments, history
from clusterloom.plans.request import RunRequest, algorithm_names, effective_params, get_algorithm
from clusterloom.sources import points as sources
from clusterloom.sources import run_store, sinks


@pytest.fixture(scope="module")
def blobs(spark):
    return sources.make_blobs(spark, 300, 3, 0.5, 7).persist()


@pytest.fixture(scope="module")
def dealt(blobs):
    return graph.materialise(blobs.join(partitioning.partition_iid(blobs, 5, 1), "sample_id"), "dealt")


def frame(spark, rows, clusters=None, labels=None):
    out = [(i, [float(v) for v in x], None if clusters is None else int(clusters[i]), None if labels is None else int(labels[i])) for i, x in enumerate(rows)]
    return spark.createDataFrame(out, "sample_id bigint, features array<double>, cluster int, label int")


# Sources and sinks


def test_arff(spark, tmp_path):
    (tmp_path / "a.arff").write_text("% x\n@RELATION r\n@ATTRIBUTE Area REAL\n@attribute P real\n@ATTRIBUTE Class {B,A}\n@DATA\n1,2,B\n3,4,A\n5,6,B\n")
    rows = {tuple(r.features): r.label for r in sources.read_arff(spark, str(tmp_path / "a.arff")).collect()}
    assert rows == {(1.0, 2.0): 1, (3.0, 4.0): 0, (5.0, 6.0): 1}
    (tmp_path / "b.arff").write_text("@ATTRIBUTE a REAL\n@DATA\n1\n")
    with pytest.raises(ValueError):
        sources.read_arff(spark, str(tmp_path / "b.arff"))


def test_idx(spark, tmp_path):
    for part, n in (("train", 3), ("t10k", 2)):
        images = np.arange(n * 4, dtype=np.uint8)
        head = np.array([2051, n, 2, 2], dtype=">i4").tobytes()
        (tmp_path / f"{part}-images-idx3-ubyte.gz").write_bytes(gzip.compress(head + images.tobytes()))
        (tmp_path / f"{part}-labels-idx1-ubyte").write_bytes(np.array([2049, n], dtype=">i4").tobytes() + bytes(range(n)))
    rows = sources.read_idx(spark, str(tmp_path)).orderBy("sample_id").collect()
    assert [r.sample_id for r in rows] == [0, 1, 2, 3, 4] and [r.label for r in rows] == [0, 1, 2, 0, 1]
    assert np.allclose(rows[1].features, np.array([4, 5, 6, 7]) / 255)
    with pytest.raises(ValueError):
        sources.decode_idx(np.array([2051, 9, 2, 2], dtype=">i4").tobytes() + b"x")


def test_unknown_names():
    for call in (lambda: sources.load_points(None, "nothing"), lambda: get_algorithm("nothing"), lambda: partitioning.make_partition(None, "nothing"), lambda: scaling.preprocess(None, "nothing"), lambda: scaling.scale_public_named(None, "x")):
        with pytest.raises(ValueError):
            call()


def test_registered_source(spark):
    sources.register_source("clouds", lambda s, n=10: sources.make_blobs(s, n))
    assert sources.load_points(spark, "clouds", {"n": 12}).count() == 12 and "clouds" in sources.source_names()


def test_blobs_and_samples(blobs):
    assert blobs.groupBy("label").count().filter("count = 100").count() == 3
    sample = sources.stratified_sample(blobs, 31, 3)
    assert sample.count() == 31 and sorted(r["count"] for r in sample.groupBy("label").count().collect()) == [10, 10, 11]
    assert sources.stratified_sample(blobs, 1000, 3).count() == 300
    with pytest.raises(ValueError):
        sources.expect_shape(blobs, rows=3)


def test_strict_json_and_history(spark, tmp_path):
    rows = spark.createDataFrame([(float("nan"), float("inf"), 0.0, [1.0, float("-inf")], {"a": float("nan")})], "score double, bad double, ok double, nested array<double>, m map<string,double>")
    sinks.write_report(rows, str(tmp_path / "out"))
    text = next(p for p in (tmp_path / "out").iterdir() if p.suffix == ".json").read_text()
    assert json.loads(text) == {"score": None, "bad": None, "ok": 0.0, "nested": [1.0, None], "m": {"a": None}}
    good = {"experiment_id": "e1", "started_at": "2026-01-01T00:00:00Z", "finished_at": "2026-01-01T00:00:05Z", "request": {"dataset": "d", "mode": "federated"}, "partition": {"fingerprint": "f", "heterogeneity": {"cv": 0.5}}, "results": [{"algorithm": "a", "ari": 0.5}, {"algorithm": "b", "ari": None}]}
    for name, body in (("r1", json.dumps(good)), ("r2", "{ not json"), ("r3", json.dumps({"experiment_id": "x"}))):
        (tmp_path / "runs" / name).mkdir(parents=True)
        (tmp_path / "runs" / name / "report.json").write_text(body)
    stored = sources.read_history(spark, str(tmp_path / "runs"))
    view = history.typed_view(stored).orderBy("algorithm").collect()
    assert [(r.algorithm, r.ari, r.ami, r.duration_sec, r.privacy_mode) for r in view] == [("a", 0.5, None, 5.0, "none"), ("b", None, None, 5.0, "none")]
    assert history.newest(stored, -1).count() == 0 and history.get_experiment(stored, "e1").count() == 1
    with pytest.raises(KeyError):
        history.get_experiment(stored, "e2")
    assert set(sinks.report_tables(stored)) >= {"results", "configuration", "privacy", "log", "partition"}
    assert run_statistics.rows_from_history(stored.select("experiment_id", "request", "results")).count() == 2
    with pytest.raises(ValueError):
        run_statistics.rows_from_history(stored.union(stored).select("experiment_id", "request", "results"))


def test_results_and_release(spark, tmp_path):
    rows = spark.createDataFrame([("e", "local", "d", "kmeans", 0.5, "none"), ("f", "federated", "d", "fed", 0.4, "gaussian_dp")], "experiment_id string, mode string, dataset string, algorithm string, ari double, privacy_mode string")
    sinks.write_results(rows, str(tmp_path / "r"), "csv")
    back = sources.read_results(spark, str(tmp_path / "r"))
    assert back.count() == 2 and len(sinks.result_rows(rows).columns) == 42
    with pytest.raises(PermissionError):
        sinks.public_report(rows)
    assert sinks.public_report(rows.filter("experiment_id = 'e'")).columns == ["experiment_id", "dataset", "algorithm", "ari"]
    ids = spark.createDataFrame([("a", "2026-01-01 00:00:00", "d x"), ("b", "2026-01-01 00:00:00", "d x")], "experiment_id string, started_at string, dataset string")
    assert sorted(r.run_id for r in run_store.run_ids(ids).collect()) == ["20260101_000000_d_x", "20260101_000000_d_x_2"]


# Partitions and schedules


@pytest.mark.parametrize("mode", ["iid", "dirichlet", "quantity_skew", "label_limited"])
def test_partitions_cover(blobs, mode):
    a = partitioning.make_partition(blobs, mode, 5, 3, min_samples=3)
    assert partitioning.check_cover(blobs, a).first() == (300, 300, 300, 0)
    again = partitioning.make_partition(blobs.repartition(7), mode, 5, 3, min_samples=3)
    assert partitioning.partition_fingerprint(a).first() == partitioning.partition_fingerprint(again).first()
    assert partitioning.client_sizes(a).filter("n < 3").count() == 0
    if mode == "quantity_skew":
        sizes = [r.n for r in partitioning.client_sizes(a).orderBy("client_id").collect()]
        assert sizes == sorted(sizes) and sizes[-1] > 2 * sizes[0]


def test_partition_errors(blobs):
    for bad in (lambda: partitioning.partition_iid(blobs, 0), lambda: partitioning.partition_iid(blobs, 301), lambda: partitioning.partition_dirichlet(blobs, 5, 0.0), lambda: partitioning.partition_label_limited(blobs.drop("label"), 5, 2)):
        with pytest.raises(ValueError):
            bad()


def test_more_labels_than_classes_mean_all(blobs):
    got, want = ({(r.sample_id, r.client_id) for r in partitioning.partition_label_limited(blobs, 5, n, 1).collect()} for n in (9, 3))
    assert got == want and len(got) == 300


def test_rows_beyond_the_ball_are_drawn_in():
    rows = rounds.within_ball([[3.0, 4.0], [0.3, 0.4], [math.nan, math.inf], [0.0, -10.0]], 1.0)
    assert np.allclose(rows, [[0.6, 0.8], [0.3, 0.4], [0.0, 0.0], [0.0, -1.0]])
    centers = rounds.data_free_centers(50, 3, 2, 0.5)
    assert np.linalg.norm(centers, axis=1).max() <= 0.5 + 1e-12 and np.array_equal(centers, rounds.data_free_centers(50, 3, 2, 0.5))


def test_heterogeneity(spark, blobs):
    labels = blobs.select("sample_id", "label")
    pure = labels.select("sample_id", F.col("label").alias("client_id"))
    assert partitioning.heterogeneity(pure, labels).first().max_js > 0.3
    even = labels.select("sample_id", (F.floor(F.col("sample_id") / 3) % 2).cast("int").alias("client_id"))
    assert abs(partitioning.heterogeneity(even, labels).first().max_js) < 1e-12


def test_schedule(spark):
    plan = schedule.make_schedule(spark, 5, 8, 0.6, 0.4, 3)
    wide = schedule.schedule_wide(plan).collect()
    assert len(wide) == 8 and all(len(r.selected_clients) == 3 and 1 <= len(r.successful_clients) <= 3 and set(r.successful_clients) <= set(r.selected_clients) for r in wide)
    assert schedule.validate_schedule(plan, 5).first() == (0, 0)
    assert all(len(r.successful_clients) == 1 for r in schedule.schedule_wide(schedule.make_schedule(spark, 5, 4, 0.6, 0.999999, 1)).collect())
    with pytest.raises(ValueError):
        schedule.make_schedule(spark, 5, 4, 0.0)


# Clusterings


@pytest.mark.parametrize("kind", ["kmeans", "fuzzy", "gmm"])
def test_rounds_ignore_the_partition(spark, blobs, dealt, kind):
    skew = blobs.join(partitioning.partition_dirichlet(blobs, 5, 0.3, 9), "sample_id")
    one, two = (rounds.fed_rounds(kind, p, 3, rounds=3, seed=5) for p in (dealt, skew))
    assert metrics.prediction_fingerprint(one.predictions).first() == metrics.prediction_fingerprint(two.predictions).first()
    assert one.communication_bytes > 0 and len(one.history) <= 3


def test_all_methods_find_clear_clouds(blobs, dealt):
    found = {
        "kmeans": rounds.kmeans(dealt, 3, n_init=3), "gmm": central.gmm(dealt, 3), "ward": central.agglomerative(dealt, 3, micro=60), "server": server.fed_server_kmeans(dealt, 3, rounds=2),
        "personal": server.fed_personalised(dealt, 3, 2), "snn": server.fed_snn_peaks(dealt, 3, 10),
    }
    for name, result in found.items():
        scored = result.predictions.select("sample_id", "cluster").join(blobs, "sample_id")
        assert metrics.external(metrics.contingency(scored)).first().ari > 0.9, name


def test_dbscan_against_plain(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 0.3, (40, 2)), rng.normal(3, 0.3, (40, 2)), rng.uniform(-3, 6, (15, 2))])
    points = frame(spark, x).select("sample_id", "features")
    eps = density.kdist_eps(points, 5, 0.5)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert math.isclose(eps, float(np.quantile(np.sort(d, axis=1)[:, 4], 0.5)), rel_tol=1e-9)
    near = d <= eps
    core = near.sum(axis=1) >= 5
    root = list(range(len(x)))
    for _ in x:
        for i, j in zip(*np.nonzero(near)):
            if core[i] and core[j]:
                root[i] = root[j] = min(root[i], root[j])
    want = [root[i] if core[i] else min([root[j] for j in np.flatnonzero(near[i] & core)], default=-1) for i in range(len(x))]
    names = {r: k for k, r in enumerate(sorted(set(want) - {-1}))}
    got = {r.sample_id: r.cluster for r in density.dbscan(points, eps, 5).predictions.collect()}
    assert [got[i] for i in range(len(x))] == [names.get(w, -1) for w in want]


def test_grid(spark):
    points = frame(spark, [(0.01, 0.02), (0.03, 0.04), (0.31, 0.32), (0.33, 0.34), (0.35, 0.36)]).select("sample_id", "features", F.lit(0).alias("client_id"))
    cells = {tuple(r.cell): r.n for r in density.grid_cells(points, 0.1).groupBy("cell").agg(F.count("*").alias("n")).collect()}
    assert cells == {(0, 0): 2, (3, 3): 3}
    got = [r.cluster for r in density.fed_grid_density(points, 0.1, 3).predictions.orderBy("sample_id").collect()]
    assert got == [-1, -1, 0, 0, 0]
    around = density.axial_neighbours(spark.createDataFrame([([2, -1, 4],)], "cell array<int>")).collect()
    assert sorted(tuple(r.neighbour) for r in around) == sorted([(1, -1, 4), (3, -1, 4), (2, -2, 4), (2, 0, 4), (2, -1, 3), (2, -1, 5)])


def test_ward_is_exact_on_few_rows():
    x = np.array([[0.0], [0.1], [1.0], [1.15], [5.0]])
    labels = central.merge_tree(x, np.ones(5), 2)
    assert labels[4] != labels[0] and len(set(labels[:4])) == 1
    assert len(set(central.merge_tree(x, np.ones(5), 3, "single"))) == 3


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 7), (5, 5)], "src int, dst int")
    got = {r.node: r.component for r in graph.connected_components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, 5: 5}
    chain = spark.createDataFrame([(i, i + 1) for i in range(100)], "src int, dst int")
    assert {r.component for r in graph.connected_components(chain).collect()} == {0}
    # A hub's edges stay where they are, and whether its leaves come first or last changes nothing.
    for hub, to in ((0, 0), (5000, 0)):
        star = [(hub, i) for i in range(1, 3000)] + [(2999, 3001), (3001, 3000), (hub, 0)]
        rows = graph.connected_components(spark.createDataFrame(star, "src int, dst int")).collect()
        assert {r.component for r in rows} == {to} and len(rows) == len({x for e in star for x in e})
    assert graph.connected_components(edges.limit(0)).count() == 0


# Metrics


def plain_ari(y, c):
    n = len(y)
    tp = sum(1 for i, j in itertools.permutations(range(n), 2) if y[i] == y[j] and c[i] == c[j])
    fp = sum(1 for i, j in itertools.permutations(range(n), 2) if y[i] != y[j] and c[i] == c[j])
    fn = sum(1 for i, j in itertools.permutations(range(n), 2) if y[i] == y[j] and c[i] != c[j])
    tn = n * (n - 1) - tp - fp - fn
    return 1.0 if fp == fn == 0 else 2 * (tp * tn - fn * fp) / ((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn))


def test_external_metrics(spark):
    rng = np.random.default_rng(3)
    y, c = rng.integers(0, 3, 40), rng.integers(-1, 3, 40)
    cont = metrics.contingency(frame(spark, np.zeros((40, 1)), c, y))
    assert math.isclose(metrics.external(cont).first().ari, plain_ari(y, c), abs_tol=1e-12)
    perfect = metrics.contingency(frame(spark, np.zeros((40, 1)), (y + 1) % 3, y))
    assert metrics.external(perfect).first().ari == 1.0 and math.isclose(metrics.ami(perfect).first().ami, 1.0)
    # Expected mutual information by drawing.
    n, total = 40, 0.0
    for _ in range(3000):
        p = rng.permutation(c)
        for a in set(y):
            for b in set(c):
                m = ((y == a) & (p == b)).sum()
                if m:
                    total += m / n * math.log(n * m / ((y == a).sum() * (c == b).sum()))
    assert abs(metrics.expected_mi(cont).first().e - total / 3000) < 0.01


def test_noise_and_undefined(spark):
    x = [(0, 0), (0.1, 0), (0, 0.1), (5, 5), (5.1, 5), (5, 5.1), (40, 40)]
    scored = frame(spark, x, [0, 0, 0, 1, 1, 1, -1], [0, 0, 0, 1, 1, 1, 1])
    assert metrics.silhouette(scored).first()[0] > 0.95 and metrics.davies_bouldin(scored).first()[0] < 0.1
    one = frame(spark, [(0, 0), (2, 2), (8, 8)], [0, -1, -1], [0, 1, 1])
    row = metrics.compute_metrics(one).first()
    assert (row.silhouette, row.davies_bouldin, row.calinski_harabasz) == (None, None, None) and row.ari is not None
    none = frame(spark, [(0, 0), (2, 2), (8, 8)], [-1, -1, -1], [0, 1, 1])
    assert metrics.label_diagnostics(none, 2).first().status == "degenerate" and metrics.compute_metrics(none, ["silhouette"]).first()[0] is None
    with pytest.raises(ValueError):
        metrics.compute_metrics(one, ["nothing"])


def test_fingerprints(spark):
    a = frame(spark, np.zeros((6, 1)), [2, 2, 0, -1, 0, 1])
    b = frame(spark, np.zeros((6, 1)), [0, 0, 1, -1, 1, 2])
    assert metrics.prediction_fingerprint(a).first() == metrics.prediction_fingerprint(b).first()
    assert metrics.prediction_fingerprint(a, raw=True).first() != metrics.prediction_fingerprint(b, raw=True).first()
    assert [r.cluster for r in metrics.canonical_labels(a).orderBy("sample_id").collect()] == [0, 0, 1, -1, 1, 2]


# Privacy


def test_noise_scale():
    for eps, delta in ((0.5, 1e-5), (5.0, 1e-6), (20.0, 1e-5)):
        sigma = privacy.gaussian_sigma(eps, delta, 2.0)
        assert privacy.gaussian_delta(sigma, eps, 2.0) <= delta < privacy.gaussian_delta(sigma * 0.999, eps, 2.0)
    assert privacy.dp_aggregate_config("gmm", 5, 1e-5, 4, 10).sigma > privacy.dp_aggregate_config("kmeans", 5, 1e-5, 4, 10).sigma
    assert privacy.dp_aggregate_config("kmeans", 5, 1e-5, 4, 10).eps_round == 0.5
    z = privacy.system_normal(100_000)
    assert abs(z.mean()) < 0.02 and abs(z.std() - 1) < 0.02


def test_releases_differ_and_clip(spark, dealt):
    one, two = (privacy.dp_input(dealt, 5.0, 1e-5, 1.0) for _ in range(2))
    assert one.join(two, ["sample_id", "features"]).count() == 0 and one.count() == 300
    assert scaling.clip_l2(dealt, 2.0).select(F.max(F.sqrt(F.aggregate("features", F.lit(0.0), lambda a, x: a + x * x)))).first()[0] <= 2.0 + 1e-9
    anchors = privacy.data_free_centers(4, 2, 1, 4.0)
    rows = privacy.dp_prototypes(dealt, anchors, privacy.dp_aggregate_config("kmeans", 50.0, 1e-5, 4.0, 1, False)).collect()
    assert rows and all(np.linalg.norm(r.center) <= 4 + 1e-9 and r.weight >= 1 for r in rows)
    centers, weights = privacy.pad_candidates(np.zeros((0, 2)), np.zeros(0), anchors, 6)
    assert len(centers) == len(weights) == 6


# Statistics and plans


def test_paired_statistics(spark):
    rows = spark.createDataFrame([("d", "s", a, i, "f", v) for i in range(5) for a, v in (("a", 0.8), ("b", 0.7))], "dataset string, scenario string, algorithm string, seed int, partition_fingerprint string, ari double")
    r = run_statistics.paired_bootstrap(rows, "a", "b").first()
    assert r.n_pairs == 5 and all(math.isclose(v, 0.1) for v in (r.mean, r.ci_low, r.ci_high)) and r.fraction_positive == 1
    both = rows.filter("algorithm = 'a'").unionByName(rows.filter("algorithm = 'a'").withColumn("scenario", F.lit("t")).withColumn("ari", F.col("ari") - 0.2))
    assert math.isclose(run_statistics.scenario_delta(both, "a", "s", "t").first().mean, -0.2)
    assert run_statistics.dp_utility_wide(rows.withColumn("epsilon", F.when(F.col("seed") > 2, 5.0)), [5.0]).columns == ["algorithm", "control", "5.0"]


def test_plan(spark):
    assert experiments.expand_params({}) == [{}] and len(experiments.expand_params({"a": [1, 2], "b": 3})) == 2
    plan = experiments.build_plan(spark, ["d"], ["a", "b"], [1, 2], modes=["iid", "dirichlet"], alphas=[0.1, 1.0])
    assert plan.count() == 2 * 2 * (1 + 2) and plan.filter("mode = 'iid' and alpha is not null").count() == 0


def test_requests():
    good = RunRequest("federated", "d", ("fed_kmeans", "fed_gmm_diag"))
    assert good.validate() is good
    for bad in ({"algorithms": ("a",)}, {"algorithms": ("a", "a")}, {"rounds": 0}, {"tol": 0}, {"participation_rate": 0}, {"dropout_rate": 1}, {"privacy_mode": "x"}, {"dp_delta": 1}, {"num_clients": 1}, {"mode": "x"}, {"mode": "local", "dropout_rate": 0.5}, {"privacy_mode": "gaussian_dp_aggregate", "dp_clip_norm": 21}, {"privacy_mode": "gaussian_dp_aggregate", "partition_mode": "dirichlet"}, {"cluster_count_mode": "estimated_k", "target_clusters": 3}):
        with pytest.raises(ValueError):
            RunRequest(**({"mode": "federated", "dataset": "d", "algorithms": ("a", "b")} | bad)).validate()
    assert RunRequest("local", "d", ("a", "b"), num_clients=1, partition_mode="x", dirichlet_alpha=0).validate() and RunRequest("local", "d", ("a", "b"), target_clusters=2).validate()
    assert RunRequest("local", "", ("a", "b"), target_clusters=1, tol=0).problems() == ["target_clusters must be at least 2", "tol must be above 0", "a dataset is needed"]
    assert effective_params({"a": 1}, {"a": 2, "b": 1}, {}, {"b": 3}, {"a": 5}) == {"a": 5, "b": 3}
    assert "dbscan" in algorithm_names("local") and "fed_kmeans" in algorithm_names("federated")


def test_compare(spark, blobs):
    seen = []
    request = RunRequest("federated", "clouds", ("fed_kmeans", "fed_grid_density"), rounds=2, num_clients=4)
    rows = experiments.compare(request, blobs, ["ari"], seen.append).collect()
    assert [r.algorithm for r in rows] == ["fed_kmeans", "fed_grid_density"] and all(r.cluster_source == "ground_truth_oracle" for r in rows)
    assert rows[0].ari > 0.5 and len(seen) == 3
    private = RunRequest("federated", "clouds", ("fed_kmeans", "fed_gmm_diag"), rounds=2, privacy_mode="gaussian_dp")
    assert len(experiments.compare(private, blobs, ["ari"]).collect()) == 2


def test_estimate_k(blobs):
    assert tuning.estimate_k(blobs, 2, 4, 3, sample=150, n_init=1)[0] == 3


def test_repeated_rows_keep_ids_of_their_own(spark, tmp_path):
    body = "@RELATION r\n@ATTRIBUTE a REAL\n@ATTRIBUTE Class {x,y}\n@DATA\n" + "1.0,x\n2.0,y\n1.0,x\n" * 40
    (tmp_path / "r.arff").write_text(body)
    rows = sources.read_arff(spark, str(tmp_path / "r.arff")).orderBy("sample_id").collect()
    assert [r.sample_id for r in rows] == list(range(120)) and [r.features[0] for r in rows] == [1.0, 2.0, 1.0] * 40
    one = spark.createDataFrame([(1.0, 2.0, 0.1, 0.2, 7, "A")] * 50, "l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_suppkey bigint, l_returnflag string")
    one.repartition(3).write.parquet(str(tmp_path / "items"))
    assert sorted(r.sample_id for r in sources.read_line_items(spark, str(tmp_path / "items")).collect()) == list(range(50))


def test_natural_clients_without_exchange_reuse(spark):
    owners = spark.range(20_000).select((F.col("id") * 7919 % 100_003).alias("owner"), F.col("id").alias("sample_id"))
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        got = partitioning.partition_by_column(owners, "owner").join(owners, "sample_id").select("client_id", "owner").orderBy("owner").collect()
    finally:
        spark.conf.set("spark.sql.exchange.reuse", "true")
    assert [r.client_id for r in got] == list(range(20_000))
