"""Plans of many runs and the comparison of several algorithms under one request (Q1-Q4)."""

from __future__ import annotations

import time
from collections.abc import Callable
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterloom.operators import metrics, partitioning
from clusterloom.operators.graph import materialise
from clusterloom.operators.privacy import dp_input, fed_rounds_dp, fed_server_dp
from clusterloom.operators.rounds import ClusterResult
from clusterloom.operators.scaling import preprocess, scale_public_named, scale_standard, validate_points
from clusterloom.operators.schedule import make_schedule
from clusterloom.plans.request import RunRequest, effective_params, get_algorithm, resolve_k


def expand_params(params: dict) -> list[dict]:
    """All combinations of list values; a single value counts as a list of one; nothing gives one empty combination."""
    names = sorted(params)
    return [dict(zip(names, values, strict=True)) for values in product(*[v if isinstance(v, (list, tuple)) else [v] for v in (params[n] for n in names)])]


def build_plan(spark: SparkSession, datasets: list[str], algorithms: list[str], seeds: list[int], repetitions: int = 1, dataset_params: dict | None = None, algorithm_params: dict | None = None, clients: list[int] = (5,), modes: list[str] = ("iid",), alphas: list[float] = (0.5,)) -> DataFrame:
    """One row a run; alphas multiply the Dirichlet mode alone."""
    one = lambda name, values, kind: F.broadcast(spark.createDataFrame([(v,) for v in values], f"{name} {kind}"))
    maps = lambda name, params: one(name, [{k: str(v) for k, v in p.items()} for p in expand_params(params or {})], "map<string,string>")
    plan = one("dataset", datasets, "string").crossJoin(one("algorithm", algorithms, "string")).crossJoin(one("seed", seeds, "int")).crossJoin(one("repetition", range(repetitions), "int"))
    plan = plan.crossJoin(maps("dataset_params", dataset_params)).crossJoin(maps("algorithm_params", algorithm_params)).crossJoin(one("clients", clients, "int")).crossJoin(one("mode", modes, "string"))
    values = F.when(F.col("mode") == "dirichlet", F.array(*[F.lit(float(a)) for a in alphas])).otherwise(F.array(F.lit(None).cast("double")))
    return plan.select("*", F.explode(values).alias("alpha"))


def run_plan(plan: DataFrame, source: Callable[[str], DataFrame], k: int | None = None, rounds: int = 5) -> DataFrame:
    """dataset, algorithm, seed, repetition, clients, mode, alpha, fingerprint, ari, nmi of each run; runs of a case share one partition."""
    spark = plan.sparkSession
    runs = plan.orderBy("dataset", "clients", "mode", "alpha", "seed", "repetition", "algorithm").collect()
    rows, case = [], None
    for r in runs:
        key = (r.dataset, r.clients, r.mode, r.alpha, r.seed, r.repetition)
        if key != case:
            case = key
            points = source(r.dataset)
            assignment = partitioning.make_partition(points, r.mode, r.clients, r.seed + 1000 * r.repetition, r.alpha or 0.5, min_samples=3)
            dealt = materialise(points.join(assignment, "sample_id"), "plan-case")
            mark = partitioning.partition_fingerprint(dealt.select("sample_id", "client_id")).first()[0]
            clusters = k or dealt.select("label").distinct().count()
        algorithm = get_algorithm(r.algorithm)
        options = {**algorithm.defaults, **({"rounds": rounds} if "rounds" in algorithm.supported else {})}
        result = algorithm.run(preprocess(dealt, algorithm.preprocessing), clusters, None, options, r.seed)
        s = metrics.external(metrics.contingency(result.predictions)).first()
        rows.append((r.dataset, r.algorithm, r.seed, r.repetition, r.clients, r.mode, r.alpha, mark, s.ari, s.nmi))
    return spark.createDataFrame(rows, "dataset string, algorithm string, seed int, repetition int, clients int, mode string, alpha double, partition_fingerprint string, ari double, nmi double")


#: Private forms of the federated algorithms.
_PRIVATE = {"fed_kmeans": "kmeans", "fed_fuzzy_cmeans": "fuzzy", "fed_gmm_diag": "gmm"}
_PRIVATE_SERVER = {"fed_server_kmeans": "server_kmeans", "fed_snn_peaks": "snn", "fed_nn_peaks": "nn", "fed_personalised": "personalised"}


def compare(request: RunRequest, points: DataFrame, requested: list[str] | None = None, log: Callable[[str], None] | None = None, on_partition: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """One row for each algorithm, all on one partition and schedule, scored in one standardised space.

    ``points``: sample_id, features, label. The dealt points are written once; predictions come back on the same rows.
    """
    request.validate()
    say = log or (lambda _: None)
    spark = points.sparkSession
    validate_points(points)
    aggregate = request.privacy_mode in ("gaussian_dp_aggregate", "public_clipped_control")
    k, source = resolve_k(request, points)
    say(f"k={k} from {source}")
    common = scale_standard(points)
    work = dp_input(points, request.dp_epsilon, request.dp_delta, request.dp_clip_norm) if request.privacy_mode == "gaussian_dp" else scale_public_named(points, request.dataset) if aggregate else points
    federated = request.mode == "federated"
    schedule = None
    if federated:
        assignment = partitioning.make_partition(points, request.partition_mode, request.num_clients, request.seed, request.dirichlet_alpha, request.labels_per_client, request.min_samples_per_client)
        schedule = materialise(make_schedule(spark, request.num_clients, request.rounds, request.participation_rate, request.dropout_rate, request.seed), "schedule")
    else:
        assignment = points.select("sample_id", F.lit(0).alias("client_id"))
    dealt = materialise(work.join(assignment, "sample_id"), "dealt")
    if on_partition:
        on_partition(dealt.select("sample_id", "client_id"))
    truth = materialise(common.select("sample_id", "features", "label"), "evaluation")
    out = None
    for name in request.algorithms:
        algorithm = get_algorithm(name)
        if algorithm.mode != request.mode:
            raise ValueError(f"{name} is for {algorithm.mode} runs")
        shared = {n: getattr(request, n) for n in algorithm.supported}
        options = effective_params(shared, algorithm.defaults, {}, request.params, request.params_by_algorithm.get(name, {}))
        began = time.perf_counter()
        if aggregate:
            result = _private(name, dealt, k, request, schedule)
        else:
            result = algorithm.run(preprocess(dealt, algorithm.preprocessing), k, schedule, options, request.seed)
        scored = materialise(result.predictions.select("sample_id", "client_id", "cluster").join(truth, "sample_id"), "scored")
        say(f"{name} done")
        row = metrics.result_row(scored, name, k, options, {"mode": request.mode, "partition": request.partition_mode}, requested)
        row = row.crossJoin(metrics.client_summary(metrics.client_metrics(scored))).crossJoin(metrics.prediction_fingerprint(scored).withColumnRenamed("fingerprint", "prediction_hash"))
        row = row.withColumns({"runtime_sec": F.lit(time.perf_counter() - began), "communication_bytes": F.lit(result.communication_bytes), "rounds": F.lit(len(result.history)), "cluster_source": F.lit(source)})
        out = row if out is None else out.unionByName(row)
    return out


def _private(name: str, dealt: DataFrame, k: int, request: RunRequest, schedule: DataFrame | None) -> ClusterResult:
    on = request.privacy_mode == "gaussian_dp_aggregate"
    if name in _PRIVATE:
        return fed_rounds_dp(_PRIVATE[name], dealt, k, request.rounds, request.dp_epsilon, request.dp_delta, request.dp_clip_norm, request.seed, schedule, on)
    if name in _PRIVATE_SERVER:
        return fed_server_dp(_PRIVATE_SERVER[name], dealt, k, request.dp_epsilon, request.dp_delta, request.dp_clip_norm, request.rounds, request.seed, schedule, on)
    from clusterloom.operators.privacy import fed_grid_density_dp

    return fed_grid_density_dp(dealt, request.dp_epsilon, request.dp_delta, request.dp_clip_norm, seed=request.seed, schedule=schedule, enabled=on)
