"""Queries of the library's smaller parts over whole tables, with their SQL; they join those of the other module."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from clusterloom.functions.arrays import chebyshev, dot, entropy_term, js_term, norm, priority, seconds_between, squared_distance, total
from clusterloom.operators import density, metrics, partitioning, privacy, rounds, run_statistics, scaling, schedule
from clusterloom.operators.graph import materialise, shared_folder
from clusterloom.plans import experiments, history
from clusterloom.plans.request import Algorithm, RunRequest, algorithm_names, get_algorithm, register_algorithm, resolve_k
from clusterloom.queries import ORACLE_SQL, CANON, CONT, CUST, GEO, IID, NEAR, NORMED, ORD, RULED, SCHED, START, STEP, customers, embeddings, nation_schedule, orders, query, r6, ruled
from clusterloom.sources import points as sources
from clusterloom.sources import run_store, sinks


def scratch(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def by_nation(spark, d):
    return customers(spark, d).withColumn("client_id", F.col("owner").cast("int"))


# Sources and sinks


@query("SELECT label::INT AS label, count(*)::BIGINT AS n, round(sum(embedding[1]::DOUBLE), 4) AS first_sum, round(sum(list_sum(embedding::DOUBLE[])), 4) AS all_sum FROM embeddings GROUP BY 1")
def s4_record_files(spark, d):
    """The embeddings written as files of fixed-length records and read in pieces."""
    path = scratch(spark, "records")
    sources.write_idx(embeddings(spark, d), path)
    rows = sources.read_idx(spark, path, scale=False)
    every = F.aggregate("features", F.lit(0.0), lambda a, x: a + x)
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("features")[0]), 4).alias("first_sum"), F.round(F.sum(every), 4).alias("all_sum"))


@query("SELECT o_orderstatus AS dataset, count(*)::BIGINT AS n, count(*) FILTER (o_custkey % 3 <> 0)::BIGINT AS known, round(sum(CASE WHEN o_custkey % 3 <> 0 THEN round(o_totalprice / 1000000.0, 6) END), 4) AS total FROM orders GROUP BY 1")
def s9_read_results(spark, d):
    """Orders as result rows, written as CSV with empty cells and read again."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    rows = o.select(F.col("o_orderkey").cast("string").alias("experiment_id"), F.lit("local").alias("mode"), F.col("o_orderstatus").alias("dataset"), F.when(F.col("o_custkey") % 3 != 0, F.round(F.col("o_totalprice") / 1000000.0, 6)).alias("ari"))
    path = scratch(spark, "results")
    sinks.write_results(rows, path, "csv")
    return sources.read_results(spark, path).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.count("ari").alias("known"), F.round(F.sum(F.col("ari").cast("double")), 4).alias("total"))


@query("""SELECT o_orderstatus AS dataset, o_orderpriority AS algorithm, CASE WHEN count(*) % 2 = 1 THEN round(avg(o_totalprice) / 1000000.0, 6) END AS ari FROM orders GROUP BY 1, 2""")
def k1_strict_report(spark, d):
    """A nested report for each status of orders, a result for each priority, some of them not finite; each written as one document, all read as stored runs."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    results = o.groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice") / 1000000.0, 6).alias("mean"))
    ari = F.when(F.col("n") % 2 == 1, F.col("mean")).when(F.col("n") % 4 == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))
    result = F.struct(F.col("o_orderpriority").alias("algorithm"), F.lit("ok").alias("status"), ari.alias("ari"))
    nested = results.groupBy(F.col("o_orderstatus").alias("experiment_id")).agg(F.collect_list(result).alias("results"))
    report = materialise(nested.withColumn("request", F.struct(F.col("experiment_id").alias("dataset"))), "reports")
    root = scratch(spark, "reports")
    for r in report.select("experiment_id").collect():  # three
        sinks.write_report(report.filter(F.col("experiment_id") == r.experiment_id), f"{root}/{r.experiment_id}/report.json")
    return sources.read_history(spark, root).select("request.dataset", F.explode("results").alias("r")).select("dataset", "r.algorithm", "r.ari")


@query("SELECT o_orderstatus AS dataset, (2 * count(*))::BIGINT AS n, count(DISTINCT o_orderkey)::BIGINT AS runs FROM orders GROUP BY 1")
def k3_append_runs(spark, d):
    """Each order's metrics appended twice to one log of JSON lines."""
    rows = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("run"), F.col("o_orderstatus").alias("dataset"), F.col("o_totalprice").alias("value"))
    path = scratch(spark, "log")
    sinks.append_runs(rows, path)
    sinks.append_runs(rows, path)
    return spark.read.schema(rows.schema).json(path).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("run").alias("runs"))


@query("""WITH b AS (SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d_%H%M%S') || '_' || regexp_replace(o_orderpriority, '[^A-Za-z0-9_.-]+', '_', 'g') AS base FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY o_orderkey::VARCHAR) AS n FROM b) SELECT o_orderkey::VARCHAR AS experiment_id, CASE WHEN n = 1 THEN base ELSE base || '_' || n END AS run_id FROM r""")
def k4_run_ids(spark, d):
    rows = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").cast("string").alias("experiment_id"), F.col("o_orderdate").alias("started_at"), F.col("o_orderpriority").alias("dataset"))
    return run_store.run_ids(rows).select("experiment_id", "run_id")


@query("""WITH b AS (SELECT o_orderkey::VARCHAR AS experiment_id, v AS version, strftime(o_orderdate, '%Y%m%d_%H%M%S') || '_' || o_orderstatus AS base FROM orders, (VALUES (1), (2)) t(v) WHERE v = 1 OR o_custkey % 2 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY version, experiment_id) AS n FROM b) SELECT version, experiment_id, CASE WHEN n = 1 THEN base ELSE base || '_' || n END AS run_id FROM r""")
def k4_run_store(spark, d):
    """Orders as runs, appended, half of them appended again, and once more by a writer that dies before it publishes."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    rows = o.select(F.col("o_orderkey").cast("string").alias("experiment_id"), F.col("o_orderdate").cast("string").alias("started_at"), F.col("o_orderstatus").alias("dataset"), "o_custkey")
    root = scratch(spark, "store")
    run_store.append(rows, root)
    run_store.append(rows.filter("o_custkey % 2 = 0"), root)
    run_store.stage(rows, root)
    return run_store.read_runs(spark, root, rows.schema).select("version", "experiment_id", "run_id")


def reports(spark, d):
    """Customers as experiments, their orders as nested results; some fields are missing in some."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    result = F.struct(F.col("o_orderpriority").alias("algorithm"), F.when(F.col("o_orderkey") % 2 == 0, "ok").alias("status"), F.round(F.col("o_totalprice") / 1000000.0, 6).alias("ari"), F.lit(None).cast("double").alias("nmi"), F.lit(None).cast("double").alias("ami"), F.lit(None).cast("double").alias("silhouette"))
    c = F.col("o_custkey")
    start = F.min("o_orderdate")
    request = F.struct(
        F.concat(F.lit("c"), (c % 9).cast("string")).alias("dataset"), F.when(c % 2 == 0, "federated").alias("mode"), F.when(c % 5 == 0, "gaussian_dp").alias("privacy_mode"),
        F.when(c % 3 == 0, F.lit(0.6)).alias("participation_rate"), F.lit(None).cast("string").alias("cluster_count_mode"),
    )
    grouped = o.groupBy("o_custkey").agg(F.collect_list(result).alias("results"), F.date_format(start, "yyyy-MM-dd'T'HH:mm:ss").alias("started_at"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd'T'HH:mm:ss").alias("finished_at"))
    heterogeneity = F.create_map(F.lit("size_cv"), (c % 7).cast("double"))
    return grouped.select(c.cast("string").alias("experiment_id"), "started_at", "finished_at", request.alias("request"), F.struct(F.lit("f").alias("fingerprint"), heterogeneity.alias("heterogeneity")).alias("partition"), "results")


@query("""WITH g AS (SELECT o_custkey, min(o_orderdate) AS a, max(o_orderdate) AS b, count(*) AS n FROM orders GROUP BY 1)
SELECT 'results' AS part, count(*)::BIGINT AS n, round(sum(round(o_totalprice / 1000000.0, 6)), 4) AS total FROM orders UNION ALL
SELECT 'configuration', count(*), sum(o_custkey % 9)::DOUBLE FROM g UNION ALL SELECT 'privacy', count(*), count(*) FILTER (o_custkey % 5 = 0)::DOUBLE FROM g UNION ALL
SELECT 'log', 2 * count(*), count(*)::DOUBLE FROM g UNION ALL SELECT 'partition', count(*), sum(o_custkey % 7)::DOUBLE FROM g""")
def k5_report_tables(spark, d):
    """The flat tables of all reports, by size and one sum each."""
    t = sinks.report_tables(reports(spark, d))
    sums = {
        "results": F.sum("ari"), "configuration": F.sum(F.substring("dataset", 2, 9).cast("double")), "privacy": F.count("privacy_mode").cast("double"),
        "log": F.count(F.when(F.col("event") == "started", 1)).cast("double"), "partition": F.sum("value"),
    }
    out = None
    for name, figure in sums.items():
        one = t[name].agg(F.count(F.lit(1)).alias("n"), F.round(figure, 4).alias("total")).select(F.lit(name).alias("part"), "n", "total")
        out = one if out is None else out.unionByName(one)
    return out


# Stored history


@query("SELECT o_custkey::VARCHAR AS experiment_id, strftime(min(o_orderdate), '%Y-%m-%dT%H:%M:%S') AS started_at FROM orders GROUP BY o_custkey ORDER BY 2 DESC, 1 DESC LIMIT 20")
def o1_newest_experiments(spark, d):
    """The newest 20 experiments: the list's limit is the feature."""
    return history.newest(reports(spark, d), 20).select("experiment_id", "started_at")


@query("SELECT o_custkey::VARCHAR AS experiment_id, count(*)::BIGINT AS results FROM orders WHERE o_custkey = (SELECT max(o_custkey) FROM orders) GROUP BY 1")
def o3_get_experiment(spark, d):
    stored = reports(spark, d)
    last = stored.agg(F.max(F.col("experiment_id").cast("bigint"))).first()[0]
    return history.get_experiment(stored, str(last)).select("experiment_id", F.size("results").cast("bigint").alias("results"))


@query("""WITH g AS (SELECT o_custkey AS c, min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders GROUP BY 1)
SELECT c::VARCHAR AS experiment_id, 'c' || c % 9 AS dataset, CASE WHEN c % 2 = 0 THEN 'federated' ELSE 'local' END AS mode, CASE WHEN c % 5 = 0 THEN 'gaussian_dp' ELSE 'none' END AS privacy_mode,
CASE WHEN c % 3 = 0 THEN 0.6 ELSE 1.0 END::DOUBLE AS participation_rate, 'known_k' AS cluster_count_mode, epoch(b)::DOUBLE - epoch(a)::DOUBLE AS duration_sec, o_orderpriority AS algorithm, 'ok' AS status, round(o_totalprice / 1000000.0, 6) AS ari FROM orders JOIN g ON o_custkey = c""")
def o4_typed_view(spark, d):
    v = history.typed_view(reports(spark, d))
    return v.select("experiment_id", "dataset", "mode", "privacy_mode", "participation_rate", "cluster_count_mode", F.col("duration_sec").cast("double").alias("duration_sec"), "algorithm", "status", "ari")


# Preparation, partitions, schedules


@query(f"""WITH {CUST}, m AS (SELECT avg(x0) AS m0, stddev_pop(x0) AS s0, min(x0) AS a0, max(x0) AS b0 FROM cust)
SELECT 'raw' AS mode, sample_id, round(x0, 6) AS x0 FROM cust UNION ALL SELECT 'standard', sample_id, round((x0 - m0) / s0, 6) FROM cust, m UNION ALL SELECT 'minmax', sample_id, round((x0 - a0) / (b0 - a0), 6) FROM cust, m""")
def p5_preprocess_modes(spark, d):
    out = None
    for mode in ("raw", "standard", "minmax"):
        one = scaling.preprocess(customers(spark, d), mode).select(F.lit(mode).alias("mode"), "sample_id", r6(F.col("features")[0]).alias("x0"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {SCHED}, w(wanted, used) AS (VALUES (-3, 1), (1, 1), (4, 4), (99, 6)) SELECT wanted::INT AS wanted, client_id FROM w JOIN sched ON round = used WHERE status = 'successful'")
def p11_round_clamp(spark, d):
    plan, out = nation_schedule(spark, d), None
    for wanted in (-3, 1, 4, 99):
        one = schedule.active_clients(plan, wanted).select(F.lit(wanted).alias("wanted"), "client_id")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT count(DISTINCT c_mktsegment)::INT AS k, 'ground_truth_oracle' AS source FROM customer")
def p13_resolve_k(spark, d):
    k, source = resolve_k(RunRequest("local", "customer", ("kmeans", "gmm")), customers(spark, d))
    return spark.createDataFrame([(k, source)], "k int, source string")


@query(f"WITH {ORD}, u AS (SELECT sample_id, 'natural' AS mode, dense_rank() OVER (ORDER BY owner) - 1 AS client_id FROM ord), {CUST.replace('customer', '(SELECT o_orderkey AS c_custkey, 0 AS c_acctbal, 0 AS c_nationkey, o_orderpriority AS c_mktsegment FROM orders)')}, {IID} SELECT mode, client_id::INT AS client_id, count(*)::BIGINT AS n FROM (SELECT sample_id, mode, client_id FROM u UNION ALL SELECT sample_id, 'iid', client_id FROM dealt) GROUP BY 1, 2")
def a5_make_partition(spark, d):
    """The dispatcher on two modes."""
    points, out = orders(spark, d), None
    for mode in ("iid", "natural"):
        one = partitioning.client_sizes(partitioning.make_partition(points, mode, 5, 42, column="owner")).select(F.lit(mode).alias("mode"), "client_id", "n")
        out = one if out is None else out.unionByName(one)
    return out


LIMITED = f"""{ORD}, sizes AS (SELECT label, count(*) AS n FROM ord GROUP BY 1), ranked AS (SELECT sample_id, label, row_number() OVER (PARTITION BY label ORDER BY sha256('42:' || sample_id), sample_id) - 1 AS rk FROM ord),
limited AS (SELECT sample_id, label, CASE WHEN rk < (n + 1) // 2 THEN CASE WHEN label = 0 THEN 0 ELSE label - 1 END ELSE CASE WHEN label = 0 THEN 4 ELSE label END END AS client_id FROM ranked JOIN sizes USING (label))"""


@query(f"WITH {LIMITED} SELECT sample_id, client_id::INT AS client_id FROM limited")
def j7_quota_ranges(spark, d):
    """Ranks of each class meet the range of ranks that a client's quota is; five classes, two a client."""
    return partitioning.partition_label_limited(orders(spark, d), 5, 2, 42)


@query(f"""WITH {SCHED}, t AS (SELECT c_nationkey AS client_id, count(*) AS n FROM customer GROUP BY 1), a AS (SELECT round, sum(n) AS n FROM sched JOIN t USING (client_id) WHERE status = 'successful' GROUP BY 1),
w AS (SELECT round, string_agg(client_id::VARCHAR, ',' ORDER BY client_id) AS selected, string_agg(client_id::VARCHAR, ',' ORDER BY client_id) FILTER (status = 'successful') AS successful, coalesce(string_agg(client_id::VARCHAR, ',' ORDER BY client_id) FILTER (status = 'dropped'), '') AS dropped FROM sched GROUP BY 1)
SELECT round, selected, successful, dropped, n::BIGINT AS active_rows FROM w JOIN a USING (round)""")
def e4_schedule_with_activity(spark, d):
    own = by_nation(spark, d).select("sample_id", "client_id")
    wide = schedule.schedule_with_activity(nation_schedule(spark, d), own)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return wide.select("round", text("selected_clients").alias("selected"), text("successful_clients").alias("successful"), text("dropped_clients").alias("dropped"), "active_rows")


@query(f"WITH {SCHED}, a AS (SELECT client_id FROM sched WHERE round = 2 AND status = 'successful') SELECT 'active' AS side, count(*)::BIGINT AS n FROM customer WHERE c_nationkey IN (FROM a) UNION ALL SELECT 'left_out', count(*) FROM customer WHERE c_nationkey NOT IN (FROM a)")
def j6_active_and_left_out(spark, d):
    points, plan = by_nation(spark, d), nation_schedule(spark, d)
    active = schedule.active_points(points, plan, 2)
    missing = partitioning.check_cover(points.select("sample_id"), active.select("sample_id")).select(F.lit("left_out").alias("side"), F.col("missing").alias("n"))
    return active.agg(F.count(F.lit(1)).alias("n")).select(F.lit("active").alias("side"), "n").unionByName(missing)


@query(f"WITH {SCHED} SELECT count(DISTINCT c_custkey)::BIGINT AS n FROM customer WHERE c_nationkey IN (SELECT client_id FROM sched WHERE round <= 2 AND status = 'successful')")
def x1_active_union(spark, d):
    """Rows that are active in either of two rounds, each once."""
    points, plan = by_nation(spark, d).select("sample_id", "client_id"), nation_schedule(spark, d)
    return schedule.active_points(points, plan, 1).union(schedule.active_points(points, plan, 2)).distinct().agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SCHED} SELECT round, true AS covered, count(*) FILTER (status = 'successful')::BIGINT AS n FROM sched GROUP BY 1")
def x3_client_sets(spark, d):
    """Selected clients are the successful and the dropped ones, as sets."""
    w = schedule.schedule_wide(nation_schedule(spark, d))
    both = F.array_sort(F.array_union("successful_clients", "dropped_clients"))
    return w.select("round", (both == F.col("selected_clients")).alias("covered"), F.size("successful_clients").cast("bigint").alias("n"))


@query("SELECT count(DISTINCT c_nationkey)::BIGINT AS clients, greatest(1, floor(count(DISTINCT c_nationkey) * 0.6))::BIGINT AS staying FROM customer")
def f7_staying_clients(spark, d):
    n = by_nation(spark, d).select("client_id").distinct().count()
    return spark.createDataFrame([(n, density.staying_clients(n, 40.0))], "clients bigint, staying bigint")


# Centres and rounds


@query("SELECT c_custkey AS sample_id, round(c_acctbal, 6) AS x0, c_nationkey::DOUBLE AS x1 FROM customer ORDER BY sha256('42:' || c_custkey), c_custkey LIMIT 6")
def o2_priority_top_k(spark, d):
    """The rows of least priority: the k of a start is the feature."""
    points = by_nation(spark, d)
    centers = rounds.priority_centers(points, 6, 42)
    found = spark.createDataFrame([tuple(float(v) for v in c) for c in centers], "x0 double, x1 double")
    ids = points.orderBy(priority(42, "sample_id"), "sample_id").limit(6).select("sample_id", F.col("features")[0].alias("x0"), F.col("features")[1].alias("x1"))
    return ids.join(found, ["x0", "x1"]).select("sample_id", r6("x0").alias("x0"), "x1")


@query("WITH m AS (SELECT c_nationkey AS client_id, avg(c_acctbal) AS x0, c_nationkey::DOUBLE AS x1 FROM customer GROUP BY 1) SELECT client_id::INT AS client_id, round(x0 * least(1.0, 4000.0 / greatest(sqrt(x0 * x0 + x1 * x1), 1e-12)), 5) AS x0, round(x1 * least(1.0, 4000.0 / greatest(sqrt(x0 * x0 + x1 * x1), 1e-12)), 5) AS x1 FROM m")
def i5_project_centers(spark, d):
    """Each nation's mean, projected onto a ball."""
    rows = by_nation(spark, d).groupBy("client_id").agg(F.avg(F.col("features")[0]).alias("x0"), F.avg(F.col("features")[1]).alias("x1")).orderBy("client_id").collect()
    inside = rounds.within_ball([[r.x0, r.x1] for r in rows], 4000.0)
    return spark.createDataFrame([(r.client_id, round(float(a), 5), round(float(b), 5)) for r, (a, b) in zip(rows, inside, strict=True)], "client_id int, x0 double, x1 double")


@query(f"WITH {CUST}, {START} SELECT sample_id, round(min((x0 - c0) * (x0 - c0) + (x1 - c1) * (x1 - c1)), 3) AS d2 FROM cust, start GROUP BY 1")
def j1_points_by_centers(spark, d):
    points = customers(spark, d)
    return rounds.assign_nearest(points, rounds.priority_centers(points, 3, 42), keep=["sample_id"]).select("sample_id", F.round("d2", 3).alias("d2"))


@query(f"""WITH {CUST}, {START}, {STEP.format(out='n1', centers='start', new='s1')}, {STEP.format(out='n2', centers='s1', new='s2')},
h AS (SELECT 1 AS round, sqrt(sum((a.c0 - b.c0) ** 2 + (a.c1 - b.c1) ** 2)) AS shift FROM start a JOIN s1 b USING (cluster) UNION ALL SELECT 2, sqrt(sum((a.c0 - b.c0) ** 2 + (a.c1 - b.c1) ** 2)) FROM s1 a JOIN s2 b USING (cluster))
SELECT round::INT AS round, round(shift, 4) AS shift, round(shift - lag(shift) OVER (ORDER BY round), 4) AS shift_change FROM h""")
def w6_round_shifts(spark, d):
    result = rounds.fed_kmeans(by_nation(spark, d), 3, rounds=2, tol=1e-12, seed=42)
    return rounds.history_table(spark, result.history).select("round", F.round("shift", 4).alias("shift"), F.round("shift_change", 4).alias("shift_change"))


@query(f"""WITH {NORMED}, start AS (SELECT row_number() OVER (ORDER BY sha256('42:' || sample_id), sample_id) - 1 AS cluster, x0 AS c0, x1 AS c1 FROM (SELECT * FROM pt ORDER BY sha256('42:' || sample_id), sample_id LIMIT 3)),
d AS (SELECT sample_id, x0, x1, cluster, greatest((x0 - c0) ** 2 + (x1 - c1) ** 2, 1e-12) AS d2 FROM pt, start), u AS (SELECT *, pow((1 / d2) / sum(1 / d2) OVER (PARTITION BY sample_id), 2) AS w FROM d),
new AS (SELECT cluster, sum(w * x0) / sum(w) AS c0, sum(w * x1) / sum(w) AS c1 FROM u GROUP BY 1), {NEAR.format(out='near', centers='new').replace('FROM cust', 'FROM pt')}
SELECT cluster::INT AS cluster, count(*)::BIGINT AS n, round(sum(x0), 4) AS total FROM near GROUP BY 1""")
def f2_fed_fuzzy_one_round(spark, d):
    points = scaling.scale_standard(by_nation(spark, d))
    result = rounds.fed_fuzzy_cmeans(points, 3, rounds=1, seed=42)
    return result.predictions.join(points.select("sample_id", "features"), "sample_id").groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("features")[0]), 4).alias("total"))


@query(f"""WITH {NORMED}, start AS (SELECT row_number() OVER (ORDER BY sha256('42:' || sample_id), sample_id) - 1 AS cluster, x0 AS c0, x1 AS c1 FROM (SELECT * FROM pt ORDER BY sha256('42:' || sample_id), sample_id LIMIT 3)),
v AS (SELECT avg(x0 * x0) - avg(x0) ** 2 AS v0, avg(x1 * x1) - avg(x1) ** 2 AS v1 FROM pt), l AS (SELECT sample_id, x0, x1, cluster, -0.5 * ((x0 - c0) ** 2 / v0 + (x1 - c1) ** 2 / v1) AS lp FROM pt, start, v),
r AS (SELECT *, exp(lp - max(lp) OVER w) / sum(exp(lp)) OVER w * exp(max(lp) OVER w) AS r FROM l WINDOW w AS (PARTITION BY sample_id)),
mm AS (SELECT cluster, sum(r) AS n, sum(r * x0) / sum(r) AS c0, sum(r * x1) / sum(r) AS c1, sum(r * x0 * x0) / sum(r) AS q0, sum(r * x1 * x1) / sum(r) AS q1 FROM r GROUP BY 1),
p AS (SELECT cluster, n / sum(n) OVER () AS w, c0, c1, greatest(q0 - c0 ** 2, 1e-6) AS v0, greatest(q1 - c1 ** 2, 1e-6) AS v1 FROM mm),
s AS (SELECT sample_id, x0, cluster, row_number() OVER (PARTITION BY sample_id ORDER BY ln(w + 1e-15) - 0.5 * (ln(2 * pi() * v0) + ln(2 * pi() * v1) + (x0 - c0) ** 2 / v0 + (x1 - c1) ** 2 / v1) DESC, cluster) AS place FROM pt, p)
SELECT cluster::INT AS cluster, count(*)::BIGINT AS n, round(sum(x0), 4) AS total FROM s WHERE place = 1 GROUP BY 1""")
def f3_fed_gmm_one_round(spark, d):
    points = scaling.scale_standard(by_nation(spark, d))
    result = rounds.fed_gmm_diag(points, 3, rounds=1, seed=42)
    return result.predictions.join(points.select("sample_id", "features"), "sample_id").groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("features")[0]), 4).alias("total"))


# Metrics


@query("SELECT NULL::DOUBLE AS davies_bouldin, NULL::DOUBLE AS calinski_harabasz, count(*)::BIGINT AS n FROM orders")
def m8_undefined_metrics(spark, d):
    """One cluster alone: geometry has no value."""
    rows = ruled(spark, d).withColumn("cluster", F.lit(0))
    return metrics.compute_metrics(rows, ["davies_bouldin", "calinski_harabasz"]).crossJoin(rows.agg(F.count(F.lit(1)).alias("n")))


@query(GEO.replace("WITH ", "WITH ", 1) + """, g AS (SELECT avg(x0) AS g0, avg(x1) AS g1, count(*) AS n FROM z), b AS (SELECT sum(k.n * ((c0 - g0) ** 2 + (c1 - g1) ** 2)) AS b, count(*) AS k FROM k, g), w AS (SELECT sum((x0 - c0) ** 2 + (x1 - c1) ** 2) AS w FROM z JOIN k USING (cluster))
SELECT round((b / (k - 1)) / (w / (n - k)), 4) AS calinski_harabasz FROM b, w, g""")
def m9_requested_metrics(spark, d):
    """Only what is asked for is there."""
    r = metrics.compute_metrics(ruled(spark, d), ["calinski_harabasz"])
    return r.select(*[F.round(c, 4).alias(c) for c in r.columns])


@query(f"""WITH {ORD}, {RULED}, v AS (SELECT 'four' AS how, cluster FROM ruled UNION ALL SELECT 'one', 0 FROM ruled UNION ALL SELECT 'nearly', CASE WHEN sample_id % 100 = 1 THEN 1 ELSE 0 END FROM ruled UNION ALL SELECT 'noise', -1 FROM ruled),
s AS (SELECT how, cluster, count(*) AS n FROM v GROUP BY 1, 2) SELECT how, CASE WHEN count(*) FILTER (cluster <> -1) < 2 THEN 'degenerate' WHEN max(n) FILTER (cluster <> -1) / sum(n) FILTER (cluster <> -1) >= 0.95 THEN 'near_degenerate' ELSE 'ok' END AS status,
(coalesce(sum(n) FILTER (cluster <> -1), 0) / sum(n) < 0.5) AS low_coverage FROM s GROUP BY 1""")
def m11_status(spark, d):
    rows = ruled(spark, d).select("sample_id", "cluster")
    ways = {"four": F.col("cluster"), "one": F.lit(0), "nearly": (F.col("sample_id") % 100 == 1).cast("int"), "noise": F.lit(-1)}
    out = None
    for how, cluster in ways.items():
        one = metrics.label_diagnostics(rows.withColumn("cluster", cluster), 4).select(F.lit(how).alias("how"), "status", "low_coverage")
        out = one if out is None else out.unionByName(one)
    return out


@query(CONT + """, mi AS (SELECT sum(c.n / t.n * ln(t.n * c.n / (a.n * b.n))) AS v FROM c JOIN a USING (label) JOIN b USING (cluster), t), h AS (SELECT (SELECT -sum(a.n / t.n * ln(a.n / t.n)) FROM a, t) AS ha, (SELECT -sum(b.n / t.n * ln(b.n / t.n)) FROM b, t) AS hb),
m AS (SELECT a.n AS x, b.n AS y, t.n AS n, unnest(range(greatest(1, (a.n + b.n - t.n)::BIGINT), least(a.n, b.n)::BIGINT + 1))::DOUBLE AS m FROM a, b, t),
e AS (SELECT sum(m / n * ln(n * m / (x * y)) * exp(lgamma(x + 1) + lgamma(y + 1) + lgamma(n - x + 1) + lgamma(n - y + 1) - lgamma(n + 1) - lgamma(m + 1) - lgamma(x - m + 1) - lgamma(y - m + 1) - lgamma(n - x - y + m + 1))) AS v FROM m)
SELECT round((mi.v - e.v) / ((ha + hb) / 2 - e.v), 6) AS ami FROM mi, h, e""")
def m4_ami_exact(spark, d):
    return metrics.ami(metrics.contingency(ruled(spark, d))).select(r6("ami").alias("ami"))


@query(CANON.replace(", canon AS", ", canon0 AS") + " SELECT cluster::INT AS cluster, c::INT AS canonical FROM f")
def w4_first_occurrence(spark, d):
    rows = ruled(spark, d)
    canon = metrics.canonical_labels(rows).withColumnRenamed("cluster", "canonical")
    return rows.filter("cluster <> -1").join(canon, "sample_id").select("cluster", "canonical").distinct()


@query("SELECT o_custkey AS custkey, o_orderkey AS orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def w5_best_candidate(spark, d):
    """Each customer's order of highest price, of equal ones the first."""
    rows = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("orderkey"), "o_totalprice")
    return run_statistics.best_candidates(rows, ["custkey"], [F.desc("o_totalprice"), F.asc("orderkey")]).select("custkey", "orderkey")


# Scalars


@query("""WITH v AS (SELECT vec_id, [x::DOUBLE for x in embedding[1:32]] AS a, [x::DOUBLE for x in embedding[33:64]] AS b FROM embeddings)
SELECT vec_id, round(list_sum([(a[i] - b[i]) * (a[i] - b[i]) for i in range(1, 33)]), 6) AS d2, round(list_max([abs(a[i] - b[i]) for i in range(1, 33)]), 6) AS cheb, round(list_dot_product(a, b), 6) AS dot, round(sqrt(list_dot_product(a, a)), 6) AS norm, round(list_sum(a), 6) AS total FROM v""")
def z1_vector_functions(spark, d):
    """The two halves of each vector."""
    v = embeddings(spark, d).select(F.col("sample_id").alias("vec_id"), F.slice("features", 1, 32).alias("a"), F.slice("features", 33, 32).alias("b"))
    return v.select("vec_id", r6(squared_distance("a", "b")).alias("d2"), r6(chebyshev("a", "b")).alias("cheb"), r6(dot("a", "b")).alias("dot"), r6(norm("a")).alias("norm"), r6(total("a")).alias("total"))


@query("SELECT o_orderkey AS id, sha256('7:' || o_orderkey) AS priority FROM orders")
def z2_priority(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"), priority(7, "o_orderkey").alias("priority"))


@query("""WITH c AS (SELECT o_orderstatus AS s, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1, 2), g AS (SELECT p, sum(n) / sum(sum(n)) OVER () AS q FROM c GROUP BY 1), f AS (SELECT s, p, n / sum(n) OVER (PARTITION BY s) AS x, q FROM c JOIN g USING (p))
SELECT s AS status, round(-sum(x * log2(x)), 6) AS entropy, round(sum((x * log2(x / ((x + q) / 2)) + q * log2(q / ((x + q) / 2))) / 2), 6) AS js FROM f GROUP BY 1""")
def z4_entropy_and_divergence(spark, d):
    c = spark.read.parquet(f"{d}/orders.parquet").groupBy(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    c = c.withColumn("x", F.col("n") / F.sum("n").over(Window.partitionBy("status"))).withColumn("q", F.sum("n").over(Window.partitionBy("p")) / F.sum("n").over(Window.partitionBy()))
    return c.groupBy("status").agg(r6(F.sum(entropy_term("x"))).alias("entropy"), r6(F.sum(js_term("x", "q"))).alias("js"))


@query(f"WITH {ORD}, {RULED}, c AS (SELECT client_id, label, count(*) AS n FROM ruled GROUP BY 1, 2) SELECT client_id::INT AS client_id, '{{' || string_agg('\"' || label || '\":' || n, ',' ORDER BY label) || '}}' AS counts, sum(n)::BIGINT AS n FROM c GROUP BY 1")
def z6_json_counts(spark, d):
    """Class counts as JSON, and their sum after reading it again."""
    rows = ruled(spark, d)
    c = partitioning.client_class_counts(rows.select("sample_id", "client_id"), rows).select("client_id", F.to_json("class_counts").alias("counts"))
    back = F.aggregate(F.map_values(F.from_json("counts", "map<string,bigint>")), F.lit(0).cast("bigint"), lambda a, b: a + b)
    return c.select("client_id", "counts", back.alias("n"))


@query("SELECT user_id, round(epoch_us(max(ts)) / 1e6 - epoch_us(min(ts)) / 1e6, 3) AS seconds FROM events GROUP BY 1")
def z7_seconds_between(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").groupBy("user_id").agg(F.min("ts").cast("string").alias("a"), F.max("ts").cast("string").alias("b"))
    return e.select("user_id", F.round(seconds_between("a", "b"), 3).alias("seconds"))


# Plans and plug-ins


@query("SELECT p AS dataset, a AS algorithm, s::INT AS seed, m AS mode, al::DOUBLE AS alpha FROM (SELECT DISTINCT o_orderpriority AS p FROM orders), (VALUES ('fed_gmm_diag'), ('fed_kmeans')) t(a), (VALUES (1), (2)) u(s), (VALUES ('iid', NULL), ('dirichlet', 0.1), ('dirichlet', 0.5)) v(m, al)")
def q2_build_plan(spark, d):
    """One data set an order priority; alphas multiply the Dirichlet mode alone."""
    names = sorted(r[0] for r in spark.read.parquet(f"{d}/orders.parquet").select("o_orderpriority").distinct().collect())
    plan = experiments.build_plan(spark, names, ["fed_kmeans", "fed_gmm_diag"], [1, 2], modes=["iid", "dirichlet"], alphas=[0.1, 0.5])
    return plan.select("dataset", "algorithm", "seed", "mode", "alpha")


@query("SELECT (c_nationkey % 5)::INT AS cluster, count(*)::BIGINT AS n FROM customer GROUP BY 1")
def v1_user_algorithm(spark, d):
    """A caller's own algorithm, registered, found by its name and run."""
    def by_owner(points, k, schedule, options, seed):
        return rounds.ClusterResult(points.withColumn("cluster", (F.col("owner") % k).cast("int")).drop("features"), {})

    register_algorithm("by_owner", Algorithm(by_owner, "local", "raw"))
    found = get_algorithm("by_owner").run(customers(spark, d), 5, None, {}, 1)
    return found.predictions.filter(F.lit("by_owner" in algorithm_names("local"))).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_size::INT AS label, count(*)::BIGINT AS n, round(sum(p_retailprice), 2) AS total FROM part GROUP BY 1")
def v3_user_source(spark, d):
    """A caller's own source of points, registered and loaded by its name."""
    sources.register_source("parts", lambda s, path: s.read.parquet(path).select(F.col("p_partkey").alias("sample_id"), F.array("p_retailprice").alias("features"), F.col("p_size").alias("label")))
    return sources.load_points(spark, "parts", {"path": f"{d}/part.parquet"}).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("features")[0]), 2).alias("total"))


# Explicit radii and private prototypes


@query(f"SELECT 0.04::DOUBLE AS eps, 'explicit' AS strategy, 5 AS min_samples, count(DISTINCT cluster) FILTER (cluster >= 0) AS clusters, count(*) FILTER (cluster = -1) AS noise FROM ({ORACLE_SQL['c4_dbscan']})")
def c6_explicit_radius(spark, d):
    """A radius that is given is taken, whatever the rule would choose, and reported with the clusters that it gives."""
    result = density.dbscan(scaling.scale_standard(customers(spark, d)), eps=0.04, min_samples=5)
    found = result.predictions.agg(F.count_distinct(F.when(F.col("cluster") >= 0, F.col("cluster"))).alias("clusters"), F.count_if(F.col("cluster") == -1).alias("noise"))
    return found.select(F.lit(result.model["eps"]).alias("eps"), F.lit(result.model["strategy"]).alias("strategy"), F.lit(result.model["min_samples"]).alias("min_samples"), "clusters", "noise")


#: Anchors of the private prototypes; no row is near the last.
ANCHORS = ((-0.8, -0.8), (0.0, 0.0), (0.8, 0.8), (9.0, 9.0))
PROTOTYPES = f"""WITH {ORD}, {RULED}, scaled AS (SELECT client_id, (x0 - 150000.0) / 90000.0 AS y0, (x1 - 700.0) / 400.0 AS y1 FROM ruled),
clipped AS (SELECT client_id, y0 * f AS y0, y1 * f AS y1 FROM (SELECT *, least(1.0, 1.5 / greatest(sqrt(y0 * y0 + y1 * y1), 1e-12)) AS f FROM scaled)),
near AS (SELECT *, [{", ".join(f"(y0 - {a}) ** 2 + (y1 - {b}) ** 2" for a, b in ANCHORS)}] AS d FROM clipped),
proto AS (SELECT client_id, list_position(d, list_min(d)) AS anchor, avg(y0) AS c0, avg(y1) AS c1, count(*)::DOUBLE AS weight FROM near GROUP BY 1, 2 HAVING count(*) > 1)"""


def private_setting(spark, d):
    """Orders by client on a public scale, clipped; anchors; the mechanism with its noise off, so that SQL can follow."""
    points = scaling.clip_l2(scaling.scale_public(ruled(spark, d), [150000.0, 700.0], [90000.0, 400.0]), 1.5)
    return points, np.array(ANCHORS), privacy.dp_aggregate_config("kmeans", 1.0, 1e-5, 1.5, 1, enabled=False)


def flat_center(df, *keep):
    return df.select(*keep, r6(F.col("center")[0]).alias("c0"), r6(F.col("center")[1]).alias("c1"), "weight")


@query(f"{PROTOTYPES} SELECT client_id::INT AS client_id, round(c0, 6) AS c0, round(c1, 6) AS c1, weight FROM proto")
def d7_prototypes(spark, d):
    return flat_center(privacy.dp_prototypes(*private_setting(spark, d)), "client_id")


@query(f"""{PROTOTYPES}, anchors(place, c0, c1) AS (VALUES {", ".join(f"({i}, {a}::DOUBLE, {b}::DOUBLE)" for i, (a, b) in enumerate(ANCHORS))}),
more AS (SELECT i % {len(ANCHORS)} AS place FROM range(40) r(i), (SELECT count(*) AS n FROM proto) WHERE i < 40 - n)
SELECT round(c0, 6) AS c0, round(c1, 6) AS c1, weight FROM proto UNION ALL SELECT c0, c1, 1.0::DOUBLE FROM more JOIN anchors USING (place)""")
def d8_padded_candidates(spark, d):
    """Prototypes, and anchors in turn until there are 40 candidates."""
    return flat_center(privacy.private_candidates(*private_setting(spark, d), 40))
