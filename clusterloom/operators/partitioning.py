"""Rows to clients (A1-A11). An assignment is sample_id, client_id; every row has one client.

A random order is that of SHA-256 keys, so it doesn't depend on how rows lie. Ranks come from two levels: rows are
bucketed by the first digits of their key, buckets are counted and summed up, and only rows of one bucket are sorted
together; no task sees a whole class.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clusterloom.functions.arrays import js_term, priority
from clusterloom.operators.graph import materialise

#: Hex digits of the key that make a bucket: 4096 buckets.
BUCKET_DIGITS = 3


def hash_rank(rows: DataFrame, seed: int, key: str = "sample_id", by: list[str] = (), name: str = "rank", digits: int = BUCKET_DIGITS) -> DataFrame:
    """``rows`` with the place (from 0) of each row in the random order of its group ``by``."""
    by = list(by)
    keyed = rows.withColumn("__key", priority(seed, key)).withColumn("__bucket", F.substring("__key", 1, digits))
    counts = keyed.groupBy(*by, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1) if by else Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy(*by, "__bucket").orderBy("__key", key))
    joined = keyed.withColumn("__within", within)
    offsets = offsets.withColumnsRenamed({c: f"__o_{c}" for c in [*by, "__bucket"]})
    on = None
    for c in [*by, "__bucket"]:
        same = F.col(c).eqNullSafe(F.col(f"__o_{c}"))
        on = same if on is None else on & same
    return joined.join(offsets, on).withColumn(name, F.col("__before") + F.col("__within") - 1).select(*rows.columns, name)


def _check(n: int, clients: int) -> None:
    if n <= 0 or clients <= 0 or clients > n:
        raise ValueError(f"{n} rows can't be dealt to {clients} clients")


def _by_quota(rank: Column, sizes: list[int]) -> Column:
    """The client whose range of ranks holds ``rank``: the number of range ends at or below it."""
    ends = F.array(*[F.lit(int(e)) for e in np.cumsum(sizes)])
    return F.size(F.filter(ends, lambda e: e <= rank)).cast("int")


def iid_sizes(n: int, clients: int) -> list[int]:
    return [n // clients + (i < n % clients) for i in range(clients)]


def quantity_sizes(n: int, clients: int, min_samples: int = 1) -> list[int]:
    """By weights that rise from 1 to 3: floors, then the largest fractions; a client that is too small takes from the largest."""
    _check(n, clients)
    if clients * min_samples > n:
        raise ValueError(f"{n} rows don't give {clients} clients {min_samples} each")
    weights = np.linspace(1.0, 3.0, clients)
    shares = n * weights / weights.sum()
    sizes = np.floor(shares).astype(int)
    for i in sorted(range(clients), key=lambda i: (-(shares[i] - sizes[i]), i))[: n - int(sizes.sum())]:
        sizes[i] += 1
    while sizes.min() < min_samples:
        sizes[int(sizes.argmax())] -= 1
        sizes[int(sizes.argmin())] += 1
    return [int(s) for s in sizes]


def partition_iid(points: DataFrame, clients: int, seed: int = 0) -> DataFrame:
    rows = points.select("sample_id")
    n = rows.count()
    _check(n, clients)
    return hash_rank(rows, seed).select("sample_id", _by_quota(F.col("rank"), iid_sizes(n, clients)).alias("client_id"))


def partition_quantity(points: DataFrame, clients: int, seed: int = 0, min_samples: int = 1) -> DataFrame:
    rows = points.select("sample_id")
    return hash_rank(rows, seed).select("sample_id", _by_quota(F.col("rank"), quantity_sizes(rows.count(), clients, min_samples)).alias("client_id"))


def class_counts(points: DataFrame) -> list[tuple]:
    return sorted(((r.label, r.n) for r in points.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()), key=lambda x: (x[0] is not None, x[0]))


def dirichlet_quotas(counts: list[tuple], clients: int, alpha: float, seed: int, min_samples: int, attempts: int = 100) -> list[tuple]:
    """(label, client sizes): for each class multinomial counts by Dirichlet proportions; redrawn until no client is too small."""
    if alpha <= 0:
        raise ValueError("alpha must be positive")
    for attempt in range(attempts):
        rng = np.random.default_rng([seed, attempt])
        quotas = [(label, rng.multinomial(n, rng.dirichlet(np.full(clients, alpha)))) for label, n in counts]
        if sum(q for _, q in quotas).min() >= min_samples:
            return quotas
    raise ValueError(f"no draw of {attempts} gives each client {min_samples} rows")


def _by_label_quota(points: DataFrame, quotas: list[tuple], seed: int) -> DataFrame:
    ranked = hash_rank(points.select("sample_id", "label"), seed, by=["label"])
    ranges = []
    for label, sizes in quotas:
        ends = np.cumsum(sizes)
        ranges += [(label, client, int(end - size), int(end)) for client, (size, end) in enumerate(zip(sizes, ends, strict=True)) if size]
    # Classes times clients rows.
    table = F.broadcast(points.sparkSession.createDataFrame(ranges, "q_label int, client_id int, lo bigint, hi bigint"))
    return ranked.join(table, F.col("label").eqNullSafe(F.col("q_label")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))).select("sample_id", "client_id")


def partition_dirichlet(points: DataFrame, clients: int, alpha: float, seed: int = 0, min_samples: int = 1) -> DataFrame:
    """Label skew; without labels as :func:`partition_iid`."""
    if "label" not in points.columns:
        return partition_iid(points, clients, seed)
    counts = class_counts(points)
    _check(sum(n for _, n in counts), clients)
    return _by_label_quota(points, dirichlet_quotas(counts, clients, alpha, seed, min_samples), seed)


def label_limited_quotas(counts: list[tuple], clients: int, labels_per_client: int, min_samples: int, attempts: int = 100) -> list[tuple]:
    """Client i may hold consecutive classes from floor(i * classes / clients) + offset on; a class is split evenly over its clients.

    More labels a client than there are classes mean all classes.
    """
    k = len(counts)
    if labels_per_client < 1:
        raise ValueError("a client needs one label at least")
    labels_per_client = min(labels_per_client, k)
    for offset in range(attempts):
        allowed = [{(i * k // clients + offset + j) % k for j in range(labels_per_client)} for i in range(clients)]
        quotas = []
        for c, (label, n) in enumerate(counts):
            own = [i for i in range(clients) if c in allowed[i]]
            if not own:
                break
            sizes = np.zeros(clients, dtype=int)
            sizes[own] = iid_sizes(n, len(own))
            quotas.append((label, sizes))
        if len(quotas) == k and sum(q for _, q in quotas).min() >= min_samples:
            return quotas
    raise ValueError(f"no offset of {attempts} covers all classes with {min_samples} rows a client")


def partition_label_limited(points: DataFrame, clients: int, labels_per_client: int, seed: int = 0, min_samples: int = 1) -> DataFrame:
    if "label" not in points.columns:
        raise ValueError("label-limited partitions need labels")
    counts = class_counts(points)
    _check(sum(n for _, n in counts), clients)
    return _by_label_quota(points, label_limited_quotas(counts, clients, labels_per_client, min_samples), seed)


def partition_by_column(points: DataFrame, column: str) -> DataFrame:
    """Natural clients: an owner's place among the sorted owners. Owners are ranked, not rows."""
    owners = points.select(column).distinct().select(F.col(column).alias("__owner"))
    ranked = hash_free_rank(owners, "__owner").select("__owner", F.col("rank").cast("int").alias("client_id"))
    return points.select("sample_id", column).join(ranked, F.col(column).eqNullSafe(F.col("__owner"))).select("sample_id", "client_id")


def hash_free_rank(rows: DataFrame, key: str) -> DataFrame:
    """Place (from 0) of each distinct key in its own order, by range partitions that are counted and summed up."""
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # Written once: ranges are drawn from a sample, so counts and ranks must see the same ones.
    ranged = materialise(rows.repartitionByRange(n, key).withColumn("__part", F.spark_partition_id()), "ranges")
    bounds = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(F.asc_nulls_first(key)))
    return ranged.withColumn("__within", within).join(F.broadcast(bounds), "__part").withColumn("rank", F.col("__before") + F.col("__within") - 1).drop("__part", "__within", "__before")


def make_partition(points: DataFrame, mode: str, clients: int = 5, seed: int = 0, alpha: float = 0.5, labels_per_client: int = 2, min_samples: int = 1, column: str | None = None) -> DataFrame:
    modes = {
        "iid": lambda: partition_iid(points, clients, seed),
        "dirichlet": lambda: partition_dirichlet(points, clients, alpha, seed, min_samples),
        "quantity_skew": lambda: partition_quantity(points, clients, seed, min_samples),
        "label_limited": lambda: partition_label_limited(points, clients, labels_per_client, seed, min_samples),
        "natural": lambda: partition_by_column(points, column),
    }
    if mode not in modes:
        raise ValueError(f"unknown partition mode {mode!r}; known: {sorted(modes)}")
    return modes[mode]()


def client_class_counts(assignment: DataFrame, labels: DataFrame) -> DataFrame:
    counts = assignment.join(labels.select("sample_id", "label"), "sample_id").groupBy("client_id", "label").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("client_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("class_counts"), F.sum("n").alias("n"))


def client_sizes(assignment: DataFrame) -> DataFrame:
    return assignment.groupBy("client_id").agg(F.count(F.lit(1)).alias("n"))


def check_cover(points: DataFrame, assignment: DataFrame) -> DataFrame:
    """rows, assigned, distinct_assigned, missing: a partition is right if the first three are equal and nothing is missing."""
    a = assignment.agg(F.count(F.lit(1)).alias("assigned"), F.count_distinct("sample_id").alias("distinct_assigned"))
    missing = points.join(assignment, "sample_id", "left_anti").agg(F.count(F.lit(1)).alias("missing"))
    return points.agg(F.count(F.lit(1)).alias("rows")).join(F.broadcast(a)).join(F.broadcast(missing))


def fingerprint(rows: DataFrame, group: str, key: str, digits: int = 2) -> DataFrame:
    """One row ``fingerprint`` (16 hex digits), equal iff the same keys are in the same groups.

    Keys are digested in buckets (by the first digits of their hash), so that no list grows with a group.
    """
    text = F.sha2(F.concat_ws(":", F.col(group).cast("string"), F.col(key).cast("string")), 256)
    parts = rows.select(F.substring(text, 1, digits).alias("bucket"), text.alias("d")).withColumn("sub", F.substring("d", digits + 1, 2))
    small = parts.groupBy("bucket", "sub").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("d")), ","), 256).alias("d"))
    middle = small.groupBy("bucket").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("sub", "d"))), ","), 256).alias("d"))
    return middle.agg(F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("bucket", "d"))), ","), 256), 1, 16).alias("fingerprint"))


def partition_fingerprint(assignment: DataFrame) -> DataFrame:
    return fingerprint(assignment, "client_id", "sample_id")


def heterogeneity_clients(assignment: DataFrame, labels: DataFrame) -> DataFrame:
    """client_id, n, support (classes), js (bits, against all rows' classes) of each client."""
    counts = assignment.join(labels.select("sample_id", "label"), "sample_id").groupBy("client_id", "label").agg(F.count(F.lit(1)).alias("n_label"))
    sizes = counts.groupBy("client_id").agg(F.sum("n_label").alias("n"), F.count(F.lit(1)).alias("support"))
    whole = counts.groupBy("label").agg(F.sum("n_label").alias("n_class")).withColumn("q", F.col("n_class") / F.sum("n_class").over(Window.partitionBy()))
    # Clients times classes: a class that a client lacks has its part too.
    grid = sizes.crossJoin(F.broadcast(whole)).join(counts, ["client_id", "label"], "left")
    p = F.coalesce(F.col("n_label"), F.lit(0)) / F.col("n")
    return grid.groupBy("client_id", "n", "support").agg(F.greatest(F.sum(js_term(p, "q")), F.lit(0.0)).alias("js"))


def heterogeneity(assignment: DataFrame, labels: DataFrame) -> DataFrame:
    return heterogeneity_clients(assignment, labels).agg(
        (F.stddev_pop("n") / F.avg("n")).alias("size_cv"), F.min("n").alias("min_size"), F.max("n").alias("max_size"),
        (F.sum(F.col("n") * F.col("js")) / F.sum("n")).alias("weighted_js"), F.max("js").alias("max_js"),
        F.min("support").alias("min_support"), F.avg("support").alias("mean_support"),
    )
