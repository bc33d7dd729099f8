"""Sources of points and stored runs."""

from __future__ import annotations

import gzip
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clusterloom.functions.arrays import hash_uniform
from clusterloom.operators.partitioning import hash_rank
from clusterloom.operators.scaling import scale_unit
from clusterloom.sources import idx

_SOURCES: dict[str, Callable[..., DataFrame]] = {}


def register_source(name: str, loader: Callable[..., DataFrame]) -> None:
    """``loader(spark, **params)`` gives sample_id, features and, if there are classes, label."""
    _SOURCES[name] = loader


def source_names() -> list[str]:
    return sorted(_SOURCES)


def load_points(spark: SparkSession, name: str, params: dict | None = None) -> DataFrame:
    if name not in _SOURCES:
        raise ValueError(f"unknown source {name!r}; known: {source_names()}")
    return _SOURCES[name](spark, **(params or {}))


#: Classes that are broadcast at most; more of them meet their rows in a shuffle.
CLASSES = 4096


def class_codes(rows: DataFrame, column: str, name: str = "label") -> DataFrame:
    """``rows`` with each class's place among the sorted classes; classes are ranked, not rows. A null class stays null.

    Up to ``CLASSES`` classes are broadcast, as a shuffle by class puts all rows of one into one task.
    """
    classes = rows.select(F.col(column).alias("__class")).filter("__class is not null").distinct()
    codes = classes.select("__class", (F.row_number().over(Window.orderBy("__class")) - 1).cast("int").alias("__code"))
    codes = F.broadcast(codes) if classes.limit(CLASSES + 1).count() <= CLASSES else codes
    return rows.join(codes, F.col(column) == F.col("__class"), "left").drop("__class").withColumnRenamed("__code", name)


def from_table(spark: SparkSession, path: str, key: str, features: list[str], label: str | None = None, client: str | None = None) -> DataFrame:
    """Numeric columns of a Parquet table as points; only the named columns are read."""
    rows = spark.read.parquet(path).select(key, *features, *([label] if label else []), *([client] if client else []))
    columns = [F.col(key).cast("bigint").alias("sample_id"), F.array(*[F.col(c).cast("double") for c in features]).alias("features")]
    if client:
        columns.append(F.col(client).alias("owner"))
    return class_codes(rows.select(*columns, F.col(label).alias("__y")), "__y").drop("__y") if label else rows.select(*columns)


def numbered(rows: DataFrame, block: list[str], at: str, name: str = "sample_id") -> DataFrame:
    """``rows`` with their place (from 0): blocks in their order, rows of a block by ``at``. Only block sizes are summed up in one place."""
    sizes = rows.groupBy(*block).agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy(*block).orderBy(at)) - 1
    return rows.withColumn("__within", within).join(sizes.withColumn("__before", before).drop("__n"), block).withColumn(name, F.col("__before") + F.col("__within")).drop("__before", "__within")


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(F.col("vec_id").alias("sample_id"), F.transform("embedding", lambda x: x.cast("double")).alias("features"), "label")


def read_line_items(spark: SparkSession, path: str) -> DataFrame:
    """Rows have no key, and may repeat: sample_id is a row's place, files by their name. What is broadcast is a number a file."""
    rows = spark.read.parquet(path)
    place = [F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row")]
    files = rows.select(*place).groupBy("__file").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbers = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    named = rows.select(F.array(*[F.col(c).cast("double") for c in numbers]).alias("features"), F.col("l_suppkey").alias("owner"), F.col("l_returnflag").alias("__y"), *place)
    placed = named.join(F.broadcast(files.select("__file", before.alias("__before"))), "__file").select((F.col("__before") + F.col("__row")).alias("sample_id"), "features", "owner", "__y")
    return class_codes(placed, "__y").drop("__y")


def read_arff(spark: SparkSession, path: str, target: str = "class") -> DataFrame:
    """An ARFF table: attribute names from its head, comma-separated data rows; all but the class are numbers. sample_id is a
    row's place in the file, so repeated rows stay apart."""
    lines = spark.read.text(path).select(F.trim("value").alias("v"), F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__line")).filter("v <> '' and not startswith(v, '%')")
    names = [r.n for r in lines.filter(F.lower("v").startswith("@attribute")).select(F.regexp_extract("v", r"(?i)^@attribute\s+['\"]?([^\s'\"]+)", 1).alias("n")).collect()]
    at = next((i for i, n in enumerate(names) if n.lower() == target), None)
    if at is None:
        raise ValueError(f"{path} has no attribute {target!r}; it has {names}")
    # Head lines start with @; data lines never do.
    cells = numbered(lines.filter("not startswith(v, '@')"), ["__file", "__block"], "__line").select("sample_id", F.split("v", r"\s*,\s*").alias("c"))
    numbers = F.array(*[F.col("c")[i].cast("double") for i in range(len(names)) if i != at])
    rows = cells.select("sample_id", numbers.alias("features"), F.regexp_replace(F.col("c")[at], "^'|'$", "").alias("__y"))
    return class_codes(rows, "__y").drop("__y")


def expect_shape(points: DataFrame, rows: int | None = None, features: int | None = None, classes: int | None = None) -> DataFrame:
    r = points.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("features")).alias("lo"), F.max(F.size("features")).alias("hi"), *([F.count_distinct("label").alias("k")] if "label" in points.columns else [F.lit(0).alias("k")])).first()
    found = {"rows": (r.n, rows), "features": (r.lo, features), "classes": (r.k, classes)}
    wrong = {k: v for k, v in found.items() if v[1] is not None and v[0] != v[1]}
    if wrong or (r.lo != r.hi):
        raise ValueError(f"unexpected shape (found, expected): {wrong or (r.lo, r.hi)}")
    return points


#: First words of image and label files.
IMAGE_MAGIC, LABEL_MAGIC = 2051, 2049


def decode_idx(content: bytes) -> np.ndarray:
    """Images as rows of pixels, or labels; the size in the head must be that of the payload."""
    raw = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
    magic, n = (int(v) for v in np.frombuffer(raw[:8], dtype=">i4"))
    if magic == LABEL_MAGIC:
        out = np.frombuffer(raw, dtype=np.uint8, offset=8)
        shape, ok = (n,), len(out) == n
    elif magic == IMAGE_MAGIC:
        h, w = (int(v) for v in np.frombuffer(raw[8:16], dtype=">i4"))
        out = np.frombuffer(raw, dtype=np.uint8, offset=16)
        shape, ok = (n, h * w), len(out) == n * h * w
    else:
        raise ValueError(f"unknown first word {magic}")
    if not ok:
        raise ValueError("the payload's length is not what the head says")
    return out.reshape(shape)


def read_idx(spark: SparkSession, folder: str, scale: bool = True, task_bytes: int = 16 << 20) -> DataFrame:
    """Image and label files of a folder, train first; images and labels meet on (part, place). Files are read in pieces of
    ``task_bytes``, so a large one is many tasks; without features nothing but the heads is read."""
    idx.register(spark)
    files = spark.read.format("idx").option("task_bytes", task_bytes)
    images = files.option("rows", "features").schema("part int, place bigint, features array<double>").load(folder)
    labels = files.option("rows", "labels").schema("part int, place bigint, label int").load(folder)
    first = files.option("rows", "features").schema("part int").load(folder).filter("part = 0").agg(F.count(F.lit(1)).alias("n"))
    rows = images.join(labels, ["part", "place"]).join(F.broadcast(first)).select((F.col("place") + F.col("part") * F.col("n")).alias("sample_id"), "features", "label")
    return scale_unit(rows) if scale else rows


def write_idx(points: DataFrame, folder: str, split: str = "train", file_bytes: int = 64 << 20) -> None:
    """features and label of ``points`` as pairs of files; none may be null, and all records have one length."""
    idx.register(points.sparkSession)
    points.select("features", F.col("label").cast("int").alias("label")).write.format("idx").mode("append").option("split", split).option("file_bytes", file_bytes).save(folder)


def stratified_sample(points: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n rows with the classes' shares kept (largest remainders); all rows if there are no more. Sorted by id."""
    counts = {r.label: r.n for r in points.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    if n >= total:
        return points.orderBy("sample_id")
    share = {c: n * m / total for c, m in counts.items()}
    quota = {c: int(v) for c, v in share.items()}
    for c in sorted(share, key=lambda c: (-(share[c] - quota[c]), str(c)))[: n - sum(quota.values())]:
        quota[c] += 1
    table = F.broadcast(points.sparkSession.createDataFrame(list(quota.items()), "q_label int, quota bigint"))
    ranked = hash_rank(points.select("sample_id", "label"), seed, by=["label"])
    chosen = ranked.join(table, F.col("label").eqNullSafe(F.col("q_label"))).filter(F.col("rank") < F.col("quota")).select("sample_id")
    return points.join(chosen, "sample_id", "left_semi").orderBy("sample_id")


def make_blobs(spark: SparkSession, n: int = 500, centers: int = 3, std: float = 1.0, seed: int = 42, features: int = 2) -> DataFrame:
    """Isotropic Gaussian clouds; every number comes from a hash of seed, row and feature, so it is the same anywhere."""
    middle = np.random.default_rng(seed).uniform(-10.0, 10.0, (centers, features))
    label = (F.col("id") % centers).cast("int")
    table = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in middle])

    def coordinate(j: int):
        u = F.greatest(hash_uniform(seed * 1000 + 2 * j, "id"), F.lit(1e-16))
        v = hash_uniform(seed * 1000 + 2 * j + 1, "id")
        return table[label][j] + F.sqrt(-2 * F.log(u)) * F.cos(2 * np.pi * v) * std

    return spark.range(n).select(F.col("id").alias("sample_id"), F.array(*[coordinate(j) for j in range(features)]).alias("features"), label.alias("label"))




RESULT = T.StructType([T.StructField(n, t) for n, t in (("algorithm", T.StringType()), ("status", T.StringType()), ("ari", T.DoubleType()), ("nmi", T.DoubleType()), ("ami", T.DoubleType()), ("silhouette", T.DoubleType()), ("runtime_sec", T.DoubleType()), ("communication_bytes", T.LongType()), ("prediction_hash", T.StringType()))])
REQUEST = T.StructType([T.StructField(n, t) for n, t in (("dataset", T.StringType()), ("mode", T.StringType()), ("partition_mode", T.StringType()), ("dirichlet_alpha", T.DoubleType()), ("participation_rate", T.DoubleType()), ("dropout_rate", T.DoubleType()), ("cluster_count_mode", T.StringType()), ("privacy_mode", T.StringType()), ("seed", T.IntegerType()))])
REPORT = T.StructType([T.StructField("experiment_id", T.StringType()), T.StructField("started_at", T.StringType()), T.StructField("finished_at", T.StringType()), T.StructField("request", REQUEST), T.StructField("partition", T.StructType([T.StructField("fingerprint", T.StringType()), T.StructField("heterogeneity", T.MapType(T.StringType(), T.DoubleType()))])), T.StructField("results", T.ArrayType(RESULT))])


def read_history(spark: SparkSession, root: str) -> DataFrame:
    """All readable ``<root>/*/report.json``; a damaged file is left out and hides no other. Fields that a file lacks are null."""
    schema = T.StructType([*REPORT.fields, T.StructField("_corrupt_record", T.StringType())])
    rows = spark.read.schema(schema).json(f"{root}/*/report.json", multiLine=True, mode="PERMISSIVE").withColumn("path", F.input_file_name())
    return rows.filter("_corrupt_record is null and request is not null").drop("_corrupt_record")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Flat result rows from CSV, whatever mark the file begins with; empty cells are null."""
    rows = spark.read.csv(path, header=True, encoding="UTF-8", nullValue="", emptyValue="")
    return rows.toDF(*[c.lstrip("﻿") for c in rows.columns])
