"""Runs appended to a shared folder (K3, K4): each append is seen as a whole or not at all, and each run has its own id.

An append stages its rows in a folder of its own, then claims the next version by creating that version's file, which
fails if another writer has it: then the one after is tried. The file names the folder, and with it the append is
published. Readers list versions and read only folders that these name; what a writer left when it died, and a version
file that it didn't finish, are never read. A run's id comes from its second and data set; the runs that share them are
numbered by version and experiment, so an id never changes and no two runs have the same.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clusterloom.functions.arrays import safe_name
from clusterloom.sources.sinks import strict_rows

VERSIONS, DATA = "_versions", "data"


def run_base(started_at: str = "started_at", dataset: str = "dataset"):
    return F.concat(F.date_format(F.to_timestamp(started_at), "yyyyMMdd_HHmmss"), F.lit("_"), safe_name(dataset))


def _numbered(rows: DataFrame, order: list) -> DataFrame:
    """run_id of rows with base: the base, with _2, _3 from the second on."""
    n = F.row_number().over(Window.partitionBy("base").orderBy(*order))
    return rows.withColumn("run_id", F.when(n == 1, F.col("base")).otherwise(F.concat("base", F.lit("_"), n))).drop("base")


def run_ids(runs: DataFrame) -> DataFrame:
    """``runs`` (experiment_id, dataset, started_at) with the run_id that each has in a store without other runs."""
    return _numbered(runs.withColumn("base", run_base()), [F.col("experiment_id")])


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _claimed(spark: SparkSession, path: str):
    """A stream into a file that this call alone has created; None if it was there."""
    target, files = _files(spark, path)
    try:
        if files.getUri().getScheme() != "file":
            return files.create(target, False)
        # Hadoop looks before it creates on local disks, which isn't one step; Java has one.
        jvm = spark._jvm
        none = spark.sparkContext._gateway.new_array(jvm.java.nio.file.attribute.FileAttribute, 0)
        jvm.java.nio.file.Files.createFile(jvm.java.nio.file.Paths.get(target.toUri().getPath(), spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0)), none)
        return files.create(target, True)
    except Py4JJavaError as error:
        if "AlreadyExists" in error.java_exception.getClass().getName():
            return None
        raise


def published(spark: SparkSession, root: str) -> dict[int, str]:
    """Folders by version, of appends that are complete."""
    place, files = _files(spark, f"{root}/{VERSIONS}")
    if not files.exists(place):
        return {}
    out = {}
    for r in spark.read.text(f"{root}/{VERSIONS}/*.json", wholetext=True).select("value", F.input_file_name().alias("path")).toLocalIterator():
        try:
            out[int(r.path.rsplit("/", 1)[1].split(".")[0])] = json.loads(r.value)["folder"]
        except (ValueError, KeyError):  # a writer died while it wrote the version
            continue
    return dict(sorted(out.items()))


def stage(runs: DataFrame, root: str) -> str:
    """Writes the rows where no reader looks; the folder's name."""
    folder = uuid.uuid4().hex
    strict_rows(runs).write.json(f"{root}/{DATA}/{folder}", ignoreNullFields=False)
    return folder


def publish(spark: SparkSession, root: str, folder: str) -> int:
    """Claims the next version for a staged folder; the version."""
    place, files = _files(spark, f"{root}/{VERSIONS}")
    files.mkdirs(place)
    taken = [int(name.split(".")[0]) for s in files.listStatus(place) if (name := s.getPath().getName())[:1].isdigit()]
    version = max(taken, default=0) + 1
    while True:
        out = _claimed(spark, f"{root}/{VERSIONS}/{version:09d}.json")
        if out is None:  # another writer was first
            version += 1
            continue
        out.write(bytearray(json.dumps({"folder": folder}).encode()))
        out.close()
        return version


def append(runs: DataFrame, root: str) -> int:
    """Appends ``runs`` (experiment_id, dataset, started_at and whatever else) as one version."""
    return publish(runs.sparkSession, root, stage(runs, root))


def read_runs(spark: SparkSession, root: str, schema: T.StructType | str) -> DataFrame:
    """All published runs with version and run_id; an empty store has no rows. The versions, a row each, are broadcast: a
    shuffle by folder brings all rows of an append into one task."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    versions = published(spark, root)
    if not versions:
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("version", T.IntegerType()), T.StructField("run_id", T.StringType())]))
    rows = spark.read.schema(schema).json([f"{root}/{DATA}/{folder}" for folder in versions.values()])
    named = spark.createDataFrame([(folder, version) for version, folder in versions.items()], "folder string, version int")
    folder = F.regexp_extract(F.col("_metadata.file_path"), f"/{DATA}/([0-9a-f]+)/[^/]*$", 1)
    own = rows.select("*", folder.alias("folder")).join(F.broadcast(named), "folder").drop("folder").withColumn("base", run_base())
    return _numbered(own, [F.col("version"), F.col("experiment_id")])
