"""Where reports and results go (K1-K6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clusterloom.functions.arrays import finite

#: The columns of a flat result row.
RESULT_COLUMNS = (
    "experiment_id", "started_at", "finished_at", "mode", "dataset", "algorithm", "backend", "runtime_sec", "communication_bytes", "rounds",
    "ari", "nmi", "ami", "silhouette", "davies_bouldin", "calinski_harabasz", "partition_id", "num_clients", "participation_rate", "dropout_rate",
    "privacy_mode", "dp_epsilon", "dp_delta", "dp_clip_norm", "prediction_hash", "client_ari_mean", "client_ari_weighted", "client_ari_worst",
    "client_ari_std", "client_nmi_mean", "client_nmi_weighted", "client_nmi_worst", "client_nmi_std", "evaluation_space", "benchmark_input_hash",
    "active_data_fingerprint", "cluster_count_mode", "tuning_mode", "class_js_divergence_weighted_bits", "metric_schema_version",
    "assigned_fraction", "runtime_wall_including_preprocessing_sec",
)

#: What a release may show.
PUBLIC_COLUMNS = ("experiment_id", "dataset", "algorithm", "ari", "ami", "nmi", "silhouette", "communication_bytes", "runtime_sec", "metric_schema_version")


def strict(column: Column, kind: T.DataType) -> Column:
    """Non-finite numbers at any depth as null, so that the JSON is strict."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return finite(column)
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: strict(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(column, lambda _, v: strict(v, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(column.isNotNull(), F.struct(*[strict(column[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    return column


def strict_rows(df: DataFrame) -> DataFrame:
    return df.select(*[strict(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def write_report(df: DataFrame, path: str) -> None:
    """One report (a row, however nested) as one JSON document: ``path`` holds a single file, readable as :func:`read_history` does."""
    strict_rows(df).coalesce(1).write.mode("errorifexists").option("ignoreNullFields", "false").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").json(path)


def result_rows(df: DataFrame) -> DataFrame:
    """The flat columns, absent ones null; privacy figures only of private runs, participation only of federated ones."""
    rows = df.select(*[(F.col(c) if c in df.columns else F.lit(None).cast("string")).alias(c) for c in RESULT_COLUMNS])
    private = F.col("privacy_mode").isin("gaussian_dp", "gaussian_dp_aggregate")
    federated = F.col("mode") == "federated"
    for name in ("dp_epsilon", "dp_delta", "dp_clip_norm"):
        rows = rows.withColumn(name, F.when(private, F.col(name)))
    for name in ("participation_rate", "dropout_rate"):
        rows = rows.withColumn(name, F.when(federated, F.col(name)))
    return rows.withColumn("privacy_mode", F.when(federated, F.col("privacy_mode")).otherwise("none"))


def write_results(df: DataFrame, path: str, form: str = "parquet") -> None:
    writer = result_rows(strict_rows(df)).write.mode("append").partitionBy("dataset")
    writer.option("header", "true").csv(path) if form == "csv" else writer.parquet(path)


def append_runs(df: DataFrame, path: str) -> None:
    strict_rows(df).write.mode("append").json(path)


def report_tables(report: DataFrame) -> dict[str, DataFrame]:
    """Flat tables of nested reports: results with status, request settings, privacy, heterogeneity."""
    key = ["experiment_id"]
    results = report.select(*key, F.explode_outer("results").alias("r")).select(*key, "r.*")
    tables = {
        "results": results,
        "configuration": report.select(*key, "started_at", "finished_at", "request.*"),
        "privacy": report.select(*key, "request.privacy_mode"),
        "log": report.select(*key, F.col("started_at").alias("at"), F.lit("started").alias("event")).unionByName(report.select(*key, F.col("finished_at").alias("at"), F.lit("finished").alias("event"))),
        "partition": report.select(*key, "partition.fingerprint", F.explode_outer("partition.heterogeneity").alias("figure", "value")),
    }
    for name in ("schedule", "client_metrics"):
        if name in report.columns:
            tables[name] = report.select(*key, F.explode_outer(name).alias("x")).select(*key, "x.*")
    return tables


def public_report(df: DataFrame) -> DataFrame:
    """The columns that a release may show; an error if any run had a privacy mode."""
    if not df.filter(F.coalesce(F.col("privacy_mode"), F.lit("none")) != "none").isEmpty():
        raise PermissionError("runs with a privacy mode can't be released: the report itself uses clean data")
    return df.select(*[c for c in PUBLIC_COLUMNS if c in df.columns])
