"""Helpers that the operators of this subpackage share.

Every operator reads the columns it names and ignores all others, so extra columns, whatever
their names, change nothing. A null text counts as an empty one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterloom.llm.fragments import give_back, slices, turn_to_other_work
from clusterloom.operators.graph import materialise as written
from clusterloom.operators.graph import shared_folder

__all__ = ["ARROW", "ascii_lower", "few_rows", "hand_few_rows", "load", "map_batches", "map_texts", "sha256", "shared_folder", "spans_digest", "written"]

ARROW = {
    "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(),
    "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()),
}

#: Rows that a task turns into Python objects at a time.
ROWS_AT_ONCE = 256
#: What bounds the rows on their way to Python: bytes that are handed over at a time, and rows that a Parquet reader holds.
#: Spark's defaults (64 MB, 4096 rows) are held several times over by each task where texts are long.
FEW_ROWS = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20), "spark.sql.parquet.columnarReaderBatchSize": "512"}


def hand_few_rows(spark: SparkSession) -> None:
    """From now on the session bounds the rows on their way to Python; results don't depend on it."""
    for key, value in FEW_ROWS.items():
        spark.conf.set(key, value)


@contextmanager
def few_rows(spark: SparkSession) -> Iterator[None]:
    """:func:`hand_few_rows` for what runs within."""
    before = {key: spark.conf.get(key) for key in FEW_ROWS}
    hand_few_rows(spark)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def map_texts(
    df: DataFrame,
    make: Callable[[], Callable[[list[str]], list[list]]],
    fields: dict[str, str],
    keep: list[str] | tuple[str, ...] = ("doc_id",),
    where: str | None = None,
) -> DataFrame:
    """Columns ``keep`` of ``df`` and the new ``fields`` (name to type) of each row's text, without a shuffle.

    ``make()`` runs once a task and gives a function from texts to one list a field. A new field takes the place of a
    kept column of its name. ``where`` names a boolean field: only rows where it is true stay.
    """
    keep = [c for c in keep if c not in fields]
    wanted = list(dict.fromkeys([*keep, "text"]))
    kinds = [ARROW[t] for t in fields.values()]
    names = [*keep, *fields]
    at = list(fields).index(where) if where else None

    def run(batches):
        turn_to_other_work()
        of_texts = make()
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                columns = of_texts([t or "" for t in part.column("text").to_pylist()])
                arrays = [part.column(c) for c in keep] + [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                out = pa.RecordBatch.from_arrays(arrays, names=names)
                yield out.filter(pa.array(columns[at], pa.bool_())) if where else out
        del of_texts
        give_back()

    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + [f"`{c}` {t}" for c, t in fields.items()])
    return df.select(*[F.col(f"`{c}`") for c in wanted]).mapInArrow(run, schema)


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.Array], list]], fields: dict[str, str], keep: list[str] | tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """As :func:`map_texts`, with the texts as an Arrow column, a bounded amount of text at a time."""
    keep = [c for c in keep if c not in fields]
    wanted = list(dict.fromkeys([*keep, "text"]))
    kinds = [ARROW[t] for t in fields.values()]

    def run(batches):
        of_texts = make()
        for batch in batches:
            for part, texts in slices(batch):
                arrays = [part.column(c) for c in keep] + [pa.array(c, k) for c, k in zip(of_texts(texts), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *fields])
                del arrays
                give_back()
        del of_texts
        give_back()

    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + [f"`{c}` {t}" for c, t in fields.items()])
    return df.select(*[F.col(f"`{c}`") for c in wanted]).mapInArrow(run, schema)


def spans_digest(spans: list[tuple[int, str, int]]) -> str:
    """``kind:start:end`` by start, the given order holding among equal starts, comma-joined."""
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in sorted(spans, key=lambda s: s[0]))


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def ascii_lower(text: str) -> str:
    """A-Z in lower case, all else as it is."""
    return text.lower() if text.isascii() else re.sub("[A-Z]+", lambda m: m[0].lower(), text)
