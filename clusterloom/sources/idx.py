"""Files of fixed-length records as a Spark data source named ``idx``.

A file has a head (kind of number, shape) and then its records, big-endian, without any marks between them; so a task can
start at any record. A folder holds files of records (two axes or more) and files of labels (one axis); those of one part
(``train`` in the name, or not) follow each other in the order of their names, and a record and its label meet on their place.

Reading: ``spark.read.format("idx").load(folder)`` gives part, place, features, label. With a schema of some of these columns
only they are decoded, and without features or labels no record is read at all. Options: ``rows`` (``features`` or
``labels``: files of that sort alone) and ``task_bytes``. A file packed by gzip has no places to start at and is one task.

Writing: ``df.write.format("idx").mode("append").save(folder)`` of features and label. A task writes a pair of files for each
``file_bytes`` of its records, beside the folder's own ones; they get their names when all tasks are done, so a task that is
lost or run twice leaves nothing that readers see. Options: ``split`` (the part) and ``file_bytes``.

The folder must be one that all executors reach by the same path.
"""

from __future__ import annotations

import gzip
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from math import prod

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Kinds of numbers by their code in the head.
KINDS = {8: ">u1", 9: ">i1", 11: ">i2", 12: ">i4", 13: ">f4", 14: ">f8"}
COLUMNS = {"part": pa.int32(), "place": pa.int64(), "features": pa.list_(pa.float64()), "label": pa.int32()}
SCHEMA = "part int, place bigint, features array<double>, label int"
#: Bytes of records that are decoded at a time.
CHUNK = 4 << 20


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it; ``file:/a`` is ``file:///a``."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:") :]
    return fs.FileSystem.from_uri(path)


@dataclass(frozen=True)
class Head:
    kind: str
    shape: tuple[int, ...]

    @classmethod
    def of(cls, stream, name: str) -> Head:
        mark = stream.read(4)
        if len(mark) < 4 or mark[:2] != b"\0\0" or mark[2] not in KINDS or not mark[3]:
            raise ValueError(f"{name}: no head of a known kind")
        sizes = stream.read(4 * mark[3])
        if len(sizes) < 4 * mark[3]:
            raise ValueError(f"{name}: the head is cut off")
        return cls(KINDS[mark[2]], tuple(int(v) for v in np.frombuffer(sizes, dtype=">i4")))

    @property
    def size(self) -> int:
        return 4 + 4 * len(self.shape)

    @property
    def width(self) -> int:
        return prod(self.shape[1:])

    @property
    def record(self) -> int:
        return self.width * np.dtype(self.kind).itemsize

    def bytes(self) -> bytes:
        code = next(c for c, k in KINDS.items() if k == self.kind)
        return bytes([0, 0, code, len(self.shape)]) + np.array(self.shape, dtype=">i4").tobytes()


@dataclass
class Records(InputPartition):
    """``rows`` records of a file from ``first`` on; the first of them has the place ``place``."""

    path: str
    head: Head
    packed: bool
    part: int
    first: int
    rows: int
    place: int


class IdxReader(DataSourceReader):
    def __init__(self, schema, options):
        self.names = list(schema.fieldNames())
        unknown = sorted(set(self.names) - set(COLUMNS))
        if unknown:
            raise ValueError(f"unknown columns {unknown}; known: {list(COLUMNS)}")
        self.folder = options["path"]
        self.rows = options.get("rows")
        if self.rows not in (None, "features", "labels"):
            raise ValueError(f"rows: features or labels, not {self.rows!r}")
        self.task_bytes = int(options.get("task_bytes", 16 << 20))

    def partitions(self) -> list[Records]:
        system, folder = located(self.folder)
        files = sorted((f for f in system.get_file_info(fs.FileSelector(folder)) if f.is_file and "idx" in f.base_name.lower() and f.base_name[0] not in "._"), key=lambda f: f.base_name)
        out, done = [], {}
        for f in files:
            with system.open_input_file(f.path) as raw:
                packed = raw.read(2) == b"\x1f\x8b"
                raw.seek(0)
                head = Head.of(gzip.GzipFile(fileobj=raw) if packed else raw, f.base_name)
            n, labels = head.shape[0], len(head.shape) == 1
            if not packed and f.size != head.size + n * head.record:
                raise ValueError(f"{f.base_name}: the payload's length is not what the head says")
            if self.rows and labels != (self.rows == "labels"):
                continue
            part = 0 if "train" in f.base_name.lower() else 1
            before = done.get((part, labels), 0)
            done[part, labels] = before + n
            step = n if packed else max(1, self.task_bytes // max(1, head.record))
            out += [Records(f.path, head, packed, part, at, min(step, n - at), before + at) for at in range(0, n, max(1, step))]
        return out

    def read(self, part: Records | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # what Spark hands on for a folder without files
            return
        head = part.head
        labels = len(head.shape) == 1
        wanted = ("label" if labels else "features") in self.names
        step = max(1, CHUNK // max(1, head.record))
        if not wanted:
            for at in range(0, part.rows, 1 << 16):
                yield self._batch(part, at, min(1 << 16, part.rows - at), None)
            return
        system, _ = located(self.folder)
        with system.open_input_file(part.path) as raw:
            stream = gzip.GzipFile(fileobj=raw) if part.packed else raw
            if part.packed:
                Head.of(stream, part.path)
            else:
                raw.seek(head.size + part.first * head.record)
            for at in range(0, part.rows, step):
                rows = min(step, part.rows - at)
                content = stream.read(rows * head.record)
                if len(content) != rows * head.record:
                    raise ValueError(f"{part.path}: the payload's length is not what the head says")
                yield self._batch(part, at, rows, np.frombuffer(content, dtype=head.kind))
            if part.packed and stream.read(1):
                raise ValueError(f"{part.path}: the payload's length is not what the head says")

    def _batch(self, part: Records, at: int, rows: int, values: np.ndarray | None) -> pa.RecordBatch:
        columns = {name: pa.nulls(rows, kind) for name, kind in COLUMNS.items()}
        columns["part"] = pa.array(np.full(rows, part.part, dtype=np.int32))
        columns["place"] = pa.array(np.arange(part.place + at, part.place + at + rows))
        if values is not None and len(part.head.shape) == 1:
            columns["label"] = pa.array(values.astype(np.int32))
        elif values is not None:
            ends = pa.array(np.arange(rows + 1, dtype=np.int32) * part.head.width)
            columns["features"] = pa.ListArray.from_arrays(ends, pa.array(values.astype(np.float64)))
        return pa.RecordBatch.from_arrays([columns[n] for n in self.names], names=self.names)


@dataclass
class Staged(WriterCommitMessage):
    """(staged features, staged labels) of each pair of files, in the task's order."""

    task: int
    pairs: list[tuple[str, str]]


class IdxWriter(DataSourceArrowWriter):
    def __init__(self, schema, options):
        missing = {"features", "label"} - set(schema.fieldNames())
        if missing:
            raise ValueError(f"missing columns {sorted(missing)}")
        self.folder = options["path"].rstrip("/")
        self.split = options.get("split", "train")
        self.file_bytes = int(options.get("file_bytes", 64 << 20))
        self.run = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        from pyspark import TaskContext

        system, folder = located(self.folder)
        stage = f"{folder}/_staged-{self.run}"
        system.create_dir(stage, recursive=True)
        pairs, waiting, labels, width, held = [], [], [], None, 0

        def put(head: Head, parts: list[np.ndarray]) -> str:
            path = f"{stage}/{uuid.uuid4().hex}"
            with system.open_output_stream(path) as out:
                out.write(head.bytes())
                for p in parts:
                    out.write(p.astype(head.kind).tobytes())
            return path

        def close():
            n = sum(len(x) for x in labels)
            pairs.append((put(Head(KINDS[14], (n, width)), waiting), put(Head(KINDS[12], (n,)), labels)))

        for batch in iterator:
            features, label = batch.column("features"), batch.column("label")
            if not batch.num_rows:
                continue
            if features.null_count or label.null_count or features.flatten().null_count:
                raise ValueError("records and labels must not be null")
            sizes = set(features.value_lengths().to_pylist())
            width = width if width is not None else next(iter(sizes))
            if sizes != {width}:
                raise ValueError(f"records of different lengths: {sorted(sizes | {width})}")
            waiting.append(features.flatten().to_numpy(zero_copy_only=False))
            labels.append(label.to_numpy(zero_copy_only=False))
            held += waiting[-1].nbytes
            if held >= self.file_bytes:
                close()
                waiting, labels, held = [], [], 0
        if waiting:
            close()
        return Staged(TaskContext.get().partitionId(), pairs)

    def commit(self, messages: list[Staged | None]) -> None:
        system, folder = located(self.folder)
        place = 0
        for m in sorted((m for m in messages if m), key=lambda m: m.task):
            for pair in m.pairs:
                for path, sort in zip(pair, ("images-idx2", "labels-idx1"), strict=True):
                    system.move(path, f"{folder}/{self.split}-{self.run}-{place:08d}-{sort}")
                place += 1
        self.abort([])

    def abort(self, messages: list[Staged | None]) -> None:
        system, folder = located(self.folder)
        stage = f"{folder}/_staged-{self.run}"
        if system.get_file_info(stage).type != fs.FileType.NotFound:
            system.delete_dir(stage)


class IdxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "idx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> IdxReader:
        return IdxReader(schema, self.options)

    def writer(self, schema, overwrite: bool) -> IdxWriter:
        if overwrite:
            raise ValueError("files are only added; use mode append")
        return IdxWriter(schema, self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(IdxSource)
