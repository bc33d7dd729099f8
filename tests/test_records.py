"""Files of fixed-length records: read in pieces, written in pieces, whole after each way."""

import os

import numpy as np
import pytest

from clusterloom.sources import idx
from clusterloom.sources import points as sources


def raw(n, width, kind=13):
    head = idx.Head(idx.KINDS[kind], (n, width))
    values = np.arange(n * width, dtype=float).reshape(n, width) / 4
    return head.bytes() + values.astype(head.kind).tobytes(), values


def test_one_file_is_many_tasks(spark, tmp_path):
    content, values = raw(1000, 8)
    (tmp_path / "train-a-idx2").write_bytes(content)
    idx.register(spark)
    reader = spark.read.format("idx").option("task_bytes", 1000)
    rows = reader.load(str(tmp_path))
    assert rows.rdd.getNumPartitions() == 33  # 31 records of 32 bytes each
    got = {r.place: r.features for r in rows.collect()}
    assert len(got) == 1000 and all(np.array_equal(got[i], values[i]) for i in range(1000))
    assert reader.schema("place bigint").load(str(tmp_path)).count() == 1000
    with pytest.raises(Exception, match="unknown columns"):
        reader.schema("other int").load(str(tmp_path)).count()


def test_files_of_a_part_follow_each_other(spark, tmp_path):
    for name, n in (("train-1-idx2", 5), ("train-2-idx2", 3), ("t10k-idx2", 2)):
        (tmp_path / name).write_bytes(raw(n, 4)[0])
        labels = idx.Head(idx.KINDS[12], (n,)).bytes() + np.full(n, n, dtype=">i4").tobytes()
        (tmp_path / name.replace("idx2", "labels-idx1")).write_bytes(labels)
    rows = sources.read_idx(spark, str(tmp_path), scale=False, task_bytes=40).orderBy("sample_id").collect()
    assert [r.label for r in rows] == [5] * 5 + [3] * 3 + [2] * 2 and [r.sample_id for r in rows] == list(range(10))


def test_what_is_written_is_read(spark, tmp_path):
    folder = str(tmp_path / "out")
    points = spark.range(500).selectExpr("array(double(id), id / 3.0D) AS features", "int(id % 7) AS label").repartition(5)
    sources.write_idx(points, folder, file_bytes=800)
    sources.write_idx(points.limit(10), folder, split="t10k")
    names = os.listdir(folder)
    assert not any(n.startswith("_") for n in names) and len(names) > 10
    rows = sources.read_idx(spark, folder, scale=False).collect()
    assert len(rows) == 510 and sorted(r.sample_id for r in rows) == list(range(510))
    assert all(r.label == r.features[0] % 7 and r.features[1] == r.features[0] / 3 for r in rows)
    assert {r.features[0] for r in rows} == set(range(500))


def test_odd_files_and_rows(spark, tmp_path):
    folder = str(tmp_path / "empty")
    sources.write_idx(spark.createDataFrame([], "features array<double>, label int"), folder)
    os.makedirs(folder, exist_ok=True)
    assert sources.read_idx(spark, folder, scale=False).count() == 0
    for rows in ([(None, 1)], [([1.0], None)], [([1.0, None], 1)], [([1.0], 1), ([1.0, 2.0], 1)]):
        with pytest.raises(Exception, match="null|lengths"):
            sources.write_idx(spark.createDataFrame(rows, "features array<double>, label int").coalesce(1), folder)
    assert not [n for n in os.listdir(folder) if not n.startswith("_")]
    for content in (b"\0\0\x08", raw(5, 4)[0][:-1], b"abcdefgh"):
        bad = tmp_path / f"bad{len(content)}"
        bad.mkdir()
        (bad / "train-idx2").write_bytes(content)
        with pytest.raises(Exception, match="head|length"):
            sources.read_idx(spark, str(bad)).count()
