"""Broadcast to every partition, functions with a life, streams of lines, splits and pairs of bytes."""

import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_DIR, rows
from tidegate.operators import dataflow
from tidegate.plans import io, load_all
from tidegate.registry import QUERIES
from tidegate.sinks import writers
from tidegate.sources import readers
from tidegate.streaming.harness import run_append


def test_broadcast_reaches_every_partition(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "id int, v string")
    got = dataflow.broadcast_all(df, 5).withColumn("task", F.spark_partition_id())
    assert rows(got, "task", "id") == sorted((t, i) for t in range(5) for i in (1, 2, 2))
    assert got.filter("task <> part").count() == 0
    assert dataflow.broadcast_all(df.limit(0), 5).count() == 0
    with pytest.raises(ValueError):
        dataflow.broadcast_all(spark.range(11), 2, most_rows=10)
    assert dataflow.broadcast_all(spark.range(10), 2, most_rows=10).count() == 20


def test_broadcast_of_many_messages(spark):
    got = dataflow.broadcast_all(spark.range(1_000_001), 3).groupBy(F.spark_partition_id()).agg(F.count("*"), F.max("id"))
    assert rows(got) == [(i, 1_000_001, 1_000_000) for i in range(3)]


def test_files_of_lines_are_bounded(spark, monkeypatch):
    """The larger the table, the more files a stream of its lines has; no task writes or reads a fourth of it."""
    load_all()
    seen = []
    read = readers.text_stream
    monkeypatch.setattr(io.readers, "text_stream", lambda spark, path, *a: seen.append(path) or read(spark, path, *a))
    monkeypatch.setattr(io, "LINES_FILE_BYTES", 60_000)
    got = rows(QUERIES["src_stream_text"](spark, SF_DIR))
    sizes = [f.stat().st_size for f in os.scandir(seen[0]) if f.name.startswith("part-")]
    assert len(sizes) == max(4, -(-spark.read.parquet(f"{SF_DIR}/documents.parquet").agg(F.sum(F.octet_length("text"))).first()[0] // 60_000))
    lines = spark.read.parquet(f"{SF_DIR}/documents.parquet").select(F.explode(F.split("text", "\n")).alias("line"))
    assert got == rows(lines.groupBy("line").count())


def test_functions_are_closed_also_on_failure(spark, folder):
    class Told:
        def __init__(self, part):
            self.part = part
            open(f"{folder}/opened-{part}", "w").close()

        def apply(self, batch):
            if self.part == 2 and folder.endswith("x"):
                raise ValueError("this task fails")
            return pa.RecordBatch.from_arrays([batch.column(0)], ["id"])

        def close(self):
            open(f"{folder}/closed-{self.part}", "w").close()

    assert dataflow.map_with_lifecycle(spark.range(0, 100, 1, 4), Told, "id bigint").count() == 100
    assert sorted(os.listdir(folder)) == sorted(f"{x}-{p}" for x in ("opened", "closed") for p in range(4))
    folder = folder + "-x"
    os.mkdir(folder)
    with pytest.raises(Exception, match="this task fails"):
        dataflow.map_with_lifecycle(spark.range(0, 100, 1, 4), Told, "id bigint").count()
    assert {"opened-2", "closed-2"} <= set(os.listdir(folder))


def test_lines_as_a_stream(spark, folder):
    for i in range(3):
        spark.createDataFrame([(f"line {i} {j}",) for j in range(2)], "value string").coalesce(1).write.text(f"{folder}/in/{i}")
    first = run_append(readers.text_stream(spark, f"{folder}/in", 1), f"{folder}/out", f"{folder}/checkpoint")
    assert rows(first) == [(f"line {i} {j}",) for i in range(3) for j in range(2)]
    spark.createDataFrame([("", ), ("new",)], "value string").coalesce(1).write.text(f"{folder}/in/9")
    again = run_append(readers.text_stream(spark, f"{folder}/in", 1), f"{folder}/out", f"{folder}/checkpoint")
    assert again.count() == 8


def test_fixed_length_and_pairs_of_bytes(spark, folder):
    with open(f"{folder}/records", "wb") as f:
        f.write(bytes(range(256)) * 3)
    got = readers.fixed_length(spark, f"{folder}/records", 16)
    assert got.columns == ["record"] and got.count() == 48
    assert sorted(bytes(r.record) for r in got.collect())[0] == bytes(range(16))
    df = spark.createDataFrame([(bytearray(b"\x00\xff"), "é"), (None, None)], "k binary, v string")
    writers.binary_sequence_file(df, f"{folder}/pairs", "k", "v")
    back = readers.sequence_file(spark, f"{folder}/pairs", "k binary, v binary")
    assert sorted((bytes(r.k), bytes(r.v)) for r in back.collect()) == [(b"", b""), (b"\x00\xff", "é".encode())]


def test_splits_are_told_in_one_scan(spark):
    df = spark.createDataFrame([(i,) for i in range(100)] + [(None,)], "id int")
    predicates = readers.range_predicates("id", 0, 99, 4, has_nulls=True)
    got = readers.tagged_splits(df, predicates)
    assert got.groupBy("split").count().count() == len(predicates) and got.filter("id IS NULL AND split = 5").count() <= 1
    assert got.count() == 101
    with pytest.raises(Exception, match="splits of a row"):
        readers.tagged_splits(df, ["id < 60", "id > 50"]).collect()
