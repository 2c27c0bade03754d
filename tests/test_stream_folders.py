"""Streams over tables that are folders of part files in no order of time, in one and in several micro-batches."""

import os

import pytest
from pyspark.sql import functions as F

from tests.compare import diff, duck
from tests.conftest import SF_DIR, rows
from tidegate.plans import load_all, streams
from tidegate.registry import ORACLES, QUERIES
from tidegate.views import Tables

PARTS = 6
NAMES = [
    "src_stream_file", "nexmark_q5_stream", "win_session_stream", "join_ttl_latest_stream", "state_timer", "wm_callback", "stream_eos",
    "task_process_stream", "nexmark_q8_stream", "sql_stream_insert", "sql_stream_insert_twice",
]


@pytest.fixture(scope="module")
def folder_tables(spark, tables, tmp_path_factory):
    load_all()
    path = str(tmp_path_factory.mktemp("run-folders"))
    for name in os.listdir(SF_DIR):
        if name not in ("events.parquet", "lineitem.parquet"):
            os.symlink(f"{SF_DIR}/{name}", f"{path}/{name}")
    tables.events.repartition(PARTS, "event_id").write.parquet(f"{path}/events.parquet")
    tables.lineitem.repartition(PARTS, "l_orderkey").write.parquet(f"{path}/lineitem.parquet")
    return path


@pytest.mark.parametrize("name", NAMES)
def test_several_batches(spark, folder_tables, monkeypatch, name):
    monkeypatch.setattr(streams, "FILES_PER_BATCH", 2)
    assert diff(spark, duck(SF_DIR), folder_tables, QUERIES[name], ORACLES[name]) == ""


def test_one_batch(spark, folder_tables):
    name = "nexmark_q5_stream"
    assert diff(spark, duck(SF_DIR), folder_tables, QUERIES[name], ORACLES[name]) == ""


def test_order_matching(spark, folder_tables, monkeypatch):
    monkeypatch.setattr(streams, "FILES_PER_BATCH", 2)
    columns = ["security", "buy_order", "sell_order", "cents", "volume"]
    got = rows(QUERIES["stock_match_stream"](spark, folder_tables), *columns)
    assert got and got == rows(QUERIES["stock_match"](spark, SF_DIR), *columns)


def test_batches_follow_time(spark, folder_tables, monkeypatch):
    monkeypatch.setattr(streams, "FILES_PER_BATCH", 2)
    seen = []
    arrivals = streams.stream(Tables(spark, folder_tables))
    sink = lambda batch, number: seen.append(batch.agg(F.min("ts"), F.max("ts"), F.count("*")).first())
    arrivals.writeStream.foreachBatch(sink).trigger(availableNow=True).start().awaitTermination()
    seen = [tuple(s) for s in seen if s[2]]
    assert len(seen) == PARTS / 2 and all(a[1] <= b[0] for a, b in zip(seen, seen[1:]))
    assert sum(s[2] for s in seen) == spark.read.parquet(f"{SF_DIR}/events.parquet").count()
