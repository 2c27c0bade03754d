"""State over several micro-batches and over a restart: the stream's result is the batch's."""

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.conftest import rows
from tidegate.apps import stock
from tidegate.operators import joins, windows
from tidegate.operators.ordered import micros, running
from tidegate.sources.readers import file_stream
from tidegate.streaming import processors as ps
from tidegate.streaming.harness import run_append, run_update, state_store

PARTS = 4


@pytest.fixture(scope="module")
def split_events(spark, tables, tmp_path_factory):
    """The events as several files in time order."""
    path = str(tmp_path_factory.mktemp("run-split"))
    events = tables.events.withColumn("part", F.ntile(PARTS).over(Window.orderBy("ts")))
    for i in range(1, PARTS + 1):
        events.filter(F.col("part") == i).drop("part").coalesce(1).write.parquet(f"{path}/p={i}")
    return path


def stream(spark, path, parts="*"):
    schema = spark.read.parquet(f"{path}/p=1").schema
    return file_stream(spark, f"{path}/p={parts}", schema, files_per_batch=1)


def page(df):
    return df.withColumn("page", F.get_json_object("props", "$.k").cast("bigint"))


def test_tumbling_counts(spark, tables, split_events):
    def counts(df):
        return windows.tumbling(df, "ts", "1 day", ["user_id"], {"n": F.count(F.lit(1))}).drop("window_end")

    got = run_update(counts(stream(spark, split_events)), ["window_start", "user_id"])
    assert rows(got, "window_start", "user_id", "n") == rows(counts(tables.events), "window_start", "user_id", "n")


@pytest.mark.parametrize("timers", [False, True])
def test_ttl_join(spark, tables, split_events, timers):
    side = F.when(F.col("event_type") == "view", 0).when(F.col("event_type") == "click", 1)
    arrivals = page(stream(spark, split_events).withWatermark("ts", "1 hour")).select(
        F.col("page").alias("key"), F.unix_micros("ts").alias("ts"), side.alias("side"), F.col("event_id").alias("id"), F.col("ts").alias("at")
    )
    with state_store(spark):
        join = ps.LatestTtlJoin(86_400_000_000, timers)
        got = run_append(ps.stateful(arrivals.filter("side IS NOT NULL"), ["key"], join, ps.LatestTtlJoin.SCHEMA, timers))
    batch = joins.latest_ttl_join(tables.page_view, tables.ad_click, "page_id", "ts", "event_id", 86_400)
    want = batch.select("page_id", F.unix_micros("ts"), "l.event_id", "r.event_id")
    assert rows(got) == rows(want)


def test_early_panes(spark, tables, split_events):
    views = stream(spark, split_events).filter("event_type = 'view'").withWatermark("ts", "1 hour")
    start = F.unix_micros(F.date_trunc("day", "ts")).alias("window_start")
    keyed = views.select((F.col("user_id") % 5).alias("key"), start, "ts")
    with state_store(spark):
        got = run_append(ps.stateful(keyed, ["key", "window_start"], ps.CountPanes(2, 86_400_000, False), ps.CountPanes.SCHEMA, timers=True))
    batch = tables.page_view.withColumn("key", F.col("user_id") % 5)
    want = windows.early_panes(batch, ["key"], "ts", "1 day", 2, False)
    want = want.withColumn("window_start", F.unix_micros("window_start")).select(*got.columns)
    early = F.col("firing_type") == "EARLY"
    assert rows(got.filter(early)) == rows(want.filter(early))
    # The pane of a window the watermark has not passed is still open.
    assert set(rows(got.filter(~early))) <= set(rows(want.filter(~early)))
    assert got.filter(~early).count() > 0


def test_timer_sessions(spark, tables, split_events):
    quiet = stream(spark, split_events).withWatermark("ts", "1 hour").select(
        (F.col("user_id") % 5).alias("key"), F.unix_micros("ts").alias("ts"), F.col("ts").alias("at")
    )
    with state_store(spark):
        got = run_append(ps.stateful(quiet, ["key"], ps.QuietTimer(3_600_000_000 * 6), ps.QuietTimer.SCHEMA, timers=True))
    batch = windows.sessions(tables.events.withColumn("key", F.col("user_id") % 5), "ts", 6 * 3600, ["key"], {"n": ("count", "ts")})
    want = batch.select("key", F.unix_micros("session_start"), F.unix_micros("session_end"), "n")
    closed = set(rows(got))
    assert closed <= set(rows(want)) and len(closed) >= want.count() - 5


def test_running_totals_over_a_restart(spark, tables, split_events, folder):
    def run(parts):
        arrivals = stream(spark, split_events, parts).select(
            F.col("user_id").alias("key"), F.unix_micros("ts").alias("ts"), F.col("event_id").alias("id"),
            F.round(F.col("value") * 100).cast("bigint").alias("v"),
        )
        with state_store(spark):
            out = ps.stateful(arrivals, ["key"], ps.RunningTotals(), ps.RunningTotals.SCHEMA)
            return run_append(out, f"{folder}/out", f"{folder}/checkpoint")

    first = run("[1-2]").count()
    got = run("*")
    assert 0 < first < got.count()
    cents = tables.events.withColumn("v", F.round(F.col("value") * 100).cast("bigint"))
    want = running(cents, ["user_id"], ["ts", "event_id"], micros("ts"), {"seen": ("count", "v"), "top": ("max", "v")})
    assert rows(got, "id", "key", "seen", "top") == rows(want, "event_id", "user_id", "seen", "top")


@pytest.mark.parametrize("ending", [False, True])
def test_matching_over_batches(spark, tables, folder, ending):
    orders = tables.stock_order.withColumn("session", stock.session_of(F.col("ts"), "year"))
    if ending:  # state ends with its session, as the watermark passes the year's end
        orders = orders.withColumn("until", stock.session_end(F.col("ts"), "year")).withColumn("at", F.col("ts"))
    schema = orders.withColumn("ts", F.unix_micros("ts")).schema
    parts = orders.withColumn("part", F.ntile(4).over(Window.orderBy("ts")))
    for i in range(4):
        parts.filter(F.col("part") == i + 1).drop("part").withColumn("ts", F.unix_micros("ts")).coalesce(1).write.parquet(f"{folder}/in/p={i}")
    arrivals = file_stream(spark, f"{folder}/in/*", schema, files_per_batch=1)
    arrivals = arrivals.withWatermark("at", "1 day") if ending else arrivals
    with state_store(spark):
        got = run_append(ps.stateful(arrivals, ["security", "session"], ps.MatchOrders(), ps.MatchOrders.SCHEMA, timers=ending))
    assert rows(got) == rows(stock.match_orders(tables.stock_order, "year"))


def test_watermark_holds_rows_back(spark, tables, split_events):
    held = stream(spark, split_events).withWatermark("ts", "2 days").select(
        F.col("user_id").alias("key"), F.unix_micros("ts").alias("ts"), F.col("event_id").alias("id"), F.col("ts").alias("at")
    )
    with state_store(spark):
        got = run_append(ps.stateful(held, ["key"], ps.WatermarkCallback(), ps.WatermarkCallback.SCHEMA, timers=True))
    last = tables.events.agg(F.max("ts").alias("m")).select(F.col("m") - F.expr("INTERVAL 2 DAYS")).first()[0]
    want = tables.events.filter(F.col("ts") < F.lit(last)).select("user_id", F.unix_micros("ts"), "event_id")
    assert rows(got, "key", "ts", "id") == rows(want)
    order = got.groupBy("key").agg(F.count_distinct("place").alias("d"), F.max("place").alias("m"), F.count(F.lit(1)).alias("n"))
    assert order.filter("d <> n OR m <> n").count() == 0


def test_a_timer_reads_its_own_bucket():
    """Stand-ins for the state: a timer reads no other bucket, and a message no other than its own."""

    class Held(dict):
        def __init__(self):
            self.read = []

        def getValue(self, k):
            self.read.append(k[0])
            return self[k]

        def containsKey(self, k):
            return k in self

        def updateValue(self, k, v):
            self[k] = v

        def removeKey(self, k):
            del self[k]

    class Handle:
        timers: set = set()

        def registerTimer(self, t):
            self.timers.add(t)

        def deleteTimer(self, t):
            self.timers.remove(t)

    class Place:
        n = None

        def exists(self):
            return self.n is not None

        def get(self):
            return self.n

        def update(self, v):
            self.n = v

    class At:
        def __init__(self, t):
            self.t = t

        def getCurrentWatermarkInMs(self):
            return self.t

        getExpiryTimeInMs = getCurrentWatermarkInMs

    callback = ps.WatermarkCallback(bucket_ms=10)
    callback.handle, callback.held, callback.place = Handle(), Held(), Place()
    sent = [(i * 1000 + 7, i) for i in range(100)]  # 100 ms, ten buckets
    for batch in (sent[50:], sent[:50][::-1]):
        list(callback.handleInputRows((1,), [pd.DataFrame(batch, columns=["ts", "id"])], None))
    assert callback.handle.timers == {i * 10 + 1 for i in range(10)}
    callback.held.read.clear()
    got = []
    for t in (1, 11, 21):  # the watermark is at 25 ms: two buckets have passed, and half of the third
        callback.handle.timers.remove(t)
        got += pd.concat(callback.handleExpiredTimer((1,), At(25), At(t))).to_numpy().tolist()
    assert [(g[1], g[2], g[3]) for g in got] == [(ts, i, i + 1) for ts, i in sent[:25]]
    assert callback.held.read == [0, 1, 2] and 26 in callback.handle.timers
    callback.held.read.clear()
    list(callback.handleInputRows((1,), [pd.DataFrame([(55_000, 500)], columns=["ts", "id"])], None))
    assert callback.held.read == [5]


def test_completion(spark, tables, split_events):
    month = F.date_trunc("month", "ts")
    parts = stream(spark, split_events).select(
        (F.col("user_id") % 9).alias("key"), F.unix_micros(month).alias("epoch"), F.col("event_type").alias("part"),
        F.unix_micros("ts").alias("ts"),
    )
    with state_store(spark):
        got = run_append(ps.stateful(parts, ["key", "epoch"], ps.JoinCompletion(5), ps.JoinCompletion.SCHEMA))
    batch = tables.events.select((F.col("user_id") % 9).alias("key"), month.alias("epoch"), F.col("event_type").alias("part"), "ts")
    want = joins.completion_join(batch, "key", "epoch", "part", "ts", 5)
    assert rows(got) == rows(want, "key", F.unix_micros("epoch"), F.unix_micros("completed_at"))
    assert got.count() > 0
