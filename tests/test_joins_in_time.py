"""Products per key, completion over epochs and cached reads against plain Python; the stream forms over several micro-batches."""

import collections
import itertools
import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tidegate.operators import joins
from tidegate.sources.readers import file_stream
from tidegate.streaming import processors as ps
from tidegate.streaming.harness import run_append, state_store

S = 1_000_000


def bags(spark, sizes):
    """sizes = {tag: {key: rows}}; every third row repeats the one before."""
    out = {}
    for tag, keys in sizes.items():
        made = [(k, f"{tag}{k}-{i - (i % 3 == 2)}") for k, n in keys.items() for i in range(n)]
        out[tag] = made, spark.createDataFrame(made, "k int, v string").repartition(3)
    return out


def combine(of):
    a, b, c = (F.coalesce(of[t]["v"], F.lit("-")) for t in "abc")
    return F.when(F.length(a) != 5, F.concat_ws("|", a, b, c))


def product(made):
    keys = {k for rows_, _ in made.values() for k, _ in rows_ if k is not None}
    out = []
    for k in keys:
        of = [[v for x, v in rows_ if x == k] for rows_, _ in made.values()]
        if sum(map(bool, of)) >= 2:
            for a, b, c in itertools.product(*[x or ["-"] for x in of]):
                if len(a) != 5:
                    out.append((k, sum(map(bool, of)), f"{a}|{b}|{c}"))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bag_rows", [None, 40, 7, 1])
def test_product(spark, bag_rows):
    made = bags(spark, {"a": {1: 60, 2: 1, 3: 2, 5: 30}, "b": {1: 25, 2: 3, 4: 9}, "c": {1: 1, 2: 2, 3: 1, 4: 0, 6: 50, None: 9}})
    got = joins.tagged_product({t: df for t, (_, df) in made.items()}, "k", combine, bag_rows=bag_rows)
    assert rows(got) == product(made)


def test_product_of_a_large_bag(spark):
    """10,000 rows under one tag of one key: cut, and no task joins more than a block."""
    made = bags(spark, {"a": {1: 10_000, 2: 2}, "b": {1: 3, 2: 1}, "c": {1: 2}})
    got = joins.tagged_product({t: df for t, (_, df) in made.items()}, "k", combine, bag_rows=500)
    assert got.count() == len(product(made))
    left = joins.tagged_product({t: df.limit(0) for t, (_, df) in made.items()}, "k", combine)
    assert left.count() == 0


def epochs_plainly(messages, expected):
    """(key, epoch, status, parts, at) of messages (key, epoch, part, ts, id) in order of arrival."""
    out, open_ = [], {}
    for key, epoch, part, ts, _ in sorted(messages, key=lambda m: (m[3], m[4])):
        now = open_.get(key)
        if now and epoch < now[0]:
            continue
        if not now or epoch > now[0]:
            if now and len(now[1]) < expected:
                out.append((key, now[0], "INCOMPLETE", len(now[1]), ts))
            now = open_[key] = (epoch, set())
        if len(now[1]) < expected and part not in now[1]:
            now[1].add(part)
            if len(now[1]) == expected:
                out.append((key, epoch, "COMPLETED", expected, ts))
    return sorted(out, key=repr)


def epoch_messages(n=600):
    draw = random.Random(8)
    return [(draw.randrange(4), max(0, i // 40 + draw.choice([-2, -1, 0, 0, 0, 1])), draw.choice("abcde"), (100 + i // 2) * S, i) for i in range(n)]


EPOCH_ROW = "key bigint, epoch bigint, part string, ts bigint, id bigint"


@pytest.mark.parametrize("expected", [1, 3, 5])
def test_epochs(spark, expected):
    made = epoch_messages()
    df = spark.createDataFrame(made, EPOCH_ROW).repartition(5)
    got = joins.completion_epochs(df, "key", "epoch", "part", ["ts", "id"], "ts", expected)
    assert rows(got) == epochs_plainly(made, expected)
    assert joins.completion_epochs(df.limit(0), "key", "epoch", "part", ["ts", "id"], "ts", expected).count() == 0


def test_epochs_stream(spark, folder):
    made = epoch_messages()
    for i in range(4):
        part = [(*m, None) for m in made[i * 150 : (i + 1) * 150]]
        spark.createDataFrame(part, EPOCH_ROW + ", x int").drop("x").withColumn("at", F.timestamp_micros("ts")).coalesce(1).write.parquet(f"{folder}/p={i}")
    schema = spark.read.parquet(f"{folder}/p=0").schema
    arrivals = file_stream(spark, f"{folder}/p=*", schema, files_per_batch=1).withWatermark("at", "1 hour")
    with state_store(spark):
        machine = ps.CompletionEpochs(3, idle_us=86_400 * S)
        got = run_append(ps.stateful(arrivals, ["key"], machine, machine.SCHEMA, timers=True))
    assert rows(got) == epochs_plainly(made, 3)


def test_finished_epochs_leave_no_state(spark, folder):
    """A complete epoch's state ends with its idle time: the key begins anew with an older epoch."""
    first = [(1, 5, "a", 100 * S, 1), (1, 5, "b", 101 * S, 2), (2, 5, "a", 100 * S, 3)]
    far = [(9, 1, "a", 9_000 * S, 4)]
    again = [(1, 3, "a", 10_000 * S, 5), (1, 3, "b", 10_000 * S, 6), (2, 3, "b", 10_000 * S, 7), (2, 6, "b", 10_001 * S, 8)]
    for i, part in enumerate([first, far, [(9, 1, "a", 9_001 * S, 9)], again]):
        spark.createDataFrame(part, EPOCH_ROW).withColumn("at", F.timestamp_micros("ts")).coalesce(1).write.parquet(f"{folder}/p={i}")
    schema = spark.read.parquet(f"{folder}/p=0").schema
    arrivals = file_stream(spark, f"{folder}/p=*", schema, files_per_batch=1).withWatermark("at", "10 seconds")
    with state_store(spark):
        machine = ps.CompletionEpochs(2, idle_us=1_000 * S)
        got = run_append(ps.stateful(arrivals, ["key"], machine, machine.SCHEMA, timers=True))
    # Key 2 was not complete, so it still ignores epoch 3 and tells of epoch 5.
    assert rows(got) == sorted([(1, 5, "COMPLETED", 2, 101 * S), (1, 3, "COMPLETED", 2, 10_000 * S), (2, 5, "INCOMPLETE", 1, 10_001 * S)], key=repr)


def cache_plainly(reads, writes, write_ttl, read_ttl, write_around):
    out, table, entry = [], {}, {}
    events = sorted([(t, 0, i, k, v) for k, t, i, v in writes] + [(t, 1, i, k, None) for k, t, i in reads], key=lambda e: e[:3])
    for t, read, i, k, v in events:
        value, since, used = entry.get(k, (None, None, None))
        if since is not None and (t >= since + write_ttl or t >= used + read_ttl):
            value = since = None
        if not read:
            table[k] = v
            if not write_around:
                value, since = v, t
        else:
            hit = since is not None
            if not hit and table.get(k) is not None:
                value, since = table[k], t
            out.append((k, t, i, value, hit, since))
        entry[k] = value, since, t if read or not write_around else used
    return sorted(out, key=repr)


@pytest.mark.parametrize("write_around", [True, False])
@pytest.mark.parametrize("ttls", [(5, 3), (3, 100), (100, 2), (1, 1)])
def test_cached_reads(small_tasks, write_around, ttls):
    draw, spark = random.Random(3), small_tasks
    ids = iter(range(10_000))
    reads = [(draw.choice([1, 1, 1, 2, 3]), draw.randrange(80) * S, next(ids)) for _ in range(300)]
    writes = [(draw.choice([1, 2]), draw.randrange(20, 80) * S, next(ids), draw.randrange(100)) for _ in range(60)]
    r = spark.createDataFrame(reads, "k int, t bigint, id bigint").select("k", F.timestamp_micros("t").alias("ts"), "id")
    w = spark.createDataFrame(writes, "k int, t bigint, id bigint, v int").select("k", F.timestamp_micros("t").alias("ts"), "id", "v")
    got = joins.cached_reads(r, w, "k", "ts", "id", "v", *ttls, write_around)
    want = cache_plainly(reads, writes, ttls[0] * S, ttls[1] * S, write_around)
    assert rows(got) == want
    assert 0 < sum(x[4] for x in want) < len(want)
    assert joins.cached_reads(r.limit(0), w, "k", "ts", "id", "v", 1, 1).count() == 0
    counts = collections.Counter(x[3] is None for x in want)
    assert counts[True] and counts[False]


@pytest.mark.parametrize("how", ["inner", "right_outer", "left_outer"])
def test_interval_join_stream_meets_near_rows_only(spark, folder, how):
    """One hot key: rows are joined on time buckets too, and those at the edges of an interval are not lost."""
    draw = random.Random(4)
    ticks = [0, 599, 600, 601, 1200, 1800, -600, -601, *(draw.randrange(20_000) for _ in range(150))]
    made = {side: [(1 if i % 9 else None, (120_000 + t) * S + d, i) for i, t in enumerate(ticks)] for side, d in (("l", 0), ("r", 7))}
    streams = {}
    for side, messages in made.items():
        df = spark.createDataFrame([(k, t, i) for k, t, i in messages], "k bigint, t bigint, i bigint")
        df.select(F.col("k").alias(f"{side}k"), F.timestamp_micros("t").alias(f"{side}t"), F.col("i").alias(f"{side}i")).write.parquet(f"{folder}/{side}")
        schema = spark.read.parquet(f"{folder}/{side}").schema
        streams[side] = file_stream(spark, f"{folder}/{side}", schema).withWatermark(f"{side}t", "1 day")
    joined = joins.interval_join_stream(streams["l"], streams["r"], F.expr("lk = rk"), "lt", "rt", "10 MINUTES", how)
    assert joined.columns == ["lk", "lt", "li", "rk", "rt", "ri"]
    plan = joined._jdf.queryExecution().analyzed().toString()
    assert ("_lb" in plan) == (how != "left_outer")
    got = run_append(joined).filter("li IS NOT NULL AND ri IS NOT NULL")
    want = [(i, j) for k, t, i in made["l"] for m, u, j in made["r"] if k and m and t - 600 * S <= u <= t + 600 * S]
    assert rows(got, "li", "ri") == sorted(want, key=repr)
