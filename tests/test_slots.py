"""Processors that work on a slot of keys: calls into the state store do not grow with the keys."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tests.test_joins_in_time import EPOCH_ROW, epoch_messages, epochs_plainly
from tidegate.operators import triggers as tr
from tidegate.sources.readers import file_stream
from tidegate.streaming import processors as ps
from tidegate.streaming.harness import run_append, state_store

S = 1_000_000
DAY = 86_400 * S


class State(dict):
    """Stand-in for a value state (key None) or a map state, which counts the calls."""

    calls = 0

    def exists(self):
        return None in self

    def get(self):
        State.calls += 1
        return self[None]

    def update(self, v):
        State.calls += 1
        self[None] = v

    def containsKey(self, k):
        State.calls += 1
        return k in self

    def getValue(self, k):
        State.calls += 1
        return self[k]

    def updateValue(self, k, v):
        State.calls += 1
        self[k] = v

    def removeKey(self, k):
        State.calls += 1
        del self[k]


class Handle:
    def __init__(self):
        self.timers = set()

    def getValueState(self, *_):
        return State()

    getMapState = getValueState

    def registerTimer(self, t):
        State.calls += 1
        self.timers.add(t)

    def deleteTimer(self, t):
        State.calls += 1
        self.timers.remove(t)


class At:
    def __init__(self, t):
        self.t = t

    def getCurrentWatermarkInMs(self):
        return self.t

    getExpiryTimeInMs = getCurrentWatermarkInMs


def run(processor, frame):
    """Output of the rows in two micro-batches, and of all timers at the end; and the number of calls."""
    State.calls, handle, out = 0, Handle(), []
    processor.init(handle)
    half = len(frame) // 2
    for part in (frame[:half], frame[half:]):
        out += processor.handleInputRows((7,), iter([part]), None)
    while handle.timers:
        at = min(handle.timers)
        handle.timers.remove(at)
        out += processor.handleExpiredTimer((7,), At(10**12), At(at))
    return sorted(map(tuple, pd.concat([f for f in out if len(f)]).to_numpy().tolist()), key=repr), State.calls


def messages(keys):
    """Every key has messages at 1, 2 and 3 hours of two days, in order of time."""
    made = [(k, d * DAY + h * 3600 * S) for d in (1, 2) for h in (1, 2, 3) for k in range(keys)]
    frame = pd.DataFrame(made, columns=["key", "ts"])
    return frame.assign(window_start=frame["ts"] // DAY * DAY, id=range(len(frame)))


MADE = {
    "wm_callback": lambda: ps.WatermarkCallback(),
    "pageview_counter_stream": lambda: ps.CountPanes(2, 86_400_000, False),
    "win_session_early_stream": lambda: ps.TriggerSessions(tr.repeat(tr.count(2)), 6 * 3600 * S),
}


@pytest.mark.parametrize("name", MADE)
def test_calls_do_not_grow_with_keys(name):
    few, calls = run(MADE[name](), messages(5))
    many, as_many = run(MADE[name](), messages(3_000))
    assert as_many == calls and len(many) == 600 * len(few)
    per_key = sorted(r[1:] for r in few if r[0] == 0)
    if name == "wm_callback":
        assert [(r[0], r[2]) for r in per_key] == [(d * DAY + h * 3600 * S, (d - 1) * 3 + h) for d in (1, 2) for h in (1, 2, 3)]
    else:
        assert sorted((r[0] // DAY, r[2], r[-1]) for r in per_key) == [(d, kind, n) for d in (1, 2) for kind, n in (("DEFAULT", 1), ("EARLY", 2))]


def test_calls_do_not_grow_with_securities():
    def orders(securities):
        made = [(s, "", t, n, 1, 1, 100 + n, 10, "B" if n == 2 else "S") for n, t in ((0, 1), (1, 1), (2, 2)) for s in range(securities)]
        return pd.DataFrame(made, columns=["security", "session", "ts", "order_no", "line", "part_id", "cents", "volume", "side"])

    few, calls = run(ps.MatchOrders(), orders(4))
    many, as_many = run(ps.MatchOrders(), orders(3_000))
    assert as_many == calls and few == [(s, "", 2, 0, 100, 10) for s in range(4)] and len(many) == 3_000


def test_keys_of_a_slot_stay_apart(spark, folder, monkeypatch):
    """All keys in one slot, null ones too, over several micro-batches: as each key alone."""
    monkeypatch.setattr(ps, "SLOTS", 1)
    keys = [None, 0, 1, -5, 2**60 + 1]
    made = [(k, (100 + 10 * i + j) * S, 5 * i + j) for i in range(30) for j, k in enumerate(keys)]
    for i in range(3):
        part = spark.createDataFrame(made[50 * i : 50 * i + 50], "key bigint, ts bigint, id bigint")
        part.withColumn("at", F.timestamp_micros("ts")).coalesce(1).write.parquet(f"{folder}/p={i}")
    last = spark.createDataFrame([(99, 10**9 * S, -1)], "key bigint, ts bigint, id bigint").withColumn("at", F.timestamp_micros("ts"))
    last.write.parquet(f"{folder}/p=3")
    schema = last.schema

    def arrivals():
        return file_stream(spark, f"{folder}/p=*", schema, files_per_batch=1).withWatermark("at", "1 second")

    with state_store(spark):
        got = run_append(ps.stateful(arrivals(), ["key"], ps.WatermarkCallback(), ps.WatermarkCallback.SCHEMA, timers=True))
        windows = arrivals().withColumn("window_start", F.col("ts") - F.col("ts") % (100 * S))
        panes = ps.CountPanes(3, 100_000, True)
        counted = run_append(ps.stateful(windows, ["key", "window_start"], panes, panes.SCHEMA, timers=True))
        sessions = ps.TriggerSessions(tr.repeat(tr.count(4)), 20 * S)
        fired = run_append(ps.stateful(arrivals(), ["key"], sessions, sessions.SCHEMA, timers=True))
    assert rows(got.filter("id >= 0")) == sorted([(k, ts, i, i // 5 + 1) for k, ts, i in made], key=repr)
    want = [(k, w * 100 * S, p, "EARLY", 3 * p) for k in keys for w in (1, 2, 3) for p in (1, 2, 3)]
    want += [(k, w * 100 * S, 4, "DEFAULT", 10) for k in keys for w in (1, 2, 3)]
    assert rows(counted.filter("key IS NULL OR key <> 99")) == sorted(want, key=repr)
    told = fired.filter("key IS NULL OR key <> 99").groupBy("key", "window_start").agg(F.sum("count"), F.max("pane"))
    assert rows(told) == sorted([(k, (100 + j) * S, 30, 8) for j, k in enumerate(keys)], key=repr)


def test_calls_do_not_grow_with_keys_of_epochs():
    """Two of three parts of epoch 1, then all of epoch 2."""

    def parts(keys):
        made = [(k, e, p, (100 * e + i) * S, 0) for e, names in ((1, "abb"), (2, "caba")) for i, p in enumerate(names) for k in range(keys)]
        return pd.DataFrame(made, columns=["key", "epoch", "part", "ts", "id"])

    few, calls = run(ps.CompletionEpochs(3, idle_us=DAY), parts(4))
    many, as_many = run(ps.CompletionEpochs(3, idle_us=DAY), parts(3_000))
    want = [x for k in range(4) for x in ((k, 1, "INCOMPLETE", 2, 200 * S), (k, 2, "COMPLETED", 3, 202 * S))]
    assert as_many == calls and few == sorted(want, key=repr) and len(many) == 6_000


def test_epochs_of_a_slot_in_many_frames(monkeypatch):
    """A micro-batch in many frames, of which only what can count is held: the same rows."""
    monkeypatch.setattr(ps, "ROWS_AT_ONCE", 20)
    made = epoch_messages()
    drawn = pd.DataFrame(made, columns=["key", "epoch", "part", "ts", "id"]).sample(frac=1, random_state=3)
    machine, handle = ps.CompletionEpochs(3, idle_us=DAY), Handle()
    machine.init(handle)
    frames = [drawn[i : i + 10] for i in range(0, len(drawn), 10)]
    told = pd.concat(machine.handleInputRows((7,), iter(frames), None))
    assert sorted(told.itertuples(index=False, name=None), key=repr) == epochs_plainly(made, 3)


def test_epochs_of_a_slot_stay_apart(spark, folder, monkeypatch):
    """All keys in one slot, over several micro-batches, with null keys and parts: as each key alone. Messages without a
    time or an epoch are no parts. Complete epochs end each at its own idle time, the last one just as it is due."""
    monkeypatch.setattr(ps, "SLOTS", 1)
    keys, parts = [None, 0, -5, 2**60 + 1], {"a": None, "b": ""}
    made = [(keys[k], e, parts.get(p, p), ts, i) for k, e, p, ts, i in epoch_messages()]
    odd = [(k, None, "z", 100 * S, -1 - i) for i, k in enumerate(keys)] + [(k, 90, "z", None, -9 - i) for i, k in enumerate(keys)]
    far = [(99, 1, "a", 5_000 * S, 1_000)]
    again = [(k, e, p, (t + i) * S, 2_000 + i) for t, k, e in ((20_000, 7, 3), (20_010, 8, 3)) for i, p in enumerate("abc")]
    due = [(99, 2, "a", 20_012 * S + 10_000 * S + 1_000, 3_000)]
    later = [(k, 1, p, (30_020 + i) * S, 4_000 + i) for k in (7, 8) for i, p in enumerate("abc")]
    batches = [made[:150] + odd, made[150:300], made[300:450], made[450:], far, again, due, [(99, 2, "a", 30_013 * S, 3_001)], later]
    for i, batch in enumerate(batches):
        df = spark.createDataFrame([(*m, None) for m in batch], EPOCH_ROW + ", x int").drop("x")
        df.withColumn("at", F.timestamp_micros("ts")).coalesce(1).write.parquet(f"{folder}/p={i}")
    schema = spark.read.parquet(f"{folder}/p=0").schema
    arrivals = file_stream(spark, f"{folder}/p=*", schema, files_per_batch=1).withWatermark("at", "0 seconds")
    with state_store(spark):
        machine = ps.CompletionEpochs(3, idle_us=10_000 * S)
        got = run_append(ps.stateful(arrivals, ["key"], machine, machine.SCHEMA, timers=True))
    want = epochs_plainly(made, 3) + [(99, 1, "INCOMPLETE", 1, due[0][3])]
    want += [(k, e, "COMPLETED", 3, (t + 2) * S) for t, k, e in ((20_000, 7, 3), (20_010, 8, 3), (30_020, 7, 1), (30_020, 8, 1))]
    assert rows(got) == sorted(want, key=repr)
