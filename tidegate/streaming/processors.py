"""Stateful processors: stream operators whose state Spark's own aggregates and joins cannot hold.

A micro-batch gives a processor all its new rows of a key in no order, so each sorts them by
arrival time first. What it sorts is bounded by the micro-batch (files or offsets per trigger),
what it keeps by the state named in its class.

Calls into the state store, timers and small frames cost far more than the messages of most keys. Processors marked
``in_slots`` therefore work on a slot of keys at a time: their state is a slot's, packed into a few values, and each of
its rows names its key. The other processors work on a key at a time.
"""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import astuple, fields
from operator import attrgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from tidegate.apps.book import Book
from tidegate.operators.triggers import FIRINGS, Pane, Trigger


def arrivals(rows, *order: str) -> pd.DataFrame:
    frames = [f for f in rows if len(f)]
    if not frames:
        return pd.DataFrame()
    return pd.concat(frames).sort_values(list(order), kind="stable")


SLOTS = 512
ROWS_AT_ONCE = 500_000


def gathered(frames) -> Iterator[pd.DataFrame]:
    """Frames of some ROWS_AT_ONCE rows: a slot's state is changed once for each of them."""
    held, n = [], 0
    for frame in frames:
        held.append(frame)
        n += len(frame)
        if n >= ROWS_AT_ONCE:
            yield pd.concat(held)
            held, n = [], 0
    if n:
        yield pd.concat(held)


def key_column(slot: int, place: int, values):
    """A key column of a slot's output: keys that are null have slots of their own, told by the slot's number."""
    return [None] * len(values) if slot // SLOTS >> place & 1 else values


def added(known: np.ndarray, keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys with numbers, added to known ones (two rows: keys and numbers); and what was known of each."""
    every, at = np.unique(np.concatenate([known[0], keys]), return_inverse=True)
    totals = np.zeros((2, len(every)), np.int64)
    totals[0], old, new = every, at[: len(known[0])], at[len(known[0]) :]
    totals[1, old] = known[1]
    before = totals[1, new]
    totals[1, new] += n
    return totals, before


def unpacked(packed: bytes | None, rows: int) -> np.ndarray:
    return np.frombuffer(packed or b"", "int64").reshape(rows, -1)


class LatestTtlJoin(StatefulProcessor):
    """State: the latest (time, id) of each side of a key. With timers, and so a watermark, a side's state ends when the
    watermark passes its time to live, as no later row can meet it; without, it stays."""

    SCHEMA = "key bigint, ts bigint, left_id bigint, right_id bigint"

    def __init__(self, ttl_us: int, timers: bool = False):
        self.ttl, self.timers = ttl_us, timers

    def init(self, handle) -> None:
        self.handle = handle
        self.sides = [handle.getValueState(name, "ts bigint, id bigint") for name in ("left", "right")]

    def handleInputRows(self, key, rows, timerValues):
        last = [s.get() if s.exists() else None for s in self.sides]
        due = self._dues(last)
        out = []
        for row in arrivals(rows, "ts", "side", "id").itertuples(index=False):
            last[row.side] = (int(row.ts), int(row.id))
            other = last[1 - row.side]
            if other is not None and other[0] > row.ts - self.ttl:
                ids = (row.id, other[1]) if row.side == 0 else (other[1], row.id)
                out.append((key[0], row.ts, *ids))
        for state, value in zip(self.sides, last):
            if value is not None:
                state.update(tuple(value))
        if self.timers:
            for old in due - self._dues(last):
                self.handle.deleteTimer(old)
            for new in self._dues(last) - due:
                self.handle.registerTimer(new)
        yield pd.DataFrame(out, columns=["key", "ts", "left_id", "right_id"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs()
        for state in self.sides:
            if state.exists() and max(self._dues([state.get()])) <= passed:
                state.clear()
        yield pd.DataFrame([], columns=["key", "ts", "left_id", "right_id"])

    def _dues(self, last) -> set[int]:
        return {(int(v[0]) + self.ttl) // 1000 + 1 for v in last if v is not None}

    def close(self) -> None:
        pass


class CountPanes(StatefulProcessor):
    """repeat(count(n)) early panes of a (key, window), and its last pane when the watermark passes the
    window's end. State, by slot and window: its keys' numbers of messages so far, and one timer."""

    SCHEMA = "key bigint, window_start bigint, pane bigint, firing_type string, count bigint"
    in_slots = True

    def __init__(self, n: int, width_ms: int, accumulating: bool):
        self.n, self.width, self.accumulating = n, width_ms, accumulating

    def init(self, handle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "window_start bigint", "keys binary")

    def handleInputRows(self, key, rows, timerValues):
        for frame in gathered(rows):
            new = frame.groupby(["window_start", "key"]).size()
            (window, own), n = (new.index.get_level_values(i).to_numpy("int64") for i in (0, 1)), new.to_numpy()
            for w in np.unique(window).tolist():
                at = window == w
                known = self.seen.getValue((w,))[0] if self.seen.containsKey((w,)) else None
                totals, before = added(unpacked(known, 2), own[at], n[at])
                self.seen.updateValue((w,), (totals.tobytes(),))
                if known is None and not key[0] // SLOTS >> 1 & 1:
                    self.handle.registerTimer(w // 1000 + self.width)
                first, fired = before // self.n + 1, (before + n[at]) // self.n - before // self.n
                panes = np.arange(fired.sum()) + np.repeat(first - (np.cumsum(fired) - fired), fired)
                told = panes * self.n if self.accumulating else np.full(len(panes), self.n)
                yield self._frame(key, np.repeat(own[at], fired), w, panes, "EARLY", told)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        due = expiredTimerInfo.getExpiryTimeInMs()
        for w in [w for (w,) in self.seen.keys() if w // 1000 + self.width == due]:
            own, n = unpacked(self.seen.getValue((w,))[0], 2)
            self.seen.removeKey((w,))
            rest = n if self.accumulating else n % self.n
            some = rest > 0
            yield self._frame(key, own[some], w, (n // self.n + 1)[some], "DEFAULT", rest[some])

    def _frame(self, key, own, window: int, panes, kind: str, n) -> pd.DataFrame:
        windows = np.full(len(own), window)
        own, windows = (key_column(key[0], i, x) for i, x in enumerate((own, windows)))
        return pd.DataFrame({"key": own, "window_start": windows, "pane": panes, "firing_type": kind, "count": n})

    def close(self) -> None:
        pass


def by_time(rows) -> list[tuple[int, int]]:
    """The times of a micro-batch's messages in order, each with their number. Frames are counted one by one."""
    counts: Counter = Counter()
    for frame in rows:
        counts.update(frame["ts"].value_counts().to_dict())
    return sorted((int(ts), int(n)) for ts, n in counts.items())


def names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


PANE_FIELDS = [f.name for f in fields(Pane)]
PANE_STATE = ", ".join(f"{name} bigint" for name in PANE_FIELDS)


class OneTimer:
    """A key's only timer: setting it again deletes the old one."""

    def __init__(self, handle):
        self.handle = handle
        self.state = handle.getValueState("timer", "ms bigint")

    def set(self, ms: int | None) -> None:
        old = self.state.get()[0] if self.state.exists() else None
        if old == ms:
            return
        if old is not None:
            self.handle.deleteTimer(old)
        if ms is None:
            self.state.clear()
        else:
            self.handle.registerTimer(ms)
            self.state.update((ms,))

    def expired(self) -> None:
        self.state.clear()


class TriggerPanes(StatefulProcessor):
    """Firings of any trigger on fixed windows, keyed by (key, window_start, window_end), and the default one when the
    watermark passes the window's end. State: the pane's counts and times, and one timer."""

    SCHEMA = f"key bigint, window_start bigint, window_end bigint, {FIRINGS}"

    def __init__(self, trigger: Trigger, accumulating: bool = False):
        self.trigger, self.accumulating = trigger, accumulating

    def init(self, handle) -> None:
        self.pane = handle.getValueState("pane", PANE_STATE)
        self.timer = OneTimer(handle)

    def handleInputRows(self, key, rows, timerValues):
        pane = Pane(*self.pane.get()) if self.pane.exists() else Pane()
        out = [f for ts, n in by_time(rows) for f in pane.take(self.trigger, ts, n, self.accumulating)]
        self._keep(key, pane)
        yield self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.timer.expired()
        pane, end = Pane(*self.pane.get()), int(key[2])
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        if passed >= end:
            out = list(pane.close(self.trigger, end, self.accumulating))
            self.pane.clear()
        else:
            out = list(pane.run(self.trigger, passed, self.accumulating))
            self._keep(key, pane)
        yield self._frame(key, out)

    def _keep(self, key, pane: Pane) -> None:
        self.pane.update(astuple(pane))
        due, end = pane.due(self.trigger), int(key[2])
        self.timer.set(due // 1000 + 1 if due is not None and due < end else end // 1000)

    def _frame(self, key, out) -> pd.DataFrame:
        return pd.DataFrame([(*key, *f) for f in out], columns=names(self.SCHEMA))

    def close(self) -> None:
        pass


class TriggerSessions(StatefulProcessor):
    """Firings of any trigger on session windows. A message that lies within the gap of two sessions makes them one:
    their counts, told or not, are added up, so that a count trigger goes on from both. A firing carries its session's
    start as it was then. State, by slot: the open sessions' keys, starts, counts, times and dues, packed into one
    value, and one timer for all."""

    SCHEMA = f"key bigint, window_start bigint, {FIRINGS}"
    in_slots = True

    def __init__(self, trigger: Trigger, gap_us: int, accumulating: bool = False):
        self.trigger, self.gap, self.accumulating = trigger, gap_us, accumulating
        self.columns = 3 + len(PANE_FIELDS)

    def init(self, handle) -> None:
        self.open = handle.getValueState("sessions", "packed binary")
        self.timer = OneTimer(handle)

    def handleInputRows(self, key, rows, timerValues):
        parts = [frame.groupby(["key", "ts"]).size() for frame in gathered(rows)]
        new = parts[0] if len(parts) == 1 else pd.concat(parts).groupby(level=[0, 1]).sum()
        keys, times = (new.index.get_level_values(i).to_numpy("int64") for i in (0, 1))
        sessions, changed, out = self._sessions(), [], []
        meet = np.isin(sessions[:, 0], keys)
        held: dict[int, list] = {}
        for own, start, pane in self._panes(sessions[meet]):
            held.setdefault(own, []).append((start, pane))
        different, first = np.unique(keys, return_index=True)
        cuts, times, counts = [*first.tolist(), len(keys)], times.tolist(), new.tolist()
        for own, a, b in zip(different.tolist(), cuts, cuts[1:]):
            for kind, start, found in self._take(held.get(own, []), zip(times[a:b], counts[a:b])):
                if kind == "open":
                    changed.append((own, start, found))
                else:
                    out.append((own, start, *found))
        self._keep(sessions[~meet], changed)
        yield self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.timer.expired()
        passed, stay, out = timerValues.getCurrentWatermarkInMs() * 1000, [], []
        sessions = self._sessions()
        due = sessions[:, -1] < passed
        for own, start, pane in self._panes(sessions[due]):
            end = pane.last + self.gap
            if end < passed:
                out += [(own, start, *f) for f in pane.close(self.trigger, end, self.accumulating)]
            else:
                out += [(own, start, *f) for f in pane.run(self.trigger, passed, self.accumulating)]
                stay.append((own, start, pane))
        self._keep(sessions[~due], stay)
        yield self._frame(key, out)

    def _take(self, sessions: list, messages) -> Iterator[tuple]:
        """Firings of a key's messages in order of time, then its open sessions. Sessions lie more than a gap apart, so
        those behind a message are behind all later ones."""
        ahead = deque(sorted(sessions, key=lambda s: s[0]))
        for ts, n in messages:
            while ahead and ahead[0][1].last + self.gap < ts:
                yield "open", *ahead.popleft()
            near = []
            while ahead and ahead[0][0] - self.gap <= ts:
                near.append(ahead.popleft())
            start, pane = min(near[0][0], ts) if near else ts, self._one([s[1] for s in near])
            ahead.appendleft((start, pane))
            for f in pane.take(self.trigger, ts, n, self.accumulating):
                yield "fired", start, f
        for s in ahead:
            yield "open", *s

    def _one(self, panes: list[Pane]) -> Pane:
        if len(panes) < 2:
            return panes[0] if panes else Pane()
        counting = [p for p in panes if p.open]
        return Pane(
            sum(p.total for p in panes), sum(p.told for p in panes), sum(p.fired for p in panes), sum(p.open for p in panes),
            min((p.first for p in counting), default=0), max(p.last for p in panes),
        )

    def _sessions(self) -> np.ndarray:
        packed = self.open.get()[0] if self.open.exists() else b""
        return np.frombuffer(packed, "int64").reshape(-1, self.columns)

    def _panes(self, sessions: np.ndarray) -> Iterator[tuple[int, int, Pane]]:
        return ((own, start, Pane(*pane)) for own, start, *pane, _ in sessions.tolist())

    def _keep(self, as_they_are: np.ndarray, changed: list[tuple[int, int, Pane]]) -> None:
        values = attrgetter(*PANE_FIELDS)
        rows = []
        for own, start, pane in changed:
            due, end = pane.due(self.trigger), pane.last + self.gap
            rows.append((own, start, *values(pane), end if due is None else min(due, end)))
        sessions = np.concatenate([as_they_are, np.array(rows, np.int64).reshape(-1, self.columns)])
        if len(sessions):
            self.open.update((sessions.tobytes(),))
        else:
            self.open.clear()
        self.timer.set(int(sessions[:, -1].min()) // 1000 + 1 if len(sessions) else None)

    def _frame(self, key, out) -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=names(self.SCHEMA))
        frame["key"] = key_column(key[0], 0, frame["key"])
        return frame

    def close(self) -> None:
        pass


class QuietTimer(StatefulProcessor):
    """A timer per key, reset by every message: when it expires the messages since the last firing
    are reported. State: their count, the first and the last time."""

    SCHEMA = "key bigint, first_ts bigint, fire_ts bigint, n bigint"

    def __init__(self, quiet_us: int):
        self.quiet = quiet_us

    def init(self, handle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "first bigint, last bigint, n bigint")

    def handleInputRows(self, key, rows, timerValues):
        run = self.run.get() if self.run.exists() else None
        if run is not None:
            self.handle.deleteTimer(self._due(run))
        out = []
        for ts in arrivals(rows, "ts")["ts"]:
            if run is not None and ts - run[1] > self.quiet:
                out.append((key[0], run[0], run[1] + self.quiet, run[2]))
                run = None
            run = (int(ts), int(ts), 1) if run is None else (run[0], int(ts), run[2] + 1)
        self.run.update(tuple(run))
        self.handle.registerTimer(self._due(run))
        yield pd.DataFrame(out, columns=["key", "first_ts", "fire_ts", "n"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        run = self.run.get()
        self.run.clear()
        yield pd.DataFrame([(key[0], run[0], run[1] + self.quiet, run[2])], columns=["key", "first_ts", "fire_ts", "n"])

    def _due(self, run) -> int:
        return (int(run[1]) + self.quiet) // 1000 + 1

    def close(self) -> None:
        pass


class WatermarkCallback(StatefulProcessor):
    """Hold each key's messages back until the watermark passes them, then emit them in time order.

    State, by slot: an index of the messages by time, a bucket of ``bucket_ms`` each, with the bucket's first time, and
    how many of each key have been emitted. A bucket has a timer of its own, at its first message; a timer reads and
    sorts that bucket alone, and a new message touches only the bucket it falls into. A bucket is packed into one value,
    and so are the numbers emitted."""

    SCHEMA = "key bigint, ts bigint, id bigint, place bigint"
    in_slots = True

    def __init__(self, bucket_ms: int = 86_400_000):
        self.width = bucket_ms * 1000

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "bucket bigint", "first bigint, rows binary")
        self.place = handle.getValueState("places", "keys binary")

    def handleInputRows(self, key, rows, timerValues):
        for frame in gathered(rows):
            own = frame["key"] if "key" in frame else np.full(len(frame), key[0])
            messages = np.column_stack([frame[["ts", "id"]].to_numpy("int64"), own])
            bucket = messages[:, 0] // self.width
            for b in np.unique(bucket):
                self._hold(int(b), messages[bucket == b])
        yield pd.DataFrame([], columns=names(self.SCHEMA))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs()
        bucket = (expiredTimerInfo.getExpiryTimeInMs() - 1) * 1000 // self.width
        _, packed = self.held.getValue((bucket,))
        self.held.removeKey((bucket,))
        messages = np.frombuffer(packed, "int64").reshape(-1, 3)
        ready = messages[:, 0] // 1000 + 1 <= passed
        if not ready.all():
            self._hold(bucket, messages[~ready])
        out = messages[ready]
        out = out[np.lexsort((out[:, 1], out[:, 0], out[:, 2]))]
        keys, first, n = np.unique(out[:, 2], return_index=True, return_counts=True)
        totals, before = added(unpacked(self.place.get()[0] if self.place.exists() else None, 2), keys, n)
        self.place.update((totals.tobytes(),))
        place = np.arange(1, len(out) + 1) + np.repeat(before - first, n)
        yield pd.DataFrame({"key": key_column(key[0], 0, out[:, 2]), "ts": out[:, 0], "id": out[:, 1], "place": place})

    def _hold(self, bucket: int, messages: np.ndarray) -> None:
        """Add messages to a bucket, whose timer is at the first of them."""
        first, packed = int(messages[:, 0].min()), messages.tobytes()
        if self.held.containsKey((bucket,)):
            old, before = self.held.getValue((bucket,))
            packed = before + packed
            if old // 1000 <= first // 1000:
                first = old
            else:
                self.handle.deleteTimer(old // 1000 + 1)
        self.held.updateValue((bucket,), (first, packed))
        self.handle.registerTimer(first // 1000 + 1)

    def close(self) -> None:
        pass


class RunningTotals(StatefulProcessor):
    """A task with a store: answers each message with the count and the maximum of its key so far."""

    SCHEMA = "id bigint, key bigint, seen bigint, top bigint"

    def init(self, handle) -> None:
        self.store = handle.getValueState("totals", "n bigint, top bigint")

    def handleInputRows(self, key, rows, timerValues):
        n, top = self.store.get() if self.store.exists() else (0, None)
        new = arrivals(rows, "ts", "id")
        best = new["v"].cummax()
        if top is not None:
            best = best.clip(lower=top)
        out = pd.DataFrame({"id": new["id"], "key": key[0], "seen": range(n + 1, n + len(new) + 1), "top": best})
        self.store.update((int(n + len(new)), int(best.iloc[-1])))
        yield out

    def close(self) -> None:
        pass


class JoinCompletion(StatefulProcessor):
    """Emits a (key, epoch) once, when the last of the expected distinct parts arrives. State: the time
    each part was first seen, and whether the epoch has been emitted."""

    SCHEMA = "key bigint, epoch bigint, completed_at bigint"

    def __init__(self, expected: int):
        self.expected = expected

    def init(self, handle) -> None:
        self.parts = handle.getMapState("parts", "part string", "ts bigint")
        self.done = handle.getValueState("done", "done boolean")

    def handleInputRows(self, key, rows, timerValues):
        out = []
        if not self.done.exists():
            first = arrivals(rows, "ts").drop_duplicates("part")
            for part, ts in zip(first["part"], first["ts"]):
                if not self.parts.containsKey((part,)):
                    self.parts.updateValue((part,), (int(ts),))
            times = [v[0] for _, v in self.parts.iterator()]
            if len(times) == self.expected:
                out = [(*key, max(times))]
                self.done.update((True,))
                self.parts.clear()
        yield pd.DataFrame(out, columns=["key", "epoch", "completed_at"])

    def close(self) -> None:
        pass


# What a row of CompletionEpochs may have in place of a part's number, and the time of its rows that were kept.
NO_EPOCH, COMPLETE, NULL_PART = -3, -2, -1
BEFORE = -(2**63)


def whole(column: pd.Series, null: int) -> np.ndarray:
    """A column of whole numbers; pandas has floats where some are null."""
    return column.fillna(null).to_numpy("int64")


def begins(column: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before."""
    return np.concatenate([np.ones(min(1, len(column)), bool), column[1:] != column[:-1]])


class CompletionEpochs(StatefulProcessor):
    """Completion over epochs, per key: parts of the newest epoch are gathered, older ones are ignored, and a newer epoch
    takes the place of the open one, which is an INCOMPLETE row unless it was COMPLETED. Messages without a time or an
    epoch are no parts. State, by slot: each key's open epoch, a row for each of its parts or one row when it is
    complete, with the key's last time; these are packed into one value, with the names of their parts. With
    ``idle_us`` (and timers) a complete epoch's state ends when the watermark is so far past the key's last message; a
    key that speaks again begins anew. A slot has one timer."""

    SCHEMA = "key bigint, epoch bigint, status string, parts bigint, at bigint"
    in_slots = True

    def __init__(self, expected: int, idle_us: int | None = None):
        self.expected, self.idle = expected, idle_us

    def init(self, handle) -> None:
        self.open = handle.getValueState("open", "names array<string>, packed binary")
        self.timer = OneTimer(handle)

    def handleInputRows(self, key, rows, timerValues):
        names_of, kept = self._kept()
        numbers = {name: i for i, name in enumerate(names_of)}
        new, most = np.empty((5, 0), np.int64), ROWS_AT_ONCE
        for frame in gathered(rows):
            new = np.concatenate([new, self._messages(frame, numbers)], axis=1)
            if new.shape[1] > most:
                new = self._needed(new)
                most = max(most, 2 * new.shape[1])
        meet = np.isin(kept[0], new[0])
        own, epoch, part, last = kept[:, meet]
        held = np.stack([own, epoch, part, np.full(len(own), BEFORE), last])
        stay, told = self._take(np.concatenate([held, new], axis=1))
        self._keep(list(numbers), np.concatenate([kept[:, ~meet], stay], axis=1))
        yield self._frame(key, told)

    def _messages(self, frame: pd.DataFrame, numbers: dict[str, int]) -> np.ndarray:
        """Columns key, epoch, part's number, time and id, as rows. New parts are given numbers."""
        frame = frame[frame["ts"].notna()]
        at, found = pd.factorize(frame["part"])
        part = np.array([*(numbers.setdefault(name, len(numbers)) for name in found), NULL_PART])[at]
        part[frame["epoch"].isna()] = NO_EPOCH
        columns = [("key", 0), ("epoch", BEFORE), None, ("ts", 0), ("id", 2**62)]
        return np.stack([whole(frame[c[0]], c[1]) if c else part for c in columns])

    def _needed(self, messages: np.ndarray) -> np.ndarray:
        """The first message of each key, epoch and part, and each key's last."""
        own, epoch, part, ts, order = messages
        by_part = np.lexsort((order, ts, part, epoch, own))
        first = begins(own[by_part]) | begins(epoch[by_part]) | begins(part[by_part])
        by_time = np.lexsort((ts, own))
        last = np.roll(begins(own[by_time]), -1)
        return messages[:, np.union1d(by_part[first], by_time[last])]

    def _take(self, messages: np.ndarray) -> tuple[np.ndarray, tuple[list[np.ndarray], ...]]:
        """What is kept of some keys, and their COMPLETED and INCOMPLETE rows, from what was kept of them and their new
        messages."""
        own, epoch, _, ts, order = messages
        # Of messages of one time and id the newest epoch's is first.
        own, epoch, part, ts, order = messages[:, np.lexsort((~epoch, order, ts, own))]
        keys = np.flatnonzero(begins(own))
        newest = ts[np.append(keys[1:], len(own)) - 1] if len(own) else ts
        last = np.where(ts[keys] == BEFORE, np.maximum(newest, order[keys]), newest)

        # A key's newest epoch so far, as places among all epochs: later keys have higher ones.
        epochs, place = np.unique(epoch, return_inverse=True)
        number = np.cumsum(begins(own)) - 1
        level = number * len(epochs) + place
        live = np.flatnonzero((level == np.maximum.accumulate(level)) & (part != NO_EPOCH))
        # The first of each part, in order of arrival; rows of one key and epoch follow each other.
        pair = (np.cumsum(begins(level[live])) - 1) * (part.max(initial=0) + 3) + part[live] + 2
        live = live[np.sort(np.unique(pair, return_index=True)[1])]
        own, epoch, part, ts, number = (c[live] for c in (own, epoch, part, ts, number))
        starts = begins(level[live])
        first, run = np.flatnonzero(starts), np.cumsum(starts) - 1

        count = np.cumsum(np.where(part == COMPLETE, self.expected, 1))
        count -= np.concatenate([[0], count])[first][run]
        ends = np.append(first[1:], len(own)) - 1 if len(own) else first
        parts = np.minimum(count[ends], self.expected)
        done = (count == self.expected) & (ts != BEFORE)
        replaced = np.zeros(len(first), bool)
        replaced[:-1] = number[first[1:]] == number[first[:-1]]
        dropped = np.flatnonzero(replaced & (parts < self.expected))
        after = first[dropped + 1]
        told = [own[done], epoch[done], count[done], ts[done]], [own[after], epoch[first[dropped]], parts[dropped], ts[after]]

        complete = (parts == self.expected)[run]
        stays = ~replaced[run] & (~complete | starts)
        stay = np.stack([own, epoch, np.where(complete, COMPLETE, part), last[number]])[:, stays]
        return stay, told

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.timer.expired()
        names_of, kept = self._kept()
        ended = (kept[2] == COMPLETE) & (self._due(kept[3]) <= timerValues.getCurrentWatermarkInMs())
        self._keep(names_of, kept[:, ~ended])
        yield pd.DataFrame([], columns=names(self.SCHEMA))

    def _due(self, last: np.ndarray) -> np.ndarray:
        return (last + self.idle) // 1000 + 1

    def _kept(self) -> tuple[list[str], np.ndarray]:
        names_of, packed = self.open.get() if self.open.exists() else ([], None)
        return list(names_of), unpacked(packed, 4)

    def _keep(self, names_of: list[str], kept: np.ndarray) -> None:
        if kept.shape[1]:
            named = kept[2] >= 0
            used, kept[2, named] = np.unique(kept[2, named], return_inverse=True)
            self.open.update(([names_of[i] for i in used], kept.tobytes()))
        else:
            self.open.clear()
        if self.idle is not None:
            dues = self._due(kept[3, kept[2] == COMPLETE])
            self.timer.set(int(dues.min()) if len(dues) else None)

    def _frame(self, key, told) -> pd.DataFrame:
        own, epoch, parts, at = (np.concatenate(c) for c in zip(*told))
        status = np.repeat(np.array(["COMPLETED", "INCOMPLETE"], object), [len(t[0]) for t in told])
        return pd.DataFrame({"key": key_column(key[0], 0, own), "epoch": epoch, "status": status, "parts": parts, "at": at})

    def close(self) -> None:
        pass


class MatchOrders(StatefulProcessor):
    """Continuous matching of a (security, session). State, by slot and session: the open orders of its securities,
    packed into one value. Where rows have the session's end as ``until``, in microseconds, the state ends when the
    watermark passes it; this needs timers."""

    SCHEMA = "security bigint, session string, buy_order bigint, sell_order bigint, cents bigint, volume bigint"
    ARRIVAL = ["side", "volume", "cents", "part_id", "line", "order_no", "ts", "security"]  # the last one sorts first
    in_slots = True

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "session string", "until bigint, orders binary")

    def handleInputRows(self, key, rows, timerValues):
        new = pd.concat([f for f in rows if len(f)])
        sessions, names_of = pd.factorize(new["session"])
        for number, session in enumerate(names_of):
            part = new[sessions == number] if len(names_of) > 1 else new
            yield self._frame(key, session, *self._match(session, part))

    def _match(self, session: str, new: pd.DataFrame) -> tuple[list[int], list[int], list[tuple]]:
        """Securities, their numbers of trades and the trades of a session's new orders, in order of arrival."""
        by = {c: new[c].to_numpy() for c in self.ARRIVAL}
        side = by["side"]
        by["side"] = np.unique(side, return_inverse=True)[1]
        order = np.lexsort(list(by.values()))
        security = by["security"][order].astype("int64")
        columns = [side[order].tolist(), *(by[c][order].tolist() for c in ("cents", "order_no", "volume"))]

        known = self.open.containsKey((session,))
        until, packed = self.open.getValue((session,)) if known else (None, b"")
        resting = np.frombuffer(packed, "int64").reshape(-1, 5)
        meet = np.isin(resting[:, 0], security)
        books: dict[int, Book] = {}
        for own, buys, cents, order_no, volume in resting[meet].tolist():
            books.setdefault(own, Book()).add(order_no, "B" if buys else "S", cents, volume)

        different, first = np.unique(security, return_index=True)
        cuts, many, trades, stay = [*first.tolist(), len(security)], [], [], []
        for own, a, b in zip(different.tolist(), cuts, cuts[1:]):
            book, before = books.pop(own, None) or Book(), len(trades)
            for kind, cents, order_no, volume in zip(*(c[a:b] for c in columns)):
                trades += book.add(int(order_no), kind, int(cents), int(volume))
            many.append(len(trades) - before)
            orders = [(1, o) for o in book.buys] + [(0, o) for o in book.sells]
            # Oldest first, so that the next batch rests them in the same order.
            orders.sort(key=lambda so: so[1][1])
            stay += [(own, s, abs(o[0]), o[2], o[3]) for s, o in orders]
        if until is None and "until" in new:
            until = int(new["until"].iloc[0])
            self.handle.registerTimer(until // 1000 + 1)
        resting = np.concatenate([resting[~meet], np.array(stay, np.int64).reshape(-1, 5)])
        if len(resting):
            self.open.updateValue((session,), (until, resting.tobytes()))
        elif known:
            self.open.removeKey((session,))
        return different, many, trades

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs()
        for session, until in [(k[0], v[0]) for k, v in self.open.iterator()]:
            if until // 1000 + 1 <= passed:
                self.open.removeKey((session,))
        yield pd.DataFrame([], columns=names(self.SCHEMA))

    def _frame(self, key, session: str, securities, many: list[int], trades: list[tuple]) -> pd.DataFrame:
        own, sessions = np.repeat(securities, many), np.full(len(trades), session, object)
        own, sessions = (key_column(key[0], i, x) for i, x in enumerate((own, sessions)))
        traded = np.array(trades, np.int64).reshape(-1, 4)
        return pd.DataFrame({"security": own, "session": sessions, **dict(zip(names(self.SCHEMA)[2:], traded.T))})

    def close(self) -> None:
        pass


def slots(df: DataFrame, keys: list[str]) -> DataFrame:
    """The rows with their key's slot as ``_slot``. Null keys are filled, and have slots of their own behind the others,
    by which of the columns are null."""
    types = dict(df.dtypes)
    nulls = sum((F.col(k).isNull().cast("bigint") * F.lit(2**i) for i, k in enumerate(keys)), F.lit(0))
    slot = F.pmod(F.xxhash64(*keys), F.lit(SLOTS)) + nulls * SLOTS
    filled = {k: F.coalesce(k, F.lit("" if types[k] == "string" else 0).cast(types[k])) for k in keys}
    return df.withColumn("_slot", slot.cast("bigint")).withColumns(filled)


def stateful(df: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str, timers: bool = False) -> DataFrame:
    """Attach a processor to a keyed stream. With timers the stream must carry a watermark."""
    if getattr(processor, "in_slots", False):
        df, keys = slots(df, keys), ["_slot"]
    return df.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=StructType.fromDDL(schema), outputMode="Append",
        timeMode="EventTime" if timers else "None",
    )
