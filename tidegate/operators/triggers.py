"""Triggers that can be put together, and the panes they fire, on any kind of window.

All times are event times. A pane takes its messages in order of time. Every part of a trigger sees the messages
since the pane last fired: how many, the first time and the last. ``any_of`` fires with the first of its parts, which
ends the others' counts and timers; ``repeat`` arms its part again. So what a trigger can do comes down to the
smallest count, the shortest time since the first message and the shortest since the last, once or again and again.

A message at the moment a timer is due comes before the timer. A timer fires up to the end of the pane, never later.
At the pane's end the default firing gives what no early one has.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.operators.ordered import micros
from tidegate.operators.scans import scan_groups

EARLY, DEFAULT = "EARLY", "DEFAULT"


@dataclass(frozen=True)
class Trigger:
    """``parts``: (kind, value) in the order given, the smallest of each kind; kinds are count, first and last."""

    parts: tuple[tuple[str, int], ...]
    repeats: bool = False

    @property
    def messages(self) -> int | None:
        return dict(self.parts).get("count")

    def due(self, first: int, last: int) -> tuple[int, str] | None:
        """When the earliest timer of messages from ``first`` to ``last`` is due, and its kind."""
        since = {"first": first, "last": last}
        times = [(since[kind] + value, kind) for kind, value in self.parts if kind in since]
        return min(times, key=lambda x: x[0]) if times else None


def count(n: int) -> Trigger:
    """Fires at the n-th message."""
    if n < 1:
        raise ValueError("a count trigger needs a count of 1 or more")
    return Trigger((("count", n),))


def _timer(kind: str, seconds: float) -> Trigger:
    if seconds < 0:
        raise ValueError("a timer needs a time of 0 or more")
    return Trigger(((kind, round(seconds * 1_000_000)),))


def since_first(seconds: float) -> Trigger:
    """Fires so long after the first message."""
    return _timer("first", seconds)


def since_last(seconds: float) -> Trigger:
    """Fires when there was no message for so long."""
    return _timer("last", seconds)


def any_of(*triggers: Trigger) -> Trigger:
    """Fires with the first of the triggers, once."""
    least: dict[str, int] = {}
    for kind, value in (p for t in triggers for p in t.parts):
        least[kind] = min(value, least.get(kind, value))
    return Trigger(tuple(least.items()))


def repeat(trigger: Trigger) -> Trigger:
    """Starts the trigger again after each firing."""
    return replace(trigger, repeats=True)


@dataclass
class Pane:
    """A pane's state: all messages, those told by firings and the number of firings; and of the messages that the
    trigger counts, their number, first and last time."""

    total: int = 0
    told: int = 0
    fired: int = 0
    open: int = 0
    first: int = 0
    last: int = 0

    def armed(self, trigger: Trigger) -> bool:
        return trigger.repeats or self.fired == 0

    def due(self, trigger: Trigger) -> int | None:
        """When the pane's earliest timer is due."""
        found = trigger.due(self.first, self.last) if self.open and self.armed(trigger) else None
        return found and found[0]

    def fire(self, time: int, kind: str, seen: int, accumulating: bool) -> tuple:
        """(pane, firing_type, fired_by, fire_ts, count) of a firing that has seen so many messages of the pane."""
        self.fired += 1
        new, self.told, self.open = seen - self.told, seen, 0
        return self.fired, EARLY, kind, time, seen if accumulating else new

    def run(self, trigger: Trigger, now: int, accumulating: bool) -> Iterable[tuple]:
        """The firing of a timer due before ``now``."""
        if self.open and self.armed(trigger):
            found = trigger.due(self.first, self.last)
            if found and found[0] < now:
                yield self.fire(*found, self.total, accumulating)

    def take(self, trigger: Trigger, time: int, n: int, accumulating: bool) -> Iterable[tuple]:
        """Firings up to and with ``n`` messages at ``time``."""
        yield from self.run(trigger, time, accumulating)
        while n:
            wanted = trigger.messages - self.open if trigger.messages and self.armed(trigger) else None
            now = n if wanted is None else min(n, wanted)
            if not self.open:
                self.first = time
            self.last, self.open, self.total, n = max(time, self.last), self.open + now, self.total + now, n - now
            if now == wanted:
                yield self.fire(time, "count", self.total, accumulating)

    def close(self, trigger: Trigger, end: int, accumulating: bool) -> Iterable[tuple]:
        """Firings up to the pane's end."""
        yield from self.run(trigger, end + 1, accumulating)
        rest = self.total if accumulating else self.total - self.told
        if rest:
            yield self.fired + 1, DEFAULT, "window", end, rest


class _PaneFold:
    def __init__(self, trigger: Trigger, accumulating: bool, end: int):
        self.pane, self.trigger, self.accumulating, self.until = Pane(), trigger, accumulating, end

    def step(self, row: tuple) -> Iterable[tuple]:
        return self.pane.take(self.trigger, *row, self.accumulating)

    def end(self) -> Iterable[tuple]:
        return self.pane.close(self.trigger, self.until, self.accumulating)


FIRINGS = "pane bigint, firing_type string, fired_by string, fire_ts bigint, count bigint"


def fire(df: DataFrame, keys: list[str], ts: str, trigger: Trigger, accumulating: bool = False) -> DataFrame:
    """All firings of messages that carry their window as ``window_start`` and ``window_end``: keys, both as
    microseconds, pane, firing_type, fired_by, fire_ts, count.

    Messages of one time are counted on the map side, so a task reads one row per pane and time, in order, and holds
    the state of one pane.
    """
    bounds = [F.unix_micros(c).alias(c) for c in ("window_start", "window_end")]
    times = df.select(*keys, *bounds, micros(ts).alias("_t")).groupBy(*keys, "window_start", "window_end", "_t").agg(F.count(F.lit(1)).alias("_n"))
    by = [*keys, "window_start", "window_end"]
    return scan_groups(times, by, ["_t"], lambda key: _PaneFold(trigger, accumulating, key[-1]), FIRINGS)
