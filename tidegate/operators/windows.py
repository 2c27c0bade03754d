"""Tumbling and session windows, triggers and accumulation modes over event time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.operators.ordered import at, micros, number_rows, running, same_keys


def pane_start(ts: str, width: str) -> Column:
    return F.window(F.col(ts), width)["start"]


def tumbling(df: DataFrame, ts: str, width: str, keys: list[str], aggs: dict[str, Column]) -> DataFrame:
    """One row per (window, key). Works on a batch table and on a stream."""
    return (
        df.groupBy(F.window(F.col(ts), width).alias("_w"), *keys)
        .agg(*[a.alias(n) for n, a in aggs.items()])
        .select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *keys, *aggs)
    )


def session_stream(df: DataFrame, ts: str, gap: str, keys: list[str], aggs: dict[str, Column]) -> DataFrame:
    """Session windows for a stream, where the state store merges sessions as they grow."""
    return (
        df.groupBy(F.session_window(F.col(ts), gap).alias("_w"), *keys)
        .agg(*[a.alias(n) for n, a in aggs.items()])
        .select(F.col("_w.start").alias("session_start"), F.col("_w.end").alias("session_end"), *keys, *aggs)
    )


MERGE = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}
FIRST = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}


def sessions(df: DataFrame, ts: str, gap_seconds: int, keys: list[str], out: dict[str, tuple[str, str]]) -> DataFrame:
    """Session windows for a batch: ``out = {name: (kind, column)}``, kind in sum, count, min, max.

    Two rows of one key in the same gap-wide time bucket are always in one session, so
    the rows are first aggregated per (key, bucket) before the shuffle. What is sorted
    per key is then bounded by the length of time, not by the number of rows.
    """
    gap = gap_seconds * 1_000_000
    t = micros(ts)
    buckets = df.groupBy(*keys, (t - F.pmod(t, F.lit(max(1, gap)))).alias("_b")).agg(
        F.min(t).alias("_first"), F.max(t).alias("_last"), *[FIRST[k](c).alias(n) for n, (k, c) in out.items()]
    )
    by_time = Window.partitionBy(*keys).orderBy("_b")
    breaks = F.col("_first") - F.lag("_last").over(by_time) > gap
    numbered = buckets.withColumn("_new", F.when(breaks, 1).otherwise(0)).withColumn(
        "_session", F.sum("_new").over(by_time.rowsBetween(Window.unboundedPreceding, 0))
    )
    return (
        numbered.groupBy(*keys, "_session")
        .agg(
            F.timestamp_micros(F.min("_first")).alias("session_start"),
            F.timestamp_micros(F.max("_last") + gap).alias("session_end"),
            *[MERGE[k](n).alias(n) for n, (k, _) in out.items()],
        )
        .drop("_session")
    )


def in_tumbling(df: DataFrame, ts: str, width: str) -> DataFrame:
    """Tag each message with its tumbling window, as ``window_start`` and ``window_end``."""
    window = F.window(F.col(ts), width)
    return df.withColumn("_w", window).select(*df.columns, F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"))


def session_bounds(df: DataFrame, t: Column, gap: int, keys: list[str]) -> DataFrame:
    """The rows with ``_start`` and ``_end``, the first and last time (``t``, in microseconds) of their session: rows of
    a key further apart than ``gap`` are in different ones.

    All rows of a key in one gap-wide bucket are in one session, so sessions are found from one row per (key, bucket)
    and joined back by it. A hot key is spread over its buckets.
    """
    tagged = df.withColumn("_b", t - F.pmod(t, F.lit(max(1, gap))))
    buckets = tagged.groupBy(*[F.col(k).alias(f"_s_{k}") for k in keys], F.col("_b").alias("_s_b")).agg(F.min(t).alias("_first"), F.max(t).alias("_last"))
    by_time = Window.partitionBy(*[f"_s_{k}" for k in keys]).orderBy("_s_b")
    starts = F.when(F.coalesce(F.col("_first") - F.lag("_last").over(by_time) > gap, F.lit(True)), F.col("_first"))
    found = buckets.withColumn("_start", starts).withColumn("_start", F.last("_start", True).over(by_time.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy(*[f"_s_{k}" for k in keys], "_start")
    found = found.withColumn("_end", F.max("_last").over(whole)).drop("_first", "_last")
    joined = tagged.join(found, same_keys(keys, "", "_s_") & (F.col("_b") == F.col("_s_b")))
    return joined.select(*df.columns, "_start", "_end")


def in_sessions(df: DataFrame, ts: str, gap_seconds: int, keys: list[str]) -> DataFrame:
    """Tag each message with its session, as ``window_start`` and ``window_end``."""
    gap = gap_seconds * 1_000_000
    found = session_bounds(df, micros(ts), gap, keys)
    return found.select(*df.columns, F.timestamp_micros("_start").alias("window_start"), F.timestamp_micros(F.col("_end") + gap).alias("window_end"))


def panes(df: DataFrame, ts: str, width: str) -> DataFrame:
    """Tag each message with its tumbling pane; the pane's list is the rows that carry the tag."""
    return df.withColumn("window_start", pane_start(ts, width))


def count_trigger(df: DataFrame, keys: list[str], ts: str, order: list[str], width: str, n: int) -> DataFrame:
    """The message on which a count(n) trigger fires, once per (key, window).

    For a small n Spark keeps only the first n messages of a pane before the shuffle.
    """
    tagged = panes(df, ts, width)
    window_keys = [*keys, "window_start"]
    if n <= 1000:
        place = F.row_number().over(Window.partitionBy(*window_keys).orderBy(*order)).cast("bigint")
        return tagged.withColumn("count", place).filter(F.col("count") <= n).filter(F.col("count") == n)
    return number_rows(tagged, window_keys, order, at(ts, order[-1]), "count").filter(F.col("count") == n)


PANES_PER_ROW = 100_000


def early_panes(df: DataFrame, keys: list[str], ts: str, width: str, n: int, accumulating: bool) -> DataFrame:
    """repeat(count(n)) early firings plus the pane at the window's end.

    DISCARDING: every firing counts the messages since the last one, and the end pane
    holds the rest. ACCUMULATING: every firing counts all messages of the window so far.
    The number of messages in a window says which panes it fires, so they are not sorted.
    """
    window_keys = [*keys, "window_start"]
    totals = panes(df, ts, width).groupBy(*window_keys).agg(F.count(F.lit(1)).alias("_n"))
    totals = totals.withColumn("_fired", F.expr(f"_n div {n}")).withColumn("_rest", F.col("_n") % n)
    last_pane = F.col("_n") if accumulating else F.col("_rest")
    totals = totals.withColumn("_panes", F.col("_fired") + F.when(last_pane > 0, 1).otherwise(0))
    # A window with very many panes is first cut into runs of panes, which are spread over tasks.
    runs = totals.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(_panes - 1) div {PANES_PER_ROW}"))))
    low = F.col("_run") * PANES_PER_ROW + 1
    high = F.least(low + PANES_PER_ROW - 1, F.col("_panes"))
    fired = runs.repartition(*window_keys, "_run").withColumn("pane", F.explode(F.sequence(low, high)))
    early = F.col("pane") <= F.col("_fired")
    count = F.col("pane") * n if accumulating else F.lit(n).cast("bigint")
    return fired.select(
        *window_keys, "pane", F.when(early, "EARLY").otherwise("DEFAULT").alias("firing_type"),
        F.when(early, count).otherwise(last_pane).alias("count"),
    )


def in_pane(fired: DataFrame, width: str) -> DataFrame:
    """Early firings up to the pane's end; what would fire later does not, as the pane is closed."""
    return fired.filter(F.col("fire_ts") <= F.col("window_start") + F.expr(f"INTERVAL {width}"))


def since_first_trigger(df: DataFrame, keys: list[str], ts: str, width: str, delay: str) -> DataFrame:
    """Firing time of timeSinceFirstMessage(delay) per (key, window), and what it sees.

    The trigger fires once, ``delay`` after the first message of the pane, and never
    after the pane's end.
    """
    tagged = panes(df, ts, width)
    window_keys = [*keys, "window_start"]
    first = tagged.groupBy(*window_keys).agg(F.min(ts).alias("first_ts"))
    first = in_pane(first.withColumn("fire_ts", F.col("first_ts") + F.expr(f"INTERVAL {delay}")), width)
    joined = tagged.join(first, window_keys)
    return joined.groupBy(*window_keys, "fire_ts").agg(
        F.count(F.when(F.col(ts) <= F.col("fire_ts"), 1)).alias("seen"), F.count(F.lit(1)).alias("total")
    )


def since_last_trigger(
    df: DataFrame, keys: list[str], ts: str, width: str, delay_seconds: int
) -> DataFrame:
    """Firing of timeSinceLastMessage per (key, window): the first moment the pane has been
    quiet for the delay. Each message resets the timer; the trigger fires once, and never after the pane's end."""
    window_keys = [*keys, "window_start"]
    runs = sessions(panes(df, ts, width), ts, delay_seconds, window_keys, {"count": ("count", ts)})
    # Runs of a pane are bounded by its length over the delay; the first is the firing.
    first = F.min_by(F.struct(F.col("session_end").alias("fire_ts"), F.col("count").alias("seen")), "session_start")
    return in_pane(runs.groupBy(*window_keys).agg(first.alias("f")).select(*window_keys, "f.fire_ts", "f.seen"), width)


def any_trigger(
    df: DataFrame, keys: list[str], ts: str, order: list[str], width: str, n: int, delay: str
) -> DataFrame:
    """any(count(n), timeSinceFirstMessage(delay)): whichever fires first cancels the other. Neither
    fires after the pane's end.

    One pass: each message gets its number and the time of the first one in its pane.
    """
    window_keys = [*keys, "window_start"]
    tagged = panes(df, ts, width).withColumn("_t", F.col(ts))
    seen = running(tagged, window_keys, order, at(ts, order[-1]), {"_rn": ("count", "_t"), "_first": ("min", "_t")})
    due = F.col("_first") + F.expr(f"INTERVAL {delay}")
    both = seen.groupBy(*window_keys).agg(
        F.min(due).alias("due"), F.min(F.when(F.col("_rn") == n, F.col(ts))).alias("count_ts"),
        F.count(F.when(F.col(ts) <= due, 1)).alias("in_time"),
    )
    by_count = F.col("count_ts") <= F.col("due")
    fired = both.select(
        *window_keys,
        F.when(by_count, F.col("count_ts")).otherwise(F.col("due")).alias("fire_ts"),
        F.when(by_count, F.lit("count")).otherwise(F.lit("time")).alias("fired_by"),
        F.when(by_count, F.lit(n)).otherwise(F.col("in_time")).cast("bigint").alias("seen"),
    )
    return in_pane(fired, width)
