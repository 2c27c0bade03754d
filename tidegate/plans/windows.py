"""Window, trigger and keyed-state queries on batch tables, in event time."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegate.operators import triggers as tr
from tidegate.operators import windows as ops
from tidegate.operators.ordered import at, running
from tidegate.registry import query

ORDER = ["date_time", "event_id"]
WEEK_START = "epoch_us(time_bucket(INTERVAL 7 DAY, date_time, TIMESTAMP '1970-01-01'))"
WEEK = "7 days"


def rows_seen():
    return F.count(F.lit(1))


def us(*cols):
    """Timestamps as microseconds, under their own names."""
    return {c: F.unix_micros(c) for c in cols}


@query(
    "win_tumbling_keyed",
    """SELECT epoch_us(date_trunc('day', date_time)) AS window_start, bidder, count(*) AS n, max(price) AS top
    FROM bid_s GROUP BY ALL""",
)
def win_tumbling_keyed(t):
    out = ops.tumbling(t.bid_s, "date_time", "1 day", ["bidder"], {"n": rows_seen(), "top": F.max("price")})
    return out.withColumns(us("window_start")).drop("window_end")


@query(
    "win_tumbling",
    """SELECT epoch_us(date_trunc('hour', date_time)) AS window_start, epoch_us(date_trunc('hour', date_time) + INTERVAL 1 HOUR)
    AS window_end, count(*) AS n, CAST(sum(price) AS BIGINT) AS total FROM bid_s GROUP BY ALL""",
)
def win_tumbling(t):
    out = ops.tumbling(t.bid_s, "date_time", "1 hour", [], {"n": rows_seen(), "total": F.sum("price")})
    return out.withColumns(us("window_start", "window_end"))


@query(
    "win_collect",
    f"""SELECT {WEEK_START} AS window_start, auction, event_id, count(*) OVER (PARTITION BY {WEEK_START}, auction) AS pane_size
    FROM bid_s""",
)
def win_collect(t):
    # A pane's list is its rows: each message carries its pane, and the sizes come from counts
    # per pane, so no pane has to fit in one value.
    tagged = ops.panes(t.bid_s, "date_time", WEEK).select("window_start", "auction", "event_id")
    sizes = tagged.groupBy("window_start", "auction").agg(rows_seen().alias("pane_size"))
    return tagged.join(sizes, ["window_start", "auction"]).withColumns(us("window_start"))


@query(
    "win_session",
    """WITH g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM g)
    SELECT user_id, epoch_us(min(ts)) AS session_start, epoch_us(max(ts) + INTERVAL 6 HOUR) AS session_end, count(*) AS n,
    max(value) AS top FROM s GROUP BY user_id, sid""",
)
def win_session(t):
    out = ops.sessions(t.events, "ts", 6 * 3600, ["user_id"], {"n": ("count", "ts"), "top": ("max", "value")})
    return out.withColumns(us("session_start", "session_end"))


RANKED = f"""r AS (SELECT *, {WEEK_START} AS window_start, row_number() OVER (PARTITION BY auction, {WEEK_START}
    ORDER BY date_time, event_id) AS rn, count(*) OVER (PARTITION BY auction, {WEEK_START}) AS total,
    min(date_time) OVER (PARTITION BY auction, {WEEK_START}) AS first_ts FROM bid_s)"""


@query("trig_count", f"WITH {RANKED} SELECT auction, window_start, event_id, rn AS count FROM r WHERE rn = 3")
def trig_count(t):
    fired = ops.count_trigger(t.bid_s, ["auction"], "date_time", ORDER, WEEK, 3)
    return fired.select("auction", F.unix_micros("window_start").alias("window_start"), "event_id", "count")


def _early(t, key, n, accumulating):
    out = ops.early_panes(t.bid_s, [key], "date_time", WEEK, n, accumulating)
    return out.withColumns(us("window_start"))


EARLY = """WITH {ranked} SELECT auction, window_start, CAST(rn // {n} AS BIGINT) AS pane, 'EARLY' AS firing_type,
    {early} AS count FROM r WHERE rn % {n} = 0
    UNION ALL SELECT auction, window_start, CAST(total // {n} + 1 AS BIGINT), 'DEFAULT', {end} FROM r WHERE rn = 1 AND {end} > 0"""


@query("trig_repeat_count", EARLY.format(ranked=RANKED, n=2, early="2", end="total % 2"))
def trig_repeat_count(t):
    return _early(t, "auction", 2, False)


@query("win_acc_discarding", EARLY.format(ranked=RANKED, n=5, early="5", end="total % 5"))
def win_acc_discarding(t):
    return _early(t, "auction", 5, False)


@query("win_acc_accumulating", EARLY.format(ranked=RANKED, n=5, early="rn", end="total"))
def win_acc_accumulating(t):
    return _early(t, "auction", 5, True)


@query(
    "pageview_counter",
    """WITH r AS (SELECT *, date_trunc('day', ts) AS d, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts)
      ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY user_id, date_trunc('day', ts)) AS total FROM page_view)
    SELECT user_id, epoch_us(d) AS window_start, CAST(rn // 5 AS BIGINT) AS pane, 'EARLY' AS firing_type, 5 AS count FROM r WHERE rn % 5 = 0
    UNION ALL SELECT user_id, epoch_us(d), CAST(total // 5 + 1 AS BIGINT), 'DEFAULT', total % 5 FROM r WHERE rn = 1 AND total % 5 > 0""",
)
def pageview_counter(t):
    out = ops.early_panes(t.page_view, ["user_id"], "ts", "1 day", 5, False)
    return out.withColumns(us("window_start"))


IN_PANE = "epoch_us(fire_ts) <= window_start + 604800000000"
FIRST = f"""f AS (SELECT auction, window_start, first_ts + INTERVAL 1 DAY AS fire_ts,
    count(*) FILTER (date_time <= first_ts + INTERVAL 1 DAY) AS seen, count(*) AS total FROM r GROUP BY ALL)"""


@query(
    "trig_since_first",
    f"WITH {RANKED}, {FIRST} SELECT auction, window_start, epoch_us(fire_ts) AS fire_ts, seen, total FROM f WHERE {IN_PANE}",
)
def trig_since_first(t):
    out = ops.since_first_trigger(t.bid_s, ["auction"], "date_time", WEEK, "1 day")
    return out.withColumns(us("window_start", "fire_ts"))


@query(
    "trig_since_last",
    f"""WITH {RANKED}, g AS (SELECT *, lead(date_time) OVER (PARTITION BY auction, window_start ORDER BY rn) AS nxt FROM r),
    q AS (SELECT auction, window_start, date_time, rn, row_number() OVER (PARTITION BY auction, window_start ORDER BY rn) AS first_gap
      FROM g WHERE nxt IS NULL OR nxt - date_time > INTERVAL 12 HOUR)
    SELECT auction, window_start, epoch_us(date_time + INTERVAL 12 HOUR) AS fire_ts, rn AS seen FROM q
    WHERE first_gap = 1 AND epoch_us(date_time + INTERVAL 12 HOUR) <= window_start + 604800000000""",
)
def trig_since_last(t):
    out = ops.since_last_trigger(t.bid_s, ["auction"], "date_time", WEEK, 12 * 3600)
    return out.withColumns(us("window_start", "fire_ts"))


@query(
    "trig_any",
    f"""WITH {RANKED}, {FIRST}, c AS (SELECT auction, window_start, date_time AS cts FROM r WHERE rn = 3)
    SELECT auction, window_start, epoch_us(CASE WHEN cts <= fire_ts THEN cts ELSE fire_ts END) AS fire_ts,
    CASE WHEN cts <= fire_ts THEN 'count' ELSE 'time' END AS fired_by, CASE WHEN cts <= fire_ts THEN 3 ELSE seen END AS seen
    FROM f LEFT JOIN c USING (auction, window_start) WHERE cts <= fire_ts OR {IN_PANE}""",
)
def trig_any(t):
    out = ops.any_trigger(t.bid_s, ["auction"], "date_time", ORDER, WEEK, 3, "1 day")
    return out.withColumns(us("window_start", "fire_ts"))


WEEK_US = 604_800_000_000
THREE = tr.any_of(tr.count(3), tr.since_first(24 * 3600), tr.since_last(12 * 3600))
# The first firing of each pane, whichever of three comes first.
ANY_THREE = f"""{RANKED}, g AS (SELECT *, lead(date_time) OVER (PARTITION BY auction, window_start ORDER BY rn) AS nxt FROM r),
    c AS (SELECT auction, window_start, any_value(total) AS total, epoch_us(min(date_time) FILTER (rn = 3)) AS cts,
      epoch_us(any_value(first_ts)) + 86400000000 AS fts, count(*) FILTER (date_time <= first_ts + INTERVAL 1 DAY) AS fseen,
      epoch_us(min(date_time) FILTER (nxt IS NULL OR nxt - date_time > INTERVAL 12 HOUR)) + 43200000000 AS lts,
      min(rn) FILTER (nxt IS NULL OR nxt - date_time > INTERVAL 12 HOUR) AS lseen FROM g GROUP BY auction, window_start),
    f AS (SELECT *, window_start + {WEEK_US} AS window_end, least(coalesce(cts, fts), fts, lts) AS fire_ts FROM c),
    e AS (SELECT auction, window_start, window_end, total, fire_ts, fire_ts <= window_end AS early,
      CASE WHEN cts = fire_ts THEN 'count' WHEN fts = fire_ts THEN 'first' ELSE 'last' END AS fired_by,
      CASE WHEN cts = fire_ts THEN 3 WHEN fts = fire_ts THEN fseen ELSE lseen END AS seen FROM f),
    d AS (SELECT *, CASE WHEN early THEN total - seen ELSE total END AS rest FROM e)"""


@query(
    "trig_any_three",
    f"""WITH {ANY_THREE} SELECT auction, window_start, window_end, 1 AS pane, 'EARLY' AS firing_type, fired_by, fire_ts, seen AS count FROM d
    WHERE early UNION ALL SELECT auction, window_start, window_end, CASE WHEN early THEN 2 ELSE 1 END, 'DEFAULT', 'window', window_end, rest
    FROM d WHERE rest > 0""",
)
def trig_any_three(t):
    return tr.fire(ops.in_tumbling(t.bid_s, "date_time", WEEK), ["auction"], "date_time", THREE)


# Where each firing starts counting, by recursion: three messages on, or the first message later than a day after.
REPEAT_ANY = f"""WITH RECURSIVE {RANKED}, g AS (SELECT *, window_start + {WEEK_US} AS window_end, epoch_us(date_time) + 86400000000 AS due,
      epoch_us(lead(date_time, 2) OVER (PARTITION BY auction, window_start ORDER BY rn)) AS cts,
      count(*) OVER (PARTITION BY auction, window_start ORDER BY date_time RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY FOLLOWING) AS upto FROM r),
    n AS (SELECT auction, window_start, window_end, rn, total, CASE WHEN cts <= due THEN 'count' ELSE 'first' END AS fired_by,
      CASE WHEN cts <= due THEN cts ELSE due END AS fire_ts, CASE WHEN cts <= due THEN 3 ELSE upto - rn + 1 END AS seen FROM g),
    chain AS (SELECT *, 1 AS pane FROM n WHERE rn = 1
      UNION ALL SELECT n.*, chain.pane + 1 FROM chain JOIN n ON n.auction = chain.auction AND n.window_start = chain.window_start
      AND n.rn = chain.rn + chain.seen WHERE chain.fire_ts <= chain.window_end),
    d AS (SELECT auction, window_start, any_value(window_end) AS window_end, count(*) AS fired, max(rn + seen) - 1 AS told, any_value(total) AS total
      FROM chain WHERE fire_ts <= window_end GROUP BY auction, window_start)
    SELECT auction, window_start, window_end, pane, 'EARLY' AS firing_type, fired_by, fire_ts, {{early}} AS count FROM chain WHERE fire_ts <= window_end
    UNION ALL SELECT auction, window_start, window_end, coalesce(fired, 0) + 1, 'DEFAULT', 'window', window_end, {{end}}
    FROM (SELECT auction, window_start, window_end, total FROM n WHERE rn = 1) LEFT JOIN d USING (auction, window_start, window_end, total) WHERE {{end}} > 0"""


@query("trig_repeat_any", REPEAT_ANY.format(early="seen", end="total - coalesce(told, 0)"))
def trig_repeat_any(t):
    trigger = tr.repeat(tr.any_of(tr.count(3), tr.since_first(24 * 3600)))
    return tr.fire(ops.in_tumbling(t.bid_s, "date_time", WEEK), ["auction"], "date_time", trigger)


@query("trig_repeat_any_accumulating", REPEAT_ANY.format(early="rn + seen - 1", end="total"))
def trig_repeat_any_accumulating(t):
    trigger = tr.repeat(tr.any_of(tr.count(3), tr.since_first(24 * 3600)))
    return tr.fire(ops.in_tumbling(t.bid_s, "date_time", WEEK), ["auction"], "date_time", trigger, accumulating=True)


# Sessions of six hours' gap, each message with its number in its session.
SESSIONS = """WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM g),
    n AS (SELECT user_id, epoch_us(ts) AS ts, row_number() OVER (PARTITION BY user_id, sid ORDER BY ts, event_id) AS rn,
      count(*) OVER (PARTITION BY user_id, sid) AS total, epoch_us(min(ts) OVER (PARTITION BY user_id, sid)) AS window_start,
      epoch_us(max(ts) OVER (PARTITION BY user_id, sid) + INTERVAL 6 HOUR) AS window_end FROM s)"""
SESSION_EARLY = f"""{SESSIONS} SELECT user_id, window_start, CAST(rn // 2 AS BIGINT) AS pane, 'EARLY' AS firing_type, 'count' AS fired_by, ts AS fire_ts,
    2 AS count FROM n WHERE rn % 2 = 0 UNION ALL SELECT user_id, window_start, CAST(total // 2 + 1 AS BIGINT), 'DEFAULT', 'window', window_end, total % 2
    FROM n WHERE rn = 1 AND total % 2 > 0"""


@query("win_session_early", SESSION_EARLY)
def win_session_early(t):
    tagged = ops.in_sessions(t.events, "ts", 6 * 3600, ["user_id"])
    return tr.fire(tagged, ["user_id"], "ts", tr.repeat(tr.count(2))).drop("window_end")


@query(
    "win_periodic_count",
    "SELECT epoch_us(date_trunc('minute', ts)) AS window_start, count(*) AS n FROM events GROUP BY ALL",
)
def win_periodic_count(t):
    return ops.tumbling(t.events, "ts", "1 minute", [], {"n": rows_seen()}).withColumns(us("window_start")).drop("window_end")


@query("state_last_value", "SELECT user_id, arg_max(event_type, ts) AS last_type, arg_max(value, ts) AS last_value, count(*) AS puts FROM events GROUP BY user_id")
def state_last_value(t):
    last = F.max_by(F.struct("event_type", "value"), F.struct("ts", "event_id"))
    out = t.events.groupBy("user_id").agg(last.alias("v"), rows_seen().alias("puts"))
    return out.select("user_id", F.col("v.event_type").alias("last_type"), F.col("v.value").alias("last_value"), "puts")


@query(
    "state_range",
    "SELECT user_id, max(event_id) AS last_event FROM events WHERE user_id >= 10 AND user_id < 40 GROUP BY user_id",
)
def state_range(t):
    # range(from, to): from is included, to is not. The bounds reach the scan.
    inside = t.events.filter((F.col("user_id") >= 10) & (F.col("user_id") < 40))
    return inside.groupBy("user_id").agg(F.max("event_id").alias("last_event"))


@query(
    "state_slot_stats",
    """SELECT user_id, epoch_us(time_bucket(INTERVAL 5 MINUTE, ts, TIMESTAMP '1970-01-01')) AS slot, count(*) AS n
    FROM events GROUP BY ALL""",
)
def state_slot_stats(t):
    out = ops.tumbling(t.events, "ts", "5 minutes", ["user_id"], {"n": rows_seen()})
    return out.select("user_id", F.unix_micros("window_start").alias("slot"), "n")


@query(
    "state_time_range",
    """SELECT user_id, epoch_us(ts) AS ts, value FROM events WHERE user_id BETWEEN 5 AND 60 AND ts >= TIMESTAMP '2024-01-10'
    AND ts < TIMESTAMP '2024-02-10'""",
)
def state_time_range(t):
    # Several values per (key, time): the series stays as rows, read by key and time range.
    inside = (F.col("ts") >= F.lit("2024-01-10").cast("timestamp")) & (F.col("ts") < F.lit("2024-02-10").cast("timestamp"))
    rows = t.events.filter(F.col("user_id").between(5, 60) & inside)
    return rows.select("user_id", F.unix_micros("ts").alias("ts"), "value")


@query(
    "task_process",
    """SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seen,
    max(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS top FROM events""",
)
def task_process(t):
    # A task that keeps a counter and a maximum per key and answers every message.
    rows = t.events.withColumn("cents", F.round(F.col("value") * 100).cast("bigint"))
    out = running(rows, ["user_id"], ["ts", "event_id"], at("ts", "event_id"), {"seen": ("count", "event_id"), "top": ("max", "cents")})
    return out.select("event_id", "user_id", "seen", "top")
