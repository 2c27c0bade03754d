"""The operators on streams: the events table read as a file stream, run over all its input."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidegate.apps.stock import session_of
from tidegate.operators import joins, triggers, windows
from tidegate.plans.joins import EPOCH_ROWS, EPOCHS, epoch_of
from tidegate.plans.nexmark import SELECTED, euros
from tidegate.plans.windows import ANY_THREE, SESSIONS, THREE, WEEK
from tidegate.registry import ORACLES, query
from tidegate.session import work_path
from tidegate.sinks.writers import each_batch
from tidegate.sources.catalog import StreamCatalog
from tidegate.sources.readers import file_stream, is_folder, ordered_files
from tidegate.streaming import processors as ps
from tidegate.streaming.harness import run_append, run_update, state_store
from tidegate.views import SCHEMAS

HOUR_US = 3_600_000_000
DAY_MS = 86_400_000
FILES_PER_BATCH = 1_000  # bounds a micro-batch, and with it what a stateful task holds of a key


# The order in which the rows of a table arrive, event time first.
ARRIVAL = {
    "events": ["ts", "event_id"],
    "lineitem": ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_returnflag"],
}


def stream(t, table="events"):
    """A table as a stream, be it one file or a folder of part files.

    Part files of a table are in no order of time. As long as one micro-batch takes them all that does not matter;
    more of them are first copied into files in order of arrival, or rows would come behind the watermark.
    """
    schema, path = StructType.fromDDL(SCHEMAS[table]), f"{t.sf_dir}/{table}.parquet"
    if not is_folder(t.spark, path):
        return file_stream(t.spark, t.sf_dir, schema, files_per_batch=FILES_PER_BATCH, glob=f"{table}.parquet")
    known = t.__dict__.setdefault("_arrivals", {})  # a query that reads the stream twice copies it once
    if table not in known:
        files, per_batch = len(t.table(table).inputFiles()), FILES_PER_BATCH
        if files > per_batch:
            copy = work_path(t.spark, "arrivals")
            if ordered_files(t.table(table).select(schema.names), copy, ARRIVAL[table], files):
                path = copy
            else:
                per_batch = None  # the store keeps no file times: only one micro-batch of all files is right
        known[table] = path, per_batch
    path, per_batch = known[table]
    return file_stream(t.spark, path, schema, files_per_batch=per_batch)


def bids(t):
    return stream(t).select(
        F.get_json_object("props", "$.k").cast("bigint").alias("auction"), F.col("user_id").alias("bidder"),
        F.floor(F.col("value") * 100).alias("price"), F.col("ts").alias("date_time"), "event_id",
    )


def same_as(name):
    """The oracle of the batch query: stream and batch must agree."""
    return ORACLES[name]


@query("src_stream_file", "SELECT event_id, user_id, event_type, value, epoch_us(ts) AS ts FROM events")
def src_stream_file(t):
    rows = stream(t).select("event_id", "user_id", "event_type", "value", F.unix_micros("ts").alias("ts"))
    return run_append(rows)


@query("sink_stream", "SELECT user_id AS key, event_type AS value FROM events WHERE value > 10")
def sink_stream(t):
    return run_append(stream(t).filter("value > 10").select(F.col("user_id").alias("key"), F.col("event_type").alias("value")))


@query("sink_foreach_batch", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def sink_foreach_batch(t):
    from tidegate.sinks.writers import each_batch

    path = work_path(t.spark, "sink")

    def sink(batch, number):
        batch.groupBy("event_type").count().write.mode("overwrite").parquet(f"{path}/batch={number}")

    each_batch(stream(t), sink, work_path(t.spark, "checkpoint")).awaitTermination()
    return t.spark.read.parquet(path).groupBy("event_type").agg(F.sum("count").alias("n"))


@query("nexmark_q1_stream", "SELECT auction, CAST(trunc(CAST(price AS FLOAT) * CAST(0.82 AS FLOAT)) AS BIGINT) AS price, bidder FROM bid_s")
def q1_stream(t):
    return run_append(bids(t).select("auction", euros(F.col("price")).alias("price"), "bidder"))


@query("nexmark_q2_stream", "SELECT event_id, price FROM bid_s WHERE event_id % 1007 = 0 OR event_id % 1020 = 0 OR event_id % 2001 = 0 OR event_id % 2019 = 0 OR event_id % 2087 = 0")
def q2_stream(t):
    hit = F.lit(False)
    for d in SELECTED:
        hit = hit | (F.col("event_id") % d == 0)
    return run_append(bids(t).filter(hit).select("event_id", "price"))


@query("nexmark_q5_stream", "SELECT epoch_us(date_trunc('day', date_time)) AS window_start, auction, count(*) AS n FROM bid_s GROUP BY ALL")
def q5_stream(t):
    counts = windows.tumbling(
        bids(t).withWatermark("date_time", "1 day"), "date_time", "1 day", ["auction"], {"n": F.count(F.lit(1))}
    )
    final = run_update(counts.drop("window_end"), ["window_start", "auction"])
    return final.withColumn("window_start", F.unix_micros("window_start"))


@query(
    "win_session_stream",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR
      THEN 0 ELSE 1 END AS fresh FROM events),
    s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM g)
    SELECT user_id, epoch_us(min(ts)) AS session_start, epoch_us(max(ts) + INTERVAL 6 HOUR) AS session_end, count(*) AS n
    FROM s GROUP BY user_id, sid HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)""",
)
def win_session_stream(t):
    # Append mode: a session appears once the watermark, a day behind, has passed its end.
    found = windows.session_stream(
        stream(t).withWatermark("ts", "1 day"), "ts", "6 hours", ["user_id"], {"n": F.count(F.lit(1))}
    )
    return run_append(found).select(
        "user_id", F.unix_micros("session_start").alias("session_start"), F.unix_micros("session_end").alias("session_end"), "n"
    )


@query(
    "wm_late_drop",
    """SELECT epoch_us(date_trunc('day', ts)) AS window_start, count(*) AS n FROM events
    WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY ALL
    HAVING date_trunc('day', min(ts)) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)""",
)
def wm_late_drop(t):
    # Three micro-batches: the second half of the events in two files, then the first half.
    # Spark drops late rows by the watermark the batch before had, so only the third batch
    # meets one that has passed its windows; all of it is late.
    path = work_path(t.spark, "late")
    events = t.events.select("event_id", "ts", "event_type")
    schema = events.schema
    late = F.col("ts") < F.lit("2024-01-16").cast("timestamp")
    views = F.col("event_type") == "view"
    for i, part in enumerate((~late & views, ~late & ~views, late)):
        events.filter(part).coalesce(1).write.parquet(f"{path}/part={i}")
    counted = windows.tumbling(
        file_stream(t.spark, f"{path}/*", schema, files_per_batch=1).withWatermark("ts", "1 day"),
        "ts", "1 day", [], {"n": F.count(F.lit(1))},
    )
    return run_append(counted).select(F.unix_micros("window_start").alias("window_start"), "n")


@query("stream_eos", "SELECT count(*) AS n, max(event_id) AS last_id, true AS ended FROM events")
def stream_eos(t):
    # A bounded input ends the stream by itself; what it wrote is then complete.
    path, checkpoint = work_path(t.spark, "eos"), work_path(t.spark, "checkpoint")
    run = (
        stream(t).select("event_id").writeStream.format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    run.awaitTermination()
    ended = not run.isActive
    out = t.spark.read.parquet(path)
    return out.agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_id"), F.lit(ended).alias("ended"))


@query(
    "join_interval_stream",
    """SELECT v.page_id, v.event_id AS view_id, c.event_id AS click_id FROM page_view v JOIN ad_click c
    ON v.page_id = c.page_id AND c.ts BETWEEN v.ts - INTERVAL 6 HOUR AND v.ts + INTERVAL 6 HOUR""",
)
def join_interval_stream(t):
    page = F.get_json_object("props", "$.k").cast("bigint")
    views = stream(t).filter("event_type = 'view'").select(page.alias("page_id"), F.col("event_id").alias("view_id"), F.col("ts").alias("view_ts"))
    clicks = stream(t).filter("event_type = 'click'").select(page.alias("c_page"), F.col("event_id").alias("click_id"), F.col("ts").alias("click_ts"))
    joined = joins.interval_join_stream(
        views.withWatermark("view_ts", "1 day"), clicks.withWatermark("click_ts", "1 day"),
        F.expr("page_id = c_page"), "view_ts", "click_ts", "6 HOURS",
    )
    return run_append(joined.select("page_id", "view_id", "click_id"))


@query("join_stream_table_stream", "SELECT e.event_id, c.c_name AS name FROM events e JOIN customer c ON e.user_id = c.c_custkey")
def join_stream_table_stream(t):
    profiles = t.customer.select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    return run_append(joins.stream_table_join(stream(t).select("event_id", "user_id"), profiles, ["user_id"]).drop("user_id"))


@query(
    "join_ttl_latest_stream",
    """WITH m AS (SELECT page_id, ts, 0 AS side, event_id FROM page_view UNION ALL SELECT page_id, ts, 1, event_id FROM ad_click),
    s AS (SELECT *, last_value(CASE WHEN side = 0 THEN event_id END IGNORE NULLS) OVER w AS lv,
      last_value(CASE WHEN side = 0 THEN ts END IGNORE NULLS) OVER w AS lts,
      last_value(CASE WHEN side = 1 THEN event_id END IGNORE NULLS) OVER w AS rv,
      last_value(CASE WHEN side = 1 THEN ts END IGNORE NULLS) OVER w AS rts
      FROM m WINDOW w AS (PARTITION BY page_id ORDER BY ts, side, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT page_id AS key, epoch_us(ts) AS ts, CASE side WHEN 0 THEN event_id ELSE lv END AS left_id,
    CASE side WHEN 1 THEN event_id ELSE rv END AS right_id FROM s
    WHERE (side = 0 AND rts > ts - INTERVAL 1 DAY) OR (side = 1 AND lts > ts - INTERVAL 1 DAY)""",
)
def join_ttl_latest_stream(t):
    side = F.when(F.col("event_type") == "view", 0).when(F.col("event_type") == "click", 1)
    rows = stream(t).withWatermark("ts", "1 day").select(
        F.get_json_object("props", "$.k").cast("bigint").alias("key"), F.unix_micros("ts").alias("ts"),
        side.alias("side"), F.col("event_id").alias("id"), F.col("ts").alias("at"),
    ).filter("side IS NOT NULL")
    with state_store(t.spark):
        join = ps.LatestTtlJoin(24 * HOUR_US, timers=True)
        return run_append(ps.stateful(rows, ["key"], join, ps.LatestTtlJoin.SCHEMA, timers=True))


@query(
    "pageview_counter_stream",
    """WITH r AS (SELECT user_id, date_trunc('day', ts) AS d, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts)
      ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY user_id, date_trunc('day', ts)) AS total FROM page_view)
    SELECT user_id AS key, epoch_us(d) AS window_start, CAST(rn // 2 AS BIGINT) AS pane, 'EARLY' AS firing_type, 2 AS count FROM r
    WHERE rn % 2 = 0 UNION ALL SELECT user_id, epoch_us(d), CAST(total // 2 + 1 AS BIGINT), 'DEFAULT', total % 2 FROM r
    WHERE rn = 1 AND total % 2 > 0 AND d + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM page_view)""",
)
def pageview_counter_stream(t):
    views = stream(t).filter("event_type = 'view'").withWatermark("ts", "1 day")
    rows = views.select(F.col("user_id").alias("key"), F.unix_micros(F.date_trunc("day", "ts")).alias("window_start"), "ts")
    with state_store(t.spark):
        panes = ps.CountPanes(2, DAY_MS, accumulating=False)
        return run_append(ps.stateful(rows, ["key", "window_start"], panes, ps.CountPanes.SCHEMA, timers=True))


@query(
    "trig_any_stream",
    f"""WITH {ANY_THREE}, m AS (SELECT epoch_us(max(date_time)) - 86400000000 AS mark FROM bid_s)
    SELECT auction AS key, window_start, window_end, 1 AS pane, 'EARLY' AS firing_type, fired_by, fire_ts, seen AS count FROM d, m
    WHERE early AND (fired_by = 'count' OR total > seen OR fire_ts < mark)
    UNION ALL SELECT auction, window_start, window_end, CASE WHEN early THEN 2 ELSE 1 END, 'DEFAULT', 'window', window_end, rest
    FROM d, m WHERE rest > 0 AND window_end <= mark""",
)
def trig_any_stream(t):
    # A timer fires when a later message of its pane or the watermark has passed it.
    rows = windows.in_tumbling(bids(t).withWatermark("date_time", "1 day"), "date_time", WEEK).select(
        F.col("auction").alias("key"), F.unix_micros("window_start").alias("window_start"), F.unix_micros("window_end").alias("window_end"),
        F.unix_micros("date_time").alias("ts"), F.col("date_time").alias("at"),
    )
    with state_store(t.spark):
        panes = ps.TriggerPanes(THREE)
        return run_append(ps.stateful(rows, ["key", "window_start", "window_end"], panes, panes.SCHEMA, timers=True))


@query(
    "win_session_early_stream",
    f"""{SESSIONS}, m AS (SELECT epoch_us(max(ts)) - 86400000000 AS mark FROM events)
    SELECT user_id AS key, window_start, CAST(rn // 2 AS BIGINT) AS pane, 'EARLY' AS firing_type, 'count' AS fired_by, ts AS fire_ts,
    2 AS count FROM n WHERE rn % 2 = 0 UNION ALL SELECT user_id, window_start, CAST(total // 2 + 1 AS BIGINT), 'DEFAULT', 'window', window_end, total % 2
    FROM n, m WHERE rn = 1 AND total % 2 > 0 AND window_end < mark""",
)
def win_session_early_stream(t):
    rows = stream(t).withWatermark("ts", "1 day").select(F.col("user_id").alias("key"), F.unix_micros("ts").alias("ts"), F.col("ts").alias("at"))
    with state_store(t.spark):
        panes = ps.TriggerSessions(triggers.repeat(triggers.count(2)), 6 * HOUR_US)
        return run_append(ps.stateful(rows, ["key"], panes, panes.SCHEMA, timers=True))


@query(
    "state_timer",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 12 HOUR
      THEN 0 ELSE 1 END AS fresh FROM events),
    s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM g),
    q AS (SELECT user_id, sid, min(ts) AS first_ts, max(ts) + INTERVAL 12 HOUR AS fire_ts, count(*) AS n,
      max(sid) OVER (PARTITION BY user_id) AS last_sid FROM s GROUP BY user_id, sid)
    SELECT user_id AS key, epoch_us(first_ts) AS first_ts, epoch_us(fire_ts) AS fire_ts, n FROM q
    WHERE sid < last_sid OR fire_ts < (SELECT max(ts) - INTERVAL 1 DAY FROM events)""",
)
def state_timer(t):
    rows = stream(t).withWatermark("ts", "1 day").select(F.col("user_id").alias("key"), F.unix_micros("ts").alias("ts"), F.col("ts").alias("at"))
    with state_store(t.spark):
        timer = ps.QuietTimer(12 * HOUR_US)
        return run_append(ps.stateful(rows, ["key"], timer, ps.QuietTimer.SCHEMA, timers=True))


@query(
    "wm_callback",
    """SELECT user_id AS key, epoch_us(ts) AS ts, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place
    FROM events WHERE ts < (SELECT max(ts) - INTERVAL 1 DAY FROM events)""",
)
def wm_callback(t):
    rows = stream(t).withWatermark("ts", "1 day").select(
        F.col("user_id").alias("key"), F.unix_micros("ts").alias("ts"), F.col("event_id").alias("id"), F.col("ts").alias("at")
    )
    with state_store(t.spark):
        return run_append(ps.stateful(rows, ["key"], ps.WatermarkCallback(), ps.WatermarkCallback.SCHEMA, timers=True))


@query(
    "task_process_stream",
    """SELECT event_id AS id, user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seen,
    max(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS top FROM events""",
)
def task_process_stream(t):
    rows = stream(t).select(
        F.col("user_id").alias("key"), F.unix_micros("ts").alias("ts"), F.col("event_id").alias("id"),
        F.round(F.col("value") * 100).cast("bigint").alias("v"),
    )
    with state_store(t.spark):
        return run_append(ps.stateful(rows, ["key"], ps.RunningTotals(), ps.RunningTotals.SCHEMA))


@query("state_last_value_stream", "SELECT user_id, arg_max(event_type, ts) AS last_type, count(*) AS puts FROM events GROUP BY user_id")
def state_last_value_stream(t):
    last = F.max_by("event_type", F.struct("ts", "event_id"))
    counted = stream(t).groupBy("user_id").agg(last.alias("last_type"), F.count(F.lit(1)).alias("puts"))
    return run_update(counted, ["user_id"])


@query("stock_match_stream")
def stock_match_stream(t):
    lines = stream(t, "lineitem")
    orders = lines.select(
        F.col("l_suppkey").alias("security"), F.col("l_orderkey").alias("order_no"), F.col("l_linenumber").alias("line"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"), F.col("l_quantity").cast("bigint").alias("volume"),
        F.when(F.col("l_returnflag") == "A", "B").otherwise("S").alias("side"), F.unix_micros("l_shipdate").alias("ts"),
        F.col("l_partkey").alias("part_id"), session_of(F.col("l_shipdate"), None).alias("session"),
    )
    with state_store(t.spark):
        return run_append(ps.stateful(orders, ["security", "session"], ps.MatchOrders(), ps.MatchOrders.SCHEMA))


@query("sql_stream_insert", "SELECT event_id, upper(event_type) AS kind FROM events WHERE value > 10")
def sql_stream_insert(t):
    cat = StreamCatalog(t.spark)
    cat.source("kafka.clicks", stream(t))
    cat.sink("kafka.large")
    cat.insert("INSERT INTO kafka.large SELECT event_id, upper(event_type) AS kind FROM kafka.clicks WHERE value > 10")
    return cat.read("kafka.large")


@query(
    "sql_stream_insert_twice",
    """SELECT event_id, event_type AS kind FROM events WHERE value > 10 UNION ALL
    SELECT event_id, upper(event_type) FROM events WHERE value < 5 UNION ALL SELECT event_id, 'batch' FROM events WHERE event_type = 'view'""",
)
def sql_stream_insert_twice(t):
    # Two streams and a batch into one sink; the last statement once more finds nothing new.
    cat = StreamCatalog(t.spark)
    cat.source("kafka.clicks", stream(t))
    cat.source("store.clicks", t.events)
    cat.sink("kafka.all")
    cat.insert("INSERT INTO kafka.all SELECT event_id, event_type AS kind FROM kafka.clicks WHERE value > 10")
    cat.insert("INSERT INTO kafka.all SELECT event_id, 'batch' AS kind FROM store.clicks WHERE event_type = 'view'")
    for _ in range(2):
        cat.insert("INSERT INTO kafka.all SELECT event_id, upper(event_type) AS kind FROM kafka.clicks WHERE value < 5")
    return cat.read("kafka.all")


@query("sql_stream_upsert", "SELECT user_id AS __key__, arg_max(event_type, event_id) AS last_type FROM events GROUP BY user_id")
def sql_stream_upsert(t):
    # The newest row per key of each micro-batch, put into the table under the batch's number.
    cat = StreamCatalog(t.spark)
    newest = stream(t).groupBy("user_id").agg(F.max_by("event_type", F.col("event_id")).alias("last_type"))
    cat.sink("store.last.$table")
    table = cat.table("store.last.$table")
    rows = newest.select(F.col("user_id").alias("__key__"), "last_type")
    each_batch(rows, lambda b, n: table.put_all(b, batch=n), work_path(t.spark, "checkpoint"), "update").awaitTermination()
    return cat.read("store.last.$table")


@query(
    "sql_stream_upsert_twice",
    """SELECT user_id AS __key__, CASE WHEN max(event_id) FILTER (event_type = 'click') IS NULL THEN arg_max(event_type, (ts, event_id))
    ELSE 'batch' END AS last_type FROM events GROUP BY user_id""",
)
def sql_stream_upsert_twice(t):
    # The last message of each key by its time; then a batch changes some keys; the stream's statement once more has
    # nothing new to put, so the later values stay.
    cat = StreamCatalog(t.spark)
    cat.source("kafka.clicks", stream(t))
    cat.source("store.clicks", t.events)
    cat.sink("store.kinds.$table")
    streamed = """UPSERT INTO store.kinds.$table SELECT user_id AS __key__, event_type AS last_type, struct(ts, event_id) AS __order__ FROM kafka.clicks"""
    cat.insert(streamed)
    cat.insert("UPSERT INTO store.kinds.$table SELECT DISTINCT user_id AS __key__, 'batch' AS last_type FROM store.clicks WHERE event_type = 'click'")
    cat.insert(streamed)
    return cat.read("store.kinds.$table")


@query(
    "nexmark_q8_stream",
    """SELECT DISTINCT p.user_id AS id, epoch_us(date_trunc('day', p.ts)) AS day FROM events p JOIN events a ON p.user_id = a.user_id
    AND date_trunc('day', p.ts) = date_trunc('day', a.ts) WHERE p.event_type = 'signup' AND a.event_type = 'purchase'""",
)
def q8_stream(t):
    # New users who were active in the same window: sign-ups stand in for new persons and
    # purchases for their auctions. Each side is first reduced to one row per (user, window).
    def side(kind, name):
        rows = stream(t).filter(F.col("event_type") == kind).withWatermark("ts", "1 day")
        return rows.select(F.col("user_id").alias(name), F.window("ts", "1 day").alias(f"w_{name}")).dropDuplicates()

    joined = side("signup", "id").join(side("purchase", "buyer"), F.expr("id = buyer AND w_id = w_buyer"))
    return run_append(joined.select("id", F.unix_micros("w_id.start").alias("day")))


@query(
    "nexmark_q11_stream",
    """WITH g AS (SELECT bidder, date_time, CASE WHEN date_time - lag(date_time) OVER (PARTITION BY bidder ORDER BY date_time)
      <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM bid_s),
    s AS (SELECT bidder, date_time, sum(fresh) OVER (PARTITION BY bidder ORDER BY date_time) AS sid FROM g)
    SELECT bidder, epoch_us(min(date_time)) AS session_start, count(*) AS n FROM s GROUP BY bidder, sid
    HAVING max(date_time) + INTERVAL 6 HOUR <= (SELECT max(date_time) - INTERVAL 1 DAY FROM bid_s)""",
)
def q11_stream(t):
    found = windows.session_stream(
        bids(t).withWatermark("date_time", "1 day"), "date_time", "6 hours", ["bidder"], {"n": F.count(F.lit(1))}
    )
    return run_append(found).select("bidder", F.unix_micros("session_start").alias("session_start"), "n")


@query(
    "join_completion_stream",
    """WITH f AS (SELECT user_id, date_trunc('month', ts) AS m, event_type, min(ts) AS seen FROM events GROUP BY ALL)
    SELECT user_id AS key, epoch_us(m) AS epoch, epoch_us(max(seen)) AS completed_at FROM f GROUP BY user_id, m HAVING count(*) = 5""",
)
def join_completion_stream(t):
    parts = stream(t).select(
        F.col("user_id").alias("key"), F.unix_micros(F.date_trunc("month", "ts")).alias("epoch"),
        F.col("event_type").alias("part"), F.unix_micros("ts").alias("ts"),
    )
    with state_store(t.spark):
        return run_append(ps.stateful(parts, ["key", "epoch"], ps.JoinCompletion(5), ps.JoinCompletion.SCHEMA))


@query("join_completion_epochs_stream", f"WITH {EPOCHS} SELECT user_id AS key, {EPOCH_ROWS}")
def join_completion_epochs_stream(t):
    parts = stream(t).withWatermark("ts", "1 day").select(
        F.col("user_id").alias("key"), epoch_of("props").alias("epoch"), F.col("event_type").alias("part"),
        F.unix_micros("ts").alias("ts"), F.col("event_id").alias("id"), F.col("ts").alias("at"),
    )
    with state_store(t.spark):
        machine = ps.CompletionEpochs(3, idle_us=365 * 24 * HOUR_US)
        return run_append(ps.stateful(parts, ["key"], machine, machine.SCHEMA, timers=True))
