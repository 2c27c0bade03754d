"""Join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegate.operators import joins as ops
from tidegate.registry import query

DAY = 86_400

TTL_ORACLE = """WITH m AS (
      SELECT page_id, ts, 0 AS side, event_id, user_id AS u, NULL AS ad FROM page_view
      UNION ALL SELECT page_id, ts, 1, event_id, NULL, ad_id FROM ad_click),
    s AS (SELECT *,
      last_value(CASE WHEN side = 0 THEN event_id END IGNORE NULLS) OVER w AS lv,
      last_value(CASE WHEN side = 0 THEN ts END IGNORE NULLS) OVER w AS lts,
      last_value(CASE WHEN side = 0 THEN u END IGNORE NULLS) OVER w AS lu,
      last_value(CASE WHEN side = 1 THEN event_id END IGNORE NULLS) OVER w AS rv,
      last_value(CASE WHEN side = 1 THEN ts END IGNORE NULLS) OVER w AS rts,
      last_value(CASE WHEN side = 1 THEN ad END IGNORE NULLS) OVER w AS rad
      FROM m WINDOW w AS (PARTITION BY page_id ORDER BY ts, side, event_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query(
    "join_ttl_latest",
    TTL_ORACLE
    + """ SELECT page_id, epoch_us(ts) AS ts, CASE side WHEN 0 THEN event_id ELSE lv END AS view_id,
      CASE side WHEN 1 THEN event_id ELSE rv END AS click_id FROM s
      WHERE (side = 0 AND rts > ts - INTERVAL 1 DAY) OR (side = 1 AND lts > ts - INTERVAL 1 DAY)""",
)
def join_ttl_latest(t):
    joined = ops.latest_ttl_join(t.page_view, t.ad_click, "page_id", "ts", "event_id", DAY)
    return joined.select(
        "page_id", F.unix_micros("ts").alias("ts"), F.col("l.event_id").alias("view_id"),
        F.col("r.event_id").alias("click_id"),
    )


@query(
    "ad_click_join",
    TTL_ORACLE
    + """ SELECT page_id, coalesce(u, lu) AS user_id, coalesce(ad, rad) AS ad_id FROM s
      WHERE (side = 0 AND rts > ts - INTERVAL 6 HOUR) OR (side = 1 AND lts > ts - INTERVAL 6 HOUR)""",
)
def ad_click_join(t):
    joined = ops.latest_ttl_join(t.page_view, t.ad_click, "page_id", "ts", "event_id", 6 * 3600)
    return joined.select("page_id", F.col("l.user_id").alias("user_id"), F.col("r.ad_id").alias("ad_id"))


INTERVAL_ORACLE = """SELECT v.page_id, v.event_id AS view_id, c.event_id AS click_id FROM page_view v {} JOIN ad_click c
    ON v.page_id = c.page_id AND c.ts BETWEEN v.ts - INTERVAL 1 DAY AND v.ts + INTERVAL 1 DAY"""


def _interval(t, how):
    clicks = t.ad_click.select("page_id", F.col("event_id").alias("click_id"), F.col("ts").alias("click_ts"))
    joined = ops.interval_join(t.page_view, clicks, "page_id", "ts", "click_ts", DAY, how)
    return joined.select("page_id", F.col("event_id").alias("view_id"), "click_id")


@query("join_interval", INTERVAL_ORACLE.format(""))
def join_interval(t):
    return _interval(t, "inner")


@query("join_interval_left", INTERVAL_ORACLE.format("LEFT"))
def join_interval_left(t):
    return _interval(t, "left")


@query(
    "order_shipment",
    """SELECT o.order_id, o.cust, epoch_us(s.ts) AS shipped FROM order_line o JOIN shipment s
    ON o.order_id = s.order_id AND s.ts BETWEEN o.ts - INTERVAL 30 DAY AND o.ts + INTERVAL 30 DAY""",
)
def order_shipment(t):
    ships = t.shipment.withColumnRenamed("ts", "shipped")
    joined = ops.interval_join(t.order_line, ships, "order_id", "ts", "shipped", 30 * DAY)
    return joined.select("order_id", "cust", F.unix_micros("shipped").alias("shipped"))


@query(
    "join_stream_table",
    """SELECT e.event_id, c.c_name AS name, c.c_mktsegment AS segment FROM events e
    JOIN customer c ON e.user_id = c.c_custkey""",
)
def join_stream_table(t):
    profiles = t.customer.select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return ops.stream_table_join(t.events.select("event_id", "user_id"), profiles, ["user_id"]).drop("user_id")


def _keyed(t):
    orders = t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"))
    ships = t.shipment.select(F.col("order_id").alias("k"), F.unix_micros("ts").alias("shipped"))
    lines = t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("item"))
    return orders, ships, lines


@query(
    "join_nway_inner",
    """SELECT o_orderkey AS k, o_orderstatus AS status, epoch_us(s.ts) AS shipped, l_linenumber AS line,
    l_partkey AS item FROM orders JOIN shipment s ON s.order_id = o_orderkey JOIN lineitem ON l_orderkey = o_orderkey""",
)
def join_nway_inner(t):
    return ops.merge_join(list(_keyed(t)), "k", "inner")


@query(
    "join_nway_outer",
    """SELECT coalesce(a.k, b.k, c.k) AS k, a.big, b.shipped, c.qty FROM
    (SELECT o_orderkey AS k, count(*) AS big FROM orders WHERE o_totalprice > 300000 GROUP BY 1) a
    FULL JOIN (SELECT order_id AS k, epoch_us(ts) AS shipped FROM shipment) b ON a.k = b.k
    FULL JOIN (SELECT l_orderkey AS k, CAST(sum(l_quantity) AS BIGINT) AS qty FROM lineitem WHERE l_quantity > 40
      GROUP BY 1) c ON coalesce(a.k, b.k) = c.k""",
)
def join_nway_outer(t):
    big = t.orders.filter("o_totalprice > 300000").groupBy(F.col("o_orderkey").alias("k")).agg(F.count(F.lit(1)).alias("big"))
    ships = t.shipment.select(F.col("order_id").alias("k"), F.unix_micros("ts").alias("shipped"))
    qty = t.lineitem.filter("l_quantity > 40").groupBy(F.col("l_orderkey").alias("k")).agg(
        F.sum("l_quantity").cast("bigint").alias("qty")
    )
    return ops.merge_unique([big, ships, qty], "k", "full_outer")


@query(
    "join_override",
    """WITH a AS (SELECT o_orderkey AS k, 'order' AS source, epoch_us(o_orderdate) AS at FROM orders),
    b AS (SELECT l_orderkey AS k, 'line' AS source, epoch_us(l_shipdate) AS at FROM lineitem WHERE l_quantity > 25),
    c AS (SELECT l_orderkey AS k, 'return' AS source, epoch_us(l_shipdate) AS at FROM lineitem WHERE l_returnflag = 'R')
    SELECT * FROM a WHERE k NOT IN (SELECT k FROM b) AND k NOT IN (SELECT k FROM c)
    UNION ALL SELECT * FROM b WHERE k NOT IN (SELECT k FROM c) UNION ALL SELECT * FROM c""",
)
def join_override(t):
    def source(df, key, name, at):
        return df.select(F.col(key).alias("k"), F.lit(name).alias("source"), F.unix_micros(at).alias("at"))

    return ops.override_join(
        [
            source(t.orders, "o_orderkey", "order", "o_orderdate"),
            source(t.lineitem.filter("l_quantity > 25"), "l_orderkey", "line", "l_shipdate"),
            source(t.lineitem.filter("l_returnflag = 'R'"), "l_orderkey", "return", "l_shipdate"),
        ],
        "k",
    )


@query(
    "join_tagged",
    """WITH a AS (SELECT o_custkey AS k, count(*) AS v FROM orders GROUP BY 1),
    b AS (SELECT user_id AS k, count(*) AS v FROM events GROUP BY 1),
    c AS (SELECT c_custkey AS k, CAST(c_nationkey AS BIGINT) AS v FROM customer)
    SELECT k, CAST((a.v IS NOT NULL)::INT + (b.v IS NOT NULL)::INT + (c.v IS NOT NULL)::INT AS INT) AS tags,
    a.v AS orders, b.v AS events, c.v AS nation FROM a FULL JOIN b USING (k) FULL JOIN c USING (k)
    WHERE (a.v IS NOT NULL)::INT + (b.v IS NOT NULL)::INT + (c.v IS NOT NULL)::INT >= 2""",
)
def join_tagged(t):
    n = F.count(F.lit(1)).alias("v")
    return ops.tagged_join(
        {
            "orders": t.orders.groupBy(F.col("o_custkey").alias("k")).agg(n),
            "events": t.events.groupBy(F.col("user_id").alias("k")).agg(n),
            "nation": t.customer.select(F.col("c_custkey").alias("k"), F.col("c_nationkey").cast("bigint").alias("v")),
        },
        "k", "v",
    )


@query(
    "join_completion",
    """WITH f AS (SELECT user_id, date_trunc('month', ts) AS m, event_type, min(ts) AS seen FROM events GROUP BY ALL)
    SELECT user_id, epoch_us(m) AS epoch, epoch_us(max(seen)) AS completed_at FROM f GROUP BY user_id, m
    HAVING count(*) = 5""",
)
def join_completion(t):
    parts = t.events.select("user_id", F.date_trunc("month", "ts").alias("epoch"), "event_type", "ts")
    done = ops.completion_join(parts, "user_id", "epoch", "event_type", "ts", 5)
    return done.select("user_id", F.unix_micros("epoch").alias("epoch"), F.unix_micros("completed_at").alias("completed_at"))


# Epochs that come somewhat out of order: each message's is moved by a part of its own.
EPOCHS = """e AS (SELECT user_id, event_id, ts, event_type, (event_id + 11 * CAST(json_extract_string(props, '$.k') AS BIGINT)) // 1200 AS epoch FROM events),
    m AS (SELECT *, max(epoch) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS newest FROM e),
    f AS (SELECT user_id, epoch, event_type, min((ts, event_id)) AS seen FROM m WHERE epoch = newest GROUP BY ALL),
    r AS (SELECT user_id, epoch, epoch_us(seen[1]) AS seen, row_number() OVER (PARTITION BY user_id, epoch ORDER BY seen) AS place FROM f),
    o AS (SELECT user_id, epoch, min(seen) AS opened, least(max(place), 3) AS parts, min(seen) FILTER (place = 3) AS done FROM r GROUP BY ALL),
    n AS (SELECT *, lead(opened) OVER (PARTITION BY user_id ORDER BY epoch) AS replaced FROM o)"""
EPOCH_ROWS = """epoch, CASE WHEN done IS NULL THEN 'INCOMPLETE' ELSE 'COMPLETED' END AS status, parts, coalesce(done, replaced) AS at
    FROM n WHERE done IS NOT NULL OR replaced IS NOT NULL"""


def epoch_of(props):
    return F.expr(f"(event_id + 11 * CAST(get_json_object({props}, '$.k') AS BIGINT)) div 1200")


@query("join_completion_epochs", f"WITH {EPOCHS} SELECT user_id, {EPOCH_ROWS}")
def join_completion_epochs(t):
    parts = t.events.withColumn("epoch", epoch_of("props"))
    out = ops.completion_epochs(parts, "user_id", "epoch", "event_type", ["ts", "event_id"], "ts", 3)
    return out.withColumn("at", F.unix_micros("at"))


@query(
    "join_tagged_product",
    """WITH a AS (SELECT event_type AS k, event_id FROM events WHERE event_id % 3 > 0), b AS (SELECT event_type AS k, event_id FROM events WHERE user_id = 7),
    c AS (SELECT DISTINCT event_type AS k FROM events WHERE event_type < 'p')
    SELECT k, CAST((a.event_id IS NOT NULL)::INT + (b.event_id IS NOT NULL)::INT + (c.k IS NOT NULL)::INT AS INT) AS tags,
    coalesce(a.event_id, -1) * 1000003 + coalesce(b.event_id, -1) AS pair, c.k IS NOT NULL AS early
    FROM a FULL JOIN b USING (k) FULL JOIN c USING (k)
    WHERE (a.event_id IS NOT NULL)::INT + (b.event_id IS NOT NULL)::INT + (c.k IS NOT NULL)::INT >= 2 AND (a.event_id + b.event_id) % 7 > 0""",
)
def join_tagged_product(t):
    # Five keys with thousands of rows each under one tag, some rows under another and one or none under a third.
    kind = F.col("event_type").alias("k")

    def combine(of):
        a, b = F.coalesce(of["a"]["event_id"], F.lit(-1)), F.coalesce(of["b"]["event_id"], F.lit(-1))
        told = F.struct((a * 1000003 + b).alias("pair"), of["c"].isNotNull().alias("early"))
        return F.when((of["a"]["event_id"] + of["b"]["event_id"]) % 7 > 0, told)

    sources = {
        "a": t.events.filter("event_id % 3 > 0").select(kind, "event_id"), "b": t.events.filter("user_id = 7").select(kind, "event_id"),
        "c": t.events.filter("event_type < 'p'").select(kind).distinct(),
    }
    return ops.tagged_product(sources, "k", combine).select("k", "tags", "result.pair", "result.early")


# Reads by recursion: a miss loads, and the next miss is the first read too late for that.
CACHED = """WITH RECURSIVE v AS (SELECT user_id, event_id, ts FROM events WHERE event_type IN ('view', 'click')),
    w AS (SELECT user_id, event_id, ts, value FROM events WHERE event_type = 'purchase'),
    x AS (SELECT v.user_id, v.event_id, epoch_us(v.ts) AS ts, arg_max(w.value, (w.ts, w.event_id)) AS now FROM v LEFT JOIN w ON w.user_id = v.user_id AND w.ts <= v.ts GROUP BY ALL),
    g AS (SELECT *, CASE WHEN ts - lag(ts) OVER u < 86400000000 THEN 0 ELSE 1 END AS fresh FROM x WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM g),
    n AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS rn FROM s),
    c AS (SELECT user_id, run, rn, event_id, ts, now AS value, false AS hit, CASE WHEN now IS NOT NULL THEN ts END AS loaded_at FROM n WHERE rn = 1
      UNION ALL SELECT n.user_id, n.run, n.rn, n.event_id, n.ts, CASE WHEN coalesce(n.ts < c.loaded_at + 172800000000, false) THEN c.value ELSE n.now END,
      coalesce(n.ts < c.loaded_at + 172800000000, false),
      CASE WHEN coalesce(n.ts < c.loaded_at + 172800000000, false) THEN c.loaded_at WHEN n.now IS NOT NULL THEN n.ts END
      FROM c JOIN n ON n.user_id = c.user_id AND n.run = c.run AND n.rn = c.rn + 1)
    SELECT user_id, ts, event_id, value, hit, loaded_at FROM c"""


@query("table_cached_ttl", CACHED)
def table_cached_ttl(t):
    reads = t.events.filter(F.col("event_type").isin("view", "click")).select("user_id", "ts", "event_id")
    writes = t.events.filter("event_type = 'purchase'").select("user_id", "ts", "event_id", "value")
    return ops.cached_reads(reads, writes, "user_id", "ts", "event_id", "value", write_ttl=2 * DAY, read_ttl=DAY)


@query(
    "table_lookup_distinct",
    """SELECT l_orderkey, l_linenumber, s_name AS supplier FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey""",
)
def table_lookup_distinct(t):
    suppliers = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("supplier"))
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey")
    return ops.lookup_distinct(lines, suppliers, "l_suppkey").drop("l_suppkey")


@query(
    "state_side_input",
    """WITH last AS (SELECT user_id, arg_max(event_type, ts) AS last_type FROM events WHERE event_type <> 'view' GROUP BY 1)
    SELECT v.event_id, v.user_id, l.last_type FROM page_view v JOIN last l ON v.user_id = l.user_id""",
)
def state_side_input(t):
    side = t.events.filter("event_type <> 'view'").select("user_id", "ts", "event_id", "event_type")
    profile = ops.side_input(side, "user_id", "ts", "event_id").select("user_id", F.col("event_type").alias("last_type"))
    return t.page_view.select("event_id", "user_id").join(profile, "user_id")
