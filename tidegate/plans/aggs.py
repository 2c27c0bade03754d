"""Aggregation queries."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import functions as F

from tidegate.operators import aggs as ops
from tidegate.operators.ordered import at
from tidegate.operators.scans import fold_ordered
from tidegate.registry import query

K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


def k():
    return F.get_json_object("props", "$.k").cast("bigint")


@query(
    "agg_fold",
    """SELECT bidder, 100 + count(*) AS n, 1000 + CAST(sum(price) AS BIGINT) AS total FROM bid_s GROUP BY bidder""",
)
def agg_fold(t):
    return ops.fold(t.bid_s, ["bidder"], {"n": 100, "total": 1000}, {"n": F.count(F.lit(1)), "total": F.sum("price")})


@query(
    "agg_fold_max",
    """SELECT bidder, greatest(50000, max(price)) AS top, least(300, min(price)) AS low FROM bid_s GROUP BY bidder""",
)
def agg_fold_max(t):
    return ops.fold(
        t.bid_s, ["bidder"], {"top": 50000, "low": 300}, {"top": F.max("price"), "low": F.min("price")},
        {"top": F.greatest, "low": F.least},
    )


@query(
    "agg_double_sum_small",
    """SELECT user_id, round(sum(value / 1e9) * 1e6, 6) AS total FROM events GROUP BY user_id""",
)
def agg_double_sum_small(t):
    tiny = t.events.withColumn("tiny", F.col("value") / 1e9)
    total = F.round(ops.AGGREGATORS["DoubleValueSum"]("tiny") * 1e6, 6)
    return tiny.groupBy("user_id").agg(total.alias("total"))


@query("agg_long_sum", "SELECT auction, CAST(sum(price) AS BIGINT) AS total FROM bid_s GROUP BY auction")
def agg_long_sum(t):
    return t.bid_s.groupBy("auction").agg(ops.AGGREGATORS["LongValueSum"]("price").alias("total"))


@query(
    "agg_double_sum",
    """SELECT l_suppkey, round(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE), 2) AS total
    FROM lineitem GROUP BY l_suppkey""",
)
def agg_double_sum(t):
    # Rounded, as a sum of doubles depends in its last digits on the order in which parts of a key are merged.
    total = F.round(ops.AGGREGATORS["DoubleValueSum"]("l_extendedprice"), 2)
    return t.lineitem.groupBy("l_suppkey").agg(total.alias("total"))


@query(
    "agg_minmax",
    """SELECT user_id, max(event_id) AS long_max, min(event_id) AS long_min, max(event_type) AS string_max,
    min(event_type) AS string_min FROM events GROUP BY user_id""",
)
def agg_minmax(t):
    a = ops.AGGREGATORS
    return t.events.groupBy("user_id").agg(
        a["LongValueMax"]("event_id").alias("long_max"), a["LongValueMin"]("event_id").alias("long_min"),
        a["StringValueMax"]("event_type").alias("string_max"), a["StringValueMin"]("event_type").alias("string_min"),
    )


@query("agg_uniq", "SELECT l_returnflag, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY l_returnflag")
def agg_uniq(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("n"))


@query(
    "agg_uniq_capped",
    "SELECT l_suppkey, least(count(DISTINCT l_partkey), 15) AS n FROM lineitem GROUP BY l_suppkey",
)
def agg_uniq_capped(t):
    return t.lineitem.groupBy("l_suppkey").agg(ops.uniq_capped("l_partkey", 14).alias("n"))


HIST_SELECT = """SELECT {id}, count(*) AS unique_values, min(n) AS min_count,
    list_sort(list(n))[count(*) // 2 + 1] AS median_count, max(n) AS max_count,
    round(avg(n), 6) AS mean_count, round(stddev_pop(n), 6) AS sd_count FROM c GROUP BY {id}"""


def rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in ("mean_count", "sd_count")})


@query(
    "agg_value_hist",
    f"WITH c AS (SELECT event_type, {K} AS k, count(*) AS n FROM events GROUP BY ALL) " + HIST_SELECT.format(id="event_type"),
)
def agg_value_hist(t):
    return rounded(ops.value_histogram(t.events.select("event_type", k().alias("k")), "event_type", "k"))


@query(
    "agg_descriptor",
    """SELECT 'LongValueSum' AS type, 'qty' AS id, CAST(CAST(sum(l_quantity) AS BIGINT) AS VARCHAR) AS value FROM lineitem
    UNION ALL SELECT 'LongValueMax', 'order', CAST(max(l_orderkey) AS VARCHAR) FROM lineitem
    UNION ALL SELECT 'LongValueMin', 'order_min', CAST(min(l_orderkey) AS VARCHAR) FROM lineitem
    UNION ALL SELECT 'StringValueMax', 'flag', max(l_returnflag) FROM lineitem
    UNION ALL SELECT 'StringValueMin', 'flag_min', min(l_returnflag) FROM lineitem
    UNION ALL SELECT 'UniqValueCount', 'parts', CAST(count(DISTINCT l_partkey) AS VARCHAR) FROM lineitem
    UNION ALL SELECT 'DoubleValueSum', 'price', CAST(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS VARCHAR) FROM lineitem""",
)
def agg_descriptor(t):
    found = ops.by_descriptor(
        t.lineitem,
        {
            "qty": ("LongValueSum", "l_quantity"),
            "order": ("LongValueMax", "l_orderkey"),
            "order_min": ("LongValueMin", "l_orderkey"),
            "flag": ("StringValueMax", "l_returnflag"),
            "flag_min": ("StringValueMin", "l_returnflag"),
            "parts": ("UniqValueCount", "l_partkey"),
            "price": ("DoubleValueSum", "l_extendedprice"),
        },
    )
    hundredths = F.round(F.col("value").cast("double"), 2).cast("decimal(38,2)").cast("string")
    return found.withColumn("value", F.when(F.col("type") == "DoubleValueSum", hundredths).otherwise(F.col("value")))


@query(
    "agg_text_protocol",
    """SELECT 'LongValueSum' AS type, event_type AS id, CAST(count(*) AS VARCHAR) AS value FROM events GROUP BY event_type
    UNION ALL SELECT 'LongValueMax', event_type, CAST(max(user_id) AS VARCHAR) FROM events GROUP BY event_type
    UNION ALL SELECT 'StringValueMin', 'day:' || user_id, min(strftime(ts, '%Y-%m-%d')) FROM events GROUP BY user_id
    UNION ALL SELECT 'UniqValueCount', event_type, CAST(count(DISTINCT user_id) AS VARCHAR) FROM events GROUP BY event_type""",
)
def agg_text_protocol(t):
    # The lines a piped mapper would print, four per event; an id may itself hold a colon.
    lines = t.events.select(
        F.explode(
            F.array(
                F.concat(F.lit("LongValueSum:"), "event_type", F.lit("\t1")),
                F.concat(F.lit("LongValueMax:"), "event_type", F.lit("\t"), F.col("user_id").cast("string")),
                F.concat(F.lit("StringValueMin:day:"), F.col("user_id").cast("string"), F.lit("\t"), F.date_format("ts", "yyyy-MM-dd")),
                F.concat(F.lit("UniqValueCount:"), "event_type", F.lit("\t"), F.col("user_id").cast("string")),
            )
        ).alias("value")
    )
    return ops.text_protocol(lines)


@query(
    "agg_matrix",
    """SELECT l_suppkey, count(*) FILTER (l_returnflag = 'A') AS A, count(*) FILTER (l_returnflag = 'N') AS N,
    count(*) FILTER (l_returnflag = 'R') AS R FROM lineitem GROUP BY l_suppkey""",
)
def agg_matrix(t):
    return ops.count_matrix(t.lineitem, "l_suppkey", "l_returnflag", ["A", "N", "R"])


@query(
    "agg_matrix_margins",
    """SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""",
)
def agg_matrix_margins(t):
    return ops.matrix_margins(t.lineitem, "l_returnflag", "l_linestatus")


@query(
    "udaf_user",
    """SELECT event_type, round(exp(avg(ln(value + 1))) - 1, 6) AS geo_mean FROM events GROUP BY event_type""",
)
def udaf_user(t):
    """A user aggregator: the geometric mean of 1 + value, less 1."""
    out = ops.user_aggregate(
        t.events, "event_type", "value", ["logs", "n"],
        accumulate=lambda v: [float(np.log1p(v).sum()), float(len(v))],
        merge=lambda s: [float(s["logs"].sum()), float(s["n"].sum())],
        finish=F.round(F.exp(F.col("logs") / F.col("n")) - 1, 6),
    )
    return out.withColumnRenamed("result", "geo_mean")


@query(
    "job_counters",
    """SELECT 'input_records' AS counter, count(*) AS value FROM events
    UNION ALL SELECT 'errors', count(*) FILTER (event_type = 'error') FROM events
    UNION ALL SELECT 'null_props', count(*) FILTER (props IS NULL) FROM events
    UNION ALL SELECT 'kept', count(*) FROM events WHERE value > 10""",
)
def job_counters(t):
    from tidegate.functions.counters import counted

    counts = counted(
        t.events,
        {
            "input_records": F.count(F.lit(1)),
            "errors": F.count(F.when(F.col("event_type") == "error", 1)),
            "null_props": F.count(F.when(F.col("props").isNull(), 1)),
        },
        lambda d: d.filter("value > 10"),
        {"kept": F.count(F.lit(1))},
    )
    return t.spark.createDataFrame(sorted(counts.items()), "counter string, value bigint")


@query(
    "agg_fold_ordered",
    """WITH d AS (SELECT user_id, list(CAST(round(value * 100) AS BIGINT) % 21 - 10 ORDER BY ts, event_id) AS steps FROM events GROUP BY user_id)
    SELECT user_id, list_reduce([10] || steps, lambda level, step: greatest(0, least(20, level + step))) AS level FROM d""",
)
def agg_fold_ordered(t):
    # A level that each message moves, but never below 0 or above 20: what it is at the end depends on the order.
    rows = t.events.withColumn("move", F.round(F.col("value") * 100).cast("bigint") % 21 - 10)
    return fold_ordered(
        rows, ["user_id"], ["ts", "event_id"], at("ts", "event_id"), ["move"], 10,
        lambda level, row: np.clip(level + row[0], 0, 20), "bigint", states=list(range(21)), name="level",
    )


@query(
    "agg_fold_text",
    """SELECT user_id, md5(string_agg(event_type || CAST(event_id AS VARCHAR), '>' ORDER BY ts, event_id)) AS path FROM events GROUP BY user_id""",
)
def agg_fold_text(t):
    # A digest over each user's messages in order, fed message by message: a fold of any function and value.
    def fed(digest, row):
        new = digest.copy() if digest else hashlib.md5()
        new.update(f"{'>' if digest else ''}{row[0]}{row[1]}".encode())
        return new

    return fold_ordered(
        t.events, ["user_id"], ["ts", "event_id"], at("ts", "event_id"), ["event_type", "event_id"], None, fed, "string",
        finish=lambda digest: digest.hexdigest(), name="path",
    )
