"""Stateless stream operators and batch mappers as queries."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from tidegate.operators import dataflow as ops
from tidegate.registry import query
from tidegate.session import materialized


@query("op_map", "SELECT event_id, -CAST(floor(value * 100) AS BIGINT) AS negated, upper(event_type) AS kind FROM events")
def op_map(t):
    return t.events.select(
        "event_id", (-F.floor(F.col("value") * 100)).alias("negated"), F.upper("event_type").alias("kind")
    )


@query("op_filter", "SELECT event_id, user_id FROM events WHERE value > 10 AND event_type <> 'error'")
def op_filter(t):
    return t.events.filter("value > 10 AND event_type <> 'error'").select("event_id", "user_id")


@query(
    "op_flat_map",
    """SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
    WHERE line <> ''""",
)
def op_flat_map(t):
    lines = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.filter("line <> ''")


@query(
    "op_merge",
    """SELECT 'view' AS stream, page_id, event_id FROM page_view
    UNION ALL SELECT 'click', page_id, event_id FROM ad_click""",
)
def op_merge(t):
    return ops.merge_all(
        t.page_view.select(F.lit("view").alias("stream"), "page_id", "event_id"),
        t.ad_click.select(F.lit("click").alias("stream"), "page_id", "event_id"),
    )


@query("op_partition_by", "SELECT user_id, 1 AS partitions, count(*) AS n FROM events GROUP BY user_id")
def op_partition_by(t):
    placed = ops.partition_by(t.events.select("user_id"), F.col("user_id"), 16)
    placed = placed.withColumn("part", F.spark_partition_id())
    per_part = placed.groupBy("user_id", "part").agg(F.count(F.lit(1)).alias("n"))
    return per_part.groupBy("user_id").agg(F.count(F.lit(1)).cast("int").alias("partitions"), F.sum("n").alias("n"))


@query(
    "op_broadcast_all",
    """SELECT CAST(part AS INT) AS task, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events, range(8) AS p(part)
    WHERE event_type = 'signup' GROUP BY part""",
)
def op_broadcast_all(t):
    # A control stream that every task of eight sees whole; each tells what it got.
    control = t.events.filter("event_type = 'signup'").select("event_id")
    seen = ops.broadcast_all(control, 8).withColumn("task", F.spark_partition_id())
    return seen.groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query(
    "op_broadcast",
    """SELECT n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""",
)
def op_broadcast(t):
    # Every task gets every message of the control stream, here the nations. There is no
    # hint: Spark broadcasts a side only while it is below its size threshold.
    control = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return t.customer.join(control, "c_nationkey").groupBy("n_name").agg(F.count(F.lit(1)).alias("customers"))


@query(
    "op_fan_out",
    """SELECT 'errors' AS output, event_id FROM events WHERE event_type = 'error'
    UNION ALL SELECT 'large', event_id FROM events WHERE value > 20
    UNION ALL SELECT 'user_even', event_id FROM events WHERE user_id % 2 = 0""",
)
def op_fan_out(t):
    routes = {
        "errors": F.col("event_type") == "error",
        "large": F.col("value") > 20,
        "user_even": F.col("user_id") % 2 == 0,
    }
    return ops.fan_out(t.events, routes).select("output", "event_id")


FIELDS = "concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag, l_linestatus, CAST(l_quantity AS {}))"


@query(
    "map_field_select",
    f"""WITH x AS (SELECT string_split({FIELDS.format('BIGINT')}, '-') AS p FROM lineitem)
    SELECT concat_ws('-', p[7], p[6], p[2], p[3], p[4]) AS key, array_to_string(p, '-') AS val FROM x""",
)
def map_field_select(t):
    lines = t.lineitem.select(F.expr(FIELDS.format("BIGINT")).alias("line"))
    return ops.select_fields(lines, "line", "-", "6,5,1-3:0-").select("key", "val")


@query(
    "map_regex",
    """SELECT m AS match, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[a-z]+(tion|ment)', 1)) AS m
    FROM documents) GROUP BY m""",
)
def map_regex(t):
    found = ops.regex_matches(t.documents, "text", "[a-z]+(tion|ment)", 1)
    return found.groupBy("match").agg(F.count(F.lit(1)).alias("n"))


@query(
    "map_tokens",
    r"""SELECT token, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '[ \t\n\r\f]+')) AS token
    FROM conversations) WHERE token <> '' GROUP BY token""",
)
def map_tokens(t):
    return ops.tokens(t.conversations, "text").groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query("map_inverse", "SELECT user_id AS event_id, event_id AS user_id FROM events")
def map_inverse(t):
    return ops.inverse(t.events, "event_id", "user_id")


@query(
    "map_chain",
    """SELECT upper(event_type) AS kind, 'n=' || count(*) AS total FROM events WHERE value > 5
    GROUP BY event_type HAVING count(*) > 1""",
)
def map_chain(t):
    return ops.chain(
        t.events,
        lambda d: d.filter("value > 5"),
        lambda d: d.select(F.upper("event_type").alias("kind")),
        lambda d: d.groupBy("kind").agg(F.count(F.lit(1)).alias("n")),
        lambda d: d.filter("n > 1"),
        lambda d: d.select("kind", F.concat(F.lit("n="), "n").alias("total")),
    )


@query(
    "fn_lifecycle",
    """SELECT event_type, count(*) AS n, 16 AS opened, 16 AS closed, (SELECT count(*) FROM events) AS seen FROM events GROUP BY event_type""",
)
def fn_lifecycle(t):
    # Sixteen tasks, so sixteen functions are made and closed; each tells how many rows it saw when it is closed.
    context = t.spark.sparkContext
    opened, closed, seen = (context.accumulator(0) for _ in range(3))

    class Upper:
        def __init__(self, part):
            self.rows = 0
            opened.add(1)

        def apply(self, batch):
            self.rows += batch.num_rows
            return pa.RecordBatch.from_arrays([pc.utf8_upper(batch.column(0))], ["kind"])

        def close(self):
            closed.add(1)
            seen.add(self.rows)

    kinds = ops.map_with_lifecycle(t.events.select("event_type").repartition(16), Upper, "kind string")
    done = materialized(kinds, "kinds")
    counted = done.groupBy(F.lower("kind").alias("event_type")).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumns({"opened": F.lit(opened.value), "closed": F.lit(closed.value), "seen": F.lit(seen.value).cast("bigint")})
