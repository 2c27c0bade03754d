"""The logical streams and tables the queries run on, as Spark views over the given
parquet tables, each with the DuckDB text of the same definition."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# Schemas of the given tables. Being explicit, a read starts no job to infer them. Times without
# zone are read as instants (in UTC) by the scan itself, so time filters reach it.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": """o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp,
        o_orderpriority string""",
    "lineitem": """l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,
        l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string,
        l_shipdate timestamp""",
    "events": "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

# Same text for both engines unless a pair (spark, duckdb) is given.
VIEWS: dict[str, str | tuple[str, str]] = {
    "bid": """SELECT l_orderkey AS auction, l_suppkey AS bidder,
        CAST(floor(l_extendedprice) AS BIGINT) AS price, l_shipdate AS date_time FROM lineitem""",
    "auction": """SELECT o_orderkey AS id, o_custkey AS seller, o_orderpriority AS category,
        o_orderdate AS date_time FROM orders""",
    "person": """SELECT c.c_custkey AS id, c.c_name AS name, c.c_mktsegment AS city, n.n_name AS state,
        o.date_time FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
        JOIN (SELECT o_custkey, min(o_orderdate) AS date_time FROM orders GROUP BY o_custkey) o
        ON o.o_custkey = c.c_custkey""",
    "bid_s": (
        """SELECT CAST(get_json_object(props, '$.k') AS BIGINT) AS auction, user_id AS bidder,
        CAST(floor(value * 100) AS BIGINT) AS price, ts AS date_time, event_id FROM events""",
        """SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS auction, user_id AS bidder,
        CAST(floor(value * 100) AS BIGINT) AS price, ts AS date_time, event_id FROM events""",
    ),
    "page_view": (
        """SELECT CAST(get_json_object(props, '$.k') AS BIGINT) AS page_id, user_id, ts, event_id
        FROM events WHERE event_type = 'view'""",
        """SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS page_id, user_id, ts, event_id
        FROM events WHERE event_type = 'view'""",
    ),
    "ad_click": (
        """SELECT CAST(get_json_object(props, '$.k') AS BIGINT) AS page_id, user_id AS ad_id, ts, event_id
        FROM events WHERE event_type = 'click'""",
        """SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS page_id, user_id AS ad_id, ts, event_id
        FROM events WHERE event_type = 'click'""",
    ),
    "order_line": "SELECT o_orderkey AS order_id, o_custkey AS cust, o_orderdate AS ts FROM orders",
    "shipment": "SELECT l_orderkey AS order_id, min(l_shipdate) AS ts FROM lineitem GROUP BY l_orderkey",
    "reading": "SELECT user_id AS device, value, ts, event_id FROM events",
    "vehicle_report": (
        """SELECT user_id AS vehicle, CAST(get_json_object(props, '$.k') AS BIGINT) % 3 AS position,
        ts, event_id FROM events""",
        """SELECT user_id AS vehicle, CAST(json_extract_string(props, '$.k') AS BIGINT) % 3 AS position,
        ts, event_id FROM events""",
    ),
    "state_seq": "SELECT user_id AS entity, event_type AS state, ts, event_id FROM events",
    "stock_order": """SELECT l_suppkey AS security, l_orderkey AS order_no, l_linenumber AS line,
        CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, CAST(l_quantity AS BIGINT) AS volume,
        CASE WHEN l_returnflag = 'A' THEN 'B' ELSE 'S' END AS side, l_shipdate AS ts, l_partkey AS part_id
        FROM lineitem""",
}


class Tables:
    """Attribute access to the given tables and to the views above."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        text = VIEWS[name]
        text = text[0] if isinstance(text, tuple) else text
        used = [t for t in TABLES if re.search(rf"\b{t}\b", text)]
        return self.spark.sql(
            re.sub(r"\b(" + "|".join(used) + r")\b", r"{\1}", text), **{t: self.table(t) for t in used}
        )

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return self.view(name)
        if name in TABLES:
            return self.table(name)
        raise AttributeError(name)


def duckdb_sql(text: str) -> str:
    """Prefix an oracle text with the definitions of the views it names."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", text)]
    ctes = [f"{v} AS ({VIEWS[v][1] if isinstance(VIEWS[v], tuple) else VIEWS[v]})" for v in used]
    if not ctes:
        return text.strip()
    body = text.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {', '.join(ctes)}, {body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {', '.join(ctes)}, {body[5:]}"
    return f"WITH {', '.join(ctes)} {body}"
