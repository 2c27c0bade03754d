"""Sort, partition and selection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegate.operators import ordering as ops
from tidegate.operators.ordered import number_rows
from tidegate.registry import query

PARTS = 16


@query(
    "sort_total",
    """SELECT row_number() OVER (ORDER BY l_extendedprice, l_orderkey, l_partkey) AS rank, l_extendedprice, l_orderkey,
    l_partkey FROM lineitem""",
)
def sort_total(t):
    rows = t.lineitem.select("l_extendedprice", "l_orderkey", "l_partkey")
    return ops.total_rank(rows, ["l_extendedprice", "l_orderkey", "l_partkey"])


@query("sort_validate", "SELECT count(*) AS n, CAST(0 AS BIGINT) AS out_of_order FROM lineitem")
def sort_validate(t):
    key = F.format_string("%014.2f%012d", "l_extendedprice", "l_orderkey").alias("key")
    return ops.sort_report(ops.range_partitioned(t.lineitem.select(key), PARTS, "key"), "key")


# CRC32 byte by byte, with its table built from the polynomial; all bytes are ASCII.
CRC_SUM = """WITH RECURSIVE steps AS (SELECT i AS byte, i AS c, 0 AS k FROM range(256) r(i)
      UNION ALL SELECT byte, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
    crc AS (SELECT list(c ORDER BY byte) AS tab FROM steps WHERE k = 8),
    bytes AS (SELECT list_prepend(4294967295, [CAST(ord(x) AS BIGINT) FOR x IN string_split({text}, '')]) AS b FROM lineitem),
    sums AS (SELECT xor(list_reduce(b, lambda c, x: xor(c >> 8, tab[CAST(xor(c & 255, x) AS BIGINT) + 1])), 4294967295) AS v FROM bytes, crc)
    SELECT count(*) AS n, CAST(sum(v) AS VARCHAR) AS checksum FROM sums"""


@query(
    "sort_checksum",
    CRC_SUM.format(
        text="""concat_ws(chr(1), l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT),
        epoch_us(CAST(l_shipdate AS TIMESTAMP)))"""
    ),
)
def sort_checksum(t):
    rows = t.lineitem.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"),
        F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("shipped"),
    )
    return ops.row_checksum(rows, *rows.columns).withColumn("checksum", F.col("checksum").cast("string"))


LINE = "concat_ws(' ', l_returnflag, CAST(l_quantity AS BIGINT), CAST(round(l_extendedprice * 100) AS BIGINT), l_orderkey)"


@query(
    "sort_key_fields",
    f"""WITH x AS (SELECT {LINE} AS line, CAST(l_quantity AS BIGINT) AS q, l_returnflag AS f,
      substr(CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR), 2, 2) AS mid FROM lineitem)
    SELECT row_number() OVER (ORDER BY CAST(mid AS BIGINT), q DESC, line) AS rank, line FROM x""",
)
def sort_key_fields(t):
    lines = t.lineitem.select(F.expr(LINE).alias("line"))
    (mid, _), (qty, _) = ops.key_fields(F.col("line"), "-k3.2,3.3n -k2,2nr", " ")
    keyed = lines.select("line", mid.alias("k1"), (-qty).alias("k2"))
    return ops.total_rank(keyed, ["k1", "k2", "line"]).select("rank", "line")


def _spread(placed, key):
    """Partitions each key was seen in, and its rows."""
    return placed.groupBy(key, "part").agg(F.count(F.lit(1)).alias("n")).groupBy(key).agg(
        F.count(F.lit(1)).alias("partitions"), F.sum("n").alias("n")
    )


@query(
    "part_key_fields",
    """SELECT l_returnflag || ' ' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS key, CAST(1 AS BIGINT) AS partitions, count(*) AS n
    FROM lineitem GROUP BY ALL""",
)
def part_key_fields(t):
    lines = t.lineitem.select(F.expr(LINE).alias("line"))
    placed = ops.partition_by_fields(lines, "line", "-k1,2", PARTS, " ").withColumn("part", F.spark_partition_id())
    return _spread(placed.withColumn("key", F.substring_index("line", " ", 2)), "key")


@query("part_hash", "SELECT l_suppkey, CAST(1 AS BIGINT) AS partitions, count(*) AS n, true AS in_range FROM lineitem GROUP BY l_suppkey")
def part_hash(t):
    placed = t.lineitem.select(
        "l_suppkey", ops.hash_part(F.col("l_suppkey"), PARTS).alias("h"), ops.rehash_part(F.col("l_suppkey"), PARTS).alias("r")
    )
    both = placed.withColumn("part", F.struct("h", "r"))
    counts = both.groupBy("l_suppkey", "part").agg(F.count(F.lit(1)).alias("n"))
    good = F.col("part.h").between(0, PARTS - 1) & F.col("part.r").between(0, PARTS - 1)
    return counts.groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("partitions"), F.sum("n").alias("n"), F.bool_and(good).alias("in_range")
    )


@query(
    "part_binary_slice",
    """SELECT substr(c_name, length(c_name) - 3, 3) AS slice, CAST(1 AS BIGINT) AS partitions, count(*) AS n FROM customer GROUP BY ALL""",
)
def part_binary_slice(t):
    cut = ops.byte_slice(F.col("c_name").cast("binary"), -4, -2)
    placed = t.customer.select(cut.cast("string").alias("slice"), ops.hash_part(cut, PARTS).alias("part"))
    return _spread(placed, "slice")


@query("part_by_id", "SELECT l_linenumber AS id, true AS placed, count(*) AS n FROM lineitem GROUP BY l_linenumber")
def part_by_id(t):
    lines = t.lineitem.select(F.col("l_linenumber").alias("id"))
    placed = lines.repartitionById(PARTS, F.col("id")).withColumn("placed", F.spark_partition_id() == F.col("id"))
    return placed.groupBy("id").agg(F.bool_and("placed").alias("placed"), F.count(F.lit(1)).alias("n"))


@query(
    "sort_secondary",
    """SELECT bidder, row_number() OVER (PARTITION BY bidder ORDER BY price, event_id) AS seq, price, event_id FROM bid_s""",
)
def sort_secondary(t):
    rows = t.bid_s.select("bidder", "price", "event_id")
    return number_rows(rows, ["bidder"], ["price", "event_id"], (F.col("price"), F.col("event_id")), "seq")


@query(
    "sort_kth",
    """SELECT l_suppkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice)
    AS rn FROM lineitem) WHERE rn = 8""",
)
def sort_kth(t):
    rows = t.lineitem.select("l_suppkey", "l_extendedprice", "l_orderkey")
    return ops.kth_smallest(rows, ["l_suppkey"], "l_extendedprice", 7, ["l_orderkey"],
        (F.col("l_extendedprice"), F.col("l_orderkey"))).drop("l_orderkey")
