"""Sources and sinks: each query writes the given tables in a format and reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegate.registry import query
from tidegate.session import materialized, work_path
from tidegate.sinks import writers
from tidegate.sinks.tables import KeyedTable
from tidegate.sources import readers
from tidegate.streaming.harness import run_append

LINES_FILE_BYTES = 128_000_000  # most, about, of a file of lines: a task writes one, and a micro-batch reads one

TYPES_SQL = "SELECT event_type, event_id FROM events"


def by_type(t):
    """Events as one folder of files per event type."""
    path = work_path(t.spark, "topics")
    writers.per_key(t.events.select("event_id", "user_id", "event_type"), path, "event_type")
    return path


@query("src_regex_paths", "SELECT 'event_type=' || event_type AS stream, event_id, user_id FROM events WHERE event_type IN ('click', 'purchase')")
def src_regex_paths(t):
    rows = t.spark.read.schema("event_id bigint, user_id bigint").option("recursiveFileLookup", "true").parquet(by_type(t))
    kept = readers.regex_paths(rows, "event_type=(click|purch.*)")
    return kept.select(F.regexp_replace("stream", "%3D", "=").alias("stream"), "event_id", "user_id")


@query("src_file_whitelist", "SELECT n_name AS name, count(*) AS n FROM nation, region WHERE n_regionkey = r_regionkey GROUP BY n_name")
def src_file_whitelist(t):
    # The folder of given tables is the stream: keep the files of two of them.
    rows = t.spark.read.schema("n_name string, n_regionkey int, r_regionkey int").parquet(f"{t.sf_dir}/nation.parquet", f"{t.sf_dir}/region.parquet", f"{t.sf_dir}/supplier.parquet")
    kept = readers.keep_files(rows, "(nation|region|supplier).*", "supp.*")
    nations = kept.filter(F.col("file").startswith("nation")).select("n_name", "n_regionkey")
    regions = kept.filter(F.col("file").startswith("region")).select("r_regionkey")
    joined = nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy(F.col("n_name").alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query("src_file_partition_col", "SELECT 'events.parquet' AS __partition__, event_id FROM events")
def src_file_partition_col(t):
    return readers.with_file_partition(t.spark.read.parquet(f"{t.sf_dir}/events.parquet")).select("__partition__", "event_id")


@query("src_text_lines", "SELECT line, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY line")
def src_text_lines(t):
    path = work_path(t.spark, "lines")
    t.documents.select("text").write.text(path)
    return readers.text_lines(t.spark, path).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "src_kv_lines",
    """SELECT CASE WHEN event_type = 'error' THEN 'error' ELSE event_type || '-' || user_id END AS key,
    CASE WHEN event_type = 'error' THEN '' ELSE event_id || chr(9) || 'x' END AS value FROM events""",
)
def src_kv_lines(t):
    path = work_path(t.spark, "kv")
    key = F.when(F.col("event_type") == "error", "error").otherwise(F.concat_ws("-", "event_type", F.col("user_id").cast("string")))
    value = F.when(F.col("event_type") != "error", F.concat_ws("\t", F.col("event_id").cast("string"), F.lit("x")))
    writers.text_pairs(t.events, path, key, value)
    return readers.kv_lines(t.spark, path)


@query("src_fixed_len", "SELECT event_id, user_id FROM events")
def src_fixed_len(t):
    # Sixteen bytes per record: two zero-padded eight-digit numbers, with no separator.
    path = work_path(t.spark, "fixed")
    record = F.concat(F.lpad(F.col("event_id").cast("string"), 8, "0"), F.lpad(F.col("user_id").cast("string"), 7, "0"))
    t.events.select(record.alias("value")).write.text(path)
    rows = readers.fixed_length(t.spark, path, 16)
    text = F.col("record").cast("string")
    return rows.select(text.substr(1, 8).cast("bigint").alias("event_id"), text.substr(9, 7).cast("bigint").alias("user_id"))


@query(
    "src_nline",
    """SELECT event_id // 1000 AS part, event_id // 100 % 10 AS split, CAST(1 AS BIGINT) AS tasks, count(*) AS n, min(event_id) AS first,
    max(event_id) AS last FROM events GROUP BY ALL""",
)
def src_nline(t):
    # Files of a thousand lines, read in splits of a hundred.
    path = work_path(t.spark, "nline")
    rows = t.events.select(F.expr("event_id div 1000").alias("part"), "event_id").repartition("part")
    rows = rows.sortWithinPartitions("part", "event_id").withColumn("value", F.col("event_id").cast("string")).drop("event_id")
    rows.write.partitionBy("part").text(path)
    groups = readers.n_line_groups(t.spark, path, 100).withColumn("task", F.spark_partition_id())
    number = F.col("value").cast("bigint")
    parts = groups.groupBy("file", "split", "task").agg(
        F.count(F.lit(1)).alias("n"), F.min(number).alias("first"), F.max(number).alias("last")
    )
    merged = parts.groupBy("file", "split").agg(
        F.count(F.lit(1)).alias("tasks"), F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last")
    )
    part = F.regexp_extract("file", r"part=(\d+)", 1).cast("bigint").alias("part")
    return merged.select(part, "split", "tasks", "n", "first", "last")


@query("src_seqfile", "SELECT event_id AS key, event_type AS value FROM events")
def src_seqfile(t):
    path = work_path(t.spark, "seq")
    writers.sequence_file(t.events, path, "event_id", "event_type")
    rows = readers.auto_text(t.spark, path)
    return rows.select(F.col("key").cast("bigint").alias("key"), "value")


@query("sink_seqfile", "SELECT CAST(user_id AS VARCHAR) AS key, event_type || '-' || event_id AS value FROM events")
def sink_seqfile(t):
    path = work_path(t.spark, "seq")
    pairs = t.events.select(F.col("user_id").cast("string").alias("k"), F.concat_ws("-", "event_type", F.col("event_id").cast("string")).alias("v"))
    writers.sequence_file(pairs, path, "k", "v")
    return readers.sequence_file(t.spark, path, "key string, value string")


@query("sink_binary", "SELECT event_id, CAST(user_id AS VARCHAR) AS user_id, event_type AS kind FROM events")
def sink_binary(t):
    # Eight bytes of the number, then text, against the bytes of another text.
    path = work_path(t.spark, "binary")
    pairs = t.events.select(
        F.concat(F.to_binary(F.lpad(F.hex("event_id"), 16, "0"), F.lit("hex")), F.col("user_id").cast("string").cast("binary")).alias("k"),
        F.col("event_type").alias("v"),
    )
    writers.binary_sequence_file(pairs, path, "k", "v")
    rows = readers.sequence_file(t.spark, path, "k binary, v binary")
    number = F.conv(F.hex(F.substring("k", 1, 8)), 16, 10).cast("bigint")
    return rows.select(number.alias("event_id"), F.expr("substring(k, 9)").cast("string").alias("user_id"), F.col("v").cast("string").alias("kind"))


@query("src_stream_text", "SELECT line, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY line")
def src_stream_text(t):
    # Files of lines as a stream, one file in a micro-batch: four, or more where these would be large.
    path = work_path(t.spark, "lines")
    texts = t.documents.select("text")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    texts.repartition(max(4, -(-size // LINES_FILE_BYTES))).write.text(path)
    return run_append(readers.text_stream(t.spark, path, 1)).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


@query("src_combine", "SELECT event_type, count(*) AS n, 40 AS files, true AS packed FROM events GROUP BY event_type")
def src_combine(t):
    # Forty small files, packed into half as many tasks or fewer.
    path = work_path(t.spark, "small")
    t.events.select("event_id", "event_type").repartition(40).write.parquet(path)
    files = t.spark.read.schema("event_id bigint, event_type string").parquet(path)
    total = files.select("_metadata.file_path", "_metadata.file_size").distinct().agg(F.count(F.lit(1)), F.sum("file_size")).first()
    with readers.packed_reads(t.spark, max(1, total[1] // 10)):
        read = materialized(files.select("event_type", F.spark_partition_id().alias("task")), "packed")
    tasks = read.agg(F.count_distinct("task")).first()[0]
    counted = read.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumns({"files": F.lit(total[0]).cast("int"), "packed": F.lit(2 * tasks <= total[0])})


@query(
    "src_multi_input",
    """SELECT 'orders' AS input, o_custkey AS cust, o_totalprice AS amount FROM orders
    UNION ALL SELECT 'customers', c_custkey, c_acctbal FROM customer""",
)
def src_multi_input(t):
    return readers.multi_input(
        {
            "orders": (t.orders, lambda d: d.select(F.col("o_custkey").alias("cust"), F.col("o_totalprice").alias("amount"))),
            "customers": (t.customer, lambda d: d.select(F.col("c_custkey").alias("cust"), F.col("c_acctbal").alias("amount"))),
        }
    )


@query(
    "src_range_splits",
    """SELECT l_orderkey, l_partkey, l_extendedprice, CAST(least((l_orderkey - low) // greatest((high - low) // 8, 1), cuts) AS INTEGER) AS split
    FROM lineitem, (SELECT min(l_orderkey) AS low, max(l_orderkey) AS high,
      least((max(l_orderkey) - min(l_orderkey) - 1) // greatest((max(l_orderkey) - min(l_orderkey)) // 8, 1), 8) AS cuts FROM lineitem)""",
)
def src_range_splits(t):
    # Each split's predicate would be one query against a database; here one scan tells which split a row falls in.
    low, high = t.lineitem.agg(F.min("l_orderkey"), F.max("l_orderkey")).first()
    splits = readers.range_predicates("l_orderkey", low, high, 8, has_nulls=True)
    return readers.tagged_splits(t.lineitem.select("l_orderkey", "l_partkey", "l_extendedprice"), splits)


@query("src_xml_records", "SELECT page_id, url FROM pages")
def src_xml_records(t):
    path = work_path(t.spark, "xml")
    xml = F.concat(
        F.lit("<skip/>\n<page>\n  <id>"), F.col("page_id").cast("string"), F.lit("</id>\n  <url>"),
        F.regexp_replace(F.regexp_replace("url", "&", "&amp;"), "<", "&lt;"), F.lit("</url>\n</page>"),
    )
    t.pages.select(xml.alias("value")).write.text(path)
    found = readers.xml_records(t.spark, path, "<page>", "</page>")
    url = F.regexp_replace(F.regexp_replace(F.regexp_extract("record", "(?s)<url>(.*)</url>", 1), "&lt;", "<"), "&amp;", "&")
    return found.select(F.regexp_extract("record", r"<id>(\d+)</id>", 1).cast("bigint").alias("page_id"), url.alias("url"))


@query(
    "sink_table_upsert",
    """SELECT user_id, arg_max(event_type, event_id) AS last_type, max(event_id) AS event_id FROM events
    WHERE user_id NOT IN (SELECT user_id FROM events WHERE value > 250) GROUP BY user_id""",
)
def sink_table_upsert(t):
    # Three changes: the older half of the events, the newer half, and the deletion of some users.
    table = KeyedTable(t.spark, work_path(t.spark, "table"), ["user_id"])
    last = F.col("event_type").alias("last_type")
    half = t.events.agg(F.max("event_id")).first()[0] // 2
    table.put_all(t.events.filter(F.col("event_id") <= half).select("user_id", last, "event_id"), ["event_id"])
    table.put_all(t.events.filter(F.col("event_id") > half).select("user_id", last, "event_id"), ["event_id"])
    table.delete_all(t.events.filter("value > 250").select("user_id"))
    table.compact()
    return table.read()


@query("sink_date_bucket", "SELECT strftime(ts, '%Y_%m_%d') AS bucket, event_id FROM events")
def sink_date_bucket(t):
    path = work_path(t.spark, "buckets")
    writers.date_buckets(t.events.select("event_id", "ts"), path, "ts", "yyyy_MM_dd")
    return t.spark.read.schema("event_id bigint, bucket string").parquet(path).select("bucket", "event_id")


@query("sink_roll", "SELECT count(*) AS n, true AS within FROM events")
def sink_roll(t):
    path = work_path(t.spark, "rolled")
    writers.rolled(t.events.select("event_id"), path, 500)
    rows = t.spark.read.schema("event_id bigint").parquet(path).withColumn("file", F.col("_metadata.file_name"))
    files = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    return files.agg(F.sum("n").alias("n"), (F.max("n") <= 500).alias("within"))


@query(
    "sink_index_docs",
    """SELECT 'events' AS "_index", CAST(event_id AS VARCHAR) AS "_id", CAST(user_id AS VARCHAR) AS "_routing", event_type, value FROM events""",
)
def sink_index_docs(t):
    path = work_path(t.spark, "index")
    writers.index_documents(t.events, path, "events", F.col("event_id"), F.col("user_id"), ["event_type", "value"])
    doc = F.from_json("value", "_index string, _id string, _routing string, _source struct<event_type: string, value: double>")
    return t.spark.read.text(path).select(doc.alias("d")).select("d._index", "d._id", "d._routing", "d._source.event_type", "d._source.value")


@query(
    "sink_text",
    """SELECT concat_ws(chr(9), CASE WHEN event_type <> 'error' THEN event_type END, CASE WHEN value > 10 THEN user_id END) AS line,
    count(*) AS n FROM events WHERE event_type <> 'error' OR value > 10 GROUP BY line""",
)
def sink_text(t):
    path = work_path(t.spark, "text")
    writers.text_pairs(
        t.events, path, F.when(F.col("event_type") != "error", F.col("event_type")), F.when(F.col("value") > 10, F.col("user_id"))
    )
    return t.spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


@query("sink_multi_output", "SELECT event_type, count(*) AS n, max(event_id) AS last_id FROM events GROUP BY event_type")
def sink_multi_output(t):
    rows = t.spark.read.schema("event_id bigint, user_id bigint, event_type string").parquet(by_type(t))
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_id"))


@query("sink_lazy", "SELECT count(*) AS n, true AS no_empty_file FROM events WHERE event_type = 'click'")
def sink_lazy(t):
    path = work_path(t.spark, "lazy")
    writers.lazy(t.events.repartition(16, "event_type").filter("event_type = 'click'").select("event_id"), path)
    rows = t.spark.read.schema("event_id bigint").parquet(path)
    files = rows.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count(F.lit(1)).alias("n"))
    written = len(rows.inputFiles())
    return files.agg(F.sum("n").alias("n"), (F.count(F.lit(1)) == written).alias("no_empty_file"))


@query("sink_sorted_lookup", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 100 AND 140")
def sink_sorted_lookup(t):
    # The lookup's bounds reach the scan, which skips the files and row groups outside them.
    path = work_path(t.spark, "sorted")
    orders = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    writers.sorted_files(orders, path, "o_orderkey", 8)
    return t.spark.read.schema(orders.schema).parquet(path).filter(F.col("o_orderkey").between(100, 140))


@query(
    "sink_routed",
    """SELECT 'errors' AS output, event_id FROM events WHERE event_type = 'error'
    UNION ALL SELECT 'large', event_id FROM events WHERE value > 20""",
)
def sink_routed(t):
    path = work_path(t.spark, "routed")
    routes = {"errors": F.col("event_type") == "error", "large": F.col("value") > 20}
    writers.routed(t.events.select("event_id", "event_type", "value"), routes, path)
    return t.spark.read.schema("event_id bigint, output string").parquet(path).select("output", "event_id")
