"""Batch and stream sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def to_topic(df: DataFrame, servers: str, topic: str, checkpoint: str) -> StreamingQuery:
    """Keyed messages (columns key and value) to a Kafka topic; needs the Kafka connector package."""
    writer = df.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic)
    return writer.option("checkpointLocation", checkpoint).start()


def to_console(df: DataFrame) -> None:
    df.write.format("console").mode("append").save()


def date_buckets(df: DataFrame, path: str, ts: str, pattern: str = "yyyy_MM_dd-HH") -> None:
    """Files under one folder per time bucket. All rows of a bucket may be many, so they are
    spread over tasks as they come and each task writes its own file per bucket."""
    df.withColumn("bucket", F.date_format(ts, pattern)).write.mode("append").partitionBy("bucket").parquet(path)


def rolled(df: DataFrame, path: str, records: int, fmt: str = "parquet") -> None:
    """A new file after every ``records`` rows."""
    df.write.mode("append").option("maxRecordsPerFile", records).format(fmt).save(path)


def text_pairs(df: DataFrame, path: str, key: Column, value: Column, separator: str = "\t") -> None:
    """``key SEP value`` lines; a null side drops the separator too, and two nulls write no line."""
    line = F.concat_ws(separator, key.cast("string"), value.cast("string")).alias("value")
    df.filter(key.isNotNull() | value.isNotNull()).select(line).write.mode("append").text(path)


def per_key(df: DataFrame, path: str, *keys: str, fmt: str = "parquet") -> None:
    """One set of files per key."""
    df.write.mode("append").partitionBy(*keys).format(fmt).save(path)


def sequence_file(df: DataFrame, path: str, key: str, value: str) -> None:
    df.select(key, value).rdd.map(lambda r: (r[0], r[1])).saveAsSequenceFile(path)


def binary_sequence_file(df: DataFrame, path: str, key: str, value: str) -> None:
    """Pairs of bytes; a column of another type is written as its bytes. A null becomes no bytes."""
    pair = [F.coalesce(F.col(c).cast("binary"), F.lit(b"")) for c in (key, value)]
    df.select(*pair).rdd.map(tuple).saveAsSequenceFile(path)


def lazy(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """No file for an empty partition: the rows are rebalanced into as many files as they need."""
    df.hint("rebalance").write.mode("append").format(fmt).save(path)


def discard(df: DataFrame) -> None:
    """Run the job and drop its output."""
    df.write.format("noop").mode("overwrite").save()


def sorted_files(df: DataFrame, path: str, key: str, files: int) -> None:
    """Files sorted by key, each with its own range, so that a lookup skips all but one by its bounds."""
    df.repartitionByRange(files, key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def index_documents(df: DataFrame, path: str, index: str, doc_id: Column, routing: Column, source: list[str]) -> None:
    """Upsert documents for a search index, one JSON line each; no id or routing leaves the field out."""
    doc = F.struct(
        F.lit(index).alias("_index"), doc_id.cast("string").alias("_id"), routing.cast("string").alias("_routing"),
        F.struct(*source).alias("_source"),
    )
    df.select(F.to_json(doc).alias("value")).write.mode("append").text(path)


def to_database(df: DataFrame, url: str, table: str, **properties: str) -> None:
    """Insert rows; needs the database's JDBC driver."""
    df.write.jdbc(url, table, mode="append", properties=properties)


def routed(df: DataFrame, routes: dict[str, Column], path: str) -> None:
    """Each message to every output whose predicate holds, in one pass over the input."""
    from tidegate.operators.dataflow import fan_out

    fan_out(df, routes).write.mode("append").partitionBy("output").parquet(path)


def each_batch(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """A custom sink: called with every micro-batch and its number, and again with both after a failure."""
    return (
        df.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
