"""Batch and stream readers. Every source takes an explicit schema, or has a fixed one."""

from __future__ import annotations

import re
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidegate.operators.ordered import number_rows


def topic_stream(
    spark: SparkSession, servers: str, topics: str, *, pattern: bool = False, static: list[str] = (), start: str = "latest", **options: str
) -> DataFrame:
    """A Kafka topic, or all topics that match a pattern; needs the Kafka connector package.

    ``start`` is earliest or latest, used where there is no checkpoint. A service that speaks
    the Kafka protocol is read the same way, with its security settings in ``options``.
    """
    if pattern:
        not_twice(topics, static)
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
    reader = reader.option("subscribePattern" if pattern else "subscribe", topics).option("startingOffsets", start)
    return reader.options(**options).load()


def file_stream(
    spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet", files_per_batch: int | None = None, glob: str | None = None
) -> DataFrame:
    """A growing folder as a stream. The schema gives event times as ``timestamp``, as watermarks need."""
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


def is_folder(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()


def ordered_files(df: DataFrame, path: str, order: list[str], files: int) -> bool:
    """Write about ``files`` files whose rows follow each other in ``order`` from file to file, with modification times
    in that order: a file stream takes files by these. False if the store does not keep the times."""
    spark = df.sparkSession
    df.repartitionByRange(files, *order).write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    # Names of part files begin with the number of their range.
    parts = sorted((f for f in system.listStatus(where) if f.getPath().getName().startswith("part-")), key=lambda f: int(f.getPath().getName().split("-")[1]))
    first = max((f.getModificationTime() for f in parts), default=0) // 1000 * 1000 - 1000 * len(parts)
    wanted = {f.getPath().getName(): first + 1000 * i for i, f in enumerate(parts)}
    for f in parts:
        system.setTimes(f.getPath(), wanted[f.getPath().getName()], -1)
    return all(f.getModificationTime() == wanted.get(f.getPath().getName(), f.getModificationTime()) for f in system.listStatus(where))


def keep_files(df: DataFrame, whitelist: str = ".*", blacklist: str | None = None) -> DataFrame:
    """Rows of files whose name matches the whitelist and not the blacklist; ``file`` holds the name."""
    named = df.withColumn("file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    kept = named.filter(F.col("file").rlike(f"^(?:{whitelist})$"))
    return kept if blacklist is None else kept.filter(~F.col("file").rlike(f"^(?:{blacklist})$"))


def regex_paths(df: DataFrame, pattern: str, static: list[str] = ()) -> DataFrame:
    """Rows of every stream folder whose name matches; ``stream`` holds the name. A stream that is also
    configured by name would be read twice, so that is an error."""
    not_twice(pattern, static)
    named = df.withColumn("stream", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))
    return named.filter(F.col("stream").rlike(f"^(?:{pattern})$"))


def not_twice(pattern: str, static: list[str]) -> None:
    """Fail if a stream that matches the pattern is also configured by its name."""
    twice = [s for s in static if re.fullmatch(pattern, s)]
    if twice:
        raise ValueError(f"streams configured twice: {twice}")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def text_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """The lines of a folder's files as a stream (column ``value``): files that are there, and those that come."""
    reader = spark.readStream.option("recursiveFileLookup", "true")
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).text(path)


def kv_lines(spark: SparkSession, path: str, separator: str = "\t") -> DataFrame:
    """Lines split at the first separator; without one the whole line is the key and the value is empty."""
    at = F.instr(F.col("value"), separator)
    whole = F.col("value")
    return spark.read.text(path).select(
        F.when(at > 0, whole.substr(F.lit(1), at - 1)).otherwise(whole).alias("key"),
        F.when(at > 0, whole.substr(at + len(separator), F.length(whole))).otherwise("").alias("value"),
    )


def fixed_length(spark: SparkSession, path: str, length: int) -> DataFrame:
    """Binary records of one length, as column ``record``. They go from the input format into rows within the JVM."""
    records = spark.sparkContext._jsc.binaryRecords(path, length)
    rows = spark._jsparkSession.createDataset(records.rdd(), spark._jvm.org.apache.spark.sql.Encoders.BINARY())
    return DataFrame(rows.toDF(), spark).withColumnRenamed("value", "record")


def n_line_groups(spark: SparkSession, path: str, n: int) -> DataFrame:
    """Number the lines of each file and give every ``n`` of them one group: columns file, split, line
    (from 0) and value. A large file is read in blocks, and numbered block by block."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_seq"), "value",
    )
    numbered = number_rows(lines, ["file"], ["_block", "_seq"], F.col("_block"), "_rn")
    line = F.col("_rn") - 1
    return numbered.select("file", F.floor(line / n).alias("split"), line.alias("line"), "value").repartition("file", "split")


def sequence_file(spark: SparkSession, path: str, schema: str, decode: Callable = lambda k, v: (k, v)) -> DataFrame:
    """Key-value container; ``decode`` turns a pair into a row, e.g. to text or to bytes."""
    return spark.sparkContext.sequenceFile(path).map(lambda kv: decode(*kv)).toDF(schema)


def auto_text(spark: SparkSession, path: str) -> DataFrame:
    """Text and sequence files, also side by side, as (key, value) text: each file is told by its first three bytes."""
    of_kind: dict[bool, list[str]] = {True: [], False: []}
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    found = list(system.globStatus(where) or [])
    while found:
        file = found.pop()
        if file.getPath().getName()[0] in "._":
            continue
        if file.isDirectory():
            found += list(system.listStatus(file.getPath()))
            continue
        stream = system.open(file.getPath())
        try:
            head = [stream.read() for _ in range(3)]
        finally:
            stream.close()
        of_kind[head == list(b"SEQ")].append(file.getPath().toString())
    parts = []
    if of_kind[False] or not of_kind[True]:
        parts.append(kv_lines(spark, of_kind[False] or path))
    if of_kind[True]:
        parts.append(sequence_file(spark, ",".join(sorted(of_kind[True])), "key string, value string", lambda k, v: (str(k), str(v))))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


@contextmanager
def packed_reads(spark: SparkSession, split_bytes: int):
    """Inside the block, jobs pack many small files into tasks of about ``split_bytes``. Spark packs by
    default too, up to 128 MB with a charge of 4 MB for each file, but so as to keep all cores busy."""
    wanted = {"spark.sql.files.maxPartitionBytes": str(split_bytes), "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    old = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield spark
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def multi_input(inputs: dict[str, tuple[DataFrame, Callable[[DataFrame], DataFrame]]]) -> DataFrame:
    """Several inputs, each with its own mapper, merged with the input's name in ``input``."""
    parts = [mapper(df).withColumn("input", F.lit(name)) for name, (df, mapper) in inputs.items()]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged


def xml_records(spark: SparkSession, path: str, begin: str, end: str) -> DataFrame:
    """Every text between a begin and an end tag, tags included, also across lines."""
    lines = spark.read.option("lineSep", end).text(path)
    whole = F.concat(F.col("value"), F.lit(end))
    at = F.instr(whole, begin)
    return lines.filter(F.instr(F.col("value"), begin) > 0).select(whole.substr(at, F.length(whole)).alias("record"))


def range_predicates(column: str, low, high, splits: int, has_nulls: bool = False) -> list[str]:
    """Predicates that cover each row exactly once, for a partitioned database read.

    Whole numbers and fractions are cut evenly with the last range closed; booleans by
    value; dates by days. Null bounds select the nulls alone.
    """
    if low is None or high is None:
        return [f"{column} IS NULL"]
    if isinstance(low, bool):
        parts = [f"{column} = {v}" for v in ("FALSE", "TRUE") if (v == "TRUE") in {low, high}]
    elif hasattr(low, "toordinal"):
        days = _cuts(low.toordinal(), high.toordinal(), splits)
        dates = [type(low).fromordinal(d).isoformat()[:10] for d in days[:-1]] + [high.isoformat()]
        parts = _ranges(column, [f"TIMESTAMP '{d}'" for d in dates])
    else:
        parts = _ranges(column, _cuts(low, high, splits))
    return parts + ([f"{column} IS NULL"] if has_nulls else [])


def tagged_splits(df: DataFrame, predicates: list[str]) -> DataFrame:
    """The rows with the number of the split they fall in, as ``split``, in one scan; a row that falls in none, or in
    more than one, is an error."""
    numbers = F.array_compact(F.array(*[F.when(F.expr(p), F.lit(i)) for i, p in enumerate(predicates)]))
    wrong = F.raise_error(F.concat(F.lit("splits of a row: "), F.to_json(numbers)))
    return df.withColumn("split", F.when(F.size(numbers) == 1, F.get(numbers, F.lit(0))).otherwise(wrong.cast("int")))


def _cuts(low, high, splits: int) -> list:
    step = (high - low) / max(splits, 1)
    if isinstance(low, int):
        step = max((high - low) // max(splits, 1), 1)
    cuts = [low]
    while cuts[-1] + step < high and len(cuts) <= splits:
        cuts.append(cuts[-1] + step)
    return [*cuts, high]


def _ranges(column: str, cuts: list) -> list[str]:
    parts = [f"{column} >= {a} AND {column} < {b}" for a, b in zip(cuts[:-2], cuts[1:-1])]
    return [*parts, f"{column} >= {cuts[-2]} AND {column} <= {cuts[-1]}"]


def jdbc_splits(spark: SparkSession, url: str, table: str, predicates: list[str], **properties: str) -> DataFrame:
    """One query per predicate against a database; needs its JDBC driver."""
    return spark.read.jdbc(url, table, predicates=predicates, properties=properties)


def avro_records(spark: SparkSession, path: str) -> DataFrame:
    """Avro files with the file name as partition column; needs the Avro package."""
    return spark.read.format("avro").load(path).withColumn("__partition__", F.col("_metadata.file_name"))


def with_file_partition(df: DataFrame) -> DataFrame:
    """The same column on any file source."""
    return df.withColumn("__partition__", F.col("_metadata.file_name"))


def enum_checked(col: Column, allowed: list[str]) -> Column:
    """An enum as text: a value outside the list fails the job."""
    bad = F.raise_error(F.concat(F.lit("not an allowed value: "), col))
    return F.when(col.isNull() | col.isin(allowed), col).otherwise(bad.cast("string"))
