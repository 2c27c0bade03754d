"""Sorting, partitioning and selection."""

from __future__ import annotations

import re

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.operators.ordered import Position, number_rows
from tidegate.session import materialized


def range_partitioned(df: DataFrame, parts: int, *order: str) -> DataFrame:
    """Range partitions sorted inside: read in partition order they are totally sorted.
    A hot key is divided as long as the later columns of the order differ."""
    return df.repartitionByRange(parts, *order).sortWithinPartitions(*order)


def total_rank(df: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """1-based place of each row in the total order.

    Range partitions are sorted and numbered inside, and written once; the numbers of rows of the partitions, one
    small row each, are summed up and added. No task sees more than its range.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = materialized(ranged.withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_at", 33)
    counts = numbered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    placed = numbered.withColumn("_part", part).join(offsets, "_part")
    rank = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.select(*df.columns, rank.alias(name))


def sort_report(sorted_df: DataFrame, key: str) -> DataFrame:
    """Check a total sort: rows in all, and places where a row is smaller than the one before.

    Each partition compares neighbours batch by batch; across partitions only the first and
    last key of each are compared, one summary row per partition.
    """
    kind = sorted_df.schema[key].dataType.simpleString()

    def scan(batches):
        first = last = None
        rows = bad = 0
        for batch in batches:
            keys = batch[key]
            if not len(keys):
                continue
            bad += int((keys < keys.shift()).sum()) if keys.dtype != object else sum(
                b < a for a, b in zip(keys, keys.iloc[1:])
            )
            if last is not None and keys.iloc[0] < last:
                bad += 1
            first = keys.iloc[0] if first is None else first
            last, rows = keys.iloc[-1], rows + len(keys)
        if rows:
            yield pd.DataFrame(
                {"part": [TaskContext.get().partitionId()], "first": [first], "last": [last], "rows": [rows], "bad": [bad]}
            )

    parts = sorted_df.select(key).mapInPandas(
        scan, f"part int, first {kind}, last {kind}, rows bigint, bad bigint"
    )
    before = F.lag("last").over(Window.orderBy("part"))
    seams = parts.withColumn("bad", F.col("bad") + F.when(F.col("first") < before, 1).otherwise(0))
    return seams.agg(F.sum("rows").alias("n"), F.sum("bad").alias("out_of_order"))


def row_checksum(df: DataFrame, *cols: str) -> DataFrame:
    """Rows and the sum of the CRC32 of each row's text: equal before and after any reordering."""
    text = F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in cols])
    return df.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.crc32(text.cast("binary")).cast("decimal(38,0)")).alias("checksum")
    )


KEY_SPEC = re.compile(r"^-k(\d+)(?:\.(\d+))?(?:,(\d+)(?:\.(\d+))?)?([nr]*)$")


def key_fields(line: Column, spec: str, separator: str = "\t") -> list[tuple[Column, bool]]:
    """Parse ``-k f[.c][,f[.c]][n][r]`` keys (1-based) into (column, descending) pairs.

    An end position of 0, or none, means the end of the end field; no end field means the
    end of the line. ``n`` compares numbers, ``r`` reverses.
    """
    parts = F.split(line, re.escape(separator), -1)
    result = []
    for item in spec.split():
        found = KEY_SPEC.match(item)
        if not found:
            raise ValueError(f"bad key {item!r}")
        f1, c1, f2, c2, flags = found.groups()
        start, offset = int(f1), int(c1 or 1)
        stop, end = (int(f2) if f2 else None), int(c2 or 0)
        text = F.array_join(F.slice(parts, start, F.size(parts) if stop is None else stop - start + 1), separator)
        if stop is not None and end:
            inner = F.get(parts, F.lit(stop - 1))
            text = text.substr(F.lit(1), F.length(text) - F.greatest(F.length(inner) - end, F.lit(0)))
        text = text.substr(F.lit(offset), F.length(text))
        if "n" in flags:
            number = F.regexp_extract(text, r"^\s*(-?\d*\.?\d*)", 1)
            text = F.coalesce(number.try_cast("double"), F.lit(0.0))
        result.append((text, "r" in flags))
    return result


def sort_by_fields(df: DataFrame, col: str, spec: str, separator: str = "\t") -> DataFrame:
    """Total sort of text lines by key fields; remaining ties in line order."""
    keys = [k.desc() if reverse else k.asc() for k, reverse in key_fields(F.col(col), spec, separator)]
    return df.orderBy(*keys, F.col(col))


def partition_by_fields(df: DataFrame, col: str, spec: str, parts: int, separator: str = "\t") -> DataFrame:
    """Hash partitions of the chosen key fields, so that lines equal in them meet."""
    return df.repartition(parts, *[k for k, _ in key_fields(F.col(col), spec, separator)])


def hash_part(key: Column, parts: int) -> Column:
    return F.pmod(F.hash(key), F.lit(parts))


def rehash_part(key: Column, parts: int) -> Column:
    """A second, independent spread, for keys whose plain hash is uneven."""
    return F.pmod(F.xxhash64(key), F.lit(parts))


def byte_slice(key: Column, left: int = 0, right: int = -1) -> Column:
    """Bytes left..right of a binary key, both included; negative offsets count from the end."""
    size = F.length(key)
    first = F.pmod(F.lit(left) + size, size)
    last = F.pmod(F.lit(right) + size, size)
    return key.substr(first + 1, last - first + 1)


def kth_smallest(df: DataFrame, keys: list[str], value: str, i: int, ties: list[str], pos: Position) -> DataFrame:
    """The row with the i-th smallest value (from 0) of each key.

    For a small i Spark keeps only i + 1 rows per key before the shuffle. For a large one the
    rows are numbered in value order, with hot keys cut into slices.
    """
    if i < 1000:
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(value, *ties))
        return df.withColumn("_rank", rank).filter(F.col("_rank") <= i + 1).filter(F.col("_rank") == i + 1).drop("_rank")
    return number_rows(df, keys, [value, *ties], pos, "_rank").filter(F.col("_rank") == i + 1).drop("_rank")
