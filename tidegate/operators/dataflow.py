"""Stateless stream operators and batch mappers."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce
from typing import Protocol

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge_all(*streams: DataFrame) -> DataFrame:
    """Bag union by column name."""
    return reduce(lambda a, b: a.unionByName(b), streams)


def partition_by(df: DataFrame, key: Column, parts: int) -> DataFrame:
    """Hash repartition by key; every null key lands in one partition."""
    return df.repartition(parts, key)


def broadcast_all(df: DataFrame, parts: int, most_rows: int | None = None) -> DataFrame:
    """Every message to each of ``parts`` partitions: the rows with the number of their partition as ``part``.

    Messages are shuffled, and a task reads its own as a stream, so there may be any number of them. A caller that
    must keep what it gets in memory gives ``most_rows``: a table of more rows is refused. Its first ``most_rows`` + 1
    rows are enough to tell.
    """
    if most_rows is not None and df.limit(most_rows + 1).count() > most_rows:
        raise ValueError(f"more than {most_rows} messages are too many to go to every partition")
    copies = df.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return copies.repartitionById(parts, F.col("part"))


def fan_out(df: DataFrame, routes: dict[str, Column]) -> DataFrame:
    """Copy each message to every output whose predicate holds, in one pass over the input."""
    names = F.array_compact(F.array(*[F.when(p, F.lit(name)) for name, p in routes.items()]))
    return df.withColumn("output", F.explode(names))


def tokens(df: DataFrame, col: str, out: str = "token") -> DataFrame:
    """One row per whitespace-separated token."""
    return df.withColumn(out, F.explode(F.split(F.col(col), r"[ \t\n\r\f]+"))).filter(F.col(out) != "")


def regex_matches(df: DataFrame, col: str, pattern: str, group: int = 0, out: str = "match") -> DataFrame:
    """One row per match of the pattern, taking one group of it."""
    return df.withColumn(out, F.explode(F.regexp_extract_all(F.col(col), F.lit(pattern), F.lit(group))))


def inverse(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.select(F.col(value).alias(key), F.col(key).alias(value))


def chain(df: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Compose mappers and reducers into one plan."""
    return reduce(lambda acc, step: acc.transform(step), steps, df)


def select_fields(df: DataFrame, col: str, separator: str, spec: str) -> DataFrame:
    """Field selection like ``cut``: ``spec`` is key fields ``:`` value fields, e.g. ``6,5,1-3:0-``.

    Fields count from 0. An open range ``n-`` means all from n on, and is allowed in the
    value part only.
    """
    key_spec, _, value_spec = spec.partition(":")
    if re.search(r"\d+-(,|$)", key_spec):
        raise ValueError("an open range may only be used for value fields")
    parts = F.split(F.col(col), re.escape(separator), -1)
    return df.withColumns({"key": _pick(parts, separator, key_spec), "val": _pick(parts, separator, value_spec)})


def _pick(parts: Column, separator: str, spec: str) -> Column:
    pieces = []
    for item in filter(None, spec.split(",")):
        first, dash, last = item.partition("-")
        count = F.size(parts) if dash and not last else F.lit(int(last or first) - int(first) + 1)
        pieces.append(F.slice(parts, int(first) + 1, count))
    return F.array_join(F.concat(*pieces), separator) if pieces else F.lit("")


class Lifecycle(Protocol):
    """A function with a life: made once per task, closed once, also when the task fails or is stopped early."""

    def apply(self, batch: pa.RecordBatch) -> pa.RecordBatch: ...

    def close(self) -> None: ...


def map_with_lifecycle(df: DataFrame, init: Callable[[int], Lifecycle], schema: str) -> DataFrame:
    """Map Arrow batches by a function that ``init`` makes in each task, from the task's partition number. A task that
    gets no rows makes none. A function whose ``init`` fails is not closed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = None
        try:
            for batch in batches:
                if made is None:
                    made = init(TaskContext.get().partitionId())
                yield made.apply(batch)
        finally:
            if made is not None:
                made.close()

    return df.mapInArrow(run, schema)
