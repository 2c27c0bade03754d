"""Small helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A side of a join with at most this many narrow rows may be broadcast.
BROADCAST_ROWS = 500_000


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one if the table already has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a narrow table of ``rows`` rows if that is few, else leave the join to Spark."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def slices(batches: Iterator[pa.RecordBatch], column: str, chars: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``chars`` bytes of a text column, or one row."""
    for batch in batches:
        sizes = batch.column(batch.schema.get_field_index(column)).nbytes
        step = batch.num_rows if sizes <= chars else max(1, batch.num_rows * chars // sizes)
        for at in range(0, batch.num_rows, step or 1):
            yield batch.slice(at, step)
