"""Per-key ordered computation that holds when one key has most of the rows.

A plain window over ``partitionBy(key)`` puts a whole key into one task. Here a key
with more rows than one task should hold is cut into slices of its order, the
window runs per (key, slice), and what earlier slices contribute (a sum, a last
value, a short tail of rows) comes from one small row per (key, slice). Keys below
the limit take the plain window and pay nothing.

``order`` is a list of column names that orders a key's rows totally. ``pos`` is a
numeric column expression that never decreases along that order; it only decides
where a hot key is cut, and must be exact as a double (below 2**53). Where many rows
may share a position give a pair: the second expression never decreases among rows of
equal first, and cuts those.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidegate.session import rows_per_task

SLICE = "_slice"
Position = Column | tuple[Column, Column]

# Cut points are taken from a quantile sketch, whose size grows with their number. With more rows
# per slice than a task should hold, the window's sort spills; the result is the same.
MAX_SLICES = 16_384


def micros(ts: str) -> Column:
    """Position of a timestamp column."""
    return F.unix_micros(F.col(ts))


def at(ts: str, tie: str) -> Position:
    """Position of a timestamp column, with a numeric column for rows of the same time."""
    return micros(ts), F.col(tie)


def slice_hot_keys(df: DataFrame, keys: list[str], pos: Position) -> tuple[DataFrame, bool]:
    """Add ``_slice``: 0 for ordinary keys, a cut of the order for hot ones.

    The hot keys number at most rows / limit, so the list of them, and the cut points
    (as many again), are safe to hold on the driver and to broadcast. They are fixed
    as literals here, so that every later pass over ``df`` sees the same slices.
    """
    spark = df.sparkSession
    limit = rows_per_task(spark)
    if df.count() <= limit:
        return df.withColumn(SLICE, F.lit(0)), False
    hot = (
        df.groupBy(*[F.col(k).alias(f"_hot_{k}") for k in keys])
        .agg(F.count(F.lit(1)).alias("_hot_n"))
        .filter(F.col("_hot_n") > limit)
    )
    rows = hot.collect()
    if not rows:
        return df.withColumn(SLICE, F.lit(0)), False
    hot_keys = F.broadcast(spark.createDataFrame(rows, hot.schema))  # at most rows / limit of them
    first, tie = pos if isinstance(pos, tuple) else (pos, None)
    tagged = df.withColumn("_pos", first.cast("double")).join(hot_keys, same_keys(keys, "", "_hot_"), "left")
    is_hot = F.col("_hot_n").isNotNull()
    parts = min(-(-sum(r["_hot_n"] for r in rows) // limit) * 2, MAX_SLICES)
    cuts, crowded = _cuts(tagged.filter(is_hot), "_pos", parts)
    sliced = _bucketed(tagged, "_pos", cuts, "_bucket")
    slice_no = F.col("_bucket")
    if tie is not None and crowded:
        # Positions shared by more rows than a slice should hold are cut again by the tie.
        sliced = sliced.withColumn("_tie", F.when(is_hot & F.col("_pos").isin(crowded), tie.cast("double")))
        finer, _ = _cuts(sliced.filter(F.col("_tie").isNotNull()), "_tie", parts)
        sliced = _bucketed(sliced, "_tie", finer, "_sub")
        slice_no = slice_no * (len(finer) + 2) + F.coalesce(F.col("_sub"), F.lit(0))
    sliced = sliced.withColumn(SLICE, F.when(is_hot, slice_no.cast("bigint")).otherwise(0))
    return sliced.select(*df.columns, SLICE), True


def _cuts(df: DataFrame, col: str, parts: int) -> tuple[list[float], list[float]]:
    """Points that cut the rows into about equal parts, and the values that hold more than a part; each
    of those gets a part of its own."""
    found = df.approxQuantile(col, [i / parts for i in range(1, parts)], 1 / (4 * parts))
    crowded = sorted({a for a, b in zip(found, found[1:]) if a == b})
    return sorted({*found, *(math.nextafter(c, math.inf) for c in crowded)}), crowded


def _bucketed(df: DataFrame, col: str, cuts: list[float], out: str) -> DataFrame:
    splits = [float("-inf"), *cuts, float("inf")]
    return Bucketizer(splits=splits, inputCol=col, outputCol=out, handleInvalid="keep").transform(df)


def same_keys(keys: list[str], left: str, right: str) -> Column:
    """Null-safe equality of two prefixed sets of key columns."""
    return reduce(lambda a, b: a & b, [F.col(left + k).eqNullSafe(F.col(right + k)) for k in keys])


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    pos: Position,
    out: dict[str, tuple[str, str]],
    include_current: bool = True,
) -> DataFrame:
    """Running aggregates per key: ``out = {name: (kind, column)}`` with kind one of
    sum, count, min, max, last (the last non-null value)."""
    sliced, split = slice_hot_keys(df, keys, pos)
    end = Window.currentRow if include_current else -1
    frame = (
        Window.partitionBy(*keys, SLICE)
        .orderBy(*[F.col(c).asc_nulls_first() for c in order])
        .rowsBetween(Window.unboundedPreceding, end)
    )
    local = sliced.withColumns({name: _windowed(kind, col).over(frame) for name, (kind, col) in out.items()})
    if not split:
        return local.drop(SLICE)
    carry = sliced.groupBy(*[F.col(k).alias(f"_c_{k}") for k in keys], F.col(SLICE).alias("_c_slice")).agg(
        *[_summary(kind, col, order).alias(f"_c_out_{name}") for name, (kind, col) in out.items()]
    )
    before = (
        Window.partitionBy(*[f"_c_{k}" for k in keys])
        .orderBy("_c_slice")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = carry.withColumns(
        {f"_c_out_{name}": _before(kind, f"_c_out_{name}", before) for name, (kind, _) in out.items()}
    )
    joined = local.join(carry, same_keys(keys, "", "_c_") & (F.col(SLICE) == F.col("_c_slice")), "left")
    joined = joined.withColumns({name: _combine(kind, name) for name, (kind, _) in out.items()})
    return joined.select(*df.columns, *out)


def _windowed(kind: str, col: str) -> Column:
    if kind == "last":
        return F.last(F.col(col), ignorenulls=True)
    return {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}[kind](F.col(col))


def _summary(kind: str, col: str, order: list[str]) -> Column:
    if kind == "last":
        keyed = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col(col).alias("v"))
        return F.max(F.when(F.col(col).isNotNull(), keyed))
    return _windowed(kind, col)


def _before(kind: str, col: str, frame: WindowSpec) -> Column:
    merged = _windowed("sum" if kind == "count" else kind, col).over(frame)
    return merged["v"] if kind == "last" else merged


def _combine(kind: str, name: str) -> Column:
    here, before = F.col(name), F.col(f"_c_out_{name}")
    if kind == "last":
        return F.coalesce(here, before)
    if kind == "min":
        return F.least(here, before)
    if kind == "max":
        return F.greatest(here, before)
    return F.coalesce(here + before, here, before)


def number_rows(df: DataFrame, keys: list[str], order: list[str], pos: Position, name: str = "rn") -> DataFrame:
    """1-based position of each row within its key."""
    return running(df.withColumn("_one", F.lit(1)), keys, order, pos, {name: ("count", "_one")}).drop("_one")


def previous(
    df: DataFrame, keys: list[str], order: list[str], pos: Position, value: str, n: int, name: str = "prev"
) -> DataFrame:
    """Array of the up to ``n`` values before each row in its key, oldest first."""
    sliced, split = slice_hot_keys(df, keys, pos)
    ordering = [F.col(c).asc_nulls_first() for c in order]
    per_slice = Window.partitionBy(*keys, SLICE).orderBy(*ordering)
    boxed = sliced.withColumn("_box", F.struct(F.col(value).alias("v")))
    local = boxed.withColumn(name, F.collect_list("_box").over(per_slice.rowsBetween(-n, -1)))
    if not split:
        return local.withColumn(name, F.transform(name, lambda b: b["v"])).drop("_box", SLICE)
    backwards = Window.partitionBy(*keys, SLICE).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    tails = (
        boxed.withColumn("_back", F.row_number().over(backwards))
        .filter(F.col("_back") <= n)
        .groupBy(*[F.col(k).alias(f"_c_{k}") for k in keys], F.col(SLICE).alias("_c_slice"))
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("_back")).alias("i"), F.col("_box").alias("b")))).alias("t"))
        .withColumn("t", F.transform("t", lambda r: r["b"]))
    )
    # Every slice that exists has a row, so n earlier slices always hold enough.
    earlier = Window.partitionBy(*[f"_c_{k}" for k in keys]).orderBy("_c_slice").rowsBetween(-n, -1)
    tails = tails.withColumn("_tail", F.flatten(F.collect_list("t").over(earlier)))
    joined = local.join(tails, same_keys(keys, "", "_c_") & (F.col(SLICE) == F.col("_c_slice")), "left")
    both = F.concat(F.coalesce(F.col("_tail"), F.array().cast(local.schema[name].dataType)), F.col(name))
    last_n = F.slice(both, F.greatest(F.size(both) - n + 1, F.lit(1)), F.lit(n))
    return joined.withColumn(name, F.transform(last_n, lambda b: b["v"])).select(*df.columns, name)


def moving(
    df: DataFrame, keys: list[str], order: list[str], pos: Position, n: int, out: dict[str, tuple[str, str]]
) -> DataFrame:
    """Aggregates over the last ``n`` rows of the key, the current row included.

    For hot keys the rows are numbered and cut into blocks; the last n-1 rows of a
    block are also given to the next one, so that each block is complete by itself.
    """
    fns = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max, "avg": F.avg}
    limit = rows_per_task(df.sparkSession)
    ordering = [F.col(c).asc_nulls_first() for c in order]
    if df.count() <= limit:
        frame = Window.partitionBy(*keys).orderBy(*ordering).rowsBetween(-(n - 1), 0)
        return df.withColumns({name: fns[kind](col).over(frame) for name, (kind, col) in out.items()})
    size = max(limit, n)
    rn = F.col("_rn") - 1
    own = F.floor(rn / size)
    numbered = number_rows(df, keys, order, pos, "_rn").withColumn("_own", own)
    halo = F.col("_own") != F.floor((rn + n - 1) / size)
    blocks = numbered.withColumn(
        "_block", F.explode(F.when(halo, F.array(F.col("_own"), F.col("_own") + 1)).otherwise(F.array("_own")))
    )
    frame = Window.partitionBy(*keys, "_block").orderBy("_rn").rowsBetween(-(n - 1), 0)
    done = blocks.withColumns({name: fns[kind](col).over(frame) for name, (kind, col) in out.items()})
    return done.filter(F.col("_own") == F.col("_block")).select(*df.columns, *out)
