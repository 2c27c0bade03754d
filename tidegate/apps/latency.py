"""Latency series from executor logs, and attributes of container logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: the form of a log line with an arrival and a completion time in milliseconds.
LATENCY_LINE = r"^stock_id:[^:]*: (\d+) completion_ts: (\d+)"


def epochs(lines: DataFrame, executor: str, col: str, epoch_ms: int = 100, open_end: bool = True) -> DataFrame:
    """Average latency per executor and epoch, counted from the executor's first completion.

    With ``open_end`` the last epoch of an executor is left out, as the log may end within it.
    """
    # Null for any other line: the marker is looked for first, as it is cheaper than the pattern.
    ours = lines.filter(F.col(col).startswith("stock_id:")).select(
        executor, F.regexp_extract(col, LATENCY_LINE, 1).try_cast("bigint").alias("a"),
        F.regexp_extract(col, LATENCY_LINE, 2).try_cast("bigint").alias("c"),
    )
    times = ours.filter("c IS NOT NULL")
    bounds = times.groupBy(executor).agg(F.min("c").alias("first"), F.max("c").alias("last"))
    placed = times.join(bounds, executor).withColumn("epoch", F.expr(f"(c - first) div {epoch_ms}"))
    whole = placed.filter(F.expr(f"epoch < (last - first) div {epoch_ms}")) if open_end else placed
    return whole.groupBy(executor, "epoch").agg(F.avg(F.col("c") - F.col("a")).alias("latency"))


RUN = 10_000


def filled(series: DataFrame, executor: str, starts_at: tuple[int, int] | None = None) -> DataFrame:
    """Linear interpolation between an executor's known epochs, from (0, 0); the last one is not included.
    With ``starts_at`` only runs of epochs that touch this range are filled.

    A window holds one row per known epoch of an executor.
    """
    order = Window.partitionBy(executor).orderBy("epoch")
    spans = series.withColumns(
        {
            "_e": F.coalesce(F.lag("epoch").over(order), F.lit(0).cast("bigint")),
            "_l": F.coalesce(F.lag("latency").over(order), F.lit(0.0)),
        }
    ).filter(F.col("epoch") > F.col("_e"))
    # A gap is cut into runs first, so that no row holds a long array.
    last = F.col("epoch") - 1
    starts = spans.withColumn("_run", F.explode(F.sequence(F.col("_e"), last, F.lit(RUN).cast("bigint"))))
    if starts_at is not None:
        starts = starts.filter((F.col("_run") + RUN > starts_at[0]) & (F.col("_run") < starts_at[1]))
    steps = starts.withColumn("t", F.explode(F.sequence(F.col("_run"), F.least(F.col("_run") + (RUN - 1), last))))
    slope = (F.col("latency") - F.col("_l")) / (F.col("epoch") - F.col("_e"))
    return steps.select(executor, F.col("t").alias("epoch"), (F.col("_l") + (F.col("t") - F.col("_e")) * slope).alias("latency"))


def worst(series: DataFrame) -> DataFrame:
    """Largest latency of any executor per epoch; epochs with none above 0 are left out."""
    return series.groupBy("epoch").agg(F.max("latency").alias("latency")).filter("latency > 0")


def resampled(series: DataFrame, start: int, end: int, granularity: int) -> DataFrame:
    """Epochs strictly between the bounds that are multiples of the granularity."""
    epoch = F.col("epoch")
    return series.filter((epoch > start) & (epoch < end) & (epoch % granularity == 0))


def log_attributes(lines: DataFrame, group: str, number: str, col: str) -> DataFrame:
    """Per log group: the first application name, memory and core tags found in it."""
    def first(pattern: str, marker: str):
        found = F.col(col).contains(marker) & (F.regexp_extract(col, pattern, 0) != "")
        return F.min_by(F.when(found, F.regexp_extract(col, pattern, 0)), F.when(found, F.col(number)))

    out = lines.groupBy(group).agg(
        first(r"nexmark-q\d", "system config").alias("app"),
        first(r"memory:\d+", "executor configure resource").alias("memory"),
        first(r"vCores:\d+", "executor configure resource").alias("cores"),
    )
    return out.filter(F.col("memory").isNotNull() & F.col("cores").isNotNull())
