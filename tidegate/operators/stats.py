"""Statistics library: per-key summaries as aggregates, with no per-row state."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.operators.ordered import Position, number_rows


def outlier_share(df: DataFrame, keys: list[str], member: str, is_outlier: Column, name: str = "share") -> DataFrame:
    """|distinct outliers| / |distinct members| per key, from one row per (key, member)."""
    members = df.groupBy(*keys, member).agg(F.max(is_outlier.cast("int")).alias("_out"))
    return members.groupBy(*keys).agg((F.sum("_out") / F.count(F.lit(1))).alias(name))


def entropy(df: DataFrame, keys: list[str], value: str, name: str = "entropy") -> DataFrame:
    """Histogram entropy per key in bits: -sum p log2 p, as log2 N - (sum n log2 n) / N."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    total = F.sum("_n")
    bits = F.log2(total) - F.sum(F.col("_n") * F.log2("_n")) / total
    return counts.groupBy(*keys).agg(bits.alias(name))


def entropy_normal(sigma: Column) -> Column:
    """Entropy of a normal distribution, with a tiny sigma in place of 0."""
    s = F.when(sigma == 0, F.lit(0.000001)).otherwise(sigma)
    return 0.5 * F.log(2 * math.pi * math.e * s * s)


def ewma(
    df: DataFrame, keys: list[str], order: list[str], pos: Position, value: str, age: float = 30.0, warmup: int = 10
) -> DataFrame:
    """Exponentially weighted moving average of each key's whole series.

    The average starts as the mean of the first ``warmup`` values and is 0 until there are
    more than that. The recurrence is linear, so the end value is a weighted sum with the
    weight of each row known from its position: an ordinary aggregate with no sequential fold.
    """
    decay = 2 / (age + 1)
    numbered = number_rows(df, keys, order, pos, "_rn")
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    placed = numbered.join(sizes, keys)
    weight = F.when(F.col("_rn") > warmup, decay * F.pow(F.lit(1 - decay), F.col("_size") - F.col("_rn"))).otherwise(
        F.pow(F.lit(1 - decay), F.col("_size") - warmup) / warmup
    )
    total = F.sum(F.col(value) * weight)
    return placed.groupBy(*keys).agg(
        F.when(F.max("_size") > warmup, total).otherwise(F.lit(0.0)).alias("ewma"), F.max("_size").alias("n")
    )


def bins(df: DataFrame, keys: list[str], value: str, width: int) -> DataFrame:
    """Binned histogram: bin = value div width."""
    return df.groupBy(*keys, F.expr(f"{value} div {width}").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")
    )


def confidence_bounds(df: DataFrame, keys: list[str], value: str, width: int, percent: int) -> DataFrame:
    """Bounds that widen by whole bins on both sides of the mean's bin until they cover ``percent``.

    At least one step is taken. The windows run over bins, of which a key has at most its
    value range divided by the width.
    """
    whole = Window.partitionBy(*keys)
    counted = bins(df, keys, value, width).withColumns({"_n": F.sum("n").over(whole), "_sum": F.sum("total").over(whole)})
    mean = F.expr("cast(_sum / _n as bigint)")
    placed = counted.withColumn("_mean", mean).withColumn("_mid", F.expr(f"_mean div {width}"))
    placed = placed.withColumn("_off", F.abs(F.col("bin") - F.col("_mid")))
    # rangeBetween counts both bins at one distance together, as the search does.
    covered = F.sum("n").over(whole.orderBy("_off").rangeBetween(Window.unboundedPreceding, 0))
    placed = placed.withColumns({"_cov": covered, "_limit": F.expr(f"(_n * {percent}) div 100")})
    reach = F.greatest(F.lit(1), F.min(F.when(F.col("_cov") >= F.col("_limit"), F.col("_off"))))
    found = placed.groupBy(*keys).agg(F.first("_mean").alias("mean"), F.first("_mid").alias("_mid"), reach.alias("_reach"))
    half = 0.5 if width > 1 else 0.0
    return found.select(
        *keys, "mean",
        ((F.col("_mid") - F.col("_reach") + half) * width).cast("bigint").alias("low"),
        ((F.col("_mid") + F.col("_reach") + half) * width).cast("bigint").alias("high"),
    )


def seasonal_median(df: DataFrame, keys: list[str], day: str, slot: str, value: str) -> DataFrame:
    """Median of the values at the same slot of all earlier days; 0 where there is none.

    One row per (key, day, slot) goes in; a window holds at most the days of the series.
    """
    earlier = Window.partitionBy(*keys, slot).orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("seasonal_median", F.coalesce(F.expr(f"percentile({value}, 0.5)").over(earlier), F.lit(0.0)))
