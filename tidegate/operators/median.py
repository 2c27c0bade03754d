"""Exact running median of each key's series, also for a key with most of the rows."""

from __future__ import annotations

from heapq import heappush, heappushpop

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidegate.operators.ordered import SLICE, Position, same_keys, slice_hot_keys


def running_median(
    df: DataFrame, keys: list[str], order: list[str], pos: Position, value: str, name: str = "median"
) -> DataFrame:
    """Median of all values of the key up to and including each row; an even count takes the mean
    of the middle two.

    Null values count for nothing: their rows repeat the median so far. Null keys are a key.

    A key that fits a task is folded with two heaps. A hot key is cut into slices of its
    order. A slice of m rows can move the median by at most m places in the values seen
    before it, so besides its own rows it only needs the earlier values ranked within m of
    the middle, and the number of values below those.
    """
    base = df.withColumn(value, F.col(value).cast("double"))
    sliced, split = slice_hot_keys(base, keys, pos)
    schema = StructType([*base.schema.fields, StructField(name, DoubleType())])
    if not split:
        # The number of partitions is fixed, as the work is in Python and small data would be
        # coalesced into few tasks.
        parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)
        placed = base.repartition(parts, *keys).sortWithinPartitions(*keys, *order)
        return placed.mapInPandas(_fold(keys, value, name), schema)
    rows = sliced.withColumnRenamed(SLICE, "slice").groupBy(*keys, "slice")
    seeds = _seeds(sliced, keys, value)
    # New names, as both sides come from the same rows and a cogroup matches keys by place.
    seeds = seeds.withColumnsRenamed({k: f"_s_{k}" for k in [*keys, "slice"]})
    grouped = seeds.groupBy(*[f"_s_{k}" for k in [*keys, "slice"]])
    return rows.cogroup(grouped).applyInPandas(_fold_seeded(order, value, name, base.columns), schema)


def _fold(keys: list[str], value: str, name: str):
    """Scan sorted rows; only the heaps of the current key are held."""

    def run(batches):
        current, medians = None, None
        for batch in batches:
            result = np.empty(len(batch))
            names = batch[keys].astype(object).where(batch[keys].notna(), None)  # a missing key equals itself
            for i, (key, v) in enumerate(zip(names.itertuples(index=False, name=None), batch[value])):
                if key != current:
                    current, medians = key, Medians()
                result[i] = medians.add(v)
            batch[name] = result
            yield batch

    return run


def _fold_seeded(order: list[str], value: str, name: str, columns: list[str]):
    def run(frame: pd.DataFrame, seed: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order, kind="stable")
        near, half, total = _within_reach(seed, len(frame))
        medians = Medians(near, half, total)
        frame[name] = [medians.add(v) for v in frame[value]]
        return frame[[*columns, name]]

    return run


def _within_reach(seed: pd.DataFrame, rows: int) -> tuple[np.ndarray, int, int]:
    """Earlier values at most ``rows`` + 2 places from the middle, how many of them are in the lower
    half, and the number of all earlier values."""
    if not len(seed):
        return np.empty(0), 0, 0
    below, total = int(seed["below"].max()), int(seed["total"].max())
    near = seed[seed["v"].notna()].sort_values("v")
    weights = near["n"].to_numpy(dtype="int64")
    end = below + np.cumsum(weights)
    middle = (total + 1) // 2
    first = np.maximum(end - weights, middle - rows - 2)
    kept = np.maximum(np.minimum(end, middle + rows + 2) - first, 0)
    half = int(np.clip(middle - first, 0, kept).sum())
    return np.repeat(near["v"].to_numpy(), kept), half, total


class Medians:
    """Running median after ``total`` earlier values, of which ``near`` are those around the middle, in
    order, the first ``half`` of them in the lower half."""

    def __init__(self, near: np.ndarray = (), half: int = 0, total: int = 0):
        self.low = [-v for v in near[:half][::-1]]
        self.high = list(near[half:])
        self.even = total % 2 == 0

    def now(self) -> float:
        """The median of the values so far; not a number without any."""
        if not self.low:
            return float("nan")
        return (self.high[0] - self.low[0]) / 2 if self.even else -self.low[0]

    def add(self, v: float) -> float:
        if v is None or v != v:
            return self.now()
        if self.even:
            heappush(self.low, -heappushpop(self.high, v))
            result = -self.low[0]
        else:
            heappush(self.high, -heappushpop(self.low, -v))
            result = (self.high[0] - self.low[0]) / 2
        self.even = not self.even
        return result


def _seeds(sliced: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per (key, slice): earlier values around the middle with their counts, and a header row (null
    value) with the number of earlier values below them and in all.

    Equal values of one slice are one row throughout. The value axis is cut into about two
    bins per slice, and counts per (slice, bin) say which bins a slice needs.
    """
    known = sliced.filter(F.col(value).isNotNull())
    per_value = known.groupBy(*keys, F.col(SLICE).alias("s"), F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    last = sliced.agg(F.max(SLICE)).first()[0]
    n_bins = 2 * (last + 1)
    cuts = sliced.approxQuantile(value, [i / n_bins for i in range(1, n_bins)], 1 / (4 * n_bins))
    splits = [float("-inf"), *sorted(set(cuts)), float("inf")]
    binned = Bucketizer(splits=splits, inputCol="v", outputCol="bin").transform(per_value)

    # Slices without a value have a size too: their rows repeat the median before them.
    sizes = sliced.groupBy(*keys, F.col(SLICE).alias("s")).agg(F.count(value).alias("m"))
    earlier = Window.partitionBy(*keys).orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("total", F.sum("m").over(earlier)).filter("total > 0").withColumnRenamed("s", "slice")

    # What slices before each one hold per bin: a running count, carried on to the bin's next slice.
    through = Window.partitionBy(*keys, "bin").orderBy("s")
    counts = binned.groupBy(*keys, "s", "bin").agg(F.sum("n").alias("n"))
    held = counts.select(
        *keys, "s", "bin",
        F.sum("n").over(through).alias("n"), F.coalesce(F.lead("s").over(through), F.lit(last)).alias("next"),
    ).filter("s < next")
    prefix = held.withColumn("slice", F.explode(F.sequence(F.col("s") + 1, F.col("next")))).drop("s", "next")
    sizes = sizes.withColumnsRenamed({k: f"_z_{k}" for k in [*keys, "slice"]})
    prefix = prefix.join(sizes, same_keys([*keys, "slice"], "", "_z_")).drop(*[f"_z_{k}" for k in [*keys, "slice"]])
    by_bin = Window.partitionBy(*keys, "slice").orderBy("bin")
    prefix = prefix.withColumn("upto", F.sum("n").over(by_bin)).withColumn("below", F.col("upto") - F.col("n"))
    reach = F.col("m") + 2
    needed = prefix.filter((F.col("upto") >= F.col("total") / 2 - reach) & (F.col("below") <= F.col("total") / 2 + reach))

    none, zero = F.lit(None).cast("double"), F.lit(0).cast("bigint")
    header = needed.groupBy(*keys, "slice").agg(F.min("below").alias("below"), F.max("total").alias("total"))
    header = header.select(*keys, "slice", none.alias("v"), zero.alias("n"), "below", "total")
    wanted = needed.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "slice", F.col("bin").alias("_bin"))
    same_bin = same_keys(keys, "", "_k_") & (F.col("bin") == F.col("_bin")) & (F.col("s") < F.col("slice"))
    near = binned.join(wanted, same_bin).groupBy(*keys, "slice", "v").agg(F.sum("n").alias("n"))
    return header.unionByName(near.select(*keys, "slice", "v", "n", zero.alias("below"), zero.alias("total")))
