"""Aggregation library: value aggregators by descriptor, histograms, matrices, user aggregators."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def uniq_capped(col: str, cap: int) -> Column:
    """Distinct count that stops growing past ``cap``: the last value is added while count <= cap,
    so the result can reach cap + 1."""
    return F.least(F.count_distinct(F.col(col)), F.lit(cap + 1))


# The names of the value aggregators in descriptors and in the text protocol.
AGGREGATORS: dict[str, Callable[[str], Column]] = {
    "LongValueSum": lambda c: F.sum(F.col(c).cast("bigint")),
    "LongValueMax": lambda c: F.max(F.col(c).cast("bigint")),
    "LongValueMin": lambda c: F.min(F.col(c).cast("bigint")),
    "DoubleValueSum": lambda c: F.sum(F.col(c).cast("double")),
    "StringValueMax": lambda c: F.max(F.col(c).cast("string")),
    "StringValueMin": lambda c: F.min(F.col(c).cast("string")),
    "UniqValueCount": lambda c: F.count_distinct(F.col(c)),
}


def by_descriptor(df: DataFrame, spec: dict[str, tuple[str, str]]) -> DataFrame:
    """Many aggregates in one pass: ``spec = {id: (type, column)}`` gives one row (type, id, value)."""
    totals = df.agg(*[AGGREGATORS[kind](col).cast("string").alias(i) for i, (kind, col) in spec.items()])
    rows = F.array(
        *[F.struct(F.lit(k).alias("type"), F.lit(i).alias("id"), F.col(i).alias("value")) for i, (k, _) in spec.items()]
    )
    return totals.select(F.inline(rows))


def text_protocol(lines: DataFrame, col: str = "value") -> DataFrame:
    """Aggregate ``type:id<TAB>value`` lines: one row (type, id, value) per distinct prefix."""
    at = F.instr(F.col(col), "\t")
    prefix = F.expr(f"substring({col}, 1, instr({col}, '\t') - 1)")
    parsed = lines.filter(at > 0).select(
        F.substring_index(prefix, ":", 1).alias("type"),
        F.expr(f"substring({col}, instr({col}, ':') + 1, instr({col}, '\t') - instr({col}, ':') - 1)").alias("id"),
        F.expr(f"substring({col}, instr({col}, '\t') + 1)").alias("_v"),
    )
    # One typed column per aggregator, so that a value is only parsed as its own type.
    typed = parsed.withColumns({f"_{k}": F.when(F.col("type") == k, F.col("_v")) for k in AGGREGATORS})
    totals = typed.groupBy("type", "id").agg(
        *[f(f"_{k}").cast("string").alias(f"_out_{k}") for k, f in AGGREGATORS.items()]
    )
    value = reduce(lambda acc, k: acc.when(F.col("type") == k, F.col(f"_out_{k}")), AGGREGATORS, F.when(F.lit(False), ""))
    return totals.select("type", "id", value.alias("value"))


def value_histogram(df: DataFrame, id_col: str, value: str, n: str | None = None) -> DataFrame:
    """Report on the counts of each distinct value per id: unique, min, median, max, mean, sd.

    The median is element ``unique div 2`` of the sorted counts. It is read off a histogram
    of the counts: they add up to the rows, so there are at most about sqrt(2 * rows)
    different ones per id, however hot the id is.
    """
    weight = F.count(F.lit(1)) if n is None else F.sum(n)
    counts = df.groupBy(id_col, value).agg(weight.cast("bigint").alias("_n"))
    freq = counts.groupBy(id_col, "_n").agg(F.count(F.lit(1)).alias("_f"))
    whole = Window.partitionBy(id_col)
    upto = whole.orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
    ranked = freq.withColumns({"_cum": F.sum("_f").over(upto), "_u": F.sum("_f").over(whole)})
    mean = F.sum(F.col("_n") * F.col("_f")) / F.sum("_f")
    ranked = ranked.withColumn("_mean", (F.sum(F.col("_n") * F.col("_f")).over(whole) / F.col("_u")))
    spread = F.sqrt(F.sum(F.pow(F.col("_n") - F.col("_mean"), 2) * F.col("_f")) / F.sum("_f"))
    return ranked.groupBy(id_col).agg(
        F.sum("_f").alias("unique_values"),
        F.min("_n").alias("min_count"),
        F.min(F.when(F.col("_cum") > F.floor(F.col("_u") / 2), F.col("_n"))).alias("median_count"),
        F.max("_n").alias("max_count"),
        mean.alias("mean_count"),
        spread.alias("sd_count"),
    )


def count_matrix(df: DataFrame, row: str, col: str, labels: list[str]) -> DataFrame:
    """Labelled count matrix: one column per label, absent cells 0."""
    counts = df.groupBy(row).pivot(col, labels).count()
    return counts.select(row, *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(c) for c in labels])


def matrix_margins(df: DataFrame, row: str, col: str) -> DataFrame:
    """Cells, row sums, column sums and the total; a null label marks a sum."""
    return df.cube(row, col).agg(F.count(F.lit(1)).alias("n"))


def fold(
    df: DataFrame, keys: list[str], initial: dict[str, int], steps: dict[str, Column],
    combine: dict[str, Callable[[Column, Column], Column]] | None = None,
) -> DataFrame:
    """Fold each key's rows onto an initial value. The steps are aggregate expressions, so that Spark
    folds parts of a key on the map side; the initial value joins in once at the end, by the column's
    ``combine`` (such as ``F.greatest`` for a maximum), or by addition."""
    folded = df.groupBy(*keys).agg(*[step.alias(name) for name, step in steps.items()])
    join_in = {name: (combine or {}).get(name, lambda a, b: a + b) for name in initial}
    return folded.withColumns({name: join_in[name](F.lit(value), F.col(name)) for name, value in initial.items()})


def user_aggregate(
    df: DataFrame,
    key: str,
    value: str,
    state: list[str],
    accumulate: Callable[[pd.Series], list[float]],
    merge: Callable[[pd.DataFrame], list[float]],
    finish: Column,
    fan_in: int = 64,
) -> DataFrame:
    """A user-defined aggregator over numeric state, with its own combiner.

    ``accumulate`` folds a batch of values, ``merge`` folds state rows (a frame with the
    ``state`` columns). Every input partition keeps one state per key; the states meet in
    two rounds, so that no task sees more than the square root of a key's partitions.
    """
    key_type = df.schema[key].dataType.simpleString()
    fields = ", ".join(f"`{s}` double" for s in state)
    schema = f"`{key}` {key_type}, {fields}"

    def merged(states: list) -> list:
        return states[0] if len(states) == 1 else merge(pd.DataFrame(states, columns=state))

    def per_partition(batches):
        held: dict = {}
        for batch in batches:
            for k, values in batch.groupby(key, sort=False, dropna=False)[value]:
                states = held.setdefault(k, [])
                states.append(accumulate(values))
                if len(states) == fan_in:
                    held[k] = [merged(states)]
        yield pd.DataFrame([[k, *merged(states)] for k, states in held.items()], columns=[key, *state])

    def combine(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[frame[key].iloc[0], *merge(frame[state])]], columns=[key, *state])

    partial = df.select(key, value).mapInPandas(per_partition, schema)
    spread = partial.withColumn("_g", F.pmod(F.xxhash64(key, F.spark_partition_id()), F.lit(fan_in)))
    first = spread.groupBy(key, "_g").applyInPandas(lambda f: combine(f), schema)
    return first.groupBy(key).applyInPandas(combine, schema).select(key, finish.alias("result"))
