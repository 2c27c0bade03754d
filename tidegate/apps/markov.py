"""Markov model of state sequences and the score of unlikely ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegate.operators.ordered import at, moving, previous


def transitions(df: DataFrame, entity: str, state: str, order: list[str]) -> DataFrame:
    """Each row with the state before it in its entity; the first row of an entity is dropped."""
    before = previous(df, [entity], order, at(order[0], order[-1]), state, 1, "_prev")
    return before.filter(F.size("_prev") > 0).withColumn("from_state", F.get("_prev", F.lit(0))).drop("_prev")


def train(moves: DataFrame, state: str, states: list[str], scale: int = 1000) -> DataFrame:
    """Transition probabilities over a fixed list of states, one row per cell.

    If any cell of a row is 0, every cell of that row gets one more. A scale above 1 gives
    whole numbers cut off; a scale of 1 gives fractions.
    """
    counts = moves.groupBy("from_state", F.col(state).alias("to_state")).agg(F.count(F.lit(1)).alias("n"))
    cells = grid(moves.sparkSession, states).join(counts, ["from_state", "to_state"], "left").fillna(0, ["n"])
    row = Window.partitionBy("from_state")
    smooth = F.when(F.min("n").over(row) == 0, F.col("n") + 1).otherwise(F.col("n"))
    cells = cells.withColumn("n", smooth).withColumn("_sum", F.sum("n").over(row))
    value = F.expr(f"(n * {scale}) div _sum") if scale > 1 else F.col("n") / F.col("_sum")
    return cells.withColumn("p", value).drop("_sum")


def grid(spark: SparkSession, states: list[str]) -> DataFrame:
    """All (from, to) cells of the configured states."""
    labels = F.array(*[F.lit(s) for s in states])
    return spark.range(1).select(F.explode(labels).alias("from_state")).withColumn("to_state", F.explode(labels))


def score(moves: DataFrame, entity: str, state: str, order: list[str], model: DataFrame, window: int, limit: float) -> DataFrame:
    """Miss probability of the last ``window`` states of an entity: the mean of 1 - P over the moves in
    them. Scored once the window is full; above ``limit`` the entity is an outlier."""
    steps = window - 1
    priced = moves.join(
        model.select("from_state", F.col("to_state").alias(state), (1 - F.col("p")).alias("_miss")), ["from_state", state]
    )
    scored = moving(priced, [entity], order, at(order[0], order[-1]), steps, {"score": ("avg", "_miss"), "_n": ("count", "_miss")})
    return scored.filter(F.col("_n") == steps).withColumn("outlier", F.col("score") > limit).drop("_n", "_miss")
