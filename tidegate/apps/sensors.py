"""Detection on sensor readings and vehicle reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.operators.ordered import at, moving, previous


def moving_average(readings: DataFrame, n: int = 1000) -> DataFrame:
    """Average of each device's last ``n`` readings, at every reading."""
    return moving(readings, ["device"], ["ts", "event_id"], at("ts", "event_id"), n, {"moving_avg": ("avg", "value")})


def spikes(readings: DataFrame, threshold: float, n: int = 1000) -> DataFrame:
    """Readings at which the moving average reaches the threshold."""
    return moving_average(readings, n).filter(F.col("moving_avg") >= threshold)


def stops(reports: DataFrame, n: int = 4) -> DataFrame:
    """A vehicle is stopped when its last ``n`` positions are equal; with fewer reports it counts as stopped too."""
    before = previous(reports, ["vehicle"], ["ts", "event_id"], at("ts", "event_id"), "position", n - 1, "_prev")
    same = F.forall("_prev", lambda p: p.eqNullSafe(F.col("position")))
    return before.withColumn("stopped", (F.size("_prev") < n - 1) | same).drop("_prev")
