"""Job counters: named counts collected while a job runs, without a second pass."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation


def counted(
    df: DataFrame,
    before: dict[str, Column],
    job: Callable[[DataFrame], DataFrame],
    after: dict[str, Column],
) -> dict[str, int]:
    """Run ``job`` once and return the counters of its input and its output."""
    first, last = Observation("input"), Observation("output")
    observed = df.observe(first, *[c.alias(n) for n, c in before.items()])
    done = job(observed).observe(last, *[c.alias(n) for n, c in after.items()])
    done.write.format("noop").mode("overwrite").save()
    return {**first.get, **last.get}
