"""Piped external mappers and reducers: rows as tab-separated lines over stdin and stdout."""

from __future__ import annotations

import shlex

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def piped_map(df: DataFrame, command: str, *cols: str, accept: tuple[int, ...] = (0,)) -> DataFrame:
    """Feed each partition's rows to ``command`` and read its lines back as column ``value``.

    The command is not started for a partition without rows. An exit code that is not in ``accept`` fails the
    job; ``grep``, for one, ends with 1 where it finds nothing.
    """
    lines = df.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in cols]).alias("value"))
    codes = "|".join(map(str, accept))
    fed = f'IFS= read -r first || exit 0; {{ printf "%s\\n" "$first"; cat; }} | {command}; code=$?'
    script = f"{fed}; case $code in {codes}) exit 0;; *) exit $code;; esac"
    out = lines.rdd.map(lambda r: r[0]).pipe(f"sh -c {shlex.quote(script)}", checkCode=True)
    return out.map(lambda s: (s,)).toDF("value string")


def piped_reduce(df: DataFrame, command: str, key: str, *cols: str, accept: tuple[int, ...] = (0,)) -> DataFrame:
    """The same with every partition sorted by key and no key in two partitions.

    The external program reads a stream, so a hot key costs it time but no memory; put a
    combiner (``piped_map`` or an aggregate) before it where the reduction allows.
    """
    return piped_map(df.repartition(F.col(key)).sortWithinPartitions(key, *cols), command, key, *cols, accept=accept)
