"""Scalar and aggregate functions of the SQL layer that Spark names or defines differently."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType


def regex_match(pattern: str, value: Column) -> Column:
    """True when the whole value matches; the pattern comes first."""
    return value.rlike(rf"\A(?:{pattern})\z")


def sum0(value: Column) -> Column:
    """Sum that is 0 for no rows or only nulls."""
    return F.coalesce(F.sum(value), F.lit(0))


def flatten_rows(df: DataFrame, *columns: str) -> DataFrame:
    """One row per element of the array column: a null keeps its row, an empty array drops it.
    Only one column may be flattened per query."""
    if len(columns) != 1:
        raise ValueError("exactly one flatten per query is supported")
    (name,) = columns
    return df.withColumn(name, F.explode(F.coalesce(F.col(name), F.array(F.lit(None)))))


@F.pandas_udf(LongType())
def scale_udf(value: pd.Series, factor: pd.Series) -> pd.Series:
    return value * factor


@F.pandas_udf(ArrayType(StringType()))
def words_udf(text: pd.Series) -> pd.Series:
    return text.str.split()


@F.udtf(returnType=StructType().add("token", StringType()).add("place", IntegerType()))
class TokenRows:
    """Table function: the whitespace tokens of a text with their places."""

    def eval(self, text: str):
        for place, token in enumerate((text or "").split()):
            yield token, place


def register(spark: SparkSession) -> None:
    """Make the functions available to SQL text, expressions as SQL functions where possible."""
    spark.sql(
        r"""CREATE OR REPLACE TEMPORARY FUNCTION RegexMatch(pattern STRING, value STRING) RETURNS BOOLEAN
        RETURN regexp(value, concat('\\A(?:', pattern, ')\\z'))"""
    )
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION my_scale(v BIGINT, f BIGINT) RETURNS BIGINT RETURN v * f")
    spark.udf.register("scale_udf", scale_udf)
    spark.udf.register("words_udf", words_udf)
    spark.udtf.register("token_rows", TokenRows)
