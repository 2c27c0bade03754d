"""Keyed tables without a table format: an append-only folder of change batches, read as the
newest row per key."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

DELETED = "_deleted"


class KeyedTable:
    """A keyed, mutable table in a shared folder.

    An upsert writes only its own changes, as one numbered batch; writing a batch again
    replaces it, so a retried micro-batch changes nothing. A read takes the newest row per
    key. ``compact`` folds the batches so far into one.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        self.base = 0
        self.schema: StructType | None = None
        self.next_batch = self._reopen()

    def _reopen(self) -> int:
        """Take the schema of the batches in the folder; the number after the last one written or set down is next."""
        try:
            given = self.spark.read.schema("number bigint").json(f"{self.path}/_numbers/*").agg(F.max("number")).first()[0]
        except AnalysisException:
            given = None
        given = 0 if given is None else given + 1
        try:
            stored = self.spark.read.option("mergeSchema", "true").parquet(self.path)
        except AnalysisException:  # no batch yet
            return given
        fields = [f for f in stored.schema if f.name not in (DELETED, "batch")]
        self.schema = StructType(fields) if len(fields) > len(self.keys) else None
        last = stored.agg(F.max("batch")).first()[0]  # null if all batches are empty: they may be written over
        try:
            self.base = self.spark.read.schema("base bigint").json(f"{self.path}/_base").first()[0]
        except (AnalysisException, TypeError):  # never compacted
            self.base = 0
        return given if last is None else max(given, last + 1)

    def put_all(self, rows: DataFrame, order: list[str] | None = None, batch: int | None = None) -> None:
        """Insert or replace by key. Of several rows of one key the last by ``order`` counts, of equally late ones the
        greatest; an order column that begins with ``__`` is not stored. Without an order, different rows of one key
        are an error."""
        stored = [c for c in rows.columns if not (order and c in order and c.startswith("__"))]
        self.schema = self.schema or rows.select(*stored).schema
        rest = F.struct(*[c for c in stored if c not in self.keys])
        if order:
            newest = F.max(F.struct(F.struct(*order).alias("o"), rest.alias("v")))["v"]
        else:
            clash = F.raise_error(F.lit("several rows of one key and no order to tell the last"))
            newest = F.when(F.max(rest).eqNullSafe(F.min(rest)), F.max(rest)).otherwise(clash)
        last = rows.groupBy(*self.keys).agg(newest.alias("_v")).select(*self.keys, "_v.*")
        self._append(last.withColumn(DELETED, F.lit(False)), batch)

    def number_of(self, writer: str) -> int:
        """The batch number of a writer's batch, such as a statement's micro-batch. It is set down in the table's folder
        before the batch is written, so that a retry finds it again."""
        known = f"{self.path}/_numbers/{writer}"
        try:
            found = self.spark.read.schema("number bigint").json(known).first()
        except AnalysisException:
            found = None
        if found:
            return found["number"]
        number = self.next_batch
        self.spark.range(1).select(F.lit(number).alias("number")).coalesce(1).write.mode("overwrite").json(known)
        self.next_batch = number + 1
        return number

    def delete_all(self, keys: DataFrame, batch: int | None = None) -> None:
        self._append(keys.select(*self.keys).distinct().withColumn(DELETED, F.lit(True)), batch)

    def _append(self, rows: DataFrame, batch: int | None) -> None:
        number = self.next_batch if batch is None else batch
        rows.write.mode("overwrite").parquet(f"{self.path}/batch={number}")
        self.next_batch = max(self.next_batch, number + 1)

    def read(self) -> DataFrame:
        """All live rows."""
        fields = [*self.schema.fields, StructField(DELETED, BooleanType()), StructField("batch", LongType())]
        stored = self.spark.read.schema(StructType(fields)).parquet(self.path).filter(F.col("batch") >= self.base)
        rest = [c for c in stored.columns if c not in (*self.keys, "batch")]
        newest = stored.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), "batch").alias("_v"))
        return newest.select(*self.keys, "_v.*").filter(~F.col(DELETED)).drop(DELETED)

    def get_all(self, keys: DataFrame) -> DataFrame:
        """Rows of the given keys; a key that is not there gives no row."""
        return self.read().join(keys.select(*self.keys).distinct(), self.keys, "left_semi")

    def compact(self) -> None:
        """Fold all batches into one, which readers then start from."""
        number = self.next_batch
        self._append(self.read().withColumn(DELETED, F.lit(False)), number)
        self.spark.range(1).select(F.lit(number).alias("base")).write.mode("overwrite").json(f"{self.path}/_base")
        self.base = number
