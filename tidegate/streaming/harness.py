"""Run a stream over all input that is there, and read what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidegate.session import work_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_append(df: DataFrame, path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Append every output row to files. Windows that the watermark has not passed stay open.

    Given the path and checkpoint of an earlier run it goes on where that one ended, also if
    it failed: each row is written once.
    """
    spark = df.sparkSession
    path = path or work_path(spark, "stream")
    checkpoint = checkpoint or work_path(spark, "checkpoint")
    query = (
        df.writeStream.format("parquet").outputMode("append").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


def run_update(df: DataFrame, keys: list[str]) -> DataFrame:
    """The final value per key of a stream in update mode.

    Each micro-batch writes only the keys it changed, under its own number, so a retry
    replaces it. At the end of a bounded input the newest row per key is the result, open
    windows included; nothing is re-emitted as complete mode would.
    """
    spark = df.sparkSession
    path = work_path(spark, "stream")
    checkpoint = work_path(spark, "checkpoint")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = (
        df.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return newest(spark, path, df, keys)


def newest(spark: SparkSession, path: str, df: DataFrame, keys: list[str]) -> DataFrame:
    stored = spark.read.schema(StructType([*df.schema.fields, StructField("batch", LongType())])).parquet(path)
    rest = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*rest), "batch").alias("_v")
    return stored.groupBy(*keys).agg(last).select(*keys, "_v.*")


class state_store:
    """Use the RocksDB state store inside the block, as stateful processors need."""

    KEY = "spark.sql.streaming.stateStore.providerClass"

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self):
        self.old = self.spark.conf.get(self.KEY, None)
        self.spark.conf.set(self.KEY, ROCKSDB)

    def __exit__(self, *exc):
        if self.old is None:
            self.spark.conf.unset(self.KEY)
        else:
            self.spark.conf.set(self.KEY, self.old)
