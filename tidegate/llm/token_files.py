"""Token-id files: texts to coded blocks in document order, and back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegate.llm.codec import read_block, write_block
from tidegate.llm.common import slices, small, text_or_empty
from tidegate.llm.tokens import binary_pieces, task_encoder, with_end

BLOCKS = "file_no int, block_no int, n_docs bigint, n_tokens bigint, payload binary"
DOCUMENTS = "file_no int, block_no int, doc_id bigint, before bigint, n_tokens bigint, ids binary"


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, block_ids: int = 4_000_000) -> None:
    """Write all documents' ids to ``path``, in ascending order of doc_id over the files and within each.

    A file holds the blocks of one range of doc_ids (see ``codec`` for their bytes); a block holds whole documents,
    about ``block_ids`` ids or one longer document, and resets the model. The container of the blocks is Parquet,
    uncompressed, written by Spark: a lost task leaves no half file. The order within one doc_id is that of a hash of
    the text, which also splits a doc_id with very many rows over the ranges. Null doc_ids come first, null and empty
    texts are the end id alone, other columns are not read.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = task_encoder(tokenizer)
        file_no, block_no = TaskContext.get().partitionId(), 0
        held_docs: list[int | None] = []
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def block() -> pa.RecordBatch:
            nonlocal block_no, held_docs, held
            ids = np.concatenate([h[0] for h in held])
            counts = np.concatenate([h[1] for h in held])
            row = pa.RecordBatch.from_arrays(
                [
                    pa.array([file_no], pa.int32()), pa.array([block_no], pa.int32()), pa.array([len(counts)], pa.int64()),
                    pa.array([len(ids)], pa.int64()), pa.array([write_block(held_docs, counts, ids)], pa.binary()),
                ],
                ["file_no", "block_no", "n_docs", "n_tokens", "payload"],
            )
            block_no, held_docs, held = block_no + 1, [], []
            return row

        for batch in slices(batches, "text", 6_000_000):
            ids, counts = with_end(*encoder.encode(batch.column(1).to_pylist()), end_id)
            held_docs += batch.column(0).to_pylist()
            held.append((ids, counts))
            if sum(len(h[0]) for h in held) >= block_ids:
                yield block()
        if held:
            yield block()

    (
        docs.select(F.col("doc_id").cast("bigint"), text_or_empty("text").alias("text"))
        .withColumn("h", F.xxhash64("text"))
        .repartitionByRange("doc_id", "h")
        .sortWithinPartitions("doc_id", "h")
        .select("doc_id", "text")
        .mapInArrow(blocks, BLOCKS)
        .write.option("compression", "none")
        .parquet(path)
    )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids (bytes).

    Starts come from the numbers of ids in the blocks' rows: one row per file is summed up in one task, blocks
    within their file. Each block is decoded in the task that reads it, after its checksum is verified.
    """
    table = spark.read.schema(BLOCKS).parquet(path)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file_no, block_no, payload in zip(*(c.to_pylist() for c in batch.columns)):
                doc_ids, counts, ids = read_block(payload)
                ends = np.cumsum(counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([file_no] * len(counts), pa.int32()), pa.array([block_no] * len(counts), pa.int32()),
                        pa.array(doc_ids, pa.int64()), pa.array(ends - counts), pa.array(counts), binary_pieces(ids, ends),
                    ],
                    ["file_no", "block_no", "doc_id", "before", "n_tokens", "ids"],
                )

    sizes = table.select("file_no", "block_no", "n_tokens")
    earlier = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    files = sizes.groupBy("file_no").agg(F.sum("n_tokens").alias("n")).select("file_no", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("f"))
    within = Window.partitionBy("file_no").orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        sizes.withColumn("b", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
        .join(files, "file_no")
        .select("file_no", "block_no", (F.col("f") + F.col("b")).alias("first"))
    )
    found = table.select("file_no", "block_no", "payload").mapInArrow(documents, DOCUMENTS)
    return found.join(small(starts, sizes.count()), ["file_no", "block_no"]).select(
        "doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids"
    )
