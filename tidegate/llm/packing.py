"""Packing token ids into sequences: power-of-two decomposition of each document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm.common import slices, text_or_empty
from tidegate.llm.tokens import binary_pieces, task_encoder, with_end

PIECES = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


def binary_lengths(n: int, longest: int) -> list[int]:
    """Lengths of the pieces of n ids: whole sequences first, then the powers of two of what is left, falling."""
    lengths, left = [longest] * (n // longest), n % longest
    return lengths + [1 << k for k in range(left.bit_length() - 1, -1, -1) if left >> k & 1]


def pack(docs: DataFrame, tokenizer: str, longest: int = 4096, end_id: int = 2) -> DataFrame:
    """Cut each document into pieces whose lengths are powers of two, one piece to a sequence.

    Every piece has a power of two of ids, at most ``longest`` (itself a power of two), so a sequence holds ids of
    one document only and needs no padding; sequences of equal length share a bucket. A bucket is a range of
    ``sequence_id``: the upper bits are the logarithm of the length, then come the task and a number within it, so
    a table sorted or partitioned by ``sequence_id`` yields batches of one length. Only a map over the documents is
    needed: no length or document can overload a task.

    Returns one row per piece: doc_id, start (its document's ids before it), length, ids (little-endian unsigned
    32 bit), doc_tokens (with the end id), sequence_id (unique), offset (0: pieces are alone). A null or empty text
    is the end id alone, a null doc_id stays null, repeated rows are packed each, other columns are not read, an
    empty table gives an empty one. A very long text gives many pieces of ``longest`` ids.
    """
    if longest & (longest - 1) or longest < 1:
        raise ValueError("longest must be a power of two")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = task_encoder(tokenizer)
        task = TaskContext.get().partitionId() << 32
        numbers = [0] * longest.bit_length()
        for batch in slices(batches, "text"):
            ids, counts = with_end(*encoder.encode(batch.column(1).to_pylist()), end_id)
            cuts = [binary_lengths(n, longest) for n in counts.tolist()]
            per_doc = np.fromiter(map(len, cuts), np.int64, len(cuts))
            lengths = np.array([n for c in cuts for n in c], np.int64)
            ends = np.cumsum(lengths)
            first = np.repeat(np.cumsum(counts) - counts, per_doc)
            sequence = np.zeros(len(lengths), np.int64)
            for k in range(longest.bit_length()):
                of = np.flatnonzero(lengths == 1 << k)
                sequence[of] = (k << 56) + task + numbers[k] + np.arange(len(of))
                numbers[k] += len(of)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(np.arange(len(cuts)), per_doc))),
                    pa.array(ends - lengths - first),
                    pa.array(lengths),
                    binary_pieces(ids, ends),
                    pa.array(np.repeat(counts, per_doc)),
                    pa.array(sequence),
                    pa.array(np.zeros(len(lengths), np.int64)),
                ],
                ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

    return docs.select(F.col("doc_id").cast("bigint"), text_or_empty("text").alias("text")).mapInArrow(cut, PIECES)
