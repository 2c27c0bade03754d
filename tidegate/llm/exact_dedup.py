"""Exact duplicates by a content sort."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from tidegate.llm.common import small, text_or_empty
from tidegate.session import materialized

LEAD_BYTES = 32


def content_sort(rows: DataFrame) -> DataFrame:
    """Sort rows (head, id, text) by the bytes of their texts, equal texts by falling id, over range partitions.

    Spark samples splitters of (leading bytes, hash, id) and sorts each range by (leading bytes, hash, text, id),
    spilling to disk. The splitters are short, whatever the texts' length; the hash parts texts with a common
    beginning, and the id parts the copies of one text, so no text, however often it occurs, fills a range.
    """
    falling = F.col("id").desc_nulls_last()
    keyed = rows.select("head", "id", "text", F.substring(F.col("text").cast("binary"), 1, LEAD_BYTES).alias("lead"), F.xxhash64("text").alias("hash"))
    return keyed.repartitionByRange("lead", "hash", falling).sortWithinPartitions("lead", "hash", "text", falling)


def runs_of_equal_texts(rows: DataFrame, with_ids: bool) -> DataFrame:
    """One row per run of equal texts in a range of the content sort: its first row's ``head``, all ids or, without
    ids, the text, their number, the range, a number within it and, where the run may go on in another range, the text.

    Each text is compared in full with its neighbour. A run is at an edge if it has the hash of the first or last row
    of its range. A task holds one text and the ids of its open run.
    """
    sorted_rows = content_sort(rows).select("head", "id", "text", "hash")
    schema = StructType(
        [
            sorted_rows.schema["head"], StructField("ids", ArrayType(LongType())) if with_ids else StructField("text", StringType()),
            StructField("n", LongType()), StructField("range_no", LongType()), StructField("run_no", LongType()), StructField("edge", StringType()),
        ]
    )

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, number = TaskContext.get().partitionId(), 0
        first_hash = None
        held: list[dict] = []  # the open run, after closed ones with the same hash

        def out(heads, shown, ns, edges) -> pa.RecordBatch:
            nonlocal number
            many = len(ns)
            numbers = pa.array(np.arange(number, number + many))
            number += many
            columns = [heads, shown, pa.array(ns, pa.int64()), pa.array(np.full(many, here)), numbers, pa.array(edges, pa.string())]
            return pa.RecordBatch.from_arrays(columns, schema.names)

        def give(run: dict, at_end: bool) -> pa.RecordBatch:
            edge = run["text"] if at_end or run["hash"] == first_hash else None
            shown = pa.array([run["text"]], pa.string())
            if with_ids:
                ids = pa.concat_arrays(run["ids"])
                shown = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            return out(run["head"], shown, [run["n"]], [edge])

        for batch in batches:
            if not (rows_here := batch.num_rows):
                continue
            heads, ids, texts = batch.column(0), batch.column(1), batch.column(2)
            hashes = batch.column(3).to_numpy()
            if first_hash is None:
                first_hash = hashes[0]
            differs = np.ones(rows_here, bool)
            differs[1:] = pc.not_equal(texts.slice(1), texts.slice(0, rows_here - 1)).to_numpy(zero_copy_only=False)
            if held:
                differs[0] = texts[0].as_py() != held[-1]["text"]
            starts = np.flatnonzero(differs)
            before = int(starts[0]) if len(starts) else rows_here
            if before:
                held[-1]["n"] += before
                if with_ids:
                    held[-1]["ids"].append(ids.slice(0, before))
            if not len(starts):
                continue
            if held and held[-1]["hash"] != hashes[starts[0]]:
                yield from (give(run, False) for run in held)
                held = []
            ends = np.append(starts[1:], rows_here)
            # Runs that are closed and have not the last row's hash can be given out together.
            closed = np.flatnonzero(hashes[starts] != hashes[-1])
            inner = len(closed) and closed[-1] + 1
            if inner:
                if held:
                    yield from (give(run, False) for run in held)
                    held = []
                ns = (ends - starts)[:inner]
                at = pa.array(starts[:inner])
                shown = texts.take(at)
                if with_ids:
                    shown = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(ns)), pa.int32()), ids.slice(int(starts[0]), int(ns.sum())))
                edges = [texts[int(s)].as_py() if hashes[s] == first_hash else None for s in starts[:inner]]
                yield out(heads.take(at), shown, ns, edges)
            for s, e in zip(starts[inner:].tolist(), ends[inner:].tolist()):
                of = [ids.slice(s, e - s)] if with_ids else []
                held.append({"head": heads.take(pa.array([s])), "ids": of, "n": e - s, "hash": hashes[s], "text": texts[s].as_py()})
        yield from (give(run, True) for run in held)

    return sorted_rows.mapInArrow(runs, schema)


def _whole_runs(docs: DataFrame, head: list[Column], with_ids: bool, id_col: str, text_col: str) -> DataFrame:
    """The runs of all ranges, those at edges with the size, range and id of their whole group."""
    text = text_or_empty(text_col)
    shown = F.struct(F.sha2(text, 256).alias("text_sha256")) if with_ids else F.struct(*head)
    rows = docs.select(shown.alias("head"), F.col(id_col).cast("bigint").alias("id"), text.alias("text"))
    runs = materialized(runs_of_equal_texts(rows, with_ids), "runs", compression="zstd")
    first_id = F.get("ids", F.lit(0)) if with_ids else F.lit(None).cast("bigint")
    edges = runs.filter(F.col("edge").isNotNull()).select("edge", "n", "range_no", "run_no", first_id.alias("first_id"))
    groups = edges.groupBy("edge").agg(
        F.sum("n").alias("group_n"), F.min("range_no").alias("first_range"), F.min_by("first_id", "range_no").alias("group_keep")
    )
    merged = edges.join(groups, "edge").select("range_no", "run_no", "group_n", "first_range", "group_keep")
    return runs.drop("edge").join(small(merged, edges.count()), ["range_no", "run_no"], "left")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when all their bytes are (a null text counts as empty). Of equal texts the row with the largest
    id is kept, and exactly one of them if that id repeats; null ids come last and keep_id is null only where the whole
    group has none. Runs at the edges of ranges, a few per range, are brought together by their whole text; all others
    are final where they were sorted. Other columns are not read; an empty table gives an empty one.
    """
    runs = _whole_runs(docs, [], True, id_col, text_col)
    spread = runs.select("range_no", "n", "group_n", "first_range", "group_keep", "head.text_sha256", F.get("ids", F.lit(0)).alias("own"), F.posexplode("ids").alias("pos", "doc_id"))
    at_edge = F.col("first_range").isNotNull()
    return spread.select(
        "doc_id",
        F.when(at_edge, F.col("group_keep")).otherwise(F.col("own")).alias("keep_id"),
        F.coalesce("group_n", "n").alias("group_size"),
        ((F.col("pos") == 0) & (~at_edge | (F.col("first_range") == F.col("range_no")))).alias("kept"),
        "text_sha256",
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that ``exact_groups`` keeps, with all their columns as they are (a kept null text stays null). The text
    is sorted and stored once; of the column itself only whether it is null goes along."""
    others = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c != text_col]
    runs = _whole_runs(docs, [*others, F.col(f"`{text_col}`").isNull().alias("empty")], False, id_col, text_col)
    kept = runs.filter(F.col("first_range").isNull() | (F.col("first_range") == F.col("range_no")))
    text = F.when(~F.col("head.empty"), F.col("text"))
    return kept.select(*[(text if c == text_col else F.col(f"head.c{i}")).alias(c) for i, c in enumerate(docs.columns)])
