"""Near duplicates by SimHash fingerprints and multi-index hashing."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.llm.common import fresh, slices, text_or_empty
from tidegate.llm.components import components
from tidegate.session import materialized

SEED = 42
PART = 1 << 16


def fingerprint(text: str, words: int = 4) -> int:
    """64 bit fingerprint, as a signed number: a bit is set if it is in over half of the shingles' hashes."""
    from xxhash import xxh64_intdigest

    found = text.encode("utf-8", "surrogatepass").lower().split()
    n = max(len(found) - words + 1, 1 if found else 0)
    if not n:
        return 0
    joined = b" ".join(found)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts, stops = (ends - lengths)[:n], ends[min(words, len(found)) - 1 :][:n]
    ones = np.zeros(64, np.int64)
    for at in range(0, n, PART):
        hashes = [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[at : at + PART].tolist(), stops[at : at + PART].tolist())]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint bigint) of every row."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            prints = [fingerprint(t, words) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], ["doc_id", "fingerprint"])

    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return texts.mapInArrow(made, "doc_id bigint, fingerprint bigint")


def segment_balls(most_bits: int, segments: int) -> list[tuple[int, int, int]]:
    """(shift, width, radius) of each segment.

    If d bits differ, d = segments * r + a, then one of the first a + 1 segments differs in at most r bits or one of
    the others in at most r - 1 (no ball for r = 0). All together find every pair within d bits.
    """
    r, a = divmod(most_bits, segments)
    found, shift = [], 0
    for k in range(segments):
        width = (64 - shift) // (segments - k)
        radius = r if k <= a else r - 1
        if radius >= 0:
            found.append((shift, width, radius))
        shift += width
    return found


def lookup_cost(n: int, most_bits: int, segments: int) -> float:
    """Rows that the search makes for a fingerprint among n: probes, and what they find in a bucket by chance."""
    balls = segment_balls(most_bits, segments)
    return sum(math.comb(width, bits) * (1 + n / 2**width) for _, width, radius in balls for bits in range(radius + 1))


def segments_for(n: int, most_bits: int = 4) -> int:
    """Number of segments, 2 to 4, that costs least for n different fingerprints. Any number gives the same links."""
    return min((4, 3, 2), key=lambda segments: lookup_cost(n, most_bits, segments))


def _part(fp: str, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1))


def _ball(k: int, value: Column, masks: list[int]) -> Column:
    """Keys of all values that differ from ``value`` by one of the masks."""
    return F.transform(F.lit(np.array(masks, np.int64)), lambda m: F.struct(F.lit(k).alias("k"), value.bitwiseXOR(m).alias("v")))


def near_links(prints: DataFrame, most_bits: int, segments: int) -> DataFrame:
    """Links (a, b) between the nodes of different fingerprints (fp, node) that differ in at most ``most_bits`` bits.

    The table of a segment holds each fingerprint once, under the segment's value. Looking up all values within the
    segment's ball fetches the candidates, and the join itself compares the whole fingerprints, so only links leave it.
    """
    stored, sought = [], []
    for k, (shift, width, radius) in enumerate(segment_balls(most_bits, segments)):
        masks = [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]
        stored.append(F.struct(F.lit(k).alias("k"), _part("fp", shift, width).alias("v")))
        sought.append(_ball(k, _part("fp", shift, width), masks))
    table = prints.select(F.col("fp").alias("fp_b"), F.col("node").alias("b"), F.explode(F.array(*stored)).alias("key"))
    probes = prints.select(F.col("fp").alias("fp_a"), F.col("node").alias("a"), F.explode(F.concat(*sought)).alias("key"))
    table, probes = table.select("fp_b", "b", "key.k", "key.v"), probes.select("fp_a", "a", "key.k", "key.v")
    differ = F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b")))
    at = [probes.k == table.k, probes.v == table.v, F.col("a") < F.col("b"), differ <= most_bits]
    return probes.join(table, at).select("a", "b").distinct()


def near_groups(docs: DataFrame, words: int = 4, most_bits: int = 4, segments: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    A-Z are lowered, words are runs of other than ASCII white space, shingles are ``words`` words with repeats (a
    shorter text is one shingle). A text without words, or null, has fingerprint zero and is linked like any other.
    Rows with one fingerprint, however many, are first reduced to one node, their smallest doc_id; links are sought
    between nodes only. Rows without a doc_id get a component only through others with their fingerprint, else null.
    Rows that share a doc_id are one node in links. Other columns are not read; an empty table gives an empty one.
    """
    prints = materialized(fingerprints(docs, words, id_col, text_col), "fingerprints")
    nodes = materialized(prints.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("node")), "nodes")
    known = nodes.filter(F.col("node").isNotNull())
    links = near_links(known, most_bits, segments or segments_for(nodes.count(), most_bits))
    same_id = prints.join(nodes, prints.fingerprint == nodes.fp).filter(F.col("doc_id") != F.col("node"))
    shared = same_id.select("doc_id", "node").join(known.select(F.col("node").alias("doc_id"), F.col("fp").alias("other")), "doc_id")
    links = links.union(shared.select(F.least("doc_id", "node").alias("a"), F.greatest("doc_id", "node").alias("b")))
    groups = components(links)
    reached = nodes.join(groups, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(reached, prints.fingerprint == reached.fp).select(
        "doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(docs: DataFrame, words: int = 4, most_bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its group, and rows without a doc_id, with all columns."""
    left = fresh(docs, "_left_id")
    groups = near_groups(docs, words, most_bits, None, id_col, text_col)
    dropped = groups.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(left)).distinct()
    return docs.join(dropped, docs[id_col] == dropped[left], "left_anti")
