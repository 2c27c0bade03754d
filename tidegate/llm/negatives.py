"""Hard negatives: rows of another label that score somewhat below an anchor's positives, found through segment summaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegate.session import materialized, work_path

BLOCK_ANCHORS = 4_096  # what is broadcast at once
CHUNK_PAIRS = 2_000_000
DENSE = 16  # below one pair in so many, pairs are bounded and scored one by one, else all of a chunk at once

STORED = "id bigint, label int, v array<double>, means array<double>, deviations array<double>"


def levels(width: int) -> list[np.ndarray]:
    """Starts of the segments of each level: one segment, then four times as many, down to four components each."""
    counts = [1] if width else []
    while counts and counts[-1] * 16 <= width:
        counts.append(counts[-1] * 4)
    return [np.arange(n) * width // n for n in counts]


def summaries(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean, times the root of the segment's size, and deviation of every segment of every level. The deviation is the
    length of what is left of a segment without its mean."""
    means, deviations = [np.zeros((len(values), 0))], [np.zeros((len(values), 0))]
    for starts in levels(values.shape[1]):
        sizes = np.diff(np.append(starts, values.shape[1]))
        mean = np.add.reduceat(values, starts, axis=1) / sizes
        rest = values - np.repeat(mean, sizes, axis=1)
        means.append(mean * np.sqrt(sizes))
        deviations.append(np.sqrt(np.add.reduceat(rest * rest, starts, axis=1)))
    return np.hstack(means), np.hstack(deviations)


class Vectors:
    """Rows of the stored table as matrices."""

    def __init__(self, table: pa.RecordBatch | pa.Table):
        def square(name: str) -> np.ndarray:
            column = table.column(name)
            column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
            flat = column.flatten().to_numpy(zero_copy_only=False)
            return flat.reshape(len(column), len(flat) // max(1, len(column)))

        self.ids, self.label = (table.column(c).to_numpy() for c in ("id", "label"))
        self.values, self.means, self.deviations = square("v"), square("means"), square("deviations")
        ends = np.cumsum([0, *[len(s) for s in levels(self.values.shape[1])]])
        self.levels = [slice(a, b) for a, b in zip(ends, ends[1:])]


def bounds(a: Vectors, b: Vectors, level: slice, pairs: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product, of all rows of ``a`` with all of ``b`` or of pairs of them: the product of the
    means, more or less the product of the deviations, added up over the level's segments."""
    x, y, dx, dy = a.means[:, level], b.means[:, level], a.deviations[:, level], b.deviations[:, level]
    if pairs is None:
        middle, off, size = x @ y.T, dx @ dy.T, np.abs(x) @ np.abs(y).T
    else:
        i, j = pairs
        products = x[i] * y[j]
        middle, off, size = products.sum(1), (dx[i] * dy[j]).sum(1), np.abs(products).sum(1)
    off = off + 1e-9 * (size + off) + 1e-6  # what rounding may add
    return middle - off, middle + off


def kth_largest(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest value of each row, minus infinity where a row is shorter."""
    if values.shape[1] < k:
        return np.full(len(values), -np.inf)
    return np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k]


def best_pairs(
    anchors: Vectors, rows: Vectors, allowed: np.ndarray, windows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int
) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each window (low, high, least; one of each per anchor) the pairs (anchor, row, score) that may be among the
    k best of their anchor with a score from low to high, and of least at least.

    Level by level a pair goes if its bounds leave the window, or if k rows of its anchor are sure to lie in the window
    and to score higher. Only what the last level leaves is scored in full.
    """
    stay = [allowed & (low <= high)[:, None] for low, high, _ in windows]
    below = above = np.zeros(allowed.shape)
    for step in [*anchors.levels, None]:
        wanted = np.logical_or.reduce(stay)
        many = np.count_nonzero(wanted)
        if many * DENSE > wanted.size:
            below, above = bounds(anchors, rows, step) if step else (anchors.values @ rows.values.T,) * 2
        elif many:
            i, j = np.nonzero(wanted)
            if step:
                below[i, j], above[i, j] = bounds(anchors, rows, step, (i, j))
            else:
                for a in range(0, many, 65_536):
                    p, q = i[a : a + 65_536], j[a : a + 65_536]
                    below[p, q] = (anchors.values[p] * rows.values[q]).sum(1)
                above = below
        for w, (low, high, least) in enumerate(windows):
            sure = stay[w] & (below >= low[:, None]) & (above <= high[:, None])
            floor = np.maximum(np.maximum(low, least), kth_largest(np.where(sure, below, -np.inf), k))
            stay[w] &= (above >= floor[:, None]) & (below <= high[:, None])
    found = [np.nonzero(s) for s in stay]
    return [(i, j, below[i, j]) for i, j in found]


def first_of(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k rows of each group, by falling score and then by rising id."""
    order = np.lexsort((ids, -score, group))
    rank = np.arange(len(order)) - np.searchsorted(group[order], group[order])
    return order[rank < k]


def scored(rows: DataFrame, block: Vectors, windows: list[tuple[np.ndarray, np.ndarray]], same_label: bool, k: int) -> DataFrame:
    """(anchor, window, id, score, rank): the first k rows of each window of each anchor of the block, among the rows of
    the anchor's label or of the others. A task holds and gives back k rows per anchor and window, whatever it reads."""
    sent = rows.sparkSession.sparkContext.broadcast((block, windows))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, windows = sent.value
        n = len(block.ids)
        step = max(1, CHUNK_PAIRS // n)
        held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)) for _ in windows]
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = Vectors(batch.slice(at, step))
                allowed = ((block.label[:, None] == part.label) == same_label) & (block.ids[:, None] != part.ids)
                limits = []
                for (low, high), (group, _, score) in zip(windows, held):
                    least = np.full(n, -np.inf)
                    full = np.bincount(group, minlength=n) == k
                    least[full] = np.minimum.reduceat(score, np.searchsorted(group, np.nonzero(full)[0])) if full.any() else 0
                    limits.append((low, high, least))
                for w, (i, j, score) in enumerate(best_pairs(block, part, allowed, limits, k)):
                    group, ids, score = (np.append(a, b) for a, b in zip(held[w], (i, part.ids[j], score)))
                    first = first_of(group, score, ids, k)
                    held[w] = group[first], ids[first], score[first]
        for w, (group, ids, score) in enumerate(held):
            columns = [pa.array(group, pa.int32()), pa.array(np.full(len(group), w), pa.int32()), pa.array(ids), pa.array(score.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["anchor", "window", "id", "score"])

    found = rows.mapInArrow(search, "anchor int, window int, id bigint, score bigint")
    place = F.row_number().over(Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k)


def with_summaries(rows: DataFrame, width: int) -> DataFrame:
    """The stored table: rows (id, label, v) of whole numbers, each vector with the summaries of its segments."""
    most = float(int((2**53 / max(1, width)) ** 0.5))

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False)
            values = np.clip(flat.reshape(batch.num_rows, width), -most, most)
            arrays = [batch.column("id"), batch.column("label")]
            for m in (values, *summaries(values)):
                offsets = pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32())
                arrays.append(pa.ListArray.from_arrays(offsets, pa.array(m.ravel())))
            yield pa.RecordBatch.from_arrays(arrays, ["id", "label", "v", "means", "deviations"])

    return rows.mapInArrow(summarise, STORED)


def blocks(anchors: DataFrame, most: int) -> list[DataFrame]:
    """The anchors, equal ones once with their number ``times``, as tables of at most ``most`` rows."""
    spark, path = anchors.sparkSession, work_path(anchors.sparkSession, "anchors")
    once = anchors.groupBy(*anchors.columns).agg(F.count("*").alias("times"))
    number = F.monotonically_increasing_id()  # the partition in the upper bits, below them the row's place in it
    name = F.concat_ws("-", F.lit("block"), F.shiftright(number, 33), F.floor(number.bitwiseAND(F.lit(2**33 - 1)) / most))
    once.withColumn("block", name).write.partitionBy("block").parquet(path)
    known = spark.read.schema(once.schema.add("block", "string")).parquet(path)
    groups: list[tuple[int, list[str]]] = []
    for row in known.groupBy("block").count().orderBy("block").collect():
        if not groups or groups[-1][0] + row["count"] > most:
            groups.append((0, []))
        groups[-1] = groups[-1][0] + row["count"], [*groups[-1][1], row["block"]]
    return [known.filter(F.col("block").isin(names)).drop("block") for _, names in groups]


def mine_negatives(
    vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block_anchors: int = BLOCK_ANCHORS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Vectors are arrays of whole numbers and a row's score is its inner product with the anchor. Anchors are the rows
    whose id is divisible by ``every``; an anchor's positives are the first ``positives`` other rows of its label, by
    falling score and rising id. For each of them come the first ``negatives`` rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score. The result is exact.

    All vectors are written once with the summaries of their segments. Anchors come in blocks of at most
    ``block_anchors``, which are broadcast and meet all rows where these lie, so rows are never shuffled: one pass finds
    a block's positives, a second its negatives. Each block's result is written to the shared folder; a lost executor
    costs the tasks it ran.

    Rows with a null id or label, a null vector or a null component take no part, nor do vectors of another length
    than the most frequent (of equally frequent ones, the shortest). A row is never a positive or negative of an anchor
    with its own id. Rows repeated whole are candidates once each; a repeated anchor's results repeat. Components
    beyond the root of 2^53 / length count as that, so that scores are exact. A negative positive score leaves no
    window, so no negatives. Further columns are not read; an empty table gives an empty one.
    """
    spark = vectors.sparkSession
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    known = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("int").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    known = known.dropna().filter(~F.exists("v", lambda x: x.isNull()))
    lengths = known.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "width").first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    rows = materialized(with_summaries(known.filter(F.size("v") == lengths["width"]), lengths["width"]), "summaries")
    path = work_path(spark, "negatives")
    spark.createDataFrame([], schema).write.parquet(path)
    for anchors in blocks(rows.filter(F.col("id") % every == 0), block_anchors):
        table = anchors.toArrow()
        block, times = Vectors(table), table.column("times").to_numpy()
        n = len(times)
        anywhere = np.full(n, -np.inf), np.full(n, np.inf)
        near = scored(rows, block, [anywhere], True, positives).toPandas()
        lows, highs = np.full((positives, n), np.inf), np.full((positives, n), -np.inf)
        place = near["rank"].to_numpy() - 1, near["anchor"].to_numpy()
        score = near["score"].to_numpy()
        lows[place], highs[place] = -(-low * score // 100), high * score // 100
        far = scored(rows, block, list(zip(lows, highs)), False, negatives)
        sides = [(int(a), int(p), int(block.ids[a]), int(i), int(s), int(times[a])) for a, p, i, s in zip(place[1], place[0], near["id"], score)]
        named = spark.createDataFrame(sides, "anchor int, window int, anchor_id bigint, positive_id bigint, positive_score bigint, times bigint")
        pairs = far.join(named, ["anchor", "window"]).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "times")))
        found = pairs.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        found.write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)
