"""Approximate nearest neighbours by balanced posting lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegate.session import materialized

SAMPLE_ROWS = 20_000
MOST_CENTROIDS = 4_096
LIST_ROWS = 200
REPLICAS = 4
WITHIN = 1.15
SEARCH_WITHIN = 1.6
SEARCH_LISTS = 256
FIRST_LISTS = 8  # searched first, for the distance that the other lists' vectors must not exceed
PART_ROWS = 4_096


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v) of the rows that take part: neither is null, the vector is not zero and its components are finite."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.col(id_col).isNotNull() & v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)
    return vectors.filter(whole).select(F.col(id_col).cast("bigint").alias("id"), v.alias("v"))


def balanced_centroids(sample: np.ndarray, lists: int, seed: int = 5) -> np.ndarray:
    """About ``lists`` centroids: the sample is halved at the median along its widest direction until parts are small
    enough, so all parts hold equally many rows; then a few rounds of k-means move the centroids into their midst."""
    random = np.random.default_rng(seed)
    parts, size = [np.arange(len(sample))], max(1, len(sample) // max(1, lists))
    done = []
    while parts:
        rows = parts.pop()
        if len(rows) <= size * 1.5:
            done.append(rows)
            continue
        x = sample[rows] - sample[rows].mean(0)
        way = random.standard_normal(sample.shape[1])
        for _ in range(6):
            way = x.T @ (x @ way)
            norm = np.linalg.norm(way)
            if norm == 0:
                break
            way /= norm
        order = np.argsort(x @ way, kind="stable")
        parts += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    centroids = np.array([sample[rows].mean(0) for rows in done])
    for _ in range(4):
        near = np.concatenate([_squares(sample[a : a + 4096], centroids).argmin(1) for a in range(0, len(sample), 4096)])
        counts = np.bincount(near, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, sample)
        centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids)
    return np.unique(centroids, axis=0)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None], 0)


class CentroidGraph:
    """Neighbour graph over the centroids and best-first search in it, many vectors at a time."""

    def __init__(self, centroids: np.ndarray, degree: int = 24, entries: int = 64):
        self.centroids = centroids
        k = len(centroids)
        near = np.concatenate([np.argsort(_squares(centroids[a : a + 512], centroids), axis=1, kind="stable")[:, 1 : degree + 1] for a in range(0, k, 512)])
        # Links go both ways, so that every centroid can be reached from its neighbours; the rest is filled up with itself.
        links: list[list[int]] = [list(row) for row in near.tolist()]
        for i, row in enumerate(near.tolist()):
            for j in row:
                if len(links[j]) < 2 * degree and i not in links[j]:
                    links[j].append(i)
        width = max(map(len, links), default=0)
        self.links = np.array([row + [i] * (width - len(row)) for i, row in enumerate(links)], np.int64).reshape(k, width)
        self.entries = np.unique(np.linspace(0, k - 1, min(entries, k)).astype(np.int64))

    def nearest(self, x: np.ndarray, many: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
        """The ``many`` nearest centroids found for each row, nearest first, and their squared distances.

        A beam: it starts at the nearest entries, and every round looks at the links of the best centroids not yet
        looked at, until none of the beam is new.
        """
        k, beam = len(self.centroids), min(max(many, 16) + 16, len(self.centroids))
        n = len(x)
        squares = np.full((n, k), np.inf, np.float32)
        opened = np.zeros((n, k), bool)
        norms = (self.centroids * self.centroids).sum(1)

        def look(rows: np.ndarray, at: np.ndarray) -> None:
            new = np.isinf(squares[rows, at])
            rows, at = rows[new], at[new]
            for s in range(0, len(rows), 65536):
                r, c = rows[s : s + 65536], at[s : s + 65536]
                dots = np.einsum("ij,ij->i", x[r], self.centroids[c])
                squares[r, c] = np.maximum((x[r] * x[r]).sum(1) - 2 * dots + norms[c], 0)

        squares[:, self.entries] = _squares(x, self.centroids[self.entries])
        for _ in range(rounds):
            best = np.argpartition(squares, beam - 1, axis=1)[:, :beam] if beam < k else np.tile(np.arange(k), (n, 1))
            rows = np.repeat(np.arange(n), best.shape[1])
            at = best.ravel()
            new = ~opened[rows, at] & np.isfinite(squares[rows, at])
            if not new.any():
                break
            rows, at = rows[new], at[new]
            opened[rows, at] = True
            look(np.repeat(rows, self.links.shape[1]), self.links[at].ravel())
        many = min(many, k)
        best = np.argsort(squares, axis=1, kind="stable")[:, :many]
        return best, np.take_along_axis(squares, best, 1)


def build_lists(vectors: DataFrame, graph: Broadcast) -> DataFrame:
    """(list_no, id, v): every vector, in the list of its nearest centroid and, at a boundary, of others as near.

    A vector is copied to the lists whose centroids are at most WITHIN times as far as the nearest, REPLICAS at most.
    """

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = np.array(part.column(1).flatten(), np.float64).reshape(part.num_rows, -1)
                lists, squares = graph.value.nearest(x, REPLICAS)
                chosen = squares <= squares[:, :1] * WITHIN**2
                rows, which = np.nonzero(chosen)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lists[rows, which].astype(np.int32)), part.column(0).take(pa.array(rows)), part.column(1).take(pa.array(rows))],
                    ["list_no", "id", "v"],
                )

    return vectors.mapInArrow(place, "list_no int, id bigint, v array<double>")


def choose_lists(queries: DataFrame, graph: Broadcast, most: int, within: float | None) -> DataFrame:
    """(list_no, place, id, v): the lists to search for each query, nearest first: of the ``most`` nearest centroids
    those at most ``within`` times as far as the nearest, or all."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = np.array(part.column(1).flatten(), np.float64).reshape(part.num_rows, -1)
                lists, squares = graph.value.nearest(x, most)
                rows, which = np.nonzero(squares <= squares[:, :1] * within**2 if within else np.isfinite(squares))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(lists[rows, which].astype(np.int32)), pa.array(which.astype(np.int32)),
                        part.column(0).take(pa.array(rows)), part.column(1).take(pa.array(rows)),
                    ],
                    ["list_no", "place", "id", "v"],
                )

    return queries.mapInArrow(choose, "list_no int, place int, id bigint, v array<double>")


def nearest_in(queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of the query, id, distance) of the ``many`` nearest vectors to each query, ties to smaller ids."""
    many = min(many, len(ids))
    rough = _squares(queries, vectors)
    # Rounding of the fast form must not lose a neighbour: take all that may be among the nearest, then measure exactly.
    slack = 1e-9 * ((queries * queries).sum(1)[:, None] + (vectors * vectors).sum(1)[None]) + 1e-300
    limit = np.partition(rough + slack, many - 1, axis=1)[:, many - 1 : many]
    rows, at = np.nonzero(rough - slack <= limit)
    exact = np.empty(len(rows))
    for s in range(0, len(rows), 65536):
        d = queries[rows[s : s + 65536]] - vectors[at[s : s + 65536]]
        exact[s : s + 65536] = np.sqrt((d * d).sum(1))
    order = np.lexsort((ids[at], exact, rows))
    rows, at, exact = rows[order], at[order], exact[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    kept = place < many
    return rows[kept], ids[at[kept]], exact[kept]


def _compared(lists: DataFrame, searched: DataFrame, k: int) -> DataFrame:
    """(of, id, score): vectors of the lists searched for each query, the k + 1 nearest of each part of a list, and of
    these only those at most ``most`` away, the query's own limit."""
    parts = lists.groupBy("list_no").agg(F.ceil(F.count("*") / PART_ROWS).alias("parts"))
    shares = searched.groupBy("list_no").agg(F.ceil(F.count("*") / PART_ROWS).alias("shares"))
    plan = parts.join(shares, "list_no")
    hashed = lambda c: F.pmod(F.xxhash64("id"), F.col(c))
    stored = lists.join(plan, "list_no").select("list_no", hashed("parts").alias("part"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), "id", "v")
    sought = searched.join(plan, "list_no").select("list_no", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), hashed("shares").alias("share"), "id", "v", "most")
    by = ["list_no", "part", "share"]

    def compare(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(rows):
            return pd.DataFrame({"of": [], "id": [], "score": []}).astype({"of": "int64", "id": "int64", "score": "float64"})
        x, y = np.stack(queries["v"].to_numpy()), np.stack(rows["v"].to_numpy())
        asking, ids, most = queries["id"].to_numpy(), rows["id"].to_numpy(), queries["most"].to_numpy()
        out = []
        for a in range(0, len(x), 256):
            row, found, score = nearest_in(x[a : a + 256], ids, y, k + 1)
            near = score <= most[a : a + 256][row]
            out.append(pd.DataFrame({"of": asking[a : a + 256][row[near]], "id": found[near], "score": score[near]}))
        return pd.concat(out)

    return sought.groupBy(*by).cogroup(stored.groupBy(*by)).applyInPandas(compare, "of bigint, id bigint, score double").distinct()


def _nearest(found: DataFrame, k: int) -> DataFrame:
    return found.withColumn("p", F.row_number().over(Window.partitionBy("of").orderBy("score", "id"))).filter(F.col("p") <= k + 1)


def _searched(lists: DataFrame, searched: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """(of, score, ids): the k + 1 nearest vectors to each query among its lists, with the rows that have them.

    The nearest lists come first. The k + 1st distance in them is a limit for all others, whose tasks give out only
    what is not farther; that loses no neighbour, and what leaves the tasks does not grow with the lists searched."""
    anywhere = F.lit(float("inf"))
    first = materialized(_nearest(_compared(lists, searched.filter(F.col("place") < FIRST_LISTS).withColumn("most", anywhere), k), k), "first-lists")
    limits = first.filter(F.col("p") == k + 1).select(F.col("of").alias("id"), F.col("score").alias("limit"))
    others = searched.filter(F.col("place") >= FIRST_LISTS).join(limits, "id", "left").withColumn("most", F.coalesce("limit", anywhere))
    both = first.drop("p").unionByName(_compared(lists, others.drop("limit"), k)).distinct()
    return _nearest(both, k).join(members.select("id", "ids"), "id").select("of", "score", "ids")


def search(
    vectors: DataFrame, every: int = 100, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
    sample_rows: int = SAMPLE_ROWS, most_lists: int = SEARCH_LISTS, within: float = SEARCH_WITHIN,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest vectors found for each row whose id is divisible by ``every``.

    Nearness is the Euclidean distance in double precision, ties go to smaller ids, a query's own row is no candidate.
    The centroids are fitted on about ``sample_rows`` rows, MOST_CENTROIDS at most, so what is broadcast has a bound;
    every vector is listed. Equal vectors are searched as one: the k + 1 smallest ids of each are enough for any
    query, so a vector that fills a third of the table costs no more than another. Lists longer than PART_ROWS are
    dealt into parts, as are the queries of a list, and each task compares one part with one part; at most k + 1 rows
    per query and part leave it, and beyond the FIRST_LISTS nearest lists none farther than the k + 1st so far. A query whose lists hold fewer than k other rows is asked of more lists, and at last
    of all vectors, so it gets fewer than k rows only if the table has no more.

    Rows with a null id or with a vector that is null, zero or not finite take no part, nor do vectors of another
    length than the most frequent (of equally frequent ones, the shortest). Rows that repeat an id and vector count
    once. Other columns are not read; an empty table gives an empty one.
    """
    spark = vectors.sparkSession
    known = usable(vectors, id_col, vector_col)
    lengths = known.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if lengths is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    known = known.filter(F.size("v") == lengths["d"])
    first = Window.partitionBy("v").orderBy("id")
    smallest = known.distinct().withColumn("place", F.row_number().over(first)).filter(F.col("place") <= k + 1)
    members = smallest.groupBy("v").agg(F.min("id").alias("id"), F.sort_array(F.collect_list("id")).alias("ids"))
    members = materialized(members.select("id", "v", "ids"), "vectors")
    n = members.count()
    chosen = members.filter(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1_000_000)) < F.lit(max(1, int(1e6 * min(1.0, sample_rows / n))))).select("v")
    sample = np.array([r["v"] for r in chosen.collect()] or [members.select("v").first()["v"]])
    centroids = balanced_centroids(sample, int(max(1, min(MOST_CENTROIDS, n // LIST_ROWS, len(sample) // 4))))

    graph = spark.sparkContext.broadcast(CentroidGraph(centroids))  # MOST_CENTROIDS at most
    lists = materialized(build_lists(members.select("id", "v"), graph), "lists")
    asked = known.filter(F.col("id") % every == 0).select(F.col("id").alias("query_id"), "v").distinct()
    asked = materialized(asked.join(members.select("v", F.col("id").alias("of")), "v").select("query_id", "of", "v"), "queries")
    searched = materialized(choose_lists(asked.select(F.col("of").alias("id"), "v").distinct(), graph, most_lists, within), "sought")

    near = materialized(_searched(lists, searched, members, k), "near")
    # Queries whose lists hold too few: the nearest lists however far they are, then the whole table as one list.
    whole = lambda df: df.select(F.lit(0).alias("list_no"), F.lit(0).alias("place"), "id", "v")
    for wider in (lambda q: (lists, choose_lists(q, graph, most_lists, None)), lambda q: (whole(members), whole(q))):
        held = near.groupBy("of").agg(F.sum(F.size("ids")).alias("held"))
        wanting = asked.select("of", "v").distinct().join(held, "of", "left").filter(F.coalesce("held", F.lit(0)) < k + 1)
        wanting = materialized(wanting.select(F.col("of").alias("id"), "v"), "wanting")
        if wanting.isEmpty():
            break
        more = materialized(_searched(*wider(wanting), members, k), "near")
        near = near.join(wanting.select(F.col("id").alias("of")), "of", "left_anti").unionByName(more)

    spread = near.select("of", "score", F.explode("ids").alias("vec_id"))
    best = Window.partitionBy("of").orderBy("score", "vec_id")
    nearest = spread.withColumn("p", F.row_number().over(best)).filter(F.col("p") <= k + 1)
    results = asked.select("query_id", "of").join(nearest, "of").filter(F.col("vec_id") != F.col("query_id"))
    ranked = results.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
