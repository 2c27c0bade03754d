"""Keyed joins of streams and tables.

No side is broadcast by hint: Spark's own size threshold decides, so a table that has
outgrown it is shuffled instead, and adaptive execution splits skewed join partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.operators.ordered import micros, running
from tidegate.operators.scans import scan_groups
from tidegate.operators.windows import session_bounds
from tidegate.session import materialized, rows_per_task


def latest_ttl_join(
    left: DataFrame, right: DataFrame, key: str, ts: str, tie: str, ttl_seconds: int
) -> DataFrame:
    """Stream-stream join that keeps only each side's latest message per key.

    Every arriving message is stored for its side, then joined to the other side's latest
    message if that is younger than the TTL: at most one output per arrival. Arrival order
    is (ts, left before right, tie). Both inputs need ``key``, ``ts`` and ``tie``; the
    output has structs ``l`` and ``r`` and the arrival's ``ts``.
    """
    merged = _tagged(left, key, ts, tie, 0, "l").unionByName(_tagged(right, key, ts, tie, 1, "r"), True)
    seen = running(
        merged, [key], ["_ts", "_side", "_tie"], (micros("_ts"), F.col("_side") * F.lit(2**52) + F.col("_tie")),
        {"_last_l": ("last", "l"), "_last_r": ("last", "r")}, include_current=False,
    )
    other = F.when(F.col("_side") == 0, F.col("_last_r")[ts]).otherwise(F.col("_last_l")[ts])
    young = F.unix_micros(other) > F.unix_micros("_ts") - ttl_seconds * 1_000_000
    return seen.filter(young).select(
        key, F.col("_ts").alias("ts"),
        F.coalesce("l", "_last_l").alias("l"), F.coalesce("r", "_last_r").alias("r"),
    )


def _tagged(df: DataFrame, key: str, ts: str, tie: str, side: int, name: str) -> DataFrame:
    return df.select(
        key, F.col(ts).alias("_ts"), F.lit(side).alias("_side"), F.col(tie).alias("_tie"),
        F.struct(*df.columns).alias(name),
    )


def interval_join(
    left: DataFrame, right: DataFrame, key: str, lts: str, rts: str, seconds: int, how: str = "inner"
) -> DataFrame:
    """All pairs of one key at most ``seconds`` apart, for batch tables.

    The join is an equi-join on (key, time bucket): a hot key is spread over its buckets
    and rows far apart in time never meet. A right row goes to the at most two buckets
    its interval touches; a left row stays in one, so a left outer join is exact.
    """
    d = seconds * 1_000_000
    width = max(2 * d, 1)

    def bucket(t: Column) -> Column:
        return t - F.pmod(t, F.lit(width))

    t = F.unix_micros(F.col(rts))
    touched = F.sequence(bucket(t - d), bucket(t + d), F.lit(width).cast("bigint"))
    spread = right.withColumn("_b", F.explode(touched)).withColumnRenamed(key, "_rkey")
    bucketed = left.withColumn("_lb", bucket(F.unix_micros(F.col(lts))))
    near = F.abs(F.unix_micros(F.col(lts)) - F.unix_micros(F.col(rts))) <= d
    joined = bucketed.join(spread, (F.col(key) == F.col("_rkey")) & (F.col("_lb") == F.col("_b")) & near, how)
    return joined.drop("_lb", "_b", "_rkey")


def interval_join_stream(
    left: DataFrame, right: DataFrame, on: Column, lts: str, rts: str, interval: str, how: str = "inner"
) -> DataFrame:
    """The same pairs on two streams; both sides must carry a watermark, which lets Spark drop old state.

    Inner and right outer joins are on time buckets of twice the interval too, so a row meets only those of its key
    that are near in time: a right row is in one bucket, a left row in the two or so its interval touches. Other kinds,
    to which each left row must come once, join on ``on`` alone.
    """
    bound = F.expr(f"{rts} BETWEEN {lts} - INTERVAL {interval} AND {lts} + INTERVAL {interval}")
    if how not in ("inner", "right", "right_outer", "rightouter"):
        return left.join(right, on & bound, how)
    width = F.greatest(F.expr(f"2 * unix_micros(timestamp_micros(0) + INTERVAL {interval})"), F.lit(1).cast("bigint"))

    def bucket(t: str) -> Column:
        t = F.unix_micros(F.expr(t))
        return t - F.pmod(t, width)

    touched = F.sequence(bucket(f"{lts} - INTERVAL {interval}"), bucket(f"{lts} + INTERVAL {interval}"), width)
    spread = left.withColumn("_lb", F.explode(touched))
    joined = spread.join(right.withColumn("_b", bucket(rts)), on & (F.col("_lb") == F.col("_b")) & bound, how)
    return joined.drop("_lb", "_b")


def stream_table_join(stream: DataFrame, table: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Look each message up in a table. ``how`` is inner, left or right as the SQL layer allows."""
    return stream.join(table, keys, how)


def merge_join(sources: list[DataFrame], key: str, how: str = "inner") -> DataFrame:
    """N-way join on one key; ``how`` is inner (all sources have the key) or full_outer (any has it).

    Give the sources with one row per key first, so that only the last join meets duplicates.
    """
    return reduce(lambda a, b: a.join(b, key, how), sources)


def merge_unique(sources: list[DataFrame], key: str, how: str = "inner") -> DataFrame:
    """The same for sources with at most one row per key: the sources are merged by one aggregation,
    with one shuffle however many there are."""
    def packed(i: int, df: DataFrame) -> DataFrame:
        return df.select(key, F.struct(*[c for c in df.columns if c != key]).alias(f"_s{i}"))

    merged = reduce(lambda a, b: a.unionByName(b, True), [packed(i, df) for i, df in enumerate(sources)])
    slots = [f"_s{i}" for i in range(len(sources))]
    # Each slot of a key has one value, so any non-null one is it.
    grouped = merged.groupBy(key).agg(*[F.any_value(s, ignoreNulls=True).alias(s) for s in slots])
    if how == "inner":
        grouped = grouped.dropna(subset=slots)
    return grouped.select(key, *[f"{s}.*" for s in slots])


def override_join(sources: list[DataFrame], key: str) -> DataFrame:
    """Per key keep the rows of the right-most source that has it. Sources share a schema."""
    kept, later = [], None
    for source in reversed(sources):
        kept.append(source if later is None else source.join(later, key, "left_anti"))
        keys = source.select(key)
        later = keys.distinct() if later is None else later.union(keys).distinct()
    return reduce(lambda a, b: a.unionByName(b), reversed(kept))


def tagged_join(sources: dict[str, DataFrame], key: str, value: str) -> DataFrame:
    """Reduce-side join of tagged sources with one ``value`` per key and tag.

    The tagged rows are merged by one aggregation per key; keys found under fewer than two
    tags are dropped. Output: key, ``tags`` and one column per tag.
    """
    rows = reduce(
        lambda a, b: a.unionByName(b),
        [df.select(key, F.lit(tag).alias("_tag"), F.col(value).alias("_value")) for tag, df in sources.items()],
    )
    grouped = rows.groupBy(key).agg(
        *[F.max(F.when(F.col("_tag") == tag, F.col("_value"))).alias(tag) for tag in sources],
        *[F.max((F.col("_tag") == tag).cast("int")).alias(f"_has_{tag}") for tag in sources],
    )
    tags = reduce(lambda a, b: a + b, [F.col(f"_has_{tag}") for tag in sources])
    return grouped.withColumn("tags", tags).filter("tags >= 2").select(key, "tags", *sources)


def tagged_product(
    sources: dict[str, DataFrame], key: str, combine: Callable[[dict[str, Column]], Column], least_tags: int = 2, bag_rows: int | None = None
) -> DataFrame:
    """Reduce-side join: per key every combination of one row of each source that has the key, put together by the
    caller. ``combine`` gets a struct of each tag's other columns, null where the source lacks the key, and returns a
    column; a null one drops the combination. Output: key, ``tags`` (how many sources have the key) and ``result``.

    A bag, the rows of a key under one tag, with more than ``bag_rows`` rows (by default what a task should hold) is
    cut into blocks. The other bags of that key go to every block, or block by block if they are cut too, so that no
    task meets more than one block of each. Such keys number at most rows / ``bag_rows``. Rows with a null key meet no
    others.
    """
    tags = list(sources)
    most = bag_rows or rows_per_task(sources[tags[0]].sparkSession)
    sizes = reduce(
        lambda a, b: a.unionByName(b), [df.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_tag", F.lit(t)) for t, df in sources.items()]
    )
    large = sizes.filter((F.col("_n") > most) & F.col("_k").isNotNull()).withColumn("_b", F.ceil(F.col("_n") / most)).collect()
    cuts: dict = {}
    for row in large:
        cuts.setdefault(row["_k"], {})[row["_tag"]] = int(row["_b"])
    grid = None
    if cuts:
        spark, kind = sources[tags[0]].sparkSession, sources[tags[0]].schema[key].dataType.simpleString()
        grid = spark.createDataFrame([(k, [b.get(t, 1) for t in tags]) for k, b in cuts.items()], f"_k {kind}, _blocks array<int>")

    def placed(place: int, tag: str) -> DataFrame:
        df = sources[tag]
        rows = df.select(key, F.struct(F.lit(1).alias("_there"), *[c for c in df.columns if c != key]).alias(tag))
        if grid is None:
            return rows.withColumn("_cell", F.lit(0))
        # A cell is a block of each bag; a row goes to all cells that hold its own block.
        blocks = F.col("_blocks")

        def times(parts: Column) -> Column:
            return F.aggregate(parts, F.lit(1), lambda a, b: a * b)

        low, high = times(F.slice(blocks, 1, place)) if place else F.lit(1), times(F.slice(blocks, place + 2, len(tags)))
        cells = F.flatten(F.transform(F.sequence(F.lit(0), high - 1), lambda h: F.transform(
            F.sequence(F.lit(0), low - 1), lambda i: (h * F.get(blocks, F.lit(place)) + F.col("_own")) * low + i
        )))
        # Blocks are drawn, so that equal rows spread too, and written, so that a task run again meets the same ones.
        drawn = rows.join(F.broadcast(grid), F.col(key) == F.col("_k")).withColumn("_own", F.floor(F.rand() * F.get(blocks, F.lit(place))).cast("int"))
        cut = materialized(drawn, "bags").select(key, tag, F.explode(cells).alias("_cell"))
        return rows.join(F.broadcast(grid), F.col(key) == F.col("_k"), "left_anti").withColumn("_cell", F.lit(0)).unionByName(cut)

    met = reduce(lambda a, b: a.join(b, [key, "_cell"], "full_outer"), [placed(i, t) for i, t in enumerate(tags)])
    if grid is not None:  # a block may stay empty, but its bag is there
        needed = F.broadcast(grid.select(F.col("_k").alias("_k2"), F.col("_blocks").alias("_cut")))
        met = met.join(needed, F.col(key) == F.col("_k2"), "left")
        for i, tag in enumerate(tags):
            met = met.filter(F.col("_cut").isNull() | (F.get("_cut", F.lit(i)) == 1) | F.col(tag).isNotNull())
    there = reduce(lambda a, b: a + b, [F.col(t).isNotNull().cast("int") for t in tags])
    out = met.withColumn("tags", there).filter(F.col("tags") >= least_tags).select(key, "tags", combine({t: F.col(t) for t in tags}).alias("result"))
    return out.filter(F.col("result").isNotNull())


def completion_epochs(df: DataFrame, key: str, epoch: str, part: str, order: list[str], ts: str, expected: int) -> DataFrame:
    """Completion over epochs. Per key the newest epoch that has arrived is the open one: its distinct parts are
    gathered, parts of older epochs are ignored, and a newer epoch opens in its place. One row per (key, epoch) that
    completes, COMPLETED at the arrival of its last expected part, or that a newer one replaces before, INCOMPLETE at
    the newer one's arrival; ``parts`` is what had arrived. An epoch that never was the newest has no row, nor has one
    still open. ``order`` is the order of arrival and begins with ``ts``.

    Only the first arrival of each (key, epoch, part) counts, which is found on the map side; what is ordered per key
    is one row per epoch.
    """
    arrival = F.struct(*order)
    first = df.groupBy(key, epoch, part).agg(F.min(arrival).alias("_at"))
    starts = first.groupBy(key, epoch).agg(F.min("_at").alias("_start"))
    newer = Window.partitionBy(key).orderBy(F.desc(epoch)).rowsBetween(Window.unboundedPreceding, -1)
    opened = starts.withColumn("_end", F.min("_start").over(newer)).filter(F.col("_end").isNull() | (F.col("_start") < F.col("_end")))
    same = [F.col(c).eqNullSafe(F.col(f"_o_{c}")) for c in (key, epoch)]
    opened = opened.select(F.col(key).alias(f"_o_{key}"), F.col(epoch).alias(f"_o_{epoch}"), "_end")
    seen = first.join(opened, reduce(lambda a, b: a & b, same)).filter(F.col("_end").isNull() | (F.col("_at") < F.col("_end")))
    place = F.row_number().over(Window.partitionBy(key, epoch).orderBy("_at"))
    gathered = seen.withColumn("_place", place).filter(F.col("_place") <= expected).groupBy(key, epoch).agg(
        F.max("_place").cast("bigint").alias("parts"), F.max("_at").alias("_last"), F.max("_end").alias("_end")
    )
    whole = F.col("parts") == expected
    told = gathered.filter(whole | F.col("_end").isNotNull())
    at = F.when(whole, F.col("_last")[ts]).otherwise(F.col("_end")[ts])
    return told.select(key, epoch, F.when(whole, "COMPLETED").otherwise("INCOMPLETE").alias("status"), "parts", at.alias("at"))


def completion_join(df: DataFrame, key: str, epoch: str, part: str, ts: str, expected: int) -> DataFrame:
    """Per (key, epoch): the moment the last of ``expected`` distinct parts arrived; incomplete epochs give no row."""
    first_seen = df.groupBy(key, epoch, part).agg(F.min(ts).alias("_seen"))
    done = first_seen.groupBy(key, epoch).agg(F.count(F.lit(1)).alias("_parts"), F.max("_seen").alias("completed_at"))
    return done.filter(F.col("_parts") == expected).drop("_parts")


def lookup_distinct(stream: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Table reads with a read-through cache: each distinct key is looked up once, then joined back."""
    found = stream.select(key).distinct().join(table, key, "left")
    return stream.join(found, key, "left")


class _Loads:
    """The cache's entry of a key: what was loaded or put last, and when."""

    def __init__(self, ttl: int):
        self.ttl, self.value, self.since = ttl, None, None

    def step(self, row: tuple) -> Iterable[tuple]:
        t, write, ident, current, _ = row
        if write:
            self.value, self.since = current, t
            return ()
        hit = self.since is not None and t < self.since + self.ttl
        if not hit:  # an absent row is not kept
            self.value, self.since = current, t if current is not None else None
        return ((t, ident, self.value, hit, self.since),)

    def end(self) -> Iterable[tuple]:
        return ()


def cached_reads(
    reads: DataFrame, writes: DataFrame, key: str, ts: str, ident: str, value: str,
    write_ttl: float, read_ttl: float, write_around: bool = True,
) -> DataFrame:
    """Reads of a table through a cache: (key, ts, ``ident``, value, hit, loaded_at) per read, times as microseconds.

    ``writes`` (key, ts, ident, value) are the table's versions. A read finds the cache's entry if it was loaded less
    than ``write_ttl`` seconds ago and used less than ``read_ttl`` seconds ago, however the table has changed since;
    otherwise it loads the table's newest version, from a write no later than the read. With ``write_around`` writes
    go to the table alone; without, they also renew the entry. A key the table does not have is loaded at each read.

    What a read would load is an as-of join. Uses further apart than ``read_ttl`` cannot share an entry, so each run
    of closer ones is followed by itself, which spreads a hot key; a task holds one entry.
    """
    kind = writes.schema[value].dataType.simpleString()
    version = F.struct(F.col(value).alias("v"))
    events = reads.select(key, ts, F.lit(1).alias("_read"), F.col(ident).alias("_id"), F.lit(None).cast(f"struct<v:{kind}>").alias("_version")).unionByName(
        writes.select(key, ts, F.lit(0).alias("_read"), F.col(ident).alias("_id"), version.alias("_version"))
    )
    known = running(
        events, [key], [ts, "_read", "_id"], (micros(ts), F.col("_read") * F.lit(2**52) + F.col("_id")), {"_now": ("last", "_version")}
    )
    uses = known.filter("_read = 1") if write_around else known
    uses = uses.select(key, micros(ts).alias("_t"), (F.col("_read") == 0).alias("_write"), "_id", F.col("_now.v").alias("_value"))
    runs, start = session_bounds(uses, F.col("_t"), round(read_ttl * 1_000_000) - 1, [key]), "_start"
    ident_kind = reads.schema[ident].dataType.simpleString()
    schema = f"`{ts}` bigint, `{ident}` {ident_kind}, `{value}` {kind}, hit boolean, loaded_at bigint"
    ttl = round(write_ttl * 1_000_000)
    order = ["_t", "_is_read", "_id"]
    ordered = runs.select(key, start, "_t", "_write", "_id", "_value", (~F.col("_write")).alias("_is_read"))
    return scan_groups(ordered, [key, start], order, lambda k: _Loads(ttl), schema).drop(start)


def side_input(side: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """Fold a secondary stream into its latest row per key, to be joined by the main input."""
    rest = [c for c in side.columns if c != key]
    latest = F.max_by(F.struct(*rest), F.struct(ts, tie)).alias("_v")
    return side.groupBy(key).agg(latest).select(key, *[F.col(f"_v.{c}").alias(c) for c in rest])
