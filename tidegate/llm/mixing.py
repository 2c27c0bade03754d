"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.llm.common import text_or_empty
from tidegate.session import materialized

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
FAN_IN = 64
ROWS_PER_BLOCK = 50_000


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    Sources in code point order, null last, get the weights in turn. ``share`` of all sizes is dealt out by weight; no
    target goes beyond ``most`` times its source's size, and what is above is dealt out again by weight. The fixed
    point of that is min(level * weight, most * size) for one level, found by running sums over the sources in the
    order in which they fill up. One row per source goes through a single task, like any table of weights.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weighed = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")))
    weighed = weighed.withColumn("full", F.lit(most) * F.col("source_size"))
    filling = Window.orderBy(F.col("full") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = filling.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    level = (F.lit(share) * F.sum("source_size").over(everything) - (F.sum("full").over(upto) - F.col("full"))) / (
        F.sum("weight").over(everything) - (F.sum("weight").over(upto) - F.col("weight"))
    )
    return weighed.withColumn("level", level).select(
        "source", "source_size", F.least(F.max("level").over(everything) * F.col("weight"), F.col("full")).alias("target")
    )


def _chance(*keys: Column) -> Column:
    """A number from [0, 1) that depends on the keys alone."""
    return F.xxhash64(*keys).bitwiseAND(F.lit((1 << 53) - 1)).cast("double") / F.lit(float(1 << 53))


def _pair(acc: Column, unit: Column, seed: int) -> Column:
    """One pivotal step: move mass between the open unit and the next until one of them is whole.

    Either the open unit gains what the next one gives, or the reverse, each with the odds that keep both chances as
    they were. The unit that became 0 or 1 joins ``done``, the other one stays open. The mass w * p of both together
    stays the same.
    """
    i, w, p = acc["unit"], acc["unit"]["w"], acc["unit"]["p"]
    v, q = unit["w"], unit["p"]
    up = F.least(w * (1 - p), v * q)  # the open unit gains
    down = F.least(w * p, v * (1 - q))
    gains = _chance(i["k"], unit["k"], F.lit(seed)) * (up + down) < down
    first_whole = F.when(gains, w * (1 - p) <= v * q).otherwise(w * p <= v * (1 - q))
    move = F.when(gains, up).otherwise(-down)

    def held(of: Column, chance: Column) -> Column:
        return F.struct(of["w"].alias("w"), of["k"].alias("k"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), chance)).alias("p"))

    def whole(of: Column, more: Column) -> Column:
        return F.struct(of["k"].alias("k"), F.when(more, 1).otherwise(0).alias("x"))

    open_unit = F.when(first_whole, held(unit, q - move / v)).otherwise(held(i, p + move / w))
    done = F.when(first_whole, whole(i, gains)).otherwise(whole(unit, ~gains))
    return F.struct(open_unit.alias("unit"), F.concat(acc["done"], F.array(done)).alias("done"))


def _tree_level(units: DataFrame, level: int, seed: int, fan_in: int) -> DataFrame:
    """Round groups of about ``fan_in`` units of a source; per group the decisions and the unit left open."""
    group = F.pmod(F.xxhash64("k", F.lit(seed + level)), F.ceil(F.col("n") / fan_in)).alias("g")
    heavy_first = F.sort_array(F.collect_list(F.struct("w", "k", "p")), asc=False)
    grouped = units.select("source", "n", "w", "k", "p", group).groupBy("source", "n", "g").agg(heavy_first.alias("us"))
    nothing = F.array().cast("array<struct<k:struct<doc_id:bigint,size:bigint>,x:int>>")
    start = F.struct(F.col("us")[0].alias("unit"), nothing.alias("done"))
    rest = F.slice("us", 2, F.greatest(F.size("us") - 1, F.lit(0)))
    folded = F.aggregate(rest, start, lambda acc, unit: _pair(acc, unit, seed + level))
    return grouped.select("source", F.ceil(F.col("n") / fan_in).alias("n"), folded.alias("f")).select("source", "n", "f.unit", "f.done")


def mix_units(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 17, fan_in: int = FAN_IN) -> DataFrame:
    """One row per unit, the rows that agree in (doc_id, source, size): these, ``source_size``, ``target``, ``m`` (rows of
    the unit), ``whole`` (copies that each of them has) and ``extra`` (how many of them have one more).

    A source's documents each have target / source_size expected copies. The whole part is certain, and of the m
    fractions of a unit all but a last one below 1, which is rounded by the pivotal method, weighted by size, so that a
    source's words come out within one document of its target. Units are dealt into groups of about ``fan_in`` by a hash
    of their keys, each group is folded to decisions and one open unit, and the open ones are folded again: a reduction
    tree with one round per logarithm of the largest source, none of whose groups grows with the source. Heavy units
    meet first, so that a light one is left. The chances are hashes of keys, so reruns agree. Empty documents weigh
    nothing and are rounded on their own.
    """
    units = sizes.groupBy("source", "doc_id", "size").agg(F.count("*").alias("m"))
    targets = source_targets(sizes, weights, share, most)
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    near = F.abs(F.col("each") - F.round("each")) < 1e-12
    targets = targets.withColumn("each", each).withColumn("whole", F.when(near, F.round("each")).otherwise(F.floor("each")).cast("int"))
    targets = materialized(targets.withColumn("p", F.greatest(F.lit(0.0), F.when(near, 0.0).otherwise(F.col("each") - F.col("whole")))), "targets")
    key = F.struct("doc_id", "size").alias("k")
    few = targets.count() <= 100_000
    begun = units.alias("u").join((F.broadcast(targets) if few else targets).alias("t"), F.col("u.source").eqNullSafe(F.col("t.source")))
    begun = begun.select("u.source", key, "m", "source_size", "target", "whole", (F.col("m") * F.col("p")).alias("share"))
    even = F.abs(F.col("share") - F.round("share")) < 1e-12 * F.col("m")
    begun = begun.withColumn("sure", F.when(even, F.round("share")).otherwise(F.floor("share")).cast("bigint"))
    begun = begun.withColumn("p", F.when(even, 0.0).otherwise(F.col("share") - F.col("sure"))).drop("share")
    begun = materialized(begun.withColumn("w", F.col("k.size").cast("double")), "units")
    open_units = begun.filter((F.col("p") > 0) & (F.col("w") > 0))
    alone = begun.filter((F.col("p") > 0) & (F.col("w") <= 0)).select("source", "k", (_chance(F.col("k"), F.lit(seed)) < F.col("p")).cast("int").alias("x"))
    many = open_units.groupBy("source").agg(F.count("*").alias("n"))
    most_units = many.agg(F.max("n")).first()[0] or 0
    now = open_units.alias("u").join(many.alias("m"), F.col("u.source").eqNullSafe(F.col("m.source"))).select("u.source", "n", "w", "k", "p")
    decided, level = [alone], 0
    while most_units > 0:
        folded = materialized(_tree_level(now, level, seed, fan_in), "tree")
        decided.append(folded.select("source", F.explode("done").alias("d")).select("source", "d.k", "d.x"))
        now = folded.select("source", "n", "unit.w", "unit.k", "unit.p")
        if most_units <= fan_in:
            decided.append(now.select("source", "k", (_chance(F.col("k"), F.lit(seed + 99)) < F.col("p")).cast("int").alias("x")))
            break
        most_units, level = -(-most_units // fan_in), level + 1
    extra = decided[0]
    for part in decided[1:]:
        extra = extra.union(part)
    extra = extra.select(F.col("source").alias("s"), F.col("k.doc_id").alias("d"), F.col("k.size").alias("z"), "x")
    same = [begun["source"].eqNullSafe(F.col("s")), F.col("k.doc_id").eqNullSafe(F.col("d")), F.col("k.size") == F.col("z")]
    return begun.join(extra, same, "left").select(
        "k.doc_id", "source", "k.size", "source_size", "target", "m", "whole", (F.col("sure") + F.coalesce("x", F.lit(0))).alias("extra")
    )


def mix_copies(sizes: DataFrame, **options) -> DataFrame:
    """Copies of each document for rows (doc_id, source, size): doc_id, source, size, source_size, target, copies.

    One row per row of ``sizes``. Rows of one unit (see ``mix_units``) are alike, so they are made from the unit, large
    units in blocks that are spread over the tasks.
    """
    units = materialized(mix_units(sizes, **options), "mixed")
    to = F.lit(ROWS_PER_BLOCK)
    block = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("m") - 1) / to)))
    large = units.filter(F.col("m") > to).withColumn("block", block)
    large = large.repartition(F.col("block"), F.col("doc_id"), F.col("source"), F.col("size"))
    blocks = units.filter(F.col("m") <= to).withColumn("block", F.lit(0).cast("bigint")).union(large)
    row = F.explode(F.sequence(F.col("block") * to + 1, F.least(F.col("m"), (F.col("block") + 1) * to))).alias("row")
    rows = blocks.select("doc_id", "source", "size", "source_size", "target", "whole", "extra", row)
    copies = F.col("whole") + (F.col("row") <= F.col("extra")).cast("int")
    return rows.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"))


def n_words() -> Column:
    return F.regexp_count(text_or_empty("text"), F.lit(WORD)).cast("bigint")


def word_sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size): size is the number of words of the text; null has none."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words().alias("size"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target and taken (words the mix takes) of every row; see ``mix_units``.

    Null doc_ids, sources and texts are values of their own (a null text has size 0); other columns are not read; an
    empty table gives an empty one.
    """
    chosen = mix_copies(materialized(word_sizes(docs), "sizes"), **options)
    return chosen.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with all their columns.

    Where only some rows of a unit have one more copy, these are the first ones by number: within blocks that rows are
    dealt into by chance and written with, then over the blocks' sizes. Other rows need no number.
    """
    sizes = materialized(word_sizes(docs), "sizes")
    units = materialized(mix_units(sizes, **options), "mixed").withColumnsRenamed({"doc_id": "d", "source": "s", "size": "z"})
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), n_words().alias("size"))
    same = [rows["row.doc_id"].cast("bigint").eqNullSafe(F.col("d")), rows["row.source"].cast("string").eqNullSafe(F.col("s")), rows["size"] == F.col("z")]
    parted = (F.col("extra") > 0) & (F.col("extra") < F.col("m"))
    alike = rows.join(units.filter(~parted), same)
    taken = [alike.select("row", (F.col("whole") + F.when(F.col("extra") > 0, 1).otherwise(0)).alias("copies"))]
    if not units.filter(parted).isEmpty():
        block = F.floor(F.col("draw") * F.ceil(F.col("m") / ROWS_PER_BLOCK))
        drawn = rows.join(units.filter(parted), same).withColumn("draw", F.rand(11)).withColumn("block", block)
        drawn = materialized(drawn.select("row", "d", "s", "z", "whole", "extra", "draw", "block"), "repeats")
        before = Window.partitionBy("d", "s", "z").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        sums = drawn.groupBy("d", "s", "z", "block").agg(F.count("*").alias("n"))
        sums = sums.select("d", "s", "z", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("upto"))
        at = F.row_number().over(Window.partitionBy("d", "s", "z", "block").orderBy("draw"))
        numbered = drawn.withColumn("at", at).alias("r").join(
            sums.alias("b"), [F.col(f"r.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("d", "s", "z", "block")]
        )
        more = F.when(F.col("r.at") + F.col("b.upto") <= F.col("r.extra"), 1).otherwise(0)
        taken.append(numbered.select("r.row", (F.col("r.whole") + more).alias("copies")))
    copies = taken[0] if len(taken) == 1 else taken[0].union(taken[1])
    copies = copies.filter(F.col("copies") > 0)
    return copies.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")
