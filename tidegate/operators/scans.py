"""Folds in order of arrival, which need not decompose into partial results."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidegate.operators.ordered import SLICE, Position, slice_hot_keys

OUT_ROWS = 20_000


class Fold(Protocol):
    """The state of one group: takes its rows in order and gives out rows as it likes."""

    def step(self, row: tuple) -> Iterable[tuple]: ...

    def end(self) -> Iterable[tuple]: ...


def scan_groups(df: DataFrame, by: list[str], order: list[str], start: Callable[[tuple], Fold], schema: str) -> DataFrame:
    """Fold each group's rows in ``order``. ``start`` makes the fold of a group from its key; a fold sees the columns
    other than ``by``, in the table's order. The result has ``by`` and the columns of ``schema``.

    Groups are hashed to partitions, which Spark sorts, spilling to disk; a task reads its partition once, batch by
    batch, and holds one group's state, however many rows the group has.
    """
    rest = [c for c in df.columns if c not in by]
    rows = df.select(*by, *rest).repartition(*by).sortWithinPartitions(*by, *[F.col(c).asc_nulls_first() for c in order])
    fields = StructType([*[df.schema[c] for c in by], *StructType.fromDDL(schema).fields])
    width, arrow = len(by), to_arrow_schema(fields)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fold, out = None, None, []

        def packed() -> pa.RecordBatch:
            made = [pa.array(c, f.type) for c, f in zip(zip(*out), arrow)]
            out.clear()
            return pa.RecordBatch.from_arrays(made, schema=arrow)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if fold is None or row[:width] != key:
                    if fold is not None:
                        out.extend((*key, *r) for r in fold.end())
                    key, fold = row[:width], start(row[:width])
                out.extend((*key, *r) for r in fold.step(row[width:]))
                if len(out) >= OUT_ROWS:
                    yield packed()
        if fold is not None:
            out.extend((*key, *r) for r in fold.end())
        if out:
            yield packed()

    return rows.mapInArrow(scan, fields)


class _Value:
    """A fold of rows onto one value, given out at the end."""

    def __init__(self, value: Any, step: Callable[[Any, tuple], Any], finish: Callable[[Any], Any]):
        self.value, self.function, self.finish = value, step, finish

    def step(self, row: tuple) -> Iterable[tuple]:
        self.value = self.function(self.value, row)
        return ()

    def end(self) -> Iterable[tuple]:
        return ((self.finish(self.value),),)


def fold_ordered(
    df: DataFrame, keys: list[str], order: list[str], pos: Position, values: list[str], initial: Any,
    step: Callable[[Any, tuple], Any], kind: str, states: list | None = None, finish: Callable[[Any], Any] = lambda v: v,
    name: str = "value",
) -> DataFrame:
    """Fold each key's rows in order of arrival onto ``initial`` by any function ``step(value, row)``, a row being its
    ``values``: one row (keys, ``name`` of type ``kind``) per key, its last value, passed through ``finish`` (not used with
    ``states``). ``pos`` reads columns among these only.

    A key is folded by one task, which holds its value alone. If the value can only be one of a few ``states``, and
    ``step`` also works on a numpy array of them, a key too large for one task is cut into slices of its order: each
    slice is folded from every state at once, which makes it a map from states to states, and the maps of a key's
    slices are applied one after the other.
    """
    narrow = df.select(*dict.fromkeys([*keys, *order, *values]))
    sliced, split = slice_hot_keys(narrow, keys, pos) if states is not None else (narrow, False)
    # The fold sees the columns after the keys; it picks the values out of them.
    rest = [c for c in narrow.columns if c not in keys]
    picks = [rest.index(v) for v in values]

    def pick(value, row):
        return step(value, tuple(row[i] for i in picks))

    if not split:
        return scan_groups(narrow, keys, order, lambda key: _Value(initial, pick, finish), f"`{name}` {kind}")
    every = np.array(states)
    place = {s: i for i, s in enumerate(states)}

    def ends(value: np.ndarray) -> list[int]:
        return [place[s] for s in value.tolist()]

    maps = scan_groups(sliced, [*keys, SLICE], order, lambda key: _Value(every, pick, ends), "_ends array<int>")
    in_order = F.sort_array(F.collect_list(F.struct(SLICE, "_ends")))
    joined = maps.groupBy(*keys).agg(in_order.alias("_maps"))
    last = F.aggregate("_maps", F.lit(place[initial]), lambda at, m: F.get(m["_ends"], at))
    known = F.array(*[F.lit(s) for s in states])
    return joined.select(*keys, F.get(known, last).cast(kind).alias(name))

