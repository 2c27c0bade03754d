"""Order-flow statistics and order matching."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.apps.book import Book
from tidegate.operators.ordered import Position, at, number_rows, running

# Positions of the fields in a pipe-delimited order line.
ORDER_NO, CODE, PRICE, EXEC_VOLUME, VOLUME, SECURITY, DIRECTION = 0, 1, 8, 9, 10, 11, 22

ARRIVAL = ["ts", "order_no", "line", "part_id", "cents", "volume", "side"]


def arrival_pos() -> Position:
    """Time first, order number within a time: the first two columns of ARRIVAL."""
    return at("ts", "order_no")


def parse_orders(lines: DataFrame, col: str = "value") -> DataFrame:
    """Order lines to columns. An order without a transaction code has only its number."""
    f = F.split(F.col(col), r"\|", -1)
    code = F.get(f, F.lit(CODE))

    def field(i: int) -> Column:
        return F.when(code != "", F.get(f, F.lit(i)))

    return lines.select(
        F.get(f, F.lit(ORDER_NO)).alias("order_no"), code.alias("code"),
        field(PRICE).cast("float").alias("price"),
        field(EXEC_VOLUME).cast("float").cast("int").alias("exec_volume"),
        field(VOLUME).cast("float").cast("int").alias("volume"),
        field(SECURITY).alias("security"), field(DIRECTION).alias("direction"),
    )


def encode_state(order_no: Column, price: Column, volume: Column) -> Column:
    """One order of a stored price level as ``orderNo|price|volume``."""
    return F.concat_ws("|", order_no.cast("string"), price.cast("string"), volume.cast("string"))


def decode_state(state: Column) -> Column:
    """Comma-joined orders back to an array of structs; the price in whole hundredths, cut from single precision."""
    def order(text: Column) -> Column:
        p = F.split(text, r"\|")
        cents = (F.get(p, F.lit(1)).cast("float") * F.lit(100).cast("float")).cast("int")
        return F.struct(
            F.get(p, F.lit(0)).alias("order_no"), cents.alias("cents"),
            F.get(p, F.lit(2)).cast("float").cast("int").alias("volume"),
        )

    return F.transform(F.split(state, ","), order)


def running_totals(orders: DataFrame) -> DataFrame:
    """Per order: its security's price total and number of orders so far. The sum is what the
    reporting application calls the average; the true average is their ratio."""
    return running(
        orders, ["security"], ARRIVAL, arrival_pos(), {"running_sum": ("sum", "cents"), "running_n": ("count", "cents")}
    )


def pool(orders: DataFrame) -> DataFrame:
    """Order pool: every order with its place in the queue of its security, side and price."""
    queue = [c for c in ARRIVAL if c not in ("cents", "side")]
    return number_rows(orders, ["security", "side", "cents"], queue, arrival_pos(), "place")


def price_levels(orders: DataFrame) -> DataFrame:
    """Per security and price: number of orders and their volume."""
    return orders.groupBy("security", "cents").agg(F.count(F.lit(1)).alias("orders"), F.sum("volume").alias("volume"))


TRADES = "security bigint, session string, buy_order bigint, sell_order bigint, cents bigint, volume bigint"


def session_of(ts: Column, session: str | None) -> Column:
    """First day of the trading session (a unit of ``date_trunc``) as text; without sessions, an empty text."""
    return F.lit("") if session is None else F.date_format(F.date_trunc(session, ts), "yyyy-MM-dd")


def session_end(ts: Column, session: str) -> Column:
    """End of the trading session, in microseconds."""
    return F.unix_micros(F.date_trunc(session, ts) + F.expr(f"INTERVAL 1 {session}"))


def match_orders(orders: DataFrame, session: str | None = None) -> DataFrame:
    """Continuous matching by price, then time, per security.

    An order trades at the price of the resting order it meets; what is left rests until it is met. A market that
    closes its books gives the unit of its ``session`` (such as "month"): then (security, session) is the unit of
    work. A task reads its orders as a stream in arrival order and holds only the open books.
    """
    dated = orders.withColumn("session", session_of(F.col("ts"), session))
    placed = dated.repartition("security", "session").sortWithinPartitions("security", "session", *ARRIVAL)
    return placed.select("security", "session", "order_no", "cents", "volume", "side").mapInPandas(_match, TRADES)


def _match(batches):
    current, book = None, Book()
    for batch in batches:
        trades = []
        for security, session, order_no, cents, volume, side in zip(*(batch[c].tolist() for c in batch)):
            if (security, session) != current:
                current, book = (security, session), Book()
            trades += [(*current, *trade) for trade in book.add(order_no, side, cents, volume)]
        yield pd.DataFrame(trades, columns=["security", "session", "buy_order", "sell_order", "cents", "volume"])
