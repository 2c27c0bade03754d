"""Auction queries. Windows are a day, sessions six hours, as the event data is spread over months."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegate.operators.windows import sessions, tumbling
from tidegate.registry import query

RATE = 0.82
SELECTED = (1007, 1020, 2001, 2019, 2087)  # fixed values: auction divisors of the selection query
HOME_STATES = ("NATION_1", "NATION_5", "NATION_7")


def euros(price):
    """Single-precision product, cut to whole units. The price is narrowed first:
    a float times a bigint would be widened to double."""
    return (price.cast("float") * F.lit(RATE).cast("float")).cast("bigint")


@query(
    "nexmark_q1",
    """SELECT auction, CAST(trunc(CAST(price AS FLOAT) * CAST(0.82 AS FLOAT)) AS BIGINT) AS price, bidder,
    epoch_us(date_time) AS date_time FROM bid""",
)
def q1(t):
    return t.bid.select("auction", euros(F.col("price")).alias("price"), "bidder", F.unix_micros("date_time").alias("date_time"))


@query(
    "nexmark_q2",
    """SELECT auction, price FROM bid WHERE auction % 1007 = 0 OR auction % 1020 = 0 OR auction % 2001 = 0
    OR auction % 2019 = 0 OR auction % 2087 = 0""",
)
def q2(t):
    hit = F.lit(False)
    for d in SELECTED:
        hit = hit | (F.col("auction") % d == 0)
    return t.bid.filter(hit).select("auction", "price")


@query(
    "nexmark_q3",
    """SELECT p.name, p.city, p.state, a.id AS auction_id FROM auction a JOIN person p ON a.seller = p.id
    WHERE p.state IN ('NATION_1', 'NATION_5', 'NATION_7') AND a.category = '1-URGENT'""",
)
def q3(t):
    people = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).filter(
        F.col("n_name").isin(*HOME_STATES)
    )
    auctions = t.auction.filter(F.col("category") == "1-URGENT")
    return auctions.join(people, F.col("seller") == F.col("c_custkey")).select(
        F.col("c_name").alias("name"), F.col("c_mktsegment").alias("city"), F.col("n_name").alias("state"),
        F.col("id").alias("auction_id"),
    )


@query(
    "nexmark_q5",
    """SELECT epoch_us(date_trunc('day', date_time)) AS window_start, auction, count(*) AS n
    FROM bid_s GROUP BY ALL""",
)
def q5(t):
    counts = tumbling(t.bid_s, "date_time", "1 day", ["auction"], {"n": F.count(F.lit(1))})
    return counts.select(F.unix_micros("window_start").alias("window_start"), "auction", "n")


@query(
    "nexmark_q8",
    """SELECT DISTINCT p.id, p.name, date_trunc('month', p.date_time)::DATE::VARCHAR AS month
    FROM person p JOIN auction a ON a.seller = p.id
    AND date_trunc('month', a.date_time) = date_trunc('month', p.date_time)""",
)
def q8(t):
    # The reserve side is first reduced to one row per (seller, window): a seller with very
    # many auctions in a window is one row before the join.
    month = F.date_format(F.date_trunc("month", F.col("date_time")), "yyyy-MM-dd").alias("month")
    sellers = t.auction.select(F.col("seller").alias("id"), month).distinct()
    return t.person.select("id", "name", month).join(sellers, ["id", "month"])


@query(
    "nexmark_q11",
    """WITH g AS (SELECT bidder, date_time, CASE WHEN date_time - lag(date_time) OVER (PARTITION BY bidder
      ORDER BY date_time) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM bid_s),
    s AS (SELECT bidder, date_time, sum(fresh) OVER (PARTITION BY bidder ORDER BY date_time) AS sid FROM g)
    SELECT bidder, epoch_us(min(date_time)) AS session_start,
    epoch_us(max(date_time) + INTERVAL 6 HOUR) AS session_end, count(*) AS n FROM s GROUP BY bidder, sid""",
)
def q11(t):
    found = sessions(t.bid_s, "date_time", 6 * 3600, ["bidder"], {"n": ("count", "price")})
    return found.select(
        "bidder", F.unix_micros("session_start").alias("session_start"),
        F.unix_micros("session_end").alias("session_end"), "n",
    )
