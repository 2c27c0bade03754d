"""Statistics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegate.operators import stats as ops
from tidegate.operators.median import running_median
from tidegate.operators.ordered import at
from tidegate.registry import query


@query(
    "stat_mean",
    """SELECT device, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents, count(*) AS n,
    sum(CAST(round(value * 100) AS BIGINT)) / count(*) AS mean FROM reading GROUP BY device""",
)
def stat_mean(t):
    cents = F.round(F.col("value") * 100).cast("bigint")
    return t.reading.groupBy("device").agg(
        F.sum(cents).alias("cents"), F.count(F.lit(1)).alias("n"), F.avg(cents).alias("mean")
    )


@query(
    "stat_outlier_pct",
    """SELECT event_type, round(count(DISTINCT CASE WHEN value > 30 THEN user_id END) / count(DISTINCT user_id), 6) AS share
    FROM events GROUP BY event_type""",
)
def stat_outlier_pct(t):
    shares = ops.outlier_share(t.events, ["event_type"], "user_id", F.col("value") > 30)
    return shares.withColumn("share", F.round("share", 6))


@query(
    "stat_entropy",
    """WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL),
    p AS (SELECT user_id, n / sum(n) OVER (PARTITION BY user_id) AS p FROM c)
    SELECT user_id, round(abs(sum(p * log2(p))), 6) AS entropy FROM p GROUP BY user_id""",
)
def stat_entropy(t):
    found = ops.entropy(t.events, ["user_id"], "event_type")
    return found.withColumn("entropy", F.round(F.abs("entropy"), 6))


@query(
    "stat_entropy_normal",
    """SELECT event_type, round(0.5 * ln(2 * pi() * exp(1) * var_samp(value)), 6) AS entropy FROM events GROUP BY event_type""",
)
def stat_entropy_normal(t):
    return t.events.groupBy("event_type").agg(F.round(ops.entropy_normal(F.stddev_samp("value")), 6).alias("entropy"))


@query(
    "stat_normal_fit",
    """SELECT device, round(avg(value), 6) AS mu, round(stddev_samp(value), 6) AS sigma, count(*) AS n
    FROM reading GROUP BY device""",
)
def stat_normal_fit(t):
    return t.reading.groupBy("device").agg(
        F.round(F.avg("value"), 6).alias("mu"), F.round(F.stddev_samp("value"), 6).alias("sigma"),
        F.count(F.lit(1)).alias("n"),
    )


@query(
    "stat_ewma",
    """WITH RECURSIVE r AS (SELECT device, value, row_number() OVER (PARTITION BY device ORDER BY ts, event_id) AS rn FROM reading),
    f AS (SELECT device, CAST(10 AS BIGINT) AS rn, avg(value) AS e FROM r WHERE rn <= 10 GROUP BY device HAVING count(*) = 10
      UNION ALL SELECT f.device, r.rn, r.value * (2 / 31.0) + f.e * (1 - 2 / 31.0) FROM f JOIN r ON r.device = f.device AND r.rn = f.rn + 1),
    c AS (SELECT device, count(*) AS n FROM reading GROUP BY device)
    SELECT c.device, c.n, round(CASE WHEN c.n > 10 THEN f.e ELSE 0 END, 6) AS ewma
    FROM c LEFT JOIN f ON f.device = c.device AND f.rn = c.n""",
)
def stat_ewma(t):
    found = ops.ewma(t.reading, ["device"], ["ts", "event_id"], at("ts", "event_id"), "value")
    return found.select("device", "n", F.round("ewma", 6).alias("ewma"))


@query(
    "stat_running_median",
    """SELECT event_id, device, round(quantile_cont(value, 0.5) OVER (PARTITION BY device ORDER BY ts, event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS median FROM reading""",
)
def stat_running_median(t):
    found = running_median(t.reading, ["device"], ["ts", "event_id"], at("ts", "event_id"), "value")
    return found.select("event_id", "device", F.round("median", 6).alias("median"))


@query(
    "stat_hist_bins",
    """SELECT l_returnflag, CAST(floor(l_extendedprice) AS BIGINT) // 1000 AS bin, count(*) AS n,
    CAST(sum(CAST(floor(l_extendedprice) AS BIGINT)) AS BIGINT) AS total FROM lineitem GROUP BY ALL""",
)
def stat_hist_bins(t):
    lines = t.lineitem.select("l_returnflag", F.floor("l_extendedprice").alias("price"))
    return ops.bins(lines, ["l_returnflag"], "price", 1000)


@query(
    "stat_conf_bounds",
    """WITH b AS (SELECT l_suppkey, CAST(floor(l_extendedprice) AS BIGINT) // 1000 AS bin, count(*) AS n,
      sum(CAST(floor(l_extendedprice) AS BIGINT)) AS s FROM lineitem GROUP BY ALL),
    m AS (SELECT l_suppkey, CAST(sum(n) AS BIGINT) AS n, CAST(sum(s) // sum(n) AS BIGINT) AS mean FROM b GROUP BY l_suppkey),
    o AS (SELECT b.l_suppkey, abs(b.bin - m.mean // 1000) AS off, b.n FROM b JOIN m ON b.l_suppkey = m.l_suppkey),
    c AS (SELECT l_suppkey, off, sum(n) OVER (PARTITION BY l_suppkey ORDER BY off) AS cov FROM o),
    r AS (SELECT c.l_suppkey, greatest(1, min(c.off)) AS off FROM c JOIN m ON c.l_suppkey = m.l_suppkey
      WHERE c.cov >= m.n * 80 // 100 GROUP BY c.l_suppkey)
    SELECT m.l_suppkey, m.mean, CAST(trunc((m.mean // 1000 - r.off + 0.5) * 1000) AS BIGINT) AS low,
    CAST(trunc((m.mean // 1000 + r.off + 0.5) * 1000) AS BIGINT) AS high FROM m JOIN r ON m.l_suppkey = r.l_suppkey""",
)
def stat_conf_bounds(t):
    lines = t.lineitem.select("l_suppkey", F.floor("l_extendedprice").alias("price"))
    return ops.confidence_bounds(lines, ["l_suppkey"], "price", 1000, 80)


@query(
    "stat_seasonal_median",
    """WITH s AS (SELECT event_type, date_trunc('day', ts) AS day, CAST(hour(ts) // 6 AS BIGINT) AS slot,
      CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY ALL)
    SELECT event_type, epoch_us(day) AS day, slot, cents, coalesce(quantile_cont(cents, 0.5) OVER (PARTITION BY event_type, slot
    ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seasonal_median FROM s""",
)
def stat_seasonal_median(t):
    slots = t.events.groupBy(
        "event_type", F.date_trunc("day", "ts").alias("day"), F.expr("cast(hour(ts) div 6 as bigint)").alias("slot")
    ).agg(F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents"))
    found = ops.seasonal_median(slots, ["event_type"], "day", "slot", "cents")
    return found.withColumn("day", F.unix_micros("day"))
