"""Application queries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from tidegate.apps import latency, markov, sensors, stock, text
from tidegate.registry import query
from tidegate.session import materialized

SO = "ts, order_no, line, part_id, cents, volume, side"
ORDER_FIELDS = """concat_ws('|', CAST(order_no AS {s}), CASE WHEN order_no % 10 = 0 THEN '' ELSE 'A' END, '', '', '', '', '', '',
    CAST(CAST(cents / 100.0 AS DECIMAL(18, 2)) AS {s}), CAST(line AS {s}), CAST(volume AS {s}), CAST(security AS {s}),
    '', '', '', '', '', '', '', '', '', '', side)"""


@query(
    "stock_parse",
    """SELECT CAST(order_no AS VARCHAR) AS order_no, CASE WHEN order_no % 10 = 0 THEN '' ELSE 'A' END AS code,
    CASE WHEN order_no % 10 <> 0 THEN line END AS exec_volume, CAST(CASE WHEN order_no % 10 <> 0 THEN volume END AS INT) AS volume,
    CASE WHEN order_no % 10 <> 0 THEN CAST(security AS VARCHAR) END AS security, CASE WHEN order_no % 10 <> 0 THEN side END AS direction,
    CASE WHEN order_no % 10 <> 0 THEN CAST(trunc(CAST(CAST(cents / 100.0 AS DECIMAL(18, 2)) AS FLOAT) * CAST(100 AS FLOAT)) AS INT) END AS cents
    FROM stock_order""",
)
def stock_parse(t):
    lines = t.stock_order.select(F.expr(ORDER_FIELDS.format(s="STRING")).alias("value"))
    parsed = stock.parse_orders(lines)
    state = stock.encode_state(F.col("order_no"), F.col("price"), F.col("volume"))
    coded = parsed.withColumn("_o", F.when(F.col("price").isNotNull(), F.get(stock.decode_state(state), F.lit(0))))
    return coded.select("order_no", "code", "exec_volume", "volume", "security", "direction", F.col("_o.cents").alias("cents"))


@query(
    "stock_running_sum",
    f"SELECT security, order_no, line, cents, CAST(sum(cents) OVER (PARTITION BY security ORDER BY {SO} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_sum FROM stock_order",
)
def stock_running_sum(t):
    return stock.running_totals(t.stock_order).select("security", "order_no", "line", "cents", "running_sum")


@query(
    "stock_running_avg",
    f"""SELECT security, order_no, line, cents, sum(cents) OVER w / count(*) OVER w AS running_avg FROM stock_order
    WINDOW w AS (PARTITION BY security ORDER BY {SO} ROWS UNBOUNDED PRECEDING)""",
)
def stock_running_avg(t):
    out = stock.running_totals(t.stock_order)
    return out.select("security", "order_no", "line", "cents", (F.col("running_sum") / F.col("running_n")).alias("running_avg"))


@query(
    "stock_window_count",
    "SELECT security, epoch_us(time_bucket(INTERVAL 5 DAY, ts, TIMESTAMP '1970-01-01')) AS window_start, count(*) AS n FROM stock_order GROUP BY ALL",
)
def stock_window_count(t):
    from tidegate.operators.windows import tumbling

    out = tumbling(t.stock_order, "ts", "5 days", ["security"], {"n": F.count(F.lit(1))})
    return out.select("security", F.unix_micros("window_start").alias("window_start"), "n")


@query(
    "stock_pool",
    """SELECT security, side, cents, order_no, volume, row_number() OVER (PARTITION BY security, side, cents
    ORDER BY ts, order_no, line, part_id, volume) AS place, count(*) OVER (PARTITION BY security, cents) AS level_orders,
    CAST(sum(volume) OVER (PARTITION BY security, cents) AS BIGINT) AS level_volume FROM stock_order""",
)
def stock_pool(t):
    orders = t.stock_order
    levels = stock.price_levels(orders).withColumnsRenamed({"orders": "level_orders", "volume": "level_volume"})
    placed = stock.pool(orders).select("security", "side", "cents", "order_no", "volume", "place")
    return placed.join(levels, ["security", "cents"])


@query("stock_match")
def stock_match(t):
    return stock.match_orders(t.stock_order)


@query(
    "stock_match_checked",
    """SELECT security, CAST(coalesce(sum(volume) FILTER (side = 'B'), 0) AS BIGINT) AS buys, CAST(coalesce(sum(volume) FILTER (side = 'S'), 0) AS BIGINT) AS sells,
    true AS no_more_than_ordered, true AS uncrossed FROM stock_order GROUP BY security""",
)
def stock_match_checked(t):
    # What must hold of any matching: no order trades more than its volume, and what is left does not cross.
    trades = stock.match_orders(t.stock_order)
    sides = [trades.select("security", F.col(f"{name}_order").alias("order_no"), F.lit(side).alias("side"), "volume") for name, side in (("buy", "B"), ("sell", "S"))]
    traded = sides[0].unionByName(sides[1]).groupBy("security", "order_no", "side").agg(F.sum("volume").alias("traded"))
    # Lines of one order, side and security are told apart by nothing, so prices are compared where there is one line.
    orders = t.stock_order.groupBy("security", "order_no", "side").agg(
        F.sum("volume").alias("volume"), F.when(F.count(F.lit(1)) == 1, F.max("cents")).alias("cents")
    )
    both = orders.join(traded, ["security", "order_no", "side"], "left").withColumn("traded", F.coalesce("traded", F.lit(0)))
    rest, of = F.when(F.col("volume") > F.col("traded"), F.col("cents")), lambda side, c: F.when(F.col("side") == side, c)
    checked = both.groupBy("security").agg(
        F.coalesce(F.sum(of("B", F.col("volume"))), F.lit(0)).alias("buys"), F.coalesce(F.sum(of("S", F.col("volume"))), F.lit(0)).alias("sells"),
        F.bool_and(F.col("traded") <= F.col("volume")).alias("no_more_than_ordered"),
        F.coalesce(F.max(of("B", rest)) < F.min(of("S", rest)), F.lit(True)).alias("uncrossed"),
    )
    return checked


@query(
    "spike_detect",
    """SELECT event_id, device, s / n AS moving_avg FROM (SELECT event_id, device, sum(CAST(round(value * 100) AS BIGINT)) OVER w AS s,
    count(*) OVER w AS n FROM reading WINDOW w AS (PARTITION BY device ORDER BY ts, event_id ROWS BETWEEN 999 PRECEDING AND CURRENT ROW))
    WHERE s / n >= 5000""",
)
def spike_detect(t):
    # Readings in whole hundredths, so that sums are exact in any order.
    cents = t.reading.withColumn("value", F.round(F.col("value") * 100).cast("bigint"))
    return sensors.spikes(cents, 5000.0).select("event_id", "device", "moving_avg")


@query(
    "stop_detect",
    """SELECT event_id, vehicle, CASE WHEN n < 4 OR lo = hi THEN 'stop at ' || position ELSE 'running!' END AS message FROM
    (SELECT *, row_number() OVER w AS n, min(position) OVER f AS lo, max(position) OVER f AS hi FROM vehicle_report
    WINDOW w AS (PARTITION BY vehicle ORDER BY ts, event_id),
    f AS (PARTITION BY vehicle ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))""",
)
def stop_detect(t):
    message = F.when(F.col("stopped"), F.concat(F.lit("stop at "), F.col("position").cast("string"))).otherwise("running!")
    return sensors.stops(t.vehicle_report).select("event_id", "vehicle", message.alias("message"))


# One state more than the data has: its cells are 0, so every row is smoothed.
STATES = ["click", "error", "purchase", "refund", "signup", "view"]

MODEL = """s AS (SELECT unnest(['click', 'error', 'purchase', 'refund', 'signup', 'view']) AS st),
    m AS (SELECT lag(state) OVER (PARTITION BY entity ORDER BY ts, event_id) AS f, state AS t FROM state_seq),
    c AS (SELECT a.st AS from_state, b.st AS to_state, (SELECT count(*) FROM m WHERE m.f = a.st AND m.t = b.st) AS n FROM s a, s b),
    z AS (SELECT from_state, to_state, CASE WHEN min(n) OVER (PARTITION BY from_state) = 0 THEN n + 1 ELSE n END AS n FROM c),
    g AS (SELECT *, CAST(sum(n) OVER (PARTITION BY from_state) AS BIGINT) AS total FROM z)"""


def _moves(t):
    return markov.transitions(t.state_seq, "entity", "state", ["ts", "event_id"])


@query("markov_train", f"WITH {MODEL} SELECT from_state, to_state, n, n * 1000 // total AS p FROM g")
def markov_train(t):
    return markov.train(_moves(t), "state", STATES, 1000)


@query(
    "fraud_score",
    f"""WITH {MODEL}, x AS (SELECT event_id, entity, ts, state, lag(state) OVER (PARTITION BY entity ORDER BY ts, event_id) AS prev FROM state_seq),
    y AS (SELECT x.*, 1 - g.n / g.total AS miss FROM x JOIN g ON g.from_state = x.prev AND g.to_state = x.state),
    v AS (SELECT event_id, entity, avg(miss) OVER w AS score, count(*) OVER w AS k FROM y
      WINDOW w AS (PARTITION BY entity ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))
    SELECT event_id, entity, round(score, 6) AS score, score > 0.805 AS outlier FROM v WHERE k = 4""",
)
def fraud_score(t):
    moves = materialized(_moves(t), "moves")  # read by the training and by the scoring
    model = markov.train(moves, "state", STATES, 1)
    out = markov.score(moves, "entity", "state", ["ts", "event_id"], model, 5, 0.805)
    return out.select("event_id", "entity", F.round("score", 6).alias("score"), "outlier")


# Words and scores of a small lexicon, taken from the frequent words of the documents.
LEXICON = {
    "the": 1, "and": 1, "der": -1, "que": 2, "that": -1, "for": 1, "was": -2, "die": -3, "with": 2, "des": -1,
    "und": 1, "this": 1, "are": 1, "tion": -2, "from": -1, "les": 1, "eau": 2, "ment": -2, "den": -1, "elle": 3,
}


@query(
    "sentiment",
    r"""WITH lex(word, score) AS (VALUES """
    + ", ".join(f"('{w}', {s})" for w, s in LEXICON.items())
    + r"""),
    w AS (SELECT doc_id, regexp_replace(unnest(string_split(lower(regexp_replace(text, '[!-/:-@\[-`{-~]|\n', ' ', 'g')), ' ')),
      '^\s+|\s+$', '', 'g') AS word FROM documents),
    s AS (SELECT doc_id, CAST(coalesce(sum(score), 0) AS BIGINT) AS score FROM w LEFT JOIN lex USING (word) GROUP BY doc_id)
    SELECT doc_id, score, CASE WHEN score > 0 THEN 'Positive' WHEN score < 0 THEN 'Negative' ELSE 'Neutral' END AS sentiment FROM s""",
)
def sentiment(t):
    # From a pandas frame, so that Spark knows how small the lexicon is.
    lexicon = t.spark.createDataFrame(pd.DataFrame(LEXICON.items(), columns=["word", "score"]), "word string, score bigint")
    return text.sentiment(t.documents, "doc_id", "text", lexicon)


@query(
    "tweet_parse",
    """SELECT CAST(doc_id AS VARCHAR) AS id_str, text, 1704067200000000 + doc_id * 1000000 AS created_at FROM documents WHERE lang <> 'de'""",
)
def tweet_parse(t):
    # Tweets as JSON lines; those of one language lack a field.
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id"))
    tweet = F.struct(
        F.col("doc_id").cast("string").alias("id_str"), "text",
        F.when(F.col("lang") != "de", F.date_format(at, "EEE MMM dd HH:mm:ss Z yyyy")).alias("created_at"),
    )
    parsed = text.parse_tweets(t.documents.select(F.to_json(tweet).alias("value")))
    return parsed.withColumn("created_at", F.unix_micros("created_at"))


EDIT = """concat(CASE WHEN user_id % 7 = 0 THEN 'Talk:' WHEN user_id % 11 = 0 THEN 'Special:' ELSE '' END, 'Page ', event_type)"""


@query(
    "wiki_parse",
    f"""SELECT {EDIT} AS title, 'user' || user_id AS "user", CAST(CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END * (event_id % 500) AS INT) AS diff_bytes,
    CASE event_id % 4 WHEN 0 THEN 'M' WHEN 1 THEN '!N' WHEN 2 THEN 'MB' ELSE '' END AS unparsed_flags,
    'note ' || event_id AS summary, event_id % 4 IN (0, 2) AS is_minor, event_id % 4 = 1 AS is_new, event_id % 4 = 1 AS is_unpatrolled,
    event_id % 4 = 2 AS is_bot_edit, user_id % 7 <> 0 AND user_id % 11 = 0 AS is_special, user_id % 7 = 0 AS is_talk
    FROM events WHERE event_type <> 'error'""",
)
def wiki_parse(t):
    # An edit line for each event; those of type error are not in the right form.
    line = F.expr(
        f"""CASE WHEN event_type = 'error' THEN concat('broken line ', event_id) ELSE
        concat('[[', {EDIT}, ']] ', CASE event_id % 4 WHEN 0 THEN 'M' WHEN 1 THEN '!N' WHEN 2 THEN 'MB' ELSE '' END,
        ' http://wiki.example.org/?diff=', event_id, ' * user', user_id, ' * (', CASE WHEN event_id % 2 = 0 THEN '+' ELSE '-' END,
        event_id % 500, ') note ', event_id) END"""
    )
    parsed = text.parse_edits(t.events.select(line.alias("value")))
    return parsed.drop("value", "diff_url")


EPOCH_MS = 3_600_000

SERIES = """l AS (SELECT lpad(CAST(user_id % 6 AS VARCHAR), 6, '0') AS executor, epoch_ms(ts) AS a,
      epoch_ms(ts) + CAST(floor(value * 10) AS BIGINT) AS c FROM events),
    b AS (SELECT executor, min(c) AS first, max(c) AS last FROM l GROUP BY executor),
    e AS (SELECT executor, (c - first) // 3600000 AS epoch, avg(c - a) AS latency FROM l JOIN b USING (executor)
      WHERE (c - first) // 3600000 < (last - first) // 3600000 GROUP BY ALL)"""

FILLED = (
    SERIES
    + """, p AS (SELECT executor, epoch, latency FROM e UNION ALL SELECT executor, 0, 0 FROM e GROUP BY executor HAVING min(epoch) > 0),
    q AS (SELECT *, lead(epoch) OVER w AS e1, lead(latency) OVER w AS l1 FROM p WINDOW w AS (PARTITION BY executor ORDER BY epoch)),
    f AS (SELECT executor, t AS epoch, latency + (t - epoch) * ((l1 - latency) / (e1 - epoch)) AS latency
      FROM (SELECT *, unnest(range(epoch, e1)) AS t FROM q WHERE e1 IS NOT NULL))"""
)


def _log(t):
    completion = F.unix_millis("ts") + F.floor(F.col("value") * 10)
    return t.events.select(
        F.lpad((F.col("user_id") % 6).cast("string"), 6, "0").alias("executor"),
        F.concat(
            F.lit("stock_id: "), F.col("event_id").cast("string"), F.lit(" arrival_ts: "), F.unix_millis("ts").cast("string"),
            F.lit(" completion_ts: "), completion.cast("string"),
        ).alias("value"),
    )


@query("latency_epochs", f"WITH {SERIES} SELECT epoch, round(max(latency), 6) AS latency FROM e GROUP BY epoch HAVING max(latency) > 0")
def latency_epochs(t):
    return latency.worst(latency.epochs(_log(t), "executor", "value", EPOCH_MS)).withColumn("latency", F.round("latency", 6))


@query("latency_fill", f"WITH {FILLED} SELECT executor, epoch, round(latency, 6) AS latency FROM f")
def latency_fill(t):
    series = latency.filled(latency.epochs(_log(t), "executor", "value", EPOCH_MS), "executor")
    return series.withColumn("latency", F.round("latency", 6))


@query(
    "latency_resample",
    f"""WITH {FILLED} SELECT epoch, round(max(latency), 6) AS latency FROM f WHERE epoch > 50 AND epoch < 500 AND epoch % 10 = 0
    GROUP BY epoch HAVING max(latency) > 0""",
)
def latency_resample(t):
    series = latency.filled(latency.epochs(_log(t), "executor", "value", EPOCH_MS), "executor")
    return latency.resampled(latency.worst(series), 50, 500, 10).withColumn("latency", F.round("latency", 6))


@query(
    "log_attrs",
    """SELECT 'container_' || user_id AS dir, 'nexmark-q' || (arg_min(event_id, event_id) % 9) AS app,
    'memory:' || (1000 + min(event_id) % 500) AS memory, 'vCores:' || (1 + min(event_id) % 8) AS cores FROM events
    WHERE event_type <> 'error' GROUP BY user_id""",
)
def log_attrs(t):
    # Container logs with one line per event: configuration lines, and noise for errors.
    line = F.expr(
        """CASE WHEN event_type = 'error' THEN 'error memory:1' ELSE concat('system config nexmark-q', event_id % 9,
        ' executor configure resource <memory:', 1000 + event_id % 500, ', vCores:', 1 + event_id % 8, '>') END"""
    )
    logs = t.events.select(F.concat(F.lit("container_"), F.col("user_id").cast("string")).alias("dir"), "event_id", line.alias("value"))
    return latency.log_attributes(logs, "dir", "event_id", "value")
