"""Text statistics: word counts, grep, lengths, and the page-view report."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegate.operators.aggs import value_histogram
from tidegate.operators.dataflow import regex_matches, tokens
from tidegate.operators.windows import sessions
from tidegate.plans.aggs import HIST_SELECT, rounded
from tidegate.registry import query
from tidegate.session import materialized

SPLIT = r"unnest(regexp_split_to_array(text, '[ \t\n\r\f]+'))"


def rows_seen():
    return F.count(F.lit(1))


@query("word_count", f"SELECT token, count(*) AS n FROM (SELECT {SPLIT} AS token FROM documents) WHERE token <> '' GROUP BY token")
def word_count(t):
    return tokens(t.documents, "text").groupBy("token").agg(rows_seen().alias("n"))


@query(
    "word_hist",
    f"""WITH c AS (SELECT lang, token, count(*) AS n FROM (SELECT lang, {SPLIT} AS token FROM documents) WHERE token <> ''
    GROUP BY ALL) """ + HIST_SELECT.format(id="lang"),
)
def word_hist(t):
    return rounded(value_histogram(tokens(t.documents.select("lang", "text"), "text"), "lang", "token"))


@query(
    "word_len_stats",
    f"""WITH w AS (SELECT length(token) AS len FROM (SELECT {SPLIT} AS token FROM documents) WHERE token <> '')
    SELECT count(*) AS n, round(avg(len), 6) AS mean, quantile_cont(len, 0.5) AS median, round(stddev_pop(len), 6) AS sd FROM w""",
)
def word_len_stats(t):
    # The statistics run on one row per distinct length, which a longest word bounds.
    lengths = tokens(t.documents, "text").groupBy(F.length("token").alias("len")).agg(rows_seen().alias("f"))
    total = F.sum("f")
    mean = F.sum(F.col("len") * F.col("f")) / total
    square = F.sum(F.col("len") * F.col("len") * F.col("f"))
    sd = F.sqrt(square / total - mean * mean)
    return lengths.agg(
        total.alias("n"), F.round(mean, 6).alias("mean"), F.expr("percentile(len, 0.5, f)").alias("median"),
        F.round(sd, 6).alias("sd"),
    )


@query(
    "word_count_multi",
    f"""SELECT source, token, count(*) AS n FROM (SELECT 'documents' AS source, {SPLIT} AS token FROM documents
    UNION ALL SELECT 'conversations', {SPLIT} FROM conversations UNION ALL SELECT 'benchmark', {SPLIT} FROM benchmark)
    WHERE token <> '' GROUP BY ALL""",
)
def word_count_multi(t):
    def tagged(name):
        return t.table(name).select(F.lit(name).alias("source"), "text")

    texts = tagged("documents").unionByName(tagged("conversations")).unionByName(tagged("benchmark"))
    return tokens(texts, "text").groupBy("source", "token").agg(rows_seen().alias("n"))


@query(
    "grep",
    """SELECT match, n, row_number() OVER (ORDER BY n DESC, match) AS place FROM (SELECT m AS match, count(*) AS n
    FROM (SELECT unnest(regexp_extract_all(text, '[a-z]*tion')) AS m FROM documents) GROUP BY m)""",
)
def grep(t):
    from tidegate.operators.ordering import total_rank

    counts = regex_matches(t.documents, "text", "[a-z]*tion").groupBy("match").agg(rows_seen().alias("n"))
    counts = materialized(counts, "grep")  # the ranking samples its ranges first
    ranked = total_rank(counts.withColumn("_down", -F.col("n")), ["_down", "match"], "place")
    return ranked.select("match", "n", "place")


@query(
    "stream_word_count",
    f"""WITH w AS (SELECT conv_id, turn, token FROM (SELECT conv_id, turn, {SPLIT} AS token FROM conversations) WHERE token <> ''),
    m AS (SELECT DISTINCT token, TIMESTAMP '2024-01-01' + to_minutes(conv_id * 10 + turn) AS ts FROM w),
    g AS (SELECT token, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY token ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END
      AS fresh FROM m),
    s AS (SELECT token, ts, sum(fresh) OVER (PARTITION BY token ORDER BY ts) AS sid FROM g),
    c AS (SELECT token, TIMESTAMP '2024-01-01' + to_minutes(conv_id * 10 + turn) AS ts, count(*) AS n FROM w GROUP BY ALL)
    SELECT s.token, epoch_us(min(s.ts)) AS session_start, CAST(sum(c.n) AS BIGINT) AS n FROM s JOIN c USING (token, ts) GROUP BY s.token, s.sid""",
)
def stream_word_count(t):
    # A turn's time: ten minutes per conversation and one per turn.
    at = F.timestamp_seconds(F.lit(1704067200) + (F.col("conv_id") * 10 + F.col("turn")) * 60)
    words = tokens(t.conversations.select(at.alias("ts"), "text"), "text")
    out = sessions(words, "ts", 1800, ["token"], {"n": ("count", "ts")})
    return out.select("token", F.unix_micros("session_start").alias("session_start"), "n")


@query(
    "db_pageview",
    """SELECT p.page_id, p.url, count(*) AS views FROM pages p JOIN (SELECT CAST(json_extract_string(props, '$.k') AS BIGINT)
    AS page_id FROM events) a ON a.page_id = p.page_id GROUP BY ALL""",
)
def db_pageview(t):
    # Accesses are counted per page first, so a page with most of them is one row in the join.
    counts = t.events.groupBy(F.get_json_object("props", "$.k").cast("bigint").alias("page_id")).agg(rows_seen().alias("views"))
    return t.pages.select("page_id", "url").join(counts, "page_id")
