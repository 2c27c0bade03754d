"""Sentiment of short texts and parsing of edit lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sentiment(texts: DataFrame, id_col: str, text_col: str, lexicon: DataFrame) -> DataFrame:
    """Sum of the lexicon scores (word, score) of each text's words, and its sign.

    All words of a text are in one task, so the sums are complete before the shuffle and
    only (id, score) moves. The lexicon is joined, broadcast as long as Spark finds it small.
    """
    clean = F.lower(F.regexp_replace(F.col(text_col), r"\p{Punct}|\n", " "))
    words = texts.select(id_col, F.explode_outer(F.split(clean, " ")).alias("word"))
    words = words.withColumn("word", F.btrim("word", F.lit(" \t\n\r\f\u000b")))
    scored = words.join(lexicon, "word", "left").groupBy(id_col).agg(F.coalesce(F.sum("score"), F.lit(0)).alias("score"))
    label = F.when(F.col("score") > 0, "Positive").when(F.col("score") < 0, "Negative").otherwise("Neutral")
    return scored.withColumn("sentiment", label)


def parse_tweets(lines: DataFrame, col: str = "value") -> DataFrame:
    """JSON tweets to (id, text, created_at); a tweet without one of them is dropped."""
    got = lines.select(F.from_json(col, "id_str string, text string, created_at string").alias("t")).select("t.*")
    at = F.try_to_timestamp(F.substring("created_at", 5, 26), F.lit("MMM dd HH:mm:ss Z yyyy"))
    return got.dropna(subset=["id_str", "text", "created_at"]).select("id_str", "text", at.alias("created_at"))


# Fixed value: the form of an edit line; groups are title, flags, url, user, byte difference, summary.
EDIT_LINE = r"\[\[(.*)\]\]\s(.*)\s(.*)\s\*\s(.*)\s\*\s\(\+?(.\d*)\)\s(.*)"


def parse_edits(lines: DataFrame, col: str = "value") -> DataFrame:
    """Edit lines to columns; lines of another form are dropped."""
    def part(i: int):
        return F.regexp_extract(col, EDIT_LINE, i)

    parsed = lines.filter(F.col(col).rlike(EDIT_LINE)).withColumns(
        {
            "title": part(1), "unparsed_flags": part(2), "diff_url": part(3), "user": part(4),
            "diff_bytes": part(5).try_cast("int"), "summary": part(6),
        }
    )
    flag = F.col("unparsed_flags")
    return parsed.filter(F.col("diff_bytes").isNotNull()).withColumns(
        {
            "is_minor": flag.contains("M"), "is_new": flag.contains("N"), "is_unpatrolled": flag.contains("!"),
            "is_bot_edit": flag.contains("B"), "is_special": F.col("title").startswith("Special:"),
            "is_talk": F.col("title").startswith("Talk:"),
        }
    )
