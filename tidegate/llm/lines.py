"""Lines that many documents share: all but one document's are dropped."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.llm.common import text_or_empty
from tidegate.session import materialized

LEAST_CHARS = 20
LEAST_DOCS = 3
BLANKS = " \t\n\x0b\x0c\r"


def split_lines(text: Column) -> Column:
    """The lines of a text; an empty text has one empty line."""
    return F.split(text, "\n", -1)


def line_key(line: Column) -> Column:
    """A line without blanks at its ends, A-Z in lower case. ``lower`` does that for lines in ASCII; others go by a
    table, as their other letters keep their case."""
    bare = F.btrim(line, F.lit(BLANKS))
    by_table = F.translate(bare, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(by_table)


def dedup_lines(
    documents: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text of each row: lines whose key has ``least_chars`` code points or more and
    is found in ``least_docs`` documents or more go, except in the document with the largest id that holds the key.

    Lines are exploded with their positions and keyed by the 128-bit hash of their normalised text. Only (hash, id)
    is counted, first per document and then per hash with partial counts on the map side, so a line that every
    document holds is a few rows by the second shuffle. The shared hashes and the lines to go are written to the
    shared folder; what joins them are plain tables, whose large keys adaptive execution splits. Texts are shuffled
    once, to be put together again by position.

    A null text is empty, an empty text is one empty line. Rows with one id are one document when documents are
    counted, and each is returned with its own lines; a null id is an id of its own and smaller than all others. Rows
    repeated whole stay repeated. Further columns are not read; an empty table gives an empty one.
    """
    text = text_or_empty(text_col)
    docs = documents.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.md5(text).alias("digest"))
    exploded = docs.select("doc_id", "digest", F.posexplode(split_lines(F.col("text"))).alias("position", "line"))
    keyed = exploded.withColumn("key", line_key(F.col("line"))).filter(F.char_length("key") >= least_chars)
    keyed = keyed.select("doc_id", "digest", "position", F.unhex(F.md5("key")).alias("hash"))

    held = keyed.select("hash", "doc_id").distinct().groupBy("hash")
    shared = held.agg(F.count("*").alias("docs"), F.max("doc_id").alias("keep_id")).filter(F.col("docs") >= least_docs)
    shared = materialized(shared.select("hash", "keep_id"), "shared-lines")
    going = keyed.join(shared, "hash").filter(~F.col("doc_id").eqNullSafe(F.col("keep_id")))
    # Rows that repeat an id and a text have the same lines to go, so each position counts once.
    going = going.groupBy("doc_id", "digest").agg(F.collect_set("position").alias("gone"))
    going = materialized(going.select(F.col("doc_id").alias("of_id"), F.col("digest").alias("of_digest"), "gone"), "lines-to-go")

    same = F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("digest") == F.col("of_digest"))
    joined = docs.join(going, same, "left").withColumn("lines", split_lines(F.col("text")))
    gone = F.coalesce("gone", F.array().cast("array<int>"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), gone)
    kept = F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n")
    return joined.select(
        "doc_id", F.size("lines").cast("bigint").alias("n_lines"), F.size(gone).cast("bigint").alias("n_dropped"), kept.alias("kept_text")
    )
