"""SQL over named streams: ``system.stream`` names, scripts of INSERT statements, table upserts."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidegate.functions import scalar
from tidegate.session import work_path
from tidegate.sinks.tables import KeyedTable
from tidegate.sinks.writers import each_batch


ORDER = "__order__"


def in_order(rows: DataFrame) -> tuple[DataFrame, list[str] | None]:
    """The rows for a keyed table, and the column that tells which row of a key is its last."""
    return rows, [ORDER] if ORDER in rows.columns else None


class StreamCatalog:
    """Resolves dotted names (``kafka.bids``, ``store.profiles.$table``) to views and sinks.

    A source is a DataFrame, batch or streaming. A sink is a folder of parquet files; a name
    that ends in ``$table`` is a keyed table, and inserting into it is an upsert on ``__key__``.
    Each streaming INSERT keeps its place in its input with the sink, under its own text, so several
    of them and batch INSERTs add to one sink, and one that is run again goes on where it ended.
    A statement into a table may select a column ``__order__``, such as the event's time: of several rows of a key in
    one batch the last by it is put. Without it, different rows of one key are an error.
    SQL text may use SUM0, flatten, TUMBLE, TUMBLE_START and TUMBLE_END.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._sinks: dict[str, str | KeyedTable] = {}
        self._sources: set[str] = set()
        scalar.register(spark)

    def source(self, name: str, df: DataFrame) -> None:
        df.createOrReplaceTempView(f"`{name}`")
        self._sources.add(name)

    def sink(self, name: str, path: str | None = None) -> None:
        path = path or work_path(self.spark, "sink")
        self._sinks[name] = KeyedTable(self.spark, path, ["__key__"]) if name.endswith("$table") else path

    def query(self, sql: str) -> DataFrame:
        """Run a SELECT whose FROM and JOIN items may be dotted names."""
        return self.spark.sql(own_functions(self._quoted(sql)))

    def read(self, name: str) -> DataFrame:
        target = self._target(name)
        if isinstance(target, KeyedTable):
            return target.read()
        return self.spark.read.option("recursiveFileLookup", "true").parquet(target)

    def insert(self, statement: str) -> str:
        """Run one ``INSERT INTO name SELECT ...`` or ``UPSERT INTO ...``; returns the sink's name.

        Over a stream it runs until all input that is there has been written.
        """
        found = re.match(r"\s*(insert|upsert)\s+into\s+(\S+?)\s*(\(([^)]*)\))?\s+(?=select|values|with|table)", statement, re.I)
        if not found:
            raise ValueError(f"not an INSERT or UPSERT statement: {statement!r}")
        name = found.group(2).replace("`", "")
        df = self.query(statement[found.end():])
        if found.group(4):
            df = df.toDF(*[c.strip() for c in found.group(4).split(",")])
        target = self._target(name)
        own = hashlib.sha256(" ".join(statement.split()).encode()).hexdigest()[:16]
        if df.isStreaming and isinstance(target, KeyedTable):
            self._upsert_stream(df, target, own)
        elif df.isStreaming:
            self._append_stream(df, target, own)
        elif isinstance(target, KeyedTable):
            target.put_all(*in_order(df))
        else:
            df.write.mode("append").parquet(target)
        return name

    def _append_stream(self, df: DataFrame, folder: str, own: str) -> None:
        """Write each micro-batch to a folder of the statement and the batch; a batch that is retried replaces its own."""

        def write(rows: DataFrame, number: int) -> None:
            rows.write.mode("overwrite").parquet(f"{folder}/{own}-{number}")

        each_batch(df, write, f"{folder}/_checkpoint-{own}").awaitTermination()

    def _upsert_stream(self, df: DataFrame, table: KeyedTable, own: str) -> None:
        """Put each micro-batch into the table under the number that was set down for it when it first came: a batch
        that is retried replaces its own, and one that has been put is not put again over later changes."""

        def write(rows: DataFrame, number: int) -> None:
            put, order = in_order(rows)
            table.put_all(put, order, batch=table.number_of(f"{own}-{number}"))

        each_batch(df, write, f"{table.path}/_checkpoint-{own}").awaitTermination()

    def run_script(self, text: str) -> list[str]:
        """Run every INSERT of a script; statements may span lines and ``--`` lines are comments."""
        return [self.insert(s) for s in script_statements(text)]

    def table(self, name: str) -> KeyedTable:
        """The keyed table behind a ``$table`` sink."""
        target = self._target(name)
        if not isinstance(target, KeyedTable):
            raise ValueError(f"{name} is not a table")
        return target

    def _target(self, name: str):
        if name not in self._sinks:
            raise ValueError(f"unknown sink {name}")
        return self._sinks[name]

    def _quoted(self, sql: str) -> str:
        """Backtick the registered names, longest first; a dotted FROM or JOIN item that is not registered
        is an error."""
        names = sorted((n for n in self._sources if "." in n), key=len, reverse=True)

        def quote(code: str, put_back) -> str:
            for name in re.findall(r"\b(?:from|join)\s+([A-Za-z_]\w*(?:\.[\w$]+)+)", code, re.I):
                if name not in self._sources:
                    raise ValueError(f"unknown stream {name}")
            return re.sub(rf"(?<![\w`.])({'|'.join(map(re.escape, names))})(?![\w`$])", r"`\1`", code) if names else code

        return in_code(sql, quote)


# What is no code: strings, quoted names and comments.
ASIDE = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", re.S)


def in_code(sql: str, change: Callable[[str, Callable[[str], str]], str]) -> str:
    """Change a text outside of its strings, quoted names and comments. ``change`` gets the text with a mark in place of
    each of them, and a function that puts them back into a part of it."""
    kept: list[str] = []

    def put_aside(found: re.Match) -> str:
        kept.append(found[0])
        return f"\x00{len(kept) - 1}\x00"

    def put_back(text: str) -> str:
        return re.sub(r"\x00(\d+)\x00", lambda m: kept[int(m[1])], text)

    return put_back(change(ASIDE.sub(put_aside, sql), put_back))


def own_functions(sql: str) -> str:
    """Spell functions that Spark lacks, or gives another meaning, in Spark's own ones. (A SQL function of Spark may hold
    no aggregate, window or generator, so these cannot be registered.)"""

    def spell(code: str, put_back: Callable[[str], str]) -> str:
        def width(interval: str) -> str:  # INTERVAL '5' SECOND as Spark's window takes it
            return " ".join(re.sub(r"(?i)\binterval\b|'", " ", put_back(interval)).split())

        meaning = {
            "sum0": lambda x: f"coalesce(sum({x}), 0)",
            "flatten": lambda x: f"explode(coalesce({x}, array(NULL)))",
            "tumble_start": lambda ts, by: f"window({ts}, '{width(by)}').start",
            "tumble_end": lambda ts, by: f"window({ts}, '{width(by)}').end",
            "tumble": lambda ts, by: f"window({ts}, '{width(by)}')",
        }
        if len(re.findall(r"(?<![\w.])flatten\s*\(", code, re.I)) > 1:
            raise ValueError("exactly one flatten per query is supported")
        for name, spelled in meaning.items():
            while found := re.search(rf"(?<![\w.]){name}\s*\(", code, re.I):
                arguments, end = _arguments(code, found.end())
                code = code[: found.start()] + spelled(*arguments) + code[end:]
        return code

    return in_code(sql, spell)


def _arguments(code: str, at: int) -> tuple[list[str], int]:
    """The arguments of a call whose parenthesis is open at a place, and where it ends."""
    parts, depth = [""], 1
    for end in range(at, len(code)):
        depth += (code[end] == "(") - (code[end] == ")")
        if not depth:
            return [p.strip() for p in parts], end + 1
        if code[end] == "," and depth == 1:
            parts.append("")
        else:
            parts[-1] += code[end]
    raise ValueError("a parenthesis is not closed")


def script_statements(text: str) -> list[str]:
    """Split a script into its statements: each starts at a line beginning with INSERT or UPSERT."""
    statements: list[str] = []
    for line in (raw.strip() for raw in text.splitlines()):
        if not line or line.startswith("--"):
            continue
        if re.match(r"(insert|upsert)\b", line, re.I) or not statements:
            statements.append(line)
        else:
            statements[-1] += " " + line
    return statements
