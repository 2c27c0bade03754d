"""Chat formatting: a finite-state machine over roles and a declarative template, in DataFrame functions only."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 512


@dataclass(frozen=True)
class Turn:
    """What stands before and after a role's text, and whether the text counts for the loss."""

    opening: str
    closing: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Marks of each role, and the order that roles may have: ``after[state]`` lists the roles that may follow.

    ``other`` marks any further role; its opening holds the role's name at ``{}``. The states are the roles and "start".
    """

    turns: dict[str, Turn]
    other: Turn
    after: dict[str, tuple[str, ...]]
    last: tuple[str, ...] = ("assistant",)
    begin: str = "<s>"
    end: str = ""
    controls: tuple[str, ...] = field(default=())

    def marks(self) -> list[str]:
        """All control strings, longest first."""
        parts = [self.begin, self.end, *self.controls]
        for t in self.turns.values():
            parts += [t.opening, t.closing]
        parts += [*self.other.opening.split("{}"), self.other.closing]
        return sorted({p.strip() for p in parts if p.strip()}, key=lambda p: (-len(p), p))


INST = Template(
    turns={
        "system": Turn("<<SYS>>\n", "\n<</SYS>>\n\n"),
        "user": Turn("[INST] ", " [/INST]"),
        "assistant": Turn("[ANS] ", " </s>", loss=True),
    },
    other=Turn("[ROLE] {} [SAYS] ", " [/SAYS]"),
    after={"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
)


class Marks:
    """Escaping of a template's control strings: a backslash after the first character, one more per escaping."""

    def __init__(self, template: Template):
        marks = template.marks()
        if any(len(m) < 2 or m[1] == "\\" for m in marks):
            raise ValueError("control strings need two characters, the second no backslash")
        heads = "".join(sorted({m[0] for m in marks}))
        tails = "|".join(re.escape(m[1:]) for m in marks)
        self.bare = f"([{re.escape(heads)}])(\\\\*)({tails})"
        self.escaped = f"([{re.escape(heads)}])\\\\(\\\\*)({tails})"

    def escape(self, text: Column) -> Column:
        """No control string is left in the text; texts that look escaped get one more backslash."""
        return F.regexp_replace(text, F.lit(self.bare), F.lit(r"$1\\$2$3"))

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, F.lit(self.escaped), F.lit("$1$2$3"))


def _segments(role: Column, text: Column, template: Template, marks: Marks) -> Column:
    """The three segments of a turn: opening, escaped text, closing, each with its loss flag."""
    opening, closing, loss = F.concat(*_around(template.other.opening, marks.escape(role))), F.lit(template.other.closing), F.lit(template.other.loss)
    for name, turn in template.turns.items():
        opening = F.when(role == name, F.lit(turn.opening)).otherwise(opening)
        closing = F.when(role == name, F.lit(turn.closing)).otherwise(closing)
        loss = F.when(role == name, F.lit(turn.loss)).otherwise(loss)
    plain = lambda part: F.struct(part.alias("text"), F.lit(False).alias("loss"))
    return F.array(plain(opening), F.struct(marks.escape(text).alias("text"), loss.alias("loss")), plain(closing))


def _around(opening: str, role: Column) -> list[Column]:
    before, _, after = opening.partition("{}")
    return [F.lit(before), role, F.lit(after)]


def _machine(template: Template) -> tuple[list[str], list[list[int]]]:
    """States and the table state -> role -> next state; the last state is an error and stays."""
    states = ["start", *template.turns]
    bad = len(states)
    table = [[states.index(r) if r in template.after.get(s, ()) else bad for r in template.turns] + [bad] for s in states]
    return states, [*table, [bad] * (len(template.turns) + 1)]


def format_conversations(turns: DataFrame, template: Template = INST) -> DataFrame:
    """One row per conv_id of rows (conv_id, turn, role, text): conv_id, n_turns, valid, segments, formatted.

    segments is an array of (text, loss) whose texts, joined, are ``formatted``: marks of the template, and the texts
    with control strings escaped. valid tells whether the machine over roles accepts the order of turns and ends in one
    of the template's last roles; a conversation that it rejects is formatted all the same. The machine runs over
    chunks of turns: each chunk yields where it leads from every state, and these maps are composed in order, so that
    a long conversation is sorted and formatted in many tasks and only its chunks meet in one row.

    Rows go by turn, then role and text; null turns come first. A null text or role counts as empty, roles beside the
    template's get the marks of ``other`` and make a conversation invalid; rows that repeat are turns of their own, a null conv_id is
    a conversation. Other columns are not read; an empty table gives an empty one.
    """
    marks = Marks(template)
    states, table = _machine(template)
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    number = F.lit(len(template.turns))
    for i, name in enumerate(template.turns):
        number = F.when(role == name, i).otherwise(number)
    rows = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.floor(F.col("turn").cast("bigint") / CHUNK).alias("chunk"), role.alias("role"), text.alias("text"),
        number.alias("r"), _segments(role, text, template, marks).alias("s"),
    )
    ordered = F.sort_array(F.collect_list(F.struct("turn", "role", "text", "r", "s")))
    chunks = rows.groupBy("conv_id", "chunk").agg(ordered.alias("rows"))
    next_state = F.lit([x for line in table for x in line])
    width = len(template.turns) + 1
    leads = F.aggregate(
        F.col("rows.r"), F.lit(list(range(len(states) + 1))), lambda to, r: F.transform(to, lambda s: next_state[s * width + r])
    )
    chunks = chunks.select("conv_id", "chunk", F.size("rows").cast("bigint").alias("n"), leads.alias("leads"), F.flatten("rows.s").alias("segments"))
    whole = chunks.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("chunk", "n", "leads", "segments"))).alias("c"))
    state = F.aggregate(F.col("c.leads"), F.lit(0), lambda s, to: to[s])
    joined = F.concat(
        F.array(F.struct(F.lit(template.begin).alias("text"), F.lit(False).alias("loss"))),
        F.flatten("c.segments"),
        F.array(F.struct(F.lit(template.end).alias("text"), F.lit(False).alias("loss"))),
    )
    return whole.select(
        "conv_id",
        F.aggregate(F.col("c.n"), F.lit(0).cast("bigint"), lambda a, n: a + n).alias("n_turns"),
        state.isin([states.index(r) for r in template.last]).alias("valid"),
        joined.alias("segments"),
    ).withColumn("formatted", F.array_join(F.col("segments.text"), ""))


def read_back(formatted: Column, template: Template = INST) -> Column:
    """Array of (role, text) that a formatted text was made from.

    As no control string stands in an escaped text, each turn is found by its marks alone.
    """
    marks = Marks(template)
    kinds = [(name, turn.opening, turn.closing) for name, turn in template.turns.items()]
    before, _, after = template.other.opening.partition("{}")
    quoted = lambda s: re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", s)
    ways = [f"{quoted(o)}.*?{quoted(c)}" for _, o, c in kinds] + [f"{quoted(before)}.*?{quoted(after)}.*?{quoted(template.other.closing)}"]
    found = F.regexp_extract_all(formatted, F.lit("(?s)(" + "|".join(ways) + ")"), F.lit(1))

    def turn(piece: Column) -> Column:
        rest = F.substring(piece, len(before) + 1, 1 << 30)
        cut = F.locate(after, rest)
        role = marks.unescape(F.left(rest, cut - 1))
        text = F.substr(rest, cut + len(after), F.length(rest) - (cut + len(after) - 1) - len(template.other.closing))
        made = F.struct(role.alias("role"), marks.unescape(text).alias("text"))
        for name, opening, closing in kinds:
            inner = F.substr(piece, F.lit(len(opening) + 1), F.length(piece) - len(opening) - len(closing))
            made = F.when(F.startswith(piece, F.lit(opening)), F.struct(F.lit(name).alias("role"), marks.unescape(inner).alias("text"))).otherwise(made)
        return made

    return F.transform(found, turn)


def loss_texts(segments: Column, template: Template = INST) -> Column:
    """The unescaped texts under the loss mask, in order."""
    marks = Marks(template)
    return F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: marks.unescape(s["text"]))
