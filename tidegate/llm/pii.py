"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust their scores."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm.common import slices, text_or_empty

# Kinds in the order of their listing, the base ones first, and words that make a kind likelier.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn")
CONTEXT = {
    "email": ("mail", "e-mail", "email", "contact", "address"),
    "ip": ("ip", "host", "server", "address", "login"),
    "card": ("card", "visa", "mastercard", "credit", "amex", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "whatsapp"),
    "iban": ("iban", "bank", "account", "konto", "transfer"),
    "ssn": ("ssn", "social", "security"),
}
BEFORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3}
NEAR = 40
SSN_LEAST = 0.5

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits that is no address from its first digit on is none from a later one: each run is tried once.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN_START = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?= ?[A-Z0-9])")
IBAN_REST = re.compile(r"(?: ?[A-Z0-9]){11,30}")
IBAN_LENGTH = {
    country: int(length)
    for length, countries in (
        line.split(":")
        for line in (
            "15:NO 16:BE 18:DK FI FO GL NL SD FK 19:MK SI 20:AT BA EE KZ LT LU XK MN 21:CH HR LI LV 22:BG BH CR DE GB GE IE ME RS VA "
            "23:AE GI IL IQ OM SO TL 24:AD CZ ES MD PK RO SA SE SK TN VG 25:LY PT ST 26:IS TR 27:BI DJ FR GR IT MC MR SM "
            "28:AL AZ BY CY DO GT HN HU LB NI PL SV 29:BR EG PS QA UA 30:JO KW MU YE 31:MT SC 32:LC 33:RU"
        ).replace(" 1", "|1").replace(" 2", "|2").replace(" 3", "|3").split("|")
    )
    for country in countries.split()
}
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    """Mod-10 check: every second digit from the right is doubled, nines cast out."""
    twice = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
    return (sum(map(int, digits[-1::-2])) + sum(twice[int(d)] for d in digits[-2::-2])) % 10 == 0


def mod97(iban: str) -> bool:
    """Bank account check: moved to the end, the first four characters make a number that leaves 1."""
    plain = iban.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Account numbers that do not overlap. Of the readings from a country code on, each up to 34 characters and ending
    where a word ends, the first that passes the check counts: the one of the country's length, then the longest; where the
    country is not known, then the shorter ones."""
    at = 0
    while m := IBAN_START.search(text, at):
        at = m.end()
        rest = IBAN_REST.match(text, at)
        if not rest:
            continue
        ends, plain = [], 4
        for i in range(at, rest.end()):
            if text[i] != " ":
                plain += 1
                if plain >= 15 and not (text[i + 1 : i + 2].isascii() and text[i + 1 : i + 2].isalnum()):
                    ends.append((plain != IBAN_LENGTH.get(m[0][:2]), -plain, i + 1))
        if m[0][:2] in IBAN_LENGTH:  # its length is known: no other reading but the longest is tried
            ends = [e for e in ends if not e[0] or e is ends[-1]]
        for _, _, end in sorted(ends):
            if mod97(text[m.start() : end]):
                yield m.start(), end
                at = end
                break


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches that do not overlap, found from their @ signs."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def confirmed(text: str) -> list[tuple[int, int, int]]:
    """(start, end, number of the kind) of all spans of a text, by start, then kind."""
    found = [(s, e, 0) for s, e in emails(text)]
    for m in IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            found.append((m.start(), m.end(), 1))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), 2))
    for m in PHONE.finditer(text):
        if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
            found.append((m.start(), m.end(), 3))
    found += [(s, e, 4) for s, e in ibans(text)]
    for m in SSN.finditer(text):
        if score(text, m.start(), m.end(), "ssn") >= SSN_LEAST:
            found.append((m.start(), m.end(), 5))
    return sorted(found, key=lambda s: (s[0], s[2]))


def score(text: str, start: int, end: int, kind: str) -> float:
    """What the kind is worth by itself, raised halfway to 1 by a telling word within NEAR characters."""
    near = set(re.findall(r"[a-z-]+", text[max(0, start - NEAR) : start].lower() + " " + text[end : end + NEAR].lower()))
    value = BEFORE[kind]
    return round(value + (1 - value) / 2, 3) if near & set(CONTEXT[kind]) else value


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base (spans of the base kinds), spans (of all
    kinds) and scores, all as comma-joined texts.

    A span is kind:start:end, in code points, its end exclusive, sorted by start and then kind. The base kinds are
    always listed; IBANs need a right mod-97 check, social security numbers a telling word nearby. A null or empty
    text has no spans. Null doc_ids stay, repeated rows are each searched, other columns are not read, an empty table
    gives an empty one. Every pattern runs in time proportional to the text.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            counts: list[list[int]] = [[] for _ in BASE_KINDS]
            base, spans, scores = [], [], []
            for text in batch.column(1).to_pylist():
                found = confirmed(text)
                kinds = [k for _, _, k in found]
                for k, of in enumerate(counts):
                    of.append(kinds.count(k))
                base.append(",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in found if k < len(BASE_KINDS)))
                spans.append(",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in found))
                scores.append(",".join(str(score(text, s, e, KINDS[k])) for s, e, k in found))
            columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), *(pa.array(c, pa.string()) for c in (base, spans, scores))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "spans", "scores"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(
        search, "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base string, spans string, scores string"
    )
