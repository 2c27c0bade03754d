"""Toxicity of disguised texts: noisy-channel restoration under a character language model, then scoring."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm.common import fresh, slices, text_or_empty
from tidegate.session import materialized

# Characters of the language model, and letters that other characters stand in for.
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿßœ"
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "¡": "i", "(": "c", "*": "aeiou", "#": "aeiou",
}
EDGE = 0
OTHER = len(LETTERS) + 1
CLASSES = len(LETTERS) + 2

# Costs of the channel, in nats.
STAND_IN, KEPT_SIGN, SHORTENED, SHORTENED_LONG, JOINED, APART = 1.5, 3.0, 2.5, 0.5, 0.0, 6.0
PIECES_JOINED = 5.0

# Characters without a width of their own: soft hyphen, zero-width blanks and joiners, marks of direction.
UNSEEN = re.compile("[\u00ad\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]")
# Marks for white space in a stretch that is decoded: the usual joint, a wider one, one between pieces of words.
JOINT, WIDE, BETWEEN = " ", "\t", "\n"


def _class_table() -> np.ndarray:
    table = np.full(0x180, OTHER, np.uint8)
    table[[ord(c) for c in " \t\n\r\x0b\x0c\xa0"]] = EDGE
    table[[ord(c) for c in LETTERS]] = np.arange(1, len(LETTERS) + 1)
    return table


def trigram_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(trigram, n): how often each three characters follow each other in all texts. At most CLASSES ** 3 rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _class_table()
        total = np.zeros(CLASSES**3, np.int64)
        for batch in slices(batches, "text", 4_000_000):
            joined = "  ".join(batch.column(0).to_pylist()).lower().encode("utf-32-le", "surrogatepass")
            classes = table.take(np.frombuffer(b" \0\0\0" * 2 + joined + b" \0\0\0" * 2, "<u4"), mode="clip").astype(np.int32)
            total += np.bincount((classes[:-2] * CLASSES + classes[1:-1]) * CLASSES + classes[2:], minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen])], ["trigram", "n"])

    counted = docs.select(text_or_empty(text_col).alias("text")).mapInArrow(count, "trigram int, n bigint")
    return counted.groupBy("trigram").agg(F.sum("n").alias("n"))


def language_model(docs: DataFrame, text_col: str = "text", smooth: float = 5.0) -> np.ndarray:
    """Costs -ln P(third class | first two), backed off to shorter histories. Its size depends on the alphabet only."""
    n = np.zeros(CLASSES**3)
    for trigram, many in trigram_counts(docs, text_col).collect():
        n[trigram] = many
    n = n.reshape(CLASSES, CLASSES, CLASSES)
    one = (n.sum((0, 1)) + 1) / (n.sum() + CLASSES)
    two = (n.sum(0) + smooth * one) / (n.sum((0, 2))[:, None] + smooth)
    three = (n + smooth * two[None]) / (n.sum(2)[:, :, None] + smooth)
    return (-np.log(three)).astype(np.float32)


def _said(link: tuple | None) -> str:
    """The reading that ends with a link."""
    texts = []
    while link is not None:
        link, text = link
        texts.append(text)
    return "".join(reversed(texts))


class Restorer:
    """Most likely plain form of a token or a spelled-out word: a Viterbi search over its lattice of readings."""

    def __init__(self, model: np.ndarray):
        self.model = model.ravel().tolist()
        self.known: dict[str, str] = {}
        self.classes = {c: i + 1 for i, c in enumerate(LETTERS)}
        signs = re.escape("".join(STANDS_FOR))
        self.core = re.compile(r"^(?:(?!!\w)[^\w@$|+€£(*#])*(.*?)[^\w@$|+€£!]*$", re.S)
        self.odd = re.compile(rf"[^\W\d_][{signs}]+|[{signs}]+[^\W\d_]|([^\W\d_])\1\1|\w(?:[.\-_~]\w){{2,}}")
        self.cut_up = re.compile(r"^\w+(?:[.\-_~]\w){2,}|^\w(?:[.\-_~]\w)+")
        self.spelled = re.compile(r"(?<!\S)\S(?:\s+\S(?!\S)){2,}")
        self.runs = re.compile(r"(.)\1*", re.S)
        self.joints = re.compile(r"\s+")

    def _readings(self, token: str) -> Iterator[list[tuple[str, float]]]:
        """For each run of equal characters, what it may stand for, with costs."""
        separated = bool(self.cut_up.match(token))
        for run in self.runs.finditer(token):
            c, many = run[1], run.end() - run.start()
            if c in self.classes:
                yield [(c, 0.0)] if many == 1 else [(c * 2, 0.0 if many == 2 else 1.0), (c, SHORTENED if many == 2 else SHORTENED_LONG)]
            elif c == JOINT or c in ".-_~" and separated:
                yield [("", JOINED), (" ", APART)]
            elif c == WIDE:
                yield [(" ", JOINED), ("", APART)]
            elif c == BETWEEN:
                yield [(" ", JOINED), ("", PIECES_JOINED)]
            elif c in STANDS_FOR:
                each = [(x, STAND_IN) for x in STANDS_FOR[c]]
                twice = [(x * 2, STAND_IN + 0.5) for x in STANDS_FOR[c]] if many > 1 else []
                yield [*each, *twice, (c * many, KEPT_SIGN)]
            else:
                yield [(c * many, 0.0)]

    def best(self, token: str) -> str:
        """The reading with the least cost of channel and model together.

        A state holds its cost and the last link of its reading, a link being (link before, text). Links that no state
        leads to any more are freed, and where one state is left its reading is settled, so memory is linear in what
        is still open, and a run of any length is searched as a whole.
        """
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(EDGE, EDGE): (0.0, None)}
        settled: list[str] = []
        model, classes = self.model, self.classes
        for readings in [*self._readings(token), [(" ", 0.0)]]:
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (cost, link) in states.items():
                for text, extra in readings:
                    x, y, now = a, b, cost + extra
                    for c in text:
                        z = EDGE if c == " " else classes.get(c, OTHER)
                        now += model[(x * CLASSES + y) * CLASSES + z]
                        x, y = y, z
                    old = after.get((x, y))
                    if old is None or now < old[0]:
                        after[x, y] = (now, (link, text))
            states = after
            if len(states) == 1:
                ((state, (cost, link)),) = states.items()
                settled.append(_said(link))
                states = {state: (0.0, None)}
        return ("".join(settled) + _said(min(states.values(), key=lambda s: s[0])[1])).strip()

    def token(self, token: str, may_matter: bool = False) -> str:
        """Restored form of a lowered token without white space. Without anything odd its lattice is one path."""
        core = self.core.match(token)[1]
        if not may_matter and not self.odd.search(core):
            return core
        if not may_matter and not any(c in self.classes for c in core):
            return core
        if len(core) > 64:
            return self.best(core)
        if core not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[core] = self.best(core)
        return self.known[core]

    def words(self, text: str) -> list[str]:
        """All restored words of a text."""
        text = lowered(text)
        return [self.token(t) for t in set(text.split())] + self.joined(text)

    def spelled_out(self, text: str) -> Iterator[list[str]]:
        """For each run of letters that stand apart, by white space of any kind, its words; wider joints are rather edges."""
        for m in self.spelled.finditer(text):
            narrow = min(len(j) for j in self.joints.findall(m[0]))
            yield self.best(self.joints.sub(lambda j: JOINT if len(j[0]) == narrow else WIDE, m[0])).split()

    def joined(self, text: str) -> list[str]:
        """Words restored from letters that stand apart."""
        return [w for words in self.spelled_out(text) for w in words]

    def pieced(self, pieces: str) -> list[str]:
        """Words restored from short pieces that white space sets apart."""
        return self.best(self.joints.sub(BETWEEN, pieces)).split()


def lowered(text: str) -> str:
    """Lower case without characters that are not seen."""
    return UNSEEN.sub("", text.lower())


def word_features(word: str) -> list[str]:
    """A restored word as a whole and its beginnings."""
    found = ["=" + word] if 2 < len(word) <= 14 else []
    return found + ["^" + word[:k] for k in (4, 5, 6) if len(word) >= k]


def disguises(stem: str, between: str = r"[.\-_~]*") -> str:
    """A pattern for all spellings of a stem that the channel knows: stand-ins, repeats and separators."""
    spelled = {c: c + "".join(k for k, v in STANDS_FOR.items() if c in v) for c in LETTERS}
    return between.join(f"[{re.escape(spelled.get(c, c))}]+" for c, before in zip(stem, " " + stem) if c != before)


def training_rows(docs: DataFrame, labels: DataFrame, most_rows: int, id_col: str, text_col: str) -> DataFrame:
    """(text, toxic) of at most about ``most_rows`` labelled documents out of the learning folds, chosen by a hash."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("_label_id"), "toxic").filter("toxic IN (0, 1) AND crc32(cast(_label_id AS string)) % 5 != 0")
    known = known.groupBy("_label_id").agg(F.max("toxic").alias("_toxic"))
    n = known.count()
    if n > most_rows:
        known = known.filter(F.pmod(F.xxhash64("_label_id"), F.lit(1_000_000)) < F.lit(int(1e6 * most_rows / n)))
    texts = docs.select(F.col(id_col).cast("bigint").alias("_label_id"), text_or_empty(text_col).alias("text"))
    return texts.join(F.broadcast(known), "_label_id").select("text", F.col("_toxic").alias("toxic"))


def learn_terms(rows: DataFrame, model: np.ndarray, least_docs: int = 3, prior: float = 5.0, least_share: float = 0.5, most_terms: int = 20_000, sure_share: float = 0.8, least_company: int = 6) -> dict[str, float]:
    """The features of restored words that together tell the toxic documents, with the share of toxic ones among theirs.

    Features are counted by document in every task and summed up; those of which most documents are toxic, at most
    ``most_terms``, come to the driver as candidates. A share starts from ``prior`` documents of which a tenth is
    toxic, so that few documents cannot make a feature telling. As all words of a text with many copies look telling,
    candidates are then chosen one by one, each for the toxic documents that no chosen one explains: the rows are
    bounded by ``training_rows``, and of each only its candidates are sent.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model)
        seen: list[dict[str, int]] = [{}, {}]
        features: dict[str, list[str]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for toxic, counts in enumerate(seen):
                n = pa.array(list(counts.values()), pa.int64())
                none = pa.array([0] * len(counts), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *((none, n) if toxic else (n, none))], ["term", "clean", "toxic"])
                counts.clear()

        for batch in slices(batches, "text"):
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts, text = seen[toxic], lowered(text)
                terms = {f for w in restorer.joined(text) for f in word_features(w)}
                for token in set(text.split()):
                    of = features.get(token)
                    if of is None:
                        of = features[token] = word_features(restorer.token(token))
                    terms.update(of)
                if len(features) > 200_000:
                    features.clear()
                for term in terms:
                    counts[term] = counts.get(term, 0) + 1
            if len(seen[0]) + len(seen[1]) > 500_000:
                yield from out()
        yield from out()

    counted = rows.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(count, "term string, clean bigint, toxic bigint")
    summed = counted.groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).filter(F.col("toxic") >= least_docs)
    share = (F.col("toxic") + prior / 10) / (F.col("toxic") + F.col("clean") + prior)
    best = summed.withColumn("share", share).filter(F.col("share") >= least_share).orderBy(F.desc("toxic"), "term").limit(most_terms)
    shares = {r["term"]: r["share"] for r in best.select("term", "share").collect()}
    numbers = {t: i for i, t in enumerate(sorted(shares))}

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model)
        for batch in slices(batches, "text"):
            found = [sorted({numbers[f] for w in restorer.words(t) for f in word_features(w) if f in numbers}) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), batch.column(1)], ["terms", "toxic"])

    held: dict[int, set[int]] = {}
    toxic_docs: set[int] = set()
    for doc, (terms, toxic) in enumerate(rows.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(present, "terms array<int>, toxic int").collect()):
        toxic_docs |= {doc} if toxic else set()
        for t in terms:
            held.setdefault(t, set()).add(doc)
    names = sorted(numbers)
    # The longest beginning of a word is taken before the whole word: its other endings are told as well.
    order = sorted(held, key=lambda t: (names[t][0] != "^", -len(names[t]), names[t]))
    worth = {t: (len(docs & toxic_docs), len(docs - toxic_docs)) for t, docs in held.items()}
    cover, left = [], set(toxic_docs)
    while order:
        best_term = max(order, key=lambda t: len(held[t] & left) - 2 * worth[t][1])
        new = len(held[best_term] & left)
        if new < least_docs or new <= 2 * worth[best_term][1]:
            break
        cover.append(best_term)
        left -= held[best_term]
        order.remove(best_term)
    # Terms that always come with chosen ones count as well, if they do so in differing company: words of copies do not.
    company: dict[int, frozenset] = {doc: frozenset(t for t in cover if doc in held[t]) for doc in toxic_docs}
    for t in order:
        stem = names[t][1:]
        seen_in = held[t] & toxic_docs
        if (
            shares[names[t]] >= sure_share
            and len({company[d] for d in seen_in}) >= least_company
            and not any(names[c][1:].startswith(stem) for c in cover)
        ):
            cover.append(t)
    chosen = {names[t]: shares[names[t]] for t in cover}
    return chosen


class Scorer:
    """Score of a whole text: how surely its most telling restored word marks a toxic text."""

    def __init__(self, model: np.ndarray, terms: dict[str, float], base: float):
        self.restorer, self.terms, self.base = Restorer(model), terms, base
        kept: list[str] = []
        for stem in sorted({t[1:] for t in terms}, key=lambda t: (len(t), t)):
            if not any(k in stem for k in kept):  # a stem that holds another one needs no look of its own
                kept.append(stem)
        self.hint = re.compile("|".join(map(disguises, kept))) if kept else None
        across = "|".join(disguises(k, r"(?:[.\-_~]*|\s+)") for k in kept)
        # A spelling of a term that starts a piece of at most five characters, and the rest of its last piece.
        self.pieces = re.compile(rf"(?<!\S)(?=\S{{1,5}}\s)(?:{across})\S*") if kept else None
        self.long_stems = [t[1:] for t in sorted(terms) if len(t) > 6]
        self.plain: set[str] = set()  # tokens that cannot be read as a term
        self.telling: dict[str, float] = {}

    def _word(self, word: str) -> float:
        return max((self.terms.get(f, 0.0) for f in word_features(word)), default=0.0)

    def _token(self, token: str) -> float:
        # Only a token in which some spelling of a term stands can be read as that term: others keep one reading here.
        if not self.hint or not self.hint.search(token):
            return 0.0
        return max([self._word(w) for w in self.restorer.token(token, True).split()] + [self._word(self.restorer.core.match(token)[1])])

    def score(self, text: str) -> float:
        text, best = lowered(text), 0.0
        if len(self.plain) > 500_000:
            self.plain.clear()
        for token in set(text.split()) - self.plain:
            s = self.telling.get(token)
            if s is None:
                s = self._token(token)
                if s > 0:
                    self.telling[token] = s
                else:
                    self.plain.add(token)
            best = max(best, s)
        if len(self.telling) > 200_000:
            self.telling.clear()
        found: list[str] = []
        for words in self.restorer.spelled_out(text):
            found += words
            # Where every letter stands apart no edge of a word is seen: a long term counts wherever it stands.
            letters = "".join(words)
            found += [t for t in self.long_stems if t in letters]
        for m in self.pieces.finditer(text) if self.pieces else ():
            if all(len(piece) <= 5 for piece in m[0].split()):
                found += self.restorer.pieced(m[0])
        best = max([best, *map(self._word, found)])
        return best if best > 0 else self.base


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = 12_000, id_col: str = "doc_id", text_col: str = "text") -> Scorer:
    """Language model from all documents, terms from at most about ``most_rows`` labelled ones."""
    model = language_model(docs, text_col)
    terms = learn_terms(materialized(training_rows(docs, labels, most_rows, id_col, text_col), "training"), model)
    return Scorer(model, terms, 0.02)


def with_score(docs: DataFrame, scorer: Scorer, name: str, text_col: str = "text") -> DataFrame:
    """All rows and columns, and the score in a new column ``name``."""
    text = fresh(docs, "_text")
    schema = docs.schema.add(name, "double")
    model, terms, base = np.array(scorer.restorer.model, np.float32), scorer.terms, scorer.base

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(model, terms, base)
        for batch in slices(batches, text):
            scores = [own.score(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], names=schema.names)

    return docs.withColumn(text, text_or_empty(text_col)).mapInArrow(scored, schema)


def score_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 from 0.5 on) of every row.

    Labels are learned only from rows whose crc32 of the doc_id's digits is not divisible by 5; nothing but the text
    enters a score. A null or empty text, or one without a telling word, has a low score that is the same for all of
    them. A null doc_id is not held out. Without labels every score is that low one. Labels of one doc_id that differ
    count as toxic, other labels than 0 and 1 are left out, further columns are not read, an empty table gives an
    empty one.
    """
    scorer = fit(docs, labels, **options)
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    scored = with_score(narrow, scorer, "score")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """The rows whose score is under ``threshold``, with all their columns."""
    score = fresh(docs, "_score")
    return with_score(docs, fit(docs, labels, **options), score).filter(F.col(score) < threshold).drop(score)
