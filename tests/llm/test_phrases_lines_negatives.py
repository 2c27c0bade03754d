"""Phrase mining, shared lines and hard negatives against plain Python, with odd rows."""

import collections
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tidegate.llm import lines, negatives, phrases

DOCS = "doc_id bigint, text string, lang string, rank int, key string, hash string, n long, word string"


def docs(spark, made):
    """(doc_id, text, lang) with further columns that clash with those the operators add."""
    return spark.createDataFrame([(*m, 1, "k", "h", 2, "w") for m in made], DOCS)


def plain_phrases(made, least, most, first):
    n, f = collections.Counter(), collections.defaultdict(collections.Counter)
    for _, text, lang in made:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, most + 1):
                for i in range(len(words) - size + 1):
                    f[lang][tuple(words[i : i + size])] += 1
    out = []
    for lang, counts in f.items():
        known = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in known.items():
            cuts = [(2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            inside = (b for q, b in known.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))))
            if not any(100 * b >= 80 * a for b in inside):
                kept.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(kept)[:first], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def prose():
    draw = random.Random(2)
    words = ["Alpha", "beta", "gamma", "déjà", "vu", "ÉTÉ", "x" * 50, "new", "york", "city", "\x00odd\x1c", "of", "the"]
    marks = [" ", " ", " ", " ", "\t", ". ", "\n", ",", "; ", "\r", "\x0b"]
    made = []
    for i in range(300):
        text = "".join(draw.choice(words) + draw.choice(marks) for _ in range(draw.randrange(60)))
        made.append((i, text + " new york city of the " * draw.randrange(3), draw.choice(["en", "de", None, "und", ""])))
    return [*made, (None, None, "en"), (5, "", None), *made[:3], (900, "the new york " * 4000, "en"), (901, " . , \n", "fr")]


@pytest.mark.parametrize("shards, window", [(1, 300_000), (4, 300_000), (3, 97)])
def test_collocations(spark, prose, monkeypatch, shards, window):
    monkeypatch.setattr(phrases, "HELD_COUNTS", 500)
    df = docs(spark, prose).repartition(5)
    if window != phrases.WINDOW_WORDS:  # tasks read the module themselves, so runs are cut by the reader's own default
        batch = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array(["a b c d . e f " * 30])], ["lang", "text"])
        whole = [w.hashes[: w.begin].tolist() for _, w in phrases.read_words(batch, 3)]
        monkeypatch.setattr(phrases, "WINDOW_WORDS", window)
        assert sum((w.hashes[: w.begin].tolist() for _, w in phrases.read_words(batch, 3)), []) == sum(whole, [])
    got = rows(phrases.collocations(df, least=8, words=4, first=40, shards=shards))
    assert got == plain_phrases(prose, 8, 4, 40)


def test_collocations_find_nothing(spark):
    for made in ([], [(1, None, None)], [(1, "a b c", "en")]):
        found = phrases.collocations(docs(spark, made))
        assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and found.count() == 0


def test_runs_share_words(monkeypatch):
    """Each phrase begins in one run and is whole there."""
    monkeypatch.setattr(phrases, "WINDOW_WORDS", 7)
    text = " ".join(f"w{i}" for i in range(50))
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "de", "en"]), pa.array([text, "", text])], ["lang", "text"])
    seen = collections.Counter()
    for _, words in phrases.read_words(batch, 3):
        for size, (here, hashes) in enumerate(words.phrases(4), 1):
            seen.update((size, h) for h, ok in zip(hashes[: words.begin].tolist(), here[: words.begin]) if ok)
    assert len(seen) == 50 + 49 + 48 + 47 and set(seen.values()) == {2}


def plain_lines(made, least_chars, least_docs):
    def key(line):
        return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))

    holders = collections.defaultdict(set)
    for i, text, _ in made:
        for line in (text or "").split("\n"):
            holders[key(line)].add(i)
    out = []
    for i, text, _ in made:
        parts = (text or "").split("\n")

        def goes(line):
            of = holders[key(line)]
            return len(key(line)) >= least_chars and len(of) >= least_docs and i != max(of, key=lambda x: (x is not None, x or 0))

        kept = [x for x in parts if not goes(x)]
        out.append((i, len(parts), len(parts) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_lines(spark):
    draw = random.Random(4)
    pool = ["Subscribe to our newsletter!", " subscribe TO our newsletter!\t", "short", "", "ÉTÉ à la plage, tous les jours", "été à la plage, tous les jours",
            "x" * 19, "y" * 20, "é" * 19 + "Z", "trailing\r", "a line that is only here, in some texts"]
    made = [(i, "\n".join(draw.choice(pool) for _ in range(draw.randrange(8))), "en") for i in range(60)]
    made += [(None, pool[0] + "\n" + pool[4], "en"), (None, pool[0], "en"), (70, None, "en"), (71, "", "en"), (72, "\n", "en"), made[0], (made[1][0], pool[0], "en")]
    made += [(100 + i, "   " + "\t" * 50_000 + "wide line with blanks inside" + " " * 50_000 + "!" + "\n" * 2_000, "en") for i in range(3)]
    made += [(200 + i, "everywhere the same line stands\nown line of document number %d" % i, "en") for i in range(500)]
    assert rows(lines.dedup_lines(docs(spark, made))) == plain_lines(made, 20, 3)
    assert lines.dedup_lines(docs(spark, [])).count() == 0
    assert rows(lines.dedup_lines(docs(spark, made), least_chars=1, least_docs=2)) == plain_lines(made, 1, 2)


def plain_negatives(made, every, positives, count, low, high):
    out = []
    for a, la, va in made:
        if a % every:
            continue
        score = {True: [], False: []}
        for b, lb, vb in made:
            if b != a:
                score[la == lb].append((-sum(x * y for x, y in zip(va, vb)), b))
        for ps, p in sorted(score[True])[:positives]:
            fit = [(s, b) for s, b in sorted(score[False]) if low * -ps <= 100 * -s <= high * -ps][:count]
            out += [(a, p, r, b, -ps, -s) for r, (s, b) in enumerate(fit, 1)]
    return sorted(out, key=repr)


VECTORS = "vec_id bigint, label int, embedding array<bigint>, rank int, anchor string, id int"


@pytest.mark.parametrize("width, block", [(0, 4), (1, 100), (5, 3), (64, 4096)])
def test_negatives(spark, monkeypatch, width, block):
    draw = random.Random(width)
    made = [(i, draw.randrange(3), [draw.randrange(-9, 30) for _ in range(width)]) for i in range(400)]
    made += [(i, 1, [7] * width) for i in range(400, 700)]  # one vector, very often
    made += [(i, 2, [7] * width) for i in range(700, 800)]
    odd = [(None, 1, [1] * width), (10, None, [1] * width), (20, 1, None), (30, 1, [1] * (width + 2)), (40, 1, [None] * max(1, width))]
    df = spark.createDataFrame([(*m, 1, "a", 2) for m in made + odd], VECTORS).repartition(4)
    got = rows(negatives.mine_negatives(df, every=50, positives=3, negatives=4, block_anchors=block))
    assert got == plain_negatives(made, 50, 3, 4, 30, 90)


def test_negatives_of_repeated_rows(spark):
    made = [(0, 1, [3, 1]), (0, 1, [3, 1]), (1, 1, [2, 2]), (1, 1, [2, 2]), (2, 2, [1, 2]), (2, 2, [1, 2]), (3, 3, [-9, -9])]
    df = spark.createDataFrame([(*m, 1, "a", 2) for m in made], VECTORS)
    one = [(0, 1, 1, 2, 8, 5), (0, 1, 2, 2, 8, 5)]
    assert rows(negatives.mine_negatives(df)) == sorted(one * 4, key=repr)
    assert negatives.mine_negatives(df.limit(0)).count() == 0
    assert negatives.mine_negatives(df.filter("vec_id > 0")).count() == 0


def test_bounds_hold(spark):
    import numpy as np

    draw = np.random.default_rng(1)
    for width in (1, 3, 16, 64, 100):
        def made(n):
            v = np.floor(draw.standard_normal((n, width)) * 50) + 3
            m, d = negatives.summaries(v)
            lists = [pa.array(list(x)) for x in (v, m, d)]
            return negatives.Vectors(pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([0] * n), *lists], ["id", "label", "v", "means", "deviations"]))

        a, b = made(20), made(30)
        exact = a.values @ b.values.T
        before = np.inf
        for level in a.levels:
            low, high = negatives.bounds(a, b, level)
            assert (low <= exact).all() and (exact <= high).all()
            assert (high - low).mean() <= before + 1e-6
            before = (high - low).mean()


def test_queries_equal_their_sql(spark):
    from tests.compare import diff, duck
    from tidegate.llm.queries import ORACLES, QUERIES

    folder = "/root/testdata/sf0.01"
    con = duck(folder)
    for name in ("op11_phrases", "op12_line_dedup", "op13_hard_negatives"):
        assert diff(spark, con, folder, QUERIES[name], ORACLES[name]) == "", name
