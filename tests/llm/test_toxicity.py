"""Toxicity at sf0.1: held-out rows, and every disguise at every place."""

import random
import time
import zlib

import numpy as np
import pytest

from tidegate.llm import toxicity

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    return toxicity.fit(docs, labels), docs, {r.doc_id: r.toxic for r in labels.collect()}


@pytest.fixture(scope="module")
def terms(fitted):
    """Learned beginnings with a word that goes on from each, by the longest ones."""
    return [w for w in ("disgusting", "pathetic", "worthless", "stupid") if fitted[0]._word(w) > 0.5]


def test_held_out_rows(fitted):
    scorer, docs, labels = fitted
    scores = {r.doc_id: r._s for r in toxicity.with_score(docs, scorer, "_s").select("doc_id", "_s").collect()}
    held = [i for i in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    flagged = {i for i in held if scores[i] >= 0.5}
    toxic = {i for i in held if labels[i] == 1}
    assert len(toxic) > 50 and len(held) - len(toxic) > 200
    assert len(flagged & toxic) / len(toxic) > 0.8
    assert len(flagged & toxic) / len(flagged) > 0.95


def test_every_place_of_a_run(fitted, terms):
    scorer = fitted[0]
    assert len(terms) >= 3
    letters = [c for c in "thonthshouinstfromerbleatantiblehaoreaaretheitheanoferreshreedtionerorinthethater" * 2]
    assert scorer.score(" ".join(letters)) < 0.5
    for word in terms:
        for at in range(len(letters) + 1):
            for joint in (" ", "  ", "\t", "\n"):
                assert scorer.score(joint.join([*letters[:at], *word, *letters[at:]])) >= 0.5, (word, at, joint)


def test_every_place_of_a_long_token(fitted, terms):
    scorer = fitted[0]
    for word in terms:
        for at in range(0, 200):
            assert scorer.score("-".join("q" * at) + " " + "-".join(word) + " x") >= 0.5, (word, at)


def test_unseen_characters_stand_ins_and_pieces(fitted, terms):
    scorer = fitted[0]
    signs = str.maketrans({"i": "1", "s": "$", "a": "@", "e": "3", "t": "7", "o": "0"})
    for word in terms:
        for hidden in ("​".join(word), "­".join(word), word.translate(signs), " ".join(word.translate(signs)), "".join(c * 3 for c in word)):
            assert scorer.score(f"the river {hidden} house") >= 0.5, hidden
    for hidden in ("stu pid", "s tupid", "stupi d", "st\tu\npid"):
        assert scorer.score(f"the river {hidden} house") >= 0.5, hidden
    for clean in ("the path entry", "mass tup ids", "a b c d e f g", "1 2 3 4 5", "455 4550 1057", "", " \t\n", "​"):
        assert scorer.score(clean) < 0.5, clean


def test_words_of_signs_alone():
    """A term whose letters all have stand-ins is found when it is written in signs alone."""
    # A model under which "gloss" is the only likely word.
    counts = np.full((toxicity.CLASSES,) * 3, 9.0, np.float32)
    classes = [toxicity.EDGE, toxicity.EDGE, *(toxicity.LETTERS.index(c) + 1 for c in "gloss"), toxicity.EDGE]
    for a, b, c in zip(classes, classes[1:], classes[2:]):
        counts[a, b, c] = 0.1
    scorer = toxicity.Scorer(counts, {"=gloss": 0.9}, 0.02)
    assert scorer.score("an 91$$0 here") == scorer.score("an 9100 here") == 0.02
    assert scorer.score("an 9|0$$ here") == scorer.score("an 6105$ here") == scorer.score("an 910$$ here") == 0.9


def test_long_runs_are_linear_and_whole(fitted):
    scorer, draw = fitted[0], random.Random(3)
    began = time.time()
    run = [draw.choice("aeiou1430sdrtln$") for _ in range(100_000)]
    assert scorer.score(" ".join([*run, *"disgusting", *run])) >= 0.5
    assert 0 <= scorer.score("".join(run)) <= 1
    assert time.time() - began < 60
