"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns; properties of the parts."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tidegate.llm import ann, chat, codec, components, exact_dedup, html, mixing, packing, pii, simhash, token_files, tokens, toxicity

LONG = "word " * 60_000
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, keep_id string, `_text` string, score int"


def docs(spark, *pairs):
    """Documents of (doc_id, text[, source]) with further columns that clash with those the operators add."""
    made = [(p[0], p[1], "en", p[2] if len(p) > 2 else "s", None, "mine", "own", 7) for p in pairs]
    return spark.createDataFrame(made, DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    return docs(spark, (1, None), (2, ""), (3, "a b c d e"), (3, "a b c d e"), (None, "a b c d e"), (4, LONG, None), (5, "a b c d e", None))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def file():
    return tokens.public_tokenizer()


def test_exact_groups(spark, odd, none):
    got = rows(exact_dedup.exact_groups(odd).select("doc_id", "keep_id", "group_size", "kept"))
    want = [(1, 2, 2, False), (2, 2, 2, True), (3, 5, 4, False), (3, 5, 4, False), (None, 5, 4, False), (4, 4, 1, True), (5, 5, 4, True)]
    assert got == sorted(want, key=repr)
    left = exact_dedup.drop_exact_duplicates(odd)
    assert left.columns == odd.columns and rows(left, "doc_id", "keep_id") == [(2, "mine"), (4, "mine"), (5, "mine")]
    assert exact_dedup.exact_groups(none).count() == 0 == exact_dedup.drop_exact_duplicates(none).count()


def test_exact_groups_over_many_ranges(spark):
    """One text fills most ranges; others begin like it."""
    made = [(i, "x" * 40 if i % 3 else f"{'x' * 40}{i % 7}") for i in range(3000)]
    df = spark.createDataFrame(made, "doc_id bigint, text string").repartition(16)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = exact_dedup.exact_groups(df).collect()
        kept = exact_dedup.drop_exact_duplicates(df).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    groups = collections.defaultdict(list)
    for i, t in made:
        groups[t].append(i)
    text = dict(made)
    assert len(got) == len(made)
    for r in got:
        of = groups[text[r.doc_id]]
        assert (r.keep_id, r.group_size, r.kept) == (max(of), len(of), r.doc_id == max(of))
    assert sorted(r.doc_id for r in kept) == sorted(map(max, groups.values()))


def test_near_groups(spark, odd, none):
    got = {(r.doc_id, r.component_id) for r in simhash.near_groups(odd).collect()}
    assert got == {(1, 1), (2, 1), (3, 3), (None, 3), (5, 3), (4, 4)}
    left = simhash.drop_near_duplicates(odd)
    assert left.columns == odd.columns and sorted(r.doc_id or 0 for r in left.collect()) == [0, 1, 3, 3, 4]
    assert simhash.near_groups(none).count() == 0 == simhash.drop_near_duplicates(none).count()


def test_segments_cost_least():
    def probes(n):
        balls = simhash.segment_balls(4, simhash.segments_for(n))
        return sum(math.comb(width, b) for _, width, radius in balls for b in range(radius + 1))

    assert [probes(n) for n in (1, 10**4, 10**5, 10**6, 10**7, 2 * 10**7)] == [20, 20, 45, 45, 45, 45]
    assert probes(10**9) == 562  # with 45, each would meet thousands by chance
    for n in (10**3, 10**6, 10**7, 10**8, 10**10):
        assert simhash.lookup_cost(n, 4, simhash.segments_for(n)) <= min(simhash.lookup_cost(n, 4, k) for k in (2, 3, 4))


@pytest.mark.parametrize("segments", [1, 2, 3, 4, 5])
def test_balls_find_all_links(segments):
    balls, draw = simhash.segment_balls(4, segments), random.Random(3)
    assert sum(w for _, w, _ in simhash.segment_balls(64, segments)) == 64
    for _ in range(2000):
        flipped = sum(1 << b for b in draw.sample(range(64), draw.randint(0, 4)))
        assert any(((flipped >> s) & ((1 << w) - 1)).bit_count() <= r for s, w, r in balls)


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 160)]
    got = dict(rows(components.components(spark.createDataFrame(links, "a bigint, b bigint"))))
    assert got == {i: 0 for i in range(51)} | {i: 100 for i in range(100, 160)}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_packing(spark, odd, none, file):
    got = packing.pack(odd, file).select("doc_id", "start", "length", "doc_tokens").collect()
    by = collections.Counter()
    for r in got:
        by[r.doc_id] += r.length
    assert by[1] == by[2] == 1 and by[3] == 12 and by[None] == by[5] == 6 and by[4] == 60_001
    assert packing.pack(none, file).count() == 0
    assert packing.binary_lengths(4096 * 2 + 5, 4096) == [4096, 4096, 4, 1]


def test_token_files(spark, odd, none, file, folder):
    token_files.write_token_files(odd, f"{folder}/a", file, block_ids=100)
    got = sorted(token_files.read_token_files(spark, f"{folder}/a").select("start", "doc_id", "n_tokens").collect())
    assert [(r.doc_id, r.n_tokens) for r in got] == [(None, 6), (1, 1), (2, 1), (3, 6), (3, 6), (4, 60_001), (5, 6)]
    assert [r.start for r in got] == [0, 6, 7, 8, 14, 20, 60_021]
    token_files.write_token_files(none, f"{folder}/b", file)
    assert token_files.read_token_files(spark, f"{folder}/b").count() == 0


def test_blocks(file):
    draw = np.random.default_rng(2)
    for n in (0, 1, 511, 3000, 40_000):
        ids = np.where(draw.random(n) < 0.6, 7, draw.integers(0, 49_000, n)).astype("<u4")
        block = codec.write_block([None, 9], np.array([n, 0]), ids)
        names, counts, back = codec.read_block(block)
        assert names == [None, 9] and counts.tolist() == [n, 0] and (back == ids).all()
    assert len(block) < 40_000 * 2
    for at in (5, len(block) // 2, len(block) - 1):
        with pytest.raises(ValueError):
            codec.read_block(block[:at] + bytes([block[at] ^ 1]) + block[at + 1 :])


def test_encoder_is_the_library(file):
    texts = ["", "İstanbul Σίσυφος <|endoftext|> <|ENDOFTEXT|> a", "a.b, c., (d), e's. I'M. x", "ﬀ ÅÅ é x́.", "\x85a\xa0b c\x1cd", "漢字 かな. 123.45, 6\n..., ."]
    encoder = tokens.TextEncoder(file, room=10)
    for text in texts * 2:
        assert encoder.encode([text])[0].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
    ids, counts = encoder.encode(texts)
    assert len(ids) == counts.sum()


def test_mixing(spark, odd, none):
    got = mixing.mix(odd).collect()
    sizes = {r.doc_id: r.size for r in got}
    assert sizes == {1: 0, 2: 0, 3: 5, None: 5, 4: 60_000, 5: 5} and len(got) == 7
    assert {r.source_size for r in got} == {15, 60_005} and all(r.taken <= 2 * r.size for r in got)
    taken = mixing.mixed_rows(odd)
    assert taken.columns == odd.columns
    assert sum(len((r.text or "").split()) for r in taken.collect()) == sum(r.taken for r in got)
    assert mixing.mix(none).count() == 0 == mixing.mixed_rows(none).count()


def test_mixing_comes_near_its_targets_in_several_rounds(spark):
    draw = random.Random(4)
    sizes = [(i, "abc"[min(i % 9, 2)], draw.randint(1, 300)) for i in range(3000)]
    df = spark.createDataFrame(sizes, "doc_id bigint, source string, size bigint")
    got = mixing.mix_copies(df, fan_in=8).collect()
    words, target = collections.Counter(), {}
    for r in got:
        words[r.source] += r.copies * r.size
        target[r.source] = r.target
    assert len(got) == 3000 and all(abs(words[s] - target[s]) <= 300 for s in target)


def test_mixing_parts_rows_that_repeat(spark, monkeypatch):
    """Rows that agree are not taken all or none, in one block or in several."""
    given = [(1, "b", "ten " * 10, f"n{i}") for i in range(300)] + [(i, "a", "one " * 30, "x") for i in range(100, 400)] + [(None, None, "w v", "y")] * 7
    df = spark.createDataFrame(given, "doc_id bigint, source string, text string, note string")
    for block in (50_000, 40):
        monkeypatch.setattr(mixing, "ROWS_PER_BLOCK", block)
        got = mixing.mix(df).collect()
        assert len(got) == len(given) and all(r.taken in (0, r.size, 2 * r.size) for r in got)
        words, target = collections.Counter(), {}
        for r in got:
            words[r.doc_id if r.doc_id in (1, None) else 0] += r.taken
            target[r.doc_id if r.doc_id in (1, None) else 0] = (r.target, r.size)
        assert all(abs(words[u] - t) <= size for u, (t, size) in target.items()), (words, target)
        rows = collections.Counter(map(tuple, mixing.mixed_rows(df).collect()))
        assert set(rows) <= set(given)
        assert {u: sum(n * len(r[2].split()) for r, n in rows.items() if (r[0] if r[0] in (1, None) else 0) == u) for u in words} == dict(words)
        assert all(n <= 2 for r, n in rows.items() if r[0] is not None)


def test_toxicity(spark, none):
    draw = random.Random(6)
    clean = "the and of with from this that river stone house garden window summer winter paper".split()
    bad = {"scoundrel": "sc0undr3l s.c.o.u.n.d.r.e.l scoouundrel".split(), "blockhead": "bl0ckh3ad b-l-o-c-k-h-e-a-d".split()}
    made, labels = [], []
    for i in range(600):
        words = draw.choices(clean, k=30)
        if toxic := i % 5 == 0:
            words.insert(draw.randrange(30), draw.choice(list(bad)))
        made.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    hidden = [w for ws in bad.values() for w in ws] + ["s c o u n d r e l"]
    made += [(10_000 + k, f"the stone {w} of summer") for k, w in enumerate(hidden)] + [(20_000, None), (20_001, ""), (None, "the"), (0, made[0][1])]
    label_rows = spark.createDataFrame([*labels, (None, 1, 1), (7, None, None)], "doc_id bigint, quality int, toxic int")
    got = toxicity.score_documents(docs(spark, *made), label_rows).collect()
    found = {r.doc_id: r for r in got}
    assert len(got) == len(made)
    for i, _, toxic in labels:
        assert found[i].predicted == toxic, i
    for k, w in enumerate(hidden):
        assert found[10_000 + k].predicted == 1, w
    assert found[20_000].score == found[20_001].score == found[None].score < 0.5 and found[None].held_out is False
    left = toxicity.drop_toxic(docs(spark, *made), label_rows)
    assert left.columns == none.columns and left.count() == sum(r.predicted == 0 for r in got)
    assert toxicity.score_documents(none, label_rows).count() == 0
    unlabelled = toxicity.score_documents(docs(spark, (1, "the scoundrel")), label_rows.limit(0)).collect()
    assert [r.predicted for r in unlabelled] == [0]


def test_personal_data(spark, odd, none):
    got = pii.find_personal_data(odd)
    assert got.count() == 7 and got.filter("spans != ''").count() == 0 and pii.find_personal_data(none).count() == 0
    text = "pay by card 4111 1111 1111 1111, iban DE89 3704 0044 0532 0130 00; a@b@c.de x@y.z.@q.r 1.2.3.4.5.6.7.8 256.1.1.1 ssn 123-45-6789 +1 (555) 123-4567"
    zeros = "0" * 5000
    assert pii.confirmed(f"{zeros}1.{zeros}.0.255")[0] == (0, 10008, 1) and not pii.confirmed(f"{zeros}256.1.1.1")
    kinds = [pii.KINDS[k] for _, _, k in pii.confirmed(text)]
    assert kinds.count("iban") == 1 and kinds.count("card") == 1 and kinds.count("ssn") == 1 and kinds.count("phone") == 1
    assert not any(pii.KINDS[k] == "iban" for _, _, k in pii.confirmed(text.replace("DE89", "DE88")))
    draw = random.Random(1)
    for _ in range(3000):
        sample = "".join(draw.choices("ab@.@1.2+ -() 9", k=40))
        from tests.llm.test_queries import plain_spans

        mine = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, e, k in pii.confirmed(sample) if k < 4)
        assert mine == plain_spans(sample)


PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="post"><header><a href=/>Home</a> Site</header>
<nav><ul><li><a>One</a><li><a>Two</a></ul></nav><div class="cookie-notice">We use cookies.</div>
<div id="content"><h1>The &amp; title</h1><p>First paragraph of some length,&nbsp;with <a href="x">a link</a> in it.
<p>Second   paragraph<br>after a break, long enough to count as text.<form><input value=x>Send</form>
<script>var a = "<p>no</p>";</script><table><tr><td>Cell one<td>Cell two</table></div>
<aside>Related</aside><div class="comments"><p>Reader: great text, really a long comment about it.</p></div><footer>Imprint</footer></body></html>"""


def test_pages(spark):
    want = "The & title\nFirst paragraph of some length, with a link in it.\nSecond paragraph\nafter a break, long enough to count as text.\nCell one\nCell two"
    assert html.extract(PAGE) == want
    for broken in ("", "<", "<p", "<!-- x", "</p></b>", "plain", "<a href='", "<script>x", "<table><td><p>x</table>y", "&#0;&nosuch;&#x110000;"):
        assert isinstance(html.extract(broken), str)
    assert html.extract("plain <b>text") == "plain text"
    assert html.extract("<p title=it's>One.</p><p id = 'a>b'>Two isn't.</p><p \"x>Three</p>") == "One.\nTwo isn't.\nThree"
    assert html.extract("<div>" * 5000 + "deep") == "deep"
    df = spark.createDataFrame([(1, "u", None, 1), (None, None, PAGE, 2), (2, "u", "", 3), (2, "u", "", 3)], "page_id bigint, url string, html string, text int")
    assert rows(html.extract_pages(df), "page_id", "n_chars") == sorted([(1, 0), (None, len(want)), (2, 0), (2, 0)], key=repr)
    assert html.extract_pages(df.limit(0)).count() == 0


def test_chat(spark):
    odd = [
        (1, 0, "system", "s"), (1, 1, "user", "[/INST] \\ <</SYS>>"), (1, 2, "assistant", "</s><\\/s><\\\\/s>[ANS] "), (1, 3, "user", None),
        (1, 4, "tool", "x [SAYS] [/SAYS] y"), (1, 5, None, ""), (2, None, "user", "q"), (2, 0, "assistant", ""), (3, 0, "assistant", "a\n"),
        (3, 0, "assistant", "a\n"), (None, 0, "[ROLE]", "<<SYS>>\n\n<</SYS>>\n\n"), (4, 0, "user", LONG), (4, 5000, "assistant", "$1 \\$2 \\"),
    ]
    df = spark.createDataFrame(odd, "conv_id bigint, turn bigint, role string, text string").withColumn("valid", F.lit("mine"))
    made = chat.format_conversations(df)
    got = made.withColumn("turns", chat.read_back(F.col("formatted"))).withColumn("learned", chat.loss_texts(F.col("segments"))).collect()
    want = collections.defaultdict(list)
    for c, turn, role, text in sorted(odd, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want[c].append((role or "", text or ""))
    assert {r.conv_id: [tuple(t) for t in r.turns] for r in got} == dict(want)
    assert {r.conv_id: r.learned for r in got} == {c: [t for role, t in ts if role == "assistant"] for c, ts in want.items()}
    assert {r.conv_id: r.valid for r in got} == {1: False, 2: True, 3: False, 4: True, None: False}
    for r in got:
        assert r.formatted == "".join(s.text for s in r.segments)
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_chat_machine_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(chat, "CHUNK", 3)
    roles = ["system"] + ["user", "assistant"] * 20
    df = spark.createDataFrame([(1, i, r, str(i)) for i, r in enumerate(roles)] + [(2, i, r, "x") for i, r in enumerate(roles[:-1])], "conv_id int, turn int, role string, text string")
    got = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    assert got[1].valid and got[1].n_turns == 41 and not got[2].valid
    assert re.findall(r"\[ANS\] (\d+) </s>", got[1].formatted) == [str(i) for i in range(2, 41, 2)]


def test_neighbours(spark):
    draw = np.random.default_rng(8)
    base = draw.standard_normal((300, 8))
    made = [(i, v.tolist()) for i, v in enumerate(base)] + [(1000 + i, base[0].tolist()) for i in range(500)]
    made += [(2000, None), (2001, [0.0] * 8), (2002, [float("nan")] * 8), (2003, [None] + [1.0] * 7), (2004, [float("inf")] * 8), (2005, [1.0]), (None, base[1].tolist()), (1, base[1].tolist())]
    df = spark.createDataFrame(made, "vec_id bigint, embedding array<double>").withColumn("id", F.lit("mine"))
    got = collections.defaultdict(list)
    for r in ann.search(df, every=100, k=10).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    known = {i: np.array(v) for i, v in made if i is not None and v is not None and len(v) == 8 and i < 2000}
    assert set(got) == {i for i in known if i % 100 == 0}
    assert [i for _, i, _ in sorted(got[0])] == list(range(1000, 1010)) and {s for _, _, s in got[0]} == {0.0}
    assert [i for _, i, _ in sorted(got[1000])] == [0, *range(1001, 1010)]
    hit = 0
    for q in (100, 200):
        best = sorted((float(np.sqrt(((v - known[q]) ** 2).sum())), i) for i, v in known.items() if i != q)[:10]
        hit += len({i for _, i in best} & {i for _, i, _ in got[q]})
    assert hit >= 18
    assert ann.search(df.limit(0)).count() == 0
    few = ann.search(df.filter("vec_id IN (100, 5, 7)"), every=100, k=10).collect()
    assert sorted((r["rank"], r.query_id) for r in few) == [(1, 100), (2, 100)]


def test_digest_of_empty_text():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


def test_words_reach_the_model_as_in_the_library():
    encoder = tokens.TextEncoder(tokens.public_tokenizer())
    assert len(encoder.letters) > 200
    letters = "".join(map(chr, encoder.letters))
    texts = [
        letters, " ".join(letters), letters[::-1], "plain words, again plain words.", "don't it's A'S re ve ll", "Ünï ÀB ñçß æœ øå ǆ Ǆ ǅ",
        "éä ño", "İstanbul ıx K ſtop", "漢字 Hello WORLD привет ΣΑΣ", "x<|endoftext|>y <|startoftext|>", "a1b2 12 3.5 x_y", "", " \n\t",
    ]
    ids, counts = encoder.encode(texts)
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


def test_dropped_duplicates_carry_their_text_once(spark, monkeypatch):
    """The text is sorted and stored once; of the column itself only whether it is null goes along."""
    seen = []
    stored = exact_dedup.materialized
    monkeypatch.setattr(exact_dedup, "materialized", lambda df, *a, **k: seen.append(df) or stored(df, *a, **k))
    made = [(1, None, "a"), (2, "x", None), (3, "x", "b"), (4, "y" * 50, "c"), (5, "z", "d")]
    docs = spark.createDataFrame(made, "doc_id bigint, text string, `odd.name` string").repartition(3)
    assert rows(exact_dedup.drop_exact_duplicates(docs)) == sorted([m for m in made if m[0] != 2], key=repr)
    head = seen[0].schema["head"].dataType
    assert [f.dataType.typeName() for f in head] == ["long", "string", "boolean"]
    assert "text" in seen[0].columns and "ids" not in seen[0].columns


def library_ids(encoder, texts):
    return [i for t in texts for i in encoder.tokenizer.encode(t, add_special_tokens=False).ids]


def test_words_with_signs_share_their_entry(file):
    """op9 over its CPU budget: each word with other signs behind it was a new word to encode."""
    encoder = tokens.TextEncoder(file)
    texts = ["Straße, straße### straße.%%% (straße) a-b.c@d it's it'S. 'll x.'s", "straße!! 漢字. straße.", "straße. <|endoftext|> a.", "a\x85. b\xa0.\tc.\x00"]
    ids, counts = encoder.encode(texts)
    assert ids.tolist() == library_ids(encoder, texts) and len(counts) == 4
    assert {w for w in encoder.known if "straße" in w} == {"straße", "(straße", "straße!!", "straße."}  # the last two: rare letters, <|
    assert {"it's", "a", "-b", ".c", "@d"} <= set(encoder.known)


def test_words_met_again_stay_known(file):
    """op9 over its CPU budget: a full table forgot frequent words that the texts at hand did not hold."""
    encoder = tokens.TextEncoder(file, room=40)
    often, once = "one two three four", iter(f"{a}{b}word" for a in "bcdfghjklm" for b in "aeiouy")
    for _ in range(2):
        encoder.encode([often])
    for _ in range(5):
        texts = [" ".join(next(once) for _ in range(9))]
        assert encoder.encode(texts)[0].tolist() == library_ids(encoder, texts)
    assert set(often.split()) <= set(encoder.known) and len(encoder.known) < 40 and "bayword" not in encoder.known
    assert encoder.encode([often])[0].tolist() == library_ids(encoder, [often])
    many = [" ".join(f"{a}{b}" for a in "abcdefgh" for b in "abcdefgh")] * 2  # more than the room
    for _ in range(3):
        assert encoder.encode(many)[0].tolist() == library_ids(encoder, many)


def test_new_words_without_a_unit_for_their_end(file):
    encoder = tokens.TextEncoder(file)
    encoder.last[:] = False
    texts = ["plain words äé ßen"]
    assert encoder.encode(texts)[0].tolist() == library_ids(encoder, texts)
