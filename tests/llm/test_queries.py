"""Each query on the small given tables against a plain computation of the same result."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash

from tests.compare import diff, duck
from tests.conftest import SF_DIR
from tidegate.llm import ann, pii, queries, tokens


def given(spark, name):
    return spark.read.parquet(f"{SF_DIR}/{name}.parquet").collect()


@pytest.fixture(scope="module")
def docs(spark):
    return given(spark, "documents")


def result(spark, name):
    return queries.QUERIES[name](spark, SF_DIR).collect()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op1(spark):
    convs = collections.defaultdict(list)
    for r in given(spark, "conversations"):
        convs[r.conv_id].append((r.turn, r.role, r.text or ""))
    convs[-1] = [(0, "user", queries.PROBE), (1, "assistant", queries.PROBE)]
    got = {r.conv_id: r for r in result(spark, "op1_chat_format")}
    assert set(got) == set(convs)
    for c, rows in convs.items():
        rows.sort()
        loss = "".join(t for _, role, t in rows if role == "assistant")
        want = (len(rows), sha("".join(f"{role}\n{t}\n" for _, role, t in rows)), len(loss), sha(loss))
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == want
        assert got[c].formatted_chars > sum(len(t) for _, _, t in rows)
        roles = "".join(role[0] for _, role, _ in rows)
        assert got[c].valid == bool(re.fullmatch("s?(ua)+", roles))


def test_op2(spark, docs):
    toxic = {r.doc_id: r.toxic for r in given(spark, "labels")}
    got = {r.doc_id: r for r in result(spark, "op2_toxicity")}
    assert set(got) == {d.doc_id for d in docs}
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    right = [got[i].predicted == t for i, t in toxic.items()]
    assert sum(right) / len(right) > 0.8


def test_op3(spark):
    assert diff(spark, duck(SF_DIR), SF_DIR, queries.QUERIES["op3_exact_dedup"], queries.ORACLES["op3_exact_dedup"]) == ""


@pytest.fixture(scope="module")
def encoded(docs):
    encoder = tokens.TextEncoder(tokens.public_tokenizer()).tokenizer
    return {d.doc_id: encoder.encode(d.text or "", add_special_tokens=False).ids for d in docs}


def test_op4(spark, encoded):
    pieces, sequences = collections.defaultdict(list), set()
    for r in result(spark, "op4_packing"):
        ids = encoded[r.doc_id] + [2]
        assert r.doc_tokens == len(ids) and r.offset == 0 and r.length & (r.length - 1) == 0 and 0 < r.length <= 4096
        assert r.ids_crc32 == crc(ids[r.start : r.start + r.length])
        pieces[r.doc_id].append((r.start, r.length))
        assert r.sequence_id not in sequences
        sequences.add(r.sequence_id)
    assert set(pieces) == set(encoded)
    for i, cut in pieces.items():
        at = 0
        for start, length in sorted(cut):
            assert start == at
            at += length
        assert at == len(encoded[i]) + 1


def plain_spans(text):
    """Base kinds by their plain patterns."""
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        total = sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d)))
        if 14 <= len(d) <= 19 and total % 10 == 0:
            found.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append((m.start(), 3, m.end()))
    return ",".join(f"{pii.BASE_KINDS[k]}:{s}:{e}" for s, k, e in sorted(found))


def test_op5(spark, docs):
    got = {r.doc_id: r for r in result(spark, "op5_pii")}
    some = 0
    for d in docs:
        base = plain_spans(d.text or "")
        r = got[d.doc_id]
        assert r.base_sha256 == sha(base)
        assert ",".join(s for s in r.spans.split(",") if s.split(":")[0] in pii.BASE_KINDS) == base
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [base.count(k + ":") for k in pii.BASE_KINDS]
        some += bool(base)
    assert some > 5 and len(got) == len(docs)


def filled(sizes):
    """Targets by dealing out the excess again until none is left."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, target = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in target]
        level = left / sum(weight[s] for s in free)
        above = [s for s in free if level * weight[s] > 2 * sizes[s]]
        if not above:
            return target | {s: level * weight[s] for s in free}
        for s in above:
            target[s] = 2.0 * sizes[s]
            left -= target[s]


def test_op6(spark, docs):
    size = {d.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", d.text or "")) for d in docs}
    source = {d.doc_id: d.source for d in docs}
    by_source, largest = collections.Counter(), collections.Counter()
    for i, n in size.items():
        by_source[source[i]] += n
        largest[source[i]] = max(largest[source[i]], n)
    target = filled(by_source)
    got = result(spark, "op6_mixing")
    taken = collections.Counter()
    for r in got:
        assert (r.size, r.source_size) == (size[r.doc_id], by_source[source[r.doc_id]])
        assert r.target == pytest.approx(target[source[r.doc_id]], rel=1e-9)
        assert r.taken in (0, r.size, 2 * r.size)
        taken[source[r.doc_id]] += r.taken
    assert len(got) == len(docs)
    for s, words in taken.items():
        assert abs(words - target[s]) <= largest[s]
    assert sorted(map(tuple, got)) == sorted(map(tuple, result(spark, "op6_mixing")))


def test_op7(spark):
    pages = given(spark, "pages")
    got = {r.page_id: r for r in result(spark, "op7_html_text")}
    for p in pages:
        article = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        import html

        want = [html.unescape(re.sub("<[^>]*>", "", part)) for part in re.split(r"<(?:/?p|/?h1|br)>", article)]
        want = "\n".join(" ".join(w.split()) for w in want if w.strip())
        assert got[p.page_id].text == want and got[p.page_id].n_chars == len(want) and got[p.page_id].url == p.url


def test_op8(spark, docs):
    prints = {}
    for d in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), d.text or ""))
        parts = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
        prints[d.doc_id] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    group = {i: i for i in prints}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = sorted((root(a), root(b)))
                group[y] = x
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in result(spark, "op8_simhash")}
    assert got == {i: (f"{p:016x}", root(i)) for i, p in prints.items()}


def test_op9(spark, encoded):
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in result(spark, "op9_token_files")}
    at, want = 0, {}
    for i in sorted(encoded):
        ids = encoded[i] + [1]
        want[i] = (at, len(ids), crc(ids))
        at += len(ids)
    assert got == want


def test_op10(spark):
    rows = {r.vec_id: np.array(r.embedding, float) for r in given(spark, "embeddings")}
    ids, x = np.array(sorted(rows)), np.array([rows[i] for i in sorted(rows)])
    got = collections.defaultdict(list)
    for r in result(spark, "op10_neighbours"):
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    found = 0
    for q in [i for i in rows if i % 100 == 0]:
        d = np.sqrt(((x - rows[q]) ** 2).sum(1))
        best = [(float(v), int(i)) for v, i in sorted(zip(d, ids)) if i != q][:10]
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == list(range(1, 11))
        assert all(s == pytest.approx(float(np.sqrt(((rows[i] - rows[q]) ** 2).sum())), abs=1e-12) for _, i, s in mine)
        assert [(s, i) for _, i, s in mine] == sorted((s, i) for _, i, s in mine)
        found += len({i for _, i in best} & {i for _, i, _ in mine}) / 10
    assert found / len(got) >= 0.9
    assert ann.LIST_ROWS > 0
