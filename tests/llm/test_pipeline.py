"""The pipeline's stages as a chain, each on what its predecessor kept, against plain Python; also on odd rows."""

import collections
import re

import numpy as np
import pytest
import tokenizers
import xxhash

import corpus_pipeline
from tests.conftest import SF_DIR
from tests.llm.test_queries import filled
from tidegate.llm import tokens
from tidegate.session import work_path
from tidegate.views import Tables


def whole(rows):
    return collections.Counter(tuple(r) for r in rows)


@pytest.fixture(scope="module")
def chain(spark):
    """[(stage, rows it got, rows it gave)], with copies, near copies and toxic texts set among the documents."""
    t = Tables(spark, SF_DIR.replace("sf0.001", "sf0.01"))
    docs, labels = t.documents, t.labels
    given = docs.collect()
    toxic = {r.doc_id for r in labels.filter("toxic = 1").collect()}
    longest = sorted((d for d in given if d.doc_id not in toxic and len(d.text) > 4_000), key=lambda d: d.doc_id)[:5]
    first = max(d.doc_id for d in given) + 1
    more = [(first + i, d.text, d.lang, d.source, d.n_chars) for i, d in enumerate(longest * 2)]
    more += [(first + 100 + i, d.text + " so", d.lang, d.source, d.n_chars) for i, d in enumerate(longest)]
    more += [(first + 200 + i, d.text, d.lang, "planted", d.n_chars) for i, d in enumerate(d for d in given if d.doc_id in toxic)]
    more += [(first + 900, None, None, None, None), (first + 901, "", "en", None, 0), (None, "words without a number", "en", "s", 3)]
    now = docs.unionByName(spark.createDataFrame(more, docs.schema))
    out = []
    for name, stage in corpus_pipeline.STAGES:
        path = work_path(spark, f"test-{name}")
        stage(spark, now, t.sf_dir).write.parquet(path)
        made = spark.read.parquet(path)
        out.append((name, now.collect(), made.collect()))
        now = made
    return out, toxic, longest, first


def test_stages(chain):
    assert [name for name, _, _ in chain[0]] == ["toxicity", "exact_dedup", "simhash_near_dedup", "mixing", "packing"]
    for _, got, gave in chain[0][:-1]:
        assert gave[0].asDict().keys() == got[0].asDict().keys()


def test_toxic_documents_go(chain):
    (_, got, gave), toxic, first = chain[0][0], chain[1], chain[3]
    assert not whole(gave) - whole(got)
    kept = {r.doc_id for r in gave}
    planted = [r.doc_id for r in got if r.source == "planted"]
    clean = [r.doc_id for r in got if r.doc_id not in toxic and r.source != "planted" and r.doc_id is not None and r.doc_id < first]
    assert len(planted) > 5 and sum(i in kept for i in planted) <= 0.4 * len(planted)
    assert sum(i not in kept for i in clean) <= 0.05 * len(clean)


def test_one_of_each_text_stays(chain):
    _, got, gave = chain[0][1]
    best = {}
    for r in got:
        key = r.text or ""
        best[key] = max(best.get(key, -1), -1 if r.doc_id is None else r.doc_id)
    assert whole(gave) == whole([r for r in got if (-1 if r.doc_id is None else r.doc_id) == best[r.text or ""]])
    assert len(gave) <= len(got) - 10


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    bits = np.zeros(64, np.int64)
    for h in np.array([xxhash.xxh64_intdigest(p.encode(), 42) for p in parts], np.uint64):
        bits += (h >> np.arange(64, dtype=np.uint64)) & np.uint64(1) == 1
    return int(sum(1 << b for b in range(64) if 2 * bits[b] > len(parts)))


def test_one_of_each_near_group_stays(chain):
    (_, got, gave), longest = chain[0][2], chain[2]
    prints = np.array([fingerprint(r.text) for r in got], np.uint64)
    group = list(range(len(got)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(got)):
        near = np.flatnonzero(np.bitwise_count(prints[i + 1 :] ^ prints[i]) <= 4) + i + 1
        for j in near.tolist():
            group[root(j)] = root(i)
    members = collections.defaultdict(list)
    for i, r in enumerate(got):
        members[root(i)].append(r)
    left = whole(gave)
    assert not left - whole(got) and sum(left.values()) == len(members) < len(got)
    for rows in members.values():
        assert sum(left[tuple(r)] for r in set(rows)) == 1


def test_the_mix(chain):
    _, got, gave = chain[0][3]
    size = {tuple(r): len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in got}
    by_source, largest, taken = (collections.Counter() for _ in range(3))
    for r in got:
        by_source[r.source] += size[tuple(r)]
        largest[r.source] = max(largest[r.source], size[tuple(r)])
    copies = whole(gave)
    assert not set(copies) - set(size) and max(copies.values()) <= 2
    for r, n in copies.items():
        taken[r[3]] += n * size[r]
    for source, target in filled(by_source).items():
        assert abs(taken[source] - target) <= max(1, largest[source])


def test_the_pieces(chain):
    _, got, gave = chain[0][4]
    encoder = tokenizers.Tokenizer.from_file(tokens.public_tokenizer())
    want, found, sequences = collections.Counter(), collections.Counter(), set()
    for r in got:
        want[r.doc_id, tuple(encoder.encode(r.text or "", add_special_tokens=False).ids + [2])] += 1
    pieces = collections.defaultdict(list)
    for p in gave:
        assert p.offset == 0 and p.length <= 4096 and p.length & (p.length - 1) == 0 and len(p.ids) == 4 * p.length
        assert p.sequence_id not in sequences
        sequences.add(p.sequence_id)
        pieces[p.doc_id].append(p)
    for doc_id, parts in pieces.items():
        copies = collections.Counter((p.start, p.ids, p.doc_tokens) for p in parts)
        while copies:
            at, ids = 0, []
            while not ids or at < total:
                key = next(k for k in copies if k[0] == at and (not ids or k[2] == total))
                total = key[2]
                ids += np.frombuffer(key[1], "<u4").tolist()
                at = len(ids)
                copies -= collections.Counter([key])
            found[doc_id, tuple(ids)] += 1
    assert found == want


def test_run_gives_pieces_of_kept_documents(spark):
    pieces = corpus_pipeline.run(spark, SF_DIR)
    assert pieces.columns[:4] == ["doc_id", "start", "length", "ids"] and pieces.count() > 0


def test_empty_tables(spark):
    now = Tables(spark, SF_DIR).documents.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        path = work_path(spark, f"none-{name}")
        stage(spark, now, SF_DIR).write.parquet(path)
        now = spark.read.parquet(path)
        assert now.count() == 0
