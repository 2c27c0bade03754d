"""A query in a small group far from all others still gets as many neighbours as were asked for."""

import collections

import numpy as np
import pytest

from tidegate.llm import ann


@pytest.mark.parametrize("most_lists", [48, 1])
def test_far_groups(spark, most_lists):
    draw = np.random.default_rng(3)
    x = draw.standard_normal((4000, 8))
    x[[100, 101, 102, 103, 104]] = 1e4 + 1e-3 * draw.standard_normal((5, 8))  # a tight group
    x[200] = -1e5  # one alone
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = collections.defaultdict(list)
    for r in ann.search(df, every=100, k=10, most_lists=most_lists).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, 4000, 100))
    for q, found in got.items():
        assert [r for r, _, _ in sorted(found)] == list(range(1, 11)), q
        assert len({i for _, i, _ in found}) == 10 and q not in {i for _, i, _ in found}
    assert {i for r, i, _ in got[100] if r <= 4} == {101, 102, 103, 104}
    if most_lists == 48:
        for q in (100, 200):
            d = np.sqrt(((x - x[q]) ** 2).sum(1))
            best = [i for i in np.argsort(d, kind="stable").tolist() if i != q][:10]
            assert len(set(best) & {i for _, i, _ in got[q]}) >= 9, q
