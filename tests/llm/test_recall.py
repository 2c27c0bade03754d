"""Share of the ten nearest vectors that stand in the lists searched, by brute force, where the caps bind."""

import numpy as np
import pytest

from tidegate.llm import ann


def recall(x, queries, most, within):
    """Of the true neighbours' lists and the queries' lists as the operator chooses them; also the number of centroids."""
    draw = np.random.default_rng(1)
    sample = x[draw.random(len(x)) < min(1, ann.SAMPLE_ROWS / len(x))].astype(float)
    centroids = ann.balanced_centroids(sample, int(max(1, min(ann.MOST_CENTROIDS, len(x) // ann.LIST_ROWS, len(sample) // 4))))
    graph = ann.CentroidGraph(centroids)
    norms, best = (x**2).sum(1), []
    for at in range(0, len(queries), 64):
        q = queries[at : at + 64]
        squares = norms[None] - 2 * x[q] @ x.T
        squares[np.arange(len(q)), q] = np.inf
        best.append(np.argpartition(squares, 10, axis=1)[:, :10])
    lists, squares = graph.nearest(x[np.concatenate(best).ravel()].astype(float), ann.REPLICAS)
    placed = squares <= squares[:, :1] * ann.WITHIN**2
    found, squares = graph.nearest(x[queries].astype(float), most)
    searched = [set(a[u].tolist()) for a, u in zip(found, squares <= squares[:, :1] * within**2)]
    return len(centroids), float(np.mean([bool(searched[i // 10] & set(l[p].tolist())) for i, (l, p) in enumerate(zip(lists, placed))]))


@pytest.mark.parametrize("n", [120_000, 819_200])
def test_recall_without_any_clusters(n):
    x = np.random.default_rng(0).standard_normal((n, 64)).astype(np.float32)
    lists, share = recall(x, np.arange(0, n, n // 100)[:100], ann.SEARCH_LISTS, ann.SEARCH_WITHIN)
    print(n, lists, share)
    assert lists >= min(ann.MOST_CENTROIDS, n // ann.LIST_ROWS) * 0.8 and share >= 0.9
