"""The inverted index against comparing everything."""

from __future__ import annotations

import numpy as np
import pytest

from docstrata.operators import overlap_index


def brute(texts, asked, k):
    words = {}
    for i, t in texts:
        words.setdefault(i, set()).update((t or "").lower().split())
    out = {}
    for q, t in asked:
        own = set((t or "").lower().split())
        scored = sorted((-round(len(own & w) / len(own | w), 9) if own | w else 0.0, i) for i, w in words.items())
        out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def run(spark, texts, asked, k):
    index = overlap_index.build(spark.createDataFrame(texts, "id long, content string"))
    hits, counts = overlap_index.search(index, spark.createDataFrame(asked, "query_id long, question string"), k)
    out = {}
    for r in hits.collect():
        out.setdefault(r.query_id, []).append((-round(r.overlap, 9), r.id))
    return {q: [(i, -s) for s, i in sorted(x)] for q, x in out.items()}, {r.query_id: (r["read"], r.postings) for r in counts.collect()}


@pytest.mark.parametrize("k", [1, 5, 40])
def test_equals_comparing_everything(spark, k):
    rng = np.random.default_rng(k)
    weights = 1 / np.arange(1, 201)
    draw = lambda n: " ".join(rng.choice([f"w{i}" for i in range(200)], n, p=weights / weights.sum()))
    texts = [(i, draw(int(rng.integers(0, 60)))) for i in range(300)] + [(7, draw(5)), (900, None), (901, ""), (902, "W1 w1")]
    asked = [(q, draw(int(rng.integers(1, 25)))) for q in range(12)] + [(50, "nowhere found"), (51, None), (52, "w199 nowhere")]
    found, counts = run(spark, texts, asked, k)
    assert found == brute(texts, asked, k)
    assert all(r <= p for r, p in counts.values())


def test_frequent_words_are_not_read(spark):
    """Once enough texts share a query's rare words, the postings of its frequent ones are left."""
    texts = [(i, f"the of and {'rare words here too' if i < 10 else f'other{i} more{i} text{i}'}") for i in range(800)]
    found, counts = run(spark, texts, [(1, "the rare words here too")], 3)
    assert found == brute(texts, [(1, "the rare words here too")], 3)
    assert counts[1][0] <= 40 < 800 < counts[1][1]


def test_empty(spark):
    assert run(spark, [], [(1, "a")], 3) == ({}, {1: (0, 0)})
    assert run(spark, [(1, "a")], [], 3) == ({}, {})
