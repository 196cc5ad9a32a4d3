"""Near-duplicates against all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest
from compare import DATA, compare
from pyspark.sql import functions as F

from docstrata.llm import minhash
from docstrata.llm.queries import ORACLES


def shingles(text, words):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({i: " " for i in range(9, 14)}).split(" ")
    w = [x for x in w if x]
    if len(w) < words:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)}


def brute(rows, words, percent=80):
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, []).append(shingles(t, words))
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                ra, rb = sorted((root(a), root(b)))
                parent[rb] = ra
    return {i: root(i) for i in ids}


def check(spark, documents, rows, words, **more):
    found = minhash.near_duplicates(documents(rows, **more), words=words).collect()
    wanted = brute(rows, words)
    assert len(found) == len(rows)
    for r in found:
        assert r.component_id == wanted.get(r.doc_id)
        assert r.kept == (r.doc_id is None or r.component_id == r.doc_id)
    return found


def corpus(seed, n, words):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.choice((1, 3, 8, 40, 120)))] for _ in range(6)]
    rows = []
    for i in range(n):
        text = list(rng.choice(bases))
        for _ in range(rng.choice((0, 0, 1, 2, 4, 6))):
            text[rng.randrange(len(text))] = rng.choice(vocabulary)
        rows.append((i, rng.choice((" ", "\n", "\t ")).join(text)))
    return rows


@pytest.mark.parametrize("words", [2, 5])
def test_against_all_pairs(spark, documents, words):
    check(spark, documents, corpus(words, 150, words), words)


def test_edges(spark, documents):
    long = " ".join(f"x{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "one  two"), (8, "ſ one"), (9, long), (10, long + " y"), (4, "one"), (None, "one"), (12, "É a b"), (13, "é a b")]
    found = check(spark, documents, rows, 2, component_id=F.lit("clash"), keys=F.lit(1))
    assert {r.n_shingles for r in found if r.doc_id in (1, 2, 3)} == {0}


def test_empty(spark, documents):
    assert minhash.near_duplicates(documents([]), words=2).collect() == []


def test_chain_of_near_copies(spark, documents):
    """A long chain, each near to the next only, is one component."""
    words = [f"v{i}" for i in range(260)]
    rows = [(100 + i, " ".join(words[4 * i : 4 * i + 100])) for i in range(40)]
    assert {r.component_id for r in minhash.near_duplicates(documents(rows), words=2).collect()} == {100}


def test_one_of_each_group_stays(spark, documents):
    rows = [(3, "a b c d e f"), (1, "a b c d e f"), (2, "other words in here now"), (1, "a b c d e f"), (None, "a b c d e f")]
    kept = minhash.deduplicated(documents(rows)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == [(0, "a b c d e f"), (1, "a b c d e f"), (2, "other words in here now")]


def test_texts_of_one_id_stay(spark, documents):
    """Rows that share an id and not a text are other documents; of repeated ones the smallest by the other columns stays."""
    rows = [(1, "a b c d e f g"), (1, "totally different words in this one"), (1, None), (2, "a b c d e f g"), (2, "some more text of its own")]
    docs = documents(rows).unionByName(documents(rows).withColumn("source", F.lit("r")))
    kept = minhash.deduplicated(docs.repartition(5)).collect()
    assert sorted((r.doc_id, r.text or "", r.source) for r in kept) == [(1, "", "r"), (1, "a b c d e f g", "r"), (1, "totally different words in this one", "r")]
    assert kept[0].__fields__ == docs.columns


def test_ids_with_several_texts(spark, documents):
    """Such an id is one node with all of its words, and meets whatever shares a bucket with one of its texts."""
    rng = random.Random(9)
    rows = corpus(9, 60, 2)
    rows += [(i, rows[rng.randrange(60)][1]) for i in range(0, 60, 7)]
    check(spark, documents, rows, 2)


def test_template_with_frequent_additions(spark, documents):
    """A family near the threshold, with additions that many members share: pairs meet beyond the hub, none is lost."""
    rng = random.Random(11)
    base = [f"t{i}" for i in range(60)]
    extra = [[f"x{k}{i}" for i in range(12)] for k in range(3)]
    rows = [(i, " ".join(base + (extra[i % 4] if i % 4 < 3 else []) + [f"own{i}_{j}" for j in range(rng.randint(0, 14))])) for i in range(160)]
    check(spark, documents, rows, 2)


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(3)
    common, a, b = rng.integers(1 << 62, size=800), rng.integers(1 << 62, size=100), rng.integers(1 << 62, size=100)
    flat = np.concatenate([np.unique(np.append(common, x)) for x in (a, b)]).astype(np.uint64)
    s = minhash.sketches(flat, np.array([0, 900, 1800]), 252)
    assert (s != minhash.EMPTY).all()
    assert abs((s[0] == s[1]).mean() - 0.8) < 0.12


def test_words_that_polynomial_hashes_confuse(spark, documents):
    t = "".join("ab"[i.bit_count() % 2] for i in range(2048))
    u = t.translate(str.maketrans("ab", "ba"))
    found = check(spark, documents, [(1, t), (2, u), (3, f"{t} x"), (4, f"{u} x"), (5, t[:1024]), (6, u[:1024])], 2)
    assert all(r.kept for r in found)


def test_small_sets_fill():
    s = minhash.sketches(np.array([5, 5, 9], np.uint64), np.array([0, 1, 1, 3]), 64)
    assert (s[0] != minhash.EMPTY).all() and (s[1] == minhash.EMPTY).all() and (s[2] != minhash.EMPTY).all()


def test_query(spark):
    from docstrata.llm.minhash import op2_minhash

    assert compare(spark, "op2_minhash", op2_minhash, ORACLES["op2_minhash"], str(DATA / "sf0.001")) == ""
