"""Pivot partitioning against counting every phrase."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import DATA, compare
from pyspark.sql import functions as F

from docstrata.llm import collocations as C


def brute(rows, least, longest=5, first=2000):
    f = defaultdict(Counter)
    for text, lang in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = [x for x in re.split("[ \t]+", piece) if x]
            for k in range(1, longest + 1):
                f["und" if lang is None else lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        n = sum(a for g, a in counts.items() if len(g) == 1)
        frequent = {g: a for g, a in counts.items() if len(g) > 1 and a >= least}
        inside = defaultdict(int)
        for g, a in frequent.items():
            for i in range(len(g)):
                for j in range(i + 1, len(g) + 1):
                    if j - i < len(g):
                        inside[g[i:j]] = max(inside[g[i:j]], a)
        scored = []
        for g, a in frequent.items():
            if 100 * inside[g] < 100 * a:
                score, k = min((1000 * a * n // (counts[g[:k]] * counts[g[k:]]), k) for k in range(1, len(g)))
                scored.append((-score, -a, " ".join(g).encode(), " ".join(g), a, counts[g[:k]], counts[g[k:]], n, score))
        out += [(lang, r + 1, *x[3:]) for r, x in enumerate(sorted(scored)[:first])]
    return sorted(out)


def mine(spark, rows, least, first=2000, **more):
    df = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string")
    return sorted(map(tuple, C.collocations(df.withColumns(more) if more else df, least, first=first).collect()))


def random_texts(rng, n, words, p):
    return [("".join(w + s for w, s in zip(rng.choice(words, 60, p=p), rng.choice([" ", "  ", "\t", ". ", "\n", ",", " \r\n", "? "], 60, p=[0.7, 0.05, 0.05, 0.05, 0.04, 0.04, 0.03, 0.04]), strict=True)), lang) for lang in rng.choice(["en", "de", "und", ""], n).tolist()]


@pytest.mark.parametrize("kind", ["zipf", "few words", "passages"])
def test_equals_counting_all(spark, kind):
    rng = np.random.default_rng(4)
    words = np.array(["the", "The", "of", "a", "é", "É", "new", "york", "data-set", "x", " wide", "🙂", "'s", "--", "zero", "ß", "end", "on", "it", "b"])
    weights = 1 / np.arange(1, len(words) + 1)
    if kind == "few words":
        words, weights = words[:3], np.ones(3)
    rows = random_texts(rng, 60, words, weights / weights.sum())
    if kind == "passages":  # of one text, often, and within others
        rows += [("Der the of a new york x x x x x x x", "en")] * 40 + [("zero of a new york x", None)] * 30
    rows += [(None, "en"), ("", None), ("   ", "de"), ("one two three", None), ("a b c", "only")]
    assert mine(spark, rows, 8, doc=F.lit(1), word=F.lit("clash"), batch=F.lit(2), WORDS_=F.lit(0), n=F.lit(3)) == brute(rows, 8)


def test_first_and_ties(spark):
    rows = [("b c. a b. c d. d e. e f", "en")] * 5 + [("a", "en"), ("q", "en")]
    found = mine(spark, rows, 5, first=3)
    assert found == brute(rows, 5, first=3) and len(found) == 3


def test_hot_pivots_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(C, "HOT", 3)
    rng = np.random.default_rng(5)
    rows = random_texts(rng, 50, np.array(list("abcdef")), np.ones(6) / 6)
    assert mine(spark, rows, 6) == brute(rows, 6)


def test_long_texts_are_cut_between_pieces(monkeypatch):
    monkeypatch.setattr(C, "PART_BYTES", 10)
    text = b"one two three\nfour\n\nfive six seven eight nine ten eleven\na"
    found = list(C.parts(text))
    assert b"".join(found) == text and len(found) > 2 and all(p.startswith(b"\n") for p in found[1:])
    assert list(C.parts(b"x" * 50)) == [b"x" * 50] and list(C.parts(b"")) == [b""]


def test_each_ngram_is_in_one_fragment():
    rng = np.random.default_rng(6)
    for v in (1, 2, 5, 40):
        rank = rng.integers(-1, v, 400)
        words, sizes, ats, counts = C.fragments_of(rank, 5)
        found, a = Counter(), 0
        for size, at, n in zip(sizes.tolist(), ats.tolist(), counts.tolist(), strict=True):
            w, a = words[a : a + size].tolist(), a + size
            for i in range(at + 1):
                for j in range(max(at + 1, i + 2), min(size, i + 5) + 1):
                    assert min(w[i:j]) == w[at]
                    found[tuple(w[i:j])] += n
        assert found == Counter(tuple(rank[i : i + k].tolist()) for k in range(2, 6) for i in range(len(rank) - k + 1) if (rank[i : i + k] >= 0).all())


def test_grams_grow_from_frequent_ones():
    """Counts of all n-grams of the fragments of a text, pivot by pivot, above a threshold."""
    rng = np.random.default_rng(7)
    for v, least in ((2, 1), (5, 1), (5, 4), (30, 3)):
        rank = rng.integers(-1, v, 600)
        words, size, at, n = C.fragments_of(rank, 5)
        start = np.cumsum(size) - size
        order = np.argsort(words[start + at], kind="stable")
        found = {}
        for grams, a, _ in C.count_grams(words, start[order], size[order], at[order], n[order], np.full(len(n), least), 5):
            found |= {tuple(g): x for g, x in zip(grams.tolist(), a.tolist(), strict=True)}
        counts = Counter(tuple(rank[i : i + k].tolist()) for k in range(2, 6) for i in range(len(rank) - k + 1) if (rank[i : i + k] >= 0).all())
        assert found == {g: a for g, a in counts.items() if a >= least}


def test_only_frequent_pairs_are_moved(spark, monkeypatch):
    """Words that are all frequent, side by side with others each time, but for one passage: the rest does not reach the shuffle of fragments."""
    rng = np.random.default_rng(8)
    rows = [(" ".join(f"w{x}" for x in rng.permutation(300)), "en") for _ in range(20)] + [("w1 w2 w3. w7", "en")] * 15
    moved, mined = [], C.mined
    monkeypatch.setattr(C, "mined", lambda found, *more: moved.append(found.agg(F.count("*"), F.sum("n")).first()) or mined(found, *more))
    assert mine(spark, rows, 15) == brute(rows, 15) != []
    assert moved[0][0] <= 8 and moved[0][1] >= 15


def test_rows_moved_are_bounded_by_batches_and_parts(spark, monkeypatch):
    """However many fragments and words a batch has, it sends a row for each part; the result is the same."""
    monkeypatch.setattr(C, "PARTS", 3)
    rng = np.random.default_rng(9)
    rows = random_texts(rng, 80, np.array([f"w{x}" for x in range(12)]), np.ones(12) / 12)
    moved, mined = [], C.mined
    monkeypatch.setattr(C, "mined", lambda found, *more: moved.append(found.count()) or mined(found, *more))
    monkeypatch.setattr(C, "TOGETHER", 50)
    assert mine(spark, rows, 4) == brute(rows, 4) != []
    batches = C.coded(spark.createDataFrame(rows, "text string, lang string"), "text", "lang").count()
    assert 0 < moved[0] <= 3 * batches


def test_packed():
    for x in ([], [0], [2**32 - 1, 0, 7, 7], range(100_000)):
        assert C.unpacked(C.packed(np.array(x, np.int64))).tolist() == list(x)
    for x in ([], [b"a"], ["é".encode(), b"\xff", b"--"]):
        assert C.unpacked_words(C.packed_words(x)) == x


def test_empty_table(spark):
    assert mine(spark, [], 1) == [] and mine(spark, [(None, None)], 1) == []


def test_query(spark):
    for size in ("sf0.001", "sf0.01"):
        assert compare(spark, "op13", C.op13_collocations, C.OP13_SQL, str(DATA / size)) == ""
