"""The splitter over many tasks against the splitter in one."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docstrata.operators import chunking, long_texts

WORDS = ["a", "bb", "ccc", " ", " ", " ", " ", "\n", "\n\n", "\t", ".", "\xa0", "é🙂"]


def texts(rng, n, length):
    return ["".join(rng.choice(WORDS, rng.integers(0, length))) for _ in range(n)]


@pytest.mark.parametrize("separators", [chunking.SEPARATORS, (".", "\n"), (" ", ""), ("zz",), ("\n\n", "bb", " ")])
def test_pieces_of_cells_equal_those_of_whole_texts(separators):
    """Cuts decided cell by cell, with what cells know of one another, are those that a cell as long as the text decides."""
    rng = np.random.default_rng(3)
    for text in texts(rng, 60, 120):
        if not text:
            continue
        for size in (1, 2, 5):
            c = long_texts.Cell(0, text, None, None, separators)
            top = next((j for j, s in enumerate(separators) if s in text), len(separators))
            at, n = c.pieces(top, [0] * len(separators), [0] * len(separators), size)
            whole = [text[a:b] for a, b in zip(at, [*at[1:], len(text)], strict=True)]
            assert "".join(whole) == text and n.tolist() == [len(p.split()) for p in whole]


def run(spark, rows, size, overlap, separators=chunking.SEPARATORS, grid=7, block=1):
    df = spark.createDataFrame(rows, "doc_id long, part long, text string").withColumn("key", F.lit(1)).withColumn("cell", F.lit("x"))
    found = {}
    for r in long_texts.split_distributed(df, size, overlap, separators=separators, grid=grid, block=block).collect():
        found.setdefault(r.doc_id, []).append((r.chunk_idx, r.chunk, r.n_tokens))
    return {d: sorted(x) for d, x in found.items()}


def wanted(rows, size, overlap, separators=chunking.SEPARATORS):
    by = {}
    for d, p, t in rows:
        by.setdefault(d, []).append((p, t or ""))
    split = {d: chunking.split_text("".join(t for _, t in sorted(x)), size, overlap, separators) for d, x in by.items()}
    return {d: [(i, c, len(c.split())) for i, c in enumerate(x)] for d, x in split.items() if x}


@pytest.mark.parametrize(("size", "overlap", "separators"), [(3, 0, chunking.SEPARATORS), (5, 2, chunking.SEPARATORS), (9, 4, ("\n\n", ".", " ")), (4, 3, (" ", "")), (2, 1, ("zz",))])
def test_equals_the_splitter(spark, monkeypatch, size, overlap, separators):
    monkeypatch.setattr(long_texts, "FAN_IN", 3)
    rng = np.random.default_rng(size)
    rows = []
    for d, t in enumerate([*texts(rng, 40, 400), "", "   \n\n ", "\n" * 90, "word" * 60, "one two"]):
        at = 0
        while at < len(t) or at == 0:
            n = int(rng.integers(0, 40))
            rows.append((d if d else None, len(rows), t[at : at + n]))
            at += max(n, 1) if n else 0
            if not t:
                break
    rows += [(500, 0, None), (501, 3, "last words"), (501, 1, "first words "), (501, 2, "")]
    assert run(spark, rows, size, overlap, separators) == wanted(rows, size, overlap, separators)


def test_empty_table(spark):
    assert run(spark, [], 5, 1) == {} and run(spark, [(1, 0, None)], 5, 1) == {}
    with pytest.raises(ValueError):
        run(spark, [], 5, 5)


def test_production_parameters(spark):
    """A text of many cells and blocks; slices of any size give the same chunks."""
    rng = np.random.default_rng(9)
    text = "".join(rng.choice(["the ", "longer words ", "of ", "one.\n", "a\n\n", "x" * 30 + " "], 700_000))
    docs = spark.createDataFrame([(7, text), (8, "short one"), (9, None)], "doc_id long, text string")
    slices = long_texts.text_slices(docs, chars=300_000)
    found = {}
    for r in long_texts.split_distributed(slices, 1024, 100).collect():
        found.setdefault(r.doc_id, {})[r.chunk_idx] = (r.chunk, r.n_tokens)
    split = chunking.split_text(text, 1024, 100)
    assert len(text) > 5 * long_texts.GRID and [found[7][i][0] for i in range(len(found[7]))] == split and found[8] == {0: ("short one", 2)} and set(found) == {7, 8}


def test_texts_of_any_length(spark):
    """Long and short texts in one table, also under one key."""
    rng = np.random.default_rng(10)
    rows = [(i % 9, t) for i, t in enumerate(texts(rng, 30, 300))] + [(3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(map(tuple, long_texts.chunks_of_any_length(docs, 5, 2, longer_than=150, grid=40).collect()))
    assert found == sorted((d, i, c, len(c.split())) for d, t in rows for i, c in enumerate(chunking.split_text(t or "", 5, 2)))
    assert sum(len(t or "") > 150 for _, t in rows) > 5


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=40), st.integers(1, 8), st.integers(0, 7))
def test_next_chunks_follow_the_packing(n, size, overlap):
    """Where chunks begin, by jumps from piece to piece, against packing one piece after the other."""
    overlap = min(overlap, size - 1)
    held, total, begins = [], 0, []
    for i, x in enumerate(n):
        if held and total + x > size:
            begins.append((held[0], i))
            while held and (total > overlap or total + x > size):
                total -= n[held.pop(0)]
        held.append(i)
        total += x
    begins.append((held[0], len(n)))
    m = np.array(n)
    full, after = long_texts.next_chunks(np.arange(len(n)), np.cumsum(m) - m, m, len(n), size, overlap)
    now, found = 0, []
    while now >= 0:
        found.append((now, int(full[now])))
        now = int(after[now])
    assert found == begins
    assert long_texts.followed(after, 0, len(n)).tolist() == [-1] * len(n)
