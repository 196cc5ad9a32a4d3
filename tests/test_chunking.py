from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docstrata.operators import chunking as C


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n", max_size=200), st.integers(2, 20), st.integers(0, 10))
def test_splitter_invariants(text, size, overlap):
    if overlap >= size:
        with pytest.raises(ValueError):
            C.split_text(text, size, overlap)
        return
    chunks = C.split_text(text, size, overlap, length=len)
    assert all(0 < len(c) <= size and c == c.strip() for c in chunks)
    at = 0
    for c in chunks:  # in order
        at = text.index(c, at)
    if not overlap:
        assert "".join("".join(chunks).split()) == "".join(text.split())


def test_cases():
    assert C.split_text("a b c d e", 2, 0) == ["a b", "c d", "e"]
    assert C.split_text("a b c d", 2, 1) == ["a b", "b c", "c d"]
    assert C.split_text("one two\n\nthree four", 2, 0) == ["one two", "three four"]
    assert C.split_text("abcdef", 4, 2, ("",), len) == ["abcd", "cdef"]
    assert C.split_text("", 4, 0) == []
    assert C.split_text("uncuttable", 3, 0, ("\n",), len) == ["uncuttable"]


def test_windows_equal_the_splitter(spark):
    rows = [(i, "x" * 0 + "".join(chr(97 + (i * 7 + j) % 26) for j in range(i))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {}
    for r in C.character_windows(df, 10, 3).orderBy("doc_id", "chunk_idx").collect():
        found.setdefault(r.doc_id, []).append(r.chunk)
    assert found == {i: C.split_text(t, 10, 3, ("",), len) for i, t in rows if t}


def test_blank_texts_have_no_chunks(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "\xa0 \n"), (4, "a")], "doc_id long, text string")
    assert [(r.doc_id, r.chunk, r.n_tokens) for r in C.recursive_chunks(df, 5, 1).collect()] == [(4, "a", 1)]


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_numbers_run_through(spark, parts):
    df = spark.createDataFrame([(f"f{i % 13}", i // 13) for i in range(130)], "source_file string, chunk_idx int").repartition(parts)
    found = sorted((r.source_file, r.chunk_idx, r.chunk_number) for r in C.numbered(df).collect())
    assert [n for *_, n in found] == list(range(130))


def test_table_function(spark):
    C.register_split_text(spark)
    found = spark.sql("SELECT * FROM VALUES ('a b c'), (NULL) t(x), LATERAL split_text(x, 2, 0)").collect()
    assert [(r.chunk_idx, r.chunk) for r in found] == [(0, "a b"), (1, "c")]


def test_numbers_over_ranges_of_files(spark, monkeypatch):
    """Files in many ranges, with a common prefix; names that are numbers are ordered as strings."""
    monkeypatch.setattr(C, "ADDED_TOGETHER", 7)
    rows = [(i, k) for i in range(60) for k in range(i % 4 + 1)]
    found = C.numbered(spark.createDataFrame(rows, "source_file int, chunk_idx int")).collect()
    order = sorted(rows, key=lambda r: (str(r[0]), r[1]))
    assert {(r.source_file, r.chunk_idx): r.chunk_number for r in found} == {r: n for n, r in enumerate(order)}
