"""Corpora of many documents in few files."""

from __future__ import annotations

import pytest
from compare import DATA, compare

from docstrata import queries_files
from docstrata.queries import ORACLES, QUERIES
from docstrata.sources import readers, writers


@pytest.mark.parametrize("name", ["json_documents", "unreadable_files", "markdown_files", "flat_files"])
def test_files_do_not_grow_with_the_documents(spark, tmp_path, monkeypatch, name):
    """200 documents: a file for each of them would be 200 files."""
    monkeypatch.setattr(queries_files, "new_folder", lambda spark, name: str(tmp_path / name))
    assert compare(spark, name, QUERIES[name], ORACLES[name], str(DATA / "sf0.001")) == ""
    assert 0 < len(list(tmp_path.rglob("part-*"))) < 40


def test_packed_texts_come_back_as_they_were(spark, tmp_path):
    rows = [("a.md", "x\n\ny\r\n"), ("b.md", ""), ("c.md", None), ("d.md", '  "é" \x00')]
    writers.write_packed(spark.createDataFrame(rows, "file_name string, value string"), str(tmp_path / "p"))
    assert sorted(tuple(r) for r in readers.read_packed(spark, str(tmp_path / "p")).collect()) == rows


def test_documents_by_line_equal_those_of_single_files(spark, tmp_path):
    texts = ['{"document_name":"a","content":[{"title":"t","subsections":[{"title":"u","chunks":["c"]}]}]}', '{"document_name":"b","content":[]}', '{"document_name":"c","content":[']
    for d in ("one", "each"):
        (tmp_path / d).mkdir()
    (tmp_path / "one" / "all.json").write_text("\n".join(texts))
    for i, t in enumerate(texts):
        (tmp_path / "each" / f"{i}.json").write_text(t)
    by_line, single = (readers.read_documents(spark, str(tmp_path / d), lines=x).drop("file_path").collect() for d, x in (("one", True), ("each", False)))
    assert sorted(by_line, key=repr) == sorted(single, key=repr) and len(by_line) == 3


def test_flat_lines_equal_single_flat_files(spark, tmp_path):
    chunks = spark.createDataFrame([("a", 0, "x", [1.0]), ("a", 1, "y", None), ("b", 0, "z", [2.0])], "source_file string, chunk_idx int, content string, embedding array<float>")
    found = []
    for lines in (True, False):
        writers.write_flat(chunks, str(tmp_path / str(lines)), lines=lines)
        found.append(sorted(tuple(r) for r in readers.read_flat_embedded(spark, str(tmp_path / str(lines)), lines).collect()))
    assert found[0] == found[1] == [("a", 0, "x", [1.0]), ("b", 0, "z", [2.0])]
