"""DOCX and document JSON as streams, and DOCX without the bytes of images."""

from __future__ import annotations

import json

import pyarrow as pa
import pytest
from test_structure import docx_file

from docstrata.sources import docx, readers

PARAGRAPH = '<w:p><w:r><w:t>{}</w:t><a:blip r:embed="r1"/></w:r></w:p>'


def drain(spark, rows, at):
    rows.writeStream.format("parquet").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start(f"{at}/out").awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{at}/out")


def write_docx(folder, name, text):
    (folder / f"{name}.docx").write_bytes(docx_file(PARAGRAPH.format(text), ["word/media/i.png"]))


def plain(rows):
    return sorted((r.asDict(True) for r in rows.collect()), key=repr)


@pytest.mark.parametrize("batch_bytes", [1, 1 << 30])
def test_docx_stream_equals_the_reader_and_reads_new_files_once(spark, tmp_path, batch_bytes):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(3):
        write_docx(folder, f"d{i}", f"text {i}")
    (folder / "bad.docx").write_bytes(b"no zip")
    (folder / "empty.docx").write_bytes(b"")
    (folder / "other.txt").write_bytes(b"not ours")
    first = drain(spark, docx.stream_docx(spark, str(folder), batch_bytes=batch_bytes), tmp_path)
    assert plain(first) == plain(docx.read_docx(spark, str(folder))) and first.count() == 4  # Spark reads no files of no bytes
    assert [r.doc_name for r in first.where("kind = 'unreadable'").collect()] == ["bad"]
    write_docx(folder, "late", "text")
    again = drain(spark, docx.stream_docx(spark, str(folder), batch_bytes=batch_bytes), tmp_path)
    assert again.count() == 5 and plain(again) == plain(docx.read_docx(spark, str(folder)))


def test_docx_without_images(spark, tmp_path):
    write_docx(tmp_path, "a", "x")
    with_bytes, without = (docx.read_docx(spark, str(tmp_path), images=i).first() for i in (True, False))
    assert [(i.ext, i.bytes) for i in without.images] == [("png", None)] and bytes(with_bytes.images[0].bytes) == b"png"
    assert without.text == with_bytes.text == "x"


def test_null_and_empty_contents_are_unreadable(spark):
    found = docx.docx_blocks(spark.createDataFrame([("a", None), ("b", b"")], "doc_name string, content binary")).collect()
    assert sorted((r.doc_name, r.kind) for r in found) == [("a", "unreadable"), ("b", "unreadable")]


def test_document_stream_equals_the_reader(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(3):
        (folder / f"{i}.json").write_text(json.dumps({"document_name": f"n{i}", "content": [{"title": "t", "description": "d"}], "extra": 1}))
    (folder / "cut.json").write_text('{"document_name": "n')
    (folder / "none.json").write_text("")
    found = drain(spark, readers.stream_documents(spark, str(folder)), tmp_path)
    assert plain(found) == plain(readers.read_documents(spark, str(folder)))
    good, bad = readers.split_unreadable(found)
    assert good.where("document_name IS NOT NULL").count() == 3 and bad.count() >= 1


def test_blocks_of_many_files_leave_together(spark, monkeypatch):
    """A batch for each file made the conversion the greatest part of the work."""
    made = []
    monkeypatch.setattr(docx, "as_batch", lambda rows, f=docx.as_batch: made.append(len(rows)) or f(rows))
    content = docx_file(PARAGRAPH.format("x"), ["word/media/i.png"])
    batch = pa.RecordBatch.from_pydict({"doc_name": [f"d{i}" for i in range(50)], "content": [content] * 50})
    for size, n in ((docx.OUT_BYTES, 1), (1, 50)):
        monkeypatch.setattr(docx, "OUT_BYTES", size)
        made.clear()
        assert sum(b.num_rows for b in docx.parsed([batch, batch], True)) == 100 and len(made) == n * (1 if n == 1 else 2)
