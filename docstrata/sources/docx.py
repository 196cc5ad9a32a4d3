"""DOCX files as rows of blocks."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docstrata.functions import text as X

#: Name spaces of the format.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
BLOCKS = "doc_name string, pos int, kind string, style string, text string, images array<struct<ext string, bytes binary>>, cells array<array<struct<text string, span string>>>"
ARROW = pa.schema([
    ("doc_name", pa.string()), ("pos", pa.int32()), ("kind", pa.string()), ("style", pa.string()), ("text", pa.string()),
    ("images", pa.list_(pa.struct([("ext", pa.string()), ("bytes", pa.binary())]))), ("cells", pa.list_(pa.list_(pa.struct([("text", pa.string()), ("span", pa.string())])))),
])
#: Blocks leave a task in batches of about so many bytes, with as many for a row or cell besides its text.
OUT_BYTES, ROW_BYTES = 8 << 20, 100


def text_of(element: ElementTree.Element) -> str:
    marks = {f"{W}tab": "\t", f"{W}br": "\n"}
    return "".join(e.text or "" if e.tag == f"{W}t" else marks.get(e.tag, "") for e in element.iter())


def cells_of(table: ElementTree.Element) -> list[list[tuple[str, str | None]]]:
    """Cells of a table with their spans: a cell over several columns is repeated as "right", a continued one is "down"."""
    out = []
    for row in table.iterfind(f"{W}tr"):
        cells: list[tuple[str, str | None]] = []
        for cell in row.iterfind(f"{W}tc"):
            wide, tall = cell.find(f"{W}tcPr/{W}gridSpan"), cell.find(f"{W}tcPr/{W}vMerge")
            down = tall is not None and tall.get(f"{W}val", "continue") == "continue"
            text = "\n".join(text_of(p) for p in cell.iterfind(f"{W}p"))
            cells.append((text, "down" if down else None))
            cells += [("", "right")] * (int(wide.get(f"{W}val", "1")) - 1 if wide is not None else 0)
        out.append(cells)
    return out


def blocks_of(content: bytes, images: bool = True) -> Iterator[tuple]:
    """(pos, kind, style, text, images, cells) of the body's paragraphs and tables, in order; without ``images`` their bytes are
    not unpacked, and null."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        styles = {}
        if "word/styles.xml" in names:
            for s in ElementTree.fromstring(z.read("word/styles.xml")).iterfind(f"{W}style"):
                name = s.find(f"{W}name")
                styles[s.get(f"{W}styleId")] = name.get(f"{W}val") if name is not None else None
        links = {}
        if "word/_rels/document.xml.rels" in names:
            links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("word/_rels/document.xml.rels"))}
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{W}body")
        if body is None:
            raise ValueError("no body")
        for pos, e in enumerate(x for x in body if x.tag in (f"{W}p", f"{W}tbl")):
            if e.tag == f"{W}tbl":
                yield pos, "table", None, None, [], cells_of(e)
                continue
            style = e.find(f"{W}pPr/{W}pStyle")
            name = styles.get(style.get(f"{W}val"), style.get(f"{W}val")) if style is not None else "Normal"
            # built-in style names are stored in lower case
            name = name[:1].upper() + name[1:] if name else name
            pictures = []
            for b in e.iter(f"{A}blip"):
                target = links.get(b.get(f"{R}embed"), "")
                if f"word/{target}" in names:
                    pictures.append((target.rsplit(".", 1)[-1].lower(), z.read(f"word/{target}") if images else None))
            yield pos, "paragraph", name, text_of(e), pictures, []


#: What Spark's reader of whole files gives, as a stream must be told.
FILES = "path string, modificationTime timestamp, length bigint, content binary"


def read_docx(spark: SparkSession, path: str, parts: int = 0, images: bool = True) -> DataFrame:
    """Blocks of all DOCX files; ``parts`` spreads the files by size before they are parsed. Files of no bytes are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.docx").load(path)
    files = files.select(X.stem(F.col("path")).alias("doc_name"), "content", "length")
    return docx_blocks(files.repartition(parts, "length", "doc_name") if parts else files, images)


def stream_docx(spark: SparkSession, path: str, images: bool = True, batch_bytes: int = 1 << 30) -> DataFrame:
    """A stream of the blocks of DOCX files: each file is read once, in a batch of about ``batch_bytes``; which were read is kept in
    the query's checkpoint. A file that is replaced under its name is not read again."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True).option("pathGlobFilter", "*.docx").option("maxBytesPerTrigger", batch_bytes).load(path)
    return docx_blocks(files.select(X.stem(F.col("path")).alias("doc_name"), "content"), images)


def docx_blocks(files: DataFrame, images: bool = True) -> DataFrame:
    """Blocks of files(doc_name, content), a table or a stream. A file that can't be read, as an empty or null one, yields one block of kind
    "unreadable" with the reason as text. Without ``images`` only their extensions are told, and no image is unpacked."""
    return files.select("doc_name", "content").mapInArrow(lambda batches: parsed(batches, images), BLOCKS)


def parsed(batches: Iterable[pa.RecordBatch], images: bool) -> Iterator[pa.RecordBatch]:
    """Blocks of many files in each batch; one for each file would make the conversion the greatest part of the work."""
    rows, size = [], 0
    for batch in batches:
        for name, content in zip(batch["doc_name"], batch["content"], strict=True):
            name = name.as_py()
            try:
                found = [(name, *b) for b in blocks_of(content.as_py(), images)]
            except Exception as x:  # whatever is wrong with one file, the others are read
                found = [(name, 0, "unreadable", None, f"{type(x).__name__}: {x}", [], [])]
            rows += found
            size += sum(ROW_BYTES + len(r[4] or "") + sum(len(i or b"") for _, i in r[5]) + ROW_BYTES * sum(map(len, r[6])) for r in found)
            if size >= OUT_BYTES:
                yield as_batch(rows)
                rows, size = [], 0
    if rows:
        yield as_batch(rows)


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = [list(c) for c in zip(*rows, strict=True)]
    columns[5] = [[{"ext": e, "bytes": b} for e, b in x] for x in columns[5]]
    columns[6] = [[[{"text": t, "span": s} for t, s in r] for r in x] for x in columns[6]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ARROW, strict=True)], schema=ARROW)


def cells(blocks: DataFrame) -> DataFrame:
    """(doc_name, table_id, row, col, text, span): the tables' cells in long form; table_id is the block's place."""
    rows = blocks.where("kind = 'table'").select("doc_name", F.col("pos").alias("table_id"), F.posexplode("cells").alias("row", "r"))
    return rows.select("doc_name", "table_id", "row", F.posexplode("r").alias("col", "c")).select("doc_name", "table_id", "row", "col", "c.text", "c.span")
