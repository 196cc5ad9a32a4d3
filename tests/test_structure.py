from __future__ import annotations

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from docstrata.jobs import ingest
from docstrata.operators import embedding, structure, tables
from docstrata.sources import docx

BLOCKS = "doc_id string, pos int, kind string, style string, text string, images array<struct<ext string, bytes binary>>"


def blocks(spark, rows, doc="d"):
    """Rows are (style or "table", text[, image extension])."""
    out = []
    for i, r in enumerate(rows):
        kind = "table" if r[0] == "table" else "paragraph"
        out.append((doc, i, kind, None if kind == "table" else r[0], r[1], [(r[2], b"\x01")] if len(r) > 2 else []))
    return spark.createDataFrame(out, BLOCKS)


def placed(spark, rows):
    return structure.assign(structure.with_headings(blocks(spark, rows)))


def indexes(spark, rows):
    return [(r.section_idx, r.subsection_idx, r.subsubsection_idx, r.attached) for r in placed(spark, rows).orderBy("pos").collect()]


def test_indexes(spark):
    rows = [("Normal", "before"), ("Heading 2", "orphan"), ("Normal", "lost"), ("Heading 1", "A"), ("Heading 3", "detached"), ("Heading 2", "A.1"), ("Heading 3", "A.1.1"), ("Heading 4", "deep"), ("Heading", "unreadable"), ("Normal", "text"), ("Heading 1", "B")]
    assert indexes(spark, rows) == [(-1, -1, -1, False), (-1, 0, -1, False), (-1, 0, -1, False), (0, -1, -1, True), (0, -1, 0, False), (0, 0, -1, True), (0, 0, 0, True), (0, 0, 0, True), (0, 0, 0, True), (0, 0, 0, True), (1, -1, -1, True)]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_tree_costs_one_shuffle_and_one_sort(spark):
    df = spark.createDataFrame([], "doc_id long, pos int, kind string, level int, text string")
    plan = plan_of(structure.assign(df))
    assert plan.count("Exchange ") == 1 and plan.count("Sort [") == 1


def test_titles_end_with_their_level(spark):
    rows = [("Heading 1", "A"), ("Heading 2", "A.1"), ("Heading 3", "A.1.1"), ("Heading 2", "A.2"), ("Normal", "x"), ("Heading 3", None), ("Heading 1", "B"), ("Normal", "y"), ("Heading 3", "lost")]
    found = placed(spark, rows).orderBy("pos").select(*structure.TITLES).collect()
    assert [tuple(r) for r in found] == [("A", None, None), ("A", "A.1", None), ("A", "A.1", "A.1.1"), ("A", "A.2", None), ("A", "A.2", None), ("A", "A.2", None), ("B", None, None), ("B", None, None), ("B", None, "lost")]


def test_node_text(spark):
    rows = [("Heading 1", "1\tScope\xa0"), ("Normal", " a\xa0b "), ("Normal", "c"), ("Heading 2", "S"), ("Heading", "no number"), ("Normal", "d")]
    found = {(r.section_idx, r.subsection_idx): (r.title, r.text, r.level) for r in structure.node_text(placed(spark, rows)).collect()}
    assert found == {(0, -1): ("1\tScope", "a bc", 1), (0, 0): ("S", "d", 2)}


def test_orphans(spark):
    r = structure.orphans(placed(spark, [("Normal", "ab"), ("Heading 2", "c"), ("Heading 1", "A")])).first()
    assert (r.blocks, r.characters) == (2, 3)


def test_table_entries(spark):
    rows = [("table", None), ("Heading 1", "A"), ("table", None), ("Normal", " before "), ("table", None), ("table", None), ("Heading 2", "S"), ("Normal", "x"), ("table", None)]
    found = [(r.table_number, r.description, r.subsection_idx) for r in structure.table_entries(placed(spark, rows)).orderBy("pos").collect()]
    assert found == [(2, "", -1), (3, "before", -1), (4, "", -1), (5, "x", 0)]


def test_figures_meet_only_their_images(spark):
    """The texts of nodes are found in one grouping; the one join is that with the images."""
    rows = [("Heading 1", "A"), ("Normal", "one "), ("Normal", "two", "png"), ("Normal", "Fig. 1"), ("Heading 2", "S"), ("Normal", "three"), ("table", "t"), ("Normal", None, "emf"), ("Normal", "four", "png"), ("Normal", "\xa0 note 2")]
    found = structure.figures(placed(spark, rows))
    assert sorted((r.pos, r.figure_name, r.last_paragraph, r.subsection_title) for r in found.collect()) == [(2, "Fig. 1", "onetwo", ""), (7, "note 2", "three", "S"), (8, "note 2", "threefour", "S")]
    assert sum(plan_of(found.drop("image_bytes")).split("Initial Plan")[0].count(f"{j}Join ") for j in ("SortMerge", "BroadcastHash", "ShuffledHash")) == 1


def test_figures(spark):
    rows = [("Heading 1", "A"), ("Normal", "one "), ("Normal", "two", "png"), ("Normal", "x"), ("Normal", "NOTE: n"), ("Normal", "", "emf"), ("Normal", "a"), ("Normal", "b"), ("Normal", "c"), ("Normal", "Figure late")]
    found = structure.figures(placed(spark, rows)).collect()
    assert [(r.figure_name, r.last_paragraph, r.image_ext, r.section_title, r.subsection_idx) for r in found] == [("NOTE: n", "onetwo", "png", "A", -1)]
    asked = structure.figure_prompts(structure.figures(placed(spark, rows))).first()
    assert asked.file_name == "NOTE: n.png" and asked.image_base64 == "AQ==" and "onetwo" in asked.prompt


def test_descriptions_reach_the_text(spark):
    rows = [("Heading 1", "A"), ("Normal", "see ", "png"), ("Normal", "Fig 1")]
    nodes, _, _ = ingest.build_tree(blocks(spark, rows), lambda f: f.withColumn("description", F.lit("(a box)")))
    assert nodes.first().text == "see (a box)Fig 1"


def test_assemble_flatten_renest(spark):
    rows = [("Heading 1", "A"), ("Normal", "a"), ("Heading 2", "A1"), ("Normal", "b"), ("Heading 3", "A11"), ("Normal", "c"), ("Heading 2", "A2"), ("Heading 1", "B")]
    p = placed(spark, rows)
    tree = structure.assemble(structure.node_text(p), tables=structure.table_entries(p)).withColumnRenamed("doc_id", "document_name")
    flat = structure.flatten(tree)
    texts = {r.path: r.text for r in flat.collect()}
    assert texts["content/0/subsections/0/subsubsections/0/text_content"] == "c" and texts["content/1/title"] == "B"
    vectors = flat.select("document_name", "path", F.array(F.length("text").cast("float")).alias("vector"))
    nested = structure.renest(structure.with_vectors(flat, vectors), tree).first().content
    assert [s.title.title for s in nested] == ["A", "B"] and [s.title.title for s in nested[0].subsections] == ["A1", "A2"]
    assert nested[0].subsections[0].subsubsections[0].title.embedding == [3.0]
    assert nested[0].description.description == "a" and nested[0].subsections[0].text_content == "b" and nested[0].subsections[0].subsubsections[0].text_content == "c"


def test_renest_keeps_the_document(spark):
    """Every other field, texts without a vector, empty lists, repeated chunks, and documents without sections."""
    sub = "struct<title:string,text_content:string,summary:string,chunks:array<string>,tables:array<struct<name:string>>>"
    docs = spark.createDataFrame([("d", [("T", "D", "sum", [("S", "body", "s2", ["c", "...", "c"], [("t",)]), (None, "x", None, [], [])]), ("U", "", None, None)], 7), ("e", [], 8), ("f", None, 9)], f"document_name string, content array<struct<title:string,description:string,summary:string,subsections:array<{sub}>>>, extra int")
    flat = structure.flatten(docs)
    vectors = embedding.embeddable(flat).select("document_name", "path", F.array(F.length("text").cast("float")).alias("vector"))
    found = {r.document_name: r for r in structure.renest(structure.with_vectors(flat, vectors), docs).collect()}
    one, two = found["d"].content
    assert (one.title.title, one.title.embedding, one.description.embedding, one.summary, found["d"].extra) == ("T", [1.0], [1.0], "sum", 7)
    s = one.subsections[0]
    assert [(c.chunk, c.embedding) for c in s.chunks] == [("c", [1.0]), ("...", None), ("c", [1.0])] and (s.text_content, s.summary, s.tables[0].name) == ("body", "s2", "t")
    assert one.subsections[1].title == (None, None) and one.subsections[1].chunks == [] and one.subsections[1].text_content == "x"
    assert two.description == ("", None) and not two.subsections and (found["e"].extra, found["f"].extra) == (8, 9)


def test_nodes_are_dealt_out_once_on_their_way_up(spark):
    """A tree with its tables is put together without joins; vectors and texts move once, by document."""
    df = spark.createDataFrame([], "doc_id string, pos int, kind string, level int, text string")
    p = structure.assign(df)
    tree = structure.assemble(structure.node_text(p), tables=structure.table_entries(p))
    plan = plan_of(tree)
    assert "Join" not in plan and plan.count("Exchange ") == 2
    plain = plan_of(structure.assemble(structure.node_text(p)))
    assert "Join" not in plain and plain.count("Exchange ") == 1
    rows = spark.createDataFrame([], "document_name string, path string, kind string, vector array<float>")
    sub = "struct<title:string,text_content:string,chunks:array<string>>"
    docs = spark.createDataFrame([], f"document_name string, content array<struct<title:string,description:string,subsections:array<{sub}>>>")
    plan = plan_of(structure.renest(rows, docs))
    assert "Join" not in plan and plan.count("Exchange ") == 1


def test_what_has_no_parent_drops_out(spark):
    """Nodes without a parent, entries without a node, and vectors without a text leave no trace; a node's entries are in order."""
    nodes = spark.createDataFrame([("d", 0, -1, -1, "A", "a"), ("d", 0, 0, 0, "lost", "x"), ("d", 0, 1, -1, "A2", "b"), ("d", 0, 1, 0, "A21", "c"), ("d", 1, 0, -1, "lost", "x"), ("e", 0, 0, -1, "lost", "x")], "doc_id string, section_idx int, subsection_idx int, subsubsection_idx int, title string, text string")
    entries = spark.createDataFrame([("d", 9, 0, 1, -1, 2, "two"), ("d", 5, 0, 1, -1, 1, "one"), ("d", 7, 3, -1, -1, 3, "lost")], "doc_id string, pos int, section_idx int, subsection_idx int, subsubsection_idx int, table_number int, description string")
    figures = spark.createDataFrame([("d", 8, 0, 0, -1, -1, "f2", "q"), ("d", 6, 1, 0, -1, -1, "f1", "p")], "doc_id string, pos int, image_pos int, section_idx int, subsection_idx int, subsubsection_idx int, figure_id string, last_paragraph string")
    (row,) = structure.assemble(nodes, tables=entries, figures=figures).collect()
    assert row.doc_id == "d" and len(row.content) == 1
    (sub,) = row.content[0].subsections
    assert (sub.title, [t.description for t in sub.tables], sub.figures_meta_data, [x.title for x in sub.subsubsections]) == ("A2", ["one", "two"], None, ["A21"])
    assert [f.figure_id for f in row.content[0].figures_meta_data] == ["f1", "f2"] and row.content[0].tables is None
    docs = structure.assemble(nodes).withColumnRenamed("doc_id", "document_name")
    vectors = spark.createDataFrame([("d", "content/0/title", "title", [1.0]), ("d", "content/7/title", "title", [2.0]), ("d", "content/0/subsections/5/title", "title", [3.0]), ("z", "content/0/title", "title", [4.0])], "document_name string, path string, kind string, vector array<float>")
    (row,) = structure.renest(vectors, docs).collect()
    assert row.content[0].title == ("A", [1.0]) and [s.title.title for s in row.content[0].subsections] == ["A2"]


@pytest.mark.parametrize("parts", [1, 7])
def test_order_does_not_depend_on_partitions(spark, parts):
    rows = [("Heading 1", "A"), *[("Normal", str(i)) for i in range(50)]]
    df = structure.with_headings(blocks(spark, rows).repartition(parts))
    assert structure.node_text(structure.assign(df)).first().text == "".join(map(str, range(50)))


def test_grids(spark):
    cells = spark.createDataFrame([("d", 0, 0, 0, "a\xa0b", None), ("d", 0, 0, 1, "", "right"), ("d", 0, 1, 0, "", "down"), ("d", 0, 1, 1, "x,y", None)], "doc_id string, table_id int, row int, col int, text string, span string")
    grid = tables.merged_cells(tables.cleaned(cells))
    assert {(r.row, r.col): r.text for r in grid.collect()} == {(0, 0): "a b", (0, 1): "a b", (1, 0): "a b", (1, 1): "x,y"}
    assert [r.line for r in tables.delimited(grid).orderBy("row").collect()] == ["a b,a b", 'a b,"x,y"']
    report = tables.report(grid, F.lit("2024-01-01 00:00:00").cast("timestamp")).first().report
    assert '"num_tables":1' in report and '"data":[["a b","a b"],["a b","x,y"]]' in report
    assert tables.larger_than(grid, 2).count() == 0 and tables.larger_than(grid, 1).count() == 4


def docx_file(body, media=()):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f'<w:styles {ns}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>')
        z.writestr("word/_rels/document.xml.rels", '<Relationships><Relationship Id="r1" Target="media/i.png"/></Relationships>')
        for name in media:
            z.writestr(name, b"png")
    return out.getvalue()


def test_docx(spark, tmp_path):
    body = ('<w:p><w:pPr><w:pStyle w:val="H1"/></w:pPr><w:r><w:t>1</w:t><w:tab/><w:t>Scope</w:t></w:r></w:p><w:p><w:r><w:t>text</w:t><a:blip r:embed="r1"/></w:r></w:p>'
            '<w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr><w:p><w:r><w:t>wide</w:t></w:r></w:p></w:tc></w:tr>'
            '<w:tr><w:tc><w:tcPr><w:vMerge/></w:tcPr><w:p/></w:tc><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:sectPr/>')  # fmt: skip
    (tmp_path / "a.docx").write_bytes(docx_file(body, ["word/media/i.png"]))
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    found = docx.read_docx(spark, str(tmp_path), 2)
    good = found.where("doc_name = 'a'").orderBy("pos").collect()
    assert [(r.kind, r.style, r.text) for r in good] == [("paragraph", "Heading 1", "1\tScope"), ("paragraph", "Normal", "text"), ("table", None, None)]
    assert good[1].images[0].ext == "png" and bytes(good[1].images[0].bytes) == b"png"
    grid = tables.merged_cells(docx.cells(found), ["doc_name", "table_id"])
    assert {(r.row, r.col): r.text for r in grid.collect()} == {(0, 0): "wide", (0, 1): "wide", (1, 0): "wide", (1, 1): "x"}
    assert found.where("kind = 'unreadable'").first().doc_name == "bad"
