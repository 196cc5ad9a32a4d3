from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from docstrata.operators import validation as V

GOOD = {"document_name": "D", "content": [{"title": {"title": "T", "embedding": [1.0]}, "description": "x", "subsections": [{"title": "S", "chunks": [{"chunk": "c", "embedding": [1.0]}, {"content": "d"}]}]}]}


def doc(**section):
    return {"document_name": "D", "content": [{"title": "T"} | section]}


def sub(**fields):
    return doc(subsections=[{"title": "S"} | fields])


CASES = {
    "[]": ["JSON data is not a dictionary"],
    "{": ["unreadable JSON"],
    "{}": ["Missing 'document_name' field", "Missing 'content' field"],
    '{"document_name": "D", "content": "x"}': ["'content' field is not a list"],
    '{"document_name": "D", "content": ["x"]}': ["Section 0 is not a dictionary"],
    '{"document_name": "D", "content": [{}]}': ["Section 0 is missing 'title' field"],
    json.dumps(doc(title={})): ["Section 0 has malformed title dictionary (missing 'title' key)"],
    json.dumps(doc(title={"title": "T", "embedding": "x"})): ["Section 0 has invalid title embedding format"],
    json.dumps(doc(description={})): ["Section 0 has malformed description dictionary (missing 'description' key)"],
    json.dumps(doc(description={"description": "x", "embedding": 1})): ["Section 0 has invalid description embedding format"],
    json.dumps(doc(subsections={})): ["Section 0 'subsections' is not a list"],
    json.dumps(doc(subsections=[3])): ["Subsection 0 in section 0 is not a dictionary"],
    json.dumps(doc(subsections=[{}])): ["Subsection 0 in section 0 is missing 'title' field"],
    json.dumps(sub(title={})): ["Subsection 0 in section 0 has malformed title dictionary"],
    json.dumps(sub(title={"title": "T", "embedding": {}})): ["Subsection 0 in section 0 has invalid title embedding format"],
    json.dumps(sub(chunks="x")): ["Subsection 0 in section 0 'chunks' is not a list"],
    json.dumps(sub(chunks=["x"])): ["Chunk 0 in subsection 0, section 0 is not a dictionary"],
    json.dumps(sub(chunks=[{}])): ["Chunk 0 in subsection 0, section 0 is missing content field"],
    json.dumps(sub(chunks=[{"chunk": "c", "embedding": "x"}])): ["Chunk 0 in subsection 0, section 0 has invalid embedding format"],
    json.dumps(GOOD): [],
}


def files(spark):
    return spark.createDataFrame([(f"in/f{i}.json", raw) for i, raw in enumerate(CASES)], "file_name string, value string")


def test_messages(spark):
    found = {}
    for r in V.issues(files(spark)).orderBy("file", "section", "subsection", "chunk", "part").collect():
        found.setdefault(r.file, []).append(r.message)
    assert found == {f"in/f{i}.json": m for i, m in enumerate(CASES.values()) if m}


def test_repair(spark):
    rows = {r.file_name: r for r in V.checked_again(files(spark)).collect()}
    for i, (raw, messages) in enumerate(CASES.items()):
        r = rows[f"in/f{i}.json"]
        if i < 2:
            assert r.status == "failed"
        else:
            assert (r.status, r.remaining, r.n_issues) == ("fixed" if messages else "ok", 0, len(messages)), raw
    assert rows["in/f2.json"].fixed_name == "f2_fixed.json" and json.loads(rows["in/f2.json"].fixed) == {"document_name": "f2", "content": []}
    s = V.run_summary(V.checked_again(files(spark))).first()
    assert (s.processed, s.failed) == (len(CASES), 2)


def test_repair_moves_nothing_and_holds_few_texts(spark, monkeypatch):
    """Issues are counted where the file is, without joins; the texts of a few rows are Python's at once, good ones not at all."""
    rows = [(f"in/f{i}.json", json.dumps(GOOD) if i % 3 else "{}" if i % 2 else None) for i in range(40)]
    df = spark.createDataFrame(rows, "file_name string, value string").coalesce(1)
    plan = V.checked_again(df)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange " not in plan
    monkeypatch.setattr(V, "ROWS", 7)
    found = {r.file_name: r for r in V.checked_again(df).collect()}
    for i, (name, raw) in enumerate(rows):
        r = found[name]
        assert (r.status, r.repairs, r.n_issues) == (("ok", 0, 0) if i % 3 else ("fixed", 2, 2) if i % 2 else ("failed", 0, 1))
        assert r.fixed == raw if i % 3 or not i % 2 else json.loads(r.fixed) == {"document_name": f"f{i}", "content": []}


def test_a_text_is_parsed_once(spark):
    """Filters on what is found stay above: the optimized plan has one call to parse each text, or two where it is validated again."""
    parsed = lambda df: df._jdf.queryExecution().optimizedPlan().toString().lower().count("parsejson")
    assert parsed(V.issues(files(spark)).where("message = 'unreadable JSON'")) == parsed(files(spark).select(F.try_parse_json("value"))) == 1
    assert parsed(V.checked_again(files(spark)).where(F.startswith("status", F.lit("fixed")))) == 2


def test_validated_trees_cost_one_shuffle(spark):
    """The JSON of a corpus is put together and validated where the blocks of a document are."""
    from docstrata import queries as Q

    plan = Q.validate_issues(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange ") == 1


@pytest.mark.parametrize(("raw", "fixed"), [
    ('{"document_name": "D", "content": [1, {"subsections": [2, {"title": {}, "chunks": [3, {}]}]}]}',
     {"document_name": "D", "content": [{"title": "Section 1", "description": ""}, {"title": "Section 2", "subsections": [{"title": "Subsection 1", "description": ""}, {"title": {"title": "Subsection 2"}, "chunks": [{"content": "Empty chunk", "embedding": [0.0] * 10}, {"content": "Empty chunk"}]}]}]}),
])
def test_repairs_in_full(raw, fixed):
    out, n = V.repaired(raw)
    assert json.loads(out) == fixed and n == 6
    assert V.repaired(json.dumps(GOOD)) == (json.dumps(GOOD), 0) and V.repaired(None) == (None, 0)
    assert json.loads(V.repaired("{}")[0])["document_name"] == "Unnamed Document"


def test_issue_kinds(spark):
    counts = V.issue_counts(V.issues(files(spark))).where("kind = 'Section n is not a dictionary'").collect()
    assert [r["count"] for r in counts] == [1]
