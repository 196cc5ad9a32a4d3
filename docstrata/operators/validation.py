"""Validation and repair of document JSON: raw text in, issue rows and repaired text out."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docstrata.functions import text as X

#: What a repair puts in.
ZEROS = [0.0] * 10
NO_NAME, NO_CHUNK = "Unnamed Document", "Empty chunk"
CHUNK_KEYS = ("chunk", "content")


def kind(value: Column) -> Column:
    """OBJECT, ARRAY or the scalar type of a VARIANT; null if there is none."""
    return F.regexp_extract(F.schema_of_variant(value), r"^[A-Z]+", 0)


def at(value: Column, *path: str) -> Column:
    return F.try_variant_get(value, "$" + "".join(f".{p}" for p in path), "variant")


def items(value: Column) -> Column:
    """The elements of a VARIANT array, in order."""
    return F.try_variant_get(value, "$", "array<variant>")


def issue(when: Column, *message: Column | str) -> Column:
    text = F.concat(*(F.lit(m) if isinstance(m, str) else m.cast("string") for m in message))
    return F.when(F.coalesce(when, F.lit(False)), text)


def missing(value: Column) -> Column:
    return value.isNull()


def not_a(value: Column, wanted: str) -> Column:
    return value.isNotNull() & (F.coalesce(kind(value), F.lit("VOID")) != wanted)


def is_object(value: Column) -> Column:
    return F.coalesce(kind(value) == "OBJECT", F.lit(False))


def issues(files: DataFrame, file: str = "file_name", raw: str = "value") -> DataFrame:
    """(file, section, subsection, chunk, part, message): one row per issue, in the order file, section, subsection,
    chunk, part; indexes are -1 above their level. What lies below something unusable is not looked at. Broken JSON is
    "unreadable". Keys whose value is JSON null count as there. Each text is parsed once; its issues are one array."""
    return with_issues(files.select(F.col(file).alias("file"), raw), raw).select("file", F.explode("issues").alias("x")).select("file", "x.*")


def with_issues(files: DataFrame, raw: str = "value", name: str = "issues") -> DataFrame:
    """``files`` with an array of the issues of each, in the order and with the fields of ``issues``; empty where there are none."""
    none = F.lit(-1)
    kind_ = "array<struct<section:int,subsection:int,chunk:int,part:int,message:string>>"

    def listed(section: Column, subsection: Column, chunk: Column, found: list[Column]) -> Column:
        every = F.array(*(F.struct(section.alias("section"), subsection.alias("subsection"), chunk.alias("chunk"), F.lit(i).alias("part"), m.alias("message")) for i, m in enumerate(found)))
        return F.filter(every, lambda x: x["message"].isNotNull()).cast(kind_)

    def below(value: Column, of: Callable[[Column, Column], Column]) -> Column:
        """The issues of all elements of a list, in order; none if it is no list."""
        return F.coalesce(F.flatten(F.transform(items(value), of)), F.array().cast(kind_))

    def of_chunk(i: Column, j: Column) -> Callable[[Column, Column], Column]:
        def check(c: Column, k: Column) -> Column:
            good = is_object(c)
            return listed(i, j, k, [
                issue(~good, "Chunk ", k, " in subsection ", j, ", section ", i, " is not a dictionary"),
                issue(good & missing(at(c, "chunk")) & missing(at(c, "content")), "Chunk ", k, " in subsection ", j, ", section ", i, " is missing content field"),
                issue(good & not_a(at(c, "embedding"), "ARRAY"), "Chunk ", k, " in subsection ", j, ", section ", i, " has invalid embedding format"),
            ])

        return check

    def of_subsection(i: Column) -> Callable[[Column, Column], Column]:
        def check(s: Column, j: Column) -> Column:
            good, title = is_object(s), at(s, "title")
            own = listed(i, j, none, [
                issue(~good, "Subsection ", j, " in section ", i, " is not a dictionary"),
                issue(good & missing(title), "Subsection ", j, " in section ", i, " is missing 'title' field"),
                issue(good & is_object(title) & missing(at(title, "title")), "Subsection ", j, " in section ", i, " has malformed title dictionary"),
                issue(good & is_object(title) & not_a(at(title, "embedding"), "ARRAY"), "Subsection ", j, " in section ", i, " has invalid title embedding format"),
                issue(good & not_a(at(s, "chunks"), "ARRAY"), "Subsection ", j, " in section ", i, " 'chunks' is not a list"),
            ])
            return F.concat(own, below(at(s, "chunks"), of_chunk(i, j)))

        return check

    def of_section(s: Column, i: Column) -> Column:
        good, title, text = is_object(s), at(s, "title"), at(s, "description")
        own = listed(i, none, none, [
            issue(~good, "Section ", i, " is not a dictionary"),
            issue(good & missing(title), "Section ", i, " is missing 'title' field"),
            issue(good & is_object(title) & missing(at(title, "title")), "Section ", i, " has malformed title dictionary (missing 'title' key)"),
            issue(good & is_object(title) & not_a(at(title, "embedding"), "ARRAY"), "Section ", i, " has invalid title embedding format"),
            issue(good & is_object(text) & missing(at(text, "description")), "Section ", i, " has malformed description dictionary (missing 'description' key)"),
            issue(good & is_object(text) & not_a(at(text, "embedding"), "ARRAY"), "Section ", i, " has invalid description embedding format"),
            issue(good & not_a(at(s, "subsections"), "ARRAY"), "Section ", i, " 'subsections' is not a list"),
        ])
        return F.concat(own, below(at(s, "subsections"), of_subsection(i)))

    d = F.col("_d")
    top = listed(none, none, none, [
        issue(d.isNull(), "unreadable JSON"),
        issue(d.isNotNull() & ~is_object(d), "JSON data is not a dictionary"),
        issue(is_object(d) & missing(at(d, "document_name")), "Missing 'document_name' field"),
        issue(is_object(d) & missing(at(d, "content")), "Missing 'content' field"),
        issue(is_object(d) & not_a(at(d, "content"), "ARRAY"), "'content' field is not a list"),
    ])
    found = F.concat(top, below(at(d, "content"), of_section))
    # made by a generator, so that no filter on it is moved below and parses each text for every place that asks for it
    return files.withColumn("_d", F.try_parse_json(raw)).select(*files.columns, F.explode(F.array(found)).alias(name))


def repaired(raw: str, name: str = "") -> tuple[str, int]:
    """(JSON, number of repairs) of one document; what is no object, or no JSON, stays as it is."""
    try:
        document = json.loads(raw)
    except (TypeError, ValueError):
        return raw, 0
    if not isinstance(document, dict):
        return raw, 0
    n = 0

    def put(holder, key, value) -> None:
        nonlocal n
        holder[key] = value
        n += 1

    def entries(holder: dict, key: str, substitute) -> Iterator[tuple[int, dict]]:
        """The objects of a list; a value that is no list is emptied, an element that is no object replaced."""
        if not isinstance(holder.get(key, []), list):
            put(holder, key, [])
        for at_, x in enumerate(holder.get(key, [])):
            if isinstance(x, dict):
                yield at_, x
            else:
                put(holder[key], at_, substitute(at_))

    def texts(holder: dict, key: str, substitute: str, required: bool) -> None:
        value = holder.get(key)
        if key not in holder:
            if required:
                put(holder, key, substitute)
        elif isinstance(value, dict):
            if key not in value:
                put(value, key, substitute)
            if not isinstance(value.get("embedding", []), list):
                put(value, "embedding", list(ZEROS))

    if "document_name" not in document:
        put(document, "document_name", name.rsplit("/", 1)[-1].rsplit(".", 1)[0] if name else NO_NAME)
    if "content" not in document:
        put(document, "content", [])
    untitled = lambda what: lambda at_: {"title": f"{what} {at_ + 1}", "description": ""}
    for i, section in entries(document, "content", untitled("Section")):
        texts(section, "title", f"Section {i + 1}", True)
        texts(section, "description", "", False)
        for j, sub in entries(section, "subsections", untitled("Subsection")):
            texts(sub, "title", f"Subsection {j + 1}", True)
            for _, chunk in entries(sub, "chunks", lambda _: {"content": NO_CHUNK, "embedding": list(ZEROS)}):
                if not any(key in chunk for key in CHUNK_KEYS):
                    put(chunk, "content", NO_CHUNK)
                if not isinstance(chunk.get("embedding", []), list):
                    put(chunk, "embedding", list(ZEROS))
    return (json.dumps(document, ensure_ascii=False), n) if n else (raw, 0)


#: Rows whose texts are Python's at once.
ROWS = 64


def repair(files: DataFrame, file: str = "file_name", raw: str = "value") -> DataFrame:
    """``files`` with ``n_issues``, ``fixed`` (the repaired text) and ``repairs``; only texts with an issue are Python's, ``ROWS`` rows at a time."""
    found = with_issues(files, raw, "_issues")
    marked = found.select(*files.columns, F.size("_issues").cast("long").alias("n_issues"), F.col(file).cast("string").alias("_name"))
    schema = T.StructType([*files.schema.fields, T.StructField("n_issues", T.LongType()), T.StructField("fixed", T.StringType()), T.StructField("repairs", T.IntegerType())])

    def fix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS):
                part = whole.slice(first, ROWS)
                bad = pc.greater(part.column("n_issues"), 0)
                texts, names = (part.column(c).filter(bad).to_pylist() for c in (raw, "_name"))
                done = [repaired(t, n or "") for t, n in zip(texts, names, strict=True)]
                kept = part.column(raw)
                fixed = pc.replace_with_mask(kept, bad, pa.array([t for t, _ in done], kept.type))
                repairs = pc.replace_with_mask(pa.array([0] * part.num_rows, pa.int32()), bad, pa.array([n for _, n in done], pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], fixed, repairs], names=schema.names)

    return marked.mapInArrow(fix, schema)


def checked_again(files: DataFrame, file: str = "file_name", raw: str = "value") -> DataFrame:
    """Validate, repair, validate again: (file, n_issues, repairs, remaining, status, fixed_name, fixed); a row for each file, nothing is moved.

    ``status`` is "ok", "fixed", "fixed, with issues" or "failed" (no JSON object)."""
    fixed = repair(files, file, raw).select(file, "n_issues", "repairs", "fixed")
    out = with_issues(fixed, "fixed", "_left")
    hopeless = F.exists("_left", lambda x: x["message"].isin("unreadable JSON", "JSON data is not a dictionary"))
    out = out.select(*fixed.columns, F.size("_left").cast("long").alias("remaining"), hopeless.alias("hopeless"))
    status = F.when(F.col("hopeless"), "failed").when(F.col("n_issues") == 0, "ok").when(F.col("remaining") == 0, "fixed").otherwise("fixed, with issues")
    return out.select(file, "n_issues", "repairs", "remaining", status.alias("status"), F.concat(X.stem(F.col(file).cast("string")), F.lit("_fixed.json")).alias("fixed_name"), "fixed")


def run_summary(status: DataFrame) -> DataFrame:
    """Processed, successful, failed and fixed files."""
    return status.agg(F.count("*").alias("processed"), F.count_if(F.col("status") != "failed").alias("successful"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.startswith("status", F.lit("fixed"))).alias("fixed"))


def issue_counts(found: DataFrame) -> DataFrame:
    """Issues of each file and kind; the numbers in the messages are left out of the kind."""
    return found.groupBy("file", F.regexp_replace("message", r"\d+", "n").alias("kind")).count()
