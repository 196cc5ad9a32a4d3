"""Document trees: from a stream of blocks to sections, subsections and subsubsections, and back to nested documents.

Blocks are rows (doc, pos, kind, level, text, ...): ``kind`` is "paragraph" or "table", ``level`` the heading level or
null. All windows of a document share one partitioning and one order, so a tree costs one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docstrata.functions import text as X

LEVELS = ("section", "subsection", "subsubsection")
INDEXES = [f"{x}_idx" for x in LEVELS]
TITLES = [f"{x}_title" for x in LEVELS]


def with_headings(blocks: DataFrame, style: str = "style") -> DataFrame:
    """``level`` from the style name; ``unreadable`` marks headings without a number, which open nothing and hold no text."""
    level = X.heading_level(F.col(style))
    return blocks.withColumn("level", level).withColumn("unreadable", F.coalesce(F.startswith(F.col(style), F.lit("Heading")) & level.isNull(), F.lit(False)))


def assign(blocks: DataFrame, doc: str = "doc_id", pos: str = "pos") -> DataFrame:
    """Each block's place in the tree: three indexes (-1 for none), three titles, ``attached``.

    A level-1 heading opens a section and closes what is below, and so on; other levels change nothing. Blocks before the
    first section, and those under a heading whose parent level is not open, are not ``attached``."""
    w = Window.partitionBy(doc).orderBy(pos)
    # one order for all: a lower level counts on through the document, less what it had where a higher one last opened
    level = F.coalesce("level", F.lit(0))
    sums = lambda n: F.sum((level == n).cast("int")).over(w)
    since = lambda n: F.coalesce(F.last(F.when(level.between(1, n - 1), F.col(f"_n{n}")), ignorenulls=True).over(w), F.lit(0))

    def title(n: int) -> Column:
        """The last title of level n since a higher level opened."""
        own = F.when(level == n, X.strip(X.clean_nbsp(F.col("text"))))
        told = F.when(level.between(1, n - 1), F.struct(F.lit(None).cast("string").alias("t"))).when(own.isNotNull(), F.struct(own.alias("t")))
        return F.last(told, ignorenulls=True).over(w)["t"]

    out = blocks.withColumns({"_n1": sums(1), "_n2": sums(2), "_n3": sums(3)})
    out = out.withColumns({i: (F.col(f"_n{n}") - (since(n) if n > 1 else F.lit(0)) - 1).cast("int") for n, i in enumerate(INDEXES, 1)} | {t: title(n) for n, t in enumerate(TITLES, 1)}).drop("_n1", "_n2", "_n3")
    detached = (F.col("section_idx") < 0) | (F.col("subsubsection_idx") >= 0) & (F.col("subsection_idx") < 0)
    return out.withColumn("attached", ~detached)


def node_path(*indexes: Column) -> Column:
    """"content/0/subsections/1/subsubsections/2", as deep as the indexes are not negative."""
    names = ("content", "subsections", "subsubsections")
    return F.concat_ws("/", *(F.when(i >= 0, F.concat(F.lit(f"{n}/"), i.cast("string"))) for n, i in zip(names, indexes, strict=False)))


def deepest() -> Column:
    return F.when(F.col("subsubsection_idx") >= 0, 3).when(F.col("subsection_idx") >= 0, 2).otherwise(1)


def node_text(assigned: DataFrame, doc: str = "doc_id", pos: str = "pos") -> DataFrame:
    """One row per node: (doc, indexes, level, title, text); the text of its own paragraphs, joined without separator."""
    rows = assigned.where("attached")
    if "kind" in rows.columns:
        rows = rows.where("kind = 'paragraph'")
    if "unreadable" in rows.columns:
        rows = rows.where("not unreadable")
    is_heading = F.col("level").isNotNull() if "style" not in rows.columns else F.startswith(F.col("style"), F.lit("Heading"))
    parts = F.array_sort(F.collect_list(F.when(~F.coalesce(is_heading, F.lit(False)), F.struct(F.col(pos).alias("pos"), X.strip(X.clean_nbsp(F.col("text"))).alias("text")))))
    titles = F.when(F.col("subsubsection_idx") >= 0, F.first("subsubsection_title")).when(F.col("subsection_idx") >= 0, F.first("subsection_title")).otherwise(F.first("section_title"))
    return rows.groupBy(doc, *INDEXES).agg(titles.alias("title"), F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("text")).withColumn("level", deepest())


def orphans(assigned: DataFrame, doc: str = "doc_id") -> DataFrame:
    """What has no place in the tree: (doc, blocks, characters), for the audit."""
    return assigned.where("not attached").groupBy(doc).agg(F.count("*").alias("blocks"), F.sum(F.length("text")).alias("characters"))


def table_entries(assigned: DataFrame, doc: str = "doc_id", pos: str = "pos") -> DataFrame:
    """Tables with a number that runs through the document (tables outside the tree count too) and, as description,
    the paragraph directly before; "" after a heading or another table."""
    w = Window.partitionBy(doc).orderBy(pos)
    before = F.when((F.lag("kind").over(w) == "paragraph") & F.lag("level").over(w).isNull(), X.strip(X.clean_nbsp(F.lag("text").over(w))))
    found = assigned.withColumn("description", F.coalesce(before, F.lit(""))).where("kind = 'table'")
    return found.withColumn("table_number", F.row_number().over(w)).where("attached").select(doc, pos, *INDEXES, "table_number", "description")


def figures(assigned: DataFrame, doc: str = "doc_id", pos: str = "pos", reach: int = 3) -> DataFrame:
    """Images with a caption among the next ``reach`` blocks: id, name (the caption), placeholder, the node's text so
    far as ``last_paragraph``, image, indexes and titles. Images without a caption are left out.

    Captions and texts are found without the images, which join their blocks at the end. A node's text is put
    together once, in the group that has its figures too, with the place in it where each figure stands: the characters before it
    in the document, less those before the node."""
    texts = assigned.withColumn("_images", F.when(F.col("images").isNotNull(), F.size("images")).otherwise(0)).drop("images")
    w = Window.partitionBy(doc).orderBy(pos)
    clean = X.strip(X.clean_nbsp(F.col("text")))
    texts = texts.withColumn("_caption", F.when(X.starts_caption(F.col("text")), clean))
    caption = F.coalesce(*(F.lead("_caption", i).over(w) for i in range(1, reach + 1)))
    paragraph = F.when((F.col("kind") == "paragraph") & F.col("level").isNull(), clean)
    before = F.coalesce(F.sum(F.length("_paragraph")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = texts.withColumn("figure_name", caption).withColumn("_own", F.coalesce(clean, F.lit(""))).withColumn("_paragraph", paragraph).withColumn("_before", before)
    paragraphs = F.collect_list(F.when(F.col("_paragraph").isNotNull(), F.struct(F.col(pos).alias("pos"), F.col("_paragraph").alias("text"))))
    found = F.collect_list(F.when(F.col("attached") & F.col("figure_name").isNotNull() & (F.col("_images") > 0), F.struct(pos, "figure_name", "_own", "_before", *TITLES)))
    nodes = placed.groupBy(doc, *INDEXES).agg(F.array_sort(paragraphs).alias("_paragraphs"), found.alias("_found"), F.min("_before").alias("_start")).where("size(_found) > 0")
    named = nodes.select(doc, *INDEXES, "_start", F.array_join(F.transform("_paragraphs", lambda x: x["text"]), "").alias("_text"), F.explode("_found").alias("_f")).select(doc, *INDEXES, "_start", "_text", "_f.*")
    named = named.withColumn("last_paragraph", F.concat(F.substring("_text", F.lit(1), (F.col("_before") - F.col("_start")).cast("int")), "_own")).drop("_text", "_own", "_before", "_start")
    images = assigned.where("size(images) > 0").select(doc, pos, F.posexplode("images").alias("image_pos", "image"))
    one = named.join(images, [doc, pos])
    return one.select(
        doc, pos, "image_pos", F.sha2(F.concat_ws("/", F.col(doc).cast("string"), F.col(pos).cast("string"), F.col("image_pos").cast("string")), 256).alias("figure_id"), "figure_name",
        F.concat(F.lit("<<<"), "figure_name", F.lit(">>>")).alias("placeholder"), "last_paragraph", F.col("image.bytes").alias("image_bytes"), F.col("image.ext").alias("image_ext"),
        *INDEXES, *(F.coalesce(t, F.lit("")).alias(t) for t in TITLES),
    )


def figure_prompts(found: DataFrame, template: str = X.FIGURE_PROMPT) -> DataFrame:
    """What a vision model is asked about each figure: prompt, file name, image as base64."""
    name = F.concat("figure_name", F.lit("."), "image_ext")
    return found.withColumn("prompt", X.fill(template, figure_name=F.col("figure_name"), last_paragraph=F.col("last_paragraph"))).withColumn("file_name", name).withColumn("image_base64", F.base64("image_bytes"))


def write_back(nodes: DataFrame, described: DataFrame, doc: str = "doc_id") -> DataFrame:
    """``nodes`` with each figure's placeholder in ``text`` replaced by its ``description``; figures are joined by node."""
    by_node = described.groupBy(doc, *INDEXES).agg(F.array_sort(F.collect_list(F.struct("pos", "image_pos", "placeholder", "description"))).alias("_figures"))
    joined = nodes.join(by_node, [doc, *INDEXES], "left")
    text = F.aggregate("_figures", F.col("text"), lambda t, f: F.replace(t, f["placeholder"], F.coalesce(f["description"], f["placeholder"])))
    return joined.withColumn("text", F.coalesce(text, F.col("text"))).drop("_figures")


def flatten(documents: DataFrame) -> DataFrame:
    """(document_name, path, kind, text) of every text in ``documents(document_name, content)``: titles, descriptions,
    text contents and chunks, level by level."""

    def texts(nodes: DataFrame, prefix: Column, fields: list[str]) -> DataFrame:
        struct = nodes.schema["node"].dataType.names
        kinds = [f for f in fields if f in struct]
        own = F.array(*(F.struct(F.concat(prefix, F.lit(f"/{f}")).alias("path"), F.lit(f).alias("kind"), F.col(f"node.{f}").alias("text")) for f in kinds))
        if "chunks" in struct:
            chunks = F.transform(F.coalesce("node.chunks", F.array().cast("array<string>")), lambda c, i: F.struct(F.concat(prefix, F.lit("/chunks/"), i.cast("string")).alias("path"), F.lit("chunk").alias("kind"), c.alias("text")))
            own = F.concat(own, chunks)
        return nodes.select("document_name", F.explode(own).alias("x")).select("document_name", "x.*")

    def children(nodes: DataFrame, name: str, idx: str) -> DataFrame | None:
        """The nodes one level down, None where documents have no such level."""
        if nodes is None or name not in nodes.schema["node"].dataType.names:
            return None
        return nodes.select(*(c for c in nodes.columns if c != "node"), F.posexplode(f"node.{name}").alias(idx, "node"))

    fields = ["title", "description", "text_content"]
    sections = documents.select("document_name", F.posexplode("content").alias("i", "node"))
    subs = children(sections, "subsections", "j")
    s, t = F.concat(F.lit("content/"), F.col("i").cast("string")), F.concat(F.lit("/subsections/"), F.col("j").cast("string"))
    found = texts(sections, s, fields)
    if subs is not None:
        found = found.unionByName(texts(subs, F.concat(s, t), fields))
        if (subsubs := children(subs, "subsubsections", "k")) is not None:
            found = found.unionByName(texts(subsubs, F.concat(s, t, F.lit("/subsubsections/"), F.col("k").cast("string")), fields))
    return found


def folded(rows: DataFrame, by: list[str], idx: str, child: Column, name: str, carried: list[str]) -> DataFrame:
    """(by..., carried..., name): for each parent its own columns, from the row whose ``idx`` is negative, and its ``child`` structs in the order of
    ``idx``, null if there are none. Parents without a row of their own drop out, with what is below. Rows that are together by
    document stay where they are, as ``by`` begins with it."""
    listed = F.array_sort(F.collect_list(F.when((F.col(idx) >= 0) & child.isNotNull(), F.struct(idx, child.alias("x")))))
    own = [F.first(F.when(F.col(idx) < 0, F.struct(*carried)), ignorenulls=True).alias("_own")] if carried else []
    found = rows.groupBy(*by).agg(*own, F.transform(listed, lambda c: c["x"]).alias(name))
    found = found.where("_own is not null") if carried else found.where(F.size(name) > 0)
    return found.select(*by, *(["_own.*"] if carried else []), F.when(F.size(name) > 0, F.col(name)).alias(name))


def assemble(nodes: DataFrame, doc: str = "doc_id", tables: DataFrame | None = None, figures: DataFrame | None = None) -> DataFrame:
    """(doc, content): nested documents from node rows (doc, indexes, title, text [, chunks]), deepest level first; with
    the entries of ``table_entries`` and ``figures`` at their nodes, if given.

    Entries meet their nodes, and children their parents, in groups, not by joins: a join on indexes deals out all texts anew, and computes
    them once for each side."""
    key, chunks = [doc, *INDEXES], ["chunks"] if "chunks" in nodes.columns else []
    rows, extra = nodes.select(*key, F.struct("title", "text", *chunks).alias("_node")), {}
    if tables is not None:
        extra["tables"] = tables.select(*key, F.struct("table_number", "description").alias("tables"))
    if figures is not None:
        extra["figures_meta_data"] = figures.select(*key, F.struct("pos", "image_pos", "figure_id", "last_paragraph").alias("figures_meta_data"))
    if extra:
        for entries in extra.values():
            rows = rows.unionByName(entries, allowMissingColumns=True)
        lists = (F.array_sort(F.collect_list(e)).alias(e) for e in extra)
        rows = rows.repartition(doc).groupBy(*key).agg(F.first("_node", ignorenulls=True).alias("_node"), *lists).where("_node is not null")
    rows = rows.select(*key, "_node.*", *(F.when(F.size(e) > 0, F.col(e)).alias(e) for e in extra))
    if figures is not None:
        rows = rows.withColumn("figures_meta_data", F.transform("figures_meta_data", lambda f: F.struct(f["figure_id"].alias("figure_id"), f["last_paragraph"].alias("last_paragraph"))))
    node = lambda text, *more: F.struct("title", F.col("text").alias(text), *more)
    rows = folded(rows, key[:3], INDEXES[2], node("text_content", *chunks, *extra), "subsubsections", ["title", "text", *chunks, *extra])
    rows = folded(rows, key[:2], INDEXES[1], node("text_content", *chunks, *extra, "subsubsections"), "subsections", ["title", "text", *extra])
    return folded(rows, [doc], INDEXES[0], node("description", *extra, "subsections"), "content", [])


def with_vectors(texts: DataFrame, vectors: DataFrame, doc: str = "document_name", keep: tuple[str, ...] = ("title", "description", "chunk")) -> DataFrame:
    """``flatten``'s rows of the kinds in ``keep`` with the vector found at the same (document, path)."""
    return texts.where(F.col("kind").isin(*keep)).join(vectors, [doc, "path"], "left")


def renest(embedded: DataFrame, documents: DataFrame, doc: str = "document_name") -> DataFrame:
    """``documents`` with vectors from rows (doc, path, kind, text, vector): titles and descriptions become
    {title | description, embedding}, chunks {chunk, embedding}, in their places; all else stays as it is. A text
    without a row keeps its text and has no vector; a document without sections has null for its content.

    Nodes, chunks and vectors are dealt out once, by document, and meet in groups from the deepest level up; of several rows for
    one text, one counts."""
    part = F.split("path", "/")
    index = lambda n: F.try_element_at(part, F.lit(n)).try_cast("int")
    place = lambda name, at: F.coalesce(F.when(F.try_element_at(part, F.lit(at)) == name, index(at + 1)), F.lit(-1))
    none, key = F.lit(-1), [doc, *INDEXES]
    of = lambda kind: F.when(F.col("kind") == kind, F.struct("vector")).alias(f"_{kind}")
    at = [index(2).alias(INDEXES[0]), place("subsections", 3).alias(INDEXES[1]), place("subsubsections", 5).alias(INDEXES[2])]
    chunk_idx = F.when(F.col("kind") == "chunk", F.element_at(part, -1).try_cast("int")).otherwise(none).alias("chunk_idx")
    rows = embedded.where(F.col("kind").isin("title", "description", "chunk")).select(doc, *at, chunk_idx, of("title"), of("description"), of("chunk"))
    others = [c for c in documents.columns if c not in (doc, "content")]
    rows = rows.unionByName(documents.select(doc, *(none.alias(i) for i in [*INDEXES, "chunk_idx"]), F.struct(F.lit(True).alias("_there"), *others).alias("_head")), allowMissingColumns=True)

    names = ("content", "subsections", "subsubsections", "")
    levels: list[list[str]] = []
    nodes = documents.select(doc, F.posexplode("content").alias(INDEXES[0], "node"))
    while True:
        n, below = len(levels), names[len(levels) + 1]
        fields = nodes.schema["node"].dataType.names
        levels.append([f for f in fields if f != below])
        own = [*INDEXES[: n + 1], *(none.alias(i) for i in INDEXES[n + 1 :])]
        texts = (F.col("node").getField(f) for f in levels[-1])
        held = F.struct(*((t.isNotNull() if f == "chunks" else t).alias(f) for f, t in zip(levels[-1], texts, strict=True))).alias(f"_node{n}")
        rows = rows.unionByName(nodes.select(doc, *own, none.alias("chunk_idx"), held), allowMissingColumns=True)
        if "chunks" in fields:
            each = nodes.select(doc, *own, F.posexplode("node.chunks").alias("chunk_idx", "_t"))
            rows = rows.unionByName(each.select(*key, "chunk_idx", F.struct(F.col("_t").alias("chunk")).alias("_text")), allowMissingColumns=True)
        if below not in fields:
            break
        nodes = nodes.select(doc, *INDEXES[: n + 1], F.posexplode(F.col("node").getField(below)).alias(INDEXES[n + 1], "node"))

    rows = rows.repartition(doc)
    firsts = lambda *cols: [F.first(c, ignorenulls=True).alias(c) for c in cols]
    whole = ["_head", "_title", "_description", *(f"_node{n}" for n in range(len(levels)))]
    lists = []
    if "_text" in rows.columns:
        rows = rows.groupBy(*key, "chunk_idx").agg(*firsts(*whole, "_text", "_chunk"))
        chunk = F.struct("chunk_idx", F.struct(F.col("_text.chunk").alias("chunk"), F.col("_chunk.vector").alias("embedding")).alias("x"))
        lists = [F.transform(F.array_sort(F.collect_list(F.when(F.col("_text").isNotNull(), chunk))), lambda c: c["x"]).alias("_chunks")]
    rows = rows.groupBy(*key).agg(*firsts(*whole), *lists)

    def told(n: int) -> Column:
        """The node of level n in a row, with its vectors; null where the row has none."""
        node = F.col(f"_node{n}")
        new = {f: F.struct(node[f].alias(f), F.col(f"_{f}.vector").alias("embedding")) for f in ("title", "description")} | ({"chunks": F.when(node["chunks"], F.col("_chunks"))} if lists else {})
        return F.when(node.isNotNull(), F.struct(*((new[f] if f in new else node[f]).alias(f) for f in levels[n]))).alias(f"_node{n}")

    rows = rows.select(*key, "_head", *map(told, range(len(levels))))
    for n in reversed(range(len(INDEXES))):
        if n >= len(levels):
            continue
        lower = [names[n + 1]] if n + 1 < len(levels) else []
        child = F.when(F.col(f"_node{n}").isNotNull(), F.struct(*(F.col(f"_node{n}").getField(f).alias(f) for f in levels[n]), *lower))
        rows = folded(rows, key[: n + 1], INDEXES[n], child, names[n], ["_head", *(f"_node{m}" for m in range(n))])
    return rows.where("_head is not null").select(doc, "content", *(F.col("_head").getField(c).alias(c) for c in others)).select(documents.columns)
