"""Registered queries of the library over the standard tables, each with its DuckDB twin where SQL can express it."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docstrata.functions import text as X
from docstrata.functions.tables import shared_folder
from docstrata.jobs import retrieval
from docstrata.operators import bounded, chat, chunking, clustering, embedding, long_texts, nodes, overlap_index, quantiles, search, stats, structure, tables, validation
from docstrata.operators.kmeans import kmeans
from docstrata.registry import ORACLES, QUERIES, Query, query, table
from docstrata.streaming import conversations as live

# ---- retrieval -------------------------------------------------------------------------------------------------------

NODES = """n AS (SELECT vec_id AS id, CAST(floor(vec_id / 100) AS BIGINT) AS doc_id, label, CASE WHEN vec_id % 100 = 0 THEN 'scope' WHEN vec_id % 100 <= 4 THEN 'section'
  WHEN vec_id % 100 <= 16 THEN 'subsection' WHEN vec_id % 100 <= 28 THEN 'subsubsection' ELSE 'chunk' END AS level,
  vec_id - vec_id % 100 + CASE WHEN vec_id % 100 <= 4 THEN NULL WHEN vec_id % 100 <= 16 THEN 1 + (vec_id % 100 - 5) % 4
  WHEN vec_id % 100 <= 28 THEN 5 + (vec_id % 100 - 17) % 4 ELSE 5 + (vec_id % 100 - 29) % 24 END AS parent_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
q AS (SELECT id AS query_id, v FROM n WHERE id % 100 = 0)"""


def sql_best(name: str, hits: str, level: str, parent: str, k: int) -> str:
    """The k best nodes of a level below each hit."""
    return f"""{name} AS (SELECT query_id, parent_id, id, score, rank FROM (SELECT q.query_id, h.id AS parent_id, n.id, list_cosine_similarity(q.v, n.v) AS score,
  row_number() OVER (PARTITION BY q.query_id, h.id ORDER BY round(list_cosine_similarity(q.v, n.v), 9) DESC, n.id) AS rank
  FROM {hits} h JOIN q USING (query_id) JOIN n ON n.level = '{level}' AND n.{parent} = h.id) WHERE rank <= {k})"""


SQL_TREE = f"""WITH {NODES},
d AS (SELECT query_id, id, score, rank FROM (SELECT q.query_id, n.doc_id AS id, list_cosine_similarity(q.v, n.v) AS score,
  row_number() OVER (PARTITION BY q.query_id ORDER BY round(list_cosine_similarity(q.v, n.v), 9) DESC, n.doc_id) AS rank FROM q, n WHERE n.level = 'scope') WHERE rank <= 3),
{sql_best("s", "d", "section", "doc_id", 2)},
{sql_best("u", "s", "subsection", "parent_id", 2)},
{sql_best("w", "u", "subsubsection", "parent_id", 2)},
{sql_best("c", "(SELECT query_id, id FROM u UNION ALL SELECT query_id, id FROM w)", "chunk", "parent_id", 2)},
a AS (SELECT c.query_id, coalesce(w.parent_id, u0.id) AS sub, w.id AS third, c.id, c.score, c.rank FROM c LEFT JOIN w ON w.query_id = c.query_id AND w.id = c.parent_id
  LEFT JOIN u u0 ON u0.query_id = c.query_id AND u0.id = c.parent_id)"""


def hits(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    view = retrieval.node_view(table(spark, sf_dir, "embeddings"))
    return retrieval.search_tree(view, retrieval.every_hundredth(view))


def shown(found: DataFrame, *columns: str) -> DataFrame:
    return found.select("query_id", *columns, "id", F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


QUERIES["hierarchical_search"] = retrieval.hierarchical_search
ORACLES["hierarchical_search"] = f"""{SQL_TREE} SELECT a.query_id, s.parent_id AS parent_document, s.id AS parent_section, a.sub AS parent_subsection, a.third AS parent_subsubsection, a.id AS chunk_id,
  round(a.score, 6) AS score, CAST(a.rank AS INTEGER) AS rank FROM a JOIN u ON u.query_id = a.query_id AND u.id = a.sub JOIN s ON s.query_id = a.query_id AND s.id = u.parent_id"""


@query(f"{SQL_TREE} SELECT query_id, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM d")
def doc_discovery(spark, sf_dir):
    return shown(hits(spark, sf_dir)["documents"])


@query(f"{SQL_TREE} SELECT query_id, parent_id, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM s")
def section_topk(spark, sf_dir):
    return shown(hits(spark, sf_dir)["sections"], "parent_id")


@query(f"{SQL_TREE} SELECT query_id, parent_id, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM u")
def subsection_topk(spark, sf_dir):
    return shown(hits(spark, sf_dir)["subsections"], "parent_id")


@query(f"{SQL_TREE} SELECT query_id, parent_id, w.id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank, (SELECT count(*) FROM n WHERE n.level = 'chunk' AND n.parent_id = w.id) AS chunk_count FROM w")
def subsubsection_topk(spark, sf_dir):
    return shown(hits(spark, sf_dir)["subsubsections"], "parent_id", "chunk_count")


@query(f"{SQL_TREE} SELECT query_id, parent_id, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM c")
def best_chunks(spark, sf_dir):
    found = hits(spark, sf_dir)["chunks"]
    return shown(found.withColumn("parent_id", F.coalesce("parent_subsubsection", "parent_subsection")), "parent_id")


@query(f"{SQL_TREE} SELECT query_id, (SELECT count(*) FROM d WHERE d.query_id = q.query_id) AS documents, (SELECT count(*) FROM s WHERE s.query_id = q.query_id) AS sections, (SELECT count(*) FROM u WHERE u.query_id = q.query_id) AS subsections, (SELECT count(*) FROM w WHERE w.query_id = q.query_id) AS subsubsections, (SELECT count(*) FROM c WHERE c.query_id = q.query_id) AS chunks FROM q")
def result_counts(spark, sf_dir):
    return search.result_counts(hits(spark, sf_dir))


@query(f"WITH {NODES} SELECT query_id, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT query_id, n.id, list_cosine_similarity(q.v, n.v) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(q.v, n.v), 9) DESC, n.id) AS rank FROM q, n) WHERE rank <= 10")
def flat_topk(spark, sf_dir):
    view = retrieval.node_view(table(spark, sf_dir, "embeddings"))
    return shown(search.flat(view, retrieval.every_hundredth(view), 10))


@query(ORACLES["flat_topk"].replace("SELECT query_id, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (", "SELECT query_id, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank, (SELECT count(*) FROM embeddings) AS rows FROM (", 1))
def exact_tree_topk(spark, sf_dir):
    """The flat search's result by branch and bound in a tree of two levels; the rows compared and pruned are all rows."""
    view = retrieval.node_view(table(spark, sf_dir, "embeddings"))
    index = bounded.build(kmeans(view, ["label"], 4), ["label", "cluster"])
    hits, counts = bounded.exact(index, retrieval.every_hundredth(view), 10)
    return shown(hits.join(counts, "query_id").withColumn("rows", F.col("compared") + F.col("pruned")), "rows")


SQL_CENTROIDS = """e AS (SELECT label, vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS dim FROM embeddings),
m AS (SELECT label, dim, avg(CAST(x AS DOUBLE)) AS x FROM e GROUP BY label, dim),
k AS (SELECT label, list(x ORDER BY dim) AS v FROM m GROUP BY label)"""


@query(f"WITH {NODES}, {SQL_CENTROIDS}, p AS (SELECT query_id, label FROM (SELECT query_id, k.label, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(q.v, k.v), 9) DESC, k.label) AS r FROM q, k) WHERE r <= 2) "
       "SELECT query_id, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT q.query_id, n.id, list_cosine_similarity(q.v, n.v) AS score, row_number() OVER (PARTITION BY q.query_id ORDER BY round(list_cosine_similarity(q.v, n.v), 9) DESC, n.id) AS rank FROM p JOIN q USING (query_id) JOIN n USING (label)) WHERE rank <= 10")  # fmt: skip
def cluster_pruned_topk(spark, sf_dir):
    view = retrieval.node_view(table(spark, sf_dir, "embeddings"))
    centres = clustering.centroids(view, "label")
    return shown(search.cluster_pruned(view, centres, retrieval.every_hundredth(view), 10, 2, "label"))


@query("WITH b AS (SELECT item_id, text, list_filter(regexp_split_to_array(lower(text), '[\\t\\n\\x0b\\x0c\\r ]+'), lambda x: x <> '') AS w FROM benchmark), d AS (SELECT doc_id, text, list_distinct(list_filter(regexp_split_to_array(lower(text), '[\\t\\n\\x0b\\x0c\\r ]+'), lambda x: x <> '')) AS w FROM documents), "
       "c AS (SELECT b.item_id, d.doc_id, b.w AS bw, d.w AS dw FROM b, d), o AS (SELECT item_id, doc_id, CAST(len(list_intersect(list_distinct(bw), dw)) AS DOUBLE) / len(list_distinct(list_concat(bw, dw))) AS overlap FROM c) "
       "SELECT query_id, id, round(overlap, 6) AS overlap, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT item_id AS query_id, doc_id AS id, overlap, 0.5 * 0.25 + 0.5 * overlap AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(0.5 * 0.25 + 0.5 * overlap, 9) DESC, doc_id) AS rank FROM o) WHERE rank <= 5")  # fmt: skip
def rerank_overlap(spark, sf_dir):
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    candidates = search.overlap_topk(docs, asked, 20).drop("overlap").join(docs, "id").join(asked, "query_id")
    found = search.rerank(candidates.withColumn("score", F.lit(0.25)), 5)
    return found.select("query_id", "id", F.round("overlap", 6).alias("overlap"), F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


@query("WITH b AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[\\t\\n\\x0b\\x0c\\r ]+'), lambda x: x <> '')) AS w FROM benchmark), d AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[\\t\\n\\x0b\\x0c\\r ]+'), lambda x: x <> '')) AS w FROM documents), "
       "o AS (SELECT item_id, doc_id, coalesce(CAST(len(list_intersect(b.w, d.w)) AS DOUBLE) / nullif(len(b.w) + len(d.w) - len(list_intersect(b.w, d.w)), 0), 0) AS overlap FROM b, d) "
       "SELECT query_id, id, round(overlap, 6) AS overlap, true AS within FROM (SELECT item_id AS query_id, doc_id AS id, overlap, row_number() OVER (PARTITION BY item_id ORDER BY round(overlap, 9) DESC, doc_id) AS r FROM o) WHERE r <= 5")  # fmt: skip
def indexed_overlap(spark, sf_dir):
    """The documents of largest word overlap with each benchmark item, through an inverted index; no more postings are read than there are."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    index = overlap_index.build(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content")))
    hits, counts = overlap_index.search(index, asked, 5)
    return hits.join(counts, "query_id").select("query_id", "id", F.round("overlap", 6).alias("overlap"), (F.col("read") <= F.col("postings")).alias("within"))


@query(f"""{SQL_TREE} SELECT a.query_id, string_agg('[' || a.rank || '] D' || s.parent_id || ' / S' || s.id || ' / U' || a.sub || ': ' || CASE WHEN length(d.text) > 300 THEN substr(d.text, 1, 300) || '...' ELSE d.text END, chr(10)
  ORDER BY a.rank, '[' || a.rank || '] D' || s.parent_id || ' / S' || s.id || ' / U' || a.sub || ': ' || CASE WHEN length(d.text) > 300 THEN substr(d.text, 1, 300) || '...' ELSE d.text END) AS context
  FROM a JOIN u ON u.query_id = a.query_id AND u.id = a.sub JOIN s ON s.query_id = a.query_id AND s.id = u.parent_id JOIN documents d ON d.doc_id = a.id GROUP BY a.query_id""")
def context_assembly(spark, sf_dir):
    found = hits(spark, sf_dir)["chunks"].join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content")), "id")
    named = {n: F.concat(F.lit(p), F.col(f"parent_{n}").cast("string")) for n, p in (("document", "D"), ("section", "S"), ("subsection", "U"))}
    return search.context(found.withColumns(named))


# ---- trees -----------------------------------------------------------------------------------------------------------

SQL_BLOCKS = """b AS (SELECT doc_id, (i - 1)::INT AS pos, CASE WHEN (i - 1) % 12 = 7 THEN 'Fig. ' || lines[i] ELSE lines[i] END AS text,
  CASE WHEN (i - 1) % 12 = 0 THEN 1 WHEN (i - 1) % 4 = 0 THEN 2 WHEN (i - 1) % 4 = 2 THEN 3 END AS level, CASE WHEN (i - 1) % 12 IN (3, 9) THEN 'table' ELSE 'paragraph' END AS kind
  FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents) t, LATERAL (SELECT unnest(range(1, len(lines) + 1)) AS i) u),
i1 AS (SELECT *, CAST(sum(CASE WHEN level = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS INTEGER) - 1 AS section_idx FROM b),
i2 AS (SELECT *, CAST(sum(CASE WHEN level = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, section_idx ORDER BY pos) AS INTEGER) - 1 AS subsection_idx FROM i1),
i3 AS (SELECT *, CAST(sum(CASE WHEN level = 3 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, section_idx, subsection_idx ORDER BY pos) AS INTEGER) - 1 AS subsubsection_idx FROM i2),
t AS (SELECT *, trim(text) AS clean, NOT (section_idx < 0 OR subsubsection_idx >= 0 AND subsection_idx < 0) AS attached FROM i3)"""
SQL_NODES = f"""{SQL_BLOCKS},
x AS (SELECT doc_id, section_idx, subsection_idx, subsubsection_idx, CASE WHEN subsubsection_idx >= 0 THEN 3 WHEN subsection_idx >= 0 THEN 2 ELSE 1 END AS level,
  max(CASE WHEN level IS NOT NULL THEN clean END) AS title, coalesce(string_agg(CASE WHEN level IS NULL THEN clean END, '' ORDER BY pos), '') AS text
  FROM t WHERE attached AND kind = 'paragraph' GROUP BY ALL)"""


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as blocks: lines, with headings, tables and captions at fixed places."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    at = F.col("pos") % 12
    level = F.when(at == 0, 1).when(F.col("pos") % 4 == 0, 2).when(F.col("pos") % 4 == 2, 3)
    return lines.select("doc_id", "pos", F.when(at == 7, F.concat(F.lit("Fig. "), "line")).otherwise(F.col("line")).alias("text"), level.alias("level"), F.when(at.isin(3, 9), "table").otherwise("paragraph").alias("kind"))


def with_images(placed: DataFrame) -> DataFrame:
    """``placed`` with an image in every twelfth block."""
    return placed.withColumn("images", F.when(F.col("pos") % 12 == 5, F.array(F.struct(F.lit("png").alias("ext"), F.encode(F.col("text"), "utf-8").alias("bytes")))))


@query(f"WITH {SQL_BLOCKS} SELECT doc_id, pos, level, section_idx, subsection_idx, subsubsection_idx, attached FROM t")
def heading_tree(spark, sf_dir):
    return structure.assign(blocks(spark, sf_dir)).select("doc_id", "pos", "level", *structure.INDEXES, "attached")


@query(f"WITH {SQL_NODES} SELECT doc_id, section_idx, subsection_idx, subsubsection_idx, level, title, text FROM x")
def node_text(spark, sf_dir):
    return structure.node_text(structure.assign(blocks(spark, sf_dir))).select("doc_id", *structure.INDEXES, "level", "title", "text")


@query(f"WITH {SQL_BLOCKS} SELECT doc_id, count(*) AS blocks, sum(length(text)) AS characters FROM t WHERE NOT attached GROUP BY doc_id")
def orphan_blocks(spark, sf_dir):
    return structure.orphans(structure.assign(blocks(spark, sf_dir)))


@query(f"""WITH {SQL_BLOCKS}, y AS (SELECT *, lag(kind) OVER w AS k, lag(level) OVER w AS l, lag(clean) OVER w AS c FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
z AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS INTEGER) AS table_number FROM y WHERE kind = 'table')
SELECT doc_id, pos, section_idx, subsection_idx, subsubsection_idx, table_number, CASE WHEN k = 'paragraph' AND l IS NULL THEN c ELSE '' END AS description FROM z WHERE attached""")
def table_entries(spark, sf_dir):
    return structure.table_entries(structure.assign(blocks(spark, sf_dir)))


@query(f"""WITH {SQL_BLOCKS}, y AS (SELECT *, lead(text, 1) OVER w AS a, lead(text, 2) OVER w AS b2, lead(text, 3) OVER w AS c FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
z AS (SELECT *, CASE WHEN regexp_matches(lower(trim(a)), '^(fig|note)') THEN trim(a) WHEN regexp_matches(lower(trim(b2)), '^(fig|note)') THEN trim(b2) WHEN regexp_matches(lower(trim(c)), '^(fig|note)') THEN trim(c) END AS figure_name FROM y)
SELECT z.doc_id, z.pos, z.figure_name, '<<<' || z.figure_name || '>>>' AS placeholder, coalesce((SELECT string_agg(p.clean, '' ORDER BY p.pos) FROM t p WHERE p.doc_id = z.doc_id AND p.section_idx = z.section_idx AND p.subsection_idx = z.subsection_idx AND p.subsubsection_idx = z.subsubsection_idx AND p.pos < z.pos AND p.kind = 'paragraph' AND p.level IS NULL), '') || z.clean AS last_paragraph, z.section_idx, z.subsection_idx, z.subsubsection_idx
FROM z WHERE attached AND figure_name IS NOT NULL AND pos % 12 = 5""")
def figure_captions(spark, sf_dir):
    found = structure.figures(with_images(structure.assign(blocks(spark, sf_dir))))
    return found.select("doc_id", "pos", "figure_name", "placeholder", "last_paragraph", *structure.INDEXES)


@query(f"""WITH {SQL_NODES}, p AS (SELECT *, 'content/' || section_idx || CASE WHEN subsection_idx >= 0 THEN '/subsections/' || subsection_idx ELSE '' END || CASE WHEN subsubsection_idx >= 0 THEN '/subsubsections/' || subsubsection_idx ELSE '' END AS path FROM x)
SELECT CAST(doc_id AS VARCHAR) AS document_name, path || '/title' AS path, 'title' AS kind, title AS text FROM p
UNION ALL SELECT CAST(doc_id AS VARCHAR), path || CASE WHEN level = 1 THEN '/description' ELSE '/text_content' END, CASE WHEN level = 1 THEN 'description' ELSE 'text_content' END, text FROM p""")
def flatten_paths(spark, sf_dir):
    tree = structure.assemble(structure.node_text(structure.assign(blocks(spark, sf_dir))))
    return structure.flatten(tree.select(F.col("doc_id").cast("string").alias("document_name"), "content"))


@query(f"WITH {NODES} SELECT level, count(*) AS n FROM n GROUP BY level")
def node_counts(spark, sf_dir):
    return stats.counts_by(retrieval.node_view(table(spark, sf_dir, "embeddings")), "level")


@query("SELECT lang, doc_id, CASE WHEN length(text) > 50 THEN substr(text, 1, 50) || '...' ELSE text END AS text FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents) WHERE r <= 3")
def class_samples(spark, sf_dir):
    return nodes.sampled(table(spark, sf_dir, "documents").select("lang", "doc_id", "text"), by="lang", id="doc_id").select("lang", "doc_id", "text")


@query(f"WITH {NODES}, p AS (SELECT id FROM n WHERE level IN ('subsection', 'subsubsection')) SELECT id, parent_id FROM n WHERE level = 'chunk' AND parent_id NOT IN (SELECT id FROM p WHERE id % 7 <> 0)")
def orphan_chunks(spark, sf_dir):
    view = retrieval.node_view(table(spark, sf_dir, "embeddings"))
    kept = view.where("id % 7 <> 0")
    found = nodes.orphan_chunks(view.where("level = 'chunk'"), kept.where("level = 'subsection'"), kept.where("level = 'subsubsection'"))
    return found.select("id", "parent_id")


@query(f"WITH {SQL_BLOCKS} SELECT doc_id, count(*) FILTER (pos % 12 = 5) AS figures, count(*) FILTER (kind = 'table') AS tables, count(*) FILTER (kind = 'paragraph' AND level IS NULL) AS paragraphs, count(*) FILTER (level IS NOT NULL) AS headings FROM t GROUP BY doc_id")
def block_counts(spark, sf_dir):
    return stats.block_counts(with_images(blocks(spark, sf_dir)))


# ---- tables ----------------------------------------------------------------------------------------------------------

SQL_CELLS = """c AS (SELECT doc_id, CAST(r - 1 AS INTEGER) AS row, CAST(k - 1 AS INTEGER) AS col, CASE WHEN (r + k) % 3 = 0 THEN '' ELSE words[k] END AS text FROM (
  SELECT doc_id, r, list_filter(string_split(lines[r], ' '), lambda x: x <> '') AS words FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), LATERAL (SELECT unnest(range(1, len(lines) + 1)) AS r) u),
  LATERAL (SELECT unnest(range(1, len(words) + 1)) AS k) v)"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as rows of tables: words are cells, every third cell is blank."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("row", "line"))
    words = F.filter(F.split("line", " "), lambda w: w != "")
    found = lines.select("doc_id", F.lit(0).alias("table_id"), "row", F.posexplode(words).alias("col", "text"))
    return found.withColumn("text", F.when((F.col("row") + F.col("col") + 2) % 3 == 0, "").otherwise(F.col("text")))


@query(f"""WITH {SQL_CELLS}, d AS (SELECT doc_id, row, col, last_value(nullif(trim(text), '') IGNORE NULLS) OVER (PARTITION BY doc_id, col ORDER BY row) AS text FROM c)
SELECT doc_id, row, col, last_value(text IGNORE NULLS) OVER (PARTITION BY doc_id, row ORDER BY col) AS text FROM d""")
def ffill_table(spark, sf_dir):
    return tables.forward_filled(cells(spark, sf_dir)).select("doc_id", "row", "col", "text")


@query(f"WITH {SQL_CELLS} SELECT doc_id, max(col) + 1 AS num_cols, max(row) + 1 AS num_rows FROM c GROUP BY doc_id HAVING max(row) + 1 > 8")
def table_profile(spark, sf_dir):
    found = tables.larger_than(cells(spark, sf_dir), 8)
    return tables.profile(found).select("doc_id", "num_cols", "num_rows")


@query(f"WITH {SQL_CELLS} SELECT doc_id, row, string_agg(CASE WHEN contains(text, ',') OR contains(text, '\"') THEN '\"' || replace(text, '\"', '\"\"') || '\"' ELSE text END, ',' ORDER BY col) AS line FROM c GROUP BY doc_id, row")
def table_csv(spark, sf_dir):
    return tables.delimited(cells(spark, sf_dir)).select("doc_id", "row", "line")


# ---- chunks and statistics -------------------------------------------------------------------------------------------

SQL_WINDOWS = """w AS (SELECT doc_id, CAST(i / 400 AS INTEGER) AS chunk_idx, substr(text, i + 1, 500) AS chunk FROM documents, LATERAL (SELECT unnest(range(0, greatest(length(text) - 100, 1), 400)) AS i) u WHERE length(text) > 0),
n AS (SELECT doc_id, count(*) AS n FROM w GROUP BY doc_id)"""


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.character_windows(table(spark, sf_dir, "documents").select("doc_id", "text"), 500, 100)


def window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.counts_by(windows(spark, sf_dir), "doc_id")


@query(f"WITH {SQL_WINDOWS} SELECT doc_id, chunk_idx, chunk FROM w")
def char_windows(spark, sf_dir):
    return windows(spark, sf_dir)


@query(f"WITH {SQL_WINDOWS}, l AS (SELECT len(list_filter(regexp_split_to_array(chunk, '[\\t\\n\\x0b\\x0c\\r ]+'), lambda x: x <> '')) AS n FROM w) SELECT CAST(floor(n / 10) * 10 AS BIGINT) AS low, count(*) AS chunks, count(*) FILTER (n <= 64) AS within FROM l GROUP BY 1")
def token_lengths(spark, sf_dir):
    return stats.token_lengths(windows(spark, sf_dir), 64, 10, "chunk")


@query(f"WITH {SQL_WINDOWS} SELECT count(*) AS documents, min(n) AS min, max(n) AS max, avg(n) AS mean, quantile_cont(n, 0.5) AS median, quantile_cont(n, 0.95) AS p95, quantile_cont(n, 0.99) AS p99, stddev(n) AS std FROM n")
def chunk_count_stats(spark, sf_dir):
    return stats.chunk_distribution(window_counts(spark, sf_dir))


@query(f"WITH {SQL_WINDOWS} SELECT CAST(floor(n / 5) * 5 AS BIGINT) AS low, count(*) AS documents FROM n GROUP BY 1")
def chunk_histogram(spark, sf_dir):
    return stats.histogram(window_counts(spark, sf_dir), 5)


@query(f"WITH {SQL_WINDOWS}, q AS (SELECT quantile_cont(n, 0.75) + 1.5 * (quantile_cont(n, 0.75) - quantile_cont(n, 0.25)) AS whisker FROM n) SELECT doc_id, n, whisker FROM n, q WHERE n > whisker")
def chunk_outliers(spark, sf_dir):
    return stats.outliers(window_counts(spark, sf_dir))


@query(f"WITH {SQL_WINDOWS}, q AS (SELECT quantile_cont(n, 0.95) AS threshold FROM n) SELECT threshold, avg(CAST(n >= threshold AS INTEGER)) AS share FROM n, q GROUP BY threshold")
def heavy_share(spark, sf_dir):
    return stats.heavy_share(window_counts(spark, sf_dir))


@query(f"WITH {SQL_WINDOWS} SELECT doc_id, chunk_idx, row_number() OVER (ORDER BY CAST(doc_id AS VARCHAR), chunk_idx) - 1 AS chunk_number FROM w")
def chunk_numbering(spark, sf_dir):
    return chunking.numbered(windows(spark, sf_dir), "doc_id").select("doc_id", "chunk_idx", "chunk_number")


@query()
def recursive_chunks(spark, sf_dir):
    return chunking.recursive_chunks(table(spark, sf_dir, "documents").select("doc_id", "text"), 120, 20)


@query("SELECT doc_id, true AS same FROM documents WHERE trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)) <> ''")
def long_text_chunks(spark, sf_dir):
    """Chunks of texts of any length, those of more than 15,000 characters split by many tasks together, beside the splitter's in one task."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    apart = long_texts.chunks_of_any_length(docs, 120, 20, longer_than=15_000, grid=10_000)
    digests = lambda chunks, name: chunks.select("doc_id", "chunk_idx", F.md5("chunk").alias(name))
    both = digests(apart, "digest").join(digests(chunking.recursive_chunks(docs, 120, 20), "other"), ["doc_id", "chunk_idx"], "full")
    return both.groupBy("doc_id").agg(F.bool_and(F.coalesce(F.col("digest") == F.col("other"), F.lit(False))).alias("same"))


@query()
def sql_chunks(spark, sf_dir):
    """The splitter from SQL."""
    chunking.register_split_text(spark)
    docs = table(spark, sf_dir, "documents")
    return spark.sql("SELECT d.doc_id, s.chunk_idx, s.chunk FROM {docs} d, LATERAL split_text(d.text, 120, 20) s", docs=docs)


@query()
def tree_chunks(spark, sf_dir):
    found = chunking.tree_chunks(structure.node_text(structure.assign(blocks(spark, sf_dir))), 60, 10)
    return found.select("doc_id", *structure.INDEXES, F.posexplode("chunks").alias("chunk_idx", "chunk"))


SQL_TREE_WINDOWS = f"""WITH {SQL_NODES}, whole AS (SELECT doc_id, unnest(range(0, greatest(length(text) - 100, 1), 400)) AS i FROM documents WHERE length(text) > 0),
below AS (SELECT doc_id, unnest(range(0, greatest(length(text) - 100, 1), 400)) AS i FROM x WHERE level > 1 AND length(text) > 0)"""


@query(f"""{SQL_TREE_WINDOWS} SELECT a.flat_vectors, a.flat_per_document, a.flat_bytes, b.tree_vectors, b.tree_per_document, b.tree_bytes, 100 * (1 - b.tree_bytes / a.flat_bytes) AS saved_percent
FROM (SELECT count(*) AS flat_vectors, count(*) / count(DISTINCT doc_id) AS flat_per_document, CAST(256 * count(*) AS BIGINT) AS flat_bytes FROM whole) a, (SELECT count(*) AS tree_vectors, count(*) / count(DISTINCT doc_id) AS tree_per_document, CAST(256 * count(*) AS BIGINT) AS tree_bytes FROM below) b""")
def store_comparison(spark, sf_dir):
    """The chunks of whole texts beside those below the sections of their trees, a vector of 64 numbers for each."""
    below = structure.node_text(structure.assign(blocks(spark, sf_dir))).where("level > 1").select("doc_id", *structure.INDEXES, "text")
    with_vector = lambda chunks: chunks.select("doc_id", F.array_repeat(F.length("chunk").cast("float"), 64).alias("vector"))
    return stats.store_comparison(with_vector(windows(spark, sf_dir)), with_vector(chunking.character_windows(below, 500, 100)))


SQL_WORD_LENGTHS = "v AS (SELECT source, length(text) / CAST(length(text) - length(replace(text, ' ', '')) + 1 AS DOUBLE) AS v FROM documents)"
SHARES = [0.0, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0]


def word_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, v): characters of each document for each of its words."""
    n = F.length("text")
    return table(spark, sf_dir, "documents").select("source", (n / (n - F.length(F.replace("text", F.lit(" "), F.lit(""))) + 1).cast("double")).alias("v"))


@query(f"WITH {SQL_WORD_LENGTHS} SELECT source, count(v) AS n, quantile_cont(v, {SHARES}) AS quantiles FROM v GROUP BY source HAVING count(v) > 0")
def source_quantiles(spark, sf_dir):
    """How long words are in the documents of each source: exact quantiles."""
    return quantiles.exact_quantiles(word_lengths(spark, sf_dir), "v", SHARES, ("source",))


@query(f"WITH {SQL_WORD_LENGTHS} SELECT count(v) AS n, quantile_cont(v, {SHARES}) AS quantiles FROM v HAVING count(v) > 0")
def corpus_quantiles(spark, sf_dir):
    """The same over all documents."""
    return quantiles.exact_quantiles(word_lengths(spark, sf_dir), "v", SHARES)


# ---- vectors and clusters --------------------------------------------------------------------------------------------


@query("SELECT count(DISTINCT embedding) AS vectors FROM embeddings")
def distinct_vectors(spark, sf_dir):
    return stats.distinct_vector_count(table(spark, sf_dir, "embeddings"), vector="embedding")


@query("SELECT count(DISTINCT text) AS texts, count(*) AS rows FROM documents")
def dedup_encode(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    seen = embedding.encode_distinct(docs, lambda t: t.withColumn("vector", F.xxhash64("text")))
    return seen.agg(F.count_distinct("vector").alias("texts"), F.count("vector").alias("rows"))


@query()
def hashed_vectors(spark, sf_dir):
    return embedding.hashed_vectors(table(spark, sf_dir, "documents").select("doc_id", "text"), 64).select("doc_id", "vector")


@query("""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\\t\\n\\x0b\\x0c\\r ]+'), lambda x: x <> '') AS w FROM documents),
c AS (SELECT doc_id, CAST(i AS INTEGER) AS chunk_idx, array_to_string(list_slice(w, 256 * i + 1, 256 * i + 256), ' ') AS c FROM w, LATERAL (SELECT unnest(range(0, greatest(0, (len(w) - 1) // 256) + 1)) AS i) u)
SELECT doc_id, chunk_idx, [CAST(length(c) AS FLOAT), CAST(length(c) - length(replace(c, ' ', '')) AS FLOAT), CAST(length(c) - length(replace(c, 'e', '')) AS FLOAT)] AS vector FROM c""")
def encoded_texts(spark, sf_dir):
    def load():
        def model(texts: list[str]) -> np.ndarray:
            return np.array([[len(t), t.count(" "), t.count("e")] for t in texts], np.float32)

        return model

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chunks = embedding.word_chunks(docs, 256).drop("text")
    return embedding.encode(chunks, load, max_tokens=256, text="chunk").select("doc_id", "chunk_idx", "vector")


@query("SELECT 'width' AS issue, count(*) AS n FROM embeddings WHERE vec_id % 11 = 3 UNION ALL SELECT 'missing', count(*) FROM embeddings WHERE vec_id % 13 = 5 AND vec_id % 11 <> 3")
def vector_issues(spark, sf_dir):
    broken = F.when(F.col("vec_id") % 11 == 3, F.slice("embedding", 1, 10)).when(F.col("vec_id") % 13 != 5, F.col("embedding"))
    found = embedding.vector_issues(table(spark, sf_dir, "embeddings").withColumn("vector", broken))
    return found.where("issue is not null").groupBy("issue").agg(F.count("*").alias("n"))


@query(f"WITH {NODES}, g AS (SELECT id, parent_id, v, dense_rank() OVER (PARTITION BY parent_id ORDER BY v) - 1 AS r, (SELECT count(DISTINCT m.v) FROM n m WHERE m.parent_id = n.parent_id) AS k FROM n WHERE parent_id IS NOT NULL) SELECT id, parent_id, CAST(CASE WHEN k <= 3 THEN r END AS INTEGER) AS cluster FROM g")
def small_group_labels(spark, sf_dir):
    view = retrieval.node_view(table(spark, sf_dir, "embeddings")).where("parent_id is not null")
    return clustering.small_groups(view).select("id", "parent_id", F.col("cluster").cast("int").alias("cluster"))


@query(f"WITH {SQL_CENTROIDS} SELECT label, dim, round(x, 9) AS x FROM m")
def centroids(spark, sf_dir):
    found = clustering.centroids(table(spark, sf_dir, "embeddings"), "label", "embedding")
    return found.select("label", F.posexplode("embedding").alias("dim", "x")).withColumn("x", F.round("x", 9))


@query(f"WITH {SQL_CENTROIDS}, d AS (SELECT vec_id AS id, k.label, round(list_sum(list_transform(list_zip(CAST(embedding AS DOUBLE[]), k.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 9) AS distance FROM embeddings, k) SELECT id, label, distance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, label) AS r FROM d) WHERE r = 1")
def nearest_centroid(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"))
    return clustering.nearest_centroid(vectors, clustering.centroids(vectors, "label"), "label")


@query("SELECT count(*) AS clusters, avg(n) AS mean_size, min(n) AS smallest, max(n) AS largest FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label)")
def cluster_sizes(spark, sf_dir):
    return stats.cluster_summary(table(spark, sf_dir, "embeddings"), "label")


@query("SELECT label AS l1, CAST(vec_id % 3 AS INTEGER) AS l2, count(*) AS n FROM embeddings GROUP BY GROUPING SETS ((l1), (l1, l2))")
def cluster_rollup(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("l1"), (F.col("vec_id") % 3).cast("int").alias("l2"))
    return clustering.sizes(rows, ("l1", "l2")).withColumnRenamed("count", "n")


@query()
def kmeans_parent(spark, sf_dir):
    view = retrieval.node_view(table(spark, sf_dir, "embeddings")).withColumn("parent_id", F.coalesce("parent_id", "doc_id"))
    return clustering.per_parent(view.where("level in ('section', 'chunk')"), 2)


@query()
def kmeans_three_level(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return clustering.three_levels(vectors, 8, 4, 3).drop("vector")


# ---- conversations ---------------------------------------------------------------------------------------------------

SQL_TURNS = """o AS (SELECT conv_id, coalesce(string_agg(CASE WHEN role = 'system' THEN text END, chr(10) ORDER BY turn), '') AS system FROM conversations GROUP BY conv_id),
s AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations WHERE role <> 'system')"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


@query("SELECT conv_id, array_to_string(list(role || ': ' || text ORDER BY turn), chr(10)) AS context FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 6 GROUP BY conv_id")
def last_n_context(spark, sf_dir):
    found = chat.last_messages(messages(spark, sf_dir))
    return found.select("conv_id", F.array_join(F.transform("context", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n").alias("context"))


@query("SELECT a.conv_id, a.turn, a.text AS message, coalesce(string_agg(b.role || ': ' || b.text, chr(10) ORDER BY b.turn), '') AS history FROM conversations a LEFT JOIN (SELECT * FROM conversations) b ON b.conv_id = a.conv_id AND b.turn < a.turn AND (SELECT count(*) FROM conversations c WHERE c.conv_id = a.conv_id AND c.turn >= b.turn AND c.turn < a.turn) <= 6 WHERE a.role = 'user' GROUP BY ALL")
def turn_context(spark, sf_dir):
    found = chat.turn_contexts(messages(spark, sf_dir))
    return found.select("conv_id", "turn", "message", F.array_join(F.transform("history", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n").alias("history"))


@query(f"WITH {SQL_TURNS} SELECT a.conv_id, CAST(a.i / 2 AS INTEGER) AS pair, a.text AS user, b.text AS assistant FROM s a LEFT JOIN s b ON b.conv_id = a.conv_id AND b.i = a.i + 1 WHERE a.i % 2 = 0")
def turn_pairs(spark, sf_dir):
    found = chat.ordered(messages(spark, sf_dir)).select("conv_id", F.posexplode(chat.pairs(F.col("texts"))).alias("pair", "p"))
    return found.select("conv_id", "pair", "p.user", "p.assistant")


def sql_prompt(template: str) -> str:
    t = chat.TEMPLATES[template]
    quote = lambda x: "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    user, bot, sep, sep2 = map(quote, (*t["roles"], *t["seps"]))
    role, after = f"CASE WHEN i % 2 = 0 THEN {user} ELSE {bot} END", f"CASE WHEN i % 2 = 0 THEN {sep} ELSE {sep2} END"
    said = {"deepseek": f"({role}) || ': ' || text || ({after})", "llama2": f"CASE WHEN i = 0 THEN text || ' ' ELSE ({role}) || ' ' || text || ({after}) END", "plain": f"text || ({after})", "alignment": f"CASE WHEN i % 2 = 0 THEN {quote(chat.IMAGE)} ELSE text END || ({after})"}[t["style"]]
    none = {"deepseek": f"({role}) || ':'", "llama2": role}.get(t["style"], "''")
    head = {"deepseek": f"CASE WHEN system = '' THEN '' ELSE system || {sep} END", "llama2": f"CASE WHEN system = '' THEN '[INST] ' ELSE replace({quote(t['system'])}, '{{system_message}}', system) END"}.get(t["style"], "''")
    return f"WITH {SQL_TURNS} SELECT o.conv_id, {head} || coalesce(string_agg(CASE WHEN text IS NULL OR text = '' THEN {none} ELSE {said} END, '' ORDER BY i), '') AS prompt FROM o LEFT JOIN s USING (conv_id) GROUP BY o.conv_id, o.system"


def prompt_query(template: str) -> Query:
    def run(spark, sf_dir):
        found = chat.ordered(messages(spark, sf_dir))
        return found.select("conv_id", chat.prompt(F.col("texts"), F.col("system"), template).alias("prompt"))

    return run


for _name in chat.TEMPLATES:
    QUERIES[f"chat_prompt_{_name.replace('-', '')}"] = prompt_query(_name)
    ORACLES[f"chat_prompt_{_name.replace('-', '')}"] = sql_prompt(_name)


@query(f"WITH {SQL_TURNS} SELECT conv_id, CAST(i + 1 AS INTEGER) AS place, CASE WHEN i % 2 = 0 THEN 'user' ELSE 'assistant' END AS role, text AS content FROM s WHERE i % 2 = 0 OR text IS NOT NULL UNION ALL SELECT conv_id, 0, 'system', system FROM o")
def chat_messages(spark, sf_dir):
    found = chat.ordered(messages(spark, sf_dir))
    return found.select("conv_id", F.posexplode(chat.message_array(F.col("texts"), F.col("system"))).alias("place", "m")).select("conv_id", "place", "m.role", "m.content")


@query("SELECT conv_id, turn, 'User: ' || trim(text) || chr(10) || chr(10) || 'Assistant:' AS prompt FROM conversations WHERE role = 'user'")
def current_round(spark, sf_dir):
    return messages(spark, sf_dir).where("role = 'user'").select("conv_id", "turn", chat.current_round(F.col("text")).alias("prompt"))


@query("""SELECT conv_id, turn, 1 + (SELECT count(*) FROM (SELECT 1 FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn < a.turn LIMIT 6)) AS messages, text AS last, 2000 AS max_tokens, 0.5 AS temperature FROM conversations a WHERE role = 'user'""")
def llm_requests(spark, sf_dir):
    found = chat.requests(chat.turn_contexts(messages(spark, sf_dir)))
    body = F.from_json("request", "messages array<struct<role string, content string>>, settings struct<max_tokens int, temperature double>")
    return found.withColumn("b", body).select("conv_id", "turn", F.size("b.messages").cast("long").alias("messages"), F.element_at("b.messages", -1)["content"].alias("last"), "b.settings.max_tokens", "b.settings.temperature")


@query("SELECT user_id, min(ts) AS created_at, max(ts) AS last_at, count(*) AS messages FROM events GROUP BY user_id")
def conversation_list(spark, sf_dir):
    return chat.conversation_list(table(spark, sf_dir, "events"), "user_id")


@query("SELECT user_id, last_at, CASE WHEN last_at >= DATE '2024-01-30' THEN 'Today' WHEN last_at >= DATE '2024-01-29' THEN 'Yesterday' WHEN last_at >= DATE '2024-01-23' THEN 'Last 7 Days' ELSE 'Older' END AS date_group, CASE WHEN last_at >= DATE '2024-01-30' THEN 1 WHEN last_at >= DATE '2024-01-29' THEN 2 WHEN last_at >= DATE '2024-01-23' THEN 3 ELSE 4 END AS group_order FROM (SELECT user_id, max(ts) AS last_at FROM events GROUP BY user_id)")
def date_buckets(spark, sf_dir):
    listed = chat.conversation_list(table(spark, sf_dir, "events"), "user_id")
    return chat.grouped_by_date(listed, F.lit("2024-01-30").cast("date")).select("user_id", "last_at", "date_group", "group_order")


@query("SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 600 SECOND AS end, count(*) AS requests FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 600 SECOND THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s")
def idle_sessions(spark, sf_dir):
    return chat.busy_sessions(table(spark, sf_dir, "events"))


def titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.conversation_list(messages(spark, sf_dir), ts="turn", text="text").select("conv_id", "title")


SQL_TITLED = "c AS (SELECT conv_id, upper(substr(string_split(arg_min(text, turn), chr(10))[1], 1, 1)) || lower(substr(string_split(arg_min(text, turn), chr(10))[1], 2)) AS title FROM conversations GROUP BY conv_id)"


@query(f"WITH {SQL_TITLED} SELECT conv_id, CASE WHEN conv_id % 5 = 0 THEN 'Title ' || conv_id ELSE title END AS title FROM c")
def rename_conversations(spark, sf_dir):
    listed = titled(spark, sf_dir)
    updates = listed.where("conv_id % 5 = 0").select((F.col("conv_id")).alias("conv_id"), F.concat(F.lit("Title "), F.col("conv_id").cast("string")).alias("title"))
    return chat.renamed(listed, updates)[0]


@query("SELECT conv_id, count(*) AS messages FROM conversations WHERE conv_id % 4 <> 1 GROUP BY conv_id")
def delete_cascade(spark, sf_dir):
    m = messages(spark, sf_dir)
    listed = m.select("conv_id").distinct()
    _, left, _ = chat.deleted(listed, m, listed.where("conv_id % 4 = 1"))
    return left.groupBy("conv_id").agg(F.count("*").alias("messages"))


@query(f"WITH {SQL_TITLED} SELECT conv_id, title FROM c")
def title_cleanup(spark, sf_dir):
    return titled(spark, sf_dir)


# ---- text functions --------------------------------------------------------------------------------------------------


@query("SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#039;') AS escaped FROM pages")
def escape_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.escape_html(F.col("html")).alias("escaped"))


SQL_MARKDOWN = "text"
for _pattern, _out in (("`([^`]+)`", "<code>\\1</code>"), ("\\*\\*([^*]+)\\*\\*", "<strong>\\1</strong>"), ("\\*([^*]+)\\*", "<em>\\1</em>"), ("(?m)^### (.*$)", "<h3>\\1</h3>"), ("(?m)^## (.*$)", "<h2>\\1</h2>"), ("(?m)^# (.*$)", "<h1>\\1</h1>"), ("(?m)^- (.*$)", "<li>\\1</li>"), ("\\[([^\\]]+)\\]\\(([^)]+)\\)", '<a href="\\2">\\1</a>')):
    SQL_MARKDOWN = f"regexp_replace({SQL_MARKDOWN}, '{_pattern}', '{_out}', 'g')"


@query(f"SELECT conv_id, turn, replace(CASE WHEN role = 'assistant' THEN {SQL_MARKDOWN} ELSE text END, chr(10), '<br>') AS html FROM (SELECT conv_id, turn, role, '# ' || text || chr(10) || '- **' || role || '** `x` [a](b)' AS text FROM conversations)")
def markdown_html(spark, sf_dir):
    rows = messages(spark, sf_dir).withColumn("text", F.concat(F.lit("# "), "text", F.lit("\n- **"), "role", F.lit("** `x` [a](b)")))
    return rows.select("conv_id", "turn", X.markdown_html(F.col("text"), F.col("role")).alias("html"))


@query("SELECT doc_id, CASE WHEN b < 1024 THEN b || ' Bytes' WHEN b < 1048576 THEN regexp_replace(printf('%.2f', round(b / 1024.0, 2)), '\\.?0+$', '') || ' KB' ELSE regexp_replace(printf('%.2f', round(b / 1048576.0, 2)), '\\.?0+$', '') || ' MB' END AS size FROM (SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS b FROM documents)")
def file_size(spark, sf_dir):
    sized = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").alias("b"))
    return sized.select("doc_id", X.human_size(F.col("b")).alias("size"))


@query("SELECT page_id, ext, CASE WHEN ext IN ('jpg', 'jpeg') THEN 'image/jpeg' WHEN ext IN ('png', 'bmp', 'gif', 'tiff', 'webp') THEN 'image/' || ext WHEN ext IN ('wmf', 'emf') THEN 'image/x-' || ext END AS mime, CASE WHEN ext IN ('jpg', 'jpeg', 'png', 'bmp', 'gif', 'tiff', 'webp') THEN 'keep' ELSE 'convert' END AS route FROM (SELECT page_id, (['jpg', 'jpeg', 'png', 'bmp', 'gif', 'tiff', 'webp', 'wmf', 'emf', 'svg'])[page_id % 10 + 1] AS ext FROM pages)")
def mime_route(spark, sf_dir):
    kinds = F.array(*map(F.lit, [*X.MIME_TYPES, "svg"]))
    rows = table(spark, sf_dir, "pages").select("page_id", F.element_at(kinds, (F.col("page_id") % 10 + 1).cast("int")).alias("ext"))
    return rows.select("page_id", "ext", X.mime_type(F.concat(F.lit("."), F.upper("ext"))).alias("mime"), X.image_route(F.col("ext")).alias("route"))


# ---- validation ------------------------------------------------------------------------------------------------------

#: What is wrong with a document's JSON, by doc_id % 8: nothing, no name, content a string, a number for the first section, titles without
#: a text, subsections without a title, cut short, chunks without a text.
SQL_ISSUES = f"""{SQL_NODES},
i AS (SELECT doc_id, 'Missing ''document_name'' field' AS message FROM documents WHERE doc_id % 8 = 1
  UNION ALL SELECT doc_id, chr(39) || 'content'' field is not a list' FROM documents WHERE doc_id % 8 = 2
  UNION ALL SELECT doc_id, 'Section 0 is not a dictionary' FROM documents WHERE doc_id % 8 = 3
  UNION ALL SELECT doc_id, 'Section ' || section_idx || ' has malformed title dictionary (missing ''title'' key)' FROM x WHERE level = 1 AND doc_id % 8 = 4
  UNION ALL SELECT doc_id, 'Section ' || section_idx || ' has invalid title embedding format' FROM x WHERE level = 1 AND doc_id % 8 = 4
  UNION ALL SELECT doc_id, 'Subsection ' || subsection_idx || ' in section ' || section_idx || ' is missing ''title'' field' FROM x WHERE level = 2 AND doc_id % 8 = 5
  UNION ALL SELECT doc_id, 'unreadable JSON' FROM documents WHERE doc_id % 8 = 6
  UNION ALL SELECT doc_id, 'Chunk 0 in subsection ' || subsection_idx || ', section ' || section_idx || ' is missing content field' FROM x WHERE level = 2 AND doc_id % 8 = 7
  UNION ALL SELECT doc_id, 'Chunk 0 in subsection ' || subsection_idx || ', section ' || section_idx || ' has invalid embedding format' FROM x WHERE level = 2 AND doc_id % 8 = 7)"""


def json_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree of every document as JSON, damaged by a rule."""
    tree = structure.assemble(structure.node_text(structure.assign(blocks(spark, sf_dir))))
    name, content = F.col("doc_id").cast("string").alias("document_name"), F.col("content")
    as_json = lambda c: F.to_json(F.struct(name, c.alias("content")))
    no_titles = F.transform(content, lambda s: s.withField("title", F.struct(F.lit("x").alias("embedding"))))
    below = lambda change: F.transform(content, lambda s: s.withField("subsections", F.transform(s["subsections"], change)))
    number_first = F.concat(F.lit('{"document_name":"D","content":[7,'), F.substring(F.to_json(content), F.lit(2), F.length(F.to_json(content))), F.lit("}"))
    rules = [
        as_json(content), F.to_json(F.struct("content")), as_json(F.lit("none")), number_first, as_json(no_titles), as_json(below(lambda u: u.dropFields("title"))),
        F.substring(as_json(content), F.lit(1), F.length(as_json(content)) - 1), as_json(below(lambda u: u.withField("chunks", F.array(F.struct(F.lit(1).alias("embedding")))))),
    ]
    value = F.coalesce(*(F.when(F.col("doc_id") % 8 == k, rule) for k, rule in enumerate(rules)))
    return tree.select(F.concat(F.lit("in/"), F.col("doc_id").cast("string"), F.lit(".json")).alias("file_name"), value.alias("value"))


@query(f"WITH {SQL_ISSUES} SELECT 'in/' || doc_id || '.json' AS file, message FROM i")
def validate_issues(spark, sf_dir):
    return validation.issues(json_files(spark, sf_dir)).select("file", "message")


@query(f"WITH {SQL_ISSUES} SELECT 'in/' || doc_id || '.json' AS file, regexp_replace(message, '[0-9]+', 'n', 'g') AS kind, count(*) AS count FROM i GROUP BY ALL")
def issue_counts(spark, sf_dir):
    return validation.issue_counts(validation.issues(json_files(spark, sf_dir)))


@query(f"WITH {SQL_ISSUES}, c AS (SELECT d.doc_id, (SELECT count(*) FROM i WHERE i.doc_id = d.doc_id) AS n FROM documents d) SELECT count(*) AS processed, count(*) FILTER (doc_id % 8 <> 6) AS successful, count(*) FILTER (doc_id % 8 = 6) AS failed, count(*) FILTER (doc_id % 8 <> 6 AND n > 0) AS fixed FROM c")
def repair_status(spark, sf_dir):
    return validation.run_summary(validation.checked_again(json_files(spark, sf_dir)))


# ---- streams ---------------------------------------------------------------------------------------------------------


def drained(spark: SparkSession, rows: DataFrame, mode: str, name: str) -> DataFrame:
    """What a stream has written once all of its input is read: each batch is appended with its number."""
    out = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/rows/_b={number}")

    rows.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/rows").drop("_b")


def newest(rows: DataFrame, key: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc("_batch"))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_batch")


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    known = table(spark, sf_dir, name)
    return spark.readStream.schema(known.schema).parquet(f"{sf_dir}/{name}.parquet*")


@query("SELECT user_id, min(ts) AS created_at, max(ts) AS last_at, count(*) AS messages FROM events GROUP BY user_id")
def stream_conversations(spark, sf_dir):
    events = stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    written = drained(spark, live.live_conversations(events, "user_id", "ts", "event_id", "60 days"), "update", "conversations")
    return live.current_list(written, "user_id").select("user_id", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("created_at", "last_at")), "messages")


@query("SELECT conv_id, array_to_string(list(role || ': ' || text ORDER BY turn), chr(10)) AS context FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 6 GROUP BY conv_id")
def stream_context(spark, sf_dir):
    found = newest(drained(spark, live.rolling_context(stream(spark, sf_dir, "conversations")), "update", "context"), "conv_id")
    return found.select("conv_id", F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(": "), t)), "\n").alias("context"))


@query(ORACLES["idle_sessions"])
def stream_sessions(spark, sf_dir):
    stamped = lambda events: events.withColumn("ts", F.col("ts").cast("timestamp"))
    written = drained(spark, live.live_sessions(stamped(stream(spark, sf_dir, "events"))), "append", "sessions").drop("_batch")
    found = live.flushed(written, stamped(table(spark, sf_dir, "events")))
    return found.select("user_id", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("start", "end")), "requests")


# ---- the queries of the other modules ----------------------------------------------------------------------------------

from docstrata import queries_files, queries_text  # noqa: E402, F401
