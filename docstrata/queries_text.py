"""Registered queries over text functions, filters, vectors and clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from docstrata.functions import text as X
from docstrata.operators import chat, clustering, embedding, nodes
from docstrata.registry import query, table

SQL_KINDS = """k AS (SELECT conv_id, turn, CASE turn % 6 WHEN 0 THEN turn || chr(9) || 'Scope' WHEN 1 THEN '' WHEN 2 THEN turn || chr(9) || 'References' WHEN 3 THEN 'An Introduction' WHEN 4 THEN text END AS title FROM conversations)"""


def titled(spark, sf_dir):
    """Messages as sections: scopes, empty titles, references, introductions, plain texts and nulls."""
    n = F.col("turn") % 6
    title = F.when(n == 0, F.concat(F.col("turn").cast("string"), F.lit("\tScope"))).when(n == 1, "").when(n == 2, F.concat(F.col("turn").cast("string"), F.lit("\tReferences"))).when(n == 3, "An Introduction").when(n == 4, F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", title.alias("title"))


@query(f"WITH {SQL_KINDS} SELECT conv_id, turn, contains(title, chr(9) || 'Scope') AS scope FROM k WHERE contains(title, chr(9) || 'Scope')")
def scope_sections(spark, sf_dir):
    return titled(spark, sf_dir).where(nodes.is_scope(F.col("title"))).select("conv_id", "turn", nodes.is_scope(F.col("title")).alias("scope"))


@query(f"WITH {SQL_KINDS} SELECT conv_id, turn, title FROM k WHERE length(title) > 0 AND NOT contains(title, chr(9) || 'Scope') AND NOT contains(title, chr(9) || 'References') AND NOT contains(title, 'Introduction') AND NOT contains(title, 'Foreword')")
def searchable_sections(spark, sf_dir):
    """Sections that are no boilerplate."""
    return titled(spark, sf_dir).where(~nodes.boilerplate(F.col("title")))


@query("SELECT conv_id, turn, blank FROM (SELECT conv_id, turn, coalesce(length(regexp_replace(CASE turn % 4 WHEN 0 THEN ' ' || chr(160) || chr(10) WHEN 1 THEN chr(9) || text WHEN 2 THEN text END, '[\\s\\x{A0}]', '', 'g')) = 0, true) AS blank FROM conversations)")
def blank_texts(spark, sf_dir):
    n = F.col("turn") % 4
    text = F.when(n == 0, " \xa0\n").when(n == 1, F.concat(F.lit("\t"), "text")).when(n == 2, F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.is_blank(text).alias("blank"))


@query("WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'chunk' ELSE 'title' END AS kind, CASE turn % 5 WHEN 0 THEN '...' WHEN 1 THEN '...' WHEN 2 THEN '' WHEN 3 THEN NULL ELSE text END AS text FROM conversations) SELECT conv_id, turn, kind, text FROM t WHERE length(text) > 0 AND NOT (kind = 'chunk' AND text = '...')")
def embeddable_texts(spark, sf_dir):
    """Texts that get a vector: neither empty nor, for chunks, an ellipsis."""
    n = F.col("turn") % 5
    text = F.when(n <= 1, "...").when(n == 2, "").when(n == 4, F.col("text"))
    return embedding.embeddable(table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, "chunk").otherwise("title").alias("kind"), text.alias("text")))


@query("SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'Image file is required' WHEN page_id % 5 = 0 THEN 'Message prompt is required' WHEN octet_length(encode(html)) > 900 THEN 'Image file too large (max 10MB)' ELSE 'ok' END AS status FROM pages")
def admitted_images(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    images = pages.select("page_id", F.when(F.col("page_id") % 7 != 0, F.encode("html", "utf-8")).alias("image_bytes"), F.when(F.col("page_id") % 5 != 0, F.col("url")).alias("message"))
    return chat.admitted_images(images, 900).select("page_id", "status")


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'No message provided' ELSE 'ok' END AS reason FROM conversations")
def accepted_messages(spark, sf_dir):
    """Messages with a text, and blank ones with the reason why they are rejected."""
    rows = table(spark, sf_dir, "conversations").withColumn("text", F.when(F.col("turn") % 3 == 0, " \n").otherwise(F.col("text")))
    good, bad = chat.accepted(rows)
    return good.select("conv_id", "turn", F.lit("ok").alias("reason")).unionByName(bad.select("conv_id", "turn", "reason"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0.25 ELSE 0.5 END AS temperature, CASE WHEN event_id % 4 = 0 THEN CAST(json_extract(props, '$.k') AS INTEGER) ELSE 2000 END AS "maxTokens", 1.0 AS "topP", CASE WHEN event_id % 5 = 0 THEN 9 ELSE 5 END AS "topK", 6 AS "contextLength",
CASE WHEN event_id % 2 = 0 THEN 'Be brief.' ELSE 'You''re a helpful assistant.' END AS "systemPrompt" FROM events""")
def request_settings(spark, sf_dir):
    """Settings from JSON in camel and snake case, with defaults for what is missing or unreadable."""
    k = F.get_json_object("props", "$.k")
    pieces = [F.when(F.col("event_id") % 3 == 0, '"temperature": 0.25'), F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('"maxTokens": '), k)), F.when(F.col("event_id") % 5 == 0, '"top_k": 9'), F.lit('"topP": "high"'), F.when(F.col("event_id") % 2 == 0, '"systemPrompt": "Be brief."')]
    raw = F.concat(F.lit("{"), F.concat_ws(", ", *pieces), F.lit("}"))
    return table(spark, sf_dir, "events").select("event_id", chat.settings(raw).alias("s")).select("event_id", "s.*")


@query("""SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN text WHEN 1 THEN text ELSE '' END AS title, CASE turn % 4 WHEN 1 THEN CAST(turn AS FLOAT) WHEN 2 THEN CAST(turn AS FLOAT) END AS v FROM conversations""")
def text_or_struct(spark, sf_dir):
    """Titles that are a string, an object with a title and a vector, an object without a title, or a number."""
    n, vector = F.col("turn") % 4, F.array(F.col("turn")).alias("embedding")
    raw = F.when(n == 0, F.to_json(F.struct("text"))).when(n == 1, F.to_json(F.struct(F.struct(F.col("text").alias("title"), vector).alias("text")))).when(n == 2, F.to_json(F.struct(F.struct(vector).alias("text")))).otherwise('{"text": 7}')
    value = F.try_variant_get(F.parse_json(raw), "$.text", "variant")
    title, found = nodes.text_or_struct(value, "title")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", title.alias("title"), F.get(found, F.lit(0)).alias("v"))


@query("SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN text WHEN 1 THEN role ELSE '' END AS content FROM conversations")
def chunk_contents(spark, sf_dir):
    """The text of chunks that call it chunk, content, or have neither."""
    n = F.col("turn") % 3
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", nodes.chunk_text(F.when(n == 0, F.col("text")), F.when(n == 1, F.col("role"))).alias("content"))


@query("SELECT conv_id, turn, trim(replace(text, 'e', ' ')) AS clean, replace(text, 'e', ' ') AS spaced FROM conversations")
def cleaned_texts(spark, sf_dir):
    """No-break spaces as blanks, and texts without white space at their ends."""
    wide = F.concat(F.lit("\xa0 \t"), F.replace("text", F.lit("e"), F.lit("\xa0")), F.lit("　\n"))
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", X.strip(X.clean_nbsp(wide)).alias("clean"), X.clean_nbsp(F.replace("text", F.lit("e"), F.lit("\xa0"))).alias("spaced"))


@query("SELECT page_id, 'page' || page_id || '.v2.html' AS name, 'page' || page_id || '.v2' AS stem, '/in/page' || page_id || '.v2_embedded.json' AS swapped, '.hidden' AS hidden FROM pages")
def file_names(spark, sf_dir):
    path = F.concat(F.lit("/in/page"), F.col("page_id").cast("string"), F.lit(".v2"))
    html = F.concat(path, F.lit(".html"))
    return table(spark, sf_dir, "pages").select("page_id", X.file_name(html).alias("name"), X.stem(html).alias("stem"), X.swap_suffix(F.concat(path, F.lit(".json")), ".json", "_embedded.json").alias("swapped"), X.stem(F.lit("/in/.hidden")).alias("hidden"))


@query("SELECT page_id, CASE page_id % 5 WHEN 0 THEN CAST(page_id % 9 AS INTEGER) WHEN 1 THEN CAST(page_id % 9 AS INTEGER) END AS level FROM pages")
def heading_levels(spark, sf_dir):
    """Levels of style names: with a number, with more after it, without one, with none to read, and of other styles."""
    n, level = F.col("page_id") % 5, (F.col("page_id") % 9).cast("string")
    style = F.when(n == 0, F.concat(F.lit("Heading "), level)).when(n == 1, F.concat(F.lit("Heading  "), level, F.lit(" Char"))).when(n == 2, "Heading").when(n == 3, F.concat(F.lit("Heading x"), level)).otherwise(F.concat(F.lit("List "), level))
    return table(spark, sf_dir, "pages").select("page_id", X.heading_level(style).alias("level"))


@query("SELECT item_id, 'Describe in one paragraph the scope of a technical document that would answer this question:' || chr(10) || chr(10) || text || chr(10) AS scope, 'Give a short plain-text title for a conversation that starts with this message:' || chr(10) || text || '{question}' || chr(10) AS title FROM benchmark")
def filled_prompts(spark, sf_dir):
    """Prompts for a synthetic scope and for a title; what is filled in is not filled again."""
    return table(spark, sf_dir, "benchmark").select("item_id", X.fill(X.SCOPE_PROMPT, question=F.col("text")).alias("scope"), X.fill(X.TITLE_PROMPT, message=F.concat("text", F.lit("{question}"))).alias("title"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN event_id % 2 = 0 THEN '' ELSE '.000250' END AS at FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)")
def iso_times(spark, sf_dir):
    whole = F.date_trunc("second", F.col("ts").cast("timestamp"))
    at = F.when(F.col("event_id") % 2 == 0, whole).otherwise(whole + F.expr("INTERVAL 250 MICROSECONDS"))
    return table(spark, sf_dir, "events").select("event_id", X.iso_time(at).alias("at"))


@query("""SELECT page_id, CASE WHEN greatest(w, h) <= 1024 THEN w WHEN w >= h THEN 1024 ELSE CAST(floor(w * (1024.0::DOUBLE / h)) AS INTEGER) END AS width, CASE WHEN greatest(w, h) <= 1024 THEN h WHEN h >= w THEN 1024 ELSE CAST(floor(h * (1024.0::DOUBLE / w)) AS INTEGER) END AS height
FROM (SELECT page_id, CAST(length(html) * 3 % 2500 + 1 AS INTEGER) AS w, CAST(length(url) * 37 % 2500 + 1 AS INTEGER) AS h FROM pages)""")
def image_sizes(spark, sf_dir):
    """Sizes of images whose longer side is brought down to 1024."""
    w, h = (F.length("html") * 3 % 2500 + 1).cast("int"), (F.length("url") * 37 % 2500 + 1).cast("int")
    return table(spark, sf_dir, "pages").select("page_id", X.fitted(w, h).alias("s")).select("page_id", "s.width", "s.height")


@query("SELECT doc_id, array_to_string(list_slice(list_filter(regexp_split_to_array(text, '[\\t\\n\\x0b\\x0c\\r ]+'), lambda x: x <> ''), 1, 2048), ' ') AS cut FROM documents")
def encoder_inputs(spark, sf_dir):
    """Texts as an encoder takes them: at most 2,048 words."""
    return table(spark, sf_dir, "documents").select("doc_id", X.first_tokens(F.col("text"), embedding.MAX_TOKENS).alias("cut"))


@query("SELECT vec_id, CAST(CASE WHEN vec_id % 3 = 0 THEN len(embedding) WHEN vec_id % 3 = 1 THEN 10 END AS INTEGER) AS width, CASE WHEN vec_id % 3 = 0 THEN embedding[1] WHEN vec_id % 3 = 1 THEN 0 END AS first FROM embeddings")
def vector_widths(spark, sf_dir):
    """Widths of vectors, of placeholders for invalid ones, and of none."""
    n = F.col("vec_id") % 3
    vector = F.when(n != 2, embedding.placeholder(F.col("embedding"), n == 0))
    return table(spark, sf_dir, "embeddings").select("vec_id", embedding.width(vector).alias("width"), F.get(vector, F.lit(0)).alias("first"))


@query("SELECT vec_id AS id, CAST(floor(vec_id / 10) AS BIGINT) AS parent_id, 0 AS cluster FROM embeddings")
def placeholder_clusters(spark, sf_dir):
    """Nodes without a vector are all in cluster 0."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.floor(F.col("vec_id") / 10).cast("long").alias("parent_id"), F.lit(None).cast("array<float>").alias("vector"))
    return clustering.per_parent(rows)


@query("""WITH s AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), e AS (SELECT label, vec_id, unnest(v) AS x, unnest(range(len(v))) AS dim FROM s),
c AS (SELECT label, list(m ORDER BY dim) AS m, sum(q) AS q FROM (SELECT label, dim, avg(x) AS m, avg(x * x) AS q FROM e GROUP BY label, dim) GROUP BY label), n AS (SELECT label, count(*) AS n FROM s GROUP BY label),
d AS (SELECT s.vec_id, s.label AS own, c.label, n.n, list_inner_product(v, v) + c.q - 2 * list_inner_product(v, m) AS d FROM s, c JOIN n USING (label)),
r AS (SELECT vec_id, min(d) FILTER (label <> own) AS b, max(d * n / (n - 1)) FILTER (label = own) AS a, max(n) FILTER (label = own) AS n FROM d GROUP BY vec_id)
SELECT round(avg(CASE WHEN n = 1 THEN 0 WHEN a < b THEN 1 - a / b WHEN a > b THEN b / a - 1 ELSE 0 END), 6) AS silhouette FROM r""")
def cluster_quality(spark, sf_dir):
    """The silhouette, with squared distances, of the vectors under their labels."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("embedding").alias("vector"), F.col("label").cast("int").alias("cluster"))
    return spark.range(1).select(F.round(F.lit(clustering.quality(rows)), 6).alias("silhouette"))


@query("SELECT count(*) AS rows, count(DISTINCT vec_id) AS ids, true AS l1, true AS l2, true AS l3, true AS nearest FROM embeddings")
def kmeans_levels(spark, sf_dir):
    """What three levels of k-means promise: every row once, no more clusters than asked for on any level, and rows of a first-level
    cluster that lie, for the most part, nearest to its centre."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    found = clustering.materialize(clustering.three_levels(vectors, 8, 4, 3), "levels")
    near = clustering.nearest_centroid(found, clustering.centroids(found, "cluster_l1"), "cluster_l1").withColumnRenamed("cluster_l1", "near")
    share = found.join(near, "id").agg(F.avg((F.col("cluster_l1") == F.col("near")).cast("int")).alias("share"))
    within = lambda by, name, k: found.groupBy(*by).agg(F.count_distinct(name).alias("n")).agg((F.max("n") <= k).alias(name[-2:]))
    one = found.agg(F.count("*").alias("rows"), F.count_distinct("id").alias("ids"))
    for frame in (within([], "cluster_l1", 8), within(["cluster_l1"], "cluster_l2", 4), within(["cluster_l1", "cluster_l2"], "cluster_l3", 3), share.select((F.col("share") > 0.9).alias("nearest"))):
        one = one.join(F.broadcast(frame))  # one row each
    return one


@query("SELECT vec_id AS id, parent_id, true AS within, true AS better FROM (SELECT vec_id, CAST(floor(vec_id / 25) AS BIGINT) AS parent_id FROM embeddings)")
def parent_clusters(spark, sf_dir):
    """Independent clusters for each parent's children: no more than asked for, and a row's distance to its cluster's mean is
    no larger than to its parent's, on the whole."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.floor(F.col("vec_id") / 25).cast("long").alias("parent_id"), F.col("embedding").alias("vector"))
    found = clustering.materialize(clustering.per_parent(rows, 3).join(rows.select("id", "vector"), "id"), "parents")

    def spread(by: list[str], name: str):
        means = clustering.means(found, by).withColumnRenamed("vector", "mean")
        d = F.aggregate(F.zip_with("vector", "mean", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
        return found.join(means, by).groupBy("parent_id").agg(F.sum(d).alias(name))

    known = found.groupBy("parent_id").agg(F.count_distinct("cluster").alias("n")).join(spread(["parent_id"], "all"), "parent_id").join(spread(["parent_id", "cluster"], "own"), "parent_id")
    return found.join(known, "parent_id").select("id", "parent_id", (F.col("n") <= 3).alias("within"), (F.col("own") <= F.col("all") + 1e-9).alias("better"))
