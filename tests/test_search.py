from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from compare import DATA
from pyspark.sql import functions as F

from docstrata.functions import vectors as V
from docstrata.jobs import ingest, retrieval
from docstrata.operators import clustering, embedding, kmeans, nodes, search
from docstrata.sources import readers, writers
from docstrata.streaming.ingest import compacted, current, ingest_stream


def vectors(spark, n=300, d=6, parts=4):
    rng = np.random.default_rng(0)
    return spark.createDataFrame([(i, rng.normal(size=d).tolist()) for i in range(n)], "id long, vector array<double>").repartition(parts)


@pytest.mark.parametrize("parts", [1, 7])
def test_block_topk(spark, parts):
    df = vectors(spark, parts=parts)
    x = {r.id: np.array(r.vector) for r in df.collect()}
    asked = df.where("id % 50 = 0").withColumnRenamed("id", "query_id").unionByName(spark.createDataFrame([(900, [0.0] * 6), (901, None)], "query_id long, vector array<double>"))
    found = {}
    for r in V.block_topk(df, asked, 5, block=2).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.id)
    for q in range(0, 300, 50):
        s = sorted(x, key=lambda i: (-x[i] @ x[q] / np.linalg.norm(x[i]) / np.linalg.norm(x[q]), i))
        assert found[q] == s[:5]
    assert 900 not in found and 901 not in found


def test_hits_lie_below_hits(spark):
    view = retrieval.node_view(spark.read.parquet(str(DATA / "sf0.001" / "embeddings.parquet")))
    found = retrieval.search_tree(view, retrieval.every_hundredth(view), search.Limits(3, 2, 2, 2, 3))
    sets = {k: {(r.query_id, r.id) for r in f.collect()} for k, f in found.items()}
    assert all((r.query_id, r.parent_id) in sets["documents"] for r in found["sections"].collect())
    assert all((r.query_id, r.parent_section) in sets["sections"] and (r.query_id, r.parent_document) in sets["documents"] for r in found["chunks"].collect())
    assert max(r["count"] for r in found["sections"].groupBy("query_id", "parent_id").count().collect()) <= 2
    assert search.nested_results(found).count() == len({q for q, _ in sets["documents"]})


def test_boilerplate_and_names(spark):
    titles = spark.createDataFrame([("1\tScope",), ("2\tReferences",), ("Introduction",), ("",), (None,), ("scope",)], "t string")
    assert [r.b for r in titles.select(nodes.boilerplate(F.col("t")).alias("b")).collect()] == [True, True, True, True, True, False]
    docs = spark.createDataFrame([("b", "n"), ("a", "n"), ("c", "m")], "id string, document_name string")
    assert [r.id for r in nodes.by_name(docs, docs.limit(0).unionByName(docs.where("document_name = 'n'"))).collect()] == ["a"]
    sections = spark.createDataFrame([(1, 9, "x"), (1, 8, "x"), (2, 7, "x")], "doc_id long, id long, title string")
    assert [r.id for r in nodes.by_title(sections, spark.createDataFrame([(1, "x")], "doc_id long, title string")).collect()] == [8]


def test_text_or_struct(spark):
    df = spark.createDataFrame([('"t"',), ('{"title": "u", "embedding": [1, 2]}',), ("3",), ('{"x": 1}',)], "j string").select(F.parse_json("j").alias("v"))
    text, vector = nodes.text_or_struct(F.col("v"), "title")
    assert [(r.t, r.v) for r in df.select(text.alias("t"), vector.alias("v")).collect()] == [("t", None), ("u", [1.0, 2.0]), ("", None), ("", None)]


def test_kmeans(spark):
    rng = np.random.default_rng(1)
    rows = [(i, i % 3, (rng.normal(size=4) * 0.1 + 5 * (i // 3 % 2)).tolist()) for i in range(60)] + [(100, 9, [1.0] * 4), (101, 8, None)]
    df = spark.createDataFrame(rows, "id long, parent_id long, vector array<double>")
    found = {r.id: (r.parent_id, r.cluster) for r in clustering.per_parent(df, 2).collect()}
    assert found[100][1] == 0 and found[101][1] == 0 and len(found) == 62
    for p in range(3):
        groups = {(i // 3 % 2, found[i][1]) for i in range(60) if i % 3 == p}
        assert len(groups) == 2
    again = {r.id: (r.parent_id, r.cluster) for r in clustering.per_parent(df.repartition(13), 2).collect()}
    assert again == found


def test_kmeans_of_a_large_group(spark):
    """A parent with more children than one task takes is clustered by all tasks, like the others."""
    rng = np.random.default_rng(2)
    rows = [(i, 0 if i < 300 else i % 5 + 1, (rng.normal(size=3) * 0.1 + 9 * (i % 2)).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, parent_id long, vector array<double>")
    found = {r.id: (r.parent_id, r.cluster) for r in clustering.per_parent(df, 2, together=100).collect()}
    assert {i: p for i, (p, _) in found.items()} == {i: p for i, p, _ in rows}
    for p in range(6):
        assert len({(i % 2, found[i][1]) for i, q, _ in rows if q == p}) == 2


def test_means_and_nearest(spark):
    rng = np.random.default_rng(3)
    rows = [(i % 90, i % 7, rng.normal(size=5).tolist()) for i in range(200)] + [(5, 3, None)]
    df = spark.createDataFrame(rows, "id long, label int, vector array<double>").repartition(6)
    means = {r.label: np.array(r.vector) for r in clustering.centroids(df, "label").collect()}
    by = {k: np.array([v for _, x, v in rows if x == k and v]).mean(axis=0) for k in range(7)}
    assert all(np.allclose(means[k], by[k]) for k in by) and len(means) == 7
    found = sorted((r.id, r.label, r.distance) for r in clustering.nearest_centroid(df, clustering.centroids(df, "label"), "label").collect())
    wanted = sorted((i, *min((round(float(((np.array(v) - by[k]) ** 2).sum()), 9), k) for k in by)[::-1]) for i, _, v in rows if v)
    assert [f[:2] for f in found] == [w[:2] for w in wanted] and np.allclose([f[2] for f in found], [w[2] for w in wanted])
    assert clustering.nearest_centroid(df, clustering.centroids(df.limit(0), "label"), "label").collect() == []


def inertia(x, label):
    return sum(((x[label == c] - x[label == c].mean(axis=0)) ** 2).sum() for c in np.unique(label))


def local_kmeans(x, k, rng, starts=10):
    """k-means++ and Lloyd, the best of several starts."""
    best = np.inf
    for _ in range(starts):
        c = x[[rng.integers(len(x))]]
        while len(c) < k:
            d = ((x[:, None] - c[None]) ** 2).sum(axis=2).min(axis=1)
            c = np.vstack([c, x[rng.choice(len(x), p=d / d.sum())]])
        for _ in range(100):
            label = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
            c = np.stack([x[label == i].mean(axis=0) if (label == i).any() else c[i] for i in range(k)])
        best = min(best, inertia(x, label))
    return best


def by_id(df, *columns):
    return {r.id: tuple(r[c] for c in columns) for r in df.collect()}


@pytest.mark.parametrize("together", [10, 10_000])
def test_kmeans_at_any_size(spark, together):
    """One parent with 40 equal vectors and 4 others has min(k, distinct) clusters, whatever a task may hold."""
    rng = np.random.default_rng(11)
    rows = [(i, 1, [1.0, 1.0, 1.0]) for i in range(40)] + [(40 + i, 1, (9 * rng.normal(size=3)).tolist()) for i in range(4)]
    rows += [(100 + i, 2, rng.normal(size=3).tolist()) for i in range(200)] + [(400 + i, None, rng.normal(size=3).tolist()) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, parent_id long, vector array<double>")
    found = by_id(clustering.per_parent(df, 5, together=together), "parent_id", "cluster")
    assert len(found) == len(rows)
    assert sorted(Counter(c for p, c in found.values() if p == 1).values()) == [1, 1, 1, 1, 40]
    for parent in (2, None):
        own = [(i, v) for i, p, v in rows if p == parent]
        label, x = np.array([found[i][1] for i, _ in own]), np.array([v for _, v in own])
        assert sorted(set(label.tolist())) == [0, 1, 2, 3, 4]
        assert inertia(x, label) <= 1.05 * local_kmeans(x, 5, rng)


def test_kmeans_of_many_blocks_equals_that_of_one(spark, monkeypatch):
    """Steps as Spark jobs, with sums in a tree, and steps within a task give the same clusters of well separated groups."""
    monkeypatch.setattr(kmeans, "FAN_IN", 2)
    rng = np.random.default_rng(12)
    centres = 20 * rng.normal(size=(7, 4))
    rows = [(i, i % 2, (centres[i % 7] + rng.normal(size=4) * 0.3).tolist()) for i in range(1500)]
    df = spark.createDataFrame(rows, "id long, parent_id long, vector array<double>")
    found = by_id(clustering.per_parent(df, 7, together=100), "parent_id", "cluster")
    one = by_id(clustering.per_parent(df, 7), "parent_id", "cluster")
    for labels in (found, one):
        assert len({(p, c, i % 7) for i, (p, c) in labels.items()}) == 14
    again = by_id(clustering.per_parent(df.repartition(5), 7, together=100), "parent_id", "cluster")
    assert again == found


def test_nearest_of_many_centroids(spark, monkeypatch):
    """Centroids that no task may hold at once are met in blocks; ties go to the smaller cluster, repeated ids stay."""
    rng = np.random.default_rng(13)
    x, c = rng.integers(0, 4, (300, 3)).astype(float), rng.integers(0, 4, (40, 3)).astype(float)
    df = spark.createDataFrame([(i % 250, v.tolist()) for i, v in enumerate(x)] + [(1, None)], "id long, vector array<double>")
    centres = spark.createDataFrame([(f"c{i:02d}", v.tolist()) for i, v in enumerate(c)] + [("none", None)], "name string, vector array<double>")
    wanted = sorted((i % 250, *min((float(((v - one) ** 2).sum()), f"c{j:02d}") for j, one in enumerate(c))[::-1]) for i, v in enumerate(x))
    for numbers in (10**6, 30):
        monkeypatch.setattr(clustering, "CENTRE_NUMBERS", numbers)
        assert sorted(map(tuple, clustering.nearest_centroid(df, centres, "name").collect())) == wanted


@pytest.mark.parametrize("by", [None, "g"])
def test_block_topk_ties_and_groups(spark, by):
    """More ties than k in every block: the smaller ids win; with groups, a query only meets its own."""
    rows = [(f"r{i:04d}", i % 3, [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in range(900)] + [("none", 0, None), ("zero", 0, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "id string, g int, vector array<double>")
    asked = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 2, [1.0, 0.0]), (2, 1, [0.0, 2.0])] if by else [(1, 0, [1.0, 0.0]), (2, 0, [0.0, 2.0])], "query_id long, g int, vector array<double>")
    found = [(r.query_id, r.id) for r in V.block_topk(df, asked, 5, block=16, by=by).orderBy("query_id", "rank").collect()]
    groups = {1: (0, 2), 2: (1,)} if by else {1: (0, 1, 2), 2: (0, 1, 2)}
    assert found == [(q, x) for q in (1, 2) for x in sorted(i for i, g, v in rows if v and v[2 - 1 if q == 2 else 0] > 0 and g in groups[q])[:5]]


def test_overlap_topk(spark):
    rng = np.random.default_rng(5)
    word = lambda: f"w{rng.integers(30)}"
    texts = [(i, " ".join(word() for _ in range(rng.integers(0, 12))).upper() if i % 9 else None) for i in range(200)]
    asked = [(i, " ".join(word() for _ in range(rng.integers(0, 6)))) for i in range(20)] + [(99, None)]
    found = search.overlap_topk(spark.createDataFrame(texts, "id long, content string"), spark.createDataFrame(asked, "query_id long, question string"), 4, block=8).collect()

    def share(a, b):
        x, y = {*(a or "").lower().split()}, {*(b or "").lower().split()}
        return len(x & y) / len(x | y) if x | y else 0.0

    wanted = {(q, i, round(s, 9)) for q, a in asked for s, i in [(-n, i) for n, i in sorted((-share(a, t), i) for i, t in texts)[:4]]}
    assert {(r.query_id, r.id, round(r.overlap, 9)) for r in found} == wanted


def test_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from docstrata.functions import tables

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: None), sparkContext=SimpleNamespace(master="spark://host:7077", applicationId="a"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        tables.shared_folder(cluster)
    cluster.conf = SimpleNamespace(get=lambda k, d: "hdfs://x/y/")
    assert tables.shared_folder(cluster) == "hdfs://x/y/docstrata/a"


def test_several_blocks_in_one_task(spark, monkeypatch):
    """A group of several blocks that one task can hold needs no job for each step, and gets the clusters that the jobs give it."""
    from docstrata.operators import kmeans as K

    df = vectors(spark, 150)
    run = lambda: {r.id: r.cluster for r in K.kmeans(df, [], 3, starts=2, together=64).collect()}
    with monkeypatch.context() as m:
        m.setattr(K, "by_all_tasks", lambda *_: pytest.fail("a job for each step"))
        within = run()
    monkeypatch.setattr(K, "ALONE", 0)
    assert within == run() and set(within.values()) == {0, 1, 2}


def test_three_levels(spark):
    found = clustering.three_levels(vectors(spark, 400), 4, 3, 2)
    rows = found.collect()
    assert len({r.id for r in rows}) == 400
    sizes = {}
    for r in rows:
        assert 0 <= r.cluster_l1 < 4 and 0 <= r.cluster_l2 < 3 and 0 <= r.cluster_l3 < 2
        sizes.setdefault(r.cluster_l1, []).append(r)
    for own in sizes.values():
        for l2 in {r.cluster_l2 for r in own}:
            group = [r for r in own if r.cluster_l2 == l2]
            if len(group) <= 2:
                assert {r.cluster_l3 for r in group} == {0}
    assert -1 <= clustering.quality(found.withColumnRenamed("cluster_l1", "cluster")) <= 1


def test_encoders(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c"), (4, None)], "id long, text string")
    seen = embedding.encode_distinct(docs, lambda t: embedding.hashed_vectors(t, 16)).collect()
    assert len(seen) == 4 and len({tuple(r.vector) for r in seen if r.text == "a b"}) == 1
    assert [r.vector for r in seen if r.text is None] == [None]


def test_encode_leaves_other_columns_as_they_are(spark, monkeypatch):
    """Whole numbers beside a null keep all digits, and rows their vectors over several slices of a batch."""
    monkeypatch.setattr(embedding, "ROWS", 3)
    rows = [(2**53 + i if i % 4 else None, "x" * (i % 5) if i % 6 else None) for i in range(20)]
    lengths = lambda: lambda texts: np.array([[-1 if t is None else len(t)] for t in texts], np.float32)
    found = embedding.encode(spark.createDataFrame(rows, "id long, text string").coalesce(1), lengths, batch=2).collect()
    assert [(r.id, r.text) for r in found] == rows and [r.vector for r in found] == [[-1.0 if t is None else float(len(t))] for _, t in rows]


def test_encoded_texts_are_whole(spark):
    """The vectors of a document's chunks count the letters of all of its words."""
    from compare import DATA

    from docstrata.functions import text as X
    from docstrata.queries import encoded_texts

    small = str(DATA / "sf0.001")
    words = {r.doc_id: r.w or [] for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", X.tokens(F.col("text")).alias("w")).collect()}
    seen: dict = {}
    for r in encoded_texts(spark, small).collect():
        seen.setdefault(r.doc_id, []).append((r.chunk_idx, r.vector))
    assert max(map(len, words.values())) > 256 and seen.keys() == words.keys()
    for i, w in words.items():
        vectors = [v for _, v in sorted(seen[i])]
        assert len(vectors) == max(1, -(-len(w) // 256))
        assert sum(v[0] - v[1] for v in vectors) == sum(map(len, w)) and sum(v[2] for v in vectors) == sum(x.count("e") for x in w)
    odd = embedding.word_chunks(spark.createDataFrame([(1, None), (2, ""), (3, "a b  c")], "id long, text string"), 2).collect()
    assert sorted((r.id, r.chunk_idx, r.chunk) for r in odd) == [(1, 0, ""), (2, 0, ""), (3, 0, "a b"), (3, 1, "c")]


def test_ingest_and_baseline(spark, tmp_path):
    rows = []
    for d in range(3):
        for pos, (style, text) in enumerate([("Heading 1", "1\tScope"), ("Normal", f"about {d}"), ("Heading 1", "Body"), ("Heading 2", "Sub"), ("Normal", "word " * 30), ("Heading 3", "Deep"), ("Normal", "more " * 20)]):
            rows.append((f"d{d}", pos, "paragraph", style, text, []))
    blocks = spark.createDataFrame(rows, "doc_id string, pos int, kind string, style string, text string, images array<struct<ext string, bytes binary>>")
    encoder = lambda t: embedding.hashed_vectors(t, 8)
    written = ingest.ingest(blocks, encoder, str(tmp_path / "store"), 2)
    assert (written["document"], written["section"], written["subsection"], written["subsubsection"]) == (3, 6, 3, 3) and written["chunk"] == 6
    (tmp_path / "md").mkdir()
    for i in range(4):
        (tmp_path / "md" / f"f{i}.md").write_text("text " * (10 * i))
    files = readers.read_markdown(spark, str(tmp_path / "md"))
    stats = ingest.flat_baseline(files, encoder, str(tmp_path / "flat"), 2, 2, 2).first()
    assert stats.documents == 3 and spark.read.parquet(str(tmp_path / "flat")).count() == 3
    assert readers.first_files(files, 2).count() == 2


def test_reading_and_writing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"document_name": "A", "content": [{"title": "T", "subsections": [{"title": "S", "text_content": "x"}]}]}')
    (tmp_path / "in" / "bad.json").write_text("{")
    good, bad = readers.split_unreadable(readers.read_documents(spark, str(tmp_path / "in")).cache())
    assert [r.document_name for r in good.collect()] == ["A"] and bad.first().file_path.endswith("bad.json")
    writers.write_embedded(good, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first().file_name == "a_embedded.json"
    chunks = spark.createDataFrame([("f", 1, "y", [2.0]), ("f", 0, "x", [1.0]), ("f", 2, None, [1.0])], "source_file string, chunk_idx int, content string, embedding array<float>")
    writers.write_flat(readers.usable_chunks(chunks), str(tmp_path / "flat"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "flat")).collect()]
    assert lines == ['{"source_file":"f","file_content":[{"chunk":"x","embedding":[1.0]},{"chunk":"y","embedding":[2.0]}]}']
    assert writers.store(chunks, str(tmp_path / "s"), ("source_file",)) == 3


def test_stream_ingest(spark, tmp_path):
    source = tmp_path / "in"
    for n, text in enumerate(("one two", "three")):
        spark.createDataFrame([("a.md", text), (f"b{n}.md", "x")], "source_file string, text string").coalesce(1).write.parquet(str(source / f"p{n}"))
        stream = spark.readStream.schema("source_file string, text string").option("recursiveFileLookup", True).parquet(str(source))
        ingest_stream(stream, str(tmp_path / "store"), str(tmp_path / "checkpoint"), 10, 1).awaitTermination()
    shown = lambda store: {(r.source_file, r.chunk) for r in current(spark, str(tmp_path / store)).collect()}
    assert shown("store") == {("a.md", "three"), ("b0.md", "x"), ("b1.md", "x")}
    spark.createDataFrame([("a.md", "")], "source_file string, text string").write.parquet(str(source / "p2"))
    stream = spark.readStream.schema("source_file string, text string").option("recursiveFileLookup", True).parquet(str(source))
    ingest_stream(stream, str(tmp_path / "store"), str(tmp_path / "checkpoint"), 10, 1).awaitTermination()
    assert shown("store") == {("b0.md", "x"), ("b1.md", "x")}
    compacted(spark, str(tmp_path / "store"), str(tmp_path / "compact"))
    assert shown("compact") == shown("store") and current(spark, str(tmp_path / "none")) is None
