"""Alignment of two tokenizations of the same texts, and how often their tokens meet.

A text is encoded by a byte-level BPE (A) and by a sentencepiece model (B). Both cut the same bytes, so the tokens are the two sides of a
graph with an edge, a link, wherever an A and a B token overlap. Union-find over the links of a batch of texts gives the
connected components, which are exactly the smallest groups of tokens that cover the same bytes; the members of a
component expand to its links.

Counting is distributed: a batch of about ``BATCH_BYTES`` of text keeps its distinct (A id, B id) pairs with the number of
its documents that hold each, only these are shuffled and summed, and each batch gets back the counts of its own pairs. No
table of pairs is broadcast or collected, and a pair that every document holds is one row for each batch.

Memory: a batch, or a single longer text, is in memory at once with some 60 bytes for each of its bytes; texts are encoded in parts, cut between words.

Cases: a text that is null or empty, or whose tokens of either side don't give the bytes of a space and the text (as texts with U+2581), has no tokens:
counts of 0 and empty groups. Names of special tokens inside a text are text. Rows that repeat are documents of
their own and all count; rows with a null id too. Of equal counts all are the highest. Other columns are ignored, whatever
their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docstrata.functions.tables import materialize
from docstrata.llm.bpe import BATCH_CHARS, encoder, read_vocabulary, slices

BATCH_BYTES, MAX_WORDS = 2_000_000, 200_000
#: A blank after another character: no piece of the model has one there, so no token of either side spans its left edge.
CUT = re.compile(r"(?<=[^ ]) ")
WORD = re.compile(r" +[^ ]*")


class Pieces:
    """A sentencepiece model that encodes each distinct word once and remembers about MAX_WORDS of them."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        self.blank = [self.model.piece_to_id("▁")]
        self.by_word = not any("▁" in n.lstrip("▁") for n in names) and self.blank != [self.model.unk_id()]
        self.bytes = [bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        self.sizes = np.array([len(b) for b in self.bytes])
        self.forget()

    def forget(self) -> None:
        self.word: dict[str, int] = {}
        self.flat, self.start, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts; the model itself puts a space before each."""
        if not self.by_word:
            return [np.array(x, np.int32) for x in self.model.encode(texts, num_threads=1)]
        out: list[list[np.ndarray]] = [[] for _ in texts]
        batch: list[tuple[int, list[str]]] = []
        chars = 0
        for i, text in enumerate(texts):
            whole, a = " " + text if text else "", 0
            while a < len(whole):
                cut = CUT.search(whole, a + BATCH_CHARS) if len(whole) - a > BATCH_CHARS else None
                b = cut.start() if cut else len(whole)
                batch.append((i, WORD.findall(whole, a, b)))
                chars, a = chars + b - a, b
                if chars >= BATCH_CHARS:
                    self.part(batch, out)
                    batch, chars = [], 0
        self.part(batch, out)
        return [x[0] if len(x) == 1 else np.concatenate([np.zeros(0, np.int32), *x]) for x in out]

    def part(self, batch: list[tuple[int, list[str]]], out: list[list[np.ndarray]]) -> None:
        """Adds the ids of each list of words to its text's; new words are encoded."""
        if len(self.word) > MAX_WORDS:
            self.forget()
        words = [w for _, some in batch for w in some]
        if new := list(set(words).difference(self.word)):
            ids = [x or self.blank for x in self.model.encode([w[1:] for w in new], num_threads=1)]  # a blank at the end is a word
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            self.start = np.append(self.start, len(self.flat) + np.cumsum(size) - size)
            self.size = np.append(self.size, size)
            self.flat = np.append(self.flat, np.fromiter(chain.from_iterable(ids), np.int32, size.sum()))
            self.word.update(zip(new, range(len(self.word), len(self.word) + len(new))))
        at = np.fromiter(map(self.word.__getitem__, words), np.int64, len(words))
        size = self.size[at]
        ends = np.append(0, np.cumsum(size))
        ids = self.flat[np.arange(ends[-1]) + np.repeat(self.start[at] - ends[:-1], size)]
        cuts = ends[np.cumsum([0, *(len(some) for _, some in batch)])].tolist()
        for (i, _), a, b in zip(batch, cuts, cuts[1:]):  # noqa: B905
            out[i].append(ids[a:b])


#: The models of this Python worker, kept from task to task.
_kept: dict[bytes, Pieces] = {}


def pieces(model: bytes) -> Pieces:
    key = hashlib.sha256(model).digest()
    if key not in _kept:
        _kept[key] = Pieces(model)
    return _kept[key]


def plain(vocabulary: str) -> str:
    """A vocabulary without its added tokens, so that their names are text like any other."""
    return json.dumps(json.loads(vocabulary) | {"added_tokens": []})


def united(n: int, link_a: np.ndarray, link_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union-find over links in the order of the bytes: of each of n A tokens, and of each B token, the first A token of its component.

    Every B token hooks to its first A token, and so do that token's other A tokens, each of which has no earlier link than this; then
    paths are compressed until all lead to a root."""
    parent = np.arange(n)
    first = np.append(True, link_b[1:] != link_b[:-1])[: len(link_b)]
    head = link_a[first]
    hooked = link_a[~first]
    parent[hooked] = head[link_b[~first]]
    while ((up := parent[parent[hooked]]) != parent[hooked]).any():
        parent[hooked] = up
    return parent, parent[head]


class Alignment:
    """A batch of texts: ``a`` and ``b`` are the ids of all its tokens, one text after the other; ``of_a`` and ``of_b`` say of
    which text, ``group_a`` and ``group_b`` of which group; ``link_a`` and ``link_b`` are the places of the linked tokens."""

    def __init__(self, a: list[np.ndarray], b: list[np.ndarray], size_a: np.ndarray, size_b: np.ndarray):
        self.n, self.many = len(a), (len(size_a), len(size_b))
        self.a, self.b = (np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in (a, b))
        self.of_a, self.of_b = (np.repeat(np.arange(self.n), [len(t) for t in x]) for x in (a, b))
        end_a, end_b = np.cumsum(size_a[self.a]), np.cumsum(size_b[self.b])
        mark = np.zeros((int(end_a[-1]) if len(end_a) else 0) + 1, np.int8)
        mark[end_a] = 1
        mark[end_b] |= 2
        kind = mark[np.flatnonzero(mark)]  # every stretch of bytes between two ends is one link
        ends_a, ends_b = kind & 1, kind >> 1
        self.link_a, self.link_b = np.cumsum(ends_a) - ends_a, np.cumsum(ends_b) - ends_b
        # components lie side by side, on both sides in one order
        self.group_a, self.group_b = (np.cumsum(np.append(False, h[1:] != h[:-1])[: len(h)]) for h in united(len(self.a), self.link_a, self.link_b))

    def counts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each text its A tokens, B tokens, groups and links."""
        first = np.append(True, self.group_a[1:] != self.group_a[:-1])[: len(self.a)]
        of = (self.of_a, self.of_b, self.of_a[first], self.of_a[self.link_a])
        return tuple(np.bincount(x, minlength=self.n) for x in of)

    def groups(self) -> Iterator[str]:
        """Of each text its groups, as ``a1,a2|b1;a3|b2,b3``."""
        n = int(self.group_a[-1]) + 1 if len(self.a) else 0
        in_a, in_b = np.bincount(self.group_a, minlength=n), np.bincount(self.group_b, minlength=n)
        at_a = np.arange(len(self.a)) + (np.cumsum(in_b) - in_b)[self.group_a]
        at_b = np.arange(len(self.b)) + np.cumsum(in_a)[self.group_b]
        said = np.empty(len(self.a) + len(self.b), object)
        for at, ids, group, many, ends_with in zip((at_a, at_b), (self.a, self.b), (self.group_a, self.group_b), self.many, "|;", strict=True):
            last = np.append(group[1:] != group[:-1], True)[: len(ids)]
            said[at] = numerals(many, ends_with)[ids + last * many]
        tokens = np.cumsum(np.bincount(self.of_a, minlength=self.n) + np.bincount(self.of_b, minlength=self.n))
        a = 0
        for b in tokens.tolist():
            yield "".join(said[a:b].tolist())[:-1]
            a = b

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The distinct pairs of ids, sorted; then of each text its distinct pairs: the text, the pair's place among them, its links."""
        pair = self.a[self.link_a] * self.many[1] + self.b[self.link_b]
        all_ = self.many[0] * self.many[1]
        in_text, n = np.unique(self.of_a[self.link_a] * all_ + pair, return_counts=True)  # texts of a batch times pairs: below 2^63
        own, place = np.unique(in_text % all_, return_inverse=True)
        return own // self.many[1], own % self.many[1], in_text // all_, place, n


@cache
def numerals(many: int, ends_with: str) -> np.ndarray:
    """The numbers below ``many`` with a comma, then with ``ends_with``."""
    return np.array([f"{i}{c}" for c in (",", ends_with) for i in range(many)], object)


def token_lists(texts: list[bytes | None], e, p: Pieces) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Ids of A and B of each text; none where they don't give a space and the text."""
    none = np.zeros(0, np.int64)
    said = [None if not t else t.decode("utf-8", "replace") for t in texts]
    a = e.encode(" " + t if t else "" for t in said)
    b = p.encode([t or "" for t in said])
    for i, t in enumerate(texts):
        if t and (b"".join(map(e.v.bytes.__getitem__, a[i].tolist())) != b" " + t or b"".join(map(p.bytes.__getitem__, b[i].tolist())) != b" " + t):
            a[i] = b[i] = none
    return a, b


ALIGNED = "batch long, id long, n_a long, n_b long, n_groups long, n_links long, groups string, pair array<int>, n array<int>, a array<int>, b array<int>, docs array<int>"


def aligned(docs: DataFrame, vocabulary: str, model: bytes, id: str, text: str, digests: bool) -> DataFrame:
    """A row for each document, with the places of its pairs among those of its batch; and one for each batch (``a`` not null) with its pairs. Narrow."""
    shared = docs.sparkSession.sparkContext.broadcast((plain(vocabulary), bytes(model)))  # a few MB, fixed by the vocabularies

    def lists(of: np.ndarray, n: int, *values: np.ndarray) -> list[pa.Array]:
        cuts = pa.array(np.searchsorted(of, np.arange(n + 1)).astype(np.int32))
        return [pa.ListArray.from_arrays(cuts, pa.array(v.astype(np.int32))) for v in values]

    def run(batches):
        e, p = encoder(shared.value[0]), pieces(shared.value[1])
        size_a = np.array([len(x) for x in e.v.bytes])
        names = ["batch", "id", "n_a", "n_b", "n_groups", "n_links", "groups", "pair", "n", "a", "b", "docs"]
        for number, part in enumerate(slices(batches, "text", BATCH_BYTES)):
            batch, n = (TaskContext.get().partitionId() << 32) + number, part.num_rows
            g = Alignment(*token_lists(part.column("text").cast(pa.binary()).to_pylist(), e, p), size_a, p.sizes)
            a, b, of, place, links = g.pairs()
            groups = pa.array([hashlib.sha256(x.encode()).hexdigest() if x and digests else x for x in g.groups()], pa.string())
            nothing = [pa.nulls(n, pa.list_(pa.int32()))] * 3
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, batch)), part.column("id"), *map(pa.array, g.counts()), groups, *lists(of, n, place, links), *nothing], names=names)
            if len(a):
                whole = lists(np.zeros(len(a), int), 1, a, b, np.bincount(place, minlength=len(a)))
                yield pa.RecordBatch.from_arrays([pa.array([batch]), *(pa.nulls(1, pa.int64()) for _ in range(5)), pa.nulls(1, pa.string()), *(pa.nulls(1, pa.list_(pa.int32())) for _ in range(2)), *whole], names=names)

    return docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, ALIGNED)


def counted(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(batch, place, a, b, docs) of the pairs of each batch, and (a, b, documents, best) of all: how many documents hold the pair
    linked, and whether no other pair of that A id has more."""
    each = table.where("a is not null").select("batch", F.posexplode(F.arrays_zip("a", "b", "docs")).alias("place", "x")).select("batch", "place", "x.*")
    all_ = each.groupBy("a", "b").agg(F.sum("docs").alias("documents"))
    return each, all_.join(all_.groupBy("a").agg(F.max("documents").alias("most")), "a").select("a", "b", "documents", (F.col("documents") == F.col("most")).alias("best"))


def pair_counts(docs: DataFrame, vocabulary: str, model: bytes, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(a, b, documents, best) of all pairs of ids that are linked somewhere."""
    return counted(materialize(aligned(docs, vocabulary, model, id, text, True), "aligned"))[1]


def align(docs: DataFrame, vocabulary: str, model: bytes, id: str = "doc_id", text: str = "text", digests: bool = False) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of each document: ``groups`` as ``a1,a2|b1;a3|b2,b3``, or with
    ``digests`` the SHA-256 of that ("" without tokens)."""
    table = materialize(aligned(docs, vocabulary, model, id, text, digests), "aligned")
    each, counts = counted(table)
    back = each.join(counts, ["a", "b"]).select(F.col("batch").alias("of"), "place", "documents", "best")

    def summed(left: pa.Table, right: pa.Table) -> pa.Table:
        place = right.column("place").to_numpy()
        documents, best = np.zeros(len(place), np.int64), np.zeros(len(place), bool)
        documents[place], best[place] = right.column("documents").to_numpy(), right.column("best").to_numpy(zero_copy_only=False)
        pair, n = left.column("pair").combine_chunks(), left.column("n").combine_chunks()
        of = np.repeat(np.arange(left.num_rows), pair.value_lengths().to_numpy())
        pair, n = pair.flatten().to_numpy(), n.flatten().to_numpy().astype(np.int64)
        best_, sum_ = np.zeros(left.num_rows, np.int64), np.zeros(left.num_rows, np.int64)
        np.add.at(best_, of, n * best[pair])
        np.add.at(sum_, of, n * documents[pair])
        return left.select(["id", "n_a", "n_b", "n_groups", "n_links"]).append_column("n_best", pa.array(best_)).append_column("count_sum", pa.array(sum_)).append_column("groups", left.column("groups"))

    rows = table.where("a is null").select("batch", "id", "n_a", "n_b", "n_groups", "n_links", "groups", "pair", "n")
    schema = "id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
    return rows.groupBy("batch").cogroup(back.groupBy("of")).applyInArrow(summed, schema).withColumnRenamed("id", id)


def read_model(path: str) -> bytes:
    """The model file, read once on the driver."""
    with open(path, "rb") as f:
        return f.read()


def op11_alignment(spark: SparkSession, sf_dir: str, vocabulary: str | None = None, model: str | None = None) -> DataFrame:
    """Every whole text of documents, as cut by both tokenizers."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = align(docs, read_vocabulary(vocabulary or public_tokenizers.path("byte_bpe_50k.json")), read_model(model or public_tokenizers.path("piece_bpe_32k.model")), digests=True)
    return found.withColumnRenamed("groups", "groups_sha256")
