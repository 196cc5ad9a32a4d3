"""Byte-level BPE encoding and decoding with a pair occurrence index.

Texts of a partition are cut into words; the distinct words that the worker has not met yet are laid out in one array
of symbols. An index maps the rank of every mergeable pair to all positions of that pair; the active ranks are applied
in ascending order, each to all its positions at once, and the lists of the pairs that a merge creates are updated.
As merges only ever happen inside a word, equal words share one result.

Cases: a null or empty text has no tokens and decodes to ""; the vocabulary's added tokens are found in a text before
anything else, as the tokenizers library does; a text longer than BATCH_CHARS passes in parts, cut between words; repeated
rows are encoded alike; other columns pass through untouched, but for one named like the result, which is replaced; an
empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The byte-level alphabet's printable bytes; the white space of the split pattern; its contractions.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SHORT_ENDINGS, LONG_ENDINGS = "stmd", ("re", "ve", "ll")

OTHER, LETTER, NUMBER, BLANK, WHITE = range(5)
#: Characters laid out at once, and words a worker remembers: both bound its memory.
BATCH_CHARS, MAX_WORDS = 3_000_000, 1_500_000
BETWEEN_WORDS = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")


def character_classes() -> np.ndarray:
    """Class of every code point for the split pattern."""
    table = np.zeros(0x110000, np.uint8)
    categories = [unicodedata.category(chr(i))[0] for i in range(0x110000)]
    kinds = np.array(categories)
    table[kinds == "L"] = LETTER
    table[kinds == "N"] = NUMBER
    table[SPACES] = WHITE
    table[0x20] = BLANK
    return table


def word_starts(codes: np.ndarray, bounds: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where words start in texts laid end to end; ``bounds`` has the start of every text that is not empty.

    A word is a contraction, a run of letters, of numbers or of other characters with one blank before it, or white
    space; white space before a word leaves its last character to that word or to itself.
    """
    n = len(codes)
    cls = classes[codes]
    kind = np.where(cls == WHITE, BLANK, cls)
    first = np.zeros(n + 1, bool)
    first[bounds] = True
    start = np.empty(n, bool)
    start[0] = True
    start[1:] = kind[1:] != kind[:-1]
    start |= first[:n]
    after = np.flatnonzero(start & (kind != BLANK) & ~first[:n])
    after = after[kind[after - 1] == BLANK]
    start[after - 1] = True
    start[after[cls[after - 1] == BLANK]] = False
    marks = np.flatnonzero(start & (codes == 39))
    if len(marks):
        padded = np.append(codes, [0, 0, 0])
        one, two = padded[marks + 1], padded[marks + 2]
        in_text = ~first[np.minimum(marks + 1, n)] & (marks + 1 < n)
        short = in_text & np.isin(one, [ord(c) for c in SHORT_ENDINGS])
        long = np.zeros(len(marks), bool)
        for a, b in LONG_ENDINGS:
            long |= (one == ord(a)) & (two == ord(b))
        long &= in_text & ~short & (marks + 2 < n) & ~first[np.minimum(marks + 2, n)]
        for found, size in ((marks[short], 2), (marks[long], 3)):
            start[found + 1] = False
            end = found + size
            start[end[end < n]] = True
    return np.flatnonzero(start)


#: Words of up to eight times this many bytes are hashed and compared by blocks of eight, longer ones each on its own.
BLOCKS = 8
MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def spaced(raw: bytes) -> np.ndarray:
    """Bytes with the eight spare ones at the end that ``word_hashes`` and ``same_words`` may look at."""
    return np.frombuffer(raw + bytes(8), np.uint8)


def block_of(octets: np.ndarray, starts: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The next eight bytes at each start as one number, zero beyond the ``left`` bytes of the word."""
    every = np.ndarray(len(octets) - 7, "<u8", octets, strides=(1,))
    return every[starts] & MASKS[np.minimum(left, 8)]


def word_hashes(octets: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hashes of octets[start : start + size], mixed block by block; words of one size and up to eight bytes never
    share one."""
    h = mix(sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    short = sizes <= 8 * BLOCKS
    for r in range(BLOCKS):
        at = np.flatnonzero(short & (sizes > 8 * r))
        if not len(at):
            break
        h[at] = mix(h[at] * np.uint64(0xC2B2AE3D27D4EB4F) ^ block_of(octets, starts[at] + 8 * r, sizes[at] - 8 * r))
    for i in np.flatnonzero(~short).tolist():
        a = int(starts[i])
        h[i] = int.from_bytes(hashlib.blake2b(octets[a : a + int(sizes[i])], digest_size=8).digest(), "little")
    return h


def same_words(octets: np.ndarray, starts: np.ndarray, others: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether octets[start : start + size] and the word of that size in ``others`` are the same bytes."""
    same = np.ones(len(starts), bool)
    short = sizes <= 8 * BLOCKS
    for r in range(BLOCKS):
        here = np.flatnonzero(short & (sizes > 8 * r))
        if not len(here):
            break
        left = sizes[here] - 8 * r
        same[here] &= block_of(octets, starts[here] + 8 * r, left) == block_of(others, at[here] + 8 * r, left)
    for i in np.flatnonzero(~short).tolist():
        a, b, n = int(starts[i]), int(at[i]), int(sizes[i])
        same[i] = np.array_equal(octets[a : a + n], others[b : b + n])
    return same


class Vocabulary:
    """A byte-level BPE vocabulary, from the JSON text of a tokenizers file."""

    def __init__(self, text: str):
        data = json.loads(text)
        shown = {b: chr(b) for b in PRINTABLE}
        shown |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
        back = {c: b for b, c in shown.items()}
        ids = data["model"]["vocab"]
        self.byte_ids = np.array([ids[shown[b]] for b in range(256)], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"]]
        left = np.array([ids[a] for a, _ in merges], np.int64)
        right = np.array([ids[b] for _, b in merges], np.int64)
        self.merged = np.array([ids[a + b] for a, b in merges], np.int64)
        pairs = left << 32 | right
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.ranks = pairs[order], order
        both = np.arange(1 << 16)
        self.byte_ranks = self.rank(self.byte_ids[both >> 8], self.byte_ids[both & 255])
        self.added = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.bytes = [b""] * (1 + max([*ids.values(), *self.added.values()]))
        for token, i in ids.items():
            self.bytes[i] = bytes(back[c] for c in token)
        for token, i in self.added.items():
            self.bytes[i] = token.encode()

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where no merge exists."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.ranks[at], -1)


def encode_words(octets: np.ndarray, sizes: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words, number of ids of each word) of words laid end to end, by the pair occurrence index."""
    n = len(octets)
    symbol = np.append(v.byte_ids[octets], -1)
    ends = np.cumsum(sizes)
    # next and previous symbol of the same word; n means none
    follow, before = np.arange(1, n + 2), np.arange(-1, n)
    follow[ends[sizes > 0] - 1] = n
    before[(ends - sizes)[sizes > 0]] = n
    follow[n] = before[n] = n
    rank_at = np.full(n + 1, -1)  # of the pair that starts here
    index: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def enter(at: np.ndarray, ranks: np.ndarray) -> None:
        rank_at[at] = ranks
        there = ranks >= 0
        ranks, at = ranks[there], at[there]
        if not len(at):
            return
        order = np.argsort(ranks, kind="stable")
        ranks, at = ranks[order], at[order]
        cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(at)]
        for a, b in zip(cuts, cuts[1:]):  # noqa: B905
            rank = int(ranks[a])
            if rank not in index:
                index[rank] = []
                heapq.heappush(active, rank)
            index[rank].append(at[a:b])

    if n > 1:
        pairs = v.byte_ranks[octets[:-1].astype(np.int64) << 8 | octets[1:]]
        first = np.flatnonzero(follow[: n - 1] < n)
        enter(first, pairs[first])
    while active:
        rank = heapq.heappop(active)
        lists = index.pop(rank)
        at = lists[0] if len(lists) == 1 else np.concatenate(lists)
        at = at[rank_at[at] == rank]  # what other merges have changed is no longer this pair
        if not len(at):
            continue
        if symbol[at[0]] == symbol[follow[at[0]]]:
            # a pair of equal symbols can overlap itself: from the left, every second one
            at = np.sort(at)
            at = at[np.append(True, at[1:] != at[:-1])]
            head = np.append(True, follow[at[:-1]] != at[1:])
            at = at[(np.arange(len(at)) - np.flatnonzero(head)[np.cumsum(head) - 1]) % 2 == 0]
        second = follow[at]
        beyond = follow[second]
        symbol[at] = v.merged[rank]
        symbol[second] = rank_at[second] = -1
        follow[at] = beyond
        before[beyond] = at
        before[n] = n
        prior = before[at]
        touched = np.concatenate([prior[prior < n], at])
        enter(touched, v.rank(symbol[touched], symbol[follow[touched]]))
    kept = symbol[:n] >= 0
    total = np.append(0, np.cumsum(kept))
    return symbol[:n][kept].astype(np.uint32), total[ends] - total[ends - sizes]


class Encoder:
    """Encodes texts in batches; remembers about MAX_WORDS words from batch to batch."""

    def __init__(self, text: str):
        self.v = Vocabulary(text)
        self.classes = character_classes()
        # added tokens are found from the left, the longest first
        names = sorted((t for t in self.v.added if t), key=len, reverse=True)
        self.added = re.compile(f"({'|'.join(map(re.escape, names))})") if names else None
        self.may_cut = not any(" " in t for t in names)
        self.forget()

    def forget(self) -> None:
        #: Keys of known words, sorted, and the word of each; of each word its bytes and its ids, and where both are.
        self.key, self.word = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.octets, self.at, self.bytes = spaced(b""), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat, self.start, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def by_key(self, key: np.ndarray, octets: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The known word of each key; the first word of a key that is new is encoded and known from then on."""
        own, first, of = np.unique(key, return_index=True, return_inverse=True)
        at = np.searchsorted(self.key, own)
        new = np.append(self.key, np.uint64(0))[at] != own
        new |= at == len(self.key)
        if new.any():
            where = first[new]
            raw, n = octets.tobytes(), sizes[where]
            raw = b"".join([raw[a:b] for a, b in zip(starts[where].tolist(), (starts[where] + n).tolist(), strict=True)])
            ids, found = encode_words(np.frombuffer(raw, np.uint8), n, self.v)
            known = len(self.start)
            self.at, self.bytes = np.append(self.at, len(self.octets) - 8 + np.cumsum(n) - n), np.append(self.bytes, n)
            self.octets = spaced(self.octets[:-8].tobytes() + raw)
            self.start, self.size = np.append(self.start, len(self.flat) + np.cumsum(found) - found), np.append(self.size, found)
            self.flat = np.append(self.flat, ids)
            self.word = np.insert(self.word, at[new], known + np.arange(len(n)))
            self.key = np.insert(self.key, at[new], own[new])
            at = at + np.cumsum(new) - new
        return self.word[at][of]

    def learn(self, octets: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The known word of each octets[start : start + size]; new ones are encoded.

        A word is known by its bytes: its hash only says where to look, and a word that finds another there looks on."""
        if len(self.key) > MAX_WORDS:
            self.forget()
        key = word_hashes(octets, starts, sizes)
        word = self.by_key(key, octets, starts, sizes)
        while True:
            other = self.bytes[word] != sizes
            alike = np.flatnonzero(~other)
            other[alike] = ~same_words(octets, starts[alike], self.octets, self.at[word[alike]], sizes[alike])
            at = np.flatnonzero(other)
            if not len(at):
                return word
            key[at] = mix(key[at] + np.uint64(1))
            word[at] = self.by_key(key[at], octets, starts[at], sizes[at])

    def segments(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts without added tokens."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        bounds = np.cumsum(sizes) - sizes
        whole = "".join(texts)
        if not whole:
            return [np.zeros(0, np.uint32)] * len(texts)
        codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        starts = word_starts(codes, bounds[sizes > 0], self.classes)
        octets = spaced(whole.encode())
        at = starts if len(octets) == len(codes) + 8 else np.flatnonzero((octets[:-8] & 0xC0) != 0x80)[starts]
        word = self.learn(octets, at, np.append(at[1:], len(octets) - 8) - at)
        size = self.size[word]
        ends = np.cumsum(size)
        ids = self.flat[np.arange(ends[-1]) + np.repeat(self.start[word] - (ends - size), size)]
        firsts = np.searchsorted(starts, np.append(bounds, len(whole)))
        cut = np.append(0, ends)[firsts]
        return [ids[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]

    def encode(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        """Ids of each text, in batches of about BATCH_CHARS characters; longer texts pass in parts."""
        done: list[list[np.ndarray]] = []
        batch: list[str] = []
        owners: list[int] = []
        chars = 0

        def flush() -> None:
            for i, ids in zip(owners, self.encode_batch(batch), strict=True):
                done[i].append(ids)
            batch.clear()
            owners.clear()

        for text in texts:
            done.append([])
            for part in self.parts(text or ""):
                batch.append(part)
                owners.append(len(done) - 1)
                chars += len(part)
                if chars >= BATCH_CHARS:
                    flush()
                    chars = 0
        flush()
        return [x[0] if len(x) == 1 else np.concatenate(x) for x in done]

    def parts(self, text: str) -> Iterator[str]:
        """A text, cut before blanks between two words where it is longer than BATCH_CHARS; no token spans such a place."""
        a = 0
        while len(text) - a > BATCH_CHARS and self.may_cut and (m := BETWEEN_WORDS.search(text, a + BATCH_CHARS)):
            yield text[a : m.start()]
            a = m.start()
        yield text[a:] if a else text

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        if not self.added or not any(t in x for x in texts for t in self.v.added if t):
            return self.segments(texts)
        cut = [self.added.split(x) for x in texts]  # texts and added tokens in turn
        ids = iter(self.segments([p for parts in cut for p in parts[::2]]))
        return [np.concatenate([np.array([self.v.added[p]], np.uint32) if i % 2 else next(ids) for i, p in enumerate(parts)]) for parts in cut]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.v.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


#: The encoder of this Python worker, kept from task to task.
_kept: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    key = hashlib.sha256(vocabulary.encode()).hexdigest()
    if key not in _kept:
        _kept.clear()
        _kept[key] = Encoder(vocabulary)
    return _kept[key]


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int = BATCH_CHARS) -> Iterator[pa.RecordBatch]:
    """The batches, cut where their texts exceed ``most`` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), np.int64)
        group = (np.cumsum(sizes) - sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):  # noqa: B905
            yield batch.slice(a, b - a)


def with_columns(batch: pa.RecordBatch, keep: list[str], more: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), *more.values()], names=[*keep, *more])


def id_lists(ids: list[np.ndarray]) -> pa.Array:
    cuts = np.cumsum([0, *map(len, ids)]).astype(np.int32)
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    return pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat.astype(np.int32)))


def encode(docs: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with array<int> ``ids``; ``vocabulary`` is the JSON text of a byte-level BPE tokenizers file (it is
    broadcast: its size is fixed by the vocabulary, a few MB). Narrow: no shuffle."""
    keep = [c for c in docs.columns if c != ids]
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        e = encoder(shared.value)
        for batch in slices(batches, text):
            yield with_columns(batch, keep, {ids: id_lists(e.encode(batch.column(batch.schema.get_field_index(text)).to_pylist()))})

    return docs.select(keep).mapInArrow(run, T.StructType([*docs.select(keep).schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))]))


def decode(rows: DataFrame, vocabulary: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``rows`` with the string that array<int> ``ids`` stands for; bytes that are no UTF-8 become U+FFFD."""
    keep = [c for c in rows.columns if c != text]
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        e = encoder(shared.value)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            yield with_columns(batch, keep, {text: pa.array([e.decode(np.array(x or [], np.int64)) for x in column.to_pylist()], pa.string())})

    return rows.select(keep).mapInArrow(run, T.StructType([*rows.select(keep).schema.fields, T.StructField(text, T.StringType())]))


def digests(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode in one pass and keep digests only: (key, n_tokens, ids_sha256, decoded_sha256)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    field = docs.schema[key]

    def run(batches):
        e = encoder(shared.value)
        for batch in slices(batches, text):
            ids = e.encode(batch.column(batch.schema.get_field_index(text)).to_pylist())
            yield with_columns(batch, [key], {
                "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(e.decode(x).encode()).hexdigest() for x in ids], pa.string()),
            })

    schema = T.StructType([field, T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return docs.select(key, F.col(text)).mapInArrow(run, schema)


def read_vocabulary(path: str) -> str:
    """The vocabulary file's text, read once on the driver."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def op4_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Every whole text of documents, encoded and decoded."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(docs, read_vocabulary(path or public_tokenizers.path("byte_bpe_50k.json")))
