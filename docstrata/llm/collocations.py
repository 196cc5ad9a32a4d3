"""Phrases whose words keep company: contiguous n-grams mined by pivot partitioning, scored by their weakest cut.

Texts are cut into pieces and words (A-Z lower-cased; pieces end at ``. , ; : ! ?`` and line breaks, words at blanks and tabs).
Tasks number the words of a batch of about ``BATCH_BYTES``; words and codes of a batch are one row of packed columns.

First a filter: each batch sends the 32-bit hashes of its distinct words and word pairs, sorted, as differences, with their counts, in ``parts`` ranges of hashes.
Where a range is, the counts of all batches are added, and each batch gets back one bit for each hash it sent: whether it occurs ``least`` times in all. A
phrase that occurs so often consists of pairs that do, so texts are cut at all other pairs before anything else is moved. Hashes that coincide
only let more through, as all that is left is counted exactly afterwards. Of the words that are left, each with its whole count in every batch, the
distinct ones of a batch are shuffled, packed, a row for each range of hashes, and summed, and each batch gets back the ranks of its own frequent ones: no dictionary is broadcast, and no word is joined.

Words are ranked from rare to frequent. An n-gram belongs to its rarest word, its pivot. At each place of a text the word there
is the pivot of the fragment around it that can hold n-grams of its own: up to ``longest`` - 1 words to the left of higher
rank, and as many to the right of no lower rank, so a fragment ends where a rarer or an infrequent word stands, and an n-gram with
several occurrences of its pivot belongs to the first one. Equal fragments of a batch become one with a count. Fragments are
routed to their pivots, those of a batch that go to the same part packed as one row, and each pivot's n-grams are counted where its fragments are; no other pivot has the same n-gram, so
infrequent ones end there. There an n-gram is only counted where those
of one word less within it are frequent. Very frequent words only keep fragments of words as frequent, so no pivot gets a large share; the
fragments of a word that occurs more than ``HOT`` times are dealt over several cells by hash, and the counts of these are added afterwards.

The parts of a frequent phrase are frequent, hence all counts that a score needs are at hand. Of an m-gram's longer phrases
those of m + 1 words decide whether it is dropped: a count that survives to a longer one survives each step to it. Products are
decimals of 38 digits.

Cases: a null or empty text has no words; a null language is ``und`` and one with that name; rows that repeat count again, whatever their id;
a text longer than a batch is cut between pieces, and a piece is in memory whole; ties are ordered by count and then by the bytes of the phrase; bytes that are not UTF-8
are kept as they are; there may be 2^31 frequent words; other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docstrata.functions.tables import materialize
from docstrata.llm.bpe import slices

BATCH_BYTES, PART_BYTES, HOT = 12_000_000, 2_000_000, 200_000
#: Fragments that are mined at once, about.
TOGETHER = 200_000
LEAST, LONGEST, FIRST = 100, 5, 2000
#: A-Z to a-z, tabs to blanks, the ends of pieces to line breaks.
TO = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz \n\n\n\n\n\n\n\n\n")
#: A batch: its languages with their numbers of distinct words and of all words; words by language, counts and codes, packed.
BATCH = "batch long, langs array<string>, sizes array<int>, totals array<long>, words binary, n binary, codes binary"
#: Ranges of hashes at least, and batches for each of them; batches for each part of the fragments.
PARTS, BATCHES_A_PART, BATCHES_A_MINE = 256, 16, 4


class Codes(dict):
    """Numbers for words, in the order they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self)
        return code


def parts(text: bytes) -> Iterator[bytes]:
    """A text in parts of about PART_BYTES, cut between pieces."""
    a = 0
    while len(text) - a > PART_BYTES and (b := text.find(b"\n", a + PART_BYTES)) >= 0:
        yield text[a:b]
        a = b
    yield text[a:]


def packed(x: np.ndarray) -> bytes:
    """Numbers from 0 to 2^32 - 1 as compressed planes of their bytes."""
    return pa.compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), "zstd", asbytes=True) + len(x).to_bytes(4, "little") if len(x) else b""


def unpacked(told: bytes) -> np.ndarray:
    if not told:
        return np.zeros(0, np.int64)
    n = int.from_bytes(told[-4:], "little")
    planes = np.frombuffer(pa.decompress(told[:-4], 4 * n, "zstd"), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def packed_words(words: list[bytes]) -> bytes:
    """Words, which hold no line breaks, as one compressed text."""
    joined = b"\n".join(words)
    return pa.compress(joined, "zstd", asbytes=True) + len(joined).to_bytes(4, "little") if words else b""


def unpacked_words(told: bytes) -> list[bytes]:
    return pa.decompress(told[:-4], int.from_bytes(told[-4:], "little"), "zstd", asbytes=True).split(b"\n") if told else []


def batch_row(batch: int, langs: list[str], sizes: list[int], totals: list[int], words: list[bytes], n: np.ndarray, codes: np.ndarray) -> pa.RecordBatch:
    """A row of BATCH; codes are -1 between pieces."""
    columns = [pa.array([batch]), pa.array([langs], pa.list_(pa.string())), pa.array([sizes], pa.list_(pa.int32())), pa.array([totals], pa.list_(pa.int64()))]
    columns += [pa.array([x], pa.binary()) for x in (packed_words(words), packed(n), packed(codes + 1))]
    return pa.RecordBatch.from_arrays(columns, names=["batch", "langs", "sizes", "totals", "words", "n", "codes"])


def coded(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """Batches of texts as BATCH: the distinct words, the most frequent of a language first, how often each occurs, and the texts as codes, -1 between pieces. Narrow."""

    def run(batches):
        number, size = 0, 0
        known: dict[str, Codes] = {}
        codes: dict[str, list[np.ndarray]] = {}
        for part in slices(batches, "text", PART_BYTES):
            for t, name in zip(part.column("text").cast(pa.binary()).to_pylist(), part.column("lang").to_pylist(), strict=True):
                for p in parts((t or b"").translate(TO)):
                    own = known.setdefault(name, Codes({b"\n": 0, b"": 1}))
                    tokens = p.replace(b"\n", b" \n ").split(b" ")
                    codes.setdefault(name, []).append(np.fromiter(map(own.__getitem__, [*tokens, b"\n"]), np.int32, len(tokens) + 1))
                    size += len(p)
                    if size >= BATCH_BYTES:
                        yield batch(number, known, codes)
                        number, size, known, codes = number + 1, 0, {}, {}
        if codes:
            yield batch(number, known, codes)

    def batch(number, known, codes):
        flat, words, counts, sizes, totals, base = [], [], [], [], [], 0
        for name, own in known.items():
            x = np.concatenate(codes[name])
            x = x[x != 1] - 2  # -2 between pieces
            n = np.bincount(x[x >= 0], minlength=len(own) - 2)
            order = np.argsort(-n, kind="stable")
            place = np.empty(len(n) + 2, np.int64)
            place[order], place[-2:] = np.arange(base, base + len(n)), -1
            flat.append(place[x])
            names = list(own)[2:]
            words += [names[i] for i in order.tolist()]
            counts.append(n[order])
            sizes.append(len(n))
            totals.append(int(n.sum()))
            base += len(n)
        return batch_row((TaskContext.get().partitionId() << 32) + number, list(known), sizes, totals, words, np.concatenate(counts), np.concatenate(flat))

    return docs.select(F.col(text).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang")).mapInArrow(run, BATCH)


def hashes(langs: list[str], sizes: list[int], words: list[bytes], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of the words, and of the word pairs at each place of a text but the last, 0 where there is none."""
    start = iter([zlib.crc32(name.encode() + b"\n") for name, size in zip(langs, sizes, strict=True) for _ in range(size)])
    own = np.fromiter(map(zlib.crc32, words, start), np.uint64, len(words))
    mixed = lambda x: (((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)).astype(np.uint32)
    ended = np.append(own, np.uint64(0))  # the last one is for -1
    told = ended[codes[:-1]] * np.uint64(0x9E3779B97F4A7C15) + ended[codes[1:]]
    return mixed(own * np.uint64(0xD6E8FEB86659FD93)), np.where((codes[:-1] >= 0) & (codes[1:] >= 0), mixed(told), np.uint32(0))


def edges(parts: int) -> np.ndarray:
    """Where the ranges of hashes begin, and the end of the last one."""
    return (np.arange(parts + 1) * 2**32) // parts


def frequent_hashes(batches: DataFrame, least: int, parts: int) -> DataFrame:
    """(of, part, bits): for each batch and range of hashes, a bit for each distinct hash there, in order: whether it occurs ``least`` times in all batches."""

    def send(rows):
        for r in rows:
            for batch, langs, sizes, words, n, codes in zip(*(c.to_pylist() for c in r.columns), strict=True):
                n, codes = unpacked(n), unpacked(codes) - 1
                own, pairs = hashes(langs, sizes, unpacked_words(words), codes)
                pairs, times = np.unique(pairs[pairs > 0], return_counts=True)
                every = np.concatenate([pairs, own])
                order = np.argsort(every, kind="stable")
                every = every[order]
                first = np.flatnonzero(np.append(True, every[1:] != every[:-1])[: len(every)])
                total = np.add.reduceat(np.concatenate([times, n])[order], first) if len(first) else first
                every = every[first].astype(np.int64)
                cuts = np.searchsorted(every, edges(parts))
                some = [(p, a, b) for p, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if a < b]
                at = edges(parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p for p, _, _ in some], pa.int32()), pa.array([batch] * len(some), pa.int64()), pa.array([packed(np.diff(every[a:b], prepend=at[p])) for p, a, b in some], pa.binary()), pa.array([packed(total[a:b]) for _, a, b in some], pa.binary())],
                    names=["part", "of", "steps", "n"],
                )

    def add(t: pa.Table) -> pa.Table:
        at = edges(parts)
        part = t.column("part")[0].as_py()
        total = np.zeros(int(at[part + 1] - at[part]), np.int32)
        each = lambda steps: np.cumsum(unpacked(steps.as_py()))
        for steps, n in zip(t.column("steps"), t.column("n"), strict=True):
            i = each(steps)
            total[i] = np.minimum(total[i] + unpacked(n.as_py()), least)
        bits = [np.packbits(total[each(steps)] >= least).tobytes() for steps in t.column("steps")]
        return pa.table([t.column("of"), t.column("part"), pa.array(bits, pa.binary())], names=["of", "part", "bits"])

    sent = batches.select("batch", "langs", "sizes", "words", "n", "codes").mapInArrow(send, "part int, of long, steps binary, n binary")
    return sent.groupBy("part").applyInArrow(add, "of long, part int, bits binary")


def filtered(batches: DataFrame, least: int) -> DataFrame:
    """``batches`` with the words that may occur ``least`` times in all, and the texts cut wherever two words side by side do not."""
    parts = max(PARTS, batches.count() // BATCHES_A_PART)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        words, n, codes = unpacked_words(row["words"]), unpacked(row["n"]), unpacked(row["codes"]) - 1
        own, pairs = hashes(row["langs"], row["sizes"], words, codes)
        every, place = np.unique(np.concatenate([own, pairs]), return_inverse=True)
        # hash 0 was sent if a word has it; of pairs it marks those that do not count
        sent = every[0 if (own == 0).any() else 1 :] if len(every) and every[0] == 0 else every
        cuts = np.searchsorted(sent, edges(parts))
        often = np.zeros(len(sent), bool)
        for part, bits in zip(right.column("part").to_pylist(), right.column("bits").to_pylist(), strict=True):
            a, b = int(cuts[part]), int(cuts[part + 1])
            often[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a)
        good = np.append(np.zeros(len(every) - len(sent), bool), often)[place]
        word = good[: len(own)]
        ok = np.append(word, False)[codes]
        pair = np.append(good[len(own) :] & (pairs > 0) & ok[:-1] & ok[1:], False)
        kept = np.flatnonzero(pair | np.append(False, pair[:-1])[: len(pair)])
        width = 1 + ~pair[kept]
        short = np.full(int(width.sum()), -1)
        short[np.cumsum(width) - width] = (np.cumsum(word) - 1)[codes[kept]]
        ends = np.cumsum(row["sizes"])
        sizes = np.add.reduceat(np.append(word, False).astype(int), ends - row["sizes"]) * (np.array(row["sizes"]) > 0)
        return pa.Table.from_batches([batch_row(row["batch"], row["langs"], sizes.tolist(), row["totals"], [words[i] for i in np.flatnonzero(word).tolist()], n[word], short)])

    return batches.groupBy("batch").cogroup(frequent_hashes(batches, least, parts).groupBy("of")).applyInArrow(run, BATCH)


def counted_words(batches: DataFrame, least: int, parts: int) -> DataFrame:
    """(lang, word, f, batches, codes) of the words of ``batches`` that occur ``least`` times, with the batches that have them and their codes there.
    A batch sends its words, counts and codes packed, a row for each of ``parts`` ranges of hashes, where they are added up."""

    def send(rows):
        for r in rows:
            for batch, langs, sizes, words, n in zip(*(c.to_pylist() for c in r.columns), strict=True):
                words, n = unpacked_words(words), unpacked(n)
                own = hashes(langs, sizes, words, np.zeros(0, np.int64))[0].astype(np.int64)
                part, lang = own * parts >> 32, np.repeat(np.arange(len(langs)), sizes)
                order = np.argsort(part, kind="stable")  # by language and code within each
                sent, first = np.unique(part[order], return_index=True)
                each = [(p, at, np.bincount(lang[at], minlength=len(langs))) for p, at in zip(sent.tolist(), np.split(order, first[1:]), strict=True)] if len(sent) else []
                columns = [pa.array([p for p, *_ in each], pa.int32()), pa.array([batch] * len(each), pa.int64()), pa.array([langs] * len(each), pa.list_(pa.string())), pa.array([of.tolist() for *_, of in each], pa.list_(pa.int32()))]
                columns += [pa.array([told(at) for _, at, _ in each], pa.binary()) for told in (lambda at: packed_words([words[i] for i in at.tolist()]), lambda at: packed(n[at]), lambda at: packed(np.diff(at, prepend=0)))]  # noqa: B023
                yield pa.RecordBatch.from_arrays(columns, names=["part", "batch", "langs", "sizes", "words", "n", "codes"])

    def add(t: pa.Table) -> pa.Table:
        each = []
        for r in t.sort_by("batch").to_pylist():
            words = unpacked_words(r["words"])
            lang = pa.array(r["langs"], pa.string()).take(pa.array(np.repeat(np.arange(len(r["langs"])), r["sizes"])))
            each.append(pa.table({"lang": lang, "word": pa.array(words, pa.binary()), "n": unpacked(r["n"]), "batch": np.full(len(words), r["batch"]), "code": np.cumsum(unpacked(r["codes"])).astype(np.int32)}))
        of = pa.concat_tables(each)
        total = of.group_by(["lang", "word"], use_threads=False).aggregate([("n", "sum"), ("batch", "list"), ("code", "list")])
        total = total.filter(pc.greater_equal(total.column("n_sum"), least))
        return total.select(["lang", "word", "n_sum", "batch_list", "code_list"]).rename_columns(["lang", "word", "f", "batches", "codes"])

    sent = batches.select("batch", "langs", "sizes", "words", "n").mapInArrow(send, "part int, batch long, langs array<string>, sizes array<int>, words binary, n binary, codes binary")
    return sent.groupBy("part").applyInArrow(add, "lang string, word binary, f long, batches array<long>, codes array<int>")


def spans(rank: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """How far the fragment of each place goes to the left and to the right; -1 marks what no fragment holds."""
    n = len(rank)
    left, right = np.zeros(n, np.int64), np.zeros(n, np.int64)
    open_left = open_right = rank >= 0
    for d in range(1, longest):
        before, after = np.full(n, -1, rank.dtype), np.full(n, -1, rank.dtype)
        before[d:], after[: max(n - d, 0)] = rank[:-d], rank[d:]
        open_left = open_left & (before > rank)
        open_right = open_right & (after >= rank)
        left += open_left
        right += open_right
    return left, right


def fragments_of(rank: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct fragments of a text of ranks: (flat words, size of each, place of its pivot, count)."""
    left, right = spans(rank, longest)
    own, place = np.unique(rank, return_inverse=True)  # small numbers, so that two words make one key
    words, sizes, ats, counts = [], [], [], []
    shape = left * longest + right
    shape[(rank < 0) | (left + right == 0)] = -1
    for s in np.unique(shape[shape >= 0]).tolist():
        at, after = divmod(s, longest)
        size = at + after + 1
        places = np.flatnonzero(shape == s)
        key = place[places - at]
        for d in range(1 - at, after + 1):
            key = np.unique(key * len(own) + place[places + d], return_inverse=True)[1]
        _, first, n = np.unique(key, return_index=True, return_counts=True)
        words.append(rank[places[first][:, None] + np.arange(-at, after + 1)[None]].ravel())
        sizes.append(np.full(len(n), size))
        ats.append(np.full(len(n), at))
        counts.append(n)
    return tuple(np.concatenate([np.zeros(0, np.int64), *x]) for x in (words, sizes, ats, counts))


def fragments(batches: DataFrame, frequent: DataFrame, longest: int, parts: int) -> DataFrame:
    """The fragments of ``batches``, as BATCH, whose words are ``frequent(rank, batches, codes, cells)``: a row for each batch and each of ``parts`` to which
    pivots are dealt, with the sum ``n`` of their counts and, packed, in the order of their pivots: these as differences, the cell, or 0 where a pivot has only
    one, place of the pivot and size as one number, the other words, and counts."""
    def answers(rows):
        """Codes, ranks and cells of the words of each batch, packed."""
        for r in rows:
            batch, code = (r.column(c).flatten().to_numpy() for c in ("batches", "codes"))
            rank, cells = (np.repeat(r.column(c).to_numpy(), r.column("codes").value_lengths().to_numpy()) for c in ("rank", "cells"))
            order = np.lexsort((code, batch))
            of, first = np.unique(batch[order], return_index=True)
            each = [np.split(x[order], first[1:]) if len(of) else [] for x in (code, rank, cells)]
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), *(pa.array([packed(x) for x in xs], pa.binary()) for xs in each)], names=["of", "code", "rank", "cells"])

    ranks = frequent.select("rank", "cells", "batches", "codes").mapInArrow(answers, "of long, code binary, rank binary, cells binary")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        code, known, cells = (np.concatenate([np.zeros(0, np.int64), *map(unpacked, right.column(c).to_pylist())]) for c in ("code", "rank", "cells"))
        codes = unpacked(left.column("codes")[0].as_py()) - 1  # a batch is one row
        rank = np.full(int(max(codes.max(initial=-1), code.max(initial=-1))) + 2, -1, np.int32)  # the last one is for -1
        rank[code] = known
        flat, size, at, n = fragments_of(rank[codes], longest)
        first = np.cumsum(size) - size
        pivot = flat[first + at].astype(np.int64)
        order = np.argsort(known)
        of = cells[order][np.searchsorted(known[order], pivot)] if len(pivot) else pivot
        place = np.arange(len(flat)) - np.repeat(first, size)
        drawn = np.add.reduceat((flat * 0x9E3779B1 + 1) * (2 * place + 3), first) if len(pivot) else pivot
        cell = np.where(of > 1, (drawn >> 7) % np.maximum(of, 1) + 1, 0)
        part = (((pivot << 20) + cell) * 0x9E3779B1 >> 16 & 0xFFFFFFFF) * parts >> 32
        order = np.lexsort((pivot, part))
        rest = np.delete(np.arange(len(flat)), first + at)  # places of the words that are no pivots
        before = first - np.arange(len(first))
        told = []
        for p, i in zip(*parted(part[order], order), strict=True):
            width = size[i] - 1
            others = flat[rest[np.repeat(before[i] - np.cumsum(width) + width, width) + np.arange(int(width.sum()))]]
            told.append((p, int(n[i].sum()), *(packed(x) for x in (np.diff(pivot[i], prepend=0), cell[i], at[i] * 2 * longest + size[i], others, n[i]))))
        return pa.Table.from_arrays([pa.array(list(c), kind) for c, kind in zip(zip(*told, strict=True) if told else [[]] * 7, KINDS, strict=True)], names=["part", "n", "pivots", "cells", "shapes", "words", "counts"])

    return batches.select("batch", "codes").groupBy("batch").cogroup(ranks.groupBy("of")).applyInArrow(run, "part int, n long, pivots binary, cells binary, shapes binary, words binary, counts binary")


KINDS = [pa.int32(), pa.int64(), *[pa.binary()] * 5]


def parted(part: np.ndarray, order: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """The numbers in ``part``, which are sorted, and what is in ``order`` beside each."""
    own, first = np.unique(part, return_index=True)
    return own.tolist(), np.split(order, first[1:]) if len(own) else []


def told_fragments(rows: list[dict], longest: int) -> tuple[np.ndarray, ...]:
    """(words, start, size, place of the pivot, count, cell) of the fragments in rows of ``fragments``, in the order of pivots and cells."""
    each = [[], [], [], [], [], []]
    for r in rows:
        x = (np.cumsum(unpacked(r["pivots"])), unpacked(r["cells"]), *divmod(unpacked(r["shapes"]), 2 * longest), unpacked(r["words"]), unpacked(r["counts"]))
        for held, a in zip(each, x, strict=True):
            held.append(a.astype(np.int32))
    pivot, cell, at, size, others, n = map(np.concatenate, each)
    start = np.cumsum(size, dtype=np.int64) - size
    words = np.empty(len(pivot) + len(others), np.int32)
    is_pivot = np.zeros(len(words), bool)
    is_pivot[start + at] = True
    words[is_pivot], words[~is_pivot] = pivot, others
    order = np.lexsort((cell, pivot))
    return words, start[order], size[order].astype(np.int64), at[order].astype(np.int64), n[order].astype(np.int64), cell[order]


def count_grams(words: np.ndarray, start: np.ndarray, size: np.ndarray, at: np.ndarray, n: np.ndarray, least: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(grams as rows, counts, a fragment of each) of every length, of the n-grams that hold the pivots of the fragments
    ``words[start : start + size]`` and occur at least ``least`` times; n-grams grow from frequent ones by a word to the right, or to the left where
    the pivot, whose first place in an n-gram is the same wherever it occurs, is its last word."""
    many = int(words.max(initial=0)) + 1
    rows = np.arange(len(start))
    of, i, name, total = rows, at, words[start + at], None  # each pivot alone
    for s in range(2, longest + 1):
        last = of[i + s - 2 == at[of]], i[i + s - 2 == at[of]], name[i + s - 2 == at[of]]
        to_right = i + s - 1 < size[of]
        to_left = last[1] >= 1
        right = name[to_right] * many + words[start[of[to_right]] + i[to_right] + s - 1]
        left = -1 - (last[2][to_left] * many + words[start[last[0][to_left]] + last[1][to_left] - 1])
        of, i = np.concatenate([of[to_right], last[0][to_left]]), np.concatenate([i[to_right], last[1][to_left] - 1])
        _, first, name = np.unique(np.concatenate([right, left]), return_index=True, return_inverse=True)
        total = np.bincount(name, n[of], len(first)).astype(np.int64)
        good = total >= least[of[first]]
        yield words[(start[of[first]] + i[first])[good][:, None] + np.arange(s)[None]], total[good], of[first][good]
        kept = good[name]
        of, i, name = of[kept], i[kept], name[kept]


def mined(found: DataFrame, least: int, longest: int) -> DataFrame:
    """(gram, a) of all n-grams of 2 to ``longest`` words that occur ``least`` times, counted pivot by pivot."""

    def run(batches):
        held: list[dict] = []
        for b in batches:
            for r in b.to_pylist():
                if held and r["part"] != held[0]["part"]:
                    yield from grams(held)
                    held = []
                held.append(r)
        if held:
            yield from grams(held)

    def grams(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        words, start, size, at, n, cell = told_fragments(rows, longest)
        pivot = words[start + at]
        ends = np.append(np.flatnonzero((pivot[1:] != pivot[:-1]) | (cell[1:] != cell[:-1])) + 1, len(pivot))
        a = 0
        while a < len(pivot):  # whole pivots or cells, TOGETHER fragments or the next one's end
            z = int(ends[np.searchsorted(ends, min(a + TOGETHER, len(pivot)))])
            whole = cell[a:z] == 0
            for found_, total, of in count_grams(words, start[a:z], size[a:z], at[a:z], n[a:z], np.where(whole, least, 1), longest):
                cuts = np.arange(0, found_.size + 1, found_.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(cuts), pa.array(found_.ravel().astype(np.int32))), pa.array(total), pa.array(whole[of])], names=["gram", "a", "whole"])
            a = z

    dealt = found.repartition("part").sortWithinPartitions("part")
    counted = materialize(dealt.mapInArrow(run, "gram array<int>, a long, whole boolean"), "counted")
    added = counted.where(~F.col("whole")).groupBy("gram").agg(F.sum("a").alias("a")).where(F.col("a") >= least)
    return counted.where("whole").select("gram", "a").unionByName(added)


def ranked_words(words: DataFrame) -> DataFrame:
    """(lang, word, f, batches, codes, rank): ranks run from 0, from rare to frequent; of the sorted ranges only the sizes are added up."""
    ranges = materialize(words.orderBy("f", "lang", "word").withColumn("part", F.spark_partition_id()).withColumn("i", F.monotonically_increasing_id() - F.shiftleft(F.col("part").cast("long"), 33)), "ranges")
    sizes = ranges.groupBy("part").agg(F.count("*").alias("n"))  # a row for each range
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranges.join(sizes.select("part", before.alias("before")), "part").select("lang", "word", "f", "batches", "codes", (F.col("before") + F.col("i")).cast("int").alias("rank"))


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, first: int = FIRST, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``first`` phrases (see the module's text)."""
    every = materialize(coded(docs, text, lang), "batches")
    totals = every.select(F.explode(F.arrays_zip("langs", "totals")).alias("x")).groupBy(F.col("x.langs").alias("lang")).agg(F.sum("x.totals").alias("n"))
    batches = materialize(filtered(every, least), "filtered")
    n_batches = batches.count()
    # a frequent word's batches and codes travel with it: its rank goes back without a join
    frequent = materialize(ranked_words(counted_words(batches, least, max(PARTS, n_batches // BATCHES_A_PART))), "frequent")
    cells = F.ceil(F.col("f") / HOT).cast("int").alias("cells")
    found = fragments(batches, frequent.select("rank", "batches", "codes", cells), longest, max(PARTS, n_batches // BATCHES_A_MINE))
    grams = materialize(mined(found, least, longest), "grams")
    counts = grams.unionByName(frequent.select(F.array("rank").alias("gram"), F.col("f").alias("a")))
    several = grams.select("gram", "a", F.element_at("gram", 1).alias("rank")).join(frequent.select("rank", "lang"), "rank").join(totals, "lang")
    # an n-gram is dropped for one of a word more, of which it is the beginning or the end, that occurs as often
    ends = F.array(F.slice("gram", 1, F.size("gram") - 1), F.slice("gram", 2, F.size("gram") - 1))
    inside = grams.where(F.size("gram") > 2).select(F.explode(ends).alias("gram"), "a").groupBy("gram").agg(F.max("a").alias("longer"))
    left = several.join(inside, "gram", "left").where(F.coalesce(F.col("longer") < F.col("a"), F.lit(True))).select("lang", "gram", "a", "n")
    cuts = F.transform(F.sequence(F.lit(1), F.size("gram") - 1), lambda k: F.struct(k.alias("k"), F.slice("gram", 1, k).alias("head"), F.slice("gram", k + 1, F.size("gram")).alias("tail")))
    each = left.select("*", F.explode(cuts).alias("c")).select("lang", "gram", "a", "n", "c.*")
    each = each.join(counts.select(F.col("gram").alias("head"), F.col("a").alias("l")), "head").join(counts.select(F.col("gram").alias("tail"), F.col("a").alias("r")), "tail")
    big = lambda c, digits: F.col(c).cast(f"decimal({digits},0)")
    each = each.withColumn("up", F.lit(1000).cast("decimal(4,0)") * big("a", 17) * big("n", 17)).withColumn("down", big("l", 17) * big("r", 17)).withColumn("score", F.expr("up div down"))
    scored = each.groupBy("lang", "gram", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("x")).select("lang", "gram", "a", "n", "x.l", "x.r", "x.score")
    named = scored.select("lang", "a", "l", "r", "n", "score", "gram", F.posexplode("gram").alias("at", "rank")).join(frequent.select("rank", "word"), "rank")
    named = named.groupBy("lang", "gram", "a", "l", "r", "n", "score").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("w"))
    phrase = F.array_join(F.transform("w", lambda x: x["word"].cast("string")), " ")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = named.select("lang", phrase.alias("phrase"), "a", "l", "r", "n", "score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's 2,000 best phrases of 2 to 5 words that occur 100 times or more."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Counts every n-gram of every piece, then keeps the frequent ones.
OP13_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g FROM w, range(1, 6) t(k) WHERE len(w) >= k),
f AS (SELECT lang, k, g, count(*) AS a FROM g GROUP BY lang, k, g),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, g, string_split(g, ' ') AS w, a FROM f WHERE k >= 2 AND a >= 100),
i AS (SELECT lang, array_to_string(w[s:s + m - 1], ' ') AS g, max(a) AS longer FROM c, range(1, 5) t(s), range(2, 5) u(m) WHERE m < k AND s + m - 1 <= k GROUP BY ALL),
d AS (SELECT c.* FROM c LEFT JOIN i USING (lang, g) WHERE longer IS NULL OR 100 * longer < 100 * a),
x AS (SELECT d.lang, d.g, d.a, s AS cut, l.a AS l, r.a AS r, n.n, CAST(1000::HUGEINT * d.a * n.n // (l.a::HUGEINT * r.a) AS BIGINT) AS score
  FROM d JOIN n USING (lang), range(1, 5) t(s), f l, f r WHERE s < d.k AND l.lang = d.lang AND l.g = array_to_string(d.w[1:s], ' ') AND r.lang = d.lang AND r.g = array_to_string(d.w[s + 1:], ' ')),
b AS (SELECT lang, g AS phrase, a, n, arg_min(struct_pack(l := l, r := r, score := score), score * 8 + cut) AS m FROM x GROUP BY lang, g, a, n),
o AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY m.score DESC, a DESC, phrase) AS rank, phrase, a, m.l AS l, m.r AS r, n, m.score AS score FROM b)
SELECT lang, rank, phrase, a, l, r, n, score FROM o WHERE rank <= 2000
"""
