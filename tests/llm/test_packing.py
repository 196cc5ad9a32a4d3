"""Packing: whole documents, gapless sequences, and best-fit decreasing one piece at a time."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docstrata.llm import packing as P
from docstrata.llm.bpe import read_vocabulary

PATH = public_tokenizers.path("byte_bpe_50k.json")
VOCABULARY = read_vocabulary(PATH)
REFERENCE = Tokenizer.from_file(PATH)


def one_at_a_time(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = min((g for g in gaps if g >= n), default=None)
        if fit is None:
            gaps.append(capacity - n)
        else:
            gaps[gaps.index(fit)] -= n
    return Counter(gaps)


def packed(lengths, capacity, allowed=float("inf"), gaps=()):
    pieces = sorted(lengths, reverse=True)
    places, left = P.best_fit(pieces, list(gaps), capacity, allowed)
    filled = defaultdict(list)
    for n, (at, offset) in zip(pieces, places, strict=True):
        if at >= 0:
            filled[at].append((offset, n))
    return places, left, filled


def gapless(content, at=0):
    for offset, n in sorted(content):
        assert offset == at
        at += n
    return at


def test_one_range_is_best_fit_decreasing():
    rng = random.Random(5)
    for _ in range(200):
        capacity = rng.choice((8, 20, 64))
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 120))]
        _, left, filled = packed(lengths, capacity)
        assert sorted(left) == sorted(capacity - gapless(c) for c in filled.values())
        assert Counter(left) == one_at_a_time(lengths, capacity)


def test_gaps_and_bounds():
    places, left, _ = packed([5, 5, 3], 10, 0, [6, 2, 4])
    assert places == [(0, 4), (-1, -1), (2, 6)] and left == [1, 2, 1]
    places, left, _ = packed([5, 5, 3], 10, 1, [6, 2, 4])
    assert places == [(0, 4), (3, 0), (2, 6)] and left == [1, 2, 1, 5]


def test_carried():
    """Waiting pieces take the smallest gaps of the nearest range above, each once."""
    assert P.carried({0: (3, 2), 1: (1, 4), 2: (7, 0), 3: (1, 1)}) == [(1, 0, 0, 0, 1), (2, 0, 1, 0, 4), (2, 4, 0, 1, 1)]
    rng = random.Random(3)
    for _ in range(100):
        counts = {p: (rng.randint(0, 5), rng.randint(0, 5)) for p in range(8)}
        stack, wanted = [], []
        for p, (waiting, gaps) in counts.items():
            for k in range(waiting):
                if stack:
                    wanted.append(((p, k), stack.pop()))
            stack += [(p, g) for g in reversed(range(gaps))]
        assert [((p, k + i), (q, g + i)) for p, k, q, g, n in P.carried(counts) for i in range(n)] == wanted


@pytest.mark.parametrize("kind", ["mixed", "one length", "short", "halves"])
def test_many_ranges(spark, monkeypatch, kind):
    """Many small ranges: every piece in one place, sequences gapless, hardly more of them than one by one, but for one
    that each range may open in vain."""
    monkeypatch.setattr(P, "SWEPT_TOGETHER", 60)
    rng = random.Random(7)
    size = {"mixed": lambda: rng.choice((rng.randint(1, 64), rng.randint(1, 12))), "one length": lambda: 20, "short": lambda: rng.randint(1, 9), "halves": lambda: rng.randint(28, 32)}[kind]
    lengths = [size() for _ in range(900)]
    table = spark.createDataFrame(list(enumerate(lengths)), "uid long, length long")
    found = P.pack(table, 64).collect()
    assert sorted((r.uid, r.length) for r in found) == list(enumerate(lengths))
    by = defaultdict(list)
    for r in found:
        by[r.sequence_id].append((r.offset, r.length))
    assert all(gapless(c) <= 64 for c in by.values())
    assert len(by) <= 1.02 * sum(one_at_a_time(lengths, 64).values()) + 900 / 60


def test_documents(spark, documents):
    rng = random.Random(2)
    texts = ["", None, "a b c", "word " * 1023, "word " * 1022, "word " * 2500, "x"] + [" ".join(rng.choice(("the", "of", "quick")) for _ in range(rng.randint(1, 700))) for _ in range(80)]
    rows = [*enumerate(texts), (2, "a b c"), (None, "x")]
    docs = documents(rows, length=F.lit("clash"), piece=F.lit(1), id=F.lit("z"), rank=F.lit(0), uid=F.lit(1), sequence_id=F.lit(2), size=F.lit(3), kind=F.lit(4))
    found = P.pack_documents(docs, VOCABULARY).collect()
    ids = {i: [*REFERENCE.encode(t or "", add_special_tokens=False).ids, 2] for i, t in rows}
    repeats = Counter(i for i, _ in rows)
    for i, whole in ids.items():
        own = sorted((r for r in found if r.doc_id == i), key=lambda r: r.piece)
        own = own[:: repeats[i]]
        assert [r.start for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
        assert sum(r.length for r in own) == len(whole) and all(r.length == 1024 for r in own[1:])
        for r in own:
            part = whole[r.start : r.start + r.length]
            assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))
    by = defaultdict(list)
    for r in found:
        by[r.sequence_id].append((r.offset, r.length))
    for content in by.values():
        at = 0
        for offset, n in sorted(content):
            assert offset == at
            at += n
        assert at <= 1024
    total = sum(r.length for r in found)
    assert len(by) <= -(-total // 1024) + 2


def test_empty(spark, documents):
    assert P.pack_documents(documents([]), VOCABULARY).collect() == []
