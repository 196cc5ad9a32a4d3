"""BPE against the tokenizers library."""

from __future__ import annotations

import hashlib
import os
import random

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docstrata.llm import bpe

os.environ["TOKENIZERS_PARALLELISM"] = "false"
from tokenizers import Tokenizer  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
VOCABULARY = bpe.read_vocabulary(PATH)
REFERENCE = Tokenizer.from_file(PATH)
ENCODER = bpe.Encoder(VOCABULARY)
ODD = ["", " ", "  a", "a ", "\n\na", "<|endoftext|>", "x<|endoftext|> y<|endoftext|>", "a's'll' 's", "''s", "aaaaaaaa", " \n 'tis", "\x1c\x1d a\x85b", "\x00", "don't  stop\t\n", "é漢字😀 ١٢", "'re'vexx"]


def same(texts):
    found = ENCODER.encode(texts)
    wanted = REFERENCE.encode_batch(texts, add_special_tokens=False)
    for t, a, b in zip(texts, found, wanted, strict=True):
        assert a.tolist() == b.ids, t
        assert ENCODER.decode(a) == REFERENCE.decode(b.ids, skip_special_tokens=False)


def test_odd_texts():
    same(ODD)


def test_random_mixes():
    letters = "'''  \n\t\r sstmdrevell aAbé1٣²½!?-_\xa0　中😀aaaa<|endoftext|>"
    rng = random.Random(1)
    same(["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=8))
def test_any_text(texts):
    same(texts)


def test_words_are_forgotten(monkeypatch):
    monkeypatch.setattr(bpe, "MAX_WORDS", 3)
    monkeypatch.setattr(bpe, "BATCH_CHARS", 10)
    same(["one two three four five", "six seven", "one two"] * 3)


def test_long_text():
    same(["word " * 50_000, "a" * 5_000])


def test_long_texts_pass_in_parts(monkeypatch):
    monkeypatch.setattr(bpe, "BATCH_CHARS", 50)
    rng = random.Random(4)
    letters = ["word", " ", " ", "\n", "'re", "é", "x1", "<|endoftext|>", "  ", "don't", "."]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 200))) for _ in range(200)]
    assert any(len(list(ENCODER.parts(t))) > 2 for t in texts)
    same(texts)


def thue_morse(n):
    return "".join("ab"[i.bit_count() % 2] for i in range(n))


def test_words_that_polynomial_hashes_confuse():
    """A Thue-Morse word and its complement have one value under every odd base modulo 2^64."""
    flip = str.maketrans("ab", "ba")
    texts = [t for n in (64, 1024, 2048) for t in (thue_morse(n), thue_morse(n).translate(flip))]
    same(texts)
    same([" ".join(texts)])


def test_words_with_one_hash(monkeypatch):
    """Words are told apart by their bytes, whatever their hashes."""
    monkeypatch.setattr(bpe, "word_hashes", lambda octets, starts, sizes: (sizes % 3).astype(np.uint64))
    encoder = bpe.Encoder(VOCABULARY)
    texts = ["one two six ten red blue gold x y z", "two one " + "q" * 100 + " " + "r" * 100, thue_morse(128), "one zebra"]
    for _ in range(2):
        for t, ids in zip(texts, encoder.encode(texts), strict=True):
            assert ids.tolist() == REFERENCE.encode(t, add_special_tokens=False).ids


def test_digests(spark, documents):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(99, None), (5, ODD[5]), (None, "x")]
    docs = documents(rows, ids=F.lit(1), n_tokens=F.lit("clash"))
    found = {(r.doc_id, r.ids_sha256): r for r in bpe.digests(docs, VOCABULARY).collect()}
    assert len(found) == len({(i, t) for i, t in rows})
    for i, t in rows:
        ids = REFERENCE.encode(t or "", add_special_tokens=False).ids
        digest = hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest()
        r = found[i, digest]
        assert (r.n_tokens, r.decoded_sha256) == (len(ids), hashlib.sha256((t or "").encode()).hexdigest())


def test_round_trip_keeps_columns(spark, documents):
    docs = documents([(1, "Hello, world"), (2, None), (3, "")], ids=F.lit("clash"), decoded=F.lit(0))
    back = bpe.decode(bpe.encode(docs, VOCABULARY), VOCABULARY)
    assert {r.doc_id: r.decoded for r in back.collect()} == {1: "Hello, world", 2: "", 3: ""}
    assert "lang" in back.columns


def test_empty(spark, documents):
    assert bpe.digests(documents([]), VOCABULARY).collect() == []
