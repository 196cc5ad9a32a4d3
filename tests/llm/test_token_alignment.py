"""Alignments against the two libraries and a plain walk over byte offsets."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from compare import DATA
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docstrata.llm import token_alignment as A
from docstrata.llm.bpe import read_vocabulary

VOCABULARY, MODEL = read_vocabulary(P.path("byte_bpe_50k.json")), A.read_model(P.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def both():
    t = Tokenizer.from_str(VOCABULARY)
    t.encode_special_tokens = True
    t.no_truncation()
    t.no_padding()
    # the byte-level alphabet: printable characters stand for themselves, the others follow from 256 on
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    s = sentencepiece.SentencePieceProcessor(model_proto=MODEL)

    def encode(text):
        a, b = t.encode(" " + text, add_special_tokens=False).ids, s.encode(text)
        of_a = [bytes(byte[c] for c in t.id_to_token(i)) for i in a]
        of_b = [bytes([int(n[3:5], 16)]) if s.is_byte(i) else n.replace("▁", " ").encode() for i in b for n in [s.id_to_piece(i)]]
        return (a, b, of_a, of_b) if b"".join(of_a) == b"".join(of_b) == (" " + text).encode() else ([], [], [], [])

    return encode


def brute(encode, rows):
    docs, held = [], Counter()
    for id, text in rows:
        a, b, of_a, of_b = encode(text) if text else ([], [], [], [])
        spans = []
        for tokens in (of_a, of_b):
            ends = np.cumsum([len(x) for x in tokens]).tolist()
            spans.append(list(zip([0, *ends], ends)))  # noqa: B905
        links, j = [], 0
        for i, (s, e) in enumerate(spans[0]):
            while j and spans[1][j][0] > s:
                j -= 1
            while spans[1][j][1] <= s:
                j += 1
            k = j
            while k < len(b) and spans[1][k][0] < e:
                links.append((a[i], b[k]))
                k += 1
        common = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, at, i, j = [], 0, 0, 0
        for c in common:
            x, y = [], []
            while i < len(a) and spans[0][i][1] <= c:
                x, i = [*x, a[i]], i + 1
            while j < len(b) and spans[1][j][1] <= c:
                y, j = [*y, b[j]], j + 1
            groups.append(",".join(map(str, x)) + "|" + ",".join(map(str, y)))
        held.update(set(links))
        docs.append((id, len(a), len(b), groups, links))
    most: dict = {}
    for (x, _), n in held.items():
        most[x] = max(most.get(x, 0), n)
    return sorted(((id, na, nb, len(g), len(links), sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links), ";".join(g)) for id, na, nb, g, links in docs), key=str)


TEXTS = ["", None, "a", " ", "   two  blanks ", "Hello, world! naïve façade 你好 🙂🙂 ß́", "a▁b", "<|endoftext|> and </s> <s> <unk> <0x41>", "tab\there\nand\r\nthere\n\n  end\x00nul", "internationalization of antidisestablishmentarianism", " 　 wide", "the the the the", "https://example.org/a?b=c&d=1234567890", "x" * 500, "ﬁne Ａ ① é é", "\n", "​﻿"]


def test_equals_a_plain_walk(spark, documents, both):
    rng = np.random.default_rng(1)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "a"), (None, "Hello, world!"), (3, "a")]
    rows += [(100 + i, "".join(rng.choice(["the ", "token", "  ", "é", "🙂", "\n", "ization", " of", "Ω", "1", "..", "-"], 40))) for i in range(30)]
    df = documents(rows, id=F.lit("clash"), batch=F.lit(1), groups=F.lit(2), TEXT_=F.lit(3)).repartition(3)
    wanted = brute(both, rows)
    assert sorted(map(tuple, A.align(df, VOCABULARY, MODEL).collect()), key=str) == wanted
    digests = sorted(map(tuple, A.align(df, VOCABULARY, MODEL, digests=True).collect()), key=str)
    assert digests == sorted(((*w[:7], hashlib.sha256(w[7].encode()).hexdigest() if w[7] else "") for w in wanted), key=str)


def test_pair_counts(spark, documents):
    found = {(r.a, r.b): (r.documents, r.best) for r in A.pair_counts(documents([(1, "a"), (2, "a"), (3, "a a"), (4, "b")]), VOCABULARY, MODEL).collect()}
    assert sorted(found.values()) == [(1, True), (3, True)]


def test_long_texts_are_cut_between_words(both, monkeypatch):
    p = A.Pieces(MODEL)
    text = "".join(np.random.default_rng(2).choice(["word ", "  ", "é", "longer", "\n", " x"], 5000))
    whole = p.model.encode(text)
    monkeypatch.setattr(A, "BATCH_CHARS", 50)
    monkeypatch.setattr(A, "MAX_WORDS", 40)
    assert [x.tolist() for x in p.encode([text, "", "a ", text])] == [whole, [], p.model.encode("a "), whole] and whole == both(text)[1]


def test_union_find():
    """Components of overlapping cuts, chains over a whole text included, against labels that spread along the links."""
    rng = np.random.default_rng(3)
    for n in (1, 2, 50, 400):
        for chain in (False, True):
            ends = [np.unique(np.append(rng.integers(1, 4 * n + 1, n), 4 * n)) for _ in range(2)] if not chain else [np.append(np.arange(2, 4 * n, 2), 4 * n), np.append(np.arange(1, 4 * n, 2), 4 * n)]
            cuts = np.union1d(*ends)
            link_a, link_b = (np.searchsorted(e, cuts) for e in ends)
            label = list(range(len(ends[0]))), [10**9] * len(ends[1])
            for _ in range(len(cuts) if n <= 50 else 2 * len(cuts)):
                was = [list(x) for x in label]
                for a, b in zip(link_a.tolist(), link_b.tolist(), strict=True):
                    label[0][a] = label[1][b] = min(label[0][a], label[1][b])
                if was == [list(x) for x in label]:
                    break
            assert [x.tolist() for x in A.united(len(ends[0]), link_a, link_b)] == [list(x) for x in label]


def test_empty_table(spark, documents):
    assert A.align(documents([]), VOCABULARY, MODEL).collect() == []
    assert A.align(documents([(1, None)]), VOCABULARY, MODEL).collect() == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_query(spark, both):
    found = sorted(map(tuple, A.op11_alignment(spark, str(DATA / "sf0.001")).collect()), key=str)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(str(DATA / "sf0.001" / "documents.parquet")).collect()]
    wanted = brute(both, rows)
    assert found == sorted(((*w[:7], hashlib.sha256(w[7].encode()).hexdigest() if w[7] else "") for w in wanted), key=str)
