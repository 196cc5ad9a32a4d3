"""Secrets in texts: base patterns, and assignment-aware lexing.

The lexer reads source and configuration syntax (``name = "literal"``, ``"name": 'literal'``, ``NAME=literal``,
``name := other``, ``a = b + "literal"``, ``a = b || "literal"`` and the like, strings and YAML blocks over several lines, concatenations in parentheses,
``<name>literal</name>``, ``<x key="name" value="literal"/>``) into pairs of a target name and the literals
or names on its right. A name stands with those of the objects around it, by braces or by indentation; an object hands on to those
within it what of its name and of those around it can make a name more sensitive, which is a few kinds of words, however deep it lies. Constants are
propagated, from the most sensitive name down, each name once: a literal belongs to every name that it reaches through other names of the same text, wherever they are defined. A literal is a
secret if the most sensitive name that it reaches, times how much it looks like a secret, is at least THRESHOLD.

Cases: a null or empty text has no spans; a very long text is read line by line, in time in proportion to it, whatever is left open in it; repeated rows are scanned alike; spans are
code points, end exclusive, sorted by start and then by kind in the order of KINDS; equal spans of one kind count once. ``find``
keeps the key alone, ``redact`` all columns, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docstrata.llm.bpe import slices, with_columns

#: The kinds in their order, the base patterns and their least lengths.
KINDS = ("assign", "access", "hex", "lexed")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # the runs of [0-9a-f]+ that have 32 or more
ASSIGN_LEAST, ACCESS_LEAST = 8, 16
#: A text without these, in any case, has no assign match.
ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")

#: How sensitive a target name is by the words in it, and words that take that away.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9,
    "auth": 0.7, "bearer": 0.9, "signature": 0.6, "salt": 0.6, "private": 0.6, "key": 0.6, "access": 0.5, "encryption": 0.6, "webhook": 0.6, "dsn": 0.7, "cookie": 0.6,
}
HARMLESS = {"example", "sample", "dummy", "public", "name", "path", "file", "url", "uri", "count", "length", "size", "type", "field", "label", "id", "primary", "foreign", "index", "sort", "limit", "max", "min", "expires", "ttl", "user", "username", "host", "port", "domain", "email", "version", "region"}
#: What a name keeps of the sensitivity of the objects around it.
INHERITED = 0.8
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|<.*>|\$?\{.*\}|%\w+%|changeme|placeholder|none|null|true|false|undefined|your[\w-]*|redacted|todo)$")
THRESHOLD = 0.5

NAME = r"[A-Za-z_$][\w$]*+(?:[.\-][A-Za-z_$][\w$]*+)*+"
QUOTED = r"""\"(?:[^"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'|`(?:[^`\\\n]|\\.)*+`"""
#: A name, an assignment sign, and the terms joined by + on its right.
TERM = rf"(?:{QUOTED}|[^\s\"'`,;+(){{}}\[\]]++)"
#: What joins terms: concatenation, and defaults for what is missing.
JOINS = ("+", "||", "??", "or", "?:")
JOIN = r"(?:[ \t]*+(?:\+|\|\||\?\?|\?:)[ \t]*+|[ \t]++or[ \t]++)"
PAIR = re.compile(rf"""(?<![\w$.-])(?P<name>{NAME})["']?\]?[ \t]*+(?::=|=>|[:=](?![=:/]))[ \t]*+(?P<right>{TERM}(?:{JOIN}{TERM})*+)""")
#: What a line with braces or brackets is made of: an object that a name opens, a pair, and what opens and closes without a name.
SCAN = re.compile(rf"""(?<![\w$.-])(?P<holder>{NAME})["']?[ \t]*+(?::=|=>|[:=])[ \t]*+[{{\[]|{PAIR.pattern}|(?P<open>[{{\[])|(?P<close>[}}\]])|(?:{QUOTED})(?![ \t]*(?:[:=]))""")
HOLDER = re.compile(rf"""[ \t]*(?:-[ \t]+)?["']?(?P<name>{NAME})["']?[ \t]*:[ \t]*(?P<block>[|>][+-]?[0-9]?)?[ \t]*\r?\Z""")
TRIPLE = re.compile(rf"""(?<![\w$.-])(?P<name>{NAME})["']?[ \t]*+(?::=|=>|[:=])[ \t]*+(?P<mark>\"\"\"|\'\'\')(?P<body>.*?)(?P=mark)""", re.DOTALL)
GROUPED = re.compile(rf"""(?<![\w$.-])(?P<name>{NAME})["']?[ \t]*+(?::=|=>|[:=])[ \t]*+\((?P<right>(?:\s*+\+?\s*+(?:{QUOTED}))++)\s*+\)""")
TAG = re.compile(r"<(?P<tag>[A-Za-z_][\w.:-]*+)(?P<rest>[^<>]*+)>(?:(?P<body>[^<>]++)</(?P=tag)\s*>)?")
ATTRIBUTE = re.compile(r"""([A-Za-z_][\w.:-]*+)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)')""")
#: Attributes that name what the attribute ``value`` holds.
NAMING = ("key", "name", "id")
FRAME = re.compile(r"-----(?:BEGIN|END)[A-Z ]*-----")
TERMS = re.compile(rf"(?P<quoted>{QUOTED})|(?P<bare>[^\s\"'`,;+(){{}}\[\]]+)")
IS_NAME = re.compile(rf"{NAME}\Z")
SUBWORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")

Span = tuple[int, int, str]


def words_of(name: str) -> list[str]:
    words = [w.lower() for w in SUBWORDS.findall(name)]
    return [w[:-1] if w.endswith("s") and w[:-1] in SENSITIVE else w for w in words]


def sensitive_words(words: list[str]) -> frozenset[str]:
    """Those of the words, and of two in a row as one, that are sensitive."""
    return frozenset({*words, *(a + b for a, b in zip(words, words[1:]))} & SENSITIVE.keys())  # noqa: B905


def score_of(found: frozenset[str]) -> float:
    return min(1.0, max(SENSITIVE[w] for w in found) + 0.2 * (len(found) - 1)) if found else 0.0


#: What an object hands on: the sensitive words of its name, and its last word where that matters.
Kind = tuple[frozenset[str], str]
FULL = frozenset({"password"})
PUBLIC = {"public", "example", "sample"}
BEGINNINGS = {w[:i] for w in SENSITIVE for i in range(1, len(w))}


@lru_cache(100_000)
def kind_of(holder: str) -> Kind | None:
    """The kind of an object's name; None where it makes no name within it more sensitive. Words that suffice for the highest score
    stand for one another, so there are only so many kinds."""
    words = words_of(holder)
    found = sensitive_words(words)
    if not words or PUBLIC & {*words} or not found and words[-1] not in BEGINNINGS:
        return None
    return FULL if score_of(found) == 1.0 else found, words[-1] if words[-1] in BEGINNINGS or words[-1] in HARMLESS else ""


@lru_cache(100_000)
def kinds_within(around: frozenset[Kind], holder: str) -> frozenset[Kind]:
    kind = kind_of(holder)
    return around if kind is None or kind in around else around | {kind}


def name_score(name: str, around: Iterable[Kind] = ()) -> float:
    """How sensitive a name is within objects of these kinds, 0 to 1."""
    words = words_of(name)
    if PUBLIC & {*words} or words and words[-1] in HARMLESS:
        return 0.0
    own = sensitive_words(words)
    best = score_of(own)
    for found, last in around:
        if words or last not in HARMLESS:
            both = found | own | ({last + words[0]} & SENSITIVE.keys() if words and last else set())
            best = max(best, INHERITED * score_of(both))
    return best


def literal_score(value: str, quoted: bool) -> float:
    """How much a literal looks like a secret, 0 to 1: long, varied, without blanks, no placeholder."""
    if len(value) < 8 or PLACEHOLDER.match(value):
        return 0.0
    if any(c.isspace() for c in value):  # a word with digits may be one among few
        words = value.split() if quoted and "\n" not in value else []
        return 0.8 * max((literal_score(w, False) for w in words if any(map(str.isdigit, w))), default=0.0) if len(words) <= 3 else 0.0
    n = len(value)
    entropy = -sum(k / n * math.log2(k / n) for k in Counter(value).values())
    kinds = sum(any(f(c) for c in value) for f in (str.islower, str.isupper, str.isdigit)) + (not value.isalnum())
    if not quoted and kinds < 2 or kinds < 2 and entropy < 3.2:
        return 0.0
    return min(1.0, entropy / 3.0) * (1.0 if kinds >= 2 else 0.8)


def compact(value: str) -> str:
    """A literal over several lines as one, without the frame of a key; as it is where a line has blanks inside."""
    if "\n" not in value:
        return value
    lines = [x.strip() for x in FRAME.sub("", value).split("\n")]
    return value if any(" " in x or "\t" in x for x in lines) else "".join(lines)


def stripped(text: str, a: int, b: int) -> tuple[int, int]:
    """The span without white space at its ends."""
    return a + len(text[a:b]) - len(text[a:b].lstrip()), a + len(text[a:b].rstrip())


class Assignments:
    """The pairs of one text: literals and names by target name, and the names that stand around each."""

    def __init__(self, text: str):
        self.literals: dict[str, list[tuple[int, int, bool]]] = {}
        self.bare: list[tuple[str, int, int]] = []
        self.around: dict[str, set[Kind]] = {}
        self.text = text
        if "</" in text or "/>" in text:
            self.read_tags()
        if '"""' in text or "'''" in text:
            for m in TRIPLE.finditer(text):
                self.put(m["name"], (), *stripped(text, *m.span("body")), True)
        if "(" in text:
            for m in GROUPED.finditer(text):
                self.terms(m["name"], (), m["right"], m.start("right"))
        self.read_lines()

    def read_tags(self) -> None:
        for m in TAG.finditer(self.text):
            if m["body"]:
                self.put(m["tag"], (), *stripped(self.text, *m.span("body")), True)
            at = {k.lower(): (m.start("rest") + x.start(2 if double is not None else 3), double if double is not None else single) for x in ATTRIBUTE.finditer(m["rest"]) for k, double, single in [x.groups()]}
            if "value" in at and (name := next((at[n][1] for n in NAMING if n in at), None)):
                self.put(name, (), at["value"][0], at["value"][0] + len(at["value"][1]), True)

    def put(self, name: str, holders: Iterable[Kind], a: int, b: int, quoted: bool) -> None:
        self.literals.setdefault(name, []).append((a, b, quoted))
        self.around.setdefault(name, set()).update(holders)

    def terms(self, name: str, holders: Iterable[Kind], right: str, at: int) -> None:
        self.around.setdefault(name, set()).update(holders)
        for t in TERMS.finditer(right):
            a, b = at + t.start(), at + t.end()
            if t["quoted"]:
                self.put(name, holders, a + 1, b - 1, True)
            elif t["bare"] not in JOINS and self.text[b : b + 1] not in ("(", "["):  # no call, no element
                self.bare.append((name, a, b))

    def read_lines(self) -> None:
        at, nested, block = 0, [], None  # nested: (indentation, or None for a brace; kinds of the names around)
        for line in self.text.split("\n"):
            indent = len(line) - len(line.lstrip(" \t"))
            blank = indent == len(line)
            if block and not blank and indent <= block[1]:
                self.put(block[0], block[2], *stripped(self.text, block[3], at), True)
                block = None
            if not block and not blank:
                while nested and nested[-1][0] is not None and indent <= nested[-1][0]:
                    nested.pop()
                if ":" in line or "=" in line or nested and ("}" in line or "]" in line):
                    block = self.read(line, at, indent, nested)
            at += len(line) + 1
        if block:
            self.put(block[0], block[2], *stripped(self.text, block[3], len(self.text)), True)

    def read(self, line: str, at: int, indent: int, nested: list) -> tuple | None:
        """Reads one line; what it says if a block of lines follows that belongs to a name."""
        holders = lambda: nested[-1][1] if nested else frozenset()
        braces = any(c in line for c in "{}[]")
        for m in (SCAN if braces else PAIR).finditer(line):
            if not braces or m["name"]:
                self.terms(m["name"], holders(), m["right"], at + m.start("right"))
            elif m["holder"] or m["open"]:
                nested.append((None, kinds_within(holders(), m["holder"] or "")))
            elif m["close"]:
                while nested and nested.pop()[0] is not None:
                    pass
        if h := HOLDER.match(line):
            if h["block"]:
                return h["name"], indent, holders(), at + len(line) + 1
            nested.append((indent, kinds_within(holders(), h["name"])))
        return None


def lexed(text: str) -> list[Span]:
    """Literals that reach a sensitive name."""
    if "=" not in text and ":" not in text and "</" not in text:
        return []
    found = Assignments(text)
    known = found.around.keys()
    sources: dict[str, set[str]] = {}
    for name, a, b in found.bare:
        if IS_NAME.match(text[a:b]) and text[a:b] in known:
            sources.setdefault(name, set()).add(text[a:b])
        else:
            found.put(name, (), a, b, False)
    best: dict[tuple[int, int, bool], float] = {}
    seen: set[str] = set()
    for score, name in sorted(((name_score(name, kinds), name) for name, kinds in found.around.items()), reverse=True):
        ahead = [name] if score and name not in seen else []
        seen.update(ahead)
        while ahead:  # names that a more sensitive one has reached need no second visit
            now = ahead.pop()
            for x in found.literals.get(now, ()):
                best[x] = max(best.get(x, 0.0), score)
            new = sources.get(now, set()) - seen
            seen |= new
            ahead += new
    return sorted({(a, b, "lexed") for (a, b, quoted), score in best.items() if a < b and score * literal_score(compact(text[a:b]), quoted) >= THRESHOLD})


def base(text: str) -> list[Span]:
    """Matches of the base patterns."""
    found: list[Span] = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    return found + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def shown(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in ordered(spans))


def values(text: str, spans: list[Span]) -> Iterator[tuple[int, int]]:
    """What to hide of each span, in order and disjoint: an assign match keeps its name."""
    cuts = []
    for a, b, kind in spans:
        if kind == "assign" and (m := ASSIGN.match(text, a, b)):
            a = m.start(2)
        cuts.append((a, b))
    end = 0
    for a, b in sorted(cuts):
        if b > end:
            yield max(a, end), b
            end = b


def redacted(text: str, mark: str) -> str:
    """The text with every secret replaced."""
    spans = base(text) + lexed(text)
    if not spans:
        return text
    out, at = [], 0
    for a, b in values(text, spans):
        if a > at or not out:
            out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_assign, n_access, n_hex, base_sha256, spans) of every whole text; narrow."""

    def run(batches):
        for batch in slices(batches, text):
            counts, digests, spans = [], [], []
            for t in batch.column(batch.schema.get_field_index(text)).to_pylist():
                b = base(t or "")
                counts.append(Counter(kind for _, _, kind in b))
                digests.append(hashlib.sha256(shown(b).encode()).hexdigest())
                spans.append(shown(b + lexed(t or "")))
            yield with_columns(batch, [key], {f"n_{k}": pa.array([c[k] for c in counts], pa.int64()) for k in KINDS[:3]} | {"base_sha256": pa.array(digests, pa.string()), "spans": pa.array(spans, pa.string())})

    fields = [T.StructField(f"n_{k}", T.LongType()) for k in KINDS[:3]] + [T.StructField(c, T.StringType()) for c in ("base_sha256", "spans")]
    return docs.select(key, F.col(text)).mapInArrow(run, T.StructType([docs.schema[key], *fields]))


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with the secrets in ``text`` replaced by ``mark``; nulls stay null. Narrow."""

    def run(batches):
        for batch in slices(batches, text):
            at = batch.schema.get_field_index(text)
            new = pa.array([None if t is None else redacted(t, mark) for t in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([new if i == at else batch.column(i) for i in range(batch.num_columns)], names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def redact_documents(docs: DataFrame, text: str = "text", chars: str = "n_chars") -> DataFrame:
    """``redact``, with the column of text lengths, if there is one, brought up to date."""
    out = redact(docs, text)
    if chars not in docs.columns:
        return out
    return out.withColumn(chars, F.length(text).cast(docs.schema[chars].dataType)).select(docs.columns)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of documents."""
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
