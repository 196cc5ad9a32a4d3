"""License scans against Python's own regular expressions."""

from __future__ import annotations

import re
import sys
import time
from re import _constants, _parser

from compare import DATA
from pyspark.sql import functions as F

from docstrata.llm import licenses as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
RULES = [(p, label, k, re.compile(x), w) for p, label, k, x, w in L.signature_rules()]


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    base = []
    for phrase, label in L.BASE.items():
        p = phrase.split()
        base += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    joined = f" {' '.join(words)} "
    hits = [(m.start(), m.end(), p, label, w) for p, label, k, x, w in RULES if k in joined for m in x.finditer(joined)]
    kept = [h for h in hits if not any(e[0] <= h[0] and e[1] >= h[1] and e[2] < h[2] for e in hits)]
    starts, labels = [i for i, _ in base], {b for _, b in base}
    score = max([0.0, *(h[4] for h in kept), *([L.BASE_WEIGHT] if base else [])])
    return (len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {h[3] for h in kept})), score)


def columns(r):
    return (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score)


TEXTS = [
    None, "", " ", "Licensed under the MIT License.", "under the mit license under the mit license", "Apache License, Version 2.0", "CC BY-NC 4.0, cc_by nc",
    "This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: Apache-2.0", "SPDX-License-Identifier: LGPL-2.1-or-later", "GNU Affero General Public License v3",
    "dual licensed under the terms of the Mozilla Public License 2.0 or the Artistic License", "https://opensource.org/licenses/MIT", "the wtfpl v2", "dedicated to the public domain", "underé the mit license", "under the mit licenseſ",
    "BSD 3-Clause License and the ISC License", "Creative Commons Attribution-ShareAlike 4.0", "K under the mit license", "no license here at all", "x " * 30_000 + "under the MIT license " * 50,
]


def test_texts(spark, documents):
    docs = documents([*enumerate(TEXTS), (3, TEXTS[3]), (None, "cc by nc")], words=F.lit(1), base=F.lit("clash"), detections=F.lit(0))
    found = L.scan(docs).collect()
    assert len(found) == len(TEXTS) + 2
    for r in found:
        assert columns(r) == brute(TEXTS[r.doc_id] if r.doc_id is not None else "cc by nc"), r.doc_id


def test_suppression(spark, documents):
    r = L.scan(documents([(1, "released under the GNU General Public License version 3")])).first()
    assert r.labels == "gpl-3" and len(r.detections) == 1


def test_hundreds_of_rules():
    assert len(RULES) > 350 and len({p for p, *_ in RULES}) == len(RULES)


def forms(parsed):
    """All texts that an expression of literals, sets, alternatives and optional parts matches; of what repeats more often, the shortest."""
    out = [""]
    for op, arg in parsed:
        if op is _constants.LITERAL:
            more = [chr(arg)]
        elif op is _constants.NOT_LITERAL:
            more = ["zq"]
        elif op is _constants.IN:
            more = [c for kind, v in arg for c in ([chr(v)] if kind is _constants.LITERAL else map(chr, range(v[0], v[1] + 1)))]
        elif op is _constants.BRANCH:
            more = [f for branch in arg[1] for f in forms(branch)]
        elif op is _constants.SUBPATTERN:
            more = forms(arg[3])
        else:
            assert op is _constants.MAX_REPEAT
            least, most, inner = arg
            more = forms(inner) if least else ["", *(forms(inner) if most == 1 else ())]
        out = [a + b for a in out for b in more]
    return out


#: (keyword, a text that its rule matches), for all forms of all titles, notices and addresses.
FORMS = [(k, f) for _, k, x, *_ in [(t[0], t[1], t[2]) for t in L.LICENSES] + L.NOTICES + L.ADDRESSES for f in forms(_parser.parse(x))]
IDS = [f for *_, id in L.LICENSES if id for f in forms(_parser.parse(id))]


def test_keywords_and_gate_hold_for_every_form():
    passes = lambda f: any(x in f for x in L.GATE)
    assert [(k, f) for k, f in FORMS if k not in f or not passes(f)] == []
    assert all(map(passes, L.BASE))


def test_every_form_is_found(spark, documents, monkeypatch):
    """In every kind of signature, against a brute force without keyword or gate."""
    texts = []
    for _, f in FORMS:
        texts += [f, f"Released under the {f.upper()}", f"a {f} b".replace(" ", "_-\n")]
    for f in IDS:
        texts += [f"SPDX-License-Identifier: {f}", f"https://opensource.org/licenses/{f}", f"https://spdx.org/licenses/{f.replace(' ', '-')}.html", f"choosealicense.com/licenses/{f}/"]
    found = {r.doc_id: r for r in L.scan(documents(list(enumerate(texts)))).collect()}
    monkeypatch.setattr(sys.modules[__name__], "RULES", [(p, label, "", x, w) for p, label, _, x, w in RULES])
    assert [t for i, t in enumerate(texts) if columns(found[i]) != brute(t)] == []
    assert [t for i, t in enumerate(texts) if not found[i].labels] == []


CANONICAL = {
    "http://www.apache.org/licenses/LICENSE-2.0": "apache-2", "https://creativecommons.org/licenses/by-nc/4.0/": "cc-by-nc", "https://creativecommons.org/publicdomain/zero/1.0/legalcode": "cc0-1",
    "https://www.gnu.org/licenses/gpl-3.0.html": "gpl-3", "https://opensource.org/license/mit/": "mit", "https://www.mozilla.org/en-US/MPL/2.0/": "mpl-2", "https://unlicense.org/": "unlicense", "https://opensource.org/licenses/BSD-3-Clause": "bsd-3-clause",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\")": "mit",
    "Redistribution and use in source and binary forms, with or without modification, are permitted": "bsd",
    "either version 3 of the License, of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or": "gpl-3",
    "MIT No Attribution": "mit-0", "GNU GPL": "gpl", "PSF license": "python-2",
}


def test_canonical_texts(spark, documents):
    found = {r.doc_id: r.labels for r in L.scan(documents(list(enumerate(CANONICAL)))).collect()}
    assert [found[i] for i in range(len(CANONICAL))] == list(CANONICAL.values())


def test_many_detections_in_one_text(spark, documents):
    text = "Licensed under the GNU General Public License version 3, or the MIT License. " * 3000
    r = L.scan(documents([(1, text)])).first()
    assert columns(r) == (13 * 3000, 0, None, None, "", "gpl-3,mit", 0.95) and len(r.detections) == 6000


def test_time_grows_with_the_detections(spark, documents):
    """Some 24,000 detections in one text take no more than about twice the time of 12,000."""

    def seconds(n):
        docs = documents([(1, "the mit license and apache license version 2 under gpl " * n)])
        began = time.perf_counter()
        assert len(L.scan(docs).first().detections) == 2 * n
        return time.perf_counter() - began

    seconds(10)
    assert seconds(12_000) < 3.5 * seconds(6_000)


def test_whole_table(spark):
    docs = spark.read.parquet(str(DATA / "sf0.001" / "documents.parquet"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in L.op1_licenses(spark, str(DATA / "sf0.001")).collect():
        assert columns(r) == brute(texts[r.doc_id])


def test_empty(spark, documents):
    assert L.scan(documents([])).collect() == []
