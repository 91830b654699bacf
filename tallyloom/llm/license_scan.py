"""License scan: ordered signature rules over whole texts.

Hundreds of regular expressions, each with a label, a priority and keywords. One Aho-Corasick pass over a text tells
which keywords stand in it as words; only rules with all their keywords there run. Detections are intervals of bytes. A detection goes if it lies within that of
a rule of higher priority, or within a longer one of the same priority; the labels of the rest are the text's labels.

The rules are written as families (names, versions) times forms (notice, SPDX tag, address); ``signature_rules`` spells
them out. Besides, the base phrases are counted at all places, and their labels always stay.

Defined cases: a null text counts as empty and has no words, labels '' and score 0; repeated rows get equal results; an
empty table gives no rows; extra columns are not read; texts are scanned whole. Equal intervals of one label count once; of equal
intervals and priorities the first label in text order stays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

_GAP = rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"  # what stands between words, after A-Z became a-z
_EDGE = rb"(?<![0-9a-z\x80-\xff])", rb"(?![0-9a-z\x80-\xff])"
_WORD = np.ones(256, dtype=bool)
for _low, _high in ((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)):
    _WORD[_low : _high + 1] = False
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    keywords: tuple[str, ...]
    pattern: re.Pattern[bytes]
    weight: float


def _compiled(phrase: str) -> re.Pattern[bytes]:
    """Words of ``phrase`` with any marks between them. ``(a|b)`` are alternatives, ``x?`` is a word that may lack."""
    out, gap = b"", False
    for part in phrase.split():
        body = part.removesuffix("?").encode()
        if part.endswith("?"):
            out += b"(?:" + _GAP + body + b")?" if gap else b"(?:" + body + _GAP + b")?"
        else:
            out, gap = out + (_GAP if gap else b"") + body, True
    return re.compile(_EDGE[0] + out + _EDGE[1])


#: name of the family: (label, keyword, names, versions)
_FAMILIES = [
    ("apache", "apache", ["apache", "apache software"], ["1.0", "1.1", "2.0"]),
    ("gpl", "gnu", ["gnu general public", "gnu gpl", "gnu public"], ["1", "2", "2.0", "3", "3.0"]),
    ("gpl", "general public", ["general public"], ["2", "2.0", "3", "3.0"]),
    ("lgpl", "lesser", ["gnu lesser general public", "lesser general public"], ["2.1", "3", "3.0"]),
    ("lgpl", "library general", ["gnu library general public", "library general public"], ["2", "2.0"]),
    ("agpl", "affero", ["gnu affero general public", "affero general public"], ["1", "3", "3.0"]),
    ("mpl", "mozilla", ["mozilla public"], ["1.0", "1.1", "2.0"]),
    ("epl", "eclipse", ["eclipse public"], ["1.0", "2.0"]),
    ("eupl", "european union", ["european union public"], ["1.0", "1.1", "1.2"]),
    ("cddl", "common development", ["common development and distribution"], ["1.0", "1.1"]),
    ("cpl", "common public", ["common public"], ["1.0"]),
    ("artistic", "artistic", ["artistic", "perl artistic"], ["1.0", "2.0"]),
    ("bsl", "boost", ["boost software"], ["1.0"]),
    ("afl", "academic free", ["academic free"], ["2.1", "3.0"]),
    ("osl", "open software", ["open software"], ["2.1", "3.0"]),
    ("ofl", "open font", ["sil open font", "open font"], ["1.0", "1.1"]),
    ("odbl", "open database", ["open database", "open data commons open database"], ["1.0"]),
    ("gfdl", "free documentation", ["gnu free documentation", "free documentation"], ["1.1", "1.2", "1.3"]),
    ("mit", "mit", ["mit", "mit x11", "expat"], []),
    ("isc", "isc", ["isc"], []),
    ("bsd", "bsd", ["bsd", "new bsd", "modified bsd", "simplified bsd", "revised bsd", "(2|3|4) clause bsd", "bsd (2|3|4) clause"], []),
    ("zlib", "zlib", ["zlib", "zlib libpng"], []),
    ("ms-pl", "microsoft public", ["microsoft public"], []),
    ("ms-rl", "microsoft reciprocal", ["microsoft reciprocal"], []),
    ("python", "python software", ["python software foundation"], ["2"]),
    ("postgresql", "postgresql", ["postgresql"], []),
    ("ruby", "ruby", ["ruby"], []),
    ("wtfpl", "do what the", ["do what the f[a-z]* you want to public"], ["2"]),
]
#: Forms of a notice: (words before the name, words behind, priority, weight)
_FORMS = [
    ("", "license", 40, 0.8), ("", "licence", 40, 0.8),
    ("licensed? under the?", "license", 60, 0.95), ("distributed under the?", "license", 60, 0.95),
    ("released under the?", "license", 60, 0.95), ("under the? terms of the?", "license", 60, 0.95),
    ("available under the?", "license", 60, 0.9), ("covered by the?", "license", 55, 0.9),
]
#: SPDX identifiers, with '-' and '.' as gaps.
_TAGS = {
    "apache": ["apache 1 0", "apache 1 1", "apache 2 0"], "mit": ["mit", "mit 0", "x11"], "isc": ["isc"], "zlib": ["zlib"],
    "bsd": ["bsd 2 clause", "bsd 3 clause", "bsd 4 clause", "0bsd"], "unlicense": ["unlicense"], "wtfpl": ["wtfpl"],
    "gpl": [f"gpl {v} 0{x}" for v in "123" for x in ("", " only", " or later")],
    "lgpl": [f"lgpl {v}{x}" for v in ("2 0", "2 1", "3 0") for x in ("", " only", " or later")],
    "agpl": [f"agpl {v} 0{x}" for v in "13" for x in ("", " only", " or later")],
    "mpl": ["mpl 1 0", "mpl 1 1", "mpl 2 0"], "epl": ["epl 1 0", "epl 2 0"], "eupl": ["eupl 1 1", "eupl 1 2"], "cc0": ["cc0 1 0"],
    "bsl": ["bsl 1 0"], "artistic": ["artistic 1 0", "artistic 2 0"], "cddl": ["cddl 1 0", "cddl 1 1"], "ofl": ["ofl 1 0", "ofl 1 1"],
}
#: Addresses: label, words of the address, keyword.
_ADDRESSES = [
    ("apache", "apache org licenses license 2 0", "apache"), ("gpl", "gnu org licenses gpl (1|2|3)? 0?", "licenses"), ("lgpl", "gnu org licenses lgpl (2|3)? (0|1)?", "licenses"),
    ("agpl", "gnu org licenses agpl 3? 0?", "licenses"), ("mit", "opensource org licenses mit", "licenses"), ("bsd", "opensource org licenses bsd (2|3)? clause?", "licenses"),
    ("mpl", "mozilla org mpl (1|2)? (0|1)?", "mozilla"), ("unlicense", "unlicense org", "unlicense"), ("cc0", "creativecommons org publicdomain zero 1 0", "creativecommons"),
]
_WHOLE = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "hereby granted", 70, 1.0),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution", 70, 1.0),
    ("isc", "permission to use copy modify and or? distribute this software for any purpose", "distribute this", 70, 1.0),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered", 70, 1.0),
    ("public-domain", "(released|dedicated|placed) (into|to|in) the public domain", "public domain", 50, 0.8),
    ("proprietary", "all rights reserved", "all rights", 20, 0.4), ("proprietary", "proprietary and confidential", "proprietary", 50, 0.8),
    ("apache", "you may not use this file except in compliance with the license", "in compliance", 65, 0.95),
    ("gpl", "free software you can redistribute it and or? modify it under the terms", "redistribute", 65, 0.9),
    ("notice", "permission notice shall be included in all copies", "permission notice", 30, 0.5),
]


_COMMON = {"in", "the", "do", "this", "all", "or", "by", "later", "only", "what"}


@cache
def signature_rules() -> tuple[Rule, ...]:
    """All rules, highest priority first."""
    out = []
    for label, keyword, names, versions in _FAMILIES:
        for name in names:
            needs = keyword if set(keyword.split()) <= set(name.split()) else name  # only words that the pattern requires
            for before, behind, priority, weight in _FORMS:
                out.append(Rule(label, priority, _words(needs, behind), _compiled(f"{before} {name} {behind}"), weight))
                for v in versions:
                    numbered = f"{before} {name} {behind} (version|v)? v?{v.replace('.', ' ')}"
                    out.append(Rule(f"{label}-{v}", priority + 10, _words(needs, behind), _compiled(numbered), weight))
    for label, tags in _TAGS.items():
        for tag in tags:
            out.append(Rule(label, 90, ("spdx", "license"), _compiled(f"spdx license identifier {tag}"), 1.0))
            if " " in tag and tag != "mit 0":
                out.append(Rule(label, 80, _words(tag), _compiled(f"(license|licence|licensed)? under? {tag} license?"), 0.85))
    for part in ("by", "by sa", "by nd", "by nc", "by nc sa", "by nc nd"):
        label = "cc-" + part.replace(" ", "-")
        long = part.replace("by", "attribution").replace("sa", "share ?alike").replace("nd", "no ?derivatives").replace("nc", "non ?commercial")
        for v in ("", "1.0", "2.0", "2.5", "3.0", "4.0"):
            tail = (" " + v.replace(".", " ")) if v else ""
            name = label + (f"-{v}" if v else "")
            rank = 40 + 5 * len(part.split()) + (10 if v else 0)
            out.append(Rule(name, rank, _words("cc", part), _compiled(f"cc {part}{tail}"), 0.9))
            out.append(Rule(name, rank + 1, ("creative", "commons"), _compiled(f"creative commons {long.replace(' ?', '[^0-9a-z]*')}{tail}"), 0.95))
            if v:
                out.append(Rule(name, rank + 2, ("creativecommons", "licenses"), _compiled(f"creativecommons org licenses {part}{tail}"), 1.0))
    out += [Rule(label, 75, _words(keyword, words.split()[1]), _compiled(words), 0.9) for label, words, keyword in _ADDRESSES]
    out += [Rule(label, priority, _words(keyword), _compiled(words), weight) for label, words, keyword, priority, weight in _WHOLE]
    return tuple(sorted(out, key=lambda r: (-r.priority, r.label, r.pattern.pattern)))


def _words(*parts: str) -> tuple[str, ...]:
    """The plain words of keywords that tell something, each once; numbers alone don't."""
    return tuple(sorted({w for p in parts for w in p.split() if w.isalnum() and not w.isdigit() and w not in _COMMON}))


@cache
def _gate():
    """The automaton over single keywords, and the rules (base phrases: None) by the keywords they need."""
    by: dict[frozenset[str], list[int]] = {}
    for i, rule in enumerate(signature_rules()):
        by.setdefault(frozenset(rule.keywords), []).append(i)
    for phrase in BASE:
        by.setdefault(frozenset(_words(phrase)), [])
    machine = ahocorasick.Automaton()
    for word in {w for needs in by for w in needs}:
        machine.add_word(word, (word, len(word)))
    machine.make_automaton()
    return machine, by


_BASE_RULES = [(label, _compiled(phrase)) for phrase, label in BASE.items()]


def scan_text(text: str | None) -> tuple[int, int, int | None, int | None, str, str, float, int]:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, n_found."""
    raw = (text or "").encode("utf-8", "replace").translate(_LOWER)
    word = _WORD[np.frombuffer(raw, dtype=np.uint8)]
    starts = np.flatnonzero(word & ~np.concatenate([[False], word[:-1]])) if len(raw) else np.zeros(0, dtype=np.int64)
    machine, by = _gate()
    last = len(raw)
    keys = {w for end, (w, n) in machine.iter(raw.decode("latin-1")) if not (end + 1 < last and word[end + 1]) and not (end >= n and word[end - n])}
    wanted = [needs for needs in by if needs <= keys]
    if not wanted:
        return len(starts), 0, None, None, "", "", 0.0, 0
    base = [(m.start(), label) for label, pattern in _BASE_RULES for m in pattern.finditer(raw)]
    rules = signature_rules()
    spans = []
    for i in sorted({i for needs in wanted for i in by[needs]}):
        rule = rules[i]
        for m in rule.pattern.finditer(raw):
            spans.append((-rule.priority, m.start() - m.end(), m.start(), m.end(), rule.label, rule.weight))
    kept = uncontained(sorted(set(spans)))
    at = np.searchsorted(starts, [p for p, _ in base])
    base_labels = sorted({label for _, label in base})
    labels = sorted({k[4] for k in kept} | set(base_labels))
    score = 1 - float(np.prod([1 - k[5] for k in kept])) if kept else (0.8 if base else 0.0)
    return (len(starts), len(base), int(at.min()) if len(base) else None, int(at.max()) if len(base) else None,
            ",".join(base_labels), ",".join(labels), round(score, 9), len(kept))


def uncontained(spans: list[tuple]) -> list[tuple]:
    """Of spans (rank, -length, start, end, ...) in ascending order those that lie within no earlier one that stays.

    What a span that doesn't stay contains lies within a span that does, so each is held against all earlier ones at once: ``far`` has
    the furthest end among those that start at or before a place, as a tree of prefix maxima, in steps of the logarithm.
    """
    places = {p: i for i, p in enumerate(sorted({s[2] for s in spans}), 1)}
    far = [-1] * (len(places) + 1)
    kept = []
    for s in spans:
        i, reach = places[s[2]], -1
        while i:
            reach, i = max(reach, far[i]), i & (i - 1)
        if reach < s[3]:
            kept.append(s)
            i = places[s[2]]
            while i < len(far):
                far[i], i = max(far[i], s[3]), i + (i & -i)
    return kept


_OUT = pa.schema([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
                  ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("n_found", pa.int64())])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_found) for each row; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [scan_text(t) for t in b.column(1).to_pylist()]
            cols = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_OUT)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["doc_id", *_OUT.names])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, n_found bigint")
