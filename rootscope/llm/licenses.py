"""Licence scan: Aho-Corasick over word sequences, and a shunting-yard parser for tagged expressions.

A text becomes the sequence of its lower-cased words; one automaton finds the words of every notice
phrase and of the identifier tag standing consecutively, in one pass whatever the number of phrases.
After a tag it found, the expression (and / or / with, brackets) is read from the text itself, turned to postfix by
the shunting-yard algorithm and evaluated: every licence named becomes a label, AND takes the stricter and
OR the freer side's openness, WITH raises it. An expression that does not parse gives labels for the licence
names that it holds, and no verdict.

score: openness of what is granted, from 0 to 1 (0: nothing found, or all rights reserved); the strictest
finding of a text counts. Null or empty text: no words and no labels. Each row is judged alone, repeated ones alike; an
empty table gives none. Phrases may overlap, and each place of each counts. One pass whatever the text's length. Columns
that are kept must not have names of SCHEMA.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, unique_name

#: Phrase to label.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: The method's own phrases; none is part of a base label.
PHRASES = {
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0": "cc0-1.0",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0-1.0",
    "gnu general public license": "gpl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "apache license": "apache",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "isc license": "isc",
    "boost software license": "bsl-1.0",
    "released into the public domain": "public-domain",
    "proprietary and confidential": "proprietary",
}
TAG = "spdx license identifier"
#: How openly a family of licences lets a text be used.
OPENNESS = {
    "reserved": 0.0, "proprietary": 0.0, "cc-by-nc": 0.3, "cc-by-nd": 0.3, "agpl": 0.4, "gpl": 0.5, "cc-by-sa": 0.6,
    "lgpl": 0.6, "mpl": 0.7, "epl": 0.7, "cc-by": 0.9, "apache": 0.9, "bsd": 0.9, "bsl": 0.9, "mit": 0.9, "isc": 0.9,
    "cc0": 1.0, "public-domain": 1.0, "unlicense": 1.0,
}
UNKNOWN, EXCEPTION = 0.5, 0.1
_TOKEN = re.compile(rb"[ \t]*(\(|\)|[A-Za-z0-9][A-Za-z0-9.+\-]*)")
_WORD = re.compile(rb"[^ ]+")
_COLON = re.compile(rb"[ \t]*:?")
_BINDS = {"or": 1, "and": 2, "with": 3}


def openness(licence: str) -> float:
    """Of the longest family that the licence's name starts with."""
    families = [f for f in OPENNESS if licence == f or licence.startswith(f + "-")]
    return OPENNESS[max(families, key=len)] if families else UNKNOWN


def tokens(raw: bytes, at: int) -> list[str]:
    """The expression's tokens from at: while operators join names, on one line."""
    out: list[str] = []
    depth, wants = 0, True
    while m := _TOKEN.match(raw, at):
        t = m[1].decode()
        low = t.lower()
        if t == "(" and wants:
            depth += 1
        elif t == ")" and not wants and depth:
            depth -= 1
        elif low in _BINDS and not wants:
            wants = True
        elif low not in _BINDS and t not in "()" and wants:
            wants = False
            t = t.rstrip(".")
        else:
            break
        out.append(low if low in _BINDS else t.lower())
        at = m.end()
    return out


def postfix(parts: list[str]) -> list[str] | None:
    """Shunting-yard; None if the brackets or operators do not match."""
    out: list[str] = []
    held: list[str] = []
    operands = 0
    for t in parts:
        if t in _BINDS:
            while held and held[-1] != "(" and _BINDS[held[-1]] >= _BINDS[t]:
                out.append(held.pop())
            held.append(t)
        elif t == "(":
            held.append(t)
        elif t == ")":
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                return None
            held.pop()
        else:
            operands += 1
            out.append(t)
    while held:
        if (t := held.pop()) == "(":
            return None
        out.append(t)
    return out if operands == 1 + sum(t in _BINDS for t in out) else None


def evaluate(parts: list[str]) -> tuple[set[str], float | None]:
    """Labels and openness of an expression."""
    named = {t for i, t in enumerate(parts) if t not in _BINDS and t not in "()" and (not i or parts[i - 1] != "with")}
    if (steps := postfix(parts)) is None:
        return named, None
    stack: list[tuple[float, bool]] = []
    for t in steps:
        if t not in _BINDS:
            stack.append((openness(t), True))
            continue
        if len(stack) < 2:
            return named, None
        (b, _), (a, simple) = stack.pop(), stack.pop()
        if t == "with" and not simple:
            return named, None
        stack.append((min(a, b) if t == "and" else max(a, b) if t == "or" else min(1.0, a + EXCEPTION), False))
    return named, stack[0][0] if len(stack) == 1 else None


def automaton() -> ahocorasick.Automaton:
    found: dict[str, list] = {}
    for phrases, base in ((BASE, True), (PHRASES, False)):
        for phrase, label in phrases.items():
            found.setdefault(phrase, []).append((base, label))
    found.setdefault(TAG, []).append((False, None))
    a = ahocorasick.Automaton()
    for phrase, what in found.items():
        a.add_word(f" {phrase} ", (phrase, what))
    a.make_automaton()
    return a


def scan(raw: bytes, a: ahocorasick.Automaton) -> tuple:
    spaced = raw.translate(ALNUM)
    words = spaced.split()
    # One space after each word and one before the first: a match's spaces count the words before it.
    flat = (b" " + b" ".join(words) + b" ").decode("latin-1")
    n_base, base, labels, levels, expressions = 0, set(), set(), [], []
    first = last = None
    tags = []  # last words of identifier tags
    passed = counted = 0
    for end, (phrase, what) in a.iter(flat):  # in the order of their ends
        counted += flat.count(" ", passed, end)
        passed = end
        at = counted - phrase.count(" ") - 1
        for is_base, label in what:
            if label is None:
                tags.append(counted - 1)
                continue
            labels.add(label)
            levels.append(openness(label))
            if is_base:
                n_base += 1
                base.add(label)
                first, last = at if first is None else min(first, at), at if last is None else max(last, at)
    if tags:
        ends = [m.end() for m in _WORD.finditer(spaced)]
        for tag in tags:
            if parts := tokens(raw, _COLON.match(raw, ends[tag]).end()):
                named, level = evaluate(parts)
                labels |= {n.replace(",", "") for n in named}
                expressions.append(" ".join(parts))
                if level is not None:
                    levels.append(level)
    own = min(levels, default=0.0)
    return len(words), n_base, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), own, expressions


SCHEMA = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "expressions array<string>"
)
_TYPES = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.string())]


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a = automaton()
    for batch in batches:
        *others, text = batch.columns
        rows = [scan(x or b"", a) for x in text.to_pylist()]
        own = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(_TYPES), _TYPES)]
        yield pa.RecordBatch.from_arrays(
            [*others, *own], names=[*batch.schema.names[:-1], *(x.split()[0] for x in SCHEMA.split(", "))]
        )


def license_scan(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns keep of df, and each text's findings (SCHEMA); expressions holds the tagged ones."""
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields)
    return df.select(*keep, F.col(text).cast("binary").alias(unique_name(df.select(*keep), "text"))).mapInArrow(_scanned, f"{own}, {SCHEMA}")


def op10(spark, sf_dir):
    from .common import table

    return license_scan(table(spark, sf_dir, "documents"), ["doc_id"])
