"""Licence scans: notice phrases and identifier tags, and the expressions behind tags.

One Aho-Corasick automaton finds the words of notice phrases, another identifier tags
in the raw text. What follows a tag is read by a shunting-yard parser, which evaluates
and / or / with expressions to the obligation that is left to whoever takes the text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .textbytes import chunks

# The base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Further notice phrases (lower-case words) and their labels.
NOTICES = {
    "permission is hereby granted free of charge to any person": "mit",
    "licensed under mit": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "permission to use copy modify and or distribute this software": "isc",
    "isc license": "isc",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "creative commons attribution": "cc-by",
    "cc by": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc0": "cc0",
    "creative commons zero": "cc0",
    "boost software license": "bsl",
    "european union public licence": "eupl",
    "this is free and unencumbered software": "unlicense",
    "all rights reserved": "reserved",
}

# What an identifier tag begins with (lower case).
TAGS = ["spdx-license-identifier:", "license-expression:", "@license "]

#: Obligations of a licence, from the lightest.
OBLIGATIONS = ["permissive", "weak", "strong", "unknown"]

# Licence families of identifiers, by obligation.
FAMILIES = {
    "permissive": ["0bsd", "apache", "bsd", "bsl", "cc-by", "cc0", "isc", "mit", "postgresql", "python", "unlicense", "wtfpl", "zlib"],
    "weak": ["artistic", "cddl", "cc-by-sa", "epl", "eupl", "lgpl", "mpl", "ofl"],
    "strong": ["agpl", "gpl"],
    "unknown": ["cc-by-nc", "cc-by-nc-sa", "cc-by-nd", "licenseref"],
}
_RANK = {name: OBLIGATIONS.index(o) for o, names in FAMILIES.items() for name in names}
#: An identifier: a family, then versions and words such as only or clause; a reference may have any name.
_ID = re.compile(r"(licenseref)-[a-z0-9.-]+|(" + "|".join(sorted(map(re.escape, _RANK), key=len, reverse=True)) + r")(?:-(?:[0-9][0-9.]*|only|or|later|clause|clear|patent))*\+?")
#: Exceptions that let other works link to a strongly protected one.
_LINKING = re.compile(r"(?:classpath|gcc|llvm|linking|font|bootloader|autoconf|bison|openssl|qt|wxwindows|u-boot|universal-foss)[a-z0-9.-]*")
_TOKEN = re.compile(r"[ \t]*([a-z0-9][a-z0-9.+-]*|[()])")
_BINDS = {"or": 1, "and": 2, "with": 3}

#: How sure one place of each kind makes that a text states a licence.
WEIGHT = {"base": 0.5, "notice": 0.5, "tag": 0.9}

_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

_LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def licence_words(text: bytes) -> list[bytes]:
    """The words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of a text with A to Z lower-cased."""
    return text.translate(_WORD_BYTES).split()


def read_expression(text: str, at: int = 0, stop: int | None = None) -> tuple[list[str], int, list[str], bool]:
    """Reads the licence expression that begins at a place of a lower-case text, by two stacks.

    Returns (labels, obligation, tokens, whole): the families named, the rank of the
    obligation, the tokens of the longest beginning that is an expression, and whether no
    operand or bracket was left open. OR leaves the lighter obligation, AND the heavier;
    WITH a linking exception makes a strong one weak. The cost is linear in what is read.
    """
    operands, operators, tokens, labels = [], [], [], []
    best: tuple[list[str], int, list[str]] = ([], OBLIGATIONS.index("unknown"), [])
    stop, want, depth = len(text) if stop is None else stop, True, 0

    def reduce(values: list[int], op: str) -> None:
        right, left = values.pop(), values.pop()
        values.append(min(left, right) if op == "or" else max(left, right))

    while hit := _TOKEN.match(text, at, stop):
        token = hit[1]
        if want and operators and operators[-1] == "with":
            # what follows is an exception, which is no operand
            if _LINKING.fullmatch(token.rstrip(".")):
                operands[-1] = min(operands[-1], OBLIGATIONS.index("weak"))
            elif "exception" not in token:
                break
            operators.pop()
            want = False
        elif want and token == "(":
            operators.append(token)
            depth += 1
        elif want:
            known = _ID.fullmatch(token.rstrip("."))
            if not known:
                break
            family = known[1] or known[2]
            operands.append(_RANK[family])
            labels.append(family)
            token, want = token.rstrip("."), False
        elif token == ")" and depth:
            while operators[-1] != "(":
                reduce(operands, operators.pop())
            operators.pop()
            depth -= 1
        elif token in _BINDS and not (token == "with" and tokens[-1] == ")"):  # an exception belongs to one licence
            while operators and operators[-1] != "(" and _BINDS[operators[-1]] >= _BINDS[token]:
                reduce(operands, operators.pop())
            operators.append(token)
            want = True
        else:
            break
        tokens.append(token)
        at = hit.end()
        if not want and not depth:
            value = list(operands)
            for op in reversed(operators):
                reduce(value, op)
            best = (labels, value[0], tokens)
            size = len(labels), len(tokens)
    if not best[2]:
        return [], best[1], [], not tokens
    return labels[: size[0]], best[1], tokens[: size[1]], size[1] == len(tokens)


class Scanner:
    """The automata, built once a task."""

    def __init__(self, base: dict[str, str], notices: dict[str, str], tags: list[str]) -> None:
        import ahocorasick

        self.phrases, self.tags = ahocorasick.Automaton(), ahocorasick.Automaton()
        for kind, listed in (("base", base), ("notice", notices)):
            for phrase, label in listed.items():
                # a blank at both ends, so that only whole words match
                known = self.phrases.get(f" {phrase} ", ())
                self.phrases.add_word(f" {phrase} ", (*known, (kind, label, len(phrase.split()))))
        for tag in tags:
            self.tags.add_word(tag, tag)
        for automaton in (self.phrases, self.tags):
            if len(automaton):
                automaton.make_automaton()

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int, str, str]], list[tuple[str, str, bool]]]:
        """(words, places (start, end, label, kind) in words, expressions (text, obligation, whole))."""
        words = licence_words(text)
        places, expressions = [], []
        if len(self.phrases) and words:
            line = f" {b' '.join(words).decode('latin-1')} "
            at = word = 0
            for end, hits in self.phrases.iter(line):
                # `end` never falls, so the blanks are counted once over all places
                word, at = word + line.count(" ", at, end), end
                places += [(word - size, word, label, kind) for kind, label, size in hits]
        if len(self.tags):
            raw = text.translate(_LOWER_BYTES).decode("latin-1")
            at = word = 0
            for end, _ in self.tags.iter(raw):
                stop = raw.find("\n", end + 1)
                labels, rank, tokens, whole = read_expression(raw, end + 1, len(raw) if stop < 0 else stop)
                if tokens:
                    word, at = word + len(licence_words(text[at : end + 1])), end + 1
                    size = len(licence_words(" ".join(tokens).encode("latin-1")))
                    places += [(word, word + size, label, "tag") for label in sorted(set(labels))]
                    expressions.append((" ".join(tokens), OBLIGATIONS[rank], whole))
        return len(words), sorted(places), expressions


def scan_licenses(docs: DataFrame, text_col: str = "text", base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES, tags: list[str] = TAGS) -> DataFrame:
    """Adds to docs, in place of columns of these names: n_words; licenses, an array of
    (start, end, label, kind) in words (base and notice phrases where their words stand
    next to each other; kind tag for the families that an identifier tag's expression
    names), by start; expressions, an array of (expression, obligation, whole) as read behind
    tags on their line; and score, 0 without any place, nearer to 1 with each:
    1 less the product of (1 - WEIGHT) over the places, where a tag's labels count once each.

    Defined cases: null is an empty text; a tag without a known licence behind it is no
    place, of one that goes on without sense the longest sound beginning is taken and whole
    is false; overlapping places are all reported; each row is scanned whole and by itself;
    extra columns of any name pass through; an empty table stays empty.
    """
    docs = docs.drop("n_words", "licenses", "expressions", "score")
    columns, at = docs.columns, docs.columns.index(text_col)
    place = [("start", T.LongType()), ("end", T.LongType()), ("label", T.StringType()), ("kind", T.StringType())]
    said = [("expression", T.StringType()), ("obligation", T.StringType()), ("whole", T.BooleanType())]
    struct = lambda fields: T.ArrayType(T.StructType([T.StructField(*f) for f in fields]))
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("licenses", struct(place)), T.StructField("expressions", struct(said)), T.StructField("score", T.DoubleType())])
    places_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("kind", pa.string())]))
    said_type = pa.list_(pa.struct([("expression", pa.string()), ("obligation", pa.string()), ("whole", pa.bool_())]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(base, notices, tags)
        named = lambda fields, rows: [dict(zip([f[0] for f in fields], r)) for r in rows]
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(at)):
                done = [scanner.scan(data[s:e].tobytes()) for s, e in zip(offsets[:-1], offsets[1:])]
                sure = [1.0 - math.prod(1.0 - WEIGHT[kind] for *_, kind in places) for _, places, _ in done]
                out = [pa.array([n for n, *_ in done], pa.int64()), pa.array([named(place, p) for _, p, _ in done], places_type), pa.array([named(said, x) for *_, x in done], said_type), pa.array(sure, pa.float64())]
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns), *out], names=[*columns, "n_words", "licenses", "expressions", "score"])

    return docs.mapInArrow(search, schema)
