"""Licence scans (operator 13).

Words are maximal runs of digits, letters (A-Z lower-cased) and characters beyond ASCII.  One Aho-Corasick automaton
runs over a text's words, joined by single blanks, and finds all notice phrases and identifier tags in one pass.

* Notices: every phrase counts wherever its words stand consecutively.  A phrase inside a longer one (``cc by`` in
  ``cc by nc``) stays a place of its own, but the longer one names the licence.
* Tags: what follows ``SPDX-License-Identifier:`` on its line is a licence expression.
* Mentions that are joined by nothing but ``and``, ``or``, ``with`` and filler words are an expression, too.

Expressions are put in postfix order by a shunting-yard parser (``with`` binds closest, then ``and``, then ``or``) and
evaluated: each licence has a freedom of use from 0 (reserved) to 1 (public domain); ``or`` takes the larger, ``and`` the
smaller, ``with`` an exception goes half way to 1.  A document's score is the smallest of its expressions; 0.5 if it has none.

Scale: a narrow map in Arrow batches, one text at a time and no list of its words; nothing is shuffled.

Defined cases: null and empty texts have no words, places or labels and score 0.5; a tag without a readable expression
adds the label ``other``; broken expressions are read as far as they go, open parentheses close at the end.  Carried
columns may have any name; the operator's columns are one struct whose name avoids theirs.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, table

# The phrases that the contract counts, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Further notices by label.
NOTICES = {
    "agpl": ["affero general public license", "gnu agpl"],
    "apache": ["apache license", "apache software license"],
    "bsd": ["bsd license", "redistribution and use in source and binary forms"],
    "cc-by": ["creative commons attribution"],
    "cc-by-nc": ["cc by nc", "creative commons attribution noncommercial", "creative commons attribution non commercial"],
    "cc-by-nd": ["cc by nd", "creative commons attribution noderivatives", "creative commons attribution noderivs"],
    "cc-by-sa": ["cc by sa", "creative commons attribution sharealike", "creative commons attribution share alike"],
    "cc0": ["cc0", "cc zero", "creative commons zero"],
    "exception": ["classpath exception", "linking exception", "runtime library exception"],
    "gpl": ["gnu gpl"],
    "isc": ["isc license", "permission to use copy modify and or distribute this software"],
    "lgpl": ["lesser general public license", "library general public license", "gnu lgpl"],
    "mit": ["mit license", "permission is hereby granted free of charge to any person obtaining a copy"],
    "mpl": ["mozilla public license"],
    "proprietary": ["proprietary and confidential"],
    "public-domain": ["public domain", "unlicense"],
}
# Freedom of use by label.
FREEDOM = {"agpl": 0.3, "apache": 0.9, "bsd": 0.9, "cc-by": 0.8, "cc-by-nc": 0.2, "cc-by-nd": 0.2, "cc-by-sa": 0.5, "cc0": 1.0, "exception": 0.5, "gpl": 0.4, "isc": 0.9,
           "lgpl": 0.6, "mit": 0.9, "mpl": 0.7, "other": 0.5, "proprietary": 0.0, "public-domain": 1.0, "reserved": 0.0}
UNKNOWN = 0.5
TAG = "spdx license identifier"
_TAG = re.compile(rb"spdx-license-identifier:[ \t]*([^\r\n]*)", re.I)
_TOKEN = re.compile(r"[()]|[a-z0-9.+:_-]+")
_FILLER = frozenset("a an the gnu either both any at your option license licence licenses version v of later terms international under".split())
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_STRENGTH = {"or": 1, "and": 2, "with": 3}


def postfix(tokens: list[str]) -> list[str]:
    """Operands, ``and``, ``or``, ``with`` and parentheses in postfix order, as far as they make an expression."""
    out: list[str] = []
    stack: list[str] = []
    operand = True  # the next token has to start an operand
    for t in tokens:
        if t in _STRENGTH:
            if operand:
                break
            while stack and stack[-1] != "(" and _STRENGTH[stack[-1]] >= _STRENGTH[t]:
                out.append(stack.pop())
            stack.append(t)
            operand = True
        elif t == "(":
            if not operand:
                break
            stack.append(t)
        elif t == ")":
            if operand or "(" not in stack:
                break
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        else:
            if not operand:
                break
            out.append(t)
            operand = False
    if operand and stack:  # an operator without its right side
        while stack and stack[-1] == "(":
            stack.pop()
        if stack and out:
            stack.pop()
    return out + [t for t in reversed(stack) if t != "("]


def freedom(rpn: list[str]) -> float | None:
    """Value of a postfix expression of labels (None: no operand)."""
    values: list[float] = []
    for t in rpn:
        if t in _STRENGTH:
            if len(values) < 2:
                continue
            b, a = values.pop(), values.pop()
            values.append(max(a, b) if t == "or" else min(a, b) if t == "and" else (a + 1) / 2)
        else:
            values.append(FREEDOM.get(t, FREEDOM["other"]))
    return min(values) if values else None


def family(identifier: str) -> str:
    """Label of an identifier such as ``gpl-3.0-or-later``: the longest label that it is or begins with."""
    if identifier.endswith("exception") or "-exception-" in identifier:
        return "exception"
    known = [x for x in FREEDOM if identifier == x or identifier.startswith((x + "-", x + "+"))]
    nc = re.match(r"cc-by-(nc|nd|sa)", identifier)
    return "cc-by-" + ("nc" if "nc" in identifier.split("-") else nc.group(1)) if nc else "public-domain" if identifier == "unlicense" else max(known, key=len, default="other")


class Scanner:
    """The automaton and what is read off its matches."""

    def __init__(self):
        import ahocorasick

        self.found = ahocorasick.Automaton()
        phrases = [(p, x, True) for p, x in BASE.items()] + [(p, x, False) for x, ps in NOTICES.items() for p in ps] + [(TAG, "", False)]
        for phrase, label, base in phrases:
            self.found.add_word(f" {phrase} ", (len(phrase) + 1, phrase.count(" ") + 1, label, base))
        self.found.make_automaton()

    def scan(self, text: str) -> tuple[int, list[tuple[int, int, str, bool]], list[str], list[str]]:
        """(words, places (first word, end word, label, base), expressions in postfix order, labels of tags)."""
        raw = text.encode("utf-8", "surrogatepass")
        plain = re.sub(rb" {2,}", b" ", b" " + raw.translate(_TABLE) + b" ")
        n = max(plain.count(b" ") - 1, 0) if plain != b" " else 0
        places, tags = [], False
        done = word = 0
        hits = sorted((end - size, words, label, base) for end, (size, words, label, base) in self.found.iter(plain.decode("latin-1")))
        for at, words, label, base in hits:
            word += plain.count(b" ", done, at)
            done = at
            if label:
                places.append((word, word + words, label, base))
            tags |= not label
        expressions, tagged, lines = [], [], []
        if tags:
            read = seen = 0
            for m in _TAG.finditer(raw):
                seen += len(raw[read : m.start(1)].translate(_TABLE).split())
                lines.append((seen, seen + len(m.group(1).translate(_TABLE).split())))
                read, seen = m.end(1), lines[-1][1]
                tokens = [t if t in _STRENGTH or t in "()" else family(t) for t in _TOKEN.findall(m.group(1).decode("utf-8", "replace").lower())]
                rpn = postfix(tokens) or ["other"]
                expressions.append(" ".join(rpn))
                tagged += [t for t in rpn if t not in _STRENGTH]
        expressions += self._prose(plain, hits, places, lines)
        return n, places, expressions, tagged

    def _prose(self, plain: bytes, hits: list, places: list, lines: list[tuple[int, int]]) -> list[str]:
        """Expressions of mentions that only connectives and fillers part; phrases inside longer ones or in tags drop out."""
        spans = [(at, p) for (at, *_), p in zip([h for h in hits if h[2]], places, strict=True)]
        if lines:
            firsts = [s for s, _ in lines]
            tagged = lambda w: (k := bisect.bisect_right(firsts, w)) > 0 and w < lines[k - 1][1]
            spans = [x for x in spans if not tagged(x[1][0])]
        outer, reach = [], -1
        for at, p in sorted(spans, key=lambda s: (s[1][0], -s[1][1], s[1][3])):
            if p[1] > reach:
                outer.append((at, p))
                reach = p[1]
        out, tokens, before = [], [], None
        for at, p in outer:
            if tokens:
                # a filler or a connective has at most 13 letters, so a gap of 200 bytes holds more than fillers
                gap = plain[before : at + 1].split() if before <= at + 1 and at - before < 200 else None
                links = [w for w in gap if w in (b"and", b"or", b"with")] if gap is not None else []
                if len(links) == 1 and all(w in links or w.decode("latin-1") in _FILLER or w.isdigit() for w in gap):
                    tokens += [links[0].decode(), p[2]]
                else:
                    out.append(" ".join(postfix(tokens)))
                    tokens = [p[2]]
            else:
                tokens = [p[2]]
            before = at + 1 + self._length(plain, at, p[1] - p[0])
        if tokens:
            out.append(" ".join(postfix(tokens)))
        return out

    @staticmethod
    def _length(plain: bytes, at: int, words: int) -> int:
        """Bytes of ``words`` words after the blank at ``at``."""
        end = at
        for _ in range(words):
            end = plain.index(b" ", end + 1)
        return end - at - 1


_FOUND = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("places", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType()), T.StructField("label", T.StringType()), T.StructField("base", T.BooleanType())]))),
    T.StructField("expressions", T.ArrayType(T.StringType())), T.StructField("labels", T.ArrayType(T.StringType())), T.StructField("score", T.DoubleType())])


def scan(docs: DataFrame, text: str = "text", carry: list[str] | None = None, name: str = "licence") -> DataFrame:
    """``carry`` columns (all but the text by default) and a struct ``name`` (with underscores in front if it clashes).

    Its fields: ``n_words``, ``places`` (first word, end, label, base), ``expressions`` (postfix), ``labels``
    (sorted, distinct) and ``score``.
    """
    carry = [c for c in docs.columns if c != text] if carry is None else carry
    name = fresh(name, carry)
    own = F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.struct(F.lit(0).alias("none"))
    source = docs.select(own.alias("own"), F.col(f"`{text}`").alias("text"))
    schema = T.StructType([source.schema["own"], T.StructField("found", _FOUND)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for b in batches:
            out = []
            for x in b.column(1):
                n, places, expressions, tagged = scanner.scan(x.as_py() or "")
                labels = {p[2] for p in places if p[3]} | {t for e in expressions for t in e.split(" ") if t not in _STRENGTH and t} | set(tagged)
                values = [v for e in expressions if (v := freedom(e.split(" "))) is not None]
                out.append({"n_words": n, "places": [dict(zip(("first", "end", "label", "base"), p, strict=True)) for p in places], "expressions": expressions, "labels": sorted(labels),
                            "score": min(values, default=UNKNOWN)})
            kind = pa.struct([("n_words", pa.int64()), ("places", pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("base", pa.bool_())]))),
                              ("expressions", pa.list_(pa.string())), ("labels", pa.list_(pa.string())), ("score", pa.float64())])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, kind)], names=["own", "found"])

    return source.mapInArrow(run, schema).select(*[F.col("own").getField(c).alias(c) for c in carry], F.col("found").alias(name))


def q_op13(spark, sf_dir: str) -> DataFrame:
    """Licence notices of every document."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "licence.*")
    base = F.filter("places", lambda p: p.getField("base"))
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(F.transform(base, lambda p: p.getField("first"))).alias("first_word"),
        F.array_max(F.transform(base, lambda p: p.getField("first"))).alias("last_word"), F.array_join(F.array_sort(F.array_distinct(F.transform(base, lambda p: p.getField("label")))), ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"), "score", "expressions")
