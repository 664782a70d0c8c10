"""Token counts by offset-mapped attribution (operator 7).

Each document is encoded once, whole; token byte lengths give every token's span, byte spans become code point
spans, and an interval join (binary search of span starts in the sorted section starts) attributes tokens to
sections.  Encoding sections apart would count other tokens at their borders.  A token that crosses a border belongs

* ``first``: to the section of its first code point,
* ``last``: to the section of its last one,
* ``most``: to the section that holds most of its code points (the earlier one of equals).

Code points outside all sections, and tokens attributed to none, are counted apart, so the parts always sum up to the
document's tokens.

Scale: a narrow map; the vocabulary (its size is fixed) is broadcast.  Sections may be given as a column of
sorted, disjoint (start, end) structs of code points; by default they are the lines, each with its line end.

Defined cases: null and empty texts have no tokens and no sections; a section without tokens counts 0; sections that
reach beyond the text are cut there; null sections count as none.  Further columns are carried as asked; own
columns get underscores in front where a carried one has their name.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import named, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how text is split before merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("first", "last", "most")


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Counter:
    """Encodes texts and attributes tokens to sections."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        import tiktoken

        self.coder = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.lens = np.zeros(max(ranks.values()) + 1, np.int64)
        for piece, rank in ranks.items():
            self.lens[rank] = len(piece)

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(start, end) code points that each token touches (parts of one character share it)."""
        ids = np.array(self.coder.encode_ordinary(text), np.int64)
        ends = np.cumsum(self.lens[ids])
        lead = (np.frombuffer(text.encode("utf-8", "replace"), np.uint8) & 0xC0) != 0x80
        char = np.cumsum(lead) - 1  # code point of each byte
        return char[ends - self.lens[ids]], char[ends - 1] + 1

    def attribute(self, text: str, starts: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, int, int]:
        """(tokens of each section, tokens of none, tokens that cross a section's border)."""
        counts = np.zeros(len(starts), np.int64)
        if not text:
            return counts, 0, 0
        s, e = self.spans(text)
        if not len(starts):
            return counts, len(s), 0
        hold = lambda p: np.where((k := np.searchsorted(starts, p, "right") - 1) >= 0, np.where(p < ends[np.maximum(k, 0)], k, -1), -1)
        first, last = hold(s), hold(e - 1)
        own = last if rule == "last" else first
        if rule == "most":
            own = first.copy()
            for t in np.flatnonzero((e - s > 1) & ((first != last) | (first < 0))):
                a = max(int(np.searchsorted(ends, s[t], "right")), 0)
                b = int(np.searchsorted(starts, e[t], "left"))
                if b > a:
                    share = np.minimum(ends[a:b], e[t]) - np.maximum(starts[a:b], s[t])
                    own[t] = a + int(share.argmax())
        counts += np.bincount(own[own >= 0], minlength=len(starts))
        return counts, int((own < 0).sum()), int((first != last).sum())


def lines(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the lines, each with its line end."""
    cuts, at = [0], text.find("\n")
    while at >= 0:
        cuts.append(at + 1)
        at = text.find("\n", at + 1)
    if cuts[-1] != len(text):
        cuts.append(len(text))
    c = np.array(cuts, np.int64)
    return c[:-1], c[1:]


def count_tokens(docs: DataFrame, text: str = "text", sections: str | None = None, rule: str = "first", carry: list[str] | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """``carry`` columns, ``n_tokens``, ``section_tokens`` (one count a section), ``n_outside`` and ``n_crossing``."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))  # as large as the vocabulary
    carry = [c for c in docs.columns if c not in (text, sections)] if carry is None else carry
    own = F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.struct(F.lit(0).alias("none"))
    given = [F.transform(F.filter(F.coalesce(F.col(f"`{sections}`"), F.array()), lambda s: s.isNotNull()), lambda s: s.getField(k).cast("long")).alias(k) for k in ("start", "end")] if sections else []
    source = docs.select(own.alias("own"), F.col(f"`{text}`").alias("text"), *given)
    schema = T.StructType([source.schema["own"], T.StructField("n_tokens", T.LongType()), T.StructField("section_tokens", T.ArrayType(T.LongType())),
                           T.StructField("n_outside", T.LongType()), T.StructField("n_crossing", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(ranks.value)
        for b in batches:
            parts, none, cross, total = [], [], [], []
            for k in range(b.num_rows):
                t = b.column(1)[k].as_py() or ""
                if sections:
                    s, e = (np.minimum(np.array(b.column(c)[k].as_py(), np.int64).reshape(-1), len(t)) for c in (2, 3))
                else:
                    s, e = lines(t) if t else (np.empty(0, np.int64),) * 2
                c, out, over = counter.attribute(t, s, e, rule)
                parts.append(c)
                none.append(out)
                cross.append(over)
                total.append(int(c.sum()) + out)
            flat = pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(c) for c in parts]), pa.int32()), pa.array(np.concatenate([*parts, np.empty(0, np.int64)]), pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total, pa.int64()), flat, pa.array(none, pa.int64()), pa.array(cross, pa.int64())], names=schema.names)

    made = source.mapInArrow(run, schema)
    rest = ["n_tokens", "section_tokens", "n_outside", "n_crossing"]
    return made.select(*[F.col("own").getField(c).alias(c) for c in carry], *[F.col(c).alias(n) for c, n in zip(rest, named(rest, carry), strict=True)])


def q_op7(spark, sf_dir: str) -> DataFrame:
    """Tokens of every document and of each of its lines."""
    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))
