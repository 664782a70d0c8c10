"""Removal of repeated word sequences with difference-cover anchors (operator 8).

A window is ``window`` consecutive words of one document; each word covered by a window whose word
sequence also starts earlier (smaller document, or earlier in the same one) is removed.

Method.  With a perfect difference set ``D`` modulo ``v``, two equal windows starting anywhere share an
offset ``d < v`` at which both positions lie in ``D`` modulo ``v``.  So only positions in ``D`` modulo ``v``
are hashed (4 of 13), each with the ``window - v + 1`` words that follow, and every repeated window holds
an anchor that occurs twice.  Three jobs:

1. *anchors*: which anchors occur twice or more;
2. *windows*: around those only, all whole windows are hashed (96 bits); the earliest start of each wins;
3. *removal*: the other starts are joined back to their documents.

Scale.  Steps 1 and 2 ship packed arrays keyed by hash bucket, never one row a word.  A task resolves
what repeats inside its own stretch of documents itself and sends any hash **once**, so a passage held by a
third of all documents puts one entry a stretch into its bucket, not one a document.  Buckets grow in
number with the corpus (``BUCKET_BYTES`` of text each).  Answers go back by document.  Nothing is
collected, broadcast or capped, and intermediate results are written tables.

Defined cases: a null text has no words; a null ``doc_id`` sorts last; documents that share a
``doc_id`` are ordered by a hash of their text, and rows that repeat both, null ids included, are one document (each
gets the same result, and none is an earlier occurrence of the others).  Texts shorter than a window lose nothing.  An empty table gives an empty result.  Further
columns are carried as asked and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LAST_ID, named, table, text_bytes, written
from .words import chained, slices

WINDOW = 20
BUCKET_BYTES = 16 << 20  # bytes of text whose hashes one bucket holds
LEAST_BUCKETS = 64  # small inputs are spread as well; answers come back in at most one row a bucket and document
STRETCH = 1_500_000  # entries that a task resolves together
#: Perfect difference sets: every difference modulo v occurs between members.
COVERS = {13: (0, 1, 3, 9), 7: (0, 1, 3), 3: (0, 1), 1: (0,)}
LEAST_ANCHOR = 4

_U = np.uint64
_PACKED = T.StructType([T.StructField("bucket", T.IntegerType())] + [T.StructField(c, T.BinaryType()) for c in ("h", "g", "ids", "ths", "doc", "pos", "more")])
_FOUND = T.StructType([T.StructField("id", T.LongType()), T.StructField("th", T.LongType()), T.StructField("pos", T.BinaryType())])


def cover_of(window: int) -> tuple[int, tuple[int, ...], int]:
    """(period, cover, words of an anchor) for a window length."""
    period = next(v for v in COVERS if window - v + 1 >= min(LEAST_ANCHOR, window))
    return period, COVERS[period], window - period + 1


def _planes(x: np.ndarray) -> bytes:
    """Bytes by significance: the many zero bytes of small numbers end up together and compress away."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes()


def _unplanes(b: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


class _Entries:
    """Parallel arrays of (hash, second hash, document id, tie hash, word position)."""

    def __init__(self, parts: list[tuple]):
        self.h, self.g, self.id, self.th, self.pos = (np.concatenate(x) for x in zip(*parts, strict=True))

    def groups(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order by hash, start of each group in it, size of each group)."""
        order = np.argsort(self.h, kind="stable")
        h, g = self.h[order], self.g[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        if self.g.any():  # equal first hashes and different second ones: rare, then sort by both
            if np.any(~new[1:] & (g[1:] != g[:-1])):
                order = np.lexsort((self.g, self.h))
                h, g = self.h[order], self.g[order]
                new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
        at = np.flatnonzero(new)
        return order, at, np.diff(np.append(at, len(h)))

    def earliest(self, order: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The group's entry that comes first by (document, tie, position), for each group."""
        first = order[at].copy()
        many = np.flatnonzero(size > 1)
        if len(many):
            n = size[many]
            rows = order[np.repeat(at[many], n) + _ramp(n)]
            of = np.repeat(np.arange(len(many)), n)
            by = np.lexsort((self.pos[rows], self.th[rows], self.id[rows], of))
            head = np.ones(len(by), bool)
            head[1:] = of[by][1:] != of[by][:-1]
            first[many] = rows[by][head]
        return first

    def later(self, order: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """True for each entry that is not its group's first; repeated rows of a document share its starts."""
        lead = np.empty(len(self.h), np.int64)
        lead[order] = np.repeat(first, size)
        return (self.id != self.id[lead]) | (self.th != self.th[lead]) | (self.pos != self.pos[lead])


def _ramp(n: np.ndarray) -> np.ndarray:
    """0..n[0]-1, 0..n[1]-1, ... as one array."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _by_document(ids: np.ndarray, ths: np.ndarray, pos: np.ndarray):
    """(ids, ths, binary array of int32 positions), one row a document."""
    if not len(ids):
        return pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.binary())
    by = np.lexsort((pos, ths, ids))
    i, t, p = ids[by], ths[by], pos[by].astype(np.int32)
    new = np.ones(len(by), bool)
    new[1:] = (i[1:] != i[:-1]) | (t[1:] != t[:-1])
    at = np.flatnonzero(new)
    ends = np.append(at, len(by)).astype(np.int32) * 4
    return pa.array(i[at]), pa.array(t[at]), pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(p)])


def _pack(bucket: int, e: _Entries, rows: np.ndarray, more: bytes) -> tuple:
    """One packed row: entries ``rows`` of ``e`` in document order; ``more`` flags those that need no answer."""
    if len(rows):
        ids, ths = e.id[rows], e.th[rows]
        new = np.ones(len(rows), bool)
        new[1:] = (ids[1:] != ids[:-1]) | (ths[1:] != ths[:-1])
        doc = new.astype(np.uint8)  # 1 where a new document begins
    else:
        ids = ths = np.empty(0, np.int64)
        new, doc = np.empty(0, bool), np.empty(0, np.uint8)
    return (bucket, _planes(e.h[rows]), _planes(e.g[rows]), _planes(ids[new]), _planes(ths[new]), doc.tobytes(), _planes(e.pos[rows].astype(np.int32)), more)


def _resolved(parts: list[tuple], buckets: int, first_only: bool) -> pa.RecordBatch:
    """Packed rows of a stretch of documents: each hash once, and what is already known.

    ``first_only`` False (anchors): an answer is wanted for hashes that occur once here; occurrences of the others
    are known to repeat.  True (windows): the earliest start here goes to the bucket, the others are known repeats.
    """
    e = _Entries(parts)
    order, at, size = e.groups()
    first = e.earliest(order, at, size) if first_only else order[at]
    if first_only:
        known = e.later(order, first, size)
    else:
        known = np.ones(len(e.h), bool)
        known[first[size == 1]] = False
    repeat = np.zeros(len(e.h), bool)
    repeat[first[size > 1]] = not first_only
    first = np.sort(first)  # document order
    top = ((e.h[first] >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)
    by = np.argsort(top, kind="stable")
    edges = np.flatnonzero(np.diff(top[by])) + 1
    made = []
    for rows in np.split(first[by], edges) if len(first) else []:
        b = int((int(e.h[rows[0]]) >> 32) * buckets >> 32)
        made.append(_pack(b, e, rows, np.packbits(repeat[rows]).tobytes()))
    if known.any():  # no bucket has to decide these: they go through any, each stretch through another
        rows = np.flatnonzero(known)
        made.append(_pack(int(e.h[rows[0]]) % buckets, e, rows, b""))
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if k == 0 else pa.binary()) for k, x in enumerate(zip(*made, strict=True))] if made else [pa.array([], pa.int32())] + [pa.array([], pa.binary())] * 7, names=_PACKED.names)


def _answers(first_only: bool):
    """Per bucket: positions of shared anchors, or of windows that start earlier elsewhere."""

    def run(t: pa.Table) -> pa.Table:
        parts, wants, known = [], [], []
        cols = [t.column(c).to_pylist() for c in _PACKED.names[1:]]
        for h, g, ids, ths, doc, pos, more in zip(*cols, strict=True):
            at = np.cumsum(np.frombuffer(doc, np.uint8), dtype=np.int64) - 1
            row = (_unplanes(h, np.uint64), _unplanes(g, np.uint32), _unplanes(ids, np.int64)[at], _unplanes(ths, np.int64)[at], _unplanes(pos, np.int32))
            if more:
                parts.append(row)
                wants.append(np.unpackbits(np.frombuffer(more, np.uint8), count=len(at)) == 0)
            else:
                known.append(row[2:])
        out = [x for x in known]
        if parts:
            e, want = _Entries(parts), np.concatenate(wants)
            order, at, size = e.groups()
            say = np.zeros(len(e.h), bool)
            if first_only:
                say = e.later(order, e.earliest(order, at, size), size)
            else:
                busy = np.add.reduceat(np.where(want[order], 1, 2), at) if len(at) else np.empty(0)
                say[order] = np.repeat(busy >= 2, size)
                say &= want
            out.append((e.id[say], e.th[say], e.pos[say]))
        ids, ths, pos = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 3
        return pa.table(dict(zip(_FOUND.names, _by_document(ids, ths, pos), strict=True)))

    return run


def _stretches(batches: Iterator[pa.RecordBatch], pick, buckets: int, first_only: bool) -> Iterator[pa.RecordBatch]:
    """``pick(words, rows of the batch, their positions column)`` gives word indices, hashes, second hashes."""
    parts, held = [], 0
    for b in batches:
        ids, ths = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("id", "th"))
        for i, j, w in slices(b.column(b.schema.get_field_index("text"))):
            at, h, g = pick(w, b, i, j)
            doc = w.doc[at] + i
            parts.append((h, g, ids[doc], ths[doc], at - w.first[w.doc[at]]))
            held += len(at)
            if held >= STRETCH:
                yield _resolved(parts, buckets, first_only)
                parts, held = [], 0
    if held:
        yield _resolved(parts, buckets, first_only)


def _positions(docs: DataFrame, pick, buckets: int, first_only: bool, name: str) -> DataFrame:
    """(id, th, list of packed positions) of each document that has any, as a written table."""
    found = (docs.mapInArrow(lambda it: _stretches(it, pick, buckets, first_only), _PACKED)
             .repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_answers(first_only), _FOUND))
    return written(found, name).groupBy("id", "th").agg(F.collect_list("pos").alias("at"))


def _marks(b: pa.RecordBatch, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, position) of the answers of rows i..j of a batch."""
    rows, pos = [], []
    col = b.column(b.schema.get_field_index("at"))
    for k in range(i, j):
        for x in col[k].as_py() or ():
            p = np.frombuffer(x, np.int32)
            rows.append(np.full(len(p), k - i))
            pos.append(p)
    return (np.concatenate(rows), np.concatenate(pos).astype(np.int64)) if rows else (np.empty(0, np.int64),) * 2


def keyed(docs: DataFrame, id_col: str, text: str, carry: list[str]) -> DataFrame:
    """``id`` (null: the last), ``th`` (a text hash, only where ids are not unique), ``text`` and a struct ``own``."""
    n, ids = docs.agg(F.count(F.lit(1)), F.countDistinct(F.col(f"`{id_col}`"))).first()
    tie = F.lit(0).cast("long") if n == ids else F.xxhash64(F.col(f"`{text}`"))
    own = F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.struct(F.lit(0).alias("none"))
    return docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST_ID)).alias("id"), tie.alias("th"),
                       F.col(f"`{text}`").alias("text"), own.alias("own"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW,
                   carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns (``id_col`` by default), ``n_words``, ``n_removed`` and ``kept_text`` (words joined by a space)."""
    carry = [id_col] if carry is None else carry
    period, cover, anchor = cover_of(window)
    buckets = max(LEAST_BUCKETS, -(-text_bytes(docs, text) // BUCKET_BYTES))
    source = keyed(docs, id_col, text, carry)
    slim = source.select("id", "th", "text")

    def anchors(w, b, i, j):
        at = np.flatnonzero(w.windows(anchor) & np.isin(w.pos() % period, cover))
        return at, chained(w.hashes(), anchor, at) & _U(0xFFFFFFFFFFFF0000), np.zeros(len(at), np.uint32)

    def windows(w, b, i, j):
        row, pos = _marks(b, i, j)
        near = np.zeros(len(w.starts) + 1, np.int64)
        p = w.first[row] + pos
        np.add.at(near, np.maximum(w.first[row], p - (window - anchor)), 1)
        np.add.at(near, p + 1, -1)
        at = np.flatnonzero((np.cumsum(near[:-1]) > 0) & w.windows(window))
        return at, chained(w.hashes(), window, at), (chained(w.hashes(1), window, at, seed=8) >> _U(32)).astype(np.uint32) | np.uint32(1)

    shared = _positions(slim, anchors, buckets, False, "anchors")
    repeats = _positions(slim.join(shared, ["id", "th"]), windows, buckets, True, "windows")

    names = [f"c{k}" for k in range(len(carry))]
    kinds = [docs.select(F.col(f"`{c}`")).schema[0] for c in carry]
    schema = T.StructType([T.StructField(n, f.dataType, True) for n, f in zip(names, kinds, strict=True)]
                          + [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])
    final = source.join(repeats, ["id", "th"], "left").select(*[F.col("own").getField(c).alias(n) for n, c in zip(names, carry, strict=True)], "text", "at")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total, gone, kept = [], [], []
            texts, ats = (b.column(b.schema.get_field_index(c)) for c in ("text", "at"))
            for k in range(b.num_rows):
                words = (texts[k].as_py() or "").encode().split()
                starts = [np.frombuffer(x, np.int32) for x in ats[k].as_py() or ()]
                total.append(len(words))
                if starts:
                    edge = np.zeros(len(words) + 1, np.int64)
                    s = np.unique(np.concatenate(starts))
                    np.add.at(edge, s, 1)
                    np.add.at(edge, s + window, -1)
                    stay = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
                    gone.append(len(words) - len(stay))
                    words = [words[x] for x in stay]
                else:
                    gone.append(0)
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([b.column(k) for k in range(len(names))] + [pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=schema.names)

    made = final.mapInArrow(remove, schema)
    return made.toDF(*carry, *named(["n_words", "n_removed", "kept_text"], carry))


def q_op8(spark, sf_dir: str) -> DataFrame:
    """Words kept of every document once repeated 20-word sequences are gone."""
    made = remove_repeats(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


#: The same by self-comparison of all windows.
SQL = r"""
WITH docs AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM docs),
wins AS (SELECT doc_id, i, list_slice(w, i, i + 19) AS win
         FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM docs WHERE len(w) >= 20)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS k FROM wins) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, i + d AS i FROM later, range(0, 20) AS r(d)),
kept AS (SELECT a.doc_id, count(*) AS n_kept, string_agg(a.word, ' ' ORDER BY a.i) AS t
         FROM words AS a LEFT JOIN gone AS g ON a.doc_id = g.doc_id AND a.i = g.i WHERE g.i IS NULL GROUP BY a.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(k.n_kept, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.t, '')) AS kept_sha256
FROM docs AS d LEFT JOIN kept AS k ON d.doc_id = k.doc_id
"""
