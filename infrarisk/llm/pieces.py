"""SentencePiece encoding and decoding in batched numpy (operator 4).

Words of equal length advance together.  For a batch of words as a matrix of code points, prefix hashes give the hash of
every substring up to the longest piece; one binary search in the sorted piece keys finds which substrings are
pieces.  On that table

* a *unigram* model is decoded by Viterbi: at each end position a vectorised maximum over piece lengths, with the
  lengths kept as backpointers;
* a *BPE* model merges: in each round every word of the batch joins its best-scored adjacent pair (the leftmost of
  equals).  The sum of scores that Viterbi maximises is not what a BPE model's segmentation maximises, so
  Viterbi gives other ids than the model defines; the table and the batching are shared.

``ids`` are the model's own (the vocabulary file's type decides).  The Viterbi path over the same pieces is to be had
of every model (``viterbi``); both decode to the text.  Characters without a piece become byte pieces.  Words are runs of
the blank mark and what follows it, which no piece may cross (checked when the model is read).

Scale: a narrow map over documents, in slices of a few MB; the piece table (its size is the vocabulary's) is broadcast.
A slice's words are byte spans, told apart by 64-bit hashes; only words that the task has not seen are encoded.
Words longer than ``LONG_WORD`` take a heap (BPE) or the same Viterbi alone, so one huge word costs n log n.

Defined cases: null and empty texts have no ids and decode to the empty text.  A blank mark (U+2581) in the text
encodes like a blank and decodes as one.  Carried columns may have any name: the result's own columns get
underscores in front where they would clash.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, table
from .words import _BYTE, _powers, buffers, mix, randoms

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
LONG_WORD = 48
SLICE_BYTES = 1 << 20
BATCH_CELLS = 1 << 19  # substrings of one batch of equal-length words
WORDS_KEPT = 200_000  # words whose ids a task remembers
UNIGRAM, BPE = 1, 2
FILTER_BITS = 21  # a first look-up by the lowest bits of a substring's hash; most substrings are no pieces
_NEVER = np.int32(2**31 - 1)
_U = np.uint64
_BASE = _U(0x2545F4914F6CDD1D)
_INVERSE = _U(pow(0x2545F4914F6CDD1D, -1, 2**64))


@dataclass
class Pieces:
    kind: int
    prefix: bool  # a blank is put before the text
    keys: np.ndarray  # sorted hashes of the pieces
    ids: np.ndarray  # their ids
    scores: np.ndarray  # their scores
    lens: np.ndarray  # their code points
    longest: int
    by_text: dict
    byte_ids: np.ndarray  # id of each byte's piece
    unknown: int
    shown: list  # bytes that each id stands for

    def __post_init__(self):
        order = np.argsort(-self.scores, kind="stable")  # equal scores share a rank: the leftmost pair wins
        best = self.scores[order]
        self.ranks = np.empty(len(order), np.int32)
        self.ranks[order] = np.cumsum(np.concatenate([[0], best[1:] != best[:-1]]))
        self.maybe = np.zeros(1 << FILTER_BITS, bool)
        self.maybe[(self.keys & _U((1 << FILTER_BITS) - 1)).astype(np.int64)] = True


def _fields(b: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of the fields of a serialised message."""
    def number(i: int) -> tuple[int, int]:
        v = s = 0
        while True:
            v |= (b[i] & 127) << s
            s, i = s + 7, i + 1
            if b[i - 1] < 128:
                return v, i

    i = 0
    while i < len(b):
        tag, i = number(i)
        if tag & 7 == 0:
            v, i = number(i)
        elif tag & 7 == 2:
            n, i = number(i)
            v, i = b[i : i + n], i + n
        else:
            n = 8 if tag & 7 == 1 else 4
            v, i = b[i : i + n], i + n
        yield tag >> 3, v


def _hash_rows(codes: np.ndarray) -> np.ndarray:
    """Prefix hashes [n, length + 1] of rows of code points."""
    n, length = codes.shape
    powers = np.cumprod(np.concatenate([[_U(1)], np.full(max(length - 1, 0), _BASE)]), dtype=np.uint64)
    out = np.zeros((n, length + 1), np.uint64)
    np.cumsum(mix(codes.astype(np.uint64) + _U(1)) * powers, axis=1, out=out[:, 1:])
    return out


def _key(h: np.ndarray, length: int) -> np.ndarray:
    at = length % 64
    return mix(h + randoms(64, 21)[at : at + 1] * _U(length))


def make_pieces(pieces: list[tuple[str, float]], kind: int, prefix: bool = True, byte_ids: np.ndarray | None = None, unknown: int = 0,
                first_id: int = 0, shown: list | None = None) -> Pieces:
    """A table from (text, score) pieces numbered from ``first_id``."""
    texts = [p for p, _ in pieces]
    crossing = [p for p in texts if re.search(f"[^{BLANK}]{BLANK}", p)]
    if crossing:
        raise ValueError(f"pieces cross a word's end: {crossing[:3]}")
    keys = np.empty(len(texts), np.uint64)
    for size in {len(t) for t in texts}:
        rows = [k for k, t in enumerate(texts) if len(t) == size]
        codes = np.frombuffer("".join(texts[k] for k in rows).encode("utf-32-le"), np.uint32).reshape(len(rows), size)
        keys[rows] = _key(_hash_rows(codes)[:, -1], size)
    order = np.argsort(keys)
    ids = np.arange(first_id, first_id + len(texts))
    if len(np.unique(keys)) != len(keys):
        raise ValueError("two pieces have one hash")
    return Pieces(kind, prefix, keys[order], ids[order].astype(np.int32), np.array([s for _, s in pieces], np.float64)[order], np.array([len(p) for p in texts])[order],
                  max(map(len, texts)), {p: (i, s) for p, i, (_, s) in zip(texts, ids.tolist(), pieces, strict=True)},
                  np.full(256, unknown, np.int32) if byte_ids is None else byte_ids, unknown, shown or [p.replace(BLANK, " ").encode() for p in texts])


def read_model(path: str = MODEL) -> Pieces:
    """The piece table of a SentencePiece model file (identity normalisation; ids are the file's order)."""
    with open(path, "rb") as f:
        top = list(_fields(f.read()))
    trainer = dict(_fields(next(v for k, v in top if k == 2)))
    normal = dict(_fields(next(v for k, v in top if k == 3)))
    if normal.get(2) or normal.get(4, 1):
        raise ValueError("only models without normalisation rules are read")
    rows = [dict(_fields(v)) for k, v in top if k == 1]
    kinds = [r.get(3, 1) for r in rows]  # 1 normal, 2 unknown, 3 control, 4 user-defined, 6 byte
    texts = [r[1].decode() for r in rows]
    scores = [float(np.frombuffer(r.get(2, b"\0\0\0\0"), "<f4")[0]) for r in rows]
    unknown = kinds.index(2)
    byte_ids = np.full(256, unknown, np.int32)
    shown = [t.replace(BLANK, " ").encode() for t in texts]
    for i, (t, k) in enumerate(zip(texts, kinds, strict=True)):
        if k == 6:
            byte_ids[int(t[3:5], 16)] = i
            shown[i] = bytes([int(t[3:5], 16)])
        elif k == 3:
            shown[i] = b""
        elif k == 2:
            shown[i] = " ⁇ ".encode()
    normal_ids = [i for i, k in enumerate(kinds) if k == 1]
    made = make_pieces([(texts[i], scores[i]) for i in normal_ids], trainer.get(3, UNIGRAM), bool(normal.get(3, 1)), byte_ids, unknown, 0, shown)
    made.ids = np.array(normal_ids, np.int32)[made.ids]
    made.by_text = {texts[i]: (i, scores[i]) for i in normal_ids}
    return made


def _substrings(p: Pieces, codes: np.ndarray) -> np.ndarray:
    """Index into the piece table (-1: none) of every substring: [n, start, length - 1]."""
    n, length = codes.shape
    h = _hash_rows(codes)
    most = min(length, p.longest)
    back = np.cumprod(np.concatenate([[_U(1)], np.full(max(length - 1, 0), _INVERSE)]), dtype=np.uint64)
    found = np.full((n, length, most), -1, np.int32)
    for size in range(1, most + 1):
        part = _key((h[:, size:] - h[:, :-size]) * back[: length - size + 1], size)
        row, col = np.nonzero(p.maybe[(part & _U((1 << FILTER_BITS) - 1)).astype(np.int64)])
        part = part[row, col]
        at = np.minimum(np.searchsorted(p.keys, part), len(p.keys) - 1)
        good = (p.keys[at] == part) & (p.lens[at] == size)
        found[row[good], col[good], size - 1] = at[good]
    return found


def _viterbi(p: Pieces, found: np.ndarray) -> np.ndarray:
    """Length of the symbol that starts at each position (0: none starts there), the best sum of scores."""
    n, length, most = found.shape
    scores = np.where(found >= 0, p.scores[np.maximum(found, 0)], -np.inf)
    lone = p.scores.min() - 10  # a character without a piece
    scores[:, :, 0] = np.where(found[:, :, 0] < 0, lone, scores[:, :, 0])
    best, back = np.full((n, length + 1), -np.inf), np.zeros((n, length + 1), np.int32)
    best[:, 0] = 0
    for end in range(1, length + 1):
        sizes = np.arange(1, min(most, end) + 1)
        ways = best[:, end - sizes] + scores[:, end - sizes, sizes - 1]
        pick = ways.argmax(1)
        best[:, end] = ways[np.arange(n), pick]
        back[:, end] = sizes[pick]
    out, rows, end = np.zeros((n, length), np.int32), np.arange(n), np.full(n, length)
    while len(rows):
        size = back[rows, end]
        end = end - size
        out[rows, end] = size
        rows, end = rows[end > 0], end[end > 0]
    return out


def _merge(p: Pieces, found: np.ndarray) -> np.ndarray:
    """Length of the symbol at each position after joining best pairs until none is a piece."""
    n, length, most = found.shape
    size = np.ones((n, length), np.int32)  # 0: inside a symbol
    if length == 1:
        return size
    rank = np.where(found >= 0, p.ranks[np.maximum(found, 0)], _NEVER)
    before = np.tile(np.arange(-1, length - 1, dtype=np.int32), (n, 1))
    pair = np.full((n, length), _NEVER)  # rank of each symbol joined with the next one
    if most > 1:
        pair[:, :-1] = rank[:, :-1, 1]
    rows = np.arange(n)

    def offered(r: np.ndarray, i: np.ndarray, total: np.ndarray) -> np.ndarray:
        return np.where(total <= most, rank[r, i, np.minimum(total, most) - 1], _NEVER)

    while True:
        best = pair[rows].argmin(1)
        live = pair[rows, best] < _NEVER
        rows, i = rows[live], best[live]
        if not len(rows):
            return size
        a = size[rows, i]
        b = size[rows, i + a]
        both = a + b
        size[rows, i + a], pair[rows, i + a] = 0, _NEVER
        size[rows, i] = both
        end = i + both
        inside = end < length
        after = np.where(inside, size[rows, np.minimum(end, length - 1)], 0)
        pair[rows, i] = np.where(inside, offered(rows, i, both + after), _NEVER)
        before[rows[inside], end[inside]] = i[inside]
        left = before[rows, i]
        r, k, own = rows[left >= 0], left[left >= 0], both[left >= 0]
        pair[r, k] = offered(r, k, size[r, k] + own)


def _long_merge(p: Pieces, word: str) -> list[int]:
    """The same for one long word, by a heap of pairs."""
    n = len(word)
    size, left = [1] * n, list(range(-1, n - 1))
    heap: list[tuple[float, int, int, int]] = []

    def offer(i: int) -> None:
        j = i + size[i]
        if j < n:
            found = p.by_text.get(word[i : j + size[j]]) if size[i] + size[j] <= p.longest else None
            if found:
                heapq.heappush(heap, (-found[1], i, size[i], size[j]))

    for i in range(n):
        offer(i)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        if size[i] != a or i + a >= n or size[i + a] != b:
            continue  # one of them was joined meanwhile
        size[i + a], size[i] = 0, a + b
        if i + a + b < n:
            left[i + a + b] = i
        offer(i)
        if left[i] >= 0:
            offer(left[i])
    return size


def _byte_ids(p: Pieces, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of the UTF-8 bytes of code points, number of each one's bytes)."""
    raw = codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    lens = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
    return p.byte_ids[np.frombuffer(raw, np.uint8)], lens


def encode_words(p: Pieces, words: list[str], ways: tuple[bool, ...] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """(all ids, number of each word's ids) for each way: Viterbi (True) or merges; by default the way of the model's type.

    Words hold no blank but leading ones.  All ways share one look-up of substrings.
    """
    ways = (p.kind == UNIGRAM,) if ways is None else ways
    by_len: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        by_len.setdefault(len(w), []).append(k)
    made: list[list] = [[] for _ in ways]
    counts: list[list] = [[] for _ in ways]
    order: list[int] = []
    for length, rows in by_len.items():
        step = max(1, BATCH_CELLS // (length * min(length, p.longest)))
        for i in range(0, len(rows), step):
            part = rows[i : i + step]
            codes = np.frombuffer("".join(words[k] for k in part).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(part), length)
            found = _substrings(p, codes)
            for way, ids_made, lens_made in zip(ways, made, counts, strict=True):
                if way:
                    size = _viterbi(p, found)
                elif length > LONG_WORD:
                    size = np.array([_long_merge(p, words[k]) for k in part], np.int32)
                else:
                    size = _merge(p, found)
                row, col = np.nonzero(size)
                at = found[row, col, size[row, col] - 1]
                lens = np.ones(len(at), np.int64)
                lone = np.flatnonzero(at < 0)  # single characters without a piece
                spelled, lens[lone] = _byte_ids(p, codes[row[lone], col[lone]])
                ids = np.repeat(np.where(at >= 0, p.ids[np.maximum(at, 0)], p.unknown), lens)
                ids[np.repeat(at < 0, lens)] = spelled
                ids_made.append(ids.astype(np.int32))
                lens_made.append(np.bincount(row, lens, minlength=len(part)).astype(np.int64))
            order += part
    if not order:
        return [(np.empty(0, np.int32), np.empty(0, np.int64)) for _ in ways]
    back = np.argsort(order)
    out = []
    for ids_made, lens_made in zip(made, counts, strict=True):
        flat, lens = np.concatenate(ids_made), np.concatenate(lens_made)
        starts, lens = (np.cumsum(lens) - lens)[back], lens[back]
        out.append((flat[np.repeat(starts - np.cumsum(lens) + lens, lens) + np.arange(len(flat))], lens))
    return out


def _word_spans(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """First bytes of the words: where blanks begin, and where texts do."""
    blank = data == 0x20
    first = blank.copy()
    first[1:] &= ~blank[:-1]
    first[offs[:-1][offs[:-1] < offs[1:]]] = True
    return np.flatnonzero(first)


class Encoder:
    """Encodes slices of texts; remembers the ids of words it has seen, up to a bound."""

    def __init__(self, pieces: Pieces, ways: tuple[bool, ...] | None = None):
        self.p, self.ways = pieces, (pieces.kind == UNIGRAM,) if ways is None else ways
        self.keys = np.empty(0, np.uint64)
        self.flat = [np.empty(0, np.int32) for _ in self.ways]
        self.starts, self.lens = ([np.empty(0, np.int64) for _ in self.ways] for _ in range(2))

    def marked(self, texts: pa.Array) -> pa.Array:
        """Texts with plain blanks for blank marks, and the blank that the model puts before a text."""
        put = lambda x: pa.scalar(x, texts.type)
        texts = pc.replace_substring(pc.fill_null(texts, put("")), BLANK, " ")
        return pc.if_else(pc.equal(texts, put("")), texts, pc.binary_join_element_wise(put(""), texts, put(" "))) if self.p.prefix else texts

    def encode(self, texts: pa.Array | list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(all ids, offsets of each text's ids) for each way."""
        texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        data, offs = buffers(self.marked(texts))
        data, offs = data[offs[0] : offs[-1]], offs - offs[0]
        starts = _word_spans(data, offs)
        if not len(starts):
            return [(np.empty(0, np.int32), np.zeros(len(offs), np.int64)) for _ in self.ways]
        lens = np.diff(np.append(starts, len(data)))
        v = _BYTE[0][data] * _powers(int(lens.max()), 0)[np.arange(len(data)) - np.repeat(starts, lens)]
        keys, first, word = np.unique(mix(np.add.reduceat(v, starts) + lens.astype(np.uint64) * randoms(1, 22)), return_index=True, return_inverse=True)
        if len(self.keys) > WORDS_KEPT:
            self.__init__(self.p, self.ways)
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        new = self.keys[at] != keys if len(self.keys) else np.ones(len(keys), bool)
        if new.any():
            text = [data[s : s + n].tobytes().decode("utf-8", "replace").replace(" ", BLANK) for s, n in zip(starts[first[new]].tolist(), lens[first[new]].tolist(), strict=True)]
            every = np.concatenate([self.keys, keys[new]])
            order = np.argsort(every)
            self.keys = every[order]
            for k, (flat, n) in enumerate(encode_words(self.p, text, self.ways)):
                self.starts[k] = np.concatenate([self.starts[k], len(self.flat[k]) + np.cumsum(n) - n])[order]
                self.lens[k] = np.concatenate([self.lens[k], n])[order]
                self.flat[k] = np.concatenate([self.flat[k], flat])
            at = np.searchsorted(self.keys, keys)
        at, text_at, out = at[word], np.searchsorted(starts, offs), []
        for k in range(len(self.ways)):
            n = self.lens[k][at]
            upto = np.concatenate([[0], np.cumsum(n)])
            out.append((self.flat[k][np.repeat(self.starts[k][at] - upto[:-1], n) + np.arange(upto[-1])], upto[text_at]))
        return out


def decode(p: Pieces, ids: np.ndarray, offs: np.ndarray) -> list[str]:
    """The text of each run of ids; a leading blank that encoding put there is dropped, broken bytes become U+FFFD."""
    lens = np.array([len(x) for x in p.shown], np.int64)
    flat = np.frombuffer(b"".join(p.shown), np.uint8)
    starts = np.cumsum(lens) - lens
    n = lens[ids]
    upto = np.concatenate([[0], np.cumsum(n)])
    data = flat[np.repeat(starts[ids] - upto[:-1], n) + np.arange(upto[-1])].tobytes()
    edges = upto[offs]
    out = []
    for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        out.append(data[s + (p.prefix and data[s : s + 1] == b" ") : e].decode("utf-8", "replace"))
    return out


def encode_documents(docs: DataFrame, text: str = "text", carry: list[str] | None = None, model: str = MODEL, decoded: bool = True, viterbi: bool = False) -> DataFrame:
    """``carry`` columns (all but the text by default), ``n_tokens``, ``ids`` and, as asked, ``viterbi_ids`` and ``decoded``.

    ``decoded`` is the text that ``ids`` stand for; null if ``viterbi_ids`` stand for another.
    """
    p = docs.sparkSession.sparkContext.broadcast(read_model(model))  # as large as the vocabulary
    carry = [c for c in docs.columns if c != text] if carry is None else carry
    own = F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.struct(F.lit(0).alias("none"))
    source = docs.select(own.alias("own"), F.col(f"`{text}`").alias("text"))
    lists = T.ArrayType(T.IntegerType())
    made = [("n_tokens", T.LongType()), ("ids", lists)] + [("viterbi_ids", lists)] * viterbi + [("decoded", T.StringType())] * decoded
    schema = T.StructType([source.schema["own"], *[T.StructField(*m) for m in made]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(p.value, (p.value.kind == UNIGRAM, True) if viterbi else None)
        for b in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy())
            i, n = 0, b.num_rows
            while i < n:
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + SLICE_BYTES, "right")))
                texts = b.column(1).slice(i, j - i)
                (ids, offs), *more = encoder.encode(texts)
                cols = [b.column(0).slice(i, j - i), pa.array(np.diff(offs)), pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(ids))]
                shown = decode(p.value, ids, offs) if decoded else None
                for best, cut in more:
                    cols.append(pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(best)))
                    if decoded:
                        shown = [x if x == y else None for x, y in zip(shown, decode(p.value, best, cut), strict=True)]
                yield pa.RecordBatch.from_arrays(cols + ([pa.array(shown, pa.string())] if decoded else []), names=schema.names)
                i = j

    out = source.mapInArrow(run, schema)
    names = []
    for m, _ in made:
        names.append(fresh(m, carry + names))
    return out.select(*[F.col("own").getField(c).alias(c) for c in carry], *[F.col(m).alias(x) for (m, _), x in zip(made, names, strict=True)])


def encode_checked(docs: DataFrame, carry: list[str], model: str = MODEL) -> DataFrame:
    """``carry``, ``n_tokens``, ``ids``, ``viterbi_ids`` (the best path over the same pieces) and ``round_trip``: whether both decode to the text.

    The decoded text itself is compared by its digest and not kept.
    """
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("given")
    made = encode_documents(docs.select(F.struct(*carry).alias("of"), digest, "text"), carry=["of", "given"], model=model, viterbi=True)
    right = F.coalesce(F.sha2(F.col("decoded").cast("binary"), 256) == F.col("given"), F.lit(False))
    return made.select(*[F.col("of").getField(c).alias(c) for c in carry], "n_tokens", "ids", "viterbi_ids", right.alias("round_trip"))


def q_op4(spark, sf_dir: str) -> DataFrame:
    """Ids of every document, its Viterbi path over the same pieces, and whether both decode to it."""
    return encode_checked(table(spark, sf_dir, "documents"), ["doc_id"])
