"""Personal data (operator 1): fixed patterns, and spans added by a character-level BiLSTM-CRF.

The patterns give the base spans of four kinds; they are always kept.  The tagger (``tagger.py``) is trained in numpy
from labelled spans: windows of the corpus that hold a digit or an ``@``, labelled with their base spans, and
the same windows with generated examples of each kind written in (forms that the patterns miss included:
national phone formats, adjacent card numbers).  At most ``SAMPLE`` windows are drawn, by smallest hash, from all windows
of all texts, whatever the size of the corpus; this bound is the only thing that does not follow the data.

Every whole text is tagged.  All kinds need a digit or an ``@``, so positions farther than ``MARGIN`` from
any such character are *O* by definition and never run through the network.  The others form stretches;
overlapping windows of ``WIDTH`` cover each stretch, their tag scores are averaged with weights that fall towards a
window's edges, and one Viterbi pass over the whole stretch decodes the reconciled scores.  A decoded span
is added where it overlaps no base span, has the characters that its kind needs, and the reconciled scores make
it more likely than leaving it out by odds of ``SURE``.

Defined cases: null and empty texts have no spans.  Long texts are processed whole, and a stretch of any length is
decoded in one pass.  A corpus without digits trains on generated windows alone.  Repeated rows get equal
results; further columns are carried as asked, and own columns get underscores in front where they would clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tagger
from .common import named, table
from .tagger import KINDS

SAMPLE = 600  # labelled windows drawn from the corpus, at most
MARGIN = 24
WIDTH = 64
STRIDE = 32
SURE = 0.9
BATCH = 2048  # windows that run through the network together

_CUE = re.compile(r"[0-9@]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_NOT_DIGIT = re.compile("[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Anchored at each @, so that long runs of local characters are scanned once, not once a start."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        else:
            done = at + 1  # no local character before here can belong to a later match
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns: leftmost, non-overlapping per kind, sorted."""
    if not text or not _CUE.search(text):
        return []
    out = [(s, 0, e) for s, e in _emails(text)]
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        d = _NOT_DIGIT.sub("", m.group())
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]
    return sorted(out)


def stretches(text: str) -> list[tuple[int, int]]:
    """Runs of positions within MARGIN of a digit or an @."""
    out: list[list[int]] = []
    for m in _CUE.finditer(text):
        s, e = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
        if out and s <= out[-1][1]:
            out[-1][1] = e
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def windows(length: int) -> list[int]:
    """Starts of overlapping windows that cover a stretch of ``length``."""
    if length <= WIDTH:
        return [0]
    starts = list(range(0, length - WIDTH, STRIDE))
    return starts + [length - WIDTH]


# Training ------------------------------------------------------------------------------------------------------------

def _digits(rng, n: int) -> str:
    return "".join(map(str, rng.integers(0, 10, n)))


def example(kind: int, rng) -> list[tuple[str, bool]]:
    """Pieces of text of a kind: (piece, whether it is a span); forms in and beyond the fixed patterns."""
    word = lambda n: "".join(chr(97 + x) for x in rng.integers(0, 26, n))
    if kind == 0:
        local = word(rng.integers(2, 9)) + (["", ".", "_", "+", "-"][rng.integers(0, 5)] + (word(3) if rng.random() < 0.5 else _digits(rng, 2)) if rng.random() < 0.7 else "")
        return [(f"{local}@{word(rng.integers(3, 9))}{_digits(rng, 1) if rng.random() < 0.4 else ''}.{'example.' if rng.random() < 0.4 else ''}{['com', 'org', 'net', 'de', 'fr'][rng.integers(0, 5)]}", True)]
    if kind == 1:
        return [(".".join(str(x) for x in rng.integers(0, 256, 4)), True)]
    if kind == 2:
        card = lambda: (lambda d: " ".join(d[i : i + 4] for i in range(0, 16, 4)) if rng.random() < 0.3 else d)(_digits(rng, 16))
        return [(card(), True)] if rng.random() < 0.7 else [(_digits(rng, 16), True), (" ", False), (_digits(rng, 16), True)]
    a, b, c, d = _digits(rng, 3), _digits(rng, 3), _digits(rng, 4), _digits(rng, int(rng.integers(1, 3)))
    return [([f"+{d} ({a}) {b}-{c}", f"+{d} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}"][rng.integers(0, 4)], True)]


def harmless(rng) -> str:
    """Text with digits that is no personal data."""
    return [f"{rng.integers(1, 12)}.{rng.integers(0, 9)}.", f"{rng.integers(1900, 2030)}", f"{rng.integers(0, 100)}%", '"' + "".join("0123456789abcdef"[x] for x in rng.integers(0, 16, 40)) + '"',
            f"v{rng.integers(1, 9)}.{rng.integers(0, 20)}.{rng.integers(0, 20)}", f"{rng.integers(0, 24):02d}:{rng.integers(0, 60):02d}", f"Version {rng.integers(1, 9)}.0", f"@{rng.integers(1, 99)}"][rng.integers(0, 8)]


def training_windows(labelled: list[tuple[str, list[tuple[int, int, int]]]], seed: int = 3, generated: int = 600) -> tuple[np.ndarray, np.ndarray]:
    """(classes, tags) of labelled windows: corpus pieces with the base spans of their texts, and copies with examples written in."""
    rng = np.random.Generator(np.random.PCG64(seed))
    x, y = [], []

    def add(text: str, spans: list[tuple[int, int, int]]) -> None:
        c, t = np.full(WIDTH, tagger.PAD, np.uint8), np.zeros(WIDTH, np.int8)
        own = tagger.classes(text)[:WIDTH]
        c[: len(own)] = own
        for s, k, e in spans:
            if s < WIDTH:
                t[max(s, 0) : min(e, WIDTH)] = 2 + 2 * k
                t[max(s, 0)] = 1 + 2 * k
        x.append(c)
        y.append(t)

    for p, spans in labelled:
        add(p, spans)
    plain = [re.sub(r"\S*[0-9@]\S*", "", p) for p, _ in labelled] or ["and the of a word is here to read again"]
    for n in range(generated):
        around = plain[int(rng.integers(0, len(plain)))]
        at = int(rng.integers(0, max(1, min(len(around), 30))))
        text, spans = around[:at] + ("" if rng.random() < 0.1 else " "), []
        if n % 5 == 4:
            text += harmless(rng)
        else:
            for piece, is_span in example(n % 5, rng):
                if is_span:
                    spans.append((len(text), n % 5, len(text) + len(piece)))
                text += piece
        add(text + ["", " ", ".", ", ", "!!", "***", "%%%"][rng.integers(0, 7)] + " " + around[at:], spans)
    return np.stack(x), np.stack(y)


def sample(docs: DataFrame, text: str = "text", n: int = SAMPLE) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """At most ``n`` distinct windows of all windows of all texts, by smallest hash, with the spans of their text.

    A task keeps its own ``n`` smallest only, so what is shuffled is bounded, too.  Spans are found on the whole text; one
    that begins before the window or ends behind it is labelled as far as it is seen.
    """
    def windowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[str, str]] = {}
        worst = 2**63
        for b in batches:
            col = b.column(0)
            for row in np.flatnonzero(pc.fill_null(pc.match_substring_regex(col, "[0-9@]"), False).to_numpy(zero_copy_only=False)):
                t = col[int(row)].as_py()
                spans = None
                for s, e in stretches(t):
                    for w in windows(e - s):
                        piece = t[s + w : s + w + WIDTH if e - s > WIDTH else e]
                        by = int.from_bytes(hashlib.blake2b(piece.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big") >> 1
                        if by >= worst or by in best:
                            continue
                        spans = base_spans(t) if spans is None else spans
                        at = s + w
                        best[by] = (piece, ",".join(f"{x - at}:{k}:{y - at}" for x, k, y in spans if x < at + len(piece) and y > at))
                        if len(best) > 2 * n:
                            best = dict(sorted(best.items())[:n])
                            worst = max(best)
        rows = sorted(best.items())[:n]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([v[0] for _, v in rows], pa.string()), pa.array([v[1] for _, v in rows], pa.string())], names=["by", "piece", "spans"])

    found = docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(windowed, "by long, piece string, spans string")
    seen = found.groupBy("by").agg(F.min(F.struct("piece", "spans")).alias("best")).orderBy("by").limit(n).collect()
    return [(r["best"]["piece"], [tuple(map(int, x.split(":"))) for x in r["best"]["spans"].split(",") if x]) for r in seen]


def fit(docs: DataFrame, text: str = "text") -> tagger.Model:
    return tagger.train(*training_windows(sample(docs, text)))


# Inference -----------------------------------------------------------------------------------------------------------

_WEIGHT = (1 + np.minimum(np.arange(WIDTH), np.arange(WIDTH)[::-1])).astype(np.float32)


def tagged(model: tagger.Model, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) decoded in each text."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    held: list[tuple] = []  # (row, start, classes, window starts)
    count = 0

    def flush() -> None:
        x = np.full((count, WIDTH), tagger.PAD, np.uint8)
        k = 0
        for _, _, c, starts in held:
            for s in starts:
                w = c[s : s + WIDTH]
                x[k, : len(w)] = w
                k += 1
        e = np.concatenate([tagger.emissions(model, x[i : i + BATCH]) for i in range(0, count, BATCH)])
        rows, k = [], 0
        for row, at, c, starts in held:
            total, weight = np.zeros((len(c), tagger.N_TAGS), np.float32), np.zeros((len(c), 1), np.float32)
            for s in starts:
                n = min(WIDTH, len(c) - s)
                total[s : s + n] += e[k, :n] * _WEIGHT[:n, None]
                weight[s : s + n] += _WEIGHT[:n, None]
                k += 1
            total /= weight
            rows.append((row, at, total))
        rows.sort(key=lambda r: len(r[2]))
        i = 0
        while i < len(rows):
            j, longest = i, 0
            while j < len(rows) and (j - i + 1) * len(rows[j][2]) <= 1 << 17 or j == i:
                longest = len(rows[j][2])
                j += 1
            lens = np.array([len(r[2]) for r in rows[i:j]])
            grid = np.zeros((j - i, longest, tagger.N_TAGS), np.float32)
            for n, r in enumerate(rows[i:j]):
                grid[n, : lens[n]] = r[2]
            tags = tagger.viterbi(model, grid, lens)
            for n, (row, at, own) in enumerate(rows[i:j]):
                found[row] += _spans(model, texts[row], at, tags[n, : lens[n]], own)
            i = j

    for row, t in enumerate(texts):
        for s, e in stretches(t):
            c = tagger.classes(t[s:e])
            starts = windows(len(c))
            held.append((row, s, c, starts))
            count += len(starts)
            if count >= 4 * BATCH:
                flush()
                held, count = [], 0
    if held:
        flush()
    return [sorted(x) for x in found]


def _spans(model: tagger.Model, text: str, at: int, tags: np.ndarray, scores: np.ndarray) -> list[tuple[int, int, int]]:
    """Decoded spans whose path is SURE against the path that leaves the same characters out."""
    out, k, moves = [], 0, model.moves
    while k < len(tags):
        if tags[k] % 2 == 1:
            kind, s = int(tags[k]) // 2, k
            k += 1
            while k < len(tags) and tags[k] == 2 + 2 * kind:
                k += 1
            path, n = tags[s:k], k - s
            gain = float((scores[np.arange(s, k), path] - scores[s:k, 0]).sum() + moves[0, path[0]] + moves[path[:-1], path[1:]].sum() + moves[path[-1], 0] - (n + 1) * moves[0, 0])
            if gain >= np.log(SURE / (1 - SURE)) and plausible(kind, text[at + s : at + k]):
                out.append((at + s, kind, at + k))
        else:
            k += 1
    return out


def plausible(kind: int, piece: str) -> bool:
    """Whether a span has the characters that its kind needs."""
    digits = len(_NOT_DIGIT.sub("", piece))
    return (bool(re.fullmatch(r"\S+@\S+\.\S+", piece)), piece.count(".") >= 3 and 4 <= digits <= 12, 12 <= digits <= 19, 7 <= digits <= 15)[kind]


def with_added(base: list[tuple[int, int, int]], more: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """All base spans, and those of ``more`` that overlap none of them."""
    out = list(base)
    starts = sorted((s, e) for s, _, e in base)
    for s, k, e in more:
        if not any(s < y and x < e for x, y in starts):
            out.append((s, k, e))
    return sorted(out)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find(docs: DataFrame, text: str = "text", carry: list[str] | None = None, model: tagger.Model | None = None, mask: bool = False) -> DataFrame:
    """``carry`` columns, counts of base spans by kind, ``base`` and ``spans`` lists, and with ``mask`` the ``masked`` text."""
    model = fit(docs, text) if model is None else model
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights
    carry = list(docs.columns if carry is None else carry)
    own = F.struct(*[F.col(f"`{c}`") for c in carry])
    source = docs.select(own.alias("own"), F.col(f"`{text}`").alias("text"))
    fields = [source.schema["own"]] + [T.StructField(f"n_{k}", T.LongType()) for k in KINDS] + [T.StructField(c, T.StringType()) for c in ("base", "spans")]
    schema = T.StructType(fields + ([T.StructField("masked", T.StringType())] if mask else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shipped.value
        for b in batches:
            col = b.column(1)
            n = b.num_rows
            cued = np.flatnonzero(pc.fill_null(pc.match_substring_regex(col, "[0-9@]"), False).to_numpy(zero_copy_only=False))
            texts = [col[int(r)].as_py() for r in cued]
            counts, base, every = np.zeros((n, len(KINDS)), np.int64), [""] * n, [""] * n
            masked = col
            spans = {}
            for r, t, more in zip(cued, texts, tagged(net, texts), strict=True):
                found = base_spans(t)
                for _, k, _ in found:
                    counts[r, k] += 1
                spans[int(r)] = with_added(found, more)
                base[r], every[r] = listed(found), listed(spans[int(r)])
            if mask:
                out = col.to_pylist()
                for r, found in spans.items():
                    out[r] = masked_text(out[r], found)
                masked = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(counts[:, k]) for k in range(len(KINDS))], pa.array(base, pa.string()), pa.array(every, pa.string())]
                                             + ([masked] if mask else []), names=schema.names)

    made = source.mapInArrow(run, schema)
    rest = [f"n_{k}" for k in KINDS] + ["base", "spans"] + (["masked"] if mask else [])
    return made.select(*[F.col("own").getField(c).alias(c) for c in carry], *[F.col(c).alias(n) for c, n in zip(rest, named(rest, carry), strict=True)])


def masked_text(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first counts."""
    out, done = [], 0
    for s, k, e in spans:
        if s >= done:
            out += [text[done:s], f"[{KINDS[k].upper()}]"]
            done = e
        else:
            done = max(done, e)
    return "".join([*out, text[done:]])


def mask_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with personal data masked; all columns as they were."""
    cols = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"), F.col(f"`{text}`").alias("text"))
    made = find(packed, "text", ["row"], mask=True)
    return made.select(*[(F.col("masked") if c == text else F.col("row").getField(c)).alias(c) for c in cols])


def q_op1(spark, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    made = find(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return made.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")
