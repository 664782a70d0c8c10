"""Phrase collocations by stripes (operator 12).

Texts are lower-cased in A-Z, split at ``. , ; : ! ?`` and line ends into pieces, and pieces into words.  A *stripe* is an
associative counter: it belongs to a prefix (a language, or a language's phrase of 1 to 4 words) and counts the
words that follow it.  One structure gives all that scoring needs: an entry is a phrase's frequency, and also the
total of the stripe that the phrase itself heads; a stripe's largest entry tells whether some extension is as frequent
as its prefix.

1. Each order (1 to 5 words) is one pass.  A task keeps its stripes in numpy arrays and sends them in bundles, by bucket
   of the prefix; the bundles of a bucket are sorted together and their stripes merged element by element.
2. A phrase can only reach ``least`` occurrences if the phrase without its last and the one without its first word do, so
   a pass skips windows whose parts failed in the pass before.  What passed is handed on as a bitmap of a fixed largest
   size: a wrong bit lets a phrase be counted in vain, never lost, and counts themselves are exact.
3. Frequent phrases join with the phrase of one word less at either end.  So each carries the frequencies of all its
   first and last parts, from which cuts are scored in exact decimals.
4. A phrase is subsumed if some longer candidate that holds it is as frequent.  Frequencies never grow with length, so
   it is enough to look at candidates of one word more.

Words are told apart by 64-bit hashes (with their language), prefixes by 128 bits.

Scale: tasks send one counter a prefix, never occurrences.  The number of buckets follows the data, and a merging task
holds one bucket at a time.  Stripes of languages and of prefixes that hold more than 1/``HOT`` of all words (so fewer
than ``HOT`` an order) are dealt over all buckets by the next word.  After the passes only frequent phrases are joined.

Defined cases: a null language is ``und``; null, empty and wordless texts count nothing; ids, repeated rows and further
columns play no part (a repeated row counts twice); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, text_bytes, written
from .words import SLICE_BYTES, buffers, mix, randoms, words_of

LEAST = 100  # occurrences of a candidate
LONGEST = 5  # words of a candidate
TOP = 2000  # phrases reported a language
HOT = 1 << 16
ROW_ENTRIES = 1024  # entries of one row
HELD = 1 << 20  # entries a task holds before it adds up equal ones
MOST_BITS = 1 << 27  # largest bitmap (16 MB)
BUCKET_BYTES, MOST_BUCKETS = 1 << 20, 1 << 16  # text of a bucket of stripes; beyond, rows would hold single entries
_U = np.uint64
_BREAK = np.zeros(256, bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
_PLAIN[_BREAK] = 32
_FACTORS = [randoms(LONGEST, 41), randoms(LONGEST, 42)]


@dataclass
class Entries:
    """Stripe entries as columns: prefix (two sums of word hashes), next word, count, and for order 1 its text."""

    p1: np.ndarray
    p2: np.ndarray
    word: np.ndarray
    count: np.ndarray
    text: pa.Array | None = None

    def take(self, at: np.ndarray) -> Entries:
        return Entries(self.p1[at], self.p2[at], self.word[at], self.count[at], None if self.text is None else self.text.take(pa.array(at)))

    def __len__(self) -> int:
        return len(self.count)


def joined(parts: list[Entries]) -> Entries:
    """Parts put together, equal entries added up."""
    one = parts[0] if len(parts) == 1 else Entries(
        *[np.concatenate([getattr(p, c) for p in parts]) for c in ("p1", "p2", "word", "count")],
        None if parts[0].text is None else pa.concat_arrays([p.text for p in parts]))
    if not len(one):
        return one
    key = mix(one.p1 + one.word * _FACTORS[1][0])
    order = np.argsort(key)
    differs = lambda c: c[order][1:] != c[order][:-1]
    change = differs(one.p1) | differs(one.p2) | differs(one.word)
    if (change & ~differs(key)).any():  # two entries with one sort key
        order = np.lexsort((one.word, one.p2, one.p1))
        change = differs(one.p1) | differs(one.p2) | differs(one.word)
    heads = np.flatnonzero(np.concatenate([[True], change]))
    out = one.take(order[heads])
    out.count = np.add.reduceat(one.count[order], heads)
    return out


@dataclass
class Held:
    """Entries in the making, added up whenever too many are held."""

    parts: list[Entries] = field(default_factory=list)
    size: int = 0
    limit: int = HELD

    def add(self, e: Entries) -> None:
        self.parts.append(e)
        self.size += len(e)
        if self.size > self.limit:
            self.settle()

    def settle(self) -> Entries | None:
        if self.parts:
            self.parts = [joined(self.parts)]
            self.size = len(self.parts[0])
            self.limit = max(HELD, 2 * self.size)
        return self.parts[0] if self.parts else None


def _bits_at(keys: np.ndarray, bits: int) -> np.ndarray:
    return (mix(keys) & _U(bits - 1)).astype(np.int64)


def _spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    lens = ends - starts
    offs = np.zeros(len(lens) + 1, np.int64)
    np.cumsum(lens, out=offs[1:])
    return pa.LargeStringArray.from_buffers(len(lens), pa.py_buffer(offs), pa.py_buffer(data[np.repeat(starts - offs[:-1], lens) + np.arange(offs[-1])]))


def _counted(data: np.ndarray, offs: np.ndarray, lang: np.ndarray, k: int, passed: np.ndarray | None) -> Entries:
    """Entries of order ``k`` in some whole texts; ``lang`` holds a hash for each text."""
    plain = _PLAIN[data]
    w = words_of(plain, offs)
    n = len(w.starts)
    if n < k:
        none = np.empty(0, np.uint64)
        return Entries(none, none, none, np.empty(0, np.int64), pa.array([], pa.large_string()) if k == 1 else None)
    of = lang[w.doc]
    h = mix(w.hashes() ^ of)
    if k == 1:
        words, first, count = np.unique(h, return_index=True, return_counts=True)
        return Entries(of[first], np.zeros(len(words), np.uint64), words, count, _spans(plain, w.starts[first], w.ends[first]))
    piece = np.cumsum(_BREAK[data], dtype=np.int32)[w.starts] if len(data) < 2**31 else np.cumsum(_BREAK[data])[w.starts]
    new = np.ones(n, bool)
    new[1:] = (piece[1:] != piece[:-1]) | (w.doc[1:] != w.doc[:-1])
    run = np.cumsum(new)
    sums = [np.zeros(n - k + 2, np.uint64) for _ in _FACTORS]
    for s, factors in zip(sums, _FACTORS, strict=True):
        for j in range(k - 1):
            s += h[j : j + len(s)] * factors[j]
    at = np.flatnonzero(run[: n - k + 1] == run[k - 1 :])
    if passed is not None:
        bits = len(passed) * 8
        where = _bits_at(sums[0], bits)
        good = (passed[where >> 3] >> (where & 7).astype(np.uint8)) & 1 == 1
        at = at[good[at] & good[at + 1]]
    return Entries(sums[0][at], sums[1][at], h[at + k - 1], np.ones(len(at), np.int64))


_BUNDLE = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("p1", T.ArrayType(T.LongType())), T.StructField("p2", T.ArrayType(T.LongType())),
                        T.StructField("sizes", T.ArrayType(T.IntegerType())), T.StructField("langs", T.ArrayType(T.StringType())), T.StructField("words", T.ArrayType(T.LongType())),
                        T.StructField("counts", T.ArrayType(T.LongType())), T.StructField("texts", T.ArrayType(T.StringType()))])
_ENTRY = T.StructType([T.StructField("p1", T.LongType()), T.StructField("p2", T.LongType()), T.StructField("word", T.LongType()), T.StructField("a", T.LongType()),
                       T.StructField("q1", T.LongType()), T.StructField("q2", T.LongType()), T.StructField("lang", T.StringType()), T.StructField("text", T.StringType())])


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def _rows(e: Entries, bucket: np.ndarray, names: dict[int, str]) -> Iterator[pa.RecordBatch]:
    """Entries as bundles: the stripes (or parts of them) of one bucket, a bounded number of entries a row."""
    order = np.lexsort((e.word, e.p2, e.p1, bucket))
    e, bucket = e.take(order), bucket[order]
    n = len(e)
    turn = np.ones(n, bool)
    turn[1:] = bucket[1:] != bucket[:-1]
    at = np.flatnonzero(turn)
    row = (np.arange(n) - np.repeat(at, np.diff(np.append(at, n)))) % ROW_ENTRIES == 0
    stripe = row.copy()
    stripe[1:] |= (e.p1[1:] != e.p1[:-1]) | (e.p2[1:] != e.p2[:-1])
    rows, stripes = np.append(np.flatnonzero(row), n), np.append(np.flatnonzero(stripe), n)
    for i in range(0, len(rows) - 1, 500):
        cut = rows[i : i + 501]
        own = np.searchsorted(stripes, cut)  # the stripes of these rows
        heads, span = stripes[own[0] : own[-1]], slice(cut[0], cut[-1])
        by_stripe, by_entry = pa.array(own - own[0], pa.int32()), pa.array(cut - cut[0], pa.int32())
        sizes = pa.array(np.diff(stripes[own[0] : own[-1] + 1]), pa.int32())
        listed = pa.ListArray.from_arrays
        langs = pa.nulls(len(cut) - 1, pa.list_(pa.string())) if e.text is None else listed(by_stripe, pa.array([names[int(p)] for p in e.p1[heads]], pa.string()))
        texts = pa.nulls(len(cut) - 1, pa.list_(pa.string())) if e.text is None else listed(by_entry, e.text[cut[0] : cut[-1]].cast(pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array(bucket[cut[:-1]], pa.int32()), listed(by_stripe, _long(e.p1[heads])), listed(by_stripe, _long(e.p2[heads])), listed(by_stripe, sizes),
                                          langs, listed(by_entry, _long(e.word[span])), listed(by_entry, pa.array(e.count[span])), texts], names=_BUNDLE.names)


def _tally(k: int, passed, hot, buckets: int):
    """Order ``k`` of (lang, text) rows as bundles of stripes; ``passed`` and ``hot`` are broadcast arrays or None."""
    def sent(e: Entries, names: dict[int, str]) -> Iterator[pa.RecordBatch]:
        spread = mix(e.word) if k == 1 else np.where(np.isin(e.p1, hot.value), mix(e.word), _U(0))  # hot stripes are dealt over all buckets
        return _rows(e, ((mix(e.p1) + spread) % _U(buckets)).astype(np.int32), names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, names, total = Held(), {}, {}
        for b in batches:
            langs = b.column(0).dictionary_encode()
            shown = langs.dictionary.to_pylist()
            coded = np.array([hash_text(x) for x in shown], np.uint64)
            names |= {int(c): x for c, x in zip(coded, shown, strict=True)}
            lang = coded[langs.indices.to_numpy(zero_copy_only=False)] if len(b) else coded
            data, offs = buffers(b.column(1))
            i, n = 0, len(offs) - 1
            while i < n:
                j = max(i + 1, int(np.searchsorted(offs, offs[i] + SLICE_BYTES, "right")) - 1)
                e = _counted(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], lang[i:j], k, None if passed is None else passed.value)
                if k == 1:
                    for p in np.unique(e.p1):
                        total[int(p)] = total.get(int(p), 0) + int(e.count[e.p1 == p].sum())
                held.add(e)
                i = j
                if len(held.parts) == 1 and held.size > HELD // 2:  # adding up did not help: send what is there
                    yield from sent(held.parts[0], names)
                    held = Held()
        e = held.settle()
        if e is not None and len(e):
            yield from sent(e, names)
        if k == 1 and total:  # entry 0 of a language: all its words
            p = np.array(list(total), np.uint64)
            none = np.zeros(len(p), np.uint64)
            yield from sent(Entries(p, none, none, np.array(list(total.values()), np.int64), pa.array([""] * len(p), pa.large_string())), names)

    return run


def hash_text(x: str) -> int:
    b = np.frombuffer(x.encode(), np.uint8)
    return int(mix(np.array([(b.astype(np.uint64) + _U(1)).dot(randoms(len(b), 43))], np.uint64) + _U(len(b)))[0])


def _merge(k: int, least: int):
    """Sorted fragments of stripes, merged; entries with ``least`` occurrences and the key of the phrase they make."""
    factors = [f[k - 1] for f in _FACTORS]

    def out(e: Entries, names: dict[int, str]) -> Iterator[pa.RecordBatch]:
        e = joined([e])
        keep = np.flatnonzero((e.count >= least) | (e.word == 0))
        if not len(keep):
            return
        e = e.take(keep)
        base = [np.zeros(len(e), np.uint64)] * 2 if k == 1 else [e.p1, e.p2]
        made = [_long(b + e.word * f) for b, f in zip(base, factors, strict=True)]
        text = pa.nulls(len(e), pa.string()) if e.text is None else e.text.cast(pa.string())
        lang = pa.array([names.get(int(p)) for p in e.p1], pa.string())
        yield pa.RecordBatch.from_arrays([_long(e.p1), _long(e.p2), _long(e.word), pa.array(e.count), *made, lang, text], names=_ENTRY.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last, names = Held(), None, {}
        for b in batches:
            if not b.num_rows:
                continue
            bucket, sizes = b.column(0).to_numpy(), b.column(3).flatten().to_numpy()
            p = [b.column(i).flatten().to_numpy().view(np.uint64) for i in (1, 2)]
            e = Entries(np.repeat(p[0], sizes), np.repeat(p[1], sizes), b.column(5).flatten().to_numpy().view(np.uint64), b.column(6).flatten().to_numpy(),
                        b.column(7).flatten().cast(pa.large_string()) if k == 1 else None)
            if k == 1:
                for x in np.unique(p[0]):
                    names[int(x)] = names.get(int(x)) or b.column(4).flatten()[int(np.argmax(p[0] == x))].as_py()
            # entries of the batch's last bucket wait: the next batch may go on with it
            open_rows = int(np.argmax(bucket == bucket[-1]))
            edge = int(pc.sum(pc.list_value_length(b.column(5)[:open_rows])).as_py() or 0)
            if open_rows or last != bucket[-1]:
                if edge:
                    held.add(e.take(np.arange(edge)))
                done = held.settle()
                if done is not None and len(done):
                    yield from out(done, names)
                held = Held()
            held.add(e.take(np.arange(edge, len(e))))
            last = bucket[-1]
        done = held.settle()
        if done is not None and len(done):
            yield from out(done, names)

    return run


def _bitmap(phrases: DataFrame) -> np.ndarray:
    """Bits of the phrases' keys: at least 16 a phrase, ``MOST_BITS`` at most; what reaches the driver is no larger."""
    n = phrases.count()
    bits = min(MOST_BITS, 1 << max(16, int(16 * n).bit_length()))
    schema = "at long, bits long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            where = np.unique(_bits_at(b.column(0).to_numpy().view(np.uint64), bits))
            yield pa.RecordBatch.from_arrays([pa.array(where >> 6), pa.array((np.uint64(1) << (where & 63).astype(np.uint64)).view(np.int64))], names=["at", "bits"])

    rows = phrases.select("q1").mapInArrow(run, schema).groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits >> 6, np.uint64)
    out[rows.column("at").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out.view(np.uint8)


def mine(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, longest: int = LONGEST) -> list[DataFrame]:
    """Frequent phrases by order, each a written table: lang, phrase, words (hashes), a, n, ``firsts`` and ``rests``.

    ``firsts[j-1]`` is the frequency of the first ``j`` words, ``rests[j-1]`` that of the words after them.
    """
    if not 1 <= longest <= LONGEST:
        raise ValueError(f"phrases have 1 to {LONGEST} words")
    spark = docs.sparkSession
    source = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text}`").alias("text"))
    buckets = max(64, min(MOST_BUCKETS, text_bytes(source) // BUCKET_BYTES))
    passed = hot = None
    orders: list[DataFrame] = []
    for k in range(1, longest + 1):
        stripes = source.mapInArrow(_tally(k, passed, hot, buckets), _BUNDLE)
        made = stripes.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_merge(k, least), _ENTRY)
        entries = written(made, f"stripes{k}")
        if k == 1:
            sums = entries.where("word = 0").groupBy("lang").agg(F.sum("a").alias("n"))
            none = F.array().cast("array<long>")
            now = entries.where("word <> 0").join(sums, "lang").select("lang", F.col("text").alias("phrase"), F.array("word").alias("words"), "a", "n", none.alias("firsts"), none.alias("rests"), "q1", "q2")
            total = int(sums.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
        else:
            before = orders[-1]
            head = before.select(F.col("q1").alias("p1"), F.col("q2").alias("p2"), "lang", "n", F.col("phrase").alias("head"), F.col("words").alias("headwords"), F.col("a").alias("heada"), "firsts")
            tail = before.select(F.col("words").alias("tailwords"), F.col("a").alias("taila"), F.col("rests").alias("tailrests"))
            word = orders[0].select(F.col("words")[0].alias("word"), F.col("phrase").alias("tailword"))
            now = (entries.drop("lang", "text").join(head, ["p1", "p2"]).join(word, "word")
                   .withColumn("words", F.concat("headwords", F.array("word"))).withColumn("tailwords", F.slice("words", 2, k - 1)).join(tail, "tailwords")
                   .select("lang", F.concat_ws(" ", "head", "tailword").alias("phrase"), "words", "a", "n", F.concat("firsts", F.array("heada")).alias("firsts"),
                           F.concat(F.array("taila"), F.col("tailrests")).alias("rests"), "q1", "q2"))
        orders.append(written(now, f"phrases{k}"))
        if k < longest:
            for old in (passed, hot):
                if old is not None:
                    old.unpersist()
            passed = spark.sparkContext.broadcast(_bitmap(orders[-1]))
            often = orders[-1].where(F.col("a") > F.lit(total // HOT)).select("q1").toArrow().column(0)  # fewer than HOT
            hot = spark.sparkContext.broadcast(often.to_numpy().view(np.uint64))
    return orders


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best ``top`` phrases of each language that no longer one subsumes."""
    orders = mine(docs, lang, text, least, longest)
    parts = []
    for k in range(2, longest + 1):
        now = orders[k - 1]
        if k < longest:
            longer = orders[k]
            held = [longer.select(F.slice("words", s, k).alias("words"), F.col("a").alias("longer")) for s in (1, 2)]
            most = held[0].unionByName(held[1]).groupBy("words").agg(F.max("longer").alias("longer"))
            now = now.join(most, "words", "left").where(F.col("longer").isNull() | (F.col("longer") < F.col("a")))
        exact = lambda c: f"cast({c} as decimal(19,0))"
        cuts = [F.struct(F.expr(f"({exact('a')} * {exact('n')} * 1000BD) div ({exact(f'firsts[{j}]')} * {exact(f'rests[{j}]')})").alias("score"), F.lit(j).alias("k"),
                         F.col("firsts")[j].alias("l"), F.col("rests")[j].alias("r")) for j in range(k - 1)]
        parts.append(now.withColumn("cut", F.least(*cuts) if k > 2 else cuts[0]).select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score"))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def q_op12(spark, sf_dir: str) -> DataFrame:
    """Collocations of every language in ``documents``."""
    return collocations(table(spark, sf_dir, "documents"))


#: The same by counting every phrase.
SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS s FROM d),
w AS (SELECT lang, list_filter(string_split_regex(s, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
f AS (SELECT lang, k, g, CAST(count(*) AS BIGINT) AS a FROM (
        SELECT lang, k, list_slice(w, i, i + k - 1) AS g FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(w) >= k))
      GROUP BY ALL HAVING count(*) >= 100),
ext AS (SELECT lang, list_slice(g, 1, k - 1) AS g, a FROM f WHERE k > 1 UNION ALL SELECT lang, list_slice(g, 2, k) AS g, a FROM f WHERE k > 1),
longer AS (SELECT lang, g, max(a) AS a FROM ext GROUP BY ALL),
c AS (SELECT f.* FROM f LEFT JOIN longer AS x ON f.lang = x.lang AND f.g = x.g WHERE f.k > 1 AND (x.a IS NULL OR x.a < f.a)),
cut AS (SELECT lang, k, g, a, unnest(range(1, k)) AS j FROM c),
s AS (SELECT cut.*, l.a AS l, r.a AS r, n.n, (1000 * CAST(cut.a AS HUGEINT) * n.n) // (CAST(l.a AS HUGEINT) * r.a) AS score
      FROM cut JOIN f AS l ON l.lang = cut.lang AND l.g = list_slice(cut.g, 1, cut.j) JOIN f AS r ON r.lang = cut.lang AND r.g = list_slice(cut.g, cut.j + 1, cut.k) JOIN n ON n.lang = cut.lang),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, j) AS best FROM s),
o AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM b WHERE best = 1)
SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM o) WHERE rank <= 2000
"""
