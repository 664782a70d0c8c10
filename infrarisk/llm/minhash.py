"""Near-duplicate classes by MinHash (operator 2).

Words are lower-cased in A-Z only; a document's set holds its distinct ``k``-word shingles (the whole sequence if
it has fewer words).  Documents whose sets have a Jaccard similarity of ``threshold`` or more are linked, and
linked documents form components.

1. One pass makes each document's set key (a digest of the whole sorted set), its set size, and band hashes
   over universal-hash minima.  Equal sets become one *class*: copies are never compared.
2. Classes that share a band bucket form a candidate graph, one edge to the bucket's smallest class and
   never a pair within a bucket; alternating large-star and small-star finds its components.
3. Inside a candidate component classes are compared in *tiles* of bounded blocks: signatures first
   (agreement within ``SIGMAS`` deviations of the threshold), then the full sets.  Classes that are already
   connected inside the tile are skipped, so a tile returns a spanning forest of true links, not pairs.
   Large components are cut into blocks, every pair of blocks in a task of its own.
4. Components of the confirmed links, again by the star algorithm.

Bands are chosen so that a pair exactly at the threshold misses every band with probability ``MISS``; step 3
compares every pair of a candidate component, also those that share no band.

Scale: shuffles carry band hashes and, for candidates only, texts and sets.  A hot group costs one row a
class and block, is spread over its tiles, and is never collected; no cap drops a pair.

Defined cases: null or blank texts have an empty set, are linked with nothing and are their own
component.  Where ``id_col`` is null or repeats, rows are told apart by a hash of id and text; the component
id is the smallest non-null id of the component (null if there is none).  Rows that repeat an id and a
text are copies like any other; all rows that hold the component's id are ``kept``.  Own columns get underscores in
front where a carried one has their name.  ``drop_near_duplicates`` keeps one
row of each component whatever the ids: the smallest id (null last), then text hash, then the first of equal rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import FEW_ROWS, discard, fresh, named, prefiltered, table, written
from .components import connected_components
from .words import chained, mix, randoms, slices

ROWS = 6  # minima in a band
MISS = 1e-6
SIGMAS = 4.5
BLOCK_CLASSES = 1000
BLOCK_SHINGLES = 2_000_000
_U = np.uint64


def bands_for(threshold: float) -> int:
    """Bands of ROWS minima, so that a pair at the threshold is missed with probability MISS."""
    return math.ceil(math.log(MISS) / math.log(1 - threshold**ROWS))


def _minima(shingles: np.ndarray, n: int) -> np.ndarray:
    """``n`` universal-hash minima (multiply-add modulo 2**32) of a set of 64-bit shingle hashes."""
    a, b = (randoms(n, 11) >> _U(31)).astype(np.uint32) | np.uint32(1), (randoms(n, 12) >> _U(32)).astype(np.uint32)
    low = np.full(n, 0xFFFFFFFF, np.uint32)
    x = (shingles >> _U(32)).astype(np.uint32)
    for i in range(0, len(x), 2048):
        np.minimum(low, (a[:, None] * x[None, i : i + 2048] + b[:, None]).min(1), out=low)
    return low


def _band_hashes(low: np.ndarray, bands: int) -> np.ndarray:
    h = (low.reshape(bands, ROWS).astype(np.uint64) * randoms(ROWS, 13)[None, :]).sum(1, dtype=np.uint64)
    return mix(h + np.arange(bands, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)).view(np.int64)


def _sets(col: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text."""
    for i, _, w in slices(col):
        h = w.hashes(lower=True)
        full = chained(h, k, at := np.flatnonzero(w.windows(k)))
        of = np.searchsorted(w.doc[at], np.arange(len(w.offs)))
        for d, n in enumerate(w.counts()):
            if n >= k:
                yield i + d, np.unique(full[of[d] : of[d + 1]])
            elif n:
                s = w.first[d]
                yield i + d, chained(h[s : s + n], int(n), np.zeros(1, np.int64), seed=100 + int(n))
            else:
                yield i + d, np.empty(0, np.uint64)


def _spanning(sets: list[np.ndarray], sigs: np.ndarray, left: np.ndarray, right: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Confirmed links that connect whatever links of left x right connect; indices into ``sets``."""
    root = np.arange(len(sets))
    size = np.array([len(s) for s in sets], dtype=np.int64)
    t = num / den
    least = t - SIGMAS * math.sqrt(t * (1 - t) / sigs.shape[1])
    links = []
    for a in left:
        mates = right[right > a] if left is right else right
        mates = mates[(root[mates] != root[a]) & (np.minimum(size[mates], size[a]) * den >= np.maximum(size[mates], size[a]) * num)]
        if not len(mates):
            continue
        mates = mates[(sigs[mates] == sigs[a]).mean(1) >= least]
        if not len(mates):
            continue
        lens = size[mates]
        both = np.concatenate([sets[m] for m in mates])
        place = np.searchsorted(sets[a], both)
        place[place == len(sets[a])] = 0
        inter = np.add.reduceat((sets[a][place] == both).astype(np.int64), np.cumsum(lens) - lens)
        for m in mates[inter * den >= num * (lens + size[a] - inter)]:
            if root[m] != root[a]:
                links.append((int(a), int(m)))
                root[root == root[m]] = root[a]
    return links


def _tile(num: int, den: int):
    def run(t: pa.Table) -> pa.Table:
        node = t.column("node").to_numpy()
        _, at = np.unique(node, return_index=True)
        sets, sigs = t.column("items").to_pylist(), t.column("sig").to_pylist()
        node, block = node[at], t.column("block").to_numpy()[at]
        sets = [np.frombuffer(sets[i], np.uint64) for i in at]
        sigs = np.stack([np.frombuffer(sigs[i], np.uint32) for i in at])
        one, two = t.column("one")[0].as_py(), t.column("two")[0].as_py()
        left = np.flatnonzero(block == one)
        links = _spanning(sets, sigs, left, left if one == two else np.flatnonzero(block == two), num, den)
        return pa.table({"a": pa.array([int(node[x]) for x, _ in links], pa.int64()), "b": pa.array([int(node[y]) for _, y in links], pa.int64())})

    return run


def _labelled(docs: DataFrame, id_col: str, text: str, k: int, threshold: tuple[int, int], carry: list[str], order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with the ``key`` of their set, (key, id, component) of each set): both written tables.

    ``order`` names a struct in ``own``; then each set has the least one of its rows as well.
    """
    num, den = threshold
    bands = bands_for(num / den)
    key = F.col(f"`{id_col}`").cast("long")
    n, ids = docs.agg(F.count(F.lit(1)), F.countDistinct(key)).first()
    rid = key if n == ids else F.xxhash64(key, F.col(f"`{text}`"))
    source = docs.select(rid.alias("rid"), key.alias("id"), F.col(f"`{text}`").alias("text"),
                         F.struct(*[F.col(f"`{c}`") for c in carry]).alias("own"))
    own = source.schema["own"]
    marked_schema = T.StructType([T.StructField("rid", T.LongType()), T.StructField("id", T.LongType()), own, T.StructField("n_shingles", T.LongType()),
                                  T.StructField("key", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, keys, hashes = [], [], []
            for _, s in _sets(b.column(b.schema.get_field_index("text")), k):
                size.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                hashes.append(_band_hashes(_minima(s, bands * ROWS), bands) if len(s) else np.empty(0, np.int64))
            flat = pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(h) for h in hashes]), pa.int32()), pa.array(np.concatenate([*hashes, np.empty(0, np.int64)]), pa.int64()))
            col = lambda c: b.column(b.schema.get_field_index(c))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([col("rid"), col("id"), col("own"), pa.array(size, pa.int64()), pa.array(keys, pa.binary()), flat], names=marked_schema.names)

    rows = written(source.mapInArrow(marked, marked_schema), "shingled")
    classes = written(rows.where("key IS NOT NULL").groupBy("key").agg(
        F.min("rid").alias("node"), F.min("id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"),
        *([F.min(F.col("own").getField(order)).alias(order)] if order else [])), "classes")

    spread = classes.select("node", F.explode("bands").alias("bucket"))
    hubs = written(spread.groupBy("bucket").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket", "hub"), "hubs")
    cand = prefiltered(spread, "bucket", hubs, "bucket").join(hubs, "bucket").select("node", "hub").distinct()
    groups = written(connected_components(cand, "node", "hub").withColumnRenamed("component", "cc"), "candidates")
    sized = groups.join(classes.select("node", "n_shingles"), "node")
    cuts = sized.groupBy("cc").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_CLASSES, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    members = groups.join(cuts, "cc").select("node", "cc", "blocks")

    set_schema = T.StructType([T.StructField("node", T.LongType()), T.StructField("items", T.BinaryType()), T.StructField("sig", T.BinaryType())])

    def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            items, sigs = [], []
            for _, s in _sets(b.column(b.schema.get_field_index("text")), k):
                items.append(s.tobytes())
                sigs.append(_minima(s, bands * ROWS).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in ("node",)] + [pa.array(items, pa.binary()), pa.array(sigs, pa.binary())], names=set_schema.names)

    # texts of classes without a candidate are left behind before anything is shuffled; copies of a class drop out
    held = prefiltered(source.select(F.col("rid").alias("node"), "text"), "node", members, "node").mapInArrow(with_sets, set_schema).join(members, "node")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    tiles = (held.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .withColumn("one", F.least("block", "other")).withColumn("two", F.greatest("block", "other")))
    links = written(tiles.groupBy("cc", "one", "two").applyInArrow(_tile(num, den), "a long, b long"), "links")

    labels = connected_components(links)
    extra = [order] if order else []
    named_ = written(classes.select("key", "node", "id", *extra).join(labels, "node", "left")
                     .select("key", "id", F.coalesce("component", "node").alias("component"), *extra), "labels")
    discard(classes, hubs, groups, links)
    return rows, named_


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 5,
                    threshold: tuple[int, int] = (80, 100), carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns (``id_col`` by default), ``n_shingles``, ``component_id`` and ``kept``."""
    carry = [id_col] if carry is None else carry
    rows, joined = _labelled(docs, id_col, text, k, threshold, carry)
    least = joined.groupBy("component").agg(F.min("id").alias("component_id"))
    verdict = written(joined.join(least, "component").select("key", "component_id"), "verdict")
    discard(joined)
    out = rows.join(verdict, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id"))
    size, comp, kept = named(["n_shingles", "component_id", "kept"], carry)
    return (out.withColumn("c_", component)
            .select(*[F.col("own").getField(c).alias(c) for c in carry], F.col("n_shingles").alias(size), F.col("c_").alias(comp),
                    F.col("id").eqNullSafe(F.col("c_")).alias(kept)))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 5, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """One document of each near-duplicate group, with its columns as they were.

    Where ids are unique, helper tables hold ids only and the documents to drop are taken off by id; else rows are carried.
    """
    cols, ident = docs.columns, F.col(f"`{id_col}`").cast("long")
    n, ids = docs.agg(F.count(F.lit(1)), F.countDistinct(ident)).first()
    if n == ids:
        slim = docs.select(ident.alias("id_"), F.col(f"`{text}`").alias("text_"))
        gone = written(near_duplicates(slim, "id_", "text_", k, threshold).where("NOT kept").select(F.col("id_").alias(fresh("gone", cols))), "gone")
        few = gone.limit(FEW_ROWS + 1).count() <= FEW_ROWS
        return docs.join(F.broadcast(gone) if few else gone, ident == F.col(gone.columns[0]), "left_anti")
    at = F.monotonically_increasing_id()  # read back from a written table only
    order = F.struct(ident.isNull().alias("last"), ident.alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("hash"), at.alias("at"))
    packed = docs.select(F.col(f"`{id_col}`").alias("id_"), F.col(f"`{text}`").alias("text_"), F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row_"), order.alias("order_"))
    rows, labels = _labelled(packed, "id_", "text_", k, threshold, ["row_", "order_"], "order_")
    firsts = labels.groupBy("component").agg(F.min("order_").alias("order_")).select(F.col("order_.at").alias("at"))
    found = rows.select("key", F.col("own.row_").alias("row_"), F.col("own.order_.at").alias("at"))
    kept = found.where("key IS NOT NULL").join(firsts, "at", "left_semi").unionByName(found.where("key IS NULL"))
    return kept.select(*[F.col("row_").getField(c).alias(c) for c in cols])


def q_op2(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document: three words, similarity 0.85."""
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, threshold=(85, 100))


#: The same by counting shared shingles of all pairs and closing the links.
SQL = r"""
WITH RECURSIVE
docs AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 2), ' ') AS s
       FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM docs WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh AS a JOIN sh AS b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT p.a, p.b FROM pairs AS p JOIN n AS x ON p.a = x.doc_id JOIN n AS y ON p.b = y.doc_id WHERE 100 * p.c >= 85 * (x.n + y.n - p.c)),
sym AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach AS r JOIN sym AS l ON r.b = l.a),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents AS d JOIN comp AS c ON d.doc_id = c.doc_id LEFT JOIN n ON d.doc_id = n.doc_id
"""
