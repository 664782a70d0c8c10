"""Prefix trie of conversations by depth-band rollup (operator 11).

A node is a distinct sequence of the first ``d`` turns; its key is a digest of running sums of turn digests.  Subtree totals
would need every node at all its ancestors, or one round a level.  Here depth is cut into bands of ``BAND`` levels:

1. each node explodes to its ancestors inside its own band only (at most ``BAND``), where its values are added up;
2. the tops of bands form a trie that is ``BAND`` times lower; the same step on it (and on its tops, ...) completes them;
3. a completed top hands its total to its ancestors in the band above.

So rounds grow with the logarithm of the depth and rows with ``BAND`` times the nodes, whatever the shape of the trie.

A node's ancestors are read from one member's row of keys of the band, so no pointers are chased.  Conversations are
worked on in slices (of turn numbers, then of bands) whose sums are carried over, so one conversation with very
many turns is spread; a node with very many members or children is only ever added up.  The member list that
``ends_sha256`` digests is built in chunks of ``CHUNK`` ids, and the digest runs over sorted chunks as a stream.

Defined cases: a null turn comes first; rows that share a turn follow each other by the digest of role and text, equal rows
stay; null roles and texts are empty; rows without a conversation id belong to no conversation and are left out;
further columns are ignored; an empty table has no nodes, not even the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table, written

BAND = 32  # levels of a band
SLICE = 64  # turn numbers of a slice
CHUNK = 4096  # ids of a chunk of a member list
LENT = 3  # turns that a conversation takes over at most
HOSTS = 20  # every HOSTS-th conversation lends
SUM_BITS = 40
_WORD = r"[^\x20\x09-\x0D]+"


def _before(of: list[str], by: str, what: Column) -> Column:
    """Sum of ``what`` over the earlier rows."""
    return F.coalesce(F.sum(what).over(Window.partitionBy(*of).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))


def in_order(rows: DataFrame) -> DataFrame:
    """(c, slice, at, digest, words): turns with their place in their slice of the conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    said = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    turns = rows.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("c"), F.col("turn").cast("long").alias("turn"), said.alias("digest"), F.regexp_count(text, F.lit(_WORD)).cast("long").alias("words"))
    cut = turns.withColumn("slice", F.coalesce(F.floor(F.col("turn") / SLICE), F.lit(-(2**60))))
    place = F.row_number().over(Window.partitionBy("c", "slice").orderBy("turn", "digest")) - 1
    return written(cut.withColumn("at", place.cast("long")).drop("turn"), "turns")


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(c, pos, digest, words) turns from 1, and (c, length): conversations that begin with their host's turns."""
    turns = in_order(rows)
    sizes = turns.groupBy("c", "slice").agg(F.count(F.lit(1)).alias("n"))
    slices = written(sizes.withColumn("before", _before(["c"], "slice", F.col("n"))), "slices")
    ids = slices.groupBy("c").agg(F.sum("n").alias("n")).withColumn("h", F.crc32(F.col("c").cast("string").cast("binary")) % (LENT + 1)).withColumn("host", F.col("c") - F.col("c") % HOSTS)
    hosts = ids.select(F.col("c").alias("host"), F.col("n").alias("host_n"))
    lent = F.least(F.col("h"), F.coalesce("host_n", F.lit(0)))
    ids = written(ids.join(hosts, "host", "left").select("c", "host", "h", lent.alias("lent"), (lent + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "conversations")

    placed = turns.join(slices.join(ids, "c").select("c", "slice", "before", "h", "lent"), ["c", "slice"])
    index = F.col("at") + F.col("before")
    own = placed.where(index >= F.col("h")).select("c", (index - F.col("h") + F.col("lent") + 1).alias("pos"), "digest", "words")
    heads = placed.where((index < LENT) & (F.col("c") % HOSTS == 0)).select(F.col("c").alias("host"), index.alias("index"), "digest", "words")
    taken = heads.join(ids.where("lent > 0").select("c", "host", "lent"), "host").where("index < lent").select("c", (F.col("index") + 1).alias("pos"), "digest", "words")
    return own.unionByName(taken), ids.select("c", "length")


def chains(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """(c, pos, key, words, last): every prefix of every conversation, the empty one included, with its node's key."""
    sums = ["s0", "s1", "s2"]
    mixed = [F.pmod(F.xxhash64("digest", "pos", F.lit(i)), F.lit(1 << SUM_BITS)).alias(s) for i, s in enumerate(sums)]
    every = turns.select("c", "pos", "words", *mixed).unionByName(lengths.select("c", F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("words"), *[F.lit(0).cast("long").alias(s) for s in sums]))
    every = written(every.withColumn("band", F.floor(F.col("pos") / BAND)), "prefixes")
    parts = every.groupBy("c", "band").agg(*[F.sum(s).alias(s) for s in sums])
    carried = parts.select("c", "band", *[_before(["c"], "band", F.col(s)).alias(f"{s}_") for s in sums])
    inside = Window.partitionBy("c", "band").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    run = every.select("c", "band", "pos", "words", *[F.sum(s).over(inside).alias(s) for s in sums]).join(carried.join(lengths, "c"), ["c", "band"])
    key = F.unhex(F.md5(F.concat_ws(",", "pos", *[F.col(s) + F.col(f"{s}_") for s in sums]).cast("binary")))
    return written(run.select("c", "pos", key.alias("key"), "words", (F.col("pos") == F.col("length")).alias("last")), "chains")


def _bands(chain: DataFrame) -> DataFrame:
    """(c, band, keys): the keys of a band in order, the top of the next band included if the conversation reaches it."""
    band = F.floor(F.col("pos") / BAND)
    both = chain.select("c", "pos", "key", F.explode(F.when((F.col("pos") % BAND == 0) & (F.col("pos") > 0), F.array(band, band - 1)).otherwise(F.array(band))).alias("band"))
    rows = both.groupBy("c", "band").agg(F.sort_array(F.collect_list(F.struct("pos", "key"))).alias("keys"))  # BAND + 1 at most
    return rows.select("c", "band", F.transform("keys", lambda k: k.getField("key")).alias("keys"))


def rollup(nodes: DataFrame, chain: DataFrame, values: list[str], depth: int) -> DataFrame:
    """(key, values) summed over each node's subtree.

    ``nodes`` has key, c (a member), pos (its depth) and the values; ``chain`` (c, pos, key) holds the prefixes of
    at least those members; ``depth`` is the largest pos.
    """
    bands = written(_bands(chain), "bands")
    band = F.floor(F.col("pos") / BAND)
    total = [F.sum(v).alias(v) for v in values]
    found = nodes.withColumn("band", band).join(bands, ["c", "band"])
    upward = found.select(F.explode(F.slice("keys", F.lit(1), (F.col("pos") % BAND + 1).cast("int"))).alias("key"), *values)
    inside = written(upward.groupBy("key").agg(*total), "inside")
    if depth < BAND:
        return inside
    tops = written(nodes.where(F.col("pos") % BAND == 0).select("key", "c", (F.col("pos") / BAND).cast("long").alias("pos")).join(inside, "key"), "tops")
    above = written(chain.where(F.col("pos") % BAND == 0).select("c", (F.col("pos") / BAND).cast("long").alias("pos"), "key").join(tops.select("c").distinct(), "c", "left_semi"), "above")
    done = written(rollup(tops, above, values, depth // BAND), "done")
    hanging = tops.where("pos > 0").select("key", "c", (F.col("pos") - 1).alias("band")).join(done, "key").drop("key").join(bands, ["c", "band"])
    handed = hanging.select(F.explode(F.slice("keys", 1, BAND)).alias("key"), *values)
    rest = inside.join(tops.select("key"), "key", "left_anti")
    # tops above are complete already; what is handed to them is in their own totals
    more = handed.join(tops.select("key"), "key", "left_anti")
    return done.select("key", *values).unionByName(rest.unionByName(more).groupBy("key").agg(*total))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, chunk, ids) rows to (key, ends_sha256); one digest is open at a time."""
    open_key, digest = None, None
    for b in batches:
        keys, out = [], []
        for key, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
            if key == open_key:
                digest.update(b",")
            else:
                if open_key is not None:
                    keys.append(open_key)
                    out.append(digest.hexdigest())
                open_key, digest = key, hashlib.sha256()
            digest.update(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(out, pa.string())], names=["key", "ends_sha256"])
    if open_key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([open_key], pa.binary()), pa.array([digest.hexdigest()], pa.string())], names=["key", "ends_sha256"])


def trie(rows: DataFrame) -> DataFrame:
    """One row a node of the rebuilt conversations of (conv_id, turn, role, text) rows."""
    turns, lengths = rebuilt(rows)
    chain = chains(turns, lengths)
    nodes = written(chain.groupBy("key").agg(F.min("c").alias("c"), F.min("pos").alias("pos"), F.min("words").alias("words"), F.count(F.lit(1)).alias("n_convs")), "nodes")
    depth = nodes.agg(F.coalesce(F.max("pos"), F.lit(0))).first()[0]

    # the parent of a node is the prefix before it in any member
    member = chain.select("c", (F.col("pos") + 1).alias("pos"), F.col("key").alias("parent"))
    linked = written(nodes.join(member, ["c", "pos"], "left"), "linked")
    children = linked.where("parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    counted = written(linked.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "counted")
    valued = counted.select("key", "c", "pos", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    totals = rollup(valued, chain.select("c", "pos", "key").join(nodes.select("c").distinct(), "c", "left_semi"), ["n_leaves", "saved_tokens"], depth)

    lists = chain.where("last").groupBy("key", F.floor(F.col("c") / CHUNK).alias("chunk")).agg(F.array_join(F.sort_array(F.collect_list("c")).cast("array<string>"), ",").alias("ids"))
    ends = lists.repartition("key").sortWithinPartitions("key", "chunk").mapInArrow(_digests, "key binary, ends_sha256 string")
    up = counted.select(F.col("key").alias("parent"), F.col("c").alias("parent_conv_id"))
    return (counted.join(totals, "key").join(ends, "key", "left").join(up, "parent", "left")
            .select(F.col("c").alias("conv_id"), F.col("pos").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                    F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256")))


def q_op11(spark, sf_dir: str) -> DataFrame:
    """The trie of all conversations."""
    return trie(table(spark, sf_dir, "conversations"))


#: The same by lists of turns; the checksum of an id's digits is worked out bit by bit.
SQL = r"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS i,
             sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS g, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS w
           FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT c, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
          lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) ELSE xor(s >> 1, 3988292384 * (s & 1)) END), CAST(4294967295 AS BIGINT)) % 4 AS h FROM (SELECT DISTINCT c FROM t)),
r0 AS (SELECT ids.c, 0 AS part, t.i, g, w FROM ids JOIN t ON t.c = ids.c - ids.c % 20 AND t.i < ids.h UNION ALL SELECT ids.c, 1, t.i, g, w FROM ids JOIN t ON t.c = ids.c AND t.i >= ids.h),
r AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, i) AS d, g, w FROM r0),
l AS (SELECT ids.c, coalesce(max(r.d), 0) AS len FROM ids LEFT JOIN r ON ids.c = r.c GROUP BY ids.c),
pre AS (SELECT c, 0 AS d, '' AS k, '' AS pk, 0 AS w FROM ids UNION ALL
        SELECT c, d, string_agg(g, '') OVER (PARTITION BY c ORDER BY d), coalesce(string_agg(g, '') OVER (PARTITION BY c ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ''), w FROM r),
n AS (SELECT k, min(pk) AS pk, min(d) AS d, min(w) AS w, min(c) AS c, count(*) AS n FROM pre GROUP BY k),
kids AS (SELECT pk AS k, count(*) AS n FROM n WHERE d > 0 GROUP BY pk),
v AS (SELECT n.*, coalesce(kids.n, 0) AS kids FROM n LEFT JOIN kids USING (k)),
sub AS (SELECT a.k, sum(CASE WHEN b.kids = 0 THEN 1 ELSE 0 END) AS leaves, sum((b.n - 1) * b.w) AS saved FROM v AS a JOIN v AS b ON starts_with(b.k, a.k) GROUP BY a.k),
e AS (SELECT pre.k, sha256(string_agg(CAST(pre.c AS VARCHAR), ',' ORDER BY pre.c)) AS s FROM pre JOIN l ON pre.c = l.c AND pre.d = l.len GROUP BY pre.k)
SELECT v.c AS conv_id, CAST(v.d AS BIGINT) AS depth, p.c AS parent_conv_id, CAST(v.n AS BIGINT) AS n_convs, CAST(v.kids AS BIGINT) AS n_children, CAST(sub.leaves AS BIGINT) AS n_leaves,
       CAST(sub.saved AS BIGINT) AS saved_tokens, coalesce(e.s, sha256('')) AS ends_sha256
FROM v JOIN sub USING (k) LEFT JOIN v AS p ON v.d > 0 AND p.k = v.pk LEFT JOIN e ON e.k = v.k
"""
