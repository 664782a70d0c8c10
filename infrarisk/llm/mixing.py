"""Mixing sources to target weights by the cube method (operator 9).

Each source has a target number of words; a document of a source with ratio ``r`` = target / source size is
taken ``floor(r)`` times for sure and once more with probability ``r - floor(r)``.  Which documents get the
additional copy is decided by balanced sampling: inclusion probabilities move through the null space of the
constraints (number of documents, number of words) until all but a few of a block are 0 or 1, so both totals
keep their expected values.  Blocks hold at most ``BLOCK`` documents of one source; what they leave undecided
forms the blocks of the next level, until one block a source remains, whose last two documents are landed
by trying their roundings against the word total and turning single documents over.

Scale: blocks are salted by a hash of the document, so a hot source is many blocks; each level keeps ten
of ``BLOCK`` rows, so there are log(rows) / log(BLOCK / 10) levels.  Only numbers are shuffled, never texts.  Targets come
from a table of one row a source, by window sums over that table.

Defined cases: null texts have size 0; null sources are one source, sorted last; sources without words get target 0
and their documents are taken 0 words; documents without words are never repeated.  Where ids are null or repeat, rows
are spread by a row counter as well; a rerun over the same files agrees.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table, written

WEIGHTS = (5, 2, 1)
MOST = 3  # copies of a document, and of a source's size, at most
BLOCK = 512
MANY_SOURCES = 50_000  # a table of one row a source is broadcast up to this many
HELD = 8  # smallest documents of a block that stay open for the next level, so that the landing has a choice
WORD = r"[^\x20\x09-\x0D]+"
_EPS = 1e-9


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size) -> with ``target``: weight shares of the total, capped, the excess shared by weight again.

    Sharing the excess until none is above its cap ends at one common price: target = min(cap, price * weight),
    where exactly the sources of lowest cap / weight are capped.  So one ordered pass of running sums finds it.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.lit(0)
    for k, x in enumerate(weights):
        w = F.when(F.col("rank") % len(weights) == k, F.lit(x)).otherwise(w)
    ranked = sizes.withColumn("rank", F.row_number().over(by_name) - 1).withColumn("weight", w)
    ranked = ranked.withColumn("cap", F.lit(most) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("rank"))
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    priced = ranked.withColumn("price", left / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    # the first source (in this order) that its cap doesn't bind sets the price of all that follow
    free = F.first(F.when(F.col("cap") >= F.col("price") * F.col("weight"), F.col("price")), True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return priced.withColumn("free", free).select("source", "source_size", "rank", F.when(F.col("free").isNull(), F.col("cap").cast("double"))
                                                  .otherwise(F.least(F.col("cap").cast("double"), F.col("free") * F.col("weight"))).alias("target"))


def flight(p: np.ndarray, size: np.ndarray, draw) -> np.ndarray:
    """Moves probabilities to 0 or 1, at most two left over; sums of ``p`` and ``p * size`` stay as they are."""
    p = p.copy()
    todo = [i for i in range(len(p)) if _EPS < p[i] < 1 - _EPS]
    todo.reverse()  # the caller's order: large ones first
    live: list[int] = []
    while True:
        while todo and len(live) < 3:
            live.append(todo.pop())
        if len(live) == 3:
            a, b, c = (size[i] for i in live)
            u = [c - b, a - c, b - a]  # orthogonal to (1, 1, 1) and to the sizes
            if not any(u):
                u = [1.0, -1.0, 0.0]
        elif len(live) == 2 and size[live[0]] == size[live[1]]:
            u = [1.0, -1.0]
        else:
            return p
        up = min((1 - p[i]) / x if x > 0 else p[i] / -x for i, x in zip(live, u, strict=True) if x)
        down = min(p[i] / x if x > 0 else (1 - p[i]) / -x for i, x in zip(live, u, strict=True) if x)
        step = up if draw() * (up + down) < down else -down
        for i, x in zip(live, u, strict=True):
            p[i] = min(1.0, max(0.0, p[i] + step * x))
            if p[i] <= _EPS or p[i] >= 1 - _EPS:
                p[i] = round(p[i])
        live = [i for i in live if 0 < p[i] < 1]


def landing(p: np.ndarray, size: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Rounds the (few) undecided ones so that the word total moves least, then the number of documents.

    What error remains is reduced by turning one or two documents of the block over, as long as that helps;
    only documents whose probability was fractional (``start``) are turned, so none leaves its two counts.
    """
    left = np.flatnonzero((p > 0) & (p < 1))
    best = min(range(1 << len(left)), key=lambda m: (abs(sum(size[i] * ((m >> k & 1) - p[i]) for k, i in enumerate(left))),
                                                     abs(sum((m >> k & 1) - p[i] for k, i in enumerate(left))), m))
    p = p.copy()
    for k, i in enumerate(left):
        p[i] = best >> k & 1
    free = np.flatnonzero((start > 0) & (start < 1) & (size > 0))
    for _ in range(8):
        error = float((size * (p - start)).sum())
        if abs(error) < 1 or not len(free):
            break
        turn = np.append(size[free] * (1 - 2 * p[free]), 0.0)  # the last stands for no second document
        both = np.abs(error + turn[:, None] + turn[None, :])
        np.fill_diagonal(both, np.inf)
        i, j = np.unravel_index(int(both.argmin()), both.shape)
        if both[i, j] >= abs(error):
            break
        for k in (i, j):
            if k < len(free):
                p[free[k]] = 1 - p[free[k]]
    return p


def _block(level: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "key", "salt"], ascending=[False, True, True], kind="stable")
        size = rows["size"].to_numpy(float)
        rng = np.random.Generator(np.random.PCG64([level, int(rows["rank"].iloc[0]), int(rows["block"].iloc[0])]))
        start = rows["p"].to_numpy(float)
        if rows["blocks"].iloc[0] == 1:
            p = landing(flight(start, size, rng.random), size, start)
        else:
            moved = max(0, len(start) - HELD)
            p = np.concatenate([flight(start[:moved], size[:moved], rng.random), start[moved:]])
        return rows.assign(p=p)

    return run


def _levelled(rows: DataFrame, level: int) -> DataFrame:
    """One flight over all blocks of ``rows``; a source of one block is decided wholly."""
    blocks = rows.groupBy("rank").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    small = blocks.limit(MANY_SOURCES + 1).count() <= MANY_SOURCES  # then rows stay where they are; else the join deals them out
    dealt = rows.drop("blocks", "block").join(F.broadcast(blocks) if small else blocks, "rank").withColumn("block", F.pmod(F.xxhash64("key", "salt", F.lit(level)), "blocks").cast("int"))
    return written(dealt.groupBy("rank", "block").applyInPandas(_block(level), dealt.schema), "flight")


def copies(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(key, salt, source, size) -> the same with ``source_size``, ``target`` and ``copies``; one row for each row."""
    sizes = written(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "targets")
    rows = sized.join(sizes, sized["source"].eqNullSafe(sizes["source"])).drop(sizes["source"])
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    sure = F.floor(ratio + F.lit(_EPS)).cast("long")
    rows = rows.withColumn("sure", sure).withColumn("p", F.greatest(F.lit(0.0), ratio - sure)).withColumn("p", F.when(F.col("p") < _EPS, 0.0).otherwise(F.col("p")))
    rows = rows.withColumn("p", F.when(F.col("size") == 0, F.lit(0.0)).otherwise(F.col("p")))
    open_ = rows.where("p > 0")
    done = [rows.where("p = 0").drop("blocks", "block")]
    level = 0
    while True:
        now = _levelled(open_, level)
        done.append(now.where("p = 0 OR p = 1").drop("blocks", "block"))
        open_ = now.where("p > 0 AND p < 1")
        level += 1
        if open_.isEmpty():
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.withColumn("copies", F.col("sure") + F.col("p").cast("long")).drop("p", "sure", "rank")


def sized(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, bool]:
    """((key, salt, id, source, size) of each document, unique): ``key`` is the id where ids are unique, else a hash of the row."""
    ident = F.col(f"`{id_col}`").cast("long")
    n, ids = docs.agg(F.count(F.lit(1)), F.countDistinct(ident)).first()
    unique = n == ids
    key = ident if unique else F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    salt = F.lit(0).cast("long") if unique else F.monotonically_increasing_id()
    size = F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))
    return written(docs.select(key.alias("key"), salt.alias("salt"), ident.alias("id"), F.col(f"`{source}`").alias("source"), size.alias("size")), "sizes"), unique


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc id, source, ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` of each document."""
    c = copies(sized(docs, id_col, text, source)[0])
    return c.select(F.col("id").alias(id_col), F.col("source").alias(source), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mixed corpus itself: each document as often as it is taken, with its columns as they were.

    Rows that are equal in all columns share their copies: the first gets all of them.
    """
    cols, (s, unique) = docs.columns, sized(docs, id_col, text, source)
    c = copies(s).groupBy("key").agg(F.sum("copies").alias("n"), F.count(F.lit(1)).alias("rows"))
    key = F.col(f"`{id_col}`").cast("long") if unique else F.xxhash64(*[F.col(f"`{x}`") for x in cols])
    keyed = docs.select(key.alias("key"), F.struct(*[F.col(f"`{x}`") for x in cols]).alias("row"))
    if not unique:
        keyed = keyed.dropDuplicates(["key"])
    return keyed.join(c.where("n > 0"), "key").select("row", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select(*[F.col("row").getField(x).alias(x) for x in cols])


def q_op9(spark, sf_dir: str) -> DataFrame:
    """Words taken of every document."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
