"""Balanced forests of many targets and row ranges, grown level by level, one Spark job a level for all of them.

Rows are the matrices of ``newton.packed``.  A numeric feature is cut into at most ``BINS`` bins at quantiles of its range; the city is
one yes/no feature a bucket.  A node tries as many features as the square root of their number, drawn at random.  A
row is in one bucket only, so the counts of all buckets of a node are one count a row, and a row takes bytes, not a
binned number for each bucket, for all forests together.  Tasks add up class counts of (tree, node, tried feature, bin); a
forest's counts meet in a task of their own, which picks the splits by the largest decrease of the weighted Gini
impurity.  The driver holds the trees.

With ``bootstrap`` a tree counts a row Poisson(1) times, by a hash of the row and the tree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BINS = 32
PIECE_ROWS = 8_192
NEVER = 1000  # above any bin or bucket: no row goes right
DRAWN = np.searchsorted(np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)]) * 65536, np.arange(65536), side="right").astype(np.float64)


@dataclass
class Forest:
    """One forest: rows of blocks up to ``last``, the ``target``-th label.  A row goes right where lo < bin <= hi."""

    last: int
    target: int
    class_weights: tuple[float, float]
    medians: np.ndarray
    edges: list[np.ndarray]
    bootstrap: bool
    least: int
    trees: int
    depth: int
    seed: int
    splits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)  # a level's (feature, lo, hi), each trees x nodes
    values: np.ndarray | None = None  # trees x leaves: weighted share of positives


def binned(x: np.ndarray, bucket: np.ndarray, medians: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Features x rows: bins, missing ones as the median's, then the bucket."""
    out = np.empty((len(x) + 1, len(bucket)), np.int16)
    for k, own in enumerate(edges):
        out[k] = np.searchsorted(own, np.where(np.isnan(x[k]), medians[k], x[k]), side="left")
    out[-1] = bucket
    return out


def nodes(splits: list, tree: int, flat: np.ndarray, here: np.ndarray) -> np.ndarray:
    """Each row's node (from 0) in the level below the ``splits``."""
    at = np.zeros(len(here), np.int64)
    for col, lo, hi in splits:
        v = flat[col[tree][at] * len(here) + here]
        at = 2 * at + ((v > lo[tree][at]) & (v <= hi[tree][at]))
    return at


def drawn(row: np.ndarray, seed: int) -> np.ndarray:
    """How many times a tree counts each row."""
    h = row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 0xD1342543DE82EF95 % 2**64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return DRAWN[(h >> np.uint64(48)).astype(np.int64)]


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        for block, n, bucket, y, x, row in zip(*(b.column(k) for k in range(6)), strict=True):
            n = n.as_py()
            yield (block.as_py(), n, np.frombuffer(bucket.as_buffer(), "<i4"), np.frombuffer(y.as_buffer(), "i1").reshape(-1, n),
                   np.frombuffer(x.as_buffer(), "<f8").reshape(-1, n), np.frombuffer(row.as_buffer(), "<i8"))


def _counts(forests: list[Forest], picks: list[tuple[np.ndarray, np.ndarray]], width: int):
    """Task of a level: (forest, counts) of its rows."""
    ranges: dict[int, list[int]] = {}
    for k, g in enumerate(forests):
        ranges.setdefault(g.last, []).append(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for block, n, bucket, y, x, row in _matrices(batches):
            for last, group in ranges.items():
                if block > last:
                    continue
                for lo in range(0, n, PIECE_ROWS):
                    part = slice(lo, lo + PIECE_ROWS)
                    own = bucket[part].astype(np.int64)
                    here, flat = np.arange(len(own)), binned(x[:, part], own, forests[group[0]].medians, forests[group[0]].edges).ravel()
                    for tree in range(max(forests[k].trees for k in group)):
                        times = None
                        for k in group:
                            g, (slots, cities) = forests[k], picks[k]
                            if tree >= g.trees:
                                continue
                            count, tried = slots.shape[1:]
                            if k not in sums:
                                sums[k] = np.zeros((g.trees, count, 2)), np.zeros((g.trees, count, tried, BINS, 2)), np.zeros((g.trees, count, cities.shape[2], 2))
                            total, numeric, city = sums[k]
                            if g.bootstrap and times is None:
                                times = drawn(row[part], g.seed * 1009 + tree)
                            w = times if g.bootstrap else None
                            at, label = nodes(g.splits, tree, flat, here), y[g.target, part].astype(np.int64)
                            found = np.bincount((at * width + own) * 2 + label, w, count * width * 2).reshape(count, width, 2)
                            total[tree] += np.bincount(at * 2 + label, w, count * 2).reshape(count, 2)
                            city[tree] += np.take_along_axis(found, np.maximum(cities[tree], 0)[:, :, None], 1)
                            for s in range(tried):
                                col = slots[tree, :, s][at]
                                have = np.flatnonzero(col >= 0)
                                if len(have):
                                    v = flat[col[have] * len(here) + have]
                                    numeric[tree, :, s] += np.bincount((at[have] * BINS + v) * 2 + label[have], w[have] if w is not None else None, count * BINS * 2).reshape(count, BINS, 2)
        for k, (total, numeric, city) in sums.items():
            counts = np.concatenate([total.ravel(), numeric[picks[k][0] >= 0].ravel(), city.ravel()])  # not of unused places
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([counts.astype("<f8" if counts.max() > 2**31 else "<i4").tobytes()], pa.binary())], names=["forest", "counts"])

    return run


def _picked(forests: list[Forest], picks: list[tuple[np.ndarray, np.ndarray]], features: int):
    """Task that adds up its forests' counts: (forest, splits), splits being feature, lo, hi, own value and the children's, a node each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, counts in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                size = picks[k][0].shape[0] * picks[k][0].shape[1] * 2 + int((picks[k][0] >= 0).sum()) * BINS * 2 + picks[k][1].size * 2
                part = np.frombuffer(counts.as_buffer(), "<i4" if len(counts.as_buffer()) == 4 * size else "<f8").astype(np.float64)
                sums[k] = sums[k] + part if k in sums else part
        for k, flat in sums.items():
            g, (slots, cities) = forests[k], picks[k]
            shape = slots.shape[:2]
            total, used, city = np.split(flat, np.cumsum([shape[0] * shape[1] * 2, int((slots >= 0).sum()) * BINS * 2]))
            total, numeric, city = total.reshape(*shape, 2), np.zeros((*slots.shape, BINS, 2)), city.reshape(*cities.shape, 2)
            numeric[slots >= 0] = used.reshape(-1, BINS, 2)
            upto = numeric.cumsum(3)[:, :, :, :-1]  # rows that a cut after the bin leaves on the left
            left = np.concatenate([np.where(slots[..., None, None] >= 0, upto, 0).reshape(*shape, -1, 2), np.where(cities[..., None] >= 0, total[:, :, None] - city, 0)], 2)
            right = total[:, :, None] - left
            weight = np.array([g.class_weights[1], g.class_weights[0]])  # of label 0, of label 1

            def purity(c):
                c = c * weight
                return (c**2).sum(-1) / np.maximum(c.sum(-1), 1e-300)

            gain = purity(left) + purity(right) - purity(total)[..., None]
            gain[(left.sum(-1) < g.least) | (right.sum(-1) < g.least)] = -1.0
            best = gain.argmax(2)
            at = np.take_along_axis(gain, best[..., None], 2)[..., 0]
            good = at > 1e-12 * purity(total)
            cuts = slots.shape[2] * (BINS - 1)
            slot, cut, c = np.minimum(best // (BINS - 1), slots.shape[2] - 1), best % (BINS - 1), np.clip(best - cuts, 0, None)
            numeric_col = np.take_along_axis(slots, slot[..., None], 2)[..., 0]
            bucket = np.take_along_axis(cities, c[..., None], 2)[..., 0]
            is_cut = best < cuts
            col = np.where(good & is_cut, numeric_col, np.where(good, features, 0))
            lo = np.where(good, np.where(is_cut, cut, bucket - 1), NEVER)
            hi = np.where(good & ~is_cut, bucket, NEVER)
            share = lambda v: (v * weight)[..., 1] / np.maximum((v * weight).sum(-1), 1e-300)
            child = [share(np.take_along_axis(v, best[..., None, None].repeat(2, 3), 2)[:, :, 0]) for v in (left, right)]
            out = np.stack([col, lo, hi, share(total), *child]).astype("<f8")
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([out.tobytes()], pa.binary())], names=["forest", "splits"])

    return run


def grow(rows: DataFrame, forests: list[Forest], features: int, width: int) -> None:
    """Fills the forests' splits and leaves from the ``packed`` rows."""
    tried = math.ceil(math.sqrt(features + width))
    alive = [np.ones((g.trees, 1), bool) for g in forests]
    for level in range(max((g.depth for g in forests), default=0)):
        now = [k for k, g in enumerate(forests) if g.depth > level and alive[k].any()]
        picks = []
        for k in now:
            g, rng = forests[k], np.random.default_rng([forests[k].seed, k, level])
            own = np.sort(np.argpartition(rng.random((g.trees, 2**level, features + width)), tried - 1, axis=2)[..., :tried], axis=2)
            own[~alive[k]] = -1
            most = max(1, int(((own >= 0) & (own < features)).sum(2).max()))
            picks.append((np.where(own < features, own, -1)[..., :most], np.where(own >= features, own - features, -1)))
        if now:
            part = [forests[k] for k in now]
            counts = rows.mapInArrow(_counts(part, picks, width), "forest int, counts binary")
            made = {r["forest"]: np.frombuffer(r["splits"], "<f8") for r in counts.repartition(len(now), "forest").mapInArrow(_picked(part, picks, features), "forest int, splits binary").collect()}  # one row a forest
        for k, g in enumerate(forests):
            if g.depth <= level:
                continue
            if k in now:
                col, lo, hi, own, left, right = made[now.index(k)].reshape(6, g.trees, 2**level)
                split = (lo < NEVER) & alive[k]
                lo = np.where(split, lo, NEVER)
                value = own if g.values is None else g.values
            else:
                value = g.values
                col, split = np.zeros_like(value), np.zeros(value.shape, bool)
                lo = hi = left = right = np.full(value.shape, float(NEVER))
            g.splits.append((col.astype(np.int64), lo.astype(np.int16), hi.astype(np.int16)))
            g.values = np.stack([np.where(split, left, value), np.where(split, right, value)], 2).reshape(g.trees, -1)
            alive[k] = np.repeat(split, 2, axis=1)


def score(rows: DataFrame, asked: list[tuple[int, Forest, int, int]]) -> DataFrame:
    """(asked, y, p) of rows lo <= row < hi under a forest, for each numbered ``(no, forest, lo, hi)``: the mean of its trees' leaves."""
    sent = rows.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, n, bucket, y, x, row in _matrices(batches):
            for start in range(0, n, PIECE_ROWS):
                part = slice(start, start + PIECE_ROWS)
                known: dict[tuple[int, int, int], tuple[np.ndarray, np.ndarray]] = {}
                for no, g, lo, hi in sent.value:
                    if (g.last, lo, hi) not in known:
                        at = np.flatnonzero((row[part] >= lo) & (row[part] < hi))
                        known[g.last, lo, hi] = at, binned(x[:, part][:, at], bucket[part][at], g.medians, g.edges).ravel()
                    at, flat = known[g.last, lo, hi]
                    if len(at):
                        here = np.arange(len(at))
                        p = sum(g.values[t][nodes(g.splits, t, flat, here)] for t in range(g.trees)) / g.trees
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), no), pa.int32()), pa.array(y[g.target, part][at].astype(np.int32)), pa.array(p)], names=["asked", "y", "p"])

    return rows.mapInArrow(run, "asked int, y int, p double")
