"""Newton's method for many class-weighted logistic fits over shared rows, one Spark job a pass for all of them.

A fit has a weight for each feature, an intercept, and a weight for each of a fixed number of city buckets.  A row is in one
bucket only, so the second derivatives are a small dense block (features and intercept), a diagonal (buckets) and the sums that
connect them: a pass adds up features + 1 numbers a bucket and fit, and the step is solved exactly by eliminating the
buckets.  Sums and steps of a fit are made in a task of their own; the driver holds the weights of the group.

Steps are full unless the objective says otherwise (then half of it, from the last good point), so each fit ends at the
optimum of its strictly convex objective; the decrease that a step foresees says when it is there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PACK_ROWS = 65_536  # rows of a matrix
PIECE_ROWS = 8_192  # of it worked on at a time
LEAST_TASK_ROWS = 16_384
MOST_TASK_ROWS = 500_000


@dataclass
class Problem:
    """One fit: rows of blocks up to ``last``, the ``target``-th label; weights to start from."""

    last: int
    target: int
    rows: int
    class_weights: tuple[float, float]
    l2: float
    pre: tuple[np.ndarray, np.ndarray, np.ndarray]  # medians, means, deviations
    weights: np.ndarray
    bias: float


def packed(rows: DataFrame, targets: int, features: int, n: int | None = None) -> DataFrame:
    """(block, n, bucket, y, x, row): rows (block, bucket, y..., x..., and ``row`` if there) as matrices of a block each, in the order of buckets; stored."""
    def cut(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        block, bucket, row = t["block"].to_numpy(), t["bucket"].to_numpy(), t["row"].to_numpy()
        y = np.stack([t[f"y{k}"].to_numpy() == 1 for k in range(targets)])
        x = np.stack([t[f"x{k}"].to_numpy() for k in range(features)])  # null is NaN
        order = np.lexsort((bucket, block))
        bounds = [0, *(np.flatnonzero(np.diff(block[order])) + 1).tolist(), len(order)]
        for lo, hi in zip(bounds, bounds[1:]):
            at = order[lo:hi]
            yield pa.RecordBatch.from_pydict({"block": pa.array([block[at[0]]], pa.int32()), "n": pa.array([len(at)], pa.int32()),
                                              **{c: pa.array([v.tobytes()], pa.binary()) for c, v in (("bucket", bucket[at].astype("<i4")), ("y", y[:, at].astype("i1")), ("x", x[:, at].astype("<f8")), ("row", row[at].astype("<i8")))}})

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(h.num_rows for h in held) >= PACK_ROWS:
                yield from cut(held)
                held = []
        if sum(h.num_rows for h in held):
            yield from cut(held)

    wanted = rows.select("block", "bucket", *[f"y{k}" for k in range(targets)], *[f"x{k}" for k in range(features)], F.col("row").cast("long") if "row" in rows.columns else F.lit(0).cast("long").alias("row"))
    # small data in few tasks, so that starting them isn't what a pass costs; large data in whole waves of equal tasks of a bounded size
    n, cores = rows.count() if n is None else n, rows.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(cores, -(-n // LEAST_TASK_ROWS))) if n <= cores * MOST_TASK_ROWS else cores * -(-n // (cores * MOST_TASK_ROWS))
    dealt = wanted.repartition(tasks, "row") if "row" in rows.columns else wanted.repartition(tasks)
    return dealt.mapInArrow(pack, "block int, n int, bucket binary, y binary, x binary, row binary").persist(StorageLevel.MEMORY_AND_DISK)


def _sums(problems: list[tuple[int, Problem]], width: int):
    """Task of a pass: (fit, sums) of its rows, sums being loss, gradient and second derivatives as one array of numbers."""
    ranges: dict[int, list[tuple[int, Problem]]] = {}
    for no, p in problems:
        ranges.setdefault(p.last, []).append((no, p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[np.ndarray, ...]] = {}
        for b in batches:
            for block, n, bucket, y, x in zip(*(b.column(k) for k in range(5)), strict=True):
                block, n = block.as_py(), n.as_py()
                bucket, y = np.frombuffer(bucket.as_buffer(), "<i4"), np.frombuffer(y.as_buffer(), "i1").reshape(-1, n)
                x = np.frombuffer(x.as_buffer(), "<f8").reshape(-1, n)
                f = len(x)
                for last, fits in ranges.items():
                    if block > last:
                        continue
                    med, mean, std = (v[:, None] for v in fits[0][1].pre)
                    for lo in range(0, n, PIECE_ROWS):
                        part, at = x[:, lo : lo + PIECE_ROWS], bucket[lo : lo + PIECE_ROWS]
                        z = np.ones((f + 1, len(at)))  # features, then the intercept's 1
                        z[:f] = (np.where(np.isnan(part), med, part) - mean) / std
                        starts = np.flatnonzero(np.diff(at, prepend=-1))
                        own = at[starts]  # buckets of the piece, each once
                        logits = np.stack([np.append(p.weights[:f], p.bias) for _, p in fits]) @ z
                        for (no, p), logit in zip(fits, logits, strict=True):
                            if no not in sums:
                                sums[no] = np.zeros(1), np.zeros(f + 1), np.zeros((f + 1, f + 1)), np.zeros(width), np.zeros((f + 1, width))
                            loss, ga, a, gb, c = sums[no]
                            pos = y[p.target, lo : lo + PIECE_ROWS] == 1
                            w = np.where(pos, *p.class_weights)
                            logit = logit + p.weights[f:][at]
                            small = np.exp(-np.abs(logit))
                            loss += w @ (np.log1p(small) + np.maximum(np.where(pos, -logit, logit), 0))
                            prob = np.where(logit >= 0, 1.0, small) / (1 + small)
                            rest = w * (prob - pos)
                            curved = z * (w * small / (1 + small) ** 2)
                            ga += z @ rest
                            a += z @ curved.T
                            gb[own] += np.add.reduceat(rest, starts)
                            c[:, own] += np.add.reduceat(curved, starts, axis=1)
        for no, parts in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([no], pa.int32()), pa.array([np.concatenate([v.ravel() for v in parts]).tobytes()], pa.binary())], names=["fit", "sums"])

    return run


def _steps(problems: list[tuple[int, Problem]], width: int):
    """Task that adds up the sums of its fits: (fit, objective, foreseen decrease, step)."""
    of = dict(problems)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for no, sums in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                part = np.frombuffer(sums.as_buffer(), "<f8")
                if no in total:
                    total[no] += part
                else:
                    total[no] = part.copy()
        for no, s in total.items():
            p = of[no]
            f = len(p.weights) - width
            s = s / p.rows
            loss, ga, a, gb, c = np.split(s, np.cumsum([1, f + 1, (f + 1) ** 2, width]))
            a, c = a.reshape(f + 1, f + 1), c.reshape(f + 1, width)
            wa, wb = p.weights[:f], p.weights[f:]
            objective = float(loss[0] + p.l2 / 2 * (wa @ wa + wb @ wb))
            ga, gb = ga + p.l2 * np.append(wa, 0.0), gb + p.l2 * wb
            a = a + p.l2 * np.diag(np.append(np.ones(f), 0.0))
            d = c[f] + p.l2  # a bucket's own second derivative: the intercept's sum of its rows
            d = np.where(d > 0, d, 1.0)
            da = -np.linalg.lstsq(a - (c / d) @ c.T, ga - c @ (gb / d), rcond=None)[0]
            db = -(gb + da @ c) / d
            ahead = -float(ga @ da + gb @ db)
            yield pa.RecordBatch.from_arrays([pa.array([no], pa.int32()), pa.array([objective]), pa.array([ahead]), pa.array([np.concatenate([da, db]).tobytes()], pa.binary())], names=["fit", "objective", "ahead", "step"])

    return run


def newton(rows: DataFrame, problems: list[Problem], width: int, tolerance: float, most: int) -> list[tuple[np.ndarray, float, int, bool]]:
    """(weights, bias, iterations, converged) of each problem, all over the ``packed`` rows."""
    f = len(problems[0].weights) - width
    point = [np.concatenate([p.weights[:f], [p.bias], p.weights[f:]]) for p in problems]  # as a step has them
    good: dict[int, tuple[float, np.ndarray, float, np.ndarray, float]] = {}  # objective, point, foreseen decrease, step, share of it taken
    steps, open_ = [0] * len(problems), set(range(len(problems)))
    converged = [False] * len(problems)
    while open_:
        now = []
        for k in sorted(open_):
            p, at = problems[k], point[k]
            now.append((k, Problem(p.last, p.target, p.rows, p.class_weights, p.l2, p.pre, np.concatenate([at[:f], at[f + 1 :]]), float(at[f]))))
        sums = rows.mapInArrow(_sums(now, width), "fit int, sums binary")
        solved = sums.repartition(len(now), "fit").mapInArrow(_steps(now, width), "fit int, objective double, ahead double, step binary").collect()  # one row a fit
        for r in solved:
            k, step = r["fit"], np.frombuffer(r["step"], "<f8")
            steps[k] += 1
            if k in good:
                objective, at, ahead, its, share = good[k]
                if not r["objective"] <= objective - 1e-4 * share * ahead + 1e-12 * abs(objective):
                    if steps[k] >= most or share < 1e-9:
                        point[k] = at
                        open_.discard(k)
                        continue
                    good[k] = objective, at, ahead, its, share / 2
                    point[k] = at + share / 2 * its
                    continue
            good[k] = r["objective"], point[k], r["ahead"], step, 1.0
            # a step of d lowers the objective by some ahead / 2; near the optimum what is left after it is of that number's square
            done = math.isfinite(r["ahead"]) and r["ahead"] / 2 <= tolerance * max(abs(r["objective"]), 1e-12)
            point[k] = point[k] + step
            if done or steps[k] >= most:
                converged[k] = done
                open_.discard(k)
        if missing := open_ - {r["fit"] for r in solved}:
            raise ValueError(f"no rows for fits {sorted(missing)}")
    return [(np.concatenate([v[:f], v[f + 1 :]]), float(v[f]), n, c) for v, n, c in zip(point, steps, converged, strict=True)]
