"""Many class-weighted logistic fits at once (L1 in bulk).

A training run or backtest needs the same fit over nested row ranges: targets x configurations x folds x windows.  A
range is the rows before its end in chronological order.  Rows are stored once (``data``); preprocessing (medians, means,
deviations) is computed once a range, for all ranges together.  The objective is the one of ``train.fit_logistic``:

    (1/n) sum w_i loss_i + l2/2 |weights|^2,  w = n / (2 positives) or n / (2 negatives), intercept unpenalised.

MLlib's solver runs a Spark job for each of the hundreds of L-BFGS iterations of each fit, and the jobs are what time goes into.
Here a pass over the rows is one job for a group of fits (``newton.py``): it adds up each fit's loss, gradient and
second derivatives, and a Newton step from them takes a fit to the optimum within some passes.  ``train.fit_logistic`` is the
same fit on MLlib, which the tests compare.

The city is one-hot over ``CITY_WIDTH`` hash buckets, a fixed number: coefficients, gradients and what scoring
broadcasts do not grow with the number of cities.  Cities that share a bucket share a weight; buckets without
training rows keep weight 0.  Each fit says whether it converged (``report``); none is cut off silently.
"""

from __future__ import annotations

from collections.abc import Hashable, Iterator
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import edge_slice
from ..operators import stats as ST
from ..operators.infer import LinearModel
from ..schema import MODEL_NUMERIC_FEATURES, TARGET_COLUMNS
from ..session import dropped, written
from .newton import Problem, newton, packed

CITY_WIDTH = 4096
TOLERANCE = 1e-6  # relative decrease of the objective at which a fit has converged
MOST_ITERATIONS = 1000  # a fit that needs more is reported as not converged
FITS_AT_ONCE = 8
MODELS_AT_ONCE = 32  # of a pass; a task holds some 1 MB of sums for each


@dataclass(frozen=True)
class Job:
    """One model: ``target`` on rows before ``end`` with penalty ``l2``; ``key`` names it."""

    key: Hashable
    target: str
    end: int
    l2: float


@dataclass
class Weights:
    """What a fit ends with: weights of features, then of city buckets."""

    coefficients: np.ndarray
    intercept: float
    iterations: int
    converged: bool


def city_bucket(city: Column, width: int = CITY_WIDTH) -> Column:
    return F.pmod(F.xxhash64(city), F.lit(width)).cast("int")


def one_hot(spark: SparkSession, width: int):
    """Encoder of a bucket column; fitted on the bucket numbers themselves, not on data."""
    buckets = spark.range(width).select(F.col("id").cast("double").alias("bucket"))
    return OneHotEncoder(inputCols=["bucket"], outputCols=["city_vec"], dropLast=False).fit(buckets)


def in_threads(work, items: list, at_once: int = FITS_AT_ONCE) -> list:
    """``work`` of each item, a few Spark jobs at a time; results in order."""
    if not items:
        return []
    pool = ThreadPool(min(at_once, len(items)))
    try:
        return pool.map(inheritable_thread_target(work), items, chunksize=1)
    finally:
        pool.terminate()


class Ranges:
    """Standardised vectors of row ranges of ``indexed`` (city, features, targets, ``idx``)."""

    def __init__(self, indexed: DataFrame, ends: list[int], targets: list[str] = TARGET_COLUMNS, features: list[str] = MODEL_NUMERIC_FEATURES, idx: str = "row_idx", width: int = CITY_WIDTH):
        self.spark, self.targets, self.features, self.width = indexed.sparkSession, targets, features, width
        self.ends = sorted(set(ends))
        city = F.coalesce(F.col("city").cast("string"), F.lit("UNKNOWN"))
        data = indexed.select(
            F.col(idx).cast("long").alias("row"), city.alias("city"), city_bucket(city, width).alias("bucket"), *[F.col(t).cast("int").alias(f"y{k}") for k, t in enumerate(targets)],
            *[F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(features)], edge_slice(F.col(idx), self.ends[:-1]).alias("block"))
        self.data = written(data, "ranges")
        self.encoder = one_hot(self.spark, width)
        self._prepare()

    def _prepare(self) -> None:
        """Per range: rows, positives, medians, means, deviations (one row a block on the driver).

        Blocks lie between neighbouring ends, so a range is the first of them: each row is read once for all its ranges, and
        what blocks know (counts, means, sums of squares) adds up.
        """
        cols, ys = [f"x{k}" for k in range(len(self.features))], [f"y{k}" for k in range(len(self.targets))]
        blocks = self.blocks()
        med = np.zeros((len(self.ends), len(cols)))
        for r in ST.prefix_medians(blocks, "block", len(self.ends), cols).collect():
            med[:, int(r["feature"][1:])] = [0.0 if m is None else m for m in r["medians"]]
        valid = [F.when(~F.isnan(c), F.col(c)) for c in cols]
        got = blocks.groupBy("block").agg(F.count(F.lit(1)).alias("n"), *[F.array(*[F.coalesce(f(v).cast("double"), F.lit(0.0)) for v in valid]).alias(name) for name, f in (("seen", F.count), ("mean", F.avg), ("var", F.var_pop))],
                                          F.array(*[F.coalesce(F.sum(y), F.lit(0)) for y in ys]).alias("pos")).collect()
        n, pos = np.zeros(len(self.ends), np.int64), np.zeros((len(self.ends), len(ys)), np.int64)
        seen, mean, var = (np.zeros((len(self.ends), len(cols))) for _ in range(3))
        for r in got:
            k = r["block"]
            n[k], pos[k], seen[k], mean[k], var[k] = r["n"], r["pos"], r["seen"], r["mean"], r["var"]
        zeros = np.zeros(len(cols))
        self.pre, self.count, self.positives = {}, {}, {}
        for k, e in enumerate(self.ends):
            rows, s, m = int(n[: k + 1].sum()), seen[: k + 1], mean[: k + 1]
            self.count[e], self.positives[e] = rows, pos[: k + 1].sum(0).tolist()
            self.pre[e] = (med[k], zeros, zeros + 1)
            if rows:
                known = s.sum(0)
                own = (s * m).sum(0) / np.maximum(known, 1)  # mean of what is there
                whole = (known * own + (rows - known) * med[k]) / rows
                squares = (s * (var[: k + 1] + (m - own) ** 2)).sum(0) + known * (own - whole) ** 2 + (rows - known) * (med[k] - whole) ** 2
                std = np.sqrt(squares / rows)
                self.pre[e] = (med[k], whole, np.where(std > 1e-9, std, 1.0))

    def blocks(self) -> DataFrame:
        """Rows of any range; ``block`` is the number of ends up to the row."""
        return self.data.where(F.col("row") < (self.ends[-1] if self.ends else 0))

    def both_classes(self, target: str, end: int) -> bool:
        return 0 < self.positives[end][self.targets.index(target)] < self.count[end]

    def vectors(self, end: int, rows: DataFrame | None = None) -> DataFrame:
        """(row, y..., features) of the range's rows (or of ``rows`` of the data) as the range's models see them.

        Without the names of the vector's thousands of slots, which every job of every fit would carry.
        """
        med, mean, std = (x.tolist() for x in self.pre[end])
        fill = lambda k: F.coalesce(F.when(~F.isnan(f"x{k}"), F.col(f"x{k}")), F.lit(med[k]))
        z = [((fill(k) - F.lit(mean[k])) / F.lit(std[k])).alias(f"z{k}") for k in range(len(self.features))]
        ys = [f"y{k}" for k in range(len(self.targets))]
        coded = self.encoder.transform((self.data.where(F.col("row") < end) if rows is None else rows).withColumn("bucket", F.col("bucket").cast("double")))
        wide = coded.select("row", *ys, "city_vec", *z)
        return VectorAssembler(inputCols=[f"z{k}" for k in range(len(z))] + ["city_vec"], outputCol="features").transform(wide).select("row", *ys, F.col("features").alias("features", metadata={}))

    def labelled(self, vectors: DataFrame, target: str, end: int) -> DataFrame:
        """Adds the target's ``label`` and balanced class weight ``w``."""
        y, (up, down) = self.targets.index(target), self.class_weights(target, end)
        return vectors.select("row", "features", F.col(f"y{y}").cast("double").alias("label"), F.when(F.col(f"y{y}") == 1, F.lit(up)).otherwise(F.lit(down)).alias("w"))

    def class_weights(self, target: str, end: int) -> tuple[float, float]:
        """Balanced weights of a positive and of another row."""
        n = self.count[end]
        pos = max(1, self.positives[end][self.targets.index(target)])
        return n / (2 * pos), n / (2 * max(1, n - pos))

    def close(self) -> None:
        dropped(self.data)


class Fits(Ranges):
    """Fitted models of ``jobs`` over ``indexed``; ranges in which a target has one class only give no model.

    ``ends`` names further ranges that jobs added later (``more``) will use.
    """

    def __init__(self, indexed: DataFrame, jobs: list[Job], targets: list[str] = TARGET_COLUMNS, features: list[str] = MODEL_NUMERIC_FEATURES, idx: str = "row_idx", width: int = CITY_WIDTH, ends: tuple[int, ...] = ()):
        super().__init__(indexed, [*ends, *(j.end for j in jobs)], targets, features, idx, width)
        # one row a city, with the first row that it occurs in; models read it after the rows are gone
        self.cities = written(self.data.groupBy("city", "bucket").agg(F.min("row").alias("first_row")), "cities")
        self.jobs: list[Job] = []
        self.weights: dict[int, Weights] = {}
        self.packed: DataFrame | None = None
        self.more(jobs)

    def more(self, jobs: list[Job]) -> dict[Hashable, int]:
        """Fits further jobs over the prepared ranges, a group of fits at a time; the number of each of all jobs, by key.

        Shorter ranges come first, and a fit starts where the target's fit on the nearest range so far has ended.
        """
        first = len(self.jobs)
        self.jobs += jobs
        asked = sorted((k for k in range(first, len(self.jobs)) if self.both_classes(self.jobs[k].target, self.jobs[k].end)), key=lambda k: self.jobs[k].end)
        for at in range(0, len(asked), MODELS_AT_ONCE):
            group = asked[at : at + MODELS_AT_ONCE]
            done = newton(self.matrices(), [self._problem(k) for k in group], self.width, TOLERANCE, MOST_ITERATIONS)
            for k, (w, bias, steps, converged) in zip(group, done, strict=True):
                self.weights[k] = Weights(w, bias, steps, converged)
        return {j.key: k for k, j in enumerate(self.jobs)}

    def matrices(self) -> DataFrame:
        """The rows of all ranges as passes read them."""
        if self.packed is None:
            self.packed = packed(self.blocks(), len(self.targets), len(self.features), self.count[self.ends[-1]] if self.ends else 0)
        return self.packed

    def _problem(self, k: int) -> Problem:
        j, f = self.jobs[k], len(self.features)
        med, mean, std = self.pre[j.end]
        w, bias = np.zeros(f + self.width), 0.0
        if near := [m for m in self.weights if self.jobs[m].target == j.target]:
            m = min(near, key=lambda m: (abs(self.jobs[m].end - j.end), abs(self.jobs[m].l2 - j.l2)))
            _, its_mean, its_std = self.pre[self.jobs[m].end]
            slope = self.weights[m].coefficients[:f] / its_std
            w = np.concatenate([slope * std, self.weights[m].coefficients[f:]])
            bias = self.weights[m].intercept + float(slope @ (mean - its_mean))
        return Problem(self.ends.index(j.end), self.targets.index(j.target), self.count[j.end], self.class_weights(j.target, j.end), j.l2, self.pre[j.end], w, bias)

    def close(self) -> None:
        if self.packed is not None:
            self.packed.unpersist()
        super().close()

    def report(self) -> DataFrame:
        """(target, rows, l2, iterations, converged), one row a fit."""
        rows = [(self.jobs[k].target, self.count[self.jobs[k].end], self.jobs[k].l2, w.iterations, w.converged) for k, w in self.weights.items()]
        return self.spark.createDataFrame(rows, "target string, rows long, l2 double, iterations int, converged boolean")

    def score(self, asked: list[tuple[int, int, int]]) -> DataFrame:
        """(asked, y, p) of rows lo <= row < hi under model k, for each numbered ``(k, lo, hi)`` with a model."""
        f, nt = len(self.features), len(self.targets)
        todo = [(no, lo, hi, self.pre[self.jobs[k].end], self.targets.index(self.jobs[k].target), self.weights[k].coefficients, self.weights[k].intercept)
                for no, (k, lo, hi) in enumerate(asked) if k in self.weights]
        sent = self.spark.sparkContext.broadcast(todo)  # features + CITY_WIDTH numbers a model

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                row, bucket = b.column(0).to_numpy(), b.column(1).to_numpy()
                x = np.stack([b.column(2 + nt + k).to_numpy(zero_copy_only=False) for k in range(f)], 1)
                for no, lo, hi, (med, mean, std), t, w, bias in sent.value:
                    at = np.flatnonzero((row >= lo) & (row < hi))
                    if len(at):
                        own = x[at]
                        z = (np.where(np.isnan(own), med, own) - mean) / std
                        p = 1 / (1 + np.exp(-np.clip(z @ w[:f] + w[f:][bucket[at]] + bias, -35, 35)))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), no), pa.int32()), b.column(2 + t).take(pa.array(at)).cast(pa.int32()), pa.array(p)], names=["asked", "y", "p"])

        span = self.data.where(F.col("row").between(min((lo for _, lo, *_ in todo), default=0), max((hi for _, _, hi, *_ in todo), default=0)))
        return span.drop("city", "block").mapInArrow(run, "asked int, y int, p double")

    def model(self, k: int) -> LinearModel:
        """The fitted model in the form inference uses; its city weights are a table of one row a city of its range."""
        med, mean, std = self.pre[self.jobs[k].end]
        pre = ST.Preprocessor(list(self.features), *({c: float(v) for c, v in zip(self.features, x, strict=True)} for x in (med, mean, std)))
        w, f = self.weights[k], len(self.features)
        known = np.flatnonzero(w.coefficients[f:])  # at most CITY_WIDTH rows
        table = self.spark.createDataFrame([(int(i), float(w.coefficients[f + i])) for i in known], "bucket int, weight double")
        cities = self.cities.where(F.col("first_row") < self.jobs[k].end).join(F.broadcast(table), "bucket").select("city", "weight")
        return LinearModel(self.jobs[k].target, pre, {c: float(v) for c, v in zip(self.features, w.coefficients[:f], strict=True)}, w.intercept, cities)
