"""Preprocessing statistics (A1-A5).

Medians by distributed rank selection, then one aggregate for all means / population stds on the imputed
frame.  Results are a handful of numbers per feature (bounded by the feature count), the only
thing brought to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import MODEL_NUMERIC_FEATURES


@dataclass
class Preprocessor:
    numeric_features: list[str]
    medians: dict[str, float]
    means: dict[str, float]
    stds: dict[str, float]
    city_categories: list[str] = field(default_factory=list)


MEDIAN_SLICES = 64


def grouped_medians(df: DataFrame, features: list[str] = MODEL_NUMERIC_FEATURES, group: list[str] | None = None) -> DataFrame:
    """A1: (group..., feature, median), exact and interpolated; features without a value are absent.

    Values are counted by (group, feature, value), running counts are taken inside value slices (edges at
    approximate quantiles, a few numbers a feature) and completed by the counts of the slices before; the middle
    ranks are then picked.  No task holds all values of a feature, and only the edges reach the driver.
    """
    group = group or []
    shares = F.lit([i / MEDIAN_SLICES for i in range(1, MEDIAN_SLICES)]).cast("array<double>")
    edge = df.agg(*[F.percentile_approx(F.col(c).cast("double"), shares, 1000).alias(c) for c in features]).first()
    edges = df.sparkSession.createDataFrame([(c, sorted(set(edge[c] or []))) for c in features], "feature string, edges array<double>")
    value = lambda c: F.when(F.isnan(F.col(c).cast("double")), F.lit(None)).otherwise(F.col(c).cast("double"))
    long = df.select(*group, F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), value(c).alias("value")) for c in features]))).where("value IS NOT NULL")
    points = long.groupBy(*group, "feature", "value").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(edges), "feature")  # one row a feature
    points = points.select(*group, "feature", "value", "n", F.size(F.filter("edges", lambda e: e <= F.col("value"))).alias("slice"))
    keys = [*group, "feature"]
    inside = F.sum("n").over(Window.partitionBy(*keys, "slice").orderBy("value").rowsBetween(Window.unboundedPreceding, -1))
    sums = points.groupBy(*keys, "slice").agg(F.sum("n").alias("sn"))
    before = F.sum("sn").over(Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(*keys, "slice", F.coalesce(before, F.lit(0)).alias("sb"), F.sum("sn").over(Window.partitionBy(*keys)).alias("total"))
    ranked = points.withColumn("ib", F.coalesce(inside, F.lit(0))).join(sums, [*keys, "slice"]).withColumn("first", F.col("ib") + F.col("sb"))
    at = lambda rank: F.max(F.when((F.col("first") <= rank) & (rank < F.col("first") + F.col("n")), F.col("value")))
    low, high = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    return ranked.groupBy(*keys).agg(((at(low) + at(high)) / 2).alias("median"))


DIGIT = 11  # bits of a value told apart in a pass
COMPACT = 2_000_000  # entries that a task collects before it adds them up


def prefix_medians(df: DataFrame, block: str, blocks: int, features: list[str] = MODEL_NUMERIC_FEATURES) -> DataFrame:
    """A1 of nested ranges: (feature, medians), where medians[b] is the median of the rows whose ``block`` is at most b.

    Exact, by digits: a double's bits, the sign turned over, sort as numbers do.  A pass counts the rows of each (block, feature, next
    digit) among the values that begin as the middle ranks so far; blocks add up to ranges on the driver, which goes
    on to the digit that holds each rank.  Values are never shuffled, only counts.  A range without a value of the feature has
    a null.  ``df`` is read once a pass, so it should be stored.
    """
    spark, nf = df.sparkSession, len(features)
    data = df.select(F.col(block).cast("int").alias("b"), *[F.col(c).cast("double").alias(f"v{k}") for k, c in enumerate(features)])
    left = 64
    begun: list[np.ndarray] = [np.zeros(1, np.uint64)] * nf  # distinct beginnings still looked at, sorted
    at: dict[tuple[int, int, int], tuple[int, int]] = {}  # (feature, range, low or high) -> beginning, rank within it
    while left:
        bits = min(DIGIT, left)
        left -= bits
        first = left + bits == 64

        def run(batches: Iterator[pa.RecordBatch], left=left, bits=bits, begun=begun, first=first) -> Iterator[pa.RecordBatch]:
            seen: list[tuple[np.ndarray, np.ndarray]] = []
            held = 0
            for batch in batches:
                of = batch.column(0).to_numpy().astype(np.int64)
                for k in range(nf):
                    x = batch.column(1 + k).to_numpy(zero_copy_only=False)
                    raw = np.ascontiguousarray(x).view(np.int64)
                    key = (raw ^ ((raw >> 63) | np.int64(-(2**63)))).view(np.uint64) >> np.uint64(left)
                    inside = ~np.isnan(x)
                    if first:
                        no = np.zeros(len(key), np.int64)
                    else:
                        start = key >> np.uint64(bits)
                        no = np.searchsorted(begun[k], start)
                        inside &= begun[k][np.minimum(no, len(begun[k]) - 1)] == start if len(begun[k]) else False
                    digit = (key & np.uint64(2**bits - 1)).astype(np.int64)
                    code, n = np.unique((((no * blocks + of) * nf + k) << DIGIT | digit)[inside], return_counts=True)
                    seen.append((code, n))
                    held += len(code)
                if held > COMPACT:
                    seen = [_added(seen)]
                    held = len(seen[0][0])
                    if held > COMPACT // 2:  # few repeats: Spark adds them up
                        yield _counts(seen.pop())
                        held = 0
            if seen:
                yield _counts(_added(seen))

        got = data.mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
        code, n = got["code"].to_numpy(), got["n"].to_numpy()
        digit, rest = code & (2**DIGIT - 1), code >> DIGIT
        k, of, no = rest % nf, rest // nf % blocks, rest // nf // blocks
        following: list[set[int]] = [set() for _ in range(nf)]
        went: dict[tuple[int, int, int], tuple[int, int]] = {}
        for feature in range(nf):
            for which, start in enumerate(begun[feature].tolist()):
                mine = (k == feature) & (no == which)
                if not mine.any():
                    continue
                counts = np.zeros((blocks, 2**bits), np.int64)
                np.add.at(counts, (of[mine], digit[mine]), n[mine])
                upto = counts.cumsum(0).cumsum(1)  # rows of the range up to the digit
                for r in range(blocks):
                    total = int(upto[r, -1])
                    for side in (0, 1):
                        if first:
                            if not total:
                                continue
                            rank = (total - 1 + side) // 2
                        elif at.get((feature, r, side), (None,))[0] == start:
                            rank = at[feature, r, side][1]
                        else:
                            continue
                        d = int(np.searchsorted(upto[r], rank, side="right"))
                        found = start << bits | d
                        went[feature, r, side] = found, rank - (int(upto[r, d - 1]) if d else 0)
                        following[feature].add(found)
        at, begun = went, [np.array(sorted(s), np.uint64) for s in following]

    def value(key: int) -> float:
        key ^= (1 << 63) if key >> 63 else (1 << 64) - 1
        return float(np.array([key], np.uint64).view(np.float64)[0])

    rows = [(c, [(value(at[k, r, 0][0]) + value(at[k, r, 1][0])) / 2 if (k, r, 0) in at else None for r in range(blocks)]) for k, c in enumerate(features)]
    return spark.createDataFrame(rows, "feature string, medians array<double>")


def _added(seen: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    code, where = np.unique(np.concatenate([c for c, _ in seen]), return_inverse=True)
    return code, np.bincount(where, weights=np.concatenate([n for _, n in seen]), minlength=len(code)).astype(np.int64)


def _counts(pair: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v.astype(np.int64)) for v in pair], names=["code", "n"])


def medians(df: DataFrame, features: list[str] = MODEL_NUMERIC_FEATURES) -> dict[str, float]:
    """A1: interpolated median per feature (one number each on the driver), all-null -> 0."""
    found = {r["feature"]: float(r["median"]) for r in grouped_medians(df, features).collect()}
    return {c: found.get(c, 0.0) for c in features}


def moments(df: DataFrame, meds: dict[str, float], features: list[str] = MODEL_NUMERIC_FEATURES):
    """A2: mean and population std after median imputation; std <= 1e-9 -> 1."""
    aggs = []
    for c in features:
        x = F.coalesce(F.col(c).cast("double"), F.lit(meds[c]))
        aggs += [F.avg(x).alias(f"m_{c}"), F.stddev_pop(x).alias(f"s_{c}")]
    row = df.agg(*aggs).first()
    means = {c: float(row[f"m_{c}"]) if row[f"m_{c}"] is not None else 0.0 for c in features}
    stds = {}
    for c in features:
        s = row[f"s_{c}"]
        stds[c] = float(s) if s is not None and s > 1e-9 else 1.0
    return means, stds


def city_categories(df: DataFrame) -> DataFrame:
    """A3: distinct sorted city categories (null -> 'UNKNOWN'), as a DataFrame (not collected)."""
    return (df.select(F.coalesce(F.col("city").cast("string"), F.lit("UNKNOWN")).alias("city"))
            .distinct().orderBy("city"))


def fit_preprocessor(df: DataFrame, features: list[str] = MODEL_NUMERIC_FEATURES) -> Preprocessor:
    """Medians, means and deviations; city categories stay a DataFrame (``city_categories``)."""
    meds = medians(df, features)
    means, stds = moments(df, meds, features)
    return Preprocessor(list(features), meds, means, stds)


def class_balance(df: DataFrame, targets: list[str]) -> DataFrame:
    """A4 + A5: per target n, positives, prevalence, class weights n/(2 pos), n/(2 neg) with floors of 1,
    and whether both classes occur."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, t in enumerate(targets):
        aggs += [F.sum(F.col(t).cast("long")).alias(f"p{i}"), F.count_distinct(F.col(t)).alias(f"c{i}")]
    one = df.agg(*aggs)  # one scan for every target
    out = one.select("n", F.inline(F.array(*[
        F.struct(F.lit(t).alias("target"), F.col(f"p{i}").alias("positives"), F.col(f"c{i}").alias("classes"))
        for i, t in enumerate(targets)])))
    pos_f = F.greatest(F.col("positives"), F.lit(1))
    neg_f = F.greatest(F.col("n") - pos_f, F.lit(1))
    return out.select(
        "target", "n", "positives",
        (F.col("positives") / F.col("n")).alias("prevalence"),
        (F.col("n") / (F.lit(2.0) * pos_f)).alias("pos_weight"),
        (F.col("n") / (F.lit(2.0) * neg_f)).alias("neg_weight"),
        (F.col("classes") >= 2).alias("has_two_classes"),
    )
