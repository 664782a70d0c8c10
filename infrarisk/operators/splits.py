"""Chronological index, splits and sampling.

W1 gives every row its global position in (timestamp, city, id) order without a one-partition
window: time is cut at quantile edges that are read once and then stand as literals in the plan, rows are
numbered inside each slice, and the row counts of earlier slices (a table of one row per slice) are
added.  The slice is a function of the row, so recomputation after executor loss gives the same index.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import edge_slice, slice_edges

SLICES_PER_PARTITION = 4


def global_index(df: DataFrame, order: list[str], name: str = "row_idx", num_partitions: int | None = None) -> DataFrame:
    """0-based position of each row in ``order`` (make the key unique, e.g. add an id; the first key is a time)."""
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.unix_micros(F.col(order[0]).cast("timestamp"))
    edges = slice_edges(df, key, max(2, n * SLICES_PER_PARTITION))
    cut = df.withColumn("__slice", edge_slice(key, edges))
    counts = df.select(edge_slice(key, edges).alias("__s")).groupBy("__s").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    # one row per slice: the only single-partition window here is over #slices rows, and so is the broadcast
    offsets = counts.select("__s", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__off"))
    inside = F.row_number().over(Window.partitionBy("__slice").orderBy(*order)) - 1
    out = cut.withColumn("__local", inside).join(F.broadcast(offsets), F.col("__slice") == F.col("__s"))
    return out.select(*df.columns, (F.col("__off") + F.col("__local")).alias(name))


def held_out(n: int, fraction: float = 0.2) -> int:
    """Number of rows at the end that are held out, one at least."""
    return max(1, math.floor(n * fraction))


def holdout_split_point(n: int, holdout_fraction: float = 0.2, min_train: int = 100) -> int:
    """First row of the holdout."""
    left = n - held_out(n, holdout_fraction)
    if left < min_train:
        raise ValueError(f"{left} training rows are left of {n}; {min_train} are needed")
    return left


def split_train_holdout(indexed: DataFrame, n: int, holdout_fraction: float = 0.2, idx: str = "row_idx"):
    split = holdout_split_point(n, holdout_fraction)
    return indexed.where(F.col(idx) < split), indexed.where(F.col(idx) >= split), split


def expanding_windows(n: int, min_train_ratio: float = 0.5, test_ratio: float = 0.1,
                      step_ratio: float = 0.1) -> list[tuple[int, int, int, int]]:
    """(train_start, train_end, test_start, test_end) of each window.

    First training length, test length and step are shares of n with floors of 150, 40 and 20 rows; window k
    trains on the first ``first + k * step`` rows, and the last is the last whose test range still fits.
    """
    first, test, step = (max(floor, math.floor(n * share)) for floor, share in ((150, min_train_ratio), (40, test_ratio), (20, step_ratio)))
    count = max(0, (n - first - test) // step + 1)
    return [(0, e, e, e + test) for e in (first + k * step for k in range(count))]


def window_test_membership(indexed: DataFrame, n: int, idx: str = "row_idx", **ratios) -> DataFrame:
    """One row per (row, window) whose test range holds the row -- windows found by
    arithmetic on the index (no join), so rows in overlapping test ranges appear once per window."""
    wins = expanding_windows(n, **ratios)
    if not wins:
        raise ValueError("not enough rows for rolling backtest windows")
    e0, ts = wins[0][1], wins[0][3] - wins[0][2]
    step = wins[1][1] - wins[0][1] if len(wins) > 1 else 1
    last = len(wins) - 1
    i = F.col(idx)
    kmin = F.greatest(F.lit(0), F.ceil((i - F.lit(e0 + ts - 1)) / F.lit(step)).cast("int"))
    kmax = F.least(F.lit(last), F.floor((i - F.lit(e0)) / F.lit(step)).cast("int"))
    out = (indexed.where((i >= e0) & (kmin <= kmax))
           .withColumn("window_id", F.explode(F.sequence(kmin, kmax))))
    return out.withColumns({"train_end": F.lit(e0) + F.col("window_id") * F.lit(step),
                            "test_end": F.lit(e0 + ts) + F.col("window_id") * F.lit(step)})


def window_blocks(indexed: DataFrame, n: int, idx: str = "row_idx", **ratios) -> tuple[DataFrame, list[list[int]]]:
    """Rows of any window's test range, once each, with ``block_id``; and the windows that hold each block.

    Blocks lie between neighbouring bounds of the test ranges, so every test range is a union of blocks, and whatever
    adds up over rows is found once a block (``metrics.merged_points``), however much the ranges overlap.
    """
    wins = expanding_windows(n, **ratios)
    if not wins:
        raise ValueError("not enough rows for rolling backtest windows")
    bounds = sorted({b for w in wins for b in w[2:]})
    spans = [[k for k, w in enumerate(wins) if w[2] <= lo and hi <= w[3]] for lo, hi in zip(bounds, bounds[1:])]
    rows = indexed.where(F.col(idx).between(bounds[0], bounds[-1] - 1)).withColumn("block_id", edge_slice(F.col(idx), bounds[1:-1]))
    held = [b for b, ks in enumerate(spans) if ks]
    return (rows if len(held) == len(spans) else rows.where(F.col("block_id").isin(held))), spans


def calibration_split_point(length: int) -> int:
    """Rows before the calibration part: 85 %, 80 at least, and never all of them."""
    return min(max(80, math.floor(0.85 * length)), length - 1)


VALID_SHARE = 0.1  # of the training rows, for each validation fold
VALID_LEAST = 40


def cv_folds(n: int, n_splits: int = 4, valid_size: int | None = None) -> list[tuple[int, int]]:
    """(train_end, valid_end) of each expanding fold.

    The first fold trains on half the rows, the last one ends with the rows, those between are spaced evenly (integer
    ends).  A fold validates on ``valid_size`` rows; by default a share of n (VALID_SHARE, VALID_LEAST at least),
    so that the choice of a configuration does not hang on 40 rows of a large corpus.  Fewer than 160 rows give no folds.
    """
    if n < 160:
        return []
    size = max(VALID_LEAST, math.floor(n * VALID_SHARE)) if valid_size is None else valid_size
    lo, hi = n // 2, n - size
    ends = [lo + (hi - lo) * k // (n_splits - 1) for k in range(n_splits)]
    return [(e, e + size) for e in ends if e + size <= n]


def stride_sample(df: DataFrame, k: int, idx: str) -> DataFrame:
    """Every k-th row of an indexed frame (``idx`` 0-based within the frame)."""
    return df.where(F.col(idx) % F.lit(max(1, k)) == 0)


def even_downsample(df: DataFrame, length: int, max_rows: int, idx: str) -> DataFrame:
    """Rows at integer-truncated ``linspace(0, length-1, max_rows)``; a no-op when small enough.

    The chosen positions are a ``sequence`` of at most ``max_rows`` values (a proven bound), joined
    to the frame on its index.
    """
    if max_rows <= 0 or length <= max_rows:
        return df
    spark = df.sparkSession
    step = (length - 1) / max(1, max_rows - 1)
    picks = (spark.range(max_rows).select(
        F.when((F.col("id") == max_rows - 1) & F.lit(max_rows > 1), F.lit(length - 1))
        .otherwise(F.floor(F.col("id").cast("double") * F.lit(step))).cast("long").alias("__pick")))
    return df.join(F.broadcast(picks), F.col(idx) == F.col("__pick"), "left_semi")


def sort_by_city_time(df: DataFrame, city: str = "city", time: str = "timestamp", id_col: str | None = None,
                      num_partitions: int | None = None) -> DataFrame:
    """K2: total order by (city, timestamp[, id]).  Range partitioning on the full key spreads a hot
    city over many partitions (a hash ``repartition(city)`` would put it in one task)."""
    keys = [city, time] + ([id_col] if id_col else [])
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)


def place_in_group(table: DataFrame, group: str, at: str, name: str = "place", parts: int = 64) -> DataFrame:
    """1-based place of each row within its group by the unique number ``at``; a group is spread over ``parts`` slices and more.

    ``table`` is read several times, so ``at`` must be stored.  Slices are cuts of ``at`` at quantile edges: rows are numbered inside
    (group, slice) and completed by the counts of the group's earlier slices, a table of one row a (group, slice).
    """
    cut = table.withColumn("__slice", edge_slice(F.col(at), slice_edges(table, F.col(at), parts)))
    w = Window.partitionBy(group).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    before = cut.groupBy(group, "__slice").agg(F.count(F.lit(1)).alias("__n")).select(F.col(group).alias("__g"), F.col("__slice").alias("__s"), F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__off"))
    inside = cut.withColumn("__local", F.row_number().over(Window.partitionBy(group, "__slice").orderBy(at)))
    return inside.join(before, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__slice") == F.col("__s"))).select(*table.columns, (F.col("__off") + F.col("__local")).alias(name))
