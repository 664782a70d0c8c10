"""Skew-safe nearest-neighbour-in-time joins (as-of joins) on DataFrames.

Spark has no as-of join.  A per-key window (``partitionBy(city).orderBy(t)``) would put a hot city
(a third of all rows) into one task, and an equi+range join emits all pairs within a key.  Instead:

1. Cut time into buckets of width ``bucket_us``.  Left and right rows are unioned and a running
   window partitioned by ``(key, bucket)`` finds the nearest right row *inside the same bucket*
   (one shuffle of the big side; a hot key is spread over its buckets).
2. The right side is pre-aggregated per ``(key, bucket)`` (map-side partial aggregation, output
   bounded by keys x buckets) and a small window over those bucket summaries gives, for every
   left bucket, the nearest right row in a strictly earlier (backward) / later (forward) bucket.
3. ``coalesce(within_bucket, other_buckets)`` is exact: a same-bucket match is always nearer.

All work stays in JVM expressions; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000


def epoch_us(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.unix_micros(c.cast("timestamp"))


def nearest(
    left: DataFrame,
    right: DataFrame,
    key: str,
    left_time_us: str,
    right_time_us: str,
    aggs: dict[str, Column],
    direction: str = "forward",
    bucket_us: int = 72 * HOUR_US,
) -> DataFrame:
    """Add one column per ``aggs`` entry to ``left``.

    ``aggs`` maps an output name to an expression over ``right``'s columns; the result is its
    ``min`` over right rows with ``right_time >= left_time`` (forward) or its ``max`` over rows with
    ``right_time <= left_time`` (backward), per equal ``key``.  Make the expression start with the
    right time (e.g. ``struct(t, id, ...)``) to get the nearest row; wrap it in ``when`` to filter.
    Right rows with a null key never match.
    """
    forward = direction == "forward"
    agg_fn = F.min if forward else F.max
    names = list(aggs)
    tmp = {n: f"__a_{i}" for i, n in enumerate(names)}

    r = (right.where(F.col(key).isNotNull())
         .select(F.col(key), F.col(right_time_us).alias("__t"), *[aggs[n].alias(tmp[n]) for n in names])
         .withColumn("__b", F.floor(F.col("__t") / F.lit(bucket_us)))
         .withColumn("__side", F.lit(1)))
    lft = (left.withColumn("__t", F.col(left_time_us))
           .withColumn("__b", F.floor(F.col("__t") / F.lit(bucket_us)))
           .withColumn("__side", F.lit(0)))

    # 1. inside the bucket: running min/max over the time-ordered union
    order = F.col("__t").desc() if forward else F.col("__t").asc()
    w = Window.partitionBy(key, "__b").orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    # rows without a key match nothing: a bucket by hash spreads them, where one bucket a time would gather them
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in left.columns]), F.lit(1 << 20))
    keyed = lft.where(F.col(key).isNotNull())
    within = lft.withColumn("__b", F.when(F.col(key).isNull(), spread).otherwise(F.col("__b"))).unionByName(r, allowMissingColumns=True)
    within = within.withColumns({
        f"__in_{i}": agg_fn(F.when(F.col("__side") == 1, F.col(tmp[n]))).over(w) for i, n in enumerate(names)
    }).where(F.col("__side") == 0)

    # 2. across buckets: per-bucket summaries of the right side, then a running window per key
    summary = r.groupBy(key, "__b").agg(*[agg_fn(tmp[n]).alias(tmp[n]) for n in names]).withColumn("__side", F.lit(1))
    keys = keyed.select(key, "__b").distinct().withColumn("__side", F.lit(0))
    border = F.col("__b").desc() if forward else F.col("__b").asc()
    wb = Window.partitionBy(key).orderBy(border, F.col("__side").asc()).rowsBetween(Window.unboundedPreceding, -1)
    beyond = (keys.unionByName(summary, allowMissingColumns=True)
              .withColumns({f"__out_{i}": agg_fn(F.when(F.col("__side") == 1, F.col(tmp[n]))).over(wb)
                            for i, n in enumerate(names)})
              .where(F.col("__side") == 0)
              .select(F.col(key).alias("__k"), F.col("__b").alias("__bb"), *[f"__out_{i}" for i in range(len(names))]))

    # plain equality: a null key has no right rows anyway, and equi-keys (key, bucket) let the join reuse
    # the window's hash partitioning of the big side instead of shuffling it again
    out = within.join(beyond, on=[F.col(key) == F.col("__k"), F.col("__b") == F.col("__bb")], how="left")
    return out.select(
        *left.columns,
        *[F.coalesce(F.col(f"__in_{i}"), F.col(f"__out_{i}")).alias(n) for i, n in enumerate(names)],
    )
