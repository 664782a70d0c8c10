"""Forward interval labelling (J1, J1a), time to next incident (J1b), trailing counts.

label_k = 1 iff an incident of group k in the same city has ``t <= ti <= t + horizon``.
Computed as "next incident of group k at or after t" (skew-safe as-of join, see ``asof.py``),
then ``next - t <= horizon``; no pairs are ever materialised.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import stripped
from ..schema import SYSTEM_SYNONYMS, TARGET_COLUMNS
from .asof import HOUR_US, epoch_us, nearest

DAY_US = 24 * HOUR_US


def normalize_system(c) -> Column:
    """T4: strip all white space, lower, spaces to underscores."""
    c = F.col(c) if isinstance(c, str) else c
    return F.translate(F.lower(stripped(c)), " ", "_")


def incident_groups(incidents: DataFrame) -> DataFrame:
    """(city, t_us, one boolean per target); the overall target takes every incident."""
    norm = normalize_system("system")
    cols = {TARGET_COLUMNS[0]: F.lit(True)}
    for target, names in SYSTEM_SYNONYMS.items():
        cols[target] = F.coalesce(norm.isin(*names), F.lit(False))
    return incidents.select(F.col("city"), epoch_us("timestamp").alias("__ti"), *[v.alias(k) for k, v in cols.items()])


def next_incident(telemetry: DataFrame, incidents: DataFrame, bucket_hours: int = 72) -> DataFrame:
    """Epoch-micros of the next incident at or after each row, per target group (null if none)."""
    inc = incident_groups(incidents)
    left = telemetry.withColumn("__t_us", epoch_us("timestamp"))
    aggs = {f"next_{t}": F.when(F.col(t), F.col("__ti")) for t in TARGET_COLUMNS}
    out = nearest(left, inc, "city", "__t_us", "__ti", aggs, "forward", bucket_hours * HOUR_US)
    return out


def label(telemetry: DataFrame, incidents: DataFrame, horizon_hours: int = 72, keep_next: bool = False) -> DataFrame:
    """J1 + J1a: five 0/1 labels, both interval ends closed; null city -> 0."""
    h = horizon_hours * HOUR_US
    out = next_incident(telemetry, incidents, bucket_hours=horizon_hours)
    labels = {t: F.coalesce((F.col(f"next_{t}") - F.col("__t_us")) <= F.lit(h), F.lit(False)).cast("int")
              for t in TARGET_COLUMNS}
    out = out.withColumns(labels)
    drop = ["__t_us"] + ([] if keep_next else [f"next_{t}" for t in TARGET_COLUMNS])
    return out.drop(*drop)


def trailing_counts(telemetry: DataFrame, wanted: dict[str, tuple[DataFrame, int]], parts: int = 8) -> DataFrame:
    """For each ``name: (events, days)`` the events of the same city with ``t - days <= te <= t``, per telemetry row.

    A count depends on city and time only, so questions are distinct (city, time) points: (events up to t) minus
    (events before t - days), two running counts, linear in the rows.  All names share one line of questions and events,
    one window, one aggregate and one join.  Time is cut into buckets of ``days / parts``; running counts inside a
    bucket are completed by prefix counts over a table of one row per (name, city, bucket), so a hot city is spread over
    its buckets.  Rows without a city or a time count 0 and never enter the windows; ids play no part.
    """
    names, t = list(wanted), epoch_us("timestamp")
    known = F.col("city").isNotNull() & F.col("timestamp").isNotNull()
    points = telemetry.where(known).select(F.col("city").alias("__city"), t.alias("__at")).distinct()
    # an event at the asked time counts up to t and does not count before t - days: kind orders equal times
    both = [F.struct(F.lit(k).alias("__of"), (F.col("__at") - F.lit(DAY_US * back)).alias("__t"), F.lit(kind).alias("__kind"))
            for k, n in enumerate(names) for back, kind in ((0, 2), (wanted[n][1], 0))]
    line = points.select("__city", "__at", F.inline(F.array(*both)))
    for k, n in enumerate(names):
        line = line.unionByName(wanted[n][0].where(known).select(F.col("city").alias("__city"), F.lit(k).alias("__of"), t.alias("__t"), F.lit(1).alias("__kind")), allowMissingColumns=True)
    width = F.element_at(F.lit([DAY_US * wanted[n][1] // parts for n in names]), F.col("__of") + 1)
    line = line.withColumn("__b", F.floor(F.col("__t") / width))
    one = F.when(F.col("__kind") == 1, F.lit(1)).otherwise(F.lit(0))
    w = Window.partitionBy("__of", "__city", "__b").orderBy("__t", "__kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = line.withColumn("__in", F.sum(one).over(w)).where(F.col("__kind") != 1)
    wb = Window.partitionBy("__of", "__city").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    before = line.groupBy("__of", "__city", "__b").agg(F.sum(one).alias("__n")).select("__of", "__city", "__b", F.coalesce(F.sum("__n").over(wb), F.lit(0)).alias("__before"))
    seen = inside.join(before, ["__of", "__city", "__b"])  # reuses the window's partitioning
    signed = (F.col("__kind") - 1) * (F.col("__in") + F.col("__before"))
    counts = seen.groupBy("__city", "__at").agg(*[F.sum(F.when(F.col("__of") == k, signed)).cast("int").alias(f"__count{k}") for k in range(len(names))])
    same = (F.col("city") == F.col("__city")) & (t == F.col("__at"))
    return telemetry.join(counts, same, "left").select(*telemetry.columns, *[F.coalesce(f"__count{k}", F.lit(0)).alias(n) for k, n in enumerate(names)])


def trailing_count(telemetry: DataFrame, events: DataFrame, days: int, name: str, parts: int = 8) -> DataFrame:
    """W8 for one kind of events."""
    return trailing_counts(telemetry, {name: (events, days)}, parts)
