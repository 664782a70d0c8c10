"""S5/J1 incremental relabelling of a labelled table after late incidents.

A further incident turns labels from 0 to 1 and never back, so a stored label and the label against the late
incidents alone combine by ``greatest``: neither the earlier incidents nor other days are read.  Only the dates that a late incident
reaches back to are read (static partition pruning) and replaced (dynamic partition overwrite).  The job is idempotent: after a loss in the
middle of the commit, some dates hold new labels and some old ones, and running it again gives the same table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.labels import label
from ..schema import TARGET_COLUMNS, TIME_COLUMN


def touched_dates(late: DataFrame, horizon_hours: int = 72) -> list:
    """Days that hold a time from which a late incident is at most ``horizon_hours`` ahead (days of a calendar: a few at a time).

    Incidents without a city or a time label nothing and touch no day.
    """
    known = late.where(F.col("city").isNotNull() & F.col(TIME_COLUMN).isNotNull())
    first, last = F.to_date(F.col(TIME_COLUMN) - F.make_interval(hours=F.lit(horizon_hours))), F.to_date(TIME_COLUMN)
    return sorted(r["day"] for r in known.select(F.explode(F.sequence(first, last)).alias("day")).distinct().collect())


def relabel(spark: SparkSession, path: str, late: DataFrame, horizon_hours: int = 72) -> list:
    """Brings the table at ``path`` (``io.write_labeled``, Parquet) up to date with ``late`` incidents; returns the days rewritten.

    Rows without a time are in no touched day and keep their labels of 0.  Every row keeps its other columns; repeated rows stay repeated.
    """
    days = touched_dates(late, horizon_hours)
    table = spark.read.parquet(path)
    if not days:
        return []
    held = table.where(F.col("date").isin(days))
    days = sorted(r["date"] for r in held.select("date").distinct().collect())
    if not days:
        return []
    old = held.withColumnsRenamed({t: f"__old_{t}" for t in TARGET_COLUMNS})
    found = label(old, late, horizon_hours)
    both = found.withColumns({t: F.greatest(F.col(t), F.col(f"__old_{t}")) for t in TARGET_COLUMNS}).select(*table.columns)
    # a day's rows meet in files of about the advisory size: large days are split, small ones merged
    both.hint("rebalance", F.col("date")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)
    return days
