"""Distributed classification metrics (E1-E12) over long frames ``(group..., y, p)``.

All metrics are grouped aggregations keyed by ``group`` (e.g. target, model, window), so one job
scores every (target, model) pair.  Curve metrics (ROC-AUC, average precision, F1 threshold) first
group by ``(group, p)`` -- tie-grouped curves -- and then take global running sums without a
single-partition window (see ``running_sums``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import edge_slice, slice_edges

EPS = 1e-12

# 10 calibration bins on linspace(0, 1, 11), exact binary edges; last bin is closed.
BIN_EDGES = [0.0, 0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9, 1.0]


def safe_div(a: Column, b: Column) -> Column:
    return F.when(F.abs(b) < F.lit(EPS), F.lit(0.0)).otherwise(a.cast("double") / b.cast("double"))


def points(df: DataFrame, group: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """One row per (group, distinct p): tp = positives, cnt = rows.  Labels are 0/1.

    Every metric below is computed from this table, so the scored rows are read and shuffled once
    (partial aggregation map-side); identical sub-plans share one exchange.
    """
    return df.groupBy(*group, p).agg(F.sum(F.col(y).cast("long")).alias("tp"), F.count(F.lit(1)).alias("cnt"))


def confusion(df: DataFrame, group: list[str], threshold=0.5, y: str = "y", p: str = "p",
              pts: DataFrame | None = None) -> DataFrame:
    """E1 + E2: counts at ``p >= threshold``, accuracy, precision, recall, F1, Brier, log loss, positive rate.

    ``threshold`` is a number or the name of a column that is constant within each group.
    """
    keys = group + ([threshold] if isinstance(threshold, str) else [])
    pts = pts if pts is not None else points(df, keys, y, p)
    thr = F.col(threshold) if isinstance(threshold, str) else F.lit(float(threshold))
    pc, tp, cnt = F.col(p), F.col("tp"), F.col("cnt")
    neg = cnt - tp
    pred = pc >= thr
    pcl = F.least(F.greatest(pc, F.lit(EPS)), F.lit(1.0 - EPS))
    qcl = F.least(F.greatest(F.lit(1.0) - pc, F.lit(EPS)), F.lit(1.0 - EPS))
    agg = pts.groupBy(*keys).agg(
        F.sum(F.when(pred, tp).otherwise(F.lit(0))).alias("tp"),
        F.sum(F.when(~pred, neg).otherwise(F.lit(0))).alias("tn"),
        F.sum(F.when(pred, neg).otherwise(F.lit(0))).alias("fp"),
        F.sum(F.when(~pred, tp).otherwise(F.lit(0))).alias("fn"),
        F.sum(cnt).alias("n"),
        F.sum(tp * (pc - F.lit(1.0)) * (pc - F.lit(1.0)) + neg * pc * pc).alias("__se"),
        F.sum(tp * F.log(pcl) + neg * F.log(qcl)).alias("__ll"),
        F.sum(tp).alias("__pos"),
    )
    agg = agg.withColumns({
        "brier": F.col("__se") / F.col("n"),
        "log_loss": -(F.col("__ll") / F.col("n")),
        "positive_rate": F.col("__pos") / F.col("n"),
    }).drop("__se", "__ll", "__pos")
    prec = safe_div(F.col("tp"), F.col("tp") + F.col("fp"))
    rec = safe_div(F.col("tp"), F.col("tp") + F.col("fn"))
    agg = agg.withColumns({
        "accuracy": safe_div(F.col("tp") + F.col("tn"), F.col("n")),
        "precision": prec,
        "recall": rec,
    })
    out = agg.withColumn("f1", safe_div(F.lit(2.0) * F.col("precision") * F.col("recall"),
                                        F.col("precision") + F.col("recall")))
    return out.drop(threshold) if isinstance(threshold, str) else out


def calibration_bin(p: Column) -> Column:
    """Bin index 0..9 by comparison with the literal edges (never ``floor(p*10)``); null outside [0, 1]."""
    out = F.lit(None).cast("int")
    for i in reversed(range(10)):
        lo, hi = BIN_EDGES[i], BIN_EDGES[i + 1]
        upper = (p <= F.lit(hi)) if i == 9 else (p < F.lit(hi))
        out = F.when((p >= F.lit(lo)) & upper, F.lit(i)).otherwise(out)
    return out


def _bins(pts: DataFrame, group: list[str], p: str) -> DataFrame:
    return (pts.withColumn("bin", calibration_bin(F.col(p)))
            .groupBy(*group, "bin").agg(F.sum("cnt").alias("nb"), F.sum(F.col(p) * F.col("cnt")).alias("__ps"),
                                        F.sum("tp").alias("__ys"))
            .withColumns({"pm": F.col("__ps") / F.col("nb"), "ym": F.col("__ys") / F.col("nb")}))


def reliability(df: DataFrame, group: list[str], y: str = "y", p: str = "p", pts: DataFrame | None = None) -> DataFrame:
    """One row per group and bin (empty bins as zeros): bin, range_low, range_high, count,
    predicted_mean, observed_rate."""
    pts = pts if pts is not None else points(df, group, y, p)
    binned = _bins(pts, group, p).where(F.col("bin").isNotNull()).select(
        *group, "bin", F.col("nb").alias("count"), F.col("pm").alias("predicted_mean"), F.col("ym").alias("observed_rate"))
    edges = F.array(*[F.lit(e) for e in BIN_EDGES])
    dims = (pts.select(*group).distinct()
            .withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(9))))
            .withColumn("range_low", F.element_at(edges, F.col("bin") + 1))
            .withColumn("range_high", F.element_at(edges, F.col("bin") + 2)))
    out = dims.join(binned, on=[*group, "bin"], how="left")
    return out.select(*group, "bin", "range_low", "range_high",
                      F.coalesce("count", F.lit(0)).alias("count"),
                      F.coalesce("predicted_mean", F.lit(0.0)).alias("predicted_mean"),
                      F.coalesce("observed_rate", F.lit(0.0)).alias("observed_rate"))


def ece(df: DataFrame, group: list[str], y: str = "y", p: str = "p", pts: DataFrame | None = None) -> DataFrame:
    """Sum over non-empty bins of |mean p - mean y| * n_bin / n."""
    pts = pts if pts is not None else points(df, group, y, p)
    w = Window.partitionBy(*group)
    return (_bins(pts, group, p).withColumn("n", F.sum("nb").over(w)).where(F.col("bin").isNotNull())
            .groupBy(*group).agg(F.sum(F.abs(F.col("pm") - F.col("ym")) * (F.col("nb") / F.col("n"))).alias("ece_10_bins")))


SLICES = 1024  # fixed cuts of [0, 1]; many more than tasks, so uneven slices even out


def unit_slice(p: Column, slices: int = SLICES) -> Column:
    """Number of the equal cut of [0, 1] that holds ``p``; values outside fall into the end slices, null into -1."""
    return F.coalesce(F.least(F.greatest(F.floor(p * F.lit(slices)), F.lit(0)), F.lit(slices - 1)), F.lit(-1)).cast("int")


def running_sums(df: DataFrame, group: list[str], order: str, sums: list[str], descending: bool = True,
                 num_partitions: int | None = None, unit: bool = False) -> DataFrame:
    """Global running sums of ``sums`` per ``group`` in ``order`` (unique within a group).

    The slice of a row is a function of its own ``order`` value (with ``unit`` a fixed cut of [0, 1], else a cut at
    quantile edges that are read once and stand as literals), so every branch of the plan and every
    recomputation agree on it.  Local running sums inside (group, slice), plus the totals of the
    slices before, from a table with one row per (group, slice).  No task ever holds a whole group, and
    the join reuses the window's partitioning.
    """
    if unit:
        at = unit_slice(F.col(order))
    else:
        n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        at = edge_slice(F.col(order), slice_edges(df, F.col(order), 4 * n))
    cut = df.withColumn("__slice", at)
    o, so = (F.col(order).desc(), F.col("__slice").desc()) if descending else (F.col(order).asc(), F.col("__slice").asc())
    wl = Window.partitionBy(*group, "__slice").orderBy(o).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = cut.withColumns({f"__l_{s}": F.sum(s).over(wl) for s in sums})
    totals = cut.groupBy(*group, "__slice").agg(*[F.sum(s).alias(f"__t_{s}") for s in sums])
    wo = Window.partitionBy(*group).orderBy(so).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], F.col("__slice").alias("__s"),
                            *[F.coalesce(F.sum(f"__t_{s}").over(wo), F.lit(0)).alias(f"__o_{s}") for s in sums])
    same = [F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(group)] + [F.col("__slice") == F.col("__s")]
    out = local.join(offsets, on=same, how="inner")
    return out.select(*df.columns, *[(F.col(f"__l_{s}") + F.col(f"__o_{s}")).alias(f"c{s}") for s in sums])


def curve(df: DataFrame, group: list[str], y: str = "y", p: str = "p", pts: DataFrame | None = None) -> DataFrame:
    """Tie-grouped curve: one row per (group, distinct p desc) with tp, cnt, ctp, ccnt, pos, tot."""
    g = pts if pts is not None else points(df, group, y, p)
    cur = running_sums(g.select(*group, p, "tp", "cnt"), group, p, ["tp", "cnt"], descending=True, unit=True)
    tot = g.groupBy(*group).agg(F.sum("tp").alias("pos"), F.sum("cnt").alias("tot"))
    return cur.join(tot, on=group, how="inner")


def curve_metrics(df: DataFrame, group: list[str], y: str = "y", p: str = "p", pts: DataFrame | None = None) -> DataFrame:
    """E5 ROC-AUC (mid-ranks; null for one class), E6 average precision (step; 0 without
    positives), E7 F1-optimal threshold (smallest p with the best F1, clipped to [.05, .95];
    .5 when one class)."""
    c = curve(df, group, y, p, pts)
    prec = F.col("ctp") / F.col("ccnt")
    rec = safe_div(F.col("ctp"), F.col("pos"))
    f1 = safe_div(F.lit(2.0) * prec * rec, prec + rec)
    midrank = (F.col("tot") - F.col("ccnt")).cast("double") + (F.col("cnt") + F.lit(1)).cast("double") / F.lit(2.0)
    agg = c.groupBy(*group).agg(
        F.first("pos").alias("pos"), F.first("tot").alias("tot"),
        F.sum(prec * safe_div(F.col("tp"), F.col("pos"))).alias("ap"),
        F.sum(F.col("tp") * midrank).alias("rank_sum"),
        F.max_by(F.col(p), F.struct(f1, -F.col(p))).alias("best_p"),
    )
    pos, neg = F.col("pos").cast("double"), (F.col("tot") - F.col("pos")).cast("double")
    one_class = (F.col("pos") == 0) | (F.col("pos") == F.col("tot"))
    return agg.select(
        *group,
        F.when(one_class, F.lit(None).cast("double"))
        .otherwise((F.col("rank_sum") - pos * (pos + F.lit(1.0)) / F.lit(2.0)) / (pos * neg)).alias("roc_auc"),
        F.when(F.col("pos") == 0, F.lit(0.0)).otherwise(F.col("ap")).alias("pr_auc"),
        F.when(one_class, F.lit(0.5))
        .otherwise(F.least(F.greatest(F.col("best_p"), F.lit(0.05)), F.lit(0.95))).alias("threshold"),
    )


def merged_points(pts: DataFrame, keep: list[str], block: str | None = None, spans: list[list[int]] | None = None, name: str = "window_id", p: str = "p") -> DataFrame:
    """Points of unions of blocks: the counts of a (group, p) add up, so the rows behind them are not read again.

    ``spans[b]`` lists the windows that hold block ``b``; overlapping windows share its points.  Without ``spans`` the
    points of all blocks are added up.  ``keep`` names the other group columns.
    """
    if spans is not None:
        pts = pts.withColumn(name, F.explode(F.get(F.lit(spans).cast("array<array<int>>"), F.col(block))))
        keep = [*keep, name]
    return pts.groupBy(*keep, p).agg(F.sum("tp").alias("tp"), F.sum("cnt").alias("cnt"))


def classification_metrics(df: DataFrame | None, group: list[str], threshold=0.5, y: str = "y", p: str = "p", pts: DataFrame | None = None) -> DataFrame:
    """E1-E7 in one table per group, all from one (group, p) aggregate of ``df`` (or from given ``points``)."""
    keys = group + ([threshold] if isinstance(threshold, str) else [])
    pts = pts if pts is not None else points(df, keys, y, p)
    base = confusion(df, group, threshold, y, p, pts)
    gp = pts.drop(threshold) if isinstance(threshold, str) else pts  # threshold is constant per group
    return (base.join(curve_metrics(df, group, y, p, gp).drop("threshold"), on=group, how="left")
            .join(ece(df, group, y, p, gp), on=group, how="left")
            .withColumn("ece_10_bins", F.coalesce("ece_10_bins", F.lit(0.0))))


def macro(df: DataFrame, by: list[str], metric: str = "pr_auc", name: str = "macro_pr_auc") -> DataFrame:
    """Mean of a metric over targets, nulls ignored."""
    return df.groupBy(*by).agg(F.avg(metric).alias(name))


def mean_std(df: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Mean and population std of each metric over windows, nulls ignored."""
    aggs = []
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std")]
    return df.groupBy(*by).agg(*aggs)


def stability(per_window_summary: DataFrame, per_target_metrics: DataFrame, model_col: str = "model", by: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """PR-AUC std per target (or per ``by``, from the E10 summary) and mean ECE across targets per model."""
    prauc_std = per_window_summary.select(*(by or ["target"]), "pr_auc_std")
    models = [model_col] if model_col in per_target_metrics.columns else []
    mean_ece = per_target_metrics.groupBy(*models).agg(F.avg("ece_10_bins").alias("mean_ece_10_bins"))
    return prauc_std, mean_ece


def blend_weight(macro_pr_auc: Column) -> Column:
    """clip(.45 + .40 * macro, .40, .75)."""
    return F.least(F.greatest(F.lit(0.45) + F.lit(0.40) * macro_pr_auc, F.lit(0.40)), F.lit(0.75))
