"""Expanding-window backtest (L5) and rule / ML / hybrid comparison.

Backtest: per window and target, split the window's training rows at the calibration point (W4),
choose the config by folds before it and the F1 threshold on the calibration rows, fit on the whole training
window, score the test range; all windows' fits run together (``fits``) and all metrics come from
grouped jobs (E10).  The driver holds coefficients and one row of metrics a window and target.

Comparison: the holdout (or the sampled one: W2 tail, W6 stride, W7 downsample) is assessed by rules, by the
models and by the blend, unpivoted to (target, model, y, p) and scored by one grouped metrics job.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import clip
from ..operators import metrics as M
from ..operators import rules
from ..operators import splits as SP
from ..functions.validate import coerce_numeric
from ..operators.features import engineered, feature_frame
from ..operators.infer import predict
from ..schema import TARGET_COLUMNS, TARGET_TO_SYSTEM
from ..session import dropped, written
from . import train as TR
from .fits import Fits, Job

METRICS = ["roc_auc", "pr_auc", "brier", "log_loss", "accuracy", "precision", "recall", "f1", "ece_10_bins"]
ORDER = ["timestamp", "city", "telemetry_id"]


def backtest(labeled: DataFrame, targets: list[str] = TARGET_COLUMNS, min_train_ratio: float = 0.5,
             test_ratio: float = 0.1, step_ratio: float = 0.1):
    """L5.  Returns (per-window metrics long table, mean/std summary per target, macro PR-AUC).

    One batch of fits holds every window's folds; the next one, under the chosen configurations, every window's part before
    the calibration rows and its whole training part.  One grouped job scores all folds, one all calibration rows, one all
    test ranges.
    """
    table = written(feature_frame(labeled, include_targets=True, keep=["timestamp", "telemetry_id"]), "features")
    n = table.count()
    windows = SP.expanding_windows(n, min_train_ratio, test_ratio, step_ratio)
    if not windows:
        raise ValueError("not enough rows for rolling backtest windows")
    cal = {w: SP.calibration_split_point(train_end) for w, (_, train_end, _, _) in enumerate(windows)}
    ends = tuple(e for w, (_, train_end, _, _) in enumerate(windows) for e in (cal[w], train_end))
    fits = Fits(SP.global_index(table, ORDER), [j for w, e in cal.items() for j in TR.fold_jobs(e, (w,), targets)], targets, ends=ends)
    dropped(table)
    part = F.regexp_extract("part", "[0-9]+", 0).cast("int").alias("window_id")
    best = TR.choices(TR.fold_scores(fits, {(w,): e for w, e in cal.items()}).select(part, "target", "config", "fold", "pr_auc"), ["window_id", "target"])
    config = {(r["window_id"], r["target"]): r["config"] for r in best.collect()}  # one row a window and target
    usable = [(w, t) for w, (_, train_end, _, _) in enumerate(windows) for t in targets if fits.both_classes(t, cal[w]) and fits.both_classes(t, train_end)]
    at = fits.more([Job((w, name, t), t, end, TR.CONFIGS[config.get((w, t), 0)]["l2"]) for w, t in usable for name, end in (("sub", cal[w]), ("full", windows[w][1]))])
    tags = F.broadcast(fits.spark.createDataFrame([(k, w, t) for k, (w, t) in enumerate(usable)], "asked int, window_id int, target string"))  # one row a fit
    rows_of = lambda name, lo, hi: fits.score([(at[(w, name, t)], lo(w), hi(w)) for w, t in usable]).join(tags, "asked").drop("asked")
    calibration = rows_of("sub", lambda w: cal[w], lambda w: windows[w][1])
    test = rows_of("full", lambda w: windows[w][2], lambda w: windows[w][3])
    # one class among calibration or test rows (no ROC): the window does not count for the target
    by, both = ["window_id", "target"], "roc_auc IS NOT NULL"
    points = M.points(calibration, by).persist(StorageLevel.MEMORY_AND_DISK)  # curves read them some times
    kept = M.curve_metrics(None, by, pts=points).where(both).select(*by, "threshold").collect()  # one row a window and target
    points.unpersist()
    found = F.broadcast(fits.spark.createDataFrame(kept, "window_id int, target string, threshold double"))
    points = M.points(test, by).join(found, by).persist(StorageLevel.MEMORY_AND_DISK)
    per = M.classification_metrics(None, ["target", "window_id"], "threshold", pts=points).where(both)
    rows = per.join(found, by).collect()  # one row a window and target
    points.unpersist()
    fits.close()
    if not rows:
        raise ValueError("no window could be evaluated")
    long = fits.spark.createDataFrame(rows)
    summary = M.mean_std(long, ["target"], METRICS).join(long.groupBy("target").agg(F.count(F.lit(1)).alias("windows_evaluated")), "target")
    return long, summary, summary.agg(F.avg("pr_auc_mean").alias("macro_pr_auc_mean"))


def holdout(labeled: DataFrame, holdout_fraction: float = 0.2) -> DataFrame:
    """The rows after the split, with the global chronological index."""
    idx = SP.global_index(labeled, ORDER)
    n = idx.count()
    return idx.where(F.col("row_idx") >= n - SP.held_out(n, holdout_fraction))


def sampled_holdout(labeled: DataFrame, holdout_fraction: float = 0.2, stride: int = 15,
                    max_rows: int = 1200) -> DataFrame:
    """W2 tail + W6 stride + W7 even downsample, with the global chronological index."""
    idx = SP.global_index(labeled, ORDER)
    n = idx.count()
    split = n - max(1, int(n * holdout_fraction))
    hold = idx.where(F.col("row_idx") >= split).withColumn("h_idx", F.col("row_idx") - F.lit(split))
    strided = SP.stride_sample(hold, stride, "h_idx").withColumn("s_idx", (F.col("h_idx") / F.lit(stride)).cast("long"))
    s_len = (n - split + stride - 1) // stride
    return SP.even_downsample(strided, s_len, max_rows, "s_idx")


def compare(labeled: DataFrame, bundle: TR.Bundle, holdout_fraction: float = 0.2, rows: DataFrame | None = None):
    """L6 on the whole holdout (or on ``rows``, e.g. ``sampled_holdout``): rule p = score / 100, ML p, hybrid p = clip((1 - a) rule + a ml); metrics at .5, reliability
    bins, macro PR-AUC per model, random baseline (prevalence) and uplift."""
    scored = rules.score(holdout(labeled, holdout_fraction) if rows is None else rows)
    feats = engineered(coerce_numeric(scored)).withColumn(
        "city", F.coalesce(F.col("city").cast("string"), F.lit("UNKNOWN")))
    models = [bundle.targets[t].model for t in TARGET_COLUMNS if t in bundle.targets]
    probs = predict(feats, models)
    a = max(0.0, min(1.0, bundle.blend_weight))
    items = []
    for t in TARGET_COLUMNS:
        rule_score = "overall_risk_score" if t == TARGET_COLUMNS[0] else f"{TARGET_TO_SYSTEM[t]}_risk_score"
        rule_p = clip(F.col(rule_score) / F.lit(100.0), 0.0, 1.0)
        ml_p = clip(F.coalesce(F.col(f"p_{t}"), F.lit(0.0)), 0.0, 1.0)
        hyb = clip(F.lit(1.0 - a) * rule_p + F.lit(a) * ml_p, 0.0, 1.0)
        for name, p in (("rule_only", rule_p), ("ml_only", ml_p), ("hybrid", hyb)):
            items.append(F.struct(F.lit(t).alias("target"), F.lit(name).alias("model"), F.col(t).alias("y"), p.alias("p")))
    long = probs.select("telemetry_id", F.inline(F.array(*items)))
    points = written(M.points(long, ["target", "model"]), "compared")  # rows are scored once for all that follows
    met = M.classification_metrics(None, ["target", "model"], 0.5, pts=points)
    rel = M.reliability(None, ["target", "model"], pts=points)
    prevalence = points.where(F.col("model") == "rule_only").groupBy("target").agg((F.sum("tp") / F.sum("cnt")).alias("class_prevalence"))
    macro = met.groupBy("model").agg(F.avg("pr_auc").alias("macro_pr_auc"))
    base = prevalence.agg(F.avg("class_prevalence")).first()[0]  # one number
    macro = macro.withColumns({"macro_random_baseline": F.lit(base),
                               "macro_uplift": F.col("macro_pr_auc") - F.lit(base)})
    return met, rel, prevalence, macro
