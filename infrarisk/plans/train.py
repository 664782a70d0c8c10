"""Model fitting (L1-L4) and the training report.

L1  class-weighted L2 logistic regression: ``LogisticRegression(weightCol, regParam=l2,
    elasticNetParam=0, standardization=False)``.  With weights n/(2 pos), n/(2 neg) the weights sum
    to n, so MLlib's objective (1/sum w) sum w_i loss_i + l2/2 |b|^2 is the gradient-descent
    objective of the modelled trainer; MLlib converges where that trainer stops after fixed
    epochs, so coefficients differ slightly and metrics are compared with a tolerance.
L2  config choice by mean CV average precision over the expanding folds (W5), first of equals.
L3  fit on train -> F1 threshold and metrics on holdout -> refit on all rows.
L4  five independent targets; all fits of L2-L4 run together in ``fits``, to the same optimum by Newton steps.

Preprocessing (median impute, population standardisation) uses ``stats``; the city one-hot uses
``StringIndexer(handleInvalid='keep')`` + ``OneHotEncoder(dropLast=True)`` so an unseen city maps to
all zeros.  The fitted model is turned back into a ``LinearModel`` (weights as literals, city
weights as a small table) so inference, overlay and streaming share one expression path.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import splits as SP
from ..operators import stats as ST
from ..operators.infer import LinearModel, standardized
from ..schema import MODEL_NUMERIC_FEATURES, TARGET_COLUMNS
from ..session import dropped, written
from .fits import Fits, Job

# Candidate configurations (learning rate and epochs only matter to a fixed-epoch
# solver; MLlib converges, so l2 is the effective choice).
CONFIGS = [
    {"learning_rate": 0.03, "l2": 0.001, "epochs": 700},
    {"learning_rate": 0.05, "l2": 0.003, "epochs": 500},
    {"learning_rate": 0.08, "l2": 0.006, "epochs": 400},
]


def _vectors(df: DataFrame, pre: ST.Preprocessor, target: str) -> DataFrame:
    """Standardised numeric columns + class weight column, computed from the preprocessor."""
    return df.select(
        F.coalesce(F.col("city").cast("string"), F.lit("UNKNOWN")).alias("city"),
        F.col(target).cast("double").alias("label"),
        *[standardized(pre, c).alias(f"z_{c}") for c in pre.numeric_features],
    )


def fit_logistic(train: DataFrame, target: str, l2: float, max_iter: int = 100, tol: float = 1e-6) -> LinearModel:
    """L1: preprocessing statistics + weighted MLlib fit on ``train``; returns a LinearModel."""
    pre = ST.fit_preprocessor(train, MODEL_NUMERIC_FEATURES)
    vec = _vectors(train, pre, target)
    counts = vec.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos")).first()
    n, pos = int(counts["n"]), int(counts["pos"] or 0)
    pos_f = max(1, pos)
    neg_f = max(1, n - pos_f)
    vec = vec.withColumn("w", F.when(F.col("label") == 1.0, F.lit(n / (2.0 * pos_f))).otherwise(F.lit(n / (2.0 * neg_f))))
    indexer = StringIndexer(inputCol="city", outputCol="city_idx", handleInvalid="keep", stringOrderType="alphabetAsc")
    onehot = OneHotEncoder(inputCols=["city_idx"], outputCols=["city_vec"], dropLast=True, handleInvalid="keep")
    assembler = VectorAssembler(inputCols=[f"z_{c}" for c in pre.numeric_features] + ["city_vec"], outputCol="features")
    lr = LogisticRegression(featuresCol="features", labelCol="label", weightCol="w", regParam=l2, elasticNetParam=0.0,
                            standardization=False, fitIntercept=True, maxIter=max_iter, tol=tol)
    vec = vec.persist(StorageLevel.MEMORY_AND_DISK)  # read by the indexer, encoder and every LR iteration
    fitted = Pipeline(stages=[indexer, onehot, assembler, lr]).fit(vec)
    vec.unpersist()
    labels = fitted.stages[0].labels
    lrm = fitted.stages[-1]
    coef = lrm.coefficients.toArray()
    k = len(pre.numeric_features)
    weights = {c: float(coef[i]) for i, c in enumerate(pre.numeric_features)}
    spark = train.sparkSession
    # one row per known city: the model's own size, not the data's
    city_w = spark.createDataFrame([(lab, float(coef[k + i])) for i, lab in enumerate(labels) if k + i < len(coef)],
                                   "city string, weight double")
    pre.city_categories = list(labels)
    return LinearModel(target, pre, weights, float(lrm.intercept), city_w)


@dataclass
class Fitted:
    """What a target's training ends with: the model, its decision threshold, and how both were found."""

    model: LinearModel
    threshold: float
    l2: float
    holdout: dict  # metric -> value at the threshold
    cv: dict  # l2 -> (mean average precision, number of folds that count)
    converged: bool = True


@dataclass
class Bundle:
    targets: dict[str, Fitted]
    macro_pr_auc: float
    blend_weight: float
    rows: int


def choices(scores: DataFrame, by: list[str]) -> DataFrame:
    """L2: (by..., config, mean_pr_auc, folds), one row: the best mean over its folds, the first config of equals.

    ``scores`` has one row per (by..., config, fold) with ``pr_auc``; groups without any fold take config 0.
    """
    mean = scores.groupBy(*by, "config").agg(F.avg("pr_auc").alias("mean_pr_auc"), F.count("pr_auc").alias("folds"))
    best = F.max_by(F.struct("config", "mean_pr_auc", "folds"), F.struct(F.coalesce("mean_pr_auc", F.lit(-1.0)), -F.col("config")))
    return mean.groupBy(*by).agg(best.alias("b")).select(*by, "b.config", "b.mean_pr_auc", "b.folds")


def fold_jobs(end: int, key: tuple, targets: list[str]) -> list[Job]:
    """A job for each configuration, target and fold of the rows before ``end``."""
    return [Job((*key, "cv", f, c, t), t, stop, cfg["l2"]) for f, (stop, _) in enumerate(SP.cv_folds(end)) for c, cfg in enumerate(CONFIGS) for t in targets]


def fold_scores(fits: Fits, ends: dict[tuple, int]) -> DataFrame:
    """(part, target, config, fold, pr_auc) of all fold models whose training and validation rows have both classes."""
    asked, tags = [], []
    for k, j in enumerate(fits.jobs):
        if len(j.key) < 4 or j.key[-4] != "cv":
            continue
        *key, _, fold, config, target = j.key
        if fits.both_classes(target, j.end):
            stop, valid_end = SP.cv_folds(ends[tuple(key)])[fold]
            tags.append((len(asked), str(key), target, config, fold))
            asked.append((k, stop, valid_end))
    found = {}
    if asked:
        points = M.points(fits.score(asked), ["asked"]).persist(StorageLevel.MEMORY_AND_DISK)  # curves read them some times
        found = {r["asked"]: r["pr_auc"] for r in M.curve_metrics(None, ["asked"], pts=points).where("roc_auc IS NOT NULL").collect()}  # one row a fit
        points.unpersist()
    return fits.spark.createDataFrame([(*of, found[no]) for no, *of in tags if no in found], "part string, target string, config int, fold int, pr_auc double")


def choose_config(indexed: DataFrame, n: int, targets: list[str] = TARGET_COLUMNS) -> DataFrame:
    """L2: (target, config, l2, mean_pr_auc, folds) by mean CV average precision over the W5 folds of the first n rows."""
    fits = Fits(indexed.where(F.col("row_idx") < n), fold_jobs(n, (), targets), targets)
    chosen = choices(fold_scores(fits, {(): n}), ["target"])
    best = fits.spark.createDataFrame(chosen.collect(), chosen.schema)  # one row a target
    fits.close()
    every = fits.spark.createDataFrame([(t,) for t in targets], "target string")
    l2 = F.element_at(F.array(*[F.lit(c["l2"]) for c in CONFIGS]), F.col("config") + 1)
    return every.join(best, "target", "left").fillna({"config": 0, "mean_pr_auc": -1.0, "folds": 0}).withColumn("l2", l2)


def train_models(labeled: DataFrame, holdout_fraction: float = 0.2, targets: list[str] = TARGET_COLUMNS,
                 order: list[str] = ["timestamp", "city", "telemetry_id"], refit: bool = True, embargo_rows: int = 0) -> Bundle:
    """L3 + L4: chronological split; per target the config by CV, threshold and metrics on the holdout, refit on all rows.

    All fold models run together (``fits``), then the chosen configurations' models.  ``refit=False`` keeps the models of the training rows (a
    strict comparison on the holdout); ``embargo_rows`` drops the last training rows, whose label horizon
    reaches into the holdout.
    """
    from ..operators.features import feature_frame

    table = written(feature_frame(labeled, include_targets=True, keep=[c for c in order if c not in ("city",)]), "features")
    n = table.count()
    split = SP.holdout_split_point(n, holdout_fraction)
    end = split - embargo_rows
    fits = Fits(SP.global_index(table, order), [], targets, ends=(end, split, n, *(stop for stop, _ in SP.cv_folds(end))))
    dropped(table)
    after = [a - b for a, b in zip(fits.positives[n], fits.positives[split], strict=True)]
    if lacking := {t for t, held in zip(targets, after, strict=True) if not fits.both_classes(t, end) or not 0 < held < n - split}:
        raise ValueError(f"one class only, before or after the split, for {sorted(lacking)}")
    fits.more(fold_jobs(end, (), targets))
    scores = fold_scores(fits, {(): end})
    cv = {(r["target"], r["config"]): (r["m"], r["f"]) for r in scores.groupBy("target", "config").agg(F.avg("pr_auc").alias("m"), F.count(F.lit(1)).alias("f")).collect()}
    best = dict.fromkeys(targets, 0) | {r["target"]: r["config"] for r in choices(scores, ["target"]).collect()}  # one row a target
    at = fits.more([Job((part, t), t, stop, CONFIGS[best[t]]["l2"]) for part, stop in (("train", end), *([("all", n)] if refit else [])) for t in targets])
    tags = fits.spark.createDataFrame(list(enumerate(targets)), "asked int, target string")
    held = fits.score([(at[("train", t)], split, n) for t in targets]).join(F.broadcast(tags), "asked")
    points = M.points(held, ["target"]).persist(StorageLevel.MEMORY_AND_DISK)
    thresholds = {r["target"]: r["threshold"] for r in M.curve_metrics(None, ["target"], pts=points).collect()}
    picked = points.join(F.broadcast(fits.spark.createDataFrame(list(thresholds.items()), "target string, threshold double")), "target")
    found = {r["target"]: r.asDict() | {"thr": thresholds[r["target"]]} for r in M.classification_metrics(None, ["target"], "threshold", pts=picked).collect()}
    points.unpersist()
    out = {}
    for t in targets:
        r = found[t]
        k = at[("all" if refit else "train", t)]
        out[t] = Fitted(fits.model(k), r.pop("thr"), CONFIGS[best[t]]["l2"], {k: v for k, v in r.items() if k != "target"},
                        {cfg["l2"]: cv.get((t, c), (None, 0)) for c, cfg in enumerate(CONFIGS)}, fits.weights[k].converged)
    vals = [f.holdout["pr_auc"] for f in out.values() if f.holdout["pr_auc"] is not None]
    macro = float(sum(vals) / len(vals)) if vals else 0.0
    fits.close()
    return Bundle(out, macro, max(0.40, min(0.75, 0.45 + 0.40 * macro)), n)


def params_table(bundle: Bundle) -> DataFrame:
    """(target, feature, median, mean, std, weight) + bias rows; city weights separate."""
    rows = []
    spark = None
    for t, tt in bundle.targets.items():
        m = tt.model
        spark = m.city_weights.sparkSession if m.city_weights is not None else spark
        for c in m.pre.numeric_features:
            rows.append((t, c, m.pre.medians[c], m.pre.means[c], m.pre.stds[c], m.weights[c]))
        rows.append((t, "__bias__", None, None, None, m.bias))
        rows.append((t, "__threshold__", None, None, None, tt.threshold))
    return spark.createDataFrame(rows, "target string, feature string, median double, mean double, std double, weight double")


def report_table(bundle: Bundle) -> DataFrame:
    """Long metrics table (target, metric, value) incl. macro PR-AUC and blend weight."""
    rows, spark = [("__global__", "macro_pr_auc_holdout", bundle.macro_pr_auc), ("__global__", "recommended_ml_blend_weight", bundle.blend_weight)], None
    for t, f in bundle.targets.items():
        spark = f.model.city_weights.sparkSession
        rows += [(t, k, float(v)) for k, v in f.holdout.items() if isinstance(v, (int, float))]
        rows += [(t, "threshold", f.threshold), (t, "l2", f.l2), (t, "converged", float(f.converged)), (t, "train_cv_pr_auc", float(f.cv[f.l2][0]) if f.cv[f.l2][0] is not None else -1.0)]
    return spark.createDataFrame(rows, "target string, metric string, value double")
