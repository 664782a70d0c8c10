"""Choice of a model family (L7): balanced logistic regression, random forest or extra trees, by mean average precision.

Each family is fitted before, and scored on, every fold of an expanding time-series split; folds with one class in
either part do not count, and the best mean wins (the first of equals).  All families see the same rows, imputed values and
class weights (``fits.Ranges``), the city in ``TREE_CITY_WIDTH`` buckets.  Logistic models are fits of ``fits``.  Forests grow
for all targets and folds at once (``forest.py``); extra trees are grown without bootstrap, on quantile bins instead of random
thresholds.  Trees and depth are parameters, since the modelled 500 unbounded trees are a budget, not a meaning.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..schema import TARGET_COLUMNS
from . import forest as FO
from .fits import Fits, Job

TREE_CITY_WIDTH = 256  # a tree looks at every column's bins: fewer city buckets than for linear models


@dataclass(frozen=True)
class Forest:
    trees: int = 20
    depth: int = 6
    seed: int = 42


# Families in order, least rows of a leaf
FAMILIES = ["logistic_balanced", "random_forest_balanced", "extra_trees_balanced"]
L2 = 0.001
LEAST_IN_LEAF = {"random_forest_balanced": 3, "extra_trees_balanced": 2}


def time_series_folds(n: int, n_splits: int = 5, least: int = 40) -> list[tuple[int, int]]:
    """(train_end, valid_end) of each fold: equal validation parts at the end, each after all rows before it.

    As many folds as ``n_splits``, fewer where a part would be below ``least`` rows (two at least), none below 2 * least rows.
    """
    if n < 2 * least:
        return []
    k = min(n_splits, max(2, n // least))
    part = n // (k + 1)
    return [(n - part * i, n - part * (i - 1)) for i in range(k, 0, -1)]


def quantiles(fits: Fits, end: int) -> list[np.ndarray]:
    """Ends of each feature's bins over the range's rows, missing values being the median."""
    x = lambda k: F.coalesce(F.when(~F.isnan(f"x{k}"), F.col(f"x{k}")), F.lit(float(fits.pre[end][0][k])))
    shares = F.lit([i / FO.BINS for i in range(1, FO.BINS)]).cast("array<double>")
    got = fits.data.where(F.col("row") < end).agg(*[F.percentile_approx(x(k), shares, 1000).alias(f"x{k}") for k in range(len(fits.features))]).first()
    return [np.unique(v) for v in got]


def choose_family(indexed: DataFrame, n: int, targets: list[str] = TARGET_COLUMNS, families: list[str] = FAMILIES, forest: Forest = Forest()) -> DataFrame:
    """(target, family, folds, mean_pr_auc, chosen) over the first n rows; a target without any fold chooses none.

    Models of a family are fitted for all targets and folds together; one grouped job makes all curves.
    """
    folds = time_series_folds(n)
    spark = indexed.sparkSession
    every = spark.createDataFrame([(t, f, k) for t in targets for k, f in enumerate(families)], "target string, family string, no int")
    found = []
    if folds:
        fits = Fits(indexed.where(F.col("row_idx") < n), [], targets, width=TREE_CITY_WIDTH, ends=(*(e for e, _ in folds), n))
        usable = [(t, end, stop) for end, stop in folds for t in targets if fits.both_classes(t, end)]
        at = fits.more([Job((t, end), t, end, L2) for t, end, _ in usable]) if "logistic_balanced" in families else {}
        linear = [(at[t, end], end, stop) for t, end, stop in usable if at]
        tags = [(k, usable[k][0], "logistic_balanced") for k in range(len(linear))]
        cuts = {end: quantiles(fits, end) for end in sorted({end for _, end, _ in usable})}
        grown = []
        for family in families:
            if family in LEAST_IN_LEAF:
                for t, end, stop in usable:
                    grown.append((len(tags), FO.Forest(fits.ends.index(end), targets.index(t), fits.class_weights(t, end), fits.pre[end][0], cuts[end], family == "random_forest_balanced",
                                                       LEAST_IN_LEAF[family], forest.trees, forest.depth, forest.seed), end, stop))
                    tags.append((len(tags), t, family))
        FO.grow(fits.matrices(), [g for _, g, _, _ in grown], len(fits.features), fits.width)
        scored = FO.score(fits.matrices(), grown)
        if linear:
            scored = scored.unionByName(fits.score(linear))
        points = M.points(scored, ["asked"]).persist(StorageLevel.MEMORY_AND_DISK)  # curves read them some times
        score = {r["asked"]: r["pr_auc"] for r in M.curve_metrics(None, ["asked"], pts=points).where("roc_auc IS NOT NULL").collect()}  # one row a model
        points.unpersist()
        fits.close()
        found = [(t, f, score[k]) for k, t, f in tags if k in score]
    scores = spark.createDataFrame(found, "target string, family string, pr_auc double")
    mean = every.join(scores, ["target", "family"], "left").groupBy("target", "family", "no").agg(F.count("pr_auc").alias("folds"), F.avg("pr_auc").alias("mean_pr_auc"))
    best = mean.where("folds > 0").groupBy("target").agg(F.max_by("no", F.struct("mean_pr_auc", -F.col("no"))).alias("best"))
    return mean.join(best, "target", "left").select("target", "family", "folds", "mean_pr_auc", F.coalesce(F.col("no") == F.col("best"), F.lit(False)).alias("chosen"))
