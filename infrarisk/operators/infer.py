"""Model inference with pinned parameters (M1-M5).

A linear model is a handful of numbers per target (29 feature weights, bias, imputation and
scaling statistics) plus one weight per city.  Feature weights become literals in one fixed-order
expression (bit-for-bit repeatable); city weights are a dimension table joined on the city
(AQE broadcasts it when small).  No UDF, no shuffle of the telemetry beyond that join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import add_all, clip, py_round
from .stats import Preprocessor


@dataclass
class LinearModel:
    target: str
    pre: Preprocessor
    weights: dict[str, float]
    bias: float
    city_weights: DataFrame | None = None  # (city, <weight column>); unknown city -> 0
    city_weight_col: str = "weight"        # several models may share one table, one column each


def standardized(pre: Preprocessor, c: str) -> Column:
    """M1: median impute, then (x - mean) / std (std <= 0 -> 1)."""
    std = pre.stds[c] if pre.stds[c] > 0 else 1.0
    x = F.coalesce(F.col(c).cast("double"), F.lit(pre.medians[c]))
    return (x - F.lit(pre.means[c])) / F.lit(std)


def sigmoid(z: Column) -> Column:
    z = F.least(F.greatest(z, F.lit(-35.0)), F.lit(35.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _with_city_weight(df: DataFrame, model: LinearModel, name: str) -> DataFrame:
    return _with_city_weights(df, [model], [name])


def _with_city_weights(df: DataFrame, models: list[LinearModel], names: list[str]) -> DataFrame:
    """One left join per distinct city-weight table (a dimension: one row per known city)."""
    tables: dict[int, tuple[DataFrame, list[tuple[str, str]]]] = {}
    out = df
    for m, name in zip(models, names):
        if m.city_weights is None:
            out = out.withColumn(name, F.lit(0.0))
        else:
            tables.setdefault(id(m.city_weights), (m.city_weights, []))[1].append((m.city_weight_col, name))
    for k, (tbl, cols) in enumerate(tables.values()):
        key = f"__ck{k}"
        dim = tbl.select(F.col("city").alias(key), *[F.col(c).alias(n) for c, n in cols])
        out = out.join(dim, F.col("city") == F.col(key), "left").drop(key)
        out = out.withColumns({n: F.coalesce(F.col(n), F.lit(0.0)) for _, n in cols})
    return out


def logit(model: LinearModel, city_weight_col: str, z: dict[str, str] | None = None) -> Column:
    """x.w + b in a fixed order; ``z`` names precomputed standardised columns (shared by models
    with the same preprocessor, so the projection does not repeat them per model)."""
    terms = [F.lit(model.weights[c]) * (F.col(z[c]) if z else standardized(model.pre, c))
             for c in model.pre.numeric_features]
    return add_all(terms + [F.col(city_weight_col), F.lit(model.bias)])


def predict(df: DataFrame, models: list[LinearModel], prefix: str = "p_") -> DataFrame:
    """M2: one probability column per model: sigmoid(clip(x.w + b, -35, 35)), clipped to [0, 1]."""
    out, zmaps = df, {}
    for m in models:
        if id(m.pre) not in zmaps:
            k = len(zmaps)
            zmaps[id(m.pre)] = {c: f"__z{k}_{j}" for j, c in enumerate(m.pre.numeric_features)}
            out = out.withColumns({name: standardized(m.pre, c) for c, name in zmaps[id(m.pre)].items()})
    cws = [f"__cw{i}" for i in range(len(models))]
    out = _with_city_weights(out, models, cws)
    out = out.withColumns({f"{prefix}{m.target}": clip(sigmoid(logit(m, cw, zmaps[id(m.pre)])), 0.0, 1.0)
                           for m, cw in zip(models, cws)})
    return out.drop(*cws, *[n for zm in zmaps.values() for n in zm.values()])


def top_contributions(df: DataFrame, model: LinearModel, k: int = 5, name: str = "top_features") -> DataFrame:
    """M3: top-k |x_j w_j| of one model as an array of structs (rank, feature, impact, direction,
    logit_contribution); ties keep feature order.  Row-local: arrays, no shuffle, no collect.

    Sizes and positions are sorted as one zipped array, and every step is a projection of its own whose columns the next one
    uses more than once, so the optimizer keeps the steps apart: a sum inside the lambda of the result, or a result used once,
    was computed again for each element.
    """
    terms = [standardized(model.pre, c) * F.lit(model.weights[c]) for c in model.pre.numeric_features]
    n = len(terms) + 1
    out = _with_city_weight(df, model, "__cw").withColumn("__c", F.array(*terms, F.col("__cw")))
    out = out.withColumn("__size", F.transform("__c", lambda c: -F.abs(c)))
    out = out.withColumn("__ranked", F.sort_array(F.arrays_zip(F.col("__size").alias("k"), F.array(*[F.lit(i) for i in range(n)]).alias("pos"))))
    denom = F.aggregate("__ranked", F.lit(0.0), lambda acc, s: acc - s["k"])
    out = out.withColumn("__denom", denom)
    names = F.array(*[F.lit(c) for c in model.pre.numeric_features])

    def entry(i: int):
        pos = F.get("__ranked", F.lit(i))["pos"]
        c = F.get("__c", pos)
        return F.struct(
            F.lit(i + 1).alias("rank"), F.coalesce(F.get(names, pos), F.concat(F.lit("city="), F.col("city"))).alias("feature"),
            py_round(F.abs(c) / F.when(F.col("__denom") == 0, F.lit(1.0)).otherwise(F.col("__denom")), 4).alias("impact"),
            F.when(c >= 0, F.lit("increases_risk")).otherwise(F.lit("reduces_risk")).alias("direction"),
            py_round(c, 4).alias("logit_contribution"))

    top = F.array(*[entry(i) for i in range(min(k, n))])
    return out.withColumn(name, top).drop("__cw", "__c", "__size", "__ranked", "__denom")


def rule_probability(score: Column, base: float, scale: float) -> Column:
    """M5: clip(base + scale * score / 100, .01, .99); (.02, .92) for systems, (.01, .94) overall."""
    return clip(F.lit(base) + F.lit(scale) * (score / F.lit(100.0)), 0.01, 0.99)


def metric_context(metrics: DataFrame, pr_auc: str = "pr_auc", positive_rate: str = "positive_rate") -> DataFrame:
    """M4: macro holdout PR-AUC, mean holdout positive rate (random baseline), uplift."""
    return (metrics.agg(F.avg(pr_auc).alias("macro_pr_auc_holdout"),
                        F.avg(positive_rate).alias("random_baseline_pr_auc"))
            .withColumn("uplift_vs_baseline", F.col("macro_pr_auc_holdout") - F.col("random_baseline_pr_auc")))
