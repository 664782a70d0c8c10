"""Registered queries: one per operator family of SURVEY §2, each reading the given tables.

Every function takes ``(spark, sf_dir)`` and returns a DataFrame whose columns match the
corresponding oracle SQL in ``oracle_queries.py``.  Arrays are shown joined with `` | `` so both
engines print them the same way; aggregates over doubles are rounded to 6 decimals (their
summation order is not fixed across engines).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import validate as V
from ..functions.exprs import py_round
from ..operators import features as FE
from ..operators import infer as IN
from ..operators import labels as LB
from ..operators import metrics as M
from ..operators import overlay as OV
from ..operators import rules
from ..operators import splits as SP
from ..operators import stats as ST
from ..operators import weather as WE
from ..schema import INCIDENTS, LABELED, MODEL_NUMERIC_FEATURES, REQUEST, SYSTEM_SYNONYMS, SYSTEMS, TARGET_COLUMNS, TARGET_TO_SYSTEM
from ..session import written
from ..sources import fixtures as fx

SEP = " | "
R6 = 6


def joined(c: str):
    return F.array_join(F.col(c), SEP).alias(c)


def scored_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.score(fx.telemetry(spark, sf_dir))


# ---------------------------------------------------------------------------
# Rules and texts
# ---------------------------------------------------------------------------
def q_flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count and mean overall score of telemetry by city and level."""
    s = scored_telemetry(spark, sf_dir)
    return s.groupBy("city", "overall_level").agg(
        F.count(F.lit(1)).alias("n"), py_round(F.avg("overall_score"), R6).alias("mean_overall_score"))


def q_r1_r4_system_scores(spark, sf_dir):
    s = scored_telemetry(spark, sf_dir)
    cols = [F.col("telemetry_id")]
    for sys_ in SYSTEMS[:3]:
        cols += [F.col(f"{sys_}_risk_score"), F.col(f"{sys_}_level"), F.col(f"{sys_}_hits"),
                 joined(f"{sys_}_drivers"), joined(f"{sys_}_flags")]
    cols += [py_round("traffic_base_score", 2).alias("traffic_base_score"), F.col("traffic_infrastructure_hits"),
             joined("traffic_infrastructure_drivers")]
    return s.select(*cols)


def q_r5_r7_cascades_overall(spark, sf_dir):
    s = scored_telemetry(spark, sf_dir)
    return s.select("telemetry_id", joined("cascades"), "cascade_multiplier",
                    py_round("traffic_adjustment", 4).alias("traffic_adjustment"),
                    "traffic_infrastructure_risk_score", "traffic_infrastructure_level",
                    joined("traffic_infrastructure_flags"), "overall_risk_score", "overall_level")


def q_r8_confidence(spark, sf_dir):
    s = scored_telemetry(spark, sf_dir)
    return s.select("telemetry_id", joined("missing_fields"), "confidence_score")


def q_r9_r10_projection_zones(spark, sf_dir):
    s = scored_telemetry(spark, sf_dir)
    return s.select("telemetry_id", py_round("projected_score", 2).alias("projected_score"),
                    "hour_72_projection", joined("priority_zones"))


def q_t1_t5_texts(spark, sf_dir):
    s = scored_telemetry(spark, sf_dir)
    return s.select(
        "telemetry_id",
        F.array_join(F.col("ranked_systems.name"), SEP).alias("ranked_systems"),
        "hour_24_outlook", "executive_summary",
        *[rules.top_drivers_text(x).alias(f"{x}_top_drivers") for x in SYSTEMS])


# ---------------------------------------------------------------------------
# Validation, sources, features
# ---------------------------------------------------------------------------
def q_f1_validation(spark, sf_dir):
    v = V.validate(fx.telemetry(spark, sf_dir))
    return v.select("telemetry_id", "valid", joined("violations"))


def q_f3_incident_systems(spark, sf_dir):
    inc = fx.incidents(spark, sf_dir)
    norm = LB.normalize_system("system")
    return inc.select("incident_id", norm.alias("system_norm"),
                      *[F.coalesce(norm.isin(*names), F.lit(False)).alias(t) for t, names in SYSTEM_SYNONYMS.items()])


def q_f5_bool_coercion(spark, sf_dir):
    ev = fx.table(spark, sf_dir, "events")
    txt = F.expr("CASE event_id % 9 WHEN 0 THEN '1' WHEN 1 THEN ' Yes' WHEN 2 THEN 'n' WHEN 3 THEN 'FALSE' "
                 "WHEN 4 THEN '' WHEN 5 THEN 'maybe' WHEN 6 THEN '0.0' WHEN 7 THEN ' t ' ELSE NULL END")
    return ev.select("event_id", txt.alias("raw"), V.to_bool(txt).alias("flag"),
                     V.to_bool(F.col("value") - F.floor("value"), "double").alias("value_flag"))


def q_s1_p1_json_roundtrip(spark, sf_dir):
    """S1 + U5 + P1: telemetry -> nested request JSON -> typed record -> flat columns."""
    t = fx.telemetry(spark, sf_dir)
    nested = t.select("telemetry_id", F.to_json(F.struct(
        "city", "timestamp",
        F.struct("temperature_c", "humidity_percent", "heatwave_alert", "rainfall_mm").alias("weather"),
        F.struct("current_load_percent", "peak_load_percent", "historical_failure_rate_percent",
                 "transformer_age_years").alias("power_grid"),
        F.struct("pressure_variance_percent", "pipeline_age_years", "recent_repairs_last_30_days").alias("water_system"),
        F.struct("congestion_index", "signal_failure_reports_last_7_days").alias("traffic_system"),
        "population_density_per_km2")).alias("json"))
    parsed = nested.select("telemetry_id", F.from_json("json", REQUEST).alias("r")).select("telemetry_id", "r.*")
    flat = V.flatten(parsed)
    return flat.drop("timestamp")


def q_p3_features(spark, sf_dir):
    return FE.feature_frame(fx.telemetry(spark, sf_dir), keep=["telemetry_id"])


# ---------------------------------------------------------------------------
# Joins: labels, next incident, trailing counts, weather as-of
# ---------------------------------------------------------------------------
def labeled(spark, sf_dir):
    return LB.label(fx.telemetry(spark, sf_dir), fx.incidents(spark, sf_dir))


def q_j1_labels(spark, sf_dir):
    return labeled(spark, sf_dir).select("telemetry_id", *TARGET_COLUMNS)


def q_j1b_next_incident(spark, sf_dir):
    out = LB.next_incident(fx.telemetry(spark, sf_dir), fx.incidents(spark, sf_dir))
    return out.select("telemetry_id", *[(F.col(f"next_{t}") - F.col("__t_us")).alias(f"next_{t}_delta_us")
                                        for t in TARGET_COLUMNS])


def q_w8_trailing_counts(spark, sf_dir):
    """Every row asks three times: as it is, once more, and without an id; the counts are the same."""
    t = fx.telemetry(spark, sf_dir).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    t = t.withColumn("telemetry_id", F.when(F.col("copy") < 2, F.col("telemetry_id")))
    t = LB.trailing_counts(t, {"repairs_30d": (fx.repair_events(spark, sf_dir), 30), "signal_reports_7d": (fx.signal_events(spark, sf_dir), 7)})
    return t.select("telemetry_id", "repairs_30d", "signal_reports_7d")


def weather_checked(spark, sf_dir, df=None):
    df = df if df is not None else fx.telemetry(spark, sf_dir)
    j = WE.asof_weather(df.withColumn("__wk", WE.city_key("city")), fx.weather_obs(spark, sf_dir))
    return WE.weather_check(j.withColumn("__wk", WE.city_key("city")), fx.city_coords(spark, sf_dir))


def q_j2_v3_weather(spark, sf_dir):
    w = weather_checked(spark, sf_dir)
    return w.select("telemetry_id", "obs_id", "weather_status", "temperature_delta_c", "rainfall_delta_mm",
                    "weather_anomaly_flag")


def q_v4_weather_uplift(spark, sf_dir):
    w = weather_checked(spark, sf_dir, scored_telemetry(spark, sf_dir))
    u = WE.anomaly_uplift(w)
    return u.select("telemetry_id", "overall_risk_score", "overall_level",
                    F.endswith("executive_summary", F.lit(WE.UPLIFT_SUFFIX)).alias("uplift_note"))


# ---------------------------------------------------------------------------
# Statistics and pinned-model inference
# ---------------------------------------------------------------------------
def features_of(spark, sf_dir):
    return FE.feature_frame(fx.telemetry(spark, sf_dir), keep=["telemetry_id"])


def q_a1_a2_stats(spark, sf_dir):
    """A1 + A2: medians (one aggregate; 29 numbers reach the driver), then means and population
    stds of the imputed features (a second aggregate), as a long table."""
    f = features_of(spark, sf_dir)
    meds = ST.medians(f)
    mom = f.agg(*[x for c in MODEL_NUMERIC_FEATURES for x in (
        F.avg(F.coalesce(F.col(c).cast("double"), F.lit(meds[c]))).alias(f"m_{c}"),
        F.stddev_pop(F.coalesce(F.col(c).cast("double"), F.lit(meds[c]))).alias(f"s_{c}"))])
    out = mom.select(F.inline(F.array(*[F.struct(
        F.lit(c).alias("feature"), F.lit(meds[c]).alias("median"), F.col(f"m_{c}").alias("mean"),
        F.col(f"s_{c}").alias("std")) for c in MODEL_NUMERIC_FEATURES])))
    return out.select("feature", py_round("median", R6).alias("median"), py_round("mean", R6).alias("mean"),
                      py_round(F.when(F.col("std") > 1e-9, F.col("std")).otherwise(F.lit(1.0)), R6).alias("std"))


def q_a3_city_categories(spark, sf_dir):
    return ST.city_categories(features_of(spark, sf_dir))


def q_a4_a5_class_balance(spark, sf_dir):
    b = ST.class_balance(labeled(spark, sf_dir), TARGET_COLUMNS)
    return b.select("target", "n", "positives", py_round("prevalence", R6).alias("prevalence"),
                    py_round("pos_weight", R6).alias("pos_weight"), py_round("neg_weight", R6).alias("neg_weight"),
                    "has_two_classes")


# Pinned demonstration model: statistics from the data (rounded to 6 places so that every
# engine reads the same numbers), weights from a fixed rule, city weights from the city code.
def pinned_weight(j: int, ti: int) -> float:
    return ((j * 7 + ti * 3) % 13 - 6) / 20.0


def pinned_bias(ti: int) -> float:
    return -0.5 + 0.1 * ti


def pinned_models(spark, sf_dir, feats: DataFrame | None = None) -> list[IN.LinearModel]:
    feats = feats if feats is not None else features_of(spark, sf_dir)
    pre = ST.fit_preprocessor(feats)
    pre.medians = {c: round(v, 6) for c, v in pre.medians.items()}
    pre.means = {c: round(v, 6) for c, v in pre.means.items()}
    pre.stds = {c: (round(v, 6) or 1.0) for c, v in pre.stds.items()}
    # model parameters: one row per known city, by expression (a hash of the whole name, so no city is left out)
    code = F.coalesce(F.regexp_extract("city", r"^city_([0-9]+)$", 1).try_cast("long"), F.crc32(F.col("city").cast("binary")))
    cw = ST.city_categories(feats).select("city", *[(((code * 13 + ti * 5) % 21 - 10) / F.lit(100.0)).alias(f"w_{ti}") for ti in range(len(TARGET_COLUMNS))])
    return [IN.LinearModel(t, pre, {c: pinned_weight(j, ti) for j, c in enumerate(pre.numeric_features)},
                           pinned_bias(ti), cw, f"w_{ti}") for ti, t in enumerate(TARGET_COLUMNS)]


def q_m2_probabilities(spark, sf_dir):
    f = features_of(spark, sf_dir)
    out = IN.predict(f, pinned_models(spark, sf_dir, f))
    return out.select("telemetry_id", *[py_round(f"p_{t}", R6).alias(f"p_{t}") for t in TARGET_COLUMNS])


def q_m3_top_features(spark, sf_dir):
    f = features_of(spark, sf_dir)
    m = pinned_models(spark, sf_dir, f)[0]
    out = IN.top_contributions(f, m)
    # outer: the list is never empty, and no filter on its size makes the ranking run twice
    return out.select("telemetry_id", F.inline_outer("top_features"))


def rule_long(spark, sf_dir, s: DataFrame | None = None, keep: list[str] | None = None) -> DataFrame:
    """(telemetry_id, target, y, p) with the rule probability p = rounded score / 100."""
    s = s if s is not None else rules.score(labeled(spark, sf_dir))
    items = [F.struct(F.lit(TARGET_COLUMNS[0]).alias("target"), F.col(TARGET_COLUMNS[0]).alias("y"),
                      (F.col("overall_risk_score") / F.lit(100.0)).alias("p"))]
    for t, sys_ in TARGET_TO_SYSTEM.items():
        items.append(F.struct(F.lit(t).alias("target"), F.col(t).alias("y"),
                              (F.col(f"{sys_}_risk_score") / F.lit(100.0)).alias("p")))
    return s.select("telemetry_id", *(keep or []), F.inline(F.array(*items)))


def q_m4_metric_context(spark, sf_dir):
    met = M.classification_metrics(rule_long(spark, sf_dir), ["target"])
    ctx = IN.metric_context(met)
    return ctx.select(*[py_round(c, R6).alias(c) for c in ctx.columns])


def q_m5_rule_probabilities(spark, sf_dir):
    s = scored_telemetry(spark, sf_dir)
    cols = [IN.rule_probability(F.col("overall_risk_score"), 0.01, 0.94).alias(f"prob_{TARGET_COLUMNS[0]}")]
    cols += [IN.rule_probability(F.col(f"{x}_risk_score"), 0.02, 0.92).alias(f"prob_{t}")
             for t, x in TARGET_TO_SYSTEM.items()]
    return s.select("telemetry_id", *cols)


# ---------------------------------------------------------------------------
# Overlay, impact, districts, stress
# ---------------------------------------------------------------------------
BLEND = 0.5929935889
QUALITY = 0.357484


def q_v1_v2_overlay(spark, sf_dir):
    t = fx.telemetry(spark, sf_dir)
    f = FE.feature_frame(t, keep=["telemetry_id"])
    probs = IN.predict(f, pinned_models(spark, sf_dir, f)).select(
        F.col("telemetry_id").alias("__id"), *[py_round(f"p_{x}", R6).alias(f"p_{x}") for x in TARGET_COLUMNS])
    s = rules.score(t).join(probs, F.col("telemetry_id") == F.col("__id")).drop("__id")
    o = OV.ml_overlay(s, BLEND, QUALITY)
    cols = ["telemetry_id"]
    for x in SYSTEMS:
        cols += [f"{x}_risk_score", f"{x}_level", joined(f"{x}_flags")]
    return o.select(*cols, "overall_risk_score", "overall_level", "confidence_score", "executive_summary")


def q_v5_impact(spark, sf_dir):
    out = OV.impact(scored_telemetry(spark, sf_dir))
    return out.select("telemetry_id", "estimated_cost_avoided_usd_72h", "estimated_outage_hours_avoided_72h",
                      "estimated_response_time_gain_percent")


def q_v7_zone_scores(spark, sf_dir):
    return OV.zone_scores(scored_telemetry(spark, sf_dir)).select(
        "telemetry_id", "zone_id", "zone_score", "zone_level")


def q_v8_zone_flows(spark, sf_dir):
    return OV.zone_flows(scored_telemetry(spark, sf_dir)).select(
        "telemetry_id", "flow_from", "flow_to", "flow_label", "flow_strength")


def q_v9_stress(spark, sf_dir):
    st = OV.stress_scenarios(fx.telemetry(spark, sf_dir))
    s = rules.score(st)
    return s.select("telemetry_id", "scenario_type", "overall_risk_score", "overall_level",
                    *[f"{x}_risk_score" for x in SYSTEMS])


# ---------------------------------------------------------------------------
# Metrics
# ---------------------------------------------------------------------------
def rounded(df: DataFrame, keep: list[str]) -> DataFrame:
    types = dict(df.dtypes)
    return df.select(*[F.col(c) if c in keep or types[c] != "double" else py_round(c, R6).alias(c) for c in df.columns])


def predictions_long(spark, sf_dir):
    """The fixture ``predictions`` view: (telemetry_id, y, p) with y the 72 h overall label."""
    lab = labeled(spark, sf_dir)
    return lab.select("telemetry_id", F.col(TARGET_COLUMNS[0]).alias("y"),
                      ((F.col("telemetry_id") * 7919 % 1001) / F.lit(1e3)).alias("p"),
                      F.lit("predictions").alias("source"))


def q_e1_e2_rule_confusion(spark, sf_dir):
    c = M.confusion(rule_long(spark, sf_dir), ["target"], 0.5)
    return rounded(c, ["target"])


def q_e3_e4_prediction_calibration(spark, sf_dir):
    r = M.reliability(predictions_long(spark, sf_dir), ["source"])
    return rounded(r, ["source", "range_low", "range_high"])


def q_e3_rule_ece(spark, sf_dir):
    return rounded(M.ece(rule_long(spark, sf_dir), ["target"]), ["target"])


def q_e5_e7_prediction_curves(spark, sf_dir):
    return rounded(M.curve_metrics(predictions_long(spark, sf_dir), ["source"]), ["source"])


def q_e5_e7_rule_curves(spark, sf_dir):
    return rounded(M.curve_metrics(rule_long(spark, sf_dir), ["target"]), ["target"])


def q_e8_e9_e12_rule_macro(spark, sf_dir):
    met = M.classification_metrics(rule_long(spark, sf_dir), ["target"])
    agg = met.agg(F.avg("pr_auc").alias("macro_pr_auc"), F.avg("positive_rate").alias("macro_random_baseline"))
    agg = agg.withColumns({"macro_uplift": F.col("macro_pr_auc") - F.col("macro_random_baseline"),
                           "blend_weight": M.blend_weight(F.col("macro_pr_auc"))})
    return rounded(agg, [])


# ---------------------------------------------------------------------------
# Splits, backtest, comparison, history
# ---------------------------------------------------------------------------
ORDER = ["timestamp", "city", "telemetry_id"]


def indexed_labeled(spark, sf_dir):
    lab = labeled(spark, sf_dir)
    return SP.global_index(lab, ORDER)


def indexed_features(spark, sf_dir):
    """Features and labels with the chronological index, and their number; labelling runs once, the index reads its rows some times."""
    table = written(FE.feature_frame(labeled(spark, sf_dir), include_targets=True, keep=["timestamp", "telemetry_id"]), "features")
    return SP.global_index(table, ORDER), table.count()


def q_w1_w2_split(spark, sf_dir):
    idx = indexed_labeled(spark, sf_dir)
    n = idx.count()
    split = SP.holdout_split_point(n, 0.2)
    return idx.select("telemetry_id", "row_idx",
                      F.when(F.col("row_idx") < split, F.lit("train")).otherwise(F.lit("holdout")).alias("split"))


def q_w3_e10_rule_backtest(spark, sf_dir):
    """Expanding windows (W3); rule-probability metrics on each test range; mean/std over windows."""
    pts, spans = rule_block_points(spark, sf_dir)
    per = M.classification_metrics(None, ["target", "window_id"], 0.5, pts=M.merged_points(pts, ["target"], "block_id", spans))
    ms = M.mean_std(per, ["target"], ["roc_auc", "pr_auc", "brier", "f1", "ece_10_bins"])
    return rounded(ms, ["target"])


def rule_block_points(spark, sf_dir, predictions: bool = False):
    """(points of the rule probability by target and block of the test ranges, windows of each block): one scan of scored rows.

    With ``predictions`` the points of the fixture's predicted probability stand beside them, by model.
    """
    from ..session import written

    idx = indexed_labeled(spark, sf_dir)
    tests, spans = SP.window_blocks(idx, idx.count())
    long, by = rule_long(spark, sf_dir, rules.score(tests), keep=["block_id"]), ["target", "block_id"]
    if predictions:
        other = (F.col("telemetry_id") * 7919 % 1001) / F.lit(1000.0)
        both = F.array(F.struct(F.lit("rule").alias("model"), F.col("p")), F.struct(F.lit("predictions").alias("model"), other.alias("p")))
        long, by = long.select("telemetry_id", "target", "block_id", "y", F.inline(both)), ["model", *by]
    # one row a (group, block, distinct p)
    return written(M.points(long, by), "block-points"), spans


def q_e11_stability(spark, sf_dir):
    """Spread of PR-AUC over windows by model and target, and mean ECE over targets by model on all test ranges together."""
    pts, spans = rule_block_points(spark, sf_dir, predictions=True)
    per = M.classification_metrics(None, ["model", "target", "window_id"], 0.5, pts=M.merged_points(pts, ["model", "target"], "block_id", spans))
    whole = M.classification_metrics(None, ["model", "target"], 0.5, pts=M.merged_points(pts, ["model", "target"]))
    spread = M.mean_std(per, ["model", "target"], ["pr_auc"])
    std, mean_ece = M.stability(spread, whole, by=["model", "target"])
    return (std.select("model", "target", F.lit("pr_auc_std").alias("measure"), py_round("pr_auc_std", R6).alias("value"))
            .unionByName(mean_ece.select("model", F.lit("all").alias("target"), F.lit("mean_ece_10_bins").alias("measure"), py_round("mean_ece_10_bins", R6).alias("value"))))


def q_w6_w7_l6_rule_compare(spark, sf_dir, stride: int = 15, max_rows: int = 1200):
    """L6 rule-only arm: holdout (last 20 %), every 15th row, even downsample to <= 1200 rows,
    metrics at threshold .5 against the labels, macro PR-AUC vs the random baseline."""
    idx = indexed_labeled(spark, sf_dir)
    n = idx.count()
    split = SP.holdout_split_point(n, 0.2, min_train=0)
    hold = idx.where(F.col("row_idx") >= split).withColumn("h_idx", F.col("row_idx") - F.lit(split))
    strided = SP.stride_sample(hold, stride, "h_idx").withColumn("s_idx", F.col("h_idx") / F.lit(stride))
    s_len = (n - split + stride - 1) // stride
    sample = SP.even_downsample(strided.withColumn("s_idx", F.col("s_idx").cast("long")), s_len, max_rows, "s_idx")
    long = rule_long(spark, sf_dir, rules.score(sample))
    met = M.classification_metrics(long, ["target"], 0.5)
    out = met.select("target", "n", "positive_rate", "pr_auc", "roc_auc", "brier", "f1", "accuracy")
    return rounded(out, ["target"])


def q_k1_history_newest(spark, sf_dir, limit: int = 20):
    """K1: newest-N assessments (newest first) with deterministic ids; the limit is the feature."""
    s = scored_telemetry(spark, sf_dir)
    hist = s.select(F.concat(F.lit("asm_"), F.substring(F.sha2(F.concat_ws("|", F.col("telemetry_id").cast("string"),
                                                                          F.col("city")), 256), 1, 12)).alias("assessment_id"),
                    "telemetry_id", "city", "timestamp", "overall_risk_score")
    return hist.orderBy(F.col("timestamp").desc(), F.col("assessment_id")).limit(limit).drop("timestamp")


# ---------------------------------------------------------------------------
# Model fitting on MLlib (rows-only checks: converged MLlib fits are not SQL)
# ---------------------------------------------------------------------------
def q_l1_l4_train_report(spark, sf_dir):
    from . import train as TR
    return TR.report_table(TR.train_models(labeled(spark, sf_dir)))


def q_l2_config_choice(spark, sf_dir):
    from . import train as TR
    idx, n = indexed_features(spark, sf_dir)
    return TR.choose_config(idx, SP.holdout_split_point(n, 0.2)).select("target", "l2", F.col("mean_pr_auc").alias("cv_pr_auc"), "folds")


def q_l5_backtest(spark, sf_dir):
    from . import backtest as BT
    _, summary, _ = BT.backtest(labeled(spark, sf_dir))
    return summary


def q_l7_family_choice(spark, sf_dir):
    """Of each target's families: rows, folds that count, and whether the chosen one has the best mean."""
    from . import families as FM
    idx, n = indexed_features(spark, sf_dir)
    n = SP.holdout_split_point(n, 0.2)
    got = FM.choose_family(idx, n)
    best = F.max("mean_pr_auc").over(Window.partitionBy("target"))
    chosen = F.max(F.when(F.col("chosen"), F.col("mean_pr_auc"))).over(Window.partitionBy("target"))
    return got.select("target", "family", F.lit(n).cast("long").alias("rows"), "folds", F.sum(F.col("chosen").cast("long")).over(Window.partitionBy("target")).alias("n_chosen"),
                      (chosen == best).alias("chosen_is_best"), F.col("mean_pr_auc").between(0, 1).alias("in_range"))


def q_l6_compare(spark, sf_dir):
    from . import backtest as BT
    from . import train as TR
    lab = written(labeled(spark, sf_dir), "labeled")  # training and holdout read it some times
    met, _, _, _ = BT.compare(lab, TR.train_models(lab))
    return met.select("target", "model", "n", "pr_auc", "roc_auc", "brier", "f1", "ece_10_bins")


def q_u6_reasoning_prompt(spark, sf_dir):
    return rules.reasoning_prompt(scored_telemetry(spark, sf_dir)).select("telemetry_id", "reasoning_prompt")


def q_v6_assessment(spark, sf_dir):
    """V6 end to end, read out of the nested response: validation, weather, rules, pinned models, uplift, impact."""
    from .assess import assess, respond

    tel = fx.telemetry(spark, sf_dir)
    # every row occurs twice, and once more without an id
    tel = tel.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).withColumn("telemetry_id", F.when(F.col("copy") < 2, F.col("telemetry_id"))).drop("copy")
    out = assess(tel, pinned_models(spark, sf_dir), BLEND, QUALITY, fx.weather_obs(spark, sf_dir),
                 fx.city_coords(spark, sf_dir), top_features=True)
    r = respond(out, context={"macro_pr_auc_holdout": 0.5, "random_baseline_pr_auc": 0.25, "uplift_vs_baseline": 0.25}).select("telemetry_id", "response.*")
    return r.select("telemetry_id", "city", F.col("overall_risk.score").alias("overall_risk_score"), F.col("overall_risk.level").alias("overall_level"), "confidence_score",
                    F.col("external_signal.status").alias("weather_status"), "impact_model.estimated_cost_avoided_usd_72h",
                    "impact_model.estimated_outage_hours_avoided_72h", "impact_model.estimated_response_time_gain_percent",
                    F.size("ml_insights.top_features").alias("n_top_features"), F.col("ml_insights.metric_context.uplift_vs_baseline").alias("uplift_vs_baseline"),
                    F.size("impact_model.assumptions").alias("n_assumptions"))


def q_v6_rejected(spark, sf_dir):
    """Requests that the assessment quarantines, with their violations."""
    from .assess import rejected

    return rejected(fx.telemetry(spark, sf_dir)).select("telemetry_id", F.array_join("violations", SEP).alias("violations"))


def scratch(spark) -> str:
    """A fresh folder of the shared checkpoint folder."""
    import uuid

    from ..session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/q-{uuid.uuid4().hex}"


def q_s2_csv_roundtrip(spark, sf_dir):
    """Telemetry written as CSV and read back with the declared schema; by city."""
    from ..sources import io

    base = scratch(spark)
    fx.telemetry(spark, sf_dir).drop("telemetry_id").write.option("header", True).csv(base)
    t = io.read_telemetry_csv(spark, base)
    return t.groupBy("city").agg(F.count(F.lit(1)).alias("n"), F.count("temperature_c").alias("n_temperature"), F.sum("recent_repairs_last_30_days").cast("long").alias("repairs"),
                                 F.max("peak_load_percent").alias("max_peak"), F.sum(F.col("heatwave_alert").cast("int")).cast("long").alias("heatwaves"))


def q_s2_csv_incidents_labeled(spark, sf_dir):
    """Incidents and the labelled table written as CSV and read back with their declared schemas; by city."""
    from ..sources import io

    base = scratch(spark)
    io.write_csv(fx.incidents(spark, sf_dir).select(*[f.name for f in INCIDENTS.fields]), f"{base}/incidents")
    io.write_csv(labeled(spark, sf_dir).select(*[f.name for f in LABELED.fields]), f"{base}/labeled")
    inc, lab = io.read_incidents_csv(spark, f"{base}/incidents"), io.read_labeled_csv(spark, f"{base}/labeled")
    a = inc.groupBy("city").agg(F.lit("incidents").alias("source"), F.count("timestamp").alias("n"), F.sum("severity").cast("long").alias("total"), F.sum(F.length("system")).cast("long").alias("text"))
    b = lab.groupBy("city").agg(F.lit("labeled").alias("source"), F.count("timestamp").alias("n"), F.sum(sum((F.col(t) for t in TARGET_COLUMNS[1:]), F.col(TARGET_COLUMNS[0]))).cast("long").alias("total"),
                                F.count("temperature_c").alias("text"))
    return a.unionByName(b)


def q_s5_relabel(spark, sf_dir):
    """The table labelled without the newest tenth of the incidents' days, then brought up to date with them; by date, with what was rewritten."""
    from ..session import written
    from ..sources import io
    from .relabel import relabel

    base, inc = scratch(spark), fx.incidents(spark, sf_dir)
    late = F.col("timestamp") >= late_from(inc)
    io.write_labeled(LB.label(fx.telemetry(spark, sf_dir), inc.where(~late)), base)
    before = written(spark.read.parquet(base).select(F.input_file_name().alias("file")).distinct(), "files").withColumn("same", F.lit(True))
    relabel(spark, base, inc.where(late))
    back = spark.read.parquet(base).withColumn("file", F.input_file_name()).groupBy("date", "file").agg(F.count(F.lit(1)).alias("n"), *[F.sum(t).alias(t) for t in TARGET_COLUMNS])
    return back.join(before, "file", "left").groupBy(F.col("date").cast("string").alias("date")).agg(
        F.sum("n").cast("long").alias("n"), *[F.sum(t).cast("long").alias(t) for t in TARGET_COLUMNS], F.max("same").isNull().alias("rewritten"))


def late_from(incidents: DataFrame):
    """Start of the day from which incidents count as late: nine tenths of the way from the first incident's day to the last one's."""
    ends = incidents.agg(F.to_date(F.min("timestamp")).alias("a"), F.to_date(F.max("timestamp")).alias("b")).first()
    return F.date_add(F.lit(ends["a"]), (ends["b"] - ends["a"]).days * 9 // 10).cast("timestamp")


def q_s5_labeled_sink(spark, sf_dir):
    """The labelled table written by date and read back; label totals by date."""
    from ..sources import io

    base = scratch(spark)
    io.write_labeled(labeled(spark, sf_dir), base)
    back = spark.read.parquet(base)
    return back.groupBy(F.col("date").cast("string").alias("date")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(t).cast("long").alias(t) for t in TARGET_COLUMNS])


def q_s6_s7_history(spark, sf_dir):
    """Assessments appended twice in halves, lines cut off half-way among them, and read back; ids stay apart, requests and responses parse."""
    from ..sources import io

    base = scratch(spark)
    hist = io.to_history(scored_telemetry(spark, sf_dir), ["telemetry_id", "city"], ["overall_level"])
    for half in (0, 1):
        io.append_history(hist.where(F.get_json_object("request", "$.telemetry_id").cast("long") % 2 == half), base)
    # each stored line once more, as a writer that died would leave it, in a folder of the same day
    lines = hist.select("date", F.to_json(F.struct("assessment_id", "saved_at", "request", "response")).alias("line"))
    lines.select("date", F.left("line", F.expr("length(line) div 2")).alias("value")).write.mode("append").partitionBy("date").text(base)
    back = io.read_history(spark, base)
    return back.groupBy(F.get_json_object("request", "$.city").alias("city"), F.get_json_object("response", "$.overall_level").alias("overall_level")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("assessment_id").alias("n_ids"))


def q_s9_model_roundtrip(spark, sf_dir):
    """The pinned models saved, loaded and applied."""
    from ..sources import io

    base, f = scratch(spark), features_of(spark, sf_dir)
    io.save_model(pinned_models(spark, sf_dir, f), base)
    models, _ = io.load_model(spark, base)
    return IN.predict(f, models).select("telemetry_id", *[py_round(f"p_{t}", R6).alias(f"p_{t}") for t in TARGET_COLUMNS])


def q_s9_pipeline_model(spark, sf_dir):
    """The pinned models as a saved and loaded ``PipelineModel``."""
    from pyspark.ml import PipelineModel

    from ..operators.stages import pipeline_of

    base, f = scratch(spark), features_of(spark, sf_dir)
    pipeline_of(pinned_models(spark, sf_dir, f)).write().overwrite().save(base)
    return PipelineModel.load(base).transform(f).select("telemetry_id", *[py_round(f"p_{t}", R6).alias(f"p_{t}") for t in TARGET_COLUMNS])


def q_p2_bad_text(spark, sf_dir):
    """Numbers that arrive as text, some of them unreadable, some with a fraction."""
    k = F.col("event_id")
    raw = fx.table(spark, sf_dir, "events").select(k, F.when(k % 7 == 0, F.lit("n/a")).when(k % 7 == 1, F.lit("")).otherwise((k % 100).cast("string")).alias("temperature_c"),
                                                   ((k % 9) + F.when(k % 2 == 0, F.lit(0.5)).otherwise(F.lit(0.0))).alias("recent_repairs_last_30_days"))
    return V.coerce_numeric(raw)


def q_k2_sort(spark, sf_dir):
    """K2: place of each row within its city in the total order (city, time, id)."""
    from ..session import written

    s = SP.sort_by_city_time(fx.telemetry(spark, sf_dir), id_col="telemetry_id").select("telemetry_id", "city", F.monotonically_increasing_id().alias("at"))
    return SP.place_in_group(written(s, "sorted"), "city", "at").select("telemetry_id", F.col("place").cast("int").alias("place"))


def q_w7_downsample(spark, sf_dir):
    """Evenly spaced rows of the chronological index, for 100 rows and for one (the counts are the feature)."""
    idx = SP.global_index(fx.telemetry(spark, sf_dir), ORDER)
    n = idx.count()
    return (SP.even_downsample(idx, n, 100, "row_idx").select(F.lit(100).alias("wanted"), "row_idx", "telemetry_id")
            .unionByName(SP.even_downsample(idx, n, 1, "row_idx").select(F.lit(1).alias("wanted"), "row_idx", "telemetry_id")))


def q_w4_w5_folds(spark, sf_dir):
    """Window, calibration and fold bounds, with the rows and positives of each fold's training part."""
    idx = indexed_labeled(spark, sf_dir)
    n = idx.count()
    bounds = [(w, e, SP.calibration_split_point(e), f, a, b) for w, (_, e, _, _) in enumerate(SP.expanding_windows(n)) for f, (a, b) in enumerate(SP.cv_folds(SP.calibration_split_point(e)))]
    t = TARGET_COLUMNS[0]
    counts = idx.agg(*[F.sum(F.when(F.col("row_idx") < a, F.col(t))).alias(f"p{k}") for k, (*_, a, _) in enumerate(bounds)])
    items = [F.struct(*[F.lit(v).alias(c) for v, c in zip(b, ("window_id", "train_end", "calibration", "fold", "fold_train_end", "fold_valid_end"), strict=True)],
                      F.col(f"p{k}").cast("long").alias("positives")) for k, b in enumerate(bounds)]
    return counts.select(F.inline(F.array(*items)))


def q_l1_fit_checks(spark, sf_dir):
    """L1: of each target's fit on all rows: rows, positives, class weights, positive rate, and that it converged."""
    from .fits import Fits, Job

    idx, n = indexed_features(spark, sf_dir)
    fits = Fits(idx, [Job(t, t, n, 0.001) for t in TARGET_COLUMNS])
    rows = [(t, fits.count[n], int(fits.positives[n][k]), k in fits.weights and fits.weights[k].converged) for k, t in enumerate(TARGET_COLUMNS)]
    fits.close()
    made = spark.createDataFrame(rows, "target string, n long, positives long, converged boolean")
    pos, neg = F.greatest(F.col("positives"), F.lit(1)), F.greatest(F.col("n") - F.greatest(F.col("positives"), F.lit(1)), F.lit(1))
    return made.withColumns({"pos_weight": py_round(F.col("n") / (2 * pos), R6), "neg_weight": py_round(F.col("n") / (2 * neg), R6), "positive_rate": py_round(F.col("positives") / F.col("n"), R6)})


def q_x5_stream_dedupe(spark, sf_dir):
    """A stream of telemetry in which every row comes twice, deduplicated; by city."""
    from ..streaming import stream as X

    base = scratch(spark)
    tel = X.telemetry_stream(X.events_stream(spark, sf_dir)).select("city", "timestamp", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    X.run_available_now(X.dedupe(tel), f"{base}/out", f"{base}/checkpoint")
    return spark.read.schema("city string, timestamp timestamp, copy int").parquet(f"{base}/out").groupBy("city").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------------------
# Streaming (X1): the batch scoring applied to a file stream, driven to completion
# ---------------------------------------------------------------------------
def q_x1_stream_assessment(spark, sf_dir):
    import uuid

    from ..session import ensure_checkpoint_dir
    from ..streaming import stream as X

    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/x1-{uuid.uuid4().hex}"
    tel = X.telemetry_stream(X.events_stream(spark, sf_dir))
    out = rules.score(tel).select("telemetry_id", "overall_risk_score", "overall_level", "confidence_score")
    X.run_available_now(out, f"{base}/out", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out")


def _live(spark, sf_dir, name, build):
    """Rows that a stream over the replayed events has written when it has ended."""
    from ..streaming import stateful as LIVE
    from ..streaming import stream as X

    LIVE.use_rocksdb(spark)
    base = scratch(spark)
    events = X.replayed(spark, sf_dir, f"{base}/events")
    X.run_available_now(build(lambda view: X.view_stream(events, view), X.closing(events), LIVE), f"{base}/{name}", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/{name}")


def q_x1_live_assessment(spark, sf_dir):
    """V6 on a stream: validation, as-of weather with state, rules, pinned models, uplift, impact."""
    from ..functions.validate import coerce_numeric, flatten, split_valid
    from .assess import assess_matched

    models, coords = pinned_models(spark, sf_dir), fx.city_coords(spark, sf_dir)

    def build(view, ends, live):
        flat, _ = split_valid(coerce_numeric(flatten(view("telemetry"))))
        out = assess_matched(live.live_weather(flat, view("weather_obs"), ends=ends), models, BLEND, QUALITY, coords)
        return out.select("telemetry_id", "city", "overall_risk_score", "overall_level", "confidence_score", "weather_status", "estimated_cost_avoided_usd_72h",
                          "estimated_outage_hours_avoided_72h", "estimated_response_time_gain_percent")

    return _live(spark, sf_dir, "assessed", build)


def q_x3_live_labels(spark, sf_dir):
    """One labelled row a telemetry row, from state and timers."""
    return _live(spark, sf_dir, "labels", lambda view, ends, live: live.live_labels(view("telemetry"), view("incidents"), ends=ends).select("telemetry_id", *TARGET_COLUMNS))


def q_x4_live_counts(spark, sf_dir):
    """Exact trailing counts of a stream."""
    return _live(spark, sf_dir, "counts", lambda view, ends, live: live.live_counts(
        view("telemetry"), {"repairs_30d": (view("repair_events"), 30), "signal_reports_7d": (view("signal_events"), 7)}, ends=ends).select("telemetry_id", "repairs_30d", "signal_reports_7d"))


def q_x2_replayed_history(spark, sf_dir):
    """History of a stream whose query dies between a batch's write and its commit, and is started again."""
    from pyspark.errors import StreamingQueryException

    from ..sources import io
    from ..streaming import stream as X

    base = scratch(spark)
    events = X.replayed(spark, sf_dir, f"{base}/events")
    scored = rules.score(X.view_stream(events, "telemetry"))
    hist = io.to_history(scored, ["telemetry_id", "city"], ["overall_level"])

    def dies(batch_id: int) -> None:
        if batch_id == 1:
            raise RuntimeError("lost between write and commit")

    try:
        X.commit_batches(hist, f"{base}/history", f"{base}/checkpoint", "live", dies)
    except StreamingQueryException:
        X.commit_batches(hist, f"{base}/history", f"{base}/checkpoint", "live")
    back = spark.read.parquet(f"{base}/history")
    return back.groupBy(F.get_json_object("request", "$.city").alias("city"), F.get_json_object("response", "$.overall_level").alias("overall_level")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("assessment_id").alias("n_ids"))


def q_s4_timestamp_counts(spark, sf_dir):
    """Counts of one pass over telemetry whose times are text, some of it broken or missing, and what was read."""
    from pyspark.sql import Observation

    text = F.when(F.col("telemetry_id") % 50 == 0, "not a time").when(F.col("telemetry_id") % 70 != 1, F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"))
    counts, base = Observation("timestamps"), scratch(spark)
    V.parse_timestamps(fx.telemetry(spark, sf_dir).withColumn("timestamp", text), strict=False, counts=counts).select("telemetry_id", "timestamp").write.parquet(base)
    got = counts.get
    return spark.read.parquet(base).agg(F.lit(got["rows"]).cast("long").alias("rows"), F.lit(got["unparsable"]).cast("long").alias("unparsable"), F.lit(got["nulls"]).cast("long").alias("nulls"),
                                        F.count("timestamp").alias("parsed"), F.sum(F.unix_seconds("timestamp")).alias("seconds"))


def q_s8_report_versions(spark, sf_dir):
    """Two published versions of a report and a third that never got its manifest: the second is read."""
    from ..sources import io

    base, s = scratch(spark), scored_telemetry(spark, sf_dir)
    io.publish_report(s.groupBy("city").agg(F.count(F.lit(1)).alias("n")), base)
    report = s.groupBy("city", "overall_level").agg(F.count(F.lit(1)).alias("n"), py_round(F.avg("overall_score"), R6).alias("mean_overall_score"))
    io.publish_report(report, base)
    report.where("n > 1").write.parquet(f"{base}/versions/000003-broken")
    return io.read_report(spark, base)


REGISTRY = {
    "flagship_city_level": q_flagship,
    "r1_r4_system_scores": q_r1_r4_system_scores,
    "r5_r7_cascades_overall": q_r5_r7_cascades_overall,
    "r8_confidence": q_r8_confidence,
    "r9_r10_projection_zones": q_r9_r10_projection_zones,
    "t1_t5_texts": q_t1_t5_texts,
    "f1_validation": q_f1_validation,
    "f3_incident_systems": q_f3_incident_systems,
    "f5_bool_coercion": q_f5_bool_coercion,
    "s1_p1_json_roundtrip": q_s1_p1_json_roundtrip,
    "p3_features": q_p3_features,
    "j1_labels": q_j1_labels,
    "j1b_next_incident": q_j1b_next_incident,
    "w8_trailing_counts": q_w8_trailing_counts,
    "j2_v3_weather": q_j2_v3_weather,
    "v4_weather_uplift": q_v4_weather_uplift,
    "a1_a2_stats": q_a1_a2_stats,
    "a3_city_categories": q_a3_city_categories,
    "a4_a5_class_balance": q_a4_a5_class_balance,
    "m2_probabilities": q_m2_probabilities,
    "m3_top_features": q_m3_top_features,
    "m4_metric_context": q_m4_metric_context,
    "m5_rule_probabilities": q_m5_rule_probabilities,
    "v1_v2_overlay": q_v1_v2_overlay,
    "v5_impact": q_v5_impact,
    "v7_zone_scores": q_v7_zone_scores,
    "v8_zone_flows": q_v8_zone_flows,
    "s4_timestamp_counts": q_s4_timestamp_counts,
    "s8_report_versions": q_s8_report_versions,
    "x1_live_assessment": q_x1_live_assessment,
    "x2_replayed_history": q_x2_replayed_history,
    "x3_live_labels": q_x3_live_labels,
    "x4_live_counts": q_x4_live_counts,
    "v9_stress": q_v9_stress,
    "e1_e2_rule_confusion": q_e1_e2_rule_confusion,
    "e3_e4_prediction_calibration": q_e3_e4_prediction_calibration,
    "e3_rule_ece": q_e3_rule_ece,
    "e5_e7_prediction_curves": q_e5_e7_prediction_curves,
    "e5_e7_rule_curves": q_e5_e7_rule_curves,
    "e8_e9_e12_rule_macro": q_e8_e9_e12_rule_macro,
    "w1_w2_split": q_w1_w2_split,
    "w3_e10_rule_backtest": q_w3_e10_rule_backtest,
    "e11_stability": q_e11_stability,
    "w6_w7_l6_rule_compare": q_w6_w7_l6_rule_compare,
    "k1_history_newest": q_k1_history_newest,
    "u6_reasoning_prompt": q_u6_reasoning_prompt,
    "l1_l4_train_report": q_l1_l4_train_report,
    "l2_config_choice": q_l2_config_choice,
    "l5_backtest": q_l5_backtest,
    "l6_compare": q_l6_compare,
    "l7_family_choice": q_l7_family_choice,
    "x1_stream_assessment": q_x1_stream_assessment,
    "v6_assessment": q_v6_assessment,
    "v6_rejected": q_v6_rejected,
    "s2_csv_roundtrip": q_s2_csv_roundtrip,
    "s2_csv_incidents_labeled": q_s2_csv_incidents_labeled,
    "s5_labeled_sink": q_s5_labeled_sink,
    "s5_relabel": q_s5_relabel,
    "s6_s7_history": q_s6_s7_history,
    "s9_model_roundtrip": q_s9_model_roundtrip,
    "s9_pipeline_model": q_s9_pipeline_model,
    "p2_bad_text": q_p2_bad_text,
    "k2_sort": q_k2_sort,
    "w7_downsample": q_w7_downsample,
    "w4_w5_folds": q_w4_w5_folds,
    "l1_fit_checks": q_l1_fit_checks,
    "x5_stream_dedupe": q_x5_stream_dedupe,
}
