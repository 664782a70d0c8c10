"""End-to-end assessment (V6): validation -> as-of weather -> rules -> model overlay -> uplift -> impact.

Requests are validated first; rejected ones are a result of their own.  The weather as-of join runs on the validated input
columns, before anything is scored, and leaves its match in the row: one row in, one row out, whatever the ids.  Everything
else is projections and dimension joins.  Texts computed by the rules (outlook, projection, zones, summary body) are not
recomputed after the overlay, as in the modelled service.  ``respond`` nests the flat result into the response record.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import validate as V
from ..functions.validate import coerce_numeric, flatten
from ..operators import features as FE
from ..operators import infer as IN
from ..operators import overlay as OV
from ..operators import rules
from ..operators import weather as WE
from ..schema import SYSTEMS


def assess(
    requests: DataFrame,
    models: list[IN.LinearModel] | None = None,
    blend_weight: float = 0.55,
    quality: float | None = None,
    weather_obs: DataFrame | None = None,
    city_coords: DataFrame | None = None,
    top_features: bool = False,
) -> DataFrame:
    """Assess the valid ones of nested requests (D1) or flat telemetry."""
    flat, _ = V.split_valid(coerce_numeric(flatten(requests)))
    external = weather_obs is not None and city_coords is not None
    if external:
        flat = WE.asof_weather(flat, weather_obs).drop("__wk")
    return assess_matched(flat, models, blend_weight, quality, city_coords if external else None, top_features)


def assess_matched(
    flat: DataFrame,
    models: list[IN.LinearModel] | None = None,
    blend_weight: float = 0.55,
    quality: float | None = None,
    city_coords: DataFrame | None = None,
    top_features: bool = False,
) -> DataFrame:
    """The rest of the assessment of valid telemetry, without state: the same for a table and for a stream.

    With ``city_coords`` the rows carry the columns of ``asof_weather``.
    """
    out = rules.score(flat)
    if models:
        feats = FE.engineered(out).withColumn("city", F.coalesce(F.col("city").cast("string"), F.lit("UNKNOWN")))
        probs = IN.predict(feats, models)
        if top_features:
            overall = [m for m in models if m.target == OV.OVERALL_TARGET]
            if overall:
                probs = IN.top_contributions(probs, overall[0])
        # engineered feature columns are dropped again; probabilities and insights stay
        extra = [c for c in probs.columns if c not in out.columns and (c.startswith("p_") or c == "top_features")]
        out = OV.ml_overlay(probs.select(*out.columns, *extra), blend_weight, quality)
    if city_coords is not None:
        # the join of the coordinates also keeps the optimizer from folding scores into every use of the check
        out = WE.weather_check(out.withColumn("__wk", WE.city_key("city")), city_coords)
        out = WE.anomaly_uplift(out)
    return OV.impact(out)


def rejected(requests: DataFrame) -> DataFrame:
    """The requests that ``assess`` leaves out, with their ``violations``."""
    return V.split_valid(coerce_numeric(flatten(requests)))[1]


def respond(assessed: DataFrame, id_col: str = "telemetry_id", context: dict | None = None) -> DataFrame:
    """(id, response) with the nested record; parts that were not computed are null.

    ``context`` holds the metric context of the models (macro_pr_auc_holdout, random_baseline_pr_auc, uplift_vs_baseline).
    """
    have = set(assessed.columns)
    optional = lambda need, made: made if need <= have else F.lit(None).cast("string")
    system = lambda s: F.struct(F.col(f"{s}_risk_score").alias("risk_score"), F.col(f"{s}_level").alias("risk_level"),
                                F.col(f"{s}_drivers").alias("primary_drivers"), F.col(f"{s}_flags").alias("compound_flags")).alias(s)
    overall = F.struct(F.col("overall_risk_score").alias("score"), F.col("overall_level").alias("level"),
                       F.col("hour_24_outlook").alias("24_hour_outlook"), F.col("hour_72_projection").alias("72_hour_projection"))
    context_names = ("macro_pr_auc_holdout", "random_baseline_pr_auc", "uplift_vs_baseline")
    metric = F.struct(*[F.lit(context[k]).alias(k) for k in context_names]) if context else F.lit(None).cast("struct<" + ", ".join(f"{k}: double" for k in context_names) + ">")
    insight = lambda t: F.struct(*[t.getField(k).alias(k) for k in ("feature", "impact", "direction", "logit_contribution")])
    details = ("mapped_latitude", "mapped_longitude", "external_temperature_c", "external_precipitation_mm", "external_wind_speed_kmh",
               "temperature_delta_c", "rainfall_delta_mm", "weather_anomaly_flag")
    return assessed.select(id_col, F.struct(
        "city", "timestamp", overall.alias("overall_risk"), F.struct(*[system(s) for s in SYSTEMS]).alias("systems"),
        F.col("cascades").alias("cascading_failure_risks"), F.col("priority_zones").alias("priority_intervention_zones"), "executive_summary", "confidence_score",
        optional({"top_features"}, F.struct(F.transform("top_features", insight).alias("top_features"), metric.alias("metric_context")) if "top_features" in have else None).alias("ml_insights"),
        F.struct("estimated_cost_avoided_usd_72h", "estimated_outage_hours_avoided_72h", "estimated_response_time_gain_percent",
                 F.col("impact_assumptions").alias("assumptions")).alias("impact_model"),
        optional({"weather_status"}, F.struct(F.col("signal_source").alias("source"), "signal_type", F.col("weather_status").alias("status"), F.col("observed_at").alias("retrieved_at"),
                                              F.struct(*details).alias("details"), "influence_note") if "weather_status" in have else None).alias("external_signal"),
    ).alias("response"))
