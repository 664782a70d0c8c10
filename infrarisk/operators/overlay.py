"""Hybrid overlay (V1, V2), impact model (V5), district zones and flows (V7, V8), stress what-if (V9).

All row-local projections; fixed-size fan-outs (5 zones, 3 flows, 5 scenarios) use ``inline`` over
literal arrays instead of joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import add_all, clip, fmt, level, nz, py_round
from ..schema import FLOWS, SYSTEMS, TARGET_TO_SYSTEM, ZONES

OVERALL_TARGET = "overall_failure_72h_label"
QUALITY_SUFFIX = (" ML overlay active with calibrated macro quality score ", "/100.")
NO_QUALITY_SUFFIX = " ML overlay active for probability calibration."


def ml_overlay(df: DataFrame, blend_weight: float, quality: float | None = None, prefix: str = "p_") -> DataFrame:
    """V1 + V2.  Probability columns ``{prefix}{target}`` (null = target missing, skipped).

    blended = clip((1 - a) * rounded rule score + a * clip(100 p)); stored rounded to 2, level from
    the unrounded blend; a flag ``ml_overlay_<target>=<ml .1f>_blend=<a .2f>`` is appended.  Texts
    computed before the overlay (outlook, projection, zones, summary body) are kept as they are.
    """
    a = max(0.0, min(1.0, blend_weight))
    alpha, rule_w = F.lit(a), F.lit(1.0 - a)
    a_txt = f"{a:.2f}"
    cols = {}
    present = []
    for target, system in TARGET_TO_SYSTEM.items():
        pcol = f"{prefix}{target}"
        if pcol not in df.columns:
            continue
        p = F.col(pcol)
        present.append(p.isNotNull())
        ml = clip(p * F.lit(100.0))
        blended = clip(rule_w * F.col(f"{system}_risk_score") + alpha * ml)
        has = p.isNotNull()
        cols[f"{system}_risk_score"] = F.when(has, py_round(blended, 2)).otherwise(F.col(f"{system}_risk_score"))
        cols[f"{system}_level"] = F.when(has, level(blended)).otherwise(F.col(f"{system}_level"))
        cols[f"{system}_flags"] = F.when(has, F.concat(F.col(f"{system}_flags"), F.array(
            F.concat(F.lit(f"ml_overlay_{target}="), fmt(ml, 1), F.lit(f"_blend={a_txt}"))))
        ).otherwise(F.col(f"{system}_flags"))
    pcol = f"{prefix}{OVERALL_TARGET}"
    if pcol in df.columns:
        p = F.col(pcol)
        present.append(p.isNotNull())
        blended = clip(rule_w * F.col("overall_risk_score") + alpha * clip(p * F.lit(100.0)))
        cols["overall_risk_score"] = F.when(p.isNotNull(), py_round(blended, 2)).otherwise(F.col("overall_risk_score"))
        cols["overall_level"] = F.when(p.isNotNull(), level(blended)).otherwise(F.col("overall_level"))
    if not present:
        return df
    any_p = present[0]
    for x in present[1:]:
        any_p = any_p | x
    if quality is not None:
        q = max(0.0, min(100.0, quality * 100.0))
        shift = F.bround(F.lit((q - 50.0) / 10.0), 0).cast("int")
        cols["confidence_score"] = F.when(any_p, clip(F.col("confidence_score") + shift, 0, 100).cast("int")).otherwise(
            F.col("confidence_score"))
        suffix = F.concat(F.lit(QUALITY_SUFFIX[0]), fmt(F.lit(q), 1), F.lit(QUALITY_SUFFIX[1]))
    else:
        suffix = F.lit(NO_QUALITY_SUFFIX)
    cols["executive_summary"] = F.when(any_p, F.concat(F.col("executive_summary"), suffix)).otherwise(
        F.col("executive_summary"))
    cols["ml_overlay_active"] = any_p
    return df.withColumns(cols)


# ---------------------------------------------------------------------------
# Impact model constants
# ---------------------------------------------------------------------------
IMPACT_ASSUMPTIONS = [
    "Impact estimates are heuristic planning values, not audited financial statements.",
    "Service interruption cost per hour scales with density and critical infrastructure overlap.",
    "Estimated gains assume pre-emptive intervention is executed within 24-hour recommendations.",
]


def impact(df: DataFrame) -> DataFrame:
    """V5 over the final rounded system scores, cascade count and confidence."""
    dens = nz("population_density_per_km2")
    dfac = F.greatest(F.lit(0.6), F.least(F.lit(2.5), F.when(dens > 0, dens / F.lit(10000.0)).otherwise(F.lit(1.0))))
    n = F.size("cascades").cast("double")
    cfac = F.lit(1.0) + F.least(F.lit(0.6), F.lit(0.12) * n)
    sc = {s: F.col(f"{s}_risk_score") for s in SYSTEMS}
    wp = add_all([F.lit(0.34) * sc["power_grid"], F.lit(0.16) * sc["transformer_overload"],
                  F.lit(0.24) * sc["water_pipeline"], F.lit(0.26) * sc["traffic_infrastructure"]])
    hours = (wp / F.lit(100.0)) * (F.lit(6.5) * dfac) * cfac
    capture = F.lit(0.22) + F.lit(0.28) * (F.col("confidence_score").cast("double") / F.lit(100.0))
    avoided = hours * capture
    cost = avoided * (F.lit(45000.0) * dfac)
    gain = F.least(F.lit(45.0), F.lit(5.0) + (F.lit(0.21) * sc["traffic_infrastructure"]) + (F.lit(1.8) * n))
    return df.withColumns({
        "estimated_cost_avoided_usd_72h": py_round(F.greatest(F.lit(0.0), cost), 2),
        "estimated_outage_hours_avoided_72h": py_round(F.greatest(F.lit(0.0), avoided), 2),
        "estimated_response_time_gain_percent": py_round(F.greatest(F.lit(0.0), gain), 2),
        "impact_assumptions": F.array(*[F.lit(a) for a in IMPACT_ASSUMPTIONS]),
    })


def zone_scores(df: DataFrame) -> DataFrame:
    """V7: one row per input row and district: clip(mix . systems + bias + cascade boost)."""
    sc = {s: F.col(f"{s}_risk_score") for s in SYSTEMS}
    n = F.size("cascades").cast("double")
    items = []
    for zid, name, mp, mt, mw, mr, bias, sensitive in ZONES:
        weighted = add_all([F.lit(mp) * sc["power_grid"], F.lit(mt) * sc["transformer_overload"],
                            F.lit(mw) * sc["water_pipeline"], F.lit(mr) * sc["traffic_infrastructure"]])
        boost = F.least(F.lit(8.0), n * F.lit(1.4)) if sensitive else F.least(F.lit(4.0), n)
        score = clip(weighted + F.lit(bias) + boost)
        items.append(F.struct(F.lit(zid).alias("zone_id"), F.lit(name).alias("zone_name"),
                              score.alias("zone_score"), level(score).alias("zone_level"),
                              F.lit(sensitive).alias("cascade_sensitive")))
    return df.select("*", F.inline(F.array(*items)))


def zone_flows(df: DataFrame) -> DataFrame:
    """V8: one row per input row and dependency flow: min(.95, (.5 if an end is sensitive else .35) + .07 n)."""
    sens = {z[0]: z[7] for z in ZONES}
    n = F.size("cascades").cast("double")
    items = []
    for src, dst, label in FLOWS:
        base = 0.5 if (sens[src] or sens[dst]) else 0.35
        items.append(F.struct(F.lit(src).alias("flow_from"), F.lit(dst).alias("flow_to"), F.lit(label).alias("flow_label"),
                              F.least(F.lit(0.95), F.lit(base) + n * F.lit(0.07)).alias("flow_strength")))
    return df.select("*", F.inline(F.array(*items)))


# ---------------------------------------------------------------------------
# Scenario types in order; what each stage overrides, in application order
# ---------------------------------------------------------------------------
SCENARIO_TYPES = ["baseline", "heatwave", "high_density", "failure_event", "compound"]
# (field, percentile of the city's own values); the heat alert is set
STAGES = {
    "heatwave": [("temperature_c", 95), ("humidity_percent", 25), ("rainfall_mm", 5), ("current_load_percent", 95), ("peak_load_percent", 95), ("congestion_index", 75)],
    "high_density": [("population_density_per_km2", 95), ("congestion_index", 95), ("signal_failure_reports_last_7_days", 95), ("pressure_variance_percent", 75)],
    "failure_event": [("historical_failure_rate_percent", 95), ("transformer_age_years", 95), ("recent_repairs_last_30_days", 95), ("rainfall_mm", 95), ("pressure_variance_percent", 95)],
}


def stress_levels(df: DataFrame) -> DataFrame:
    """V9: (stress_city, stress_levels), one row a city: the smallest value of a field, rounded to 1, that the
    stage's percentage of the city's values does not exceed; null where a city has no value of a field.

    Values are counted by (city, field, value) before the shuffle, so the running counts of a city go through the
    distinct values of a validated field (its range in steps of 0.1), not through its rows.
    """
    pairs = sorted({pair for fields in STAGES.values() for pair in fields})
    value = lambda c: F.when(~F.isnan(F.col(c).cast("double")), py_round(F.col(c).cast("double"), 1))
    long = df.select(F.col("city").alias("stress_city"), F.inline(F.array(*[F.struct(F.lit(c).alias("field"), value(c).alias("value")) for c in sorted({c for c, _ in pairs})])))
    points = long.where("value IS NOT NULL").groupBy("stress_city", "field", "value").agg(F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy("stress_city", "field")
    ranked = points.withColumns({"upto": F.sum("n").over(group.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("n").over(group)})
    level = [F.min(F.when((F.col("field") == c) & (F.col("upto") * 100 >= F.col("total") * q), F.col("value"))).alias(f"{c}_{q}") for c, q in pairs]
    return ranked.groupBy("stress_city").agg(F.struct(*level).alias("stress_levels"))


def stress_scenarios(df: DataFrame, levels: DataFrame | None = None) -> DataFrame:
    """V9: each row x 5 scenario types, under its city's own extremes (``levels``, by default those of ``df``).

    Compound applies heatwave, high density, failure event in that order, later wins; a field without a level keeps its
    value.  Rescore with ``rules.score`` afterwards.
    """
    levels = stress_levels(df) if levels is None else levels
    out = df.join(levels, F.col("city").eqNullSafe(F.col("stress_city")), "left")
    out = out.withColumn("scenario_type", F.explode(F.array(*[F.lit(s) for s in SCENARIO_TYPES])))
    for stage, fields in STAGES.items():
        on = F.col("scenario_type").isin(stage, "compound")
        cols = {c: F.when(on, F.coalesce(F.col(f"stress_levels.{c}_{q}").cast(df.schema[c].dataType), F.col(c))).otherwise(F.col(c)) for c, q in fields}
        if stage == "heatwave":
            cols["heatwave_alert"] = F.when(on, F.lit(True)).otherwise(F.col("heatwave_alert"))
        out = out.withColumns(cols)
    return out.drop("stress_city", "stress_levels")
