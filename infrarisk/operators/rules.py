"""Rule scoring (R1-R10) and row-level texts (T1-T5) as one set-at-a-time projection.

Input: flat telemetry (D2 columns). Output adds, per system ``s`` in SYSTEMS:
``s_score`` (unrounded), ``s_risk_score`` (rounded 2), ``s_level``, ``s_drivers``, ``s_flags``,
``s_hits``; plus ``missing_fields``, ``cascades``, ``cascade_multiplier``, ``traffic_adjustment``,
``overall_score``/``overall_risk_score``/``overall_level``, ``confidence_score``, ``projected_score``,
``hour_24_outlook``, ``hour_72_projection``, ``priority_zones``, ``executive_summary``.

The work is split into a few ``withColumns`` layers so each whole-stage-codegen method stays small.
Nothing here shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import add_all, clip, compact, flag, fmt, json_number, level, nz, py_round
from ..schema import NESTED_FIELDS, SYSTEMS

# ---------------------------------------------------------------------------
# Rule catalogue.
# Per system: base weights, then rules in order (driver text, input, threshold, bonus),
# amplification flag prefix and default driver.  A threshold of None means "input is true".
# ---------------------------------------------------------------------------
POWER_RULES = [
    ("current_load_percent>85", "current_load_percent", 85, 8.0),
    ("peak_load_percent>90", "peak_load_percent", 90, 7.0),
    ("transformer_age_years>20", "transformer_age_years", 20, 6.0),
    ("heatwave_alert=true", "heatwave_alert", None, 5.0),
    ("historical_failure_rate_percent>15", "historical_failure_rate_percent", 15, 6.0),
]
TRANSFORMER_RULES = [
    ("peak_load_percent>90", "peak_load_percent", 90, 10.0),
    ("current_load_percent>85", "current_load_percent", 85, 8.0),
    ("transformer_age_years>20", "transformer_age_years", 20, 9.0),
    ("historical_failure_rate_percent>15", "historical_failure_rate_percent", 15, 4.0),
    ("heatwave_alert=true", "heatwave_alert", None, 4.0),
]
WATER_RULES = [
    ("pressure_variance_percent>30", "pressure_variance_percent", 30, 10.0),
    ("pipeline_age_years>25", "pipeline_age_years", 25, 9.0),
    ("rainfall_mm>40", "rainfall_mm", 40, 8.0),
    ("recent_repairs_last_30_days>3", "recent_repairs_last_30_days", 3, 7.0),
]
TRAFFIC_RULES = [
    ("congestion_index>75", "congestion_index", 75, 10.0),
    ("signal_failure_reports_last_7_days>5", "signal_failure_reports_last_7_days", 5, 8.0),
    ("population_density_per_km2>10000", "population_density_per_km2", 10000, 7.0),
]
FLAG_PREFIX = {
    "power_grid": "multi_factor_amplification_",
    "transformer_overload": "overload_intersection_amplification_",
    "water_pipeline": "water_stress_compound_amplification_",
    "traffic_infrastructure": "traffic_compound_amplification_",
}
DEFAULT_DRIVER = {
    "power_grid": "baseline_load_and_asset_profile",
    "transformer_overload": "baseline_transformer_load_profile",
    "water_pipeline": "baseline_hydraulic_and_maintenance_profile",
    "traffic_infrastructure": "baseline_traffic_and_signal_profile",
}
CASCADE_TEXT = {
    "power": "power_to_traffic_signal_dependency (impact +{} traffic risk)",
    "water": "water_burst_to_traffic_disruption_in_dense_zones (impact +{} traffic risk)",
    "congestion": "extreme_congestion_emergency_response_delay",
    "density": "population_density_plus_aging_infrastructure_amplification",
}
ZONE_TEXT = [
    "Substation clusters with sustained grid load above 85%",
    "Aging transformer corridors where age exceeds 20 years",
    "Legacy water mains with pressure variance above 30%",
    "High-congestion junctions with repeated signal failures",
    "Dense districts with overlapping aging power and water assets",
]
ZONE_DEFAULT = "Citywide monitoring zones with no immediate critical hotspot"
OUTLOOK_TEXT = {
    "LOW": "Low citywide stress; maintain routine monitoring with focus on {}.",
    "MODERATE": "Elevated monitoring required in next 24 hours, centered on {}.",
    "HIGH": "Pre-failure posture detected; activate standby crews for {} within 24 hours.",
    "CRITICAL": "Critical posture; initiate emergency response and staged load reduction for {} immediately.",
}

RULES = {
    "power_grid": POWER_RULES,
    "transformer_overload": TRANSFORMER_RULES,
    "water_pipeline": WATER_RULES,
    "traffic_infrastructure": TRAFFIC_RULES,
}


INPUTS = ["current_load_percent", "peak_load_percent", "historical_failure_rate_percent", "transformer_age_years",
          "heatwave_alert", "rainfall_mm", "pressure_variance_percent", "pipeline_age_years",
          "recent_repairs_last_30_days", "congestion_index", "signal_failure_reports_last_7_days",
          "population_density_per_km2"]


def _input(name: str) -> Column:
    """Rule input: null -> 0 (heatwave null -> false)."""
    if name == "heatwave_alert":
        return flag(F.col(name))
    return nz(name)


def _x(name: str) -> Column:
    """Reference to the prepared rule input (see ``score``: inputs are computed once)."""
    return F.col(f"__x_{name}")


def _pred(name: str, thr) -> Column:
    return _x(name) if thr is None else _x(name) > F.lit(thr)


def _age_norm(name: str, ceiling: float) -> Column:
    return clip((_x(name) / F.lit(ceiling)) * F.lit(100.0))


def _base(system: str) -> Column:
    cur, peak = _x("current_load_percent"), _x("peak_load_percent")
    hist = _x("historical_failure_rate_percent")
    if system == "power_grid":
        hw = F.when(_x("heatwave_alert"), F.lit(100.0)).otherwise(F.lit(0.0))
        return add_all([
            F.lit(0.32) * cur, F.lit(0.22) * peak, F.lit(0.18) * _age_norm("transformer_age_years", 40.0),
            F.lit(0.18) * clip(hist * F.lit(4.0)), F.lit(0.10) * hw,
        ])
    if system == "transformer_overload":
        return add_all([
            F.lit(0.38) * peak, F.lit(0.34) * cur, F.lit(0.20) * _age_norm("transformer_age_years", 35.0),
            F.lit(0.08) * clip(hist * F.lit(3.5)),
        ])
    if system == "water_pipeline":
        return add_all([
            F.lit(0.36) * _x("pressure_variance_percent"), F.lit(0.28) * _age_norm("pipeline_age_years", 60.0),
            F.lit(0.22) * clip((_x("rainfall_mm") / F.lit(80.0)) * F.lit(100.0)),
            F.lit(0.14) * clip((_x("recent_repairs_last_30_days") / F.lit(10.0)) * F.lit(100.0)),
        ])
    return add_all([
        F.lit(0.48) * _x("congestion_index"),
        F.lit(0.30) * clip((_x("signal_failure_reports_last_7_days") / F.lit(15.0)) * F.lit(100.0)),
        F.lit(0.22) * clip((_x("population_density_per_km2") / F.lit(20000.0)) * F.lit(100.0)),
    ])


def _extra(system: str) -> tuple[Column | None, str | None, float]:
    """Second-stage flag: (condition, text, multiplier)."""
    if system == "power_grid":
        return (_x("heatwave_alert") & (_x("current_load_percent") > 85),
                "heatwave_plus_high_load_extra_amplification", 1.08)
    if system == "transformer_overload":
        return (_pred("peak_load_percent", 90) & _pred("transformer_age_years", 20),
                "aging_assets_under_peak_demand", 1.0)
    if system == "water_pipeline":
        return (_pred("rainfall_mm", 40) & _pred("pressure_variance_percent", 30),
                "storm_pressure_instability_intersection", 1.0)
    return None, None, 1.0


def _dense_aging() -> Column:
    return (_x("population_density_per_km2") > 10000) & (
        (_x("transformer_age_years") > 20) | (_x("pipeline_age_years") > 25)
    )


def missing_fields() -> Column:
    """``parent.field`` of every null input, request order, then density."""
    names = [(f"{parent}.{field}", field) for parent, field, _, _ in NESTED_FIELDS]
    names.append(("population_density_per_km2", "population_density_per_km2"))
    return compact([F.when(F.col(c).isNull(), F.lit(n)) for n, c in names])


def system_columns(system: str) -> dict[str, Column]:
    rules = RULES[system]
    preds = [_pred(c, thr) for _, c, thr, _ in rules]
    hits = add_all([p.cast("int") for p in preds])
    bonus = add_all([F.when(p, F.lit(b)).otherwise(F.lit(0.0)) for p, (_, _, _, b) in zip(preds, rules)])
    mult = F.when(hits >= 3, F.lit(1.15)).when(hits == 2, F.lit(1.10)).otherwise(F.lit(1.0))
    pct = F.when(hits >= 3, F.lit("15")).otherwise(F.lit("10"))
    cond, text, extra_mult = _extra(system)
    raw = (_base(system) + bonus) * mult
    if extra_mult != 1.0:
        raw = raw * F.when(cond, F.lit(extra_mult)).otherwise(F.lit(1.0))
    drivers = compact([F.when(p, F.lit(d)) for p, (d, _, _, _) in zip(preds, rules)])
    flag_items = [F.when(hits >= 2, F.concat(F.lit(FLAG_PREFIX[system]), pct, F.lit("pct")))]
    if cond is not None:
        flag_items.append(F.when(cond, F.lit(text)))
    return {
        f"{system}_hits": hits,
        f"{system}_score": clip(raw),
        f"{system}_drivers": F.when(F.size(drivers) == 0, F.array(F.lit(DEFAULT_DRIVER[system]))).otherwise(drivers),
        f"{system}_flags": compact(flag_items),
    }


def _ranked_systems(scores: dict[str, Column]) -> Column:
    """Systems by score desc; ties keep power, transformer, water, traffic order."""
    items = [F.struct((-scores[s]).alias("k"), F.lit(i).alias("o"), F.lit(s).alias("name"), scores[s].alias("score"))
             for i, s in enumerate(SYSTEMS)]
    return F.sort_array(F.array(*items))


def pretty(name: Column) -> Column:
    """T4: underscores to spaces."""
    return F.translate(name, "_", " ")


def score(df: DataFrame) -> DataFrame:
    """R1-R10, F2, F4, T1-T3 over flat telemetry."""
    out = df.withColumns({f"__x_{c}": _input(c) for c in INPUTS})
    layer1 = {"missing_fields": missing_fields()}
    for s in SYSTEMS:
        layer1.update(system_columns(s))
    out = out.withColumns(layer1)

    # R5/R6 cascades, from pre-cascade power/water scores
    P, W = F.col("power_grid_score"), F.col("water_pipeline_score")
    dens = _x("population_density_per_km2")
    c_power = P >= 66
    c_water = (W >= 66) & (dens > 10000)
    c_cong = _x("congestion_index") > 75
    c_dense = _dense_aging()
    imp_p = F.least(F.lit(14.0), F.lit(5.0) + F.lit(0.12) * (P - F.lit(66.0)))
    imp_w = F.least(F.lit(12.0), F.lit(4.0) + F.lit(0.10) * (W - F.lit(66.0)))
    adj = F.when(c_power, imp_p).otherwise(F.lit(0.0)) + F.when(c_water, imp_w).otherwise(F.lit(0.0))
    mult = add_all([F.lit(1.0)] + [F.when(c, F.lit(v)).otherwise(F.lit(0.0))
                                   for c, v in ((c_power, 0.03), (c_water, 0.03), (c_cong, 0.02), (c_dense, 0.05))])
    cascades = compact([
        F.when(c_power, F.concat(F.lit(CASCADE_TEXT["power"].split("{}")[0]), fmt(imp_p, 1),
                                 F.lit(CASCADE_TEXT["power"].split("{}")[1]))),
        F.when(c_water, F.concat(F.lit(CASCADE_TEXT["water"].split("{}")[0]), fmt(imp_w, 1),
                                 F.lit(CASCADE_TEXT["water"].split("{}")[1]))),
        F.when(c_cong, F.lit(CASCADE_TEXT["congestion"])),
        F.when(c_dense, F.lit(CASCADE_TEXT["density"])),
    ])
    out = out.withColumns({
        "traffic_adjustment": adj,
        "cascade_multiplier": mult,
        "cascades": cascades,
        "traffic_base_score": F.col("traffic_infrastructure_score"),
    })
    tr = clip(F.col("traffic_base_score") + F.col("traffic_adjustment"))
    out = out.withColumns({
        "traffic_infrastructure_score": tr,
        "traffic_infrastructure_flags": F.when(
            F.col("traffic_adjustment") > 0,
            F.concat(F.col("traffic_infrastructure_flags"),
                     F.array(F.concat(F.lit("cascading_adjustment_plus_"), fmt("traffic_adjustment", 1)))),
        ).otherwise(F.col("traffic_infrastructure_flags")),
    })

    # R7 overall, R8 confidence, F4 levels
    sc = {s: F.col(f"{s}_score") for s in SYSTEMS}
    weighted = add_all([F.lit(0.33) * sc["power_grid"], F.lit(0.17) * sc["transformer_overload"],
                        F.lit(0.25) * sc["water_pipeline"], F.lit(0.25) * sc["traffic_infrastructure"]])
    hist_raw = F.col("historical_failure_rate_percent")
    trend = (add_all([
        flag(F.col("heatwave_alert")).cast("int"), (_x("rainfall_mm") > 20).cast("int"),
        (_x("current_load_percent") > 80).cast("int"), (_x("congestion_index") > 70).cast("int"),
        (_x("recent_repairs_last_30_days") > 2).cast("int"),
    ]))
    conf = (F.lit(95.0) - F.size("missing_fields").cast("double") * F.lit(5.0)
            - F.when(hist_raw.isNull() | (hist_raw < 5), F.lit(10.0)).otherwise(F.lit(0.0))
            - F.when(trend == 0, F.lit(8.0)).otherwise(F.lit(0.0)))
    layer3 = {"overall_score": clip(weighted * F.col("cascade_multiplier")),
              "confidence_score": F.bround(clip(conf), 0).cast("int"),
              "ranked_systems": _ranked_systems(sc)}
    for s in SYSTEMS:
        layer3[f"{s}_level"] = level(sc[s])
        layer3[f"{s}_risk_score"] = py_round(sc[s], 2)
    out = out.withColumns(layer3)

    # R9 projection, T2 outlook, R10 zones, T3 summary
    ov = F.col("overall_score")
    hw = _x("heatwave_alert")
    delta = add_all([
        F.when(hw & (_x("current_load_percent") > 85), F.lit(8.0)).when(hw, F.lit(4.0)).otherwise(F.lit(0.0)),
        F.when(_x("peak_load_percent") > 90, F.lit(3.0)).otherwise(F.lit(0.0)),
        F.when(_x("rainfall_mm") > 40, F.lit(5.0)).otherwise(F.lit(0.0)),
        F.when(_x("pressure_variance_percent") > 30, F.lit(2.0)).otherwise(F.lit(0.0)),
        F.when(_x("congestion_index") > 75, F.lit(3.0)).otherwise(F.lit(0.0)),
        F.when(_x("signal_failure_reports_last_7_days") > 5, F.lit(2.0)).otherwise(F.lit(0.0)),
        F.when(_x("recent_repairs_last_30_days") > 3, F.lit(2.0)).otherwise(F.lit(0.0)),
        F.when(_dense_aging(), F.lit(3.0)).otherwise(F.lit(0.0)),
    ])
    projected = clip(ov + delta)
    out = out.withColumns({
        "overall_level": level(ov),
        "overall_risk_score": py_round(ov, 2),
        "projected_score": projected,
        "top_two": F.concat_ws(", ", pretty(F.col("ranked_systems")[0]["name"]),
                               pretty(F.col("ranked_systems")[1]["name"])),
    })
    pj = F.col("projected_score")
    direction = (F.when(pj > ov + F.lit(5.0), F.lit("Escalating"))
                 .when(pj < ov - F.lit(5.0), F.lit("Improving")).otherwise(F.lit("Stable-to-elevated")))
    outlook = F.col("overall_level")
    outlook_text = F.lit(None).cast("string")
    for lv, text in reversed(list(OUTLOOK_TEXT.items())):
        a, b = text.split("{}")
        outlook_text = F.when(outlook == lv, F.concat(F.lit(a), F.col("top_two"), F.lit(b))).otherwise(outlook_text)
    zones = compact([
        F.when(sc["power_grid"] >= 66, F.lit(ZONE_TEXT[0])),
        F.when(sc["transformer_overload"] >= 66, F.lit(ZONE_TEXT[1])),
        F.when(sc["water_pipeline"] >= 66, F.lit(ZONE_TEXT[2])),
        F.when(sc["traffic_infrastructure"] >= 66, F.lit(ZONE_TEXT[3])),
        F.when(_dense_aging(), F.lit(ZONE_TEXT[4])),
    ])
    r0, r1 = F.col("ranked_systems")[0], F.col("ranked_systems")[1]
    cascade_clause = F.when(
        F.size("cascades") > 0,
        F.concat(F.lit(" Cascading pathways currently include "),
                 F.array_join(F.slice("cascades", 1, 2), "; "), F.lit(".")),
    ).otherwise(F.lit(" Cascading pathways are currently limited based on available indicators."))
    uncertainty = F.when(
        F.col("confidence_score") < 70,
        F.concat(F.lit(" Assessment confidence is reduced ("), F.col("confidence_score").cast("string"),
                 F.lit("/100) due to incomplete or low-signal inputs: "),
                 F.when(F.size("missing_fields") > 0, F.array_join("missing_fields", ", "))
                 .otherwise(F.lit("trend sparsity")), F.lit(".")),
    ).otherwise(F.lit(""))
    summary = F.concat(
        F.coalesce(F.col("city"), F.lit("None")), F.lit(" is operating at "), F.col("overall_level"),
        F.lit(" infrastructure risk ("), fmt(ov, 1), F.lit("/100). Primary pressure is in "),
        pretty(r0["name"]), F.lit(" ("), fmt(r0["score"], 1), F.lit(") followed by "),
        pretty(r1["name"]), F.lit(" ("), fmt(r1["score"], 1), F.lit(")."), cascade_clause,
        F.lit(" Prioritize preventive actions in the next operational window for these systems."), uncertainty,
    )
    out = out.withColumns({
        "hour_24_outlook": outlook_text,
        "hour_72_projection": F.concat(direction, F.lit(" trajectory with projected score "), fmt(pj, 1),
                                       F.lit(" ("), level(pj), F.lit(") by 72 hours based on current stress indicators.")),
        "priority_zones": F.when(F.size(zones) == 0, F.array(F.lit(ZONE_DEFAULT))).otherwise(zones),
        "executive_summary": summary,
    })
    return out.drop("top_two", *[f"__x_{c}" for c in INPUTS])


def top_drivers_text(system: str) -> Column:
    """T5: first three drivers as a display string."""
    return F.array_join(F.slice(F.col(f"{system}_drivers"), 1, 3), ", ")


def reasoning_prompt(df: DataFrame) -> DataFrame:
    """The briefing prompt as a column (JSON blobs of systems with unrounded scores, cascades, missing fields)."""
    blobs = [F.concat(F.lit(f'"{s}":{{"risk_score":'), json_number(f"{s}_score"), F.lit(',"risk_level":"'), F.col(f"{s}_level"),
                      F.lit('","primary_drivers":'), F.to_json(f"{s}_drivers"), F.lit(',"compound_flags":'), F.to_json(f"{s}_flags"), F.lit("}"))
             for s in SYSTEMS]
    return df.withColumn("reasoning_prompt", F.concat(
        F.lit("Generate an executive city infrastructure risk briefing.\ncity="), F.col("city"),
        F.lit("\noverall_score="), fmt("overall_score", 1), F.lit("\noverall_level="), F.col("overall_level"),
        F.lit("\nsystems={"), F.concat_ws(",", *blobs), F.lit("}\ncascades="), F.to_json(F.col("cascades")),
        F.lit("\nconfidence_score="), F.col("confidence_score").cast("string"),
        F.lit("\nmissing_fields="), F.to_json(F.col("missing_fields")),
        F.lit("\nRequired style: concise, technical, actionable, no disclaimers."),
    ))
