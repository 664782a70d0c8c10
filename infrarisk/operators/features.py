"""Feature engineering (P3, P4): 29 numeric model columns + city, in one projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import null_max
from ..functions.validate import coerce_numeric
from ..schema import MODEL_FEATURE_COLUMNS, TARGET_COLUMNS


def engineered(df: DataFrame) -> DataFrame:
    """P3.  Nulls propagate through arithmetic (imputed later); flags treat null as 0."""
    c = F.col
    hw = F.coalesce(c("heatwave_alert").cast("boolean"), F.lit(False)).cast("int")
    cur, peak = c("current_load_percent"), c("peak_load_percent")
    pv, rain = c("pressure_variance_percent"), c("rainfall_mm")
    dens, cong = c("population_density_per_km2"), c("congestion_index")

    def flag(x):
        return F.coalesce(x, F.lit(False)).cast("int")

    return df.withColumns({
        "heatwave_alert_int": hw,
        "load_margin_percent": peak - cur,
        "load_ratio": F.try_divide(cur, peak + F.lit(1e-3)),
        "heat_load_interaction": hw * cur,
        "transformer_stress_index": c("transformer_age_years") * (peak / F.lit(100.0)),
        "water_stress_index": pv * (F.lit(1.0) + (rain / F.lit(100.0))),
        "repair_pressure_interaction": c("recent_repairs_last_30_days") * pv,
        "congestion_signal_interaction": cong * c("signal_failure_reports_last_7_days"),
        "density_congestion_interaction": (dens / F.lit(10000.0)) * cong,
        "aging_density_intersection": null_max("transformer_age_years", "pipeline_age_years") * dens / F.lit(10000.0),
        "humidity_temperature_interaction": c("humidity_percent") * c("temperature_c") / F.lit(100.0),
        "rain_pressure_interaction": rain * pv / F.lit(100.0),
        "high_load_flag": flag(cur > 85),
        "peak_load_flag": flag(peak > 90),
        "high_pressure_flag": flag(pv > 30),
        "high_density_flag": flag(dens > 10000),
    })


def feature_frame(df: DataFrame, include_targets: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Coerce, engineer, ``city`` null -> 'UNKNOWN', select the 30 model columns (+targets, +keep)."""
    out = engineered(coerce_numeric(df)).withColumn("city", F.coalesce(F.col("city").cast("string"), F.lit("UNKNOWN")))
    cols = list(keep or []) + list(MODEL_FEATURE_COLUMNS)
    if include_targets:
        cols += [t for t in TARGET_COLUMNS if t in df.columns]
    return out.select(*cols)
