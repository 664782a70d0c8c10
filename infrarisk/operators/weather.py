"""External weather cross-check (J2 as-of join, V3 deltas/anomaly, V4 uplift).

The live fetch of the modelled service is re-aimed as an as-of join to an observations table:
the newest observation of the same (normalised) city at or before the assessment time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import level, py_round, stripped
from .asof import HOUR_US, epoch_us, nearest

# Source label, signal type, notes
SOURCE = "open-meteo.com"
SIGNAL_TYPE = "live_weather_crosscheck"
NOTE_ANOMALY = "External weather anomaly detected; elevated readiness recommended."
NOTE_ALIGNED = "External weather signal aligned with submitted telemetry profile."
NOTE_UNSUPPORTED = "Live external signal unavailable for this city mapping."
NOTE_FAILED = "Live external signal fetch failed; assessment stayed deterministic + ML only."
UPLIFT_SUFFIX = " Live external weather anomaly signal is active."


def city_key(c="city"):
    c = F.col(c) if isinstance(c, str) else c
    return F.lower(stripped(c))


def asof_weather(df: DataFrame, obs: DataFrame, max_age_hours: float | None = None,
                 bucket_hours: int = 24) -> DataFrame:
    """Adds ``obs_id``, ``observed_at``, ``external_*`` of the newest observation <= timestamp.

    ``max_age_hours`` drops matches older than the limit (staleness).  Ties on time pick the
    largest ``obs_id``.
    """
    left = df.withColumn("__wk", city_key("city")).withColumn("__t_us", epoch_us("timestamp"))
    right = obs.withColumn("__wk", city_key("city")).withColumn("__o_us", epoch_us("observed_at"))
    agg = F.struct(F.col("__o_us").alias("t"), F.col("obs_id"), F.col("external_temperature_c"),
                   F.col("external_precipitation_mm"), F.col("external_wind_speed_kmh"))
    out = nearest(left, right, "__wk", "__t_us", "__o_us", {"__obs": agg}, "backward", bucket_hours * HOUR_US)
    if max_age_hours is not None:
        fresh = (F.col("__t_us") - F.col("__obs.t")) <= F.lit(int(max_age_hours * HOUR_US))
        out = out.withColumn("__obs", F.when(fresh, F.col("__obs")))
    return out.withColumns({
        "obs_id": F.col("__obs.obs_id"),
        "observed_at": F.timestamp_micros(F.col("__obs.t")),
        "external_temperature_c": F.col("__obs.external_temperature_c"),
        "external_precipitation_mm": F.col("__obs.external_precipitation_mm"),
        "external_wind_speed_kmh": F.col("__obs.external_wind_speed_kmh"),
    }).drop("__obs", "__t_us")


def weather_check(df: DataFrame, coords: DataFrame) -> DataFrame:
    """V3: status (ok / unsupported_city / fetch_failed), deltas rounded to 2, anomaly flag, note.

    ``df`` carries the J2 columns and ``__wk``; ``coords`` is (city, latitude, longitude).  The
    coordinate table is a dimension (one row per city); AQE broadcasts it when it is small.
    """
    dim = coords.select(city_key("city").alias("__ck"), F.col("latitude").alias("mapped_latitude"),
                        F.col("longitude").alias("mapped_longitude")).dropDuplicates(["__ck"])
    out = df.join(dim, F.col("__wk") == F.col("__ck"), "left")
    supported = F.col("__ck").isNotNull()
    ok = supported & F.col("obs_id").isNotNull()
    td = F.when(ok & F.col("temperature_c").isNotNull() & F.col("external_temperature_c").isNotNull(),
                py_round(F.col("external_temperature_c") - F.col("temperature_c"), 2))
    rd = F.when(ok & F.col("rainfall_mm").isNotNull() & F.col("external_precipitation_mm").isNotNull(),
                py_round(F.col("external_precipitation_mm") - F.col("rainfall_mm"), 2))
    out = out.withColumns({"temperature_delta_c": td, "rainfall_delta_mm": rd})
    anomaly = ok & (F.coalesce(F.abs("temperature_delta_c") >= 4.0, F.lit(False))
                    | F.coalesce(F.col("rainfall_delta_mm") >= 10.0, F.lit(False))
                    | F.coalesce(F.col("external_wind_speed_kmh") >= 35.0, F.lit(False)))
    status = (F.when(~supported, F.lit("unsupported_city")).when(~ok, F.lit("fetch_failed")).otherwise(F.lit("ok")))
    note = (F.when(~supported, F.lit(NOTE_UNSUPPORTED)).when(~ok, F.lit(NOTE_FAILED))
            .when(anomaly, F.lit(NOTE_ANOMALY)).otherwise(F.lit(NOTE_ALIGNED)))
    return out.withColumns({
        "weather_status": status, "weather_anomaly_flag": anomaly, "influence_note": note,
        "signal_source": F.lit(SOURCE), "signal_type": F.lit(SIGNAL_TYPE),
    }).drop("__ck", "__wk")


def anomaly_uplift(df: DataFrame, score_col: str = "overall_risk_score", level_col: str = "overall_level",
                   summary_col: str = "executive_summary") -> DataFrame:
    """V4: status ok and anomaly -> min(100, score + 1.5) rounded 2, re-level, summary suffix."""
    hit = (F.col("weather_status") == "ok") & F.col("weather_anomaly_flag")
    boosted = F.least(F.lit(100.0), F.col(score_col) + F.lit(1.5))
    return df.withColumns({
        level_col: F.when(hit, level(boosted)).otherwise(F.col(level_col)),
        summary_col: F.when(hit, F.concat(F.col(summary_col), F.lit(UPLIFT_SUFFIX))).otherwise(F.col(summary_col)),
        score_col: F.when(hit, py_round(boosted, 2)).otherwise(F.col(score_col)),
    })
