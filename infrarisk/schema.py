"""Declared schemas (D1-D11) and fixed values.

Everything in the "fixed values" blocks must equal the modelled application's constants for
results to match; they are stated plainly and in their natural order.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Column names
# ---------------------------------------------------------------------------
TIME_COLUMN = "timestamp"

RAW_INPUT_COLUMNS = [
    "city",
    "temperature_c",
    "humidity_percent",
    "heatwave_alert",
    "rainfall_mm",
    "current_load_percent",
    "peak_load_percent",
    "historical_failure_rate_percent",
    "transformer_age_years",
    "pressure_variance_percent",
    "pipeline_age_years",
    "recent_repairs_last_30_days",
    "congestion_index",
    "signal_failure_reports_last_7_days",
    "population_density_per_km2",
]

TARGET_COLUMNS = [
    "overall_failure_72h_label",
    "power_failure_72h_label",
    "transformer_overload_72h_label",
    "water_failure_72h_label",
    "traffic_failure_72h_label",
]

MODEL_NUMERIC_FEATURES = [
    "temperature_c",
    "humidity_percent",
    "rainfall_mm",
    "current_load_percent",
    "peak_load_percent",
    "historical_failure_rate_percent",
    "transformer_age_years",
    "pressure_variance_percent",
    "pipeline_age_years",
    "recent_repairs_last_30_days",
    "congestion_index",
    "signal_failure_reports_last_7_days",
    "population_density_per_km2",
    "heatwave_alert_int",
    "load_margin_percent",
    "load_ratio",
    "heat_load_interaction",
    "transformer_stress_index",
    "water_stress_index",
    "repair_pressure_interaction",
    "congestion_signal_interaction",
    "density_congestion_interaction",
    "aging_density_intersection",
    "humidity_temperature_interaction",
    "rain_pressure_interaction",
    "high_load_flag",
    "peak_load_flag",
    "high_pressure_flag",
    "high_density_flag",
]
MODEL_FEATURE_COLUMNS = ["city"] + MODEL_NUMERIC_FEATURES

SYSTEMS = ["power_grid", "transformer_overload", "water_pipeline", "traffic_infrastructure"]

TARGET_TO_SYSTEM = {
    "power_failure_72h_label": "power_grid",
    "transformer_overload_72h_label": "transformer_overload",
    "water_failure_72h_label": "water_pipeline",
    "traffic_failure_72h_label": "traffic_infrastructure",
}

# ---------------------------------------------------------------------------
# Incident system synonyms (after strip/lower/space->underscore)
# The overall target counts every incident of the city, whatever its system.
# ---------------------------------------------------------------------------
SYSTEM_SYNONYMS = {
    "power_failure_72h_label": ["power", "power_grid", "grid"],
    "transformer_overload_72h_label": ["transformer", "transformer_overload"],
    "water_failure_72h_label": ["water", "water_pipeline", "pipeline"],
    "traffic_failure_72h_label": ["traffic", "traffic_infrastructure", "signals"],
}

# ---------------------------------------------------------------------------
# Request field ranges (closed), in request order
# ---------------------------------------------------------------------------
NESTED_FIELDS = [
    ("weather", "temperature_c", -30.0, 65.0),
    ("weather", "humidity_percent", 0.0, 100.0),
    ("weather", "heatwave_alert", None, None),
    ("weather", "rainfall_mm", 0.0, 600.0),
    ("power_grid", "current_load_percent", 0.0, 100.0),
    ("power_grid", "peak_load_percent", 0.0, 100.0),
    ("power_grid", "historical_failure_rate_percent", 0.0, 100.0),
    ("power_grid", "transformer_age_years", 0.0, 80.0),
    ("water_system", "pressure_variance_percent", 0.0, 100.0),
    ("water_system", "pipeline_age_years", 0.0, 100.0),
    ("water_system", "recent_repairs_last_30_days", 0.0, 50.0),
    ("traffic_system", "congestion_index", 0.0, 100.0),
    ("traffic_system", "signal_failure_reports_last_7_days", 0.0, 100.0),
]
DENSITY_RANGE = (0.0, 150000.0)

INT_FIELDS = {"recent_repairs_last_30_days", "signal_failure_reports_last_7_days"}

# ---------------------------------------------------------------------------
# Weather-check cities (lower-case name -> latitude, longitude)
# ---------------------------------------------------------------------------
REFERENCE_CITY_COORDS = [
    ("metrovale", 41.8781, -87.6298),
    ("bayhaven", 37.7749, -122.4194),
    ("northbridge", 42.3601, -71.0589),
    ("lakehurst", 40.7128, -74.0060),
    ("riverton", 39.9526, -75.1652),
    ("sunport", 33.4484, -112.0740),
]

# ---------------------------------------------------------------------------
# District zones (id, name, mix power/transformer/water/traffic, bias, cascade sensitive)
# and dependency flows (from, to, label)
# ---------------------------------------------------------------------------
ZONES = [
    ("north_core", "North Core", 0.28, 0.27, 0.18, 0.27, 2.0, True),
    ("west_industrial", "West Industrial", 0.36, 0.32, 0.2, 0.12, 5.0, False),
    ("central_exchange", "Central Exchange", 0.25, 0.18, 0.2, 0.37, 4.0, True),
    ("east_residential", "East Residential", 0.2, 0.16, 0.34, 0.3, 1.0, True),
    ("south_logistics", "South Logistics", 0.29, 0.21, 0.14, 0.36, 3.0, True),
]
FLOWS = [
    ("west_industrial", "central_exchange", "Grid -> Junction"),
    ("north_core", "central_exchange", "Signal Dependency"),
    ("east_residential", "south_logistics", "Water -> Traffic"),
]

# ---------------------------------------------------------------------------
# Spark schemas
# ---------------------------------------------------------------------------
WEATHER = T.StructType([
    T.StructField("temperature_c", T.DoubleType()),
    T.StructField("humidity_percent", T.DoubleType()),
    T.StructField("heatwave_alert", T.BooleanType()),
    T.StructField("rainfall_mm", T.DoubleType()),
])
POWER = T.StructType([
    T.StructField("current_load_percent", T.DoubleType()),
    T.StructField("peak_load_percent", T.DoubleType()),
    T.StructField("historical_failure_rate_percent", T.DoubleType()),
    T.StructField("transformer_age_years", T.DoubleType()),
])
WATER = T.StructType([
    T.StructField("pressure_variance_percent", T.DoubleType()),
    T.StructField("pipeline_age_years", T.DoubleType()),
    T.StructField("recent_repairs_last_30_days", T.IntegerType()),
])
TRAFFIC = T.StructType([
    T.StructField("congestion_index", T.DoubleType()),
    T.StructField("signal_failure_reports_last_7_days", T.IntegerType()),
])
REQUEST = T.StructType([
    T.StructField("city", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("weather", WEATHER),
    T.StructField("power_grid", POWER),
    T.StructField("water_system", WATER),
    T.StructField("traffic_system", TRAFFIC),
    T.StructField("population_density_per_km2", T.DoubleType()),
])

TELEMETRY = T.StructType(
    [T.StructField("timestamp", T.TimestampType()), T.StructField("city", T.StringType())]
    + [
        T.StructField(name, T.BooleanType() if name == "heatwave_alert"
                      else T.IntegerType() if name in INT_FIELDS else T.DoubleType())
        for name in RAW_INPUT_COLUMNS[1:]
    ]
)

INCIDENTS = T.StructType([
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("city", T.StringType()),
    T.StructField("system", T.StringType()),
    T.StructField("severity", T.IntegerType()),
])

LABELED = T.StructType(TELEMETRY.fields + [T.StructField(t, T.IntegerType()) for t in TARGET_COLUMNS])

WEATHER_OBS = T.StructType([
    T.StructField("city", T.StringType()),
    T.StructField("observed_at", T.TimestampType()),
    T.StructField("external_temperature_c", T.DoubleType()),
    T.StructField("external_precipitation_mm", T.DoubleType()),
    T.StructField("external_wind_speed_kmh", T.DoubleType()),
])
