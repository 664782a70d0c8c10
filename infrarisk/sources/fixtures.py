"""Views derived from the driver's ``events`` table (see FIXTURES.md).

The same SQL text is used by Spark (``spark.sql`` with a DataFrame argument, so no global view
names are needed) and, wrapped in CTEs, by the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEW_SQL = {
    "telemetry": """
SELECT event_id AS telemetry_id, ts AS timestamp, 'city_' || lpad(CAST(user_id AS STRING),4,'0') AS city,
 CASE WHEN event_id % 41 = 0 THEN NULL ELSE -5e0 + (k % 530)/1e1 END AS temperature_c,
 CASE WHEN event_id % 97 = 0 THEN 140e0 ELSE 18e0 + ((k*31) % 800)/1e1 END AS humidity_percent,
 ((k*37+11) % 100) < 18 AS heatwave_alert,
 CASE WHEN ((k*41+3) % 100) < 30 THEN ((k*43) % 850)/1e1 ELSE ((k*43) % 24)/1e1 END AS rainfall_mm,
 45e0 + ((k*47+5) % 550)/1e1 AS current_load_percent,
 least(100e0, 45e0 + ((k*47+5) % 550)/1e1 + 4e0 + ((k*53) % 65)/1e1) AS peak_load_percent,
 CASE WHEN event_id % 29 = 0 THEN NULL ELSE 1e0 + ((k*59+7) % 270)/1e1 END AS historical_failure_rate_percent,
 5e0 + ((user_id*61) % 350)/1e1 AS transformer_age_years,
 4e0 + ((k*67+13) % 560)/1e1 AS pressure_variance_percent,
 8e0 + ((user_id*71) % 420)/1e1 AS pipeline_age_years,
 CAST((k*73+1) % 9 AS INT) AS recent_repairs_last_30_days,
 30e0 + ((k*79+17) % 700)/1e1 AS congestion_index,
 CAST((k*83+19) % 13 AS INT) AS signal_failure_reports_last_7_days,
 5000e0 + ((user_id*1157) % 140)*1e2 AS population_density_per_km2
FROM (SELECT *, event_id*7919 + user_id*104729 AS k FROM {events} WHERE event_type IN ('click','view'))
""",
    "incidents": """
SELECT event_id AS incident_id, ts AS timestamp, 'city_' || lpad(CAST(user_id AS STRING),4,'0') AS city,
 CASE event_id % 7 WHEN 0 THEN 'power' WHEN 1 THEN ' Power Grid' WHEN 2 THEN 'transformer' WHEN 3 THEN 'Water Pipeline'
  WHEN 4 THEN 'traffic' WHEN 5 THEN 'signals' ELSE 'citywide' END AS system,
 CAST(1 + event_id % 5 AS INT) AS severity
FROM {events} WHERE event_type = 'error' AND value > 50
""",
    "weather_obs": """
SELECT event_id AS obs_id, ts AS observed_at, 'city_' || lpad(CAST(user_id AS STRING),4,'0') AS city,
 -5e0 + ((event_id*7907 + user_id*104729) % 530)/1e1 AS external_temperature_c,
 CASE WHEN event_id % 5 = 0 THEN ((event_id*43) % 400)/1e1 ELSE 0e0 END AS external_precipitation_mm,
 ((event_id*17) % 450)/1e1 AS external_wind_speed_kmh
FROM {events} WHERE event_type = 'purchase' AND user_id % 10 <> 9
""",
    "city_coords": """
SELECT DISTINCT 'city_' || lpad(CAST(user_id AS STRING),4,'0') AS city,
 30e0 + (user_id % 200)/1e1 AS latitude, -120e0 + (user_id % 450)/1e1 AS longitude
FROM {events} WHERE user_id % 10 <> 9
""",
    "repair_events": """
SELECT event_id AS repair_id, ts AS timestamp, 'city_' || lpad(CAST(user_id AS STRING),4,'0') AS city
FROM {events} WHERE event_type = 'purchase' AND value > 20
""",
    "signal_events": """
SELECT event_id AS report_id, ts AS timestamp, 'city_' || lpad(CAST(user_id AS STRING),4,'0') AS city
FROM {events} WHERE event_type = 'signup'
""",
}

# The oracle's `predictions` view (the Spark side is built from labels, see operators/labels.py).
PREDICTIONS_SQL = """
SELECT t.telemetry_id, CASE WHEN max(i.incident_id) IS NULL THEN 0 ELSE 1 END AS y,
 max((t.telemetry_id*7919 % 1001)/1e3) AS p
FROM telemetry t LEFT JOIN incidents i ON t.city = i.city AND i.timestamp >= t.timestamp AND i.timestamp <= t.timestamp + INTERVAL 72 HOURS
GROUP BY t.telemetry_id
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str, utc: bool = True) -> DataFrame:
    """One fixture view as a DataFrame. ``utc`` turns the parquet NTZ time into TIMESTAMP."""
    events = table(spark, sf_dir, "events")
    df = spark.sql(VIEW_SQL[name], events=events)
    if utc:
        for c in ("timestamp", "observed_at"):
            if c in df.columns:
                df = df.withColumn(c, df[c].cast("timestamp"))
    return df


def telemetry(spark, sf_dir, utc=True):
    return view(spark, sf_dir, "telemetry", utc)


def incidents(spark, sf_dir, utc=True):
    return view(spark, sf_dir, "incidents", utc)


def weather_obs(spark, sf_dir, utc=True):
    return view(spark, sf_dir, "weather_obs", utc)


def city_coords(spark, sf_dir):
    return view(spark, sf_dir, "city_coords", False)


def repair_events(spark, sf_dir, utc=True):
    return view(spark, sf_dir, "repair_events", utc)


def signal_events(spark, sf_dir, utc=True):
    return view(spark, sf_dir, "signal_events", utc)


def oracle_with(*names: str) -> str:
    """``WITH`` clause defining the named fixture views for DuckDB (base tables are registered)."""
    parts = []
    for n in names:
        if n == "predictions":
            parts.append(f"predictions AS ({PREDICTIONS_SQL})")
        else:
            parts.append(f"{n} AS ({VIEW_SQL[n].replace('{events}', 'events')})")
    return "WITH " + ",\n".join(parts) + "\n"
