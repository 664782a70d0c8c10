"""DuckDB oracle SQL per registered query (same column names as ``queries.py``).

Hand-written SQL over the pre-registered base tables; the fixture views and the scoring chain
come from ``oracle_sql``.  Where a parameter list is long (features, weights) the SQL text is
generated from that list, but every formula is written in SQL here.
"""

from __future__ import annotations

from ..operators.overlay import STAGES
from ..schema import INT_FIELDS, MODEL_NUMERIC_FEATURES, SYSTEM_SYNONYMS, TARGET_COLUMNS, ZONES
from ..sources.fixtures import oracle_with
from .oracle_sql import lvl, r, scored_ctes, with_scored

J = "' | '"
TGT = TARGET_COLUMNS
SYS_TARGETS = [("power_failure_72h_label", "p"), ("transformer_overload_72h_label", "t"),
               ("water_failure_72h_label", "w"), ("traffic_failure_72h_label", "r")]
SYS_NAME = {"p": "power_grid", "t": "transformer_overload", "w": "water_pipeline", "r": "traffic_infrastructure"}


def aj(x: str, sep: str = J) -> str:
    return f"array_to_string({x}, {sep})"


def dbl(v: float) -> str:
    return f"CAST('{v!r}' AS DOUBLE)"


def sdiv(a: str, b: str) -> str:
    return f"(CASE WHEN abs({b}) < 1e-12 THEN 0e0 ELSE CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) END)"


def in_list(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


SYS_NORM = "replace(lower(trim(system)), ' ', '_')"

# labels: telemetry x incidents within [t, t + 72 h], per target group
LABEL_CTES = f"""
inc AS (SELECT city, timestamp AS ti, {SYS_NORM} AS s FROM incidents WHERE city IS NOT NULL),
lbl AS (
 SELECT t.telemetry_id,
  max(CASE WHEN i.ti IS NOT NULL THEN 1 ELSE 0 END) AS {TGT[0]},
""" + ",\n".join(
    f"  max(CASE WHEN i.s IN {in_list(SYSTEM_SYNONYMS[t])} THEN 1 ELSE 0 END) AS {t}" for t in TGT[1:]) + """
 FROM telemetry t LEFT JOIN inc i ON t.city = i.city AND i.ti >= t.timestamp AND i.ti <= t.timestamp + INTERVAL 72 HOURS
 GROUP BY t.telemetry_id
),
lab AS (SELECT t.*, lbl.* EXCLUDE (telemetry_id) FROM telemetry t JOIN lbl USING (telemetry_id))
"""


def with_labels_scored() -> str:
    return oracle_with("telemetry", "incidents") + "," + LABEL_CTES + "," + scored_ctes("lab")


SUMMARY = (
    "coalesce(city, 'None') || ' is operating at ' || overall_level || ' infrastructure risk (' || printf('%.1f', overall_score)"
    " || '/100). Primary pressure is in ' || replace(ranked[1].name, '_', ' ') || ' (' || printf('%.1f', ranked[1].score)"
    " || ') followed by ' || replace(ranked[2].name, '_', ' ') || ' (' || printf('%.1f', ranked[2].score) || ').'"
    " || CASE WHEN len(cascades) > 0 THEN ' Cascading pathways currently include ' || array_to_string(cascades[1:2], '; ') || '.'"
    " ELSE ' Cascading pathways are currently limited based on available indicators.' END"
    " || ' Prioritize preventive actions in the next operational window for these systems.'"
    " || CASE WHEN confidence_score < 70 THEN ' Assessment confidence is reduced (' || CAST(confidence_score AS VARCHAR)"
    " || '/100) due to incomplete or low-signal inputs: ' || CASE WHEN len(missing_fields) > 0"
    " THEN array_to_string(missing_fields, ', ') ELSE 'trend sparsity' END || '.' ELSE '' END"
)

# feature frame (P3/P4) over telemetry
FEAT_CTE = """
feat AS (
 SELECT telemetry_id, coalesce(city, 'UNKNOWN') AS city, temperature_c, humidity_percent, rainfall_mm,
  current_load_percent, peak_load_percent, historical_failure_rate_percent, transformer_age_years,
  pressure_variance_percent, pipeline_age_years, recent_repairs_last_30_days, congestion_index,
  signal_failure_reports_last_7_days, population_density_per_km2,
  CAST(coalesce(heatwave_alert, false) AS INTEGER) AS heatwave_alert_int,
  peak_load_percent - current_load_percent AS load_margin_percent,
  current_load_percent / (peak_load_percent + 1e-3) AS load_ratio,
  CAST(coalesce(heatwave_alert, false) AS INTEGER) * current_load_percent AS heat_load_interaction,
  transformer_age_years * (peak_load_percent / 1e2) AS transformer_stress_index,
  pressure_variance_percent * (1e0 + (rainfall_mm / 1e2)) AS water_stress_index,
  recent_repairs_last_30_days * pressure_variance_percent AS repair_pressure_interaction,
  congestion_index * signal_failure_reports_last_7_days AS congestion_signal_interaction,
  (population_density_per_km2 / 1e4) * congestion_index AS density_congestion_interaction,
  (CASE WHEN transformer_age_years IS NULL OR pipeline_age_years IS NULL THEN NULL
        ELSE greatest(transformer_age_years, pipeline_age_years) END) * population_density_per_km2 / 1e4 AS aging_density_intersection,
  humidity_percent * temperature_c / 1e2 AS humidity_temperature_interaction,
  rainfall_mm * pressure_variance_percent / 1e2 AS rain_pressure_interaction,
  CASE WHEN current_load_percent > 85 THEN 1 ELSE 0 END AS high_load_flag,
  CASE WHEN peak_load_percent > 90 THEN 1 ELSE 0 END AS peak_load_flag,
  CASE WHEN pressure_variance_percent > 30 THEN 1 ELSE 0 END AS high_pressure_flag,
  CASE WHEN population_density_per_km2 > 10000 THEN 1 ELSE 0 END AS high_density_flag
 FROM telemetry
)
"""

F29 = MODEL_NUMERIC_FEATURES


def pinned_ctes() -> str:
    """Rounded statistics of the feature frame and the pinned city weights (see queries.pinned_models)."""
    meds = ", ".join(f"coalesce(median(CAST({c} AS DOUBLE)), 0e0) AS {c}" for c in F29)
    moms = ", ".join(f"avg(coalesce(CAST(f.{c} AS DOUBLE), md.{c})) AS m_{c}, "
                     f"stddev_pop(coalesce(CAST(f.{c} AS DOUBLE), md.{c})) AS s_{c}" for c in F29)
    pst = ", ".join(
        f"{r(f'md.{c}', 6)} AS med_{c}, {r(f'm_{c}', 6)} AS mean_{c}, "
        f"CASE WHEN s_{c} > 1e-9 AND {r(f's_{c}', 6)} <> 0 THEN {r(f's_{c}', 6)} ELSE 1e0 END AS std_{c}" for c in F29)
    cws = ", ".join(f"CAST(((TRY_CAST(substr(city, 6) AS INTEGER) * 13 + {ti * 5}) % 21 - 10) AS DOUBLE) / 1e2 AS w_{ti}"
                    for ti in range(5))
    return (f"md AS (SELECT {meds} FROM feat),\n"
            f"mo AS (SELECT {moms} FROM feat f, md),\n"
            f"pst AS (SELECT {pst} FROM md, mo),\n"
            f"cw AS (SELECT city, {cws} FROM (SELECT DISTINCT city FROM feat))\n")


def pinned_weight(j: int, ti: int) -> float:
    return ((j * 7 + ti * 3) % 13 - 6) / 20.0


def z_term(c: str, j: int, ti: int) -> str:
    return f"({dbl(pinned_weight(j, ti))} * ((coalesce(CAST(f.{c} AS DOUBLE), med_{c}) - mean_{c}) / std_{c}))"


def prob_sql(ti: int) -> str:
    z = " + ".join(z_term(c, j, ti) for j, c in enumerate(F29))
    z = f"({z} + coalesce(cw.w_{ti}, 0e0) + {dbl(-0.5 + 0.1 * ti)})"
    return f"least(1e0, greatest(0e0, 1e0 / (1e0 + exp(-least(greatest({z}, -35e0), 35e0)))))"


PROBS_CTE = "probs AS (SELECT f.telemetry_id, " + ", ".join(
    f"{r(prob_sql(ti), 6)} AS p_{t}" for ti, t in enumerate(TGT)) + " FROM feat f CROSS JOIN pst LEFT JOIN cw ON f.city = cw.city)\n"


def metrics_ctes(src: str, group: list[str], thr: str = "5e-1", name: str = "met") -> str:
    """Confusion, Brier, log loss, tie-grouped curves and ECE per group over ``src(y, p)``."""
    g = ", ".join(group)
    pcl = "least(greatest(p, 1e-12), 1e0 - 1e-12)"
    qcl = "least(greatest(1e0 - p, 1e-12), 1e0 - 1e-12)"
    edges = ["0e0", "1e-1", "2e-1", "CAST('0.30000000000000004' AS DOUBLE)", "4e-1", "5e-1",
             "CAST('0.6000000000000001' AS DOUBLE)", "CAST('0.7000000000000001' AS DOUBLE)", "8e-1", "9e-1", "1e0"]
    binx = "CASE " + " ".join(
        f"WHEN p >= {edges[i]} AND p {'<=' if i == 9 else '<'} {edges[i + 1]} THEN {i}" for i in range(10)) + " END"
    return f"""
{name}_c AS (
 SELECT {g},
  CAST(sum(CASE WHEN p >= {thr} AND y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
  CAST(sum(CASE WHEN NOT (p >= {thr}) AND y <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
  CAST(sum(CASE WHEN p >= {thr} AND y <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
  CAST(sum(CASE WHEN NOT (p >= {thr}) AND y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
  count(*) AS n, avg((p - y) * (p - y)) AS brier,
  -avg(y * ln({pcl}) + (1 - y) * ln({qcl})) AS log_loss, avg(CAST(y AS DOUBLE)) AS positive_rate
 FROM {src} GROUP BY {g}
),
{name}_c2 AS (
 SELECT *, {sdiv('tp + tn', 'n')} AS accuracy, {sdiv('tp', 'tp + fp')} AS precision, {sdiv('tp', 'tp + fn')} AS recall
 FROM {name}_c
),
{name}_c3 AS (SELECT *, {sdiv('2e0 * precision * recall', 'precision + recall')} AS f1 FROM {name}_c2),
{name}_g AS (SELECT {g}, p, sum(y) AS tp, count(*) AS cnt FROM {src} GROUP BY {g}, p),
{name}_cu AS (
 SELECT *, sum(tp) OVER (PARTITION BY {g} ORDER BY p DESC) AS ctp, sum(cnt) OVER (PARTITION BY {g} ORDER BY p DESC) AS ccnt,
  sum(tp) OVER (PARTITION BY {g}) AS pos, sum(cnt) OVER (PARTITION BY {g}) AS tot
 FROM {name}_g
),
{name}_cu2 AS (
 SELECT *, CAST(ctp AS DOUBLE) / CAST(ccnt AS DOUBLE) AS prec, {sdiv('ctp', 'pos')} AS rec FROM {name}_cu
),
{name}_k AS (
 SELECT {g}, first(pos) AS pos, first(tot) AS tot,
  sum(prec * (CAST(tp AS DOUBLE) / CAST(pos AS DOUBLE))) AS ap,
  sum(tp * (CAST(tot - ccnt AS DOUBLE) + CAST(cnt + 1 AS DOUBLE) / 2e0)) AS rank_sum,
  first(p ORDER BY {sdiv('2e0 * prec * rec', 'prec + rec')} DESC, p ASC) AS best_p
 FROM {name}_cu2 GROUP BY {g}
),
{name}_k2 AS (
 SELECT {g},
  CASE WHEN pos = 0 OR pos = tot THEN NULL ELSE
   (rank_sum - CAST(pos AS DOUBLE) * (CAST(pos AS DOUBLE) + 1e0) / 2e0) / (CAST(pos AS DOUBLE) * CAST(tot - pos AS DOUBLE)) END AS roc_auc,
  CASE WHEN pos = 0 THEN 0e0 ELSE ap END AS pr_auc,
  CASE WHEN pos = 0 OR pos = tot THEN 5e-1 ELSE least(greatest(best_p, 5e-2), 95e-2) END AS threshold
 FROM {name}_k
),
{name}_b AS (SELECT {g}, {binx} AS bin, count(*) AS nb, avg(p) AS pm, avg(CAST(y AS DOUBLE)) AS ym FROM {src} GROUP BY ALL),
{name}_e AS (
 SELECT {g}, sum(abs(pm - ym) * (CAST(nb AS DOUBLE) / CAST(n AS DOUBLE))) AS ece_10_bins
 FROM (SELECT *, sum(nb) OVER (PARTITION BY {g}) AS n FROM {name}_b) WHERE bin IS NOT NULL GROUP BY {g}
),
{name} AS (
 SELECT c.*, k.roc_auc, k.pr_auc, coalesce(e.ece_10_bins, 0e0) AS ece_10_bins
 FROM {name}_c3 c LEFT JOIN {name}_k2 k USING ({g}) LEFT JOIN {name}_e e USING ({g})
)
"""


def rule_long_cte(src: str = "scored", keep: str = "") -> str:
    parts = [f"SELECT telemetry_id{keep}, '{TGT[0]}' AS target, {TGT[0]} AS y, overall_risk_score / 1e2 AS p FROM {src}"]
    for t, pfx in SYS_TARGETS:
        parts.append(f"SELECT telemetry_id{keep}, '{t}' AS target, {t} AS y, {r(f'{pfx}_score', 2)} / 1e2 AS p FROM {src}")
    return "rl AS (" + " UNION ALL ".join(parts) + ")\n"


def rnd(cols: list[str], src: str) -> str:
    return "SELECT " + ", ".join(cols) + f" FROM {src}"


ORACLE: dict[str, str] = {}

ORACLE["flagship_city_level"] = with_scored("telemetry") + f"""
SELECT city, overall_level, count(*) AS n, {r('avg(overall_score)', 6)} AS mean_overall_score
FROM scored GROUP BY city, overall_level
"""

ORACLE["r1_r4_system_scores"] = with_scored("telemetry") + f"""
SELECT telemetry_id,
 {r('p_score', 2)} AS power_grid_risk_score, {lvl('p_score')} AS power_grid_level, p_hits AS power_grid_hits,
 {aj('p_drivers')} AS power_grid_drivers, {aj('p_flags')} AS power_grid_flags,
 {r('t_score', 2)} AS transformer_overload_risk_score, {lvl('t_score')} AS transformer_overload_level, t_hits AS transformer_overload_hits,
 {aj('t_drivers')} AS transformer_overload_drivers, {aj('t_flags')} AS transformer_overload_flags,
 {r('w_score', 2)} AS water_pipeline_risk_score, {lvl('w_score')} AS water_pipeline_level, w_hits AS water_pipeline_hits,
 {aj('w_drivers')} AS water_pipeline_drivers, {aj('w_flags')} AS water_pipeline_flags,
 {r('r_pre_score', 2)} AS traffic_base_score, r_hits AS traffic_infrastructure_hits,
 {aj('r_drivers')} AS traffic_infrastructure_drivers
FROM scored
"""

ORACLE["r5_r7_cascades_overall"] = with_scored("telemetry") + f"""
SELECT telemetry_id, {aj('cascades')} AS cascades, cascade_multiplier, {r('traffic_adjustment', 4)} AS traffic_adjustment,
 {r('r_score', 2)} AS traffic_infrastructure_risk_score, {lvl('r_score')} AS traffic_infrastructure_level,
 {aj('r_flags')} AS traffic_infrastructure_flags, overall_risk_score, overall_level
FROM scored
"""

ORACLE["r8_confidence"] = with_scored("telemetry") + f"""
SELECT telemetry_id, {aj('missing_fields')} AS missing_fields, confidence_score FROM scored
"""

ORACLE["r9_r10_projection_zones"] = with_scored("telemetry") + f"""
SELECT telemetry_id, {r('projected_score', 2)} AS projected_score,
 (CASE WHEN projected_score > overall_score + 5e0 THEN 'Escalating' WHEN projected_score < overall_score - 5e0 THEN 'Improving'
  ELSE 'Stable-to-elevated' END) || ' trajectory with projected score ' || printf('%.1f', projected_score) || ' ('
  || {lvl('projected_score')} || ') by 72 hours based on current stress indicators.' AS hour_72_projection,
 {aj('''CASE WHEN len(zl) = 0 THEN ['Citywide monitoring zones with no immediate critical hotspot'] ELSE zl END''')} AS priority_zones
FROM (SELECT *, list_filter([
  CASE WHEN p_score >= 66 THEN 'Substation clusters with sustained grid load above 85%' END,
  CASE WHEN t_score >= 66 THEN 'Aging transformer corridors where age exceeds 20 years' END,
  CASE WHEN w_score >= 66 THEN 'Legacy water mains with pressure variance above 30%' END,
  CASE WHEN r_score >= 66 THEN 'High-congestion junctions with repeated signal failures' END,
  CASE WHEN c_d THEN 'Dense districts with overlapping aging power and water assets' END], lambda x: x IS NOT NULL) AS zl
 FROM scored)
"""

ORACLE["t1_t5_texts"] = with_scored("telemetry") + f"""
SELECT telemetry_id, array_to_string(list_transform(ranked, lambda x: x.name), {J}) AS ranked_systems,
 CASE overall_level
  WHEN 'LOW' THEN 'Low citywide stress; maintain routine monitoring with focus on ' || top_two || '.'
  WHEN 'MODERATE' THEN 'Elevated monitoring required in next 24 hours, centered on ' || top_two || '.'
  WHEN 'HIGH' THEN 'Pre-failure posture detected; activate standby crews for ' || top_two || ' within 24 hours.'
  ELSE 'Critical posture; initiate emergency response and staged load reduction for ' || top_two || ' immediately.' END
  AS hour_24_outlook,
 {SUMMARY} AS executive_summary,
 array_to_string(p_drivers[1:3], ', ') AS power_grid_top_drivers,
 array_to_string(t_drivers[1:3], ', ') AS transformer_overload_top_drivers,
 array_to_string(w_drivers[1:3], ', ') AS water_pipeline_top_drivers,
 array_to_string(r_drivers[1:3], ', ') AS traffic_infrastructure_top_drivers
FROM scored
"""

_RANGES = [("weather.temperature_c", "temperature_c", "-3e1", "65e0"), ("weather.humidity_percent", "humidity_percent", "0e0", "1e2"),
           ("weather.rainfall_mm", "rainfall_mm", "0e0", "6e2"),
           ("power_grid.current_load_percent", "current_load_percent", "0e0", "1e2"),
           ("power_grid.peak_load_percent", "peak_load_percent", "0e0", "1e2"),
           ("power_grid.historical_failure_rate_percent", "historical_failure_rate_percent", "0e0", "1e2"),
           ("power_grid.transformer_age_years", "transformer_age_years", "0e0", "8e1"),
           ("water_system.pressure_variance_percent", "pressure_variance_percent", "0e0", "1e2"),
           ("water_system.pipeline_age_years", "pipeline_age_years", "0e0", "1e2"),
           ("water_system.recent_repairs_last_30_days", "recent_repairs_last_30_days", "0e0", "5e1"),
           ("traffic_system.congestion_index", "congestion_index", "0e0", "1e2"),
           ("traffic_system.signal_failure_reports_last_7_days", "signal_failure_reports_last_7_days", "0e0", "1e2"),
           ("population_density_per_km2", "population_density_per_km2", "0e0", "15e4")]
_VIOL = "list_filter([CASE WHEN city IS NULL OR length(city) < 1 THEN 'city' END, " + ", ".join(
    f"CASE WHEN {c} IS NOT NULL AND ({c} < {lo} OR {c} > {hi}) THEN '{n}' END" for n, c, lo, hi in _RANGES
) + "], lambda x: x IS NOT NULL)"

ORACLE["f1_validation"] = oracle_with("telemetry") + f"""
SELECT telemetry_id, len(v) = 0 AS valid, {aj('v')} AS violations FROM (SELECT telemetry_id, {_VIOL} AS v FROM telemetry)
"""

ORACLE["f3_incident_systems"] = oracle_with("incidents") + "SELECT incident_id, s AS system_norm, " + ", ".join(
    f"coalesce(s IN {in_list(names)}, false) AS {t}" for t, names in SYSTEM_SYNONYMS.items()
) + f" FROM (SELECT incident_id, {SYS_NORM} AS s FROM incidents)"

ORACLE["f5_bool_coercion"] = """
SELECT event_id, raw,
 CASE WHEN raw IS NULL THEN false WHEN lower(trim(raw)) IN ('1', 'true', 't', 'yes', 'y') THEN true
      WHEN lower(trim(raw)) IN ('0', 'false', 'f', 'no', 'n', '') THEN false ELSE length(raw) > 0 END AS flag,
 coalesce((value - floor(value)) <> 0, false) AS value_flag
FROM (SELECT event_id, value, CASE event_id % 9 WHEN 0 THEN '1' WHEN 1 THEN ' Yes' WHEN 2 THEN 'n' WHEN 3 THEN 'FALSE'
 WHEN 4 THEN '' WHEN 5 THEN 'maybe' WHEN 6 THEN '0.0' WHEN 7 THEN ' t ' ELSE NULL END AS raw FROM events)
"""

ORACLE["s1_p1_json_roundtrip"] = oracle_with("telemetry") + "SELECT * EXCLUDE (timestamp) FROM telemetry"

ORACLE["p3_features"] = oracle_with("telemetry") + "," + FEAT_CTE + "SELECT * FROM feat"

ORACLE["j1_labels"] = oracle_with("telemetry", "incidents") + "," + LABEL_CTES + "SELECT * FROM lbl"

ORACLE["j1b_next_incident"] = oracle_with("telemetry", "incidents") + "," + LABEL_CTES + """
SELECT t.telemetry_id,
 epoch_us(min(i.ti)) - epoch_us(t.timestamp) AS next_overall_failure_72h_label_delta_us,
""" + ",\n".join(
    f" epoch_us(min(i.ti) FILTER (WHERE i.s IN {in_list(SYSTEM_SYNONYMS[t])})) - epoch_us(t.timestamp) AS next_{t}_delta_us"
    for t in TGT[1:]) + """
FROM telemetry t LEFT JOIN inc i ON t.city = i.city AND i.ti >= t.timestamp
GROUP BY t.telemetry_id, t.timestamp
"""

ORACLE["w8_trailing_counts"] = oracle_with("telemetry", "repair_events", "signal_events") + """,
rc AS (SELECT t.telemetry_id, CAST(count(r.repair_id) AS INTEGER) AS repairs_30d FROM telemetry t
 LEFT JOIN repair_events r ON t.city = r.city AND r.timestamp >= t.timestamp - INTERVAL 30 DAY AND r.timestamp <= t.timestamp
 GROUP BY t.telemetry_id),
sc AS (SELECT t.telemetry_id, CAST(count(s.report_id) AS INTEGER) AS signal_reports_7d FROM telemetry t
 LEFT JOIN signal_events s ON t.city = s.city AND s.timestamp >= t.timestamp - INTERVAL 7 DAY AND s.timestamp <= t.timestamp
 GROUP BY t.telemetry_id)
SELECT CASE WHEN copy < 2 THEN telemetry_id END AS telemetry_id, repairs_30d, signal_reports_7d
FROM rc JOIN sc USING (telemetry_id), (SELECT unnest([0, 1, 2]) AS copy)
"""


def weather_ctes(src: str) -> str:
    return f"""
wo AS (SELECT *, lower(trim(city)) AS wk FROM weather_obs),
wl AS (SELECT *, lower(trim(city)) AS wk FROM {src}),
wm AS (SELECT wl.*, o.obs_id, o.external_temperature_c AS et, o.external_precipitation_mm AS ep, o.external_wind_speed_kmh AS ew
 FROM wl ASOF LEFT JOIN wo o ON wl.wk = o.wk AND o.observed_at <= wl.timestamp),
wc AS (SELECT wm.*, cc.ck IS NOT NULL AS supported FROM wm LEFT JOIN (SELECT DISTINCT lower(trim(city)) AS ck FROM city_coords) cc ON wm.wk = cc.ck),
wd AS (SELECT *, supported AND obs_id IS NOT NULL AS ok FROM wc),
we AS (SELECT *,
 CASE WHEN ok AND temperature_c IS NOT NULL AND et IS NOT NULL THEN {r('et - temperature_c', 2)} END AS temperature_delta_c,
 CASE WHEN ok AND rainfall_mm IS NOT NULL AND ep IS NOT NULL THEN {r('ep - rainfall_mm', 2)} END AS rainfall_delta_mm FROM wd),
wx AS (SELECT *, CASE WHEN NOT supported THEN 'unsupported_city' WHEN NOT ok THEN 'fetch_failed' ELSE 'ok' END AS weather_status,
 ok AND (coalesce(abs(temperature_delta_c) >= 4, false) OR coalesce(rainfall_delta_mm >= 10, false) OR coalesce(ew >= 35, false))
  AS weather_anomaly_flag FROM we)
"""


ORACLE["j2_v3_weather"] = oracle_with("telemetry", "weather_obs", "city_coords") + "," + weather_ctes("telemetry") + """
SELECT telemetry_id, obs_id, weather_status, temperature_delta_c, rainfall_delta_mm, weather_anomaly_flag FROM wx
"""

ORACLE["v4_weather_uplift"] = with_scored("telemetry", "weather_obs", "city_coords") + "," + weather_ctes("scored") + f"""
SELECT telemetry_id,
 CASE WHEN hit THEN {r('least(1e2, overall_risk_score + 15e-1)', 2)} ELSE overall_risk_score END AS overall_risk_score,
 CASE WHEN hit THEN {lvl('least(1e2, overall_risk_score + 15e-1)')} ELSE overall_level END AS overall_level,
 hit AS uplift_note
FROM (SELECT *, weather_status = 'ok' AND weather_anomaly_flag AS hit FROM wx)
"""

ORACLE["a1_a2_stats"] = oracle_with("telemetry") + "," + FEAT_CTE + \
    ",md AS (SELECT " + ", ".join(f"coalesce(median(CAST({c} AS DOUBLE)), 0e0) AS {c}" for c in F29) + " FROM feat)\n" + \
    "\nUNION ALL\n".join(
        f"SELECT '{c}' AS feature, {r(f'any_value(md.{c})', 6)} AS median, "
        f"{r(f'avg(coalesce(CAST(f.{c} AS DOUBLE), md.{c}))', 6)} AS mean, "
        f"{r(f'CASE WHEN stddev_pop(coalesce(CAST(f.{c} AS DOUBLE), md.{c})) > 1e-9 THEN stddev_pop(coalesce(CAST(f.{c} AS DOUBLE), md.{c})) ELSE 1e0 END', 6)} AS std "
        f"FROM feat f, md" for c in F29)

ORACLE["a3_city_categories"] = oracle_with("telemetry") + "SELECT DISTINCT coalesce(city, 'UNKNOWN') AS city FROM telemetry"

ORACLE["a4_a5_class_balance"] = oracle_with("telemetry", "incidents") + "," + LABEL_CTES + "\nUNION ALL\n".join(
    f"SELECT '{t}' AS target, count(*) AS n, CAST(sum({t}) AS BIGINT) AS positives, "
    f"{r(f'CAST(sum({t}) AS DOUBLE) / CAST(count(*) AS DOUBLE)', 6)} AS prevalence, "
    f"{r(f'CAST(count(*) AS DOUBLE) / (2e0 * CAST(greatest(sum({t}), 1) AS DOUBLE))', 6)} AS pos_weight, "
    f"{r(f'CAST(count(*) AS DOUBLE) / (2e0 * CAST(greatest(count(*) - greatest(sum({t}), 1), 1) AS DOUBLE))', 6)} AS neg_weight, "
    f"count(DISTINCT {t}) >= 2 AS has_two_classes FROM lab" for t in TGT)

_PIN = oracle_with("telemetry") + "," + FEAT_CTE + "," + pinned_ctes() + "," + PROBS_CTE

ORACLE["m2_probabilities"] = _PIN + "SELECT * FROM probs"

_CONTRIB = "[" + ", ".join(
    f"{{'pos': {j}, 'feature': '{c}', 'c': ((coalesce(CAST(f.{c} AS DOUBLE), med_{c}) - mean_{c}) / std_{c}) * {dbl(pinned_weight(j, 0))}}}"
    for j, c in enumerate(F29)) + f", {{'pos': {len(F29)}, 'feature': 'city=' || f.city, 'c': coalesce(cw.w_0, 0e0)}}]"

ORACLE["m3_top_features"] = _PIN + f""",
ct AS (SELECT f.telemetry_id, unnest({_CONTRIB}, recursive := true) FROM feat f CROSS JOIN pst LEFT JOIN cw ON f.city = cw.city),
rk AS (SELECT *, row_number() OVER (PARTITION BY telemetry_id ORDER BY -abs(c), pos) AS rn,
  sum(abs(c)) OVER (PARTITION BY telemetry_id) AS den FROM ct)
SELECT telemetry_id, CAST(rn AS INTEGER) AS rank, feature,
 {r('abs(c) / (CASE WHEN den = 0 THEN 1e0 ELSE den END)', 4)} AS impact,
 CASE WHEN c >= 0 THEN 'increases_risk' ELSE 'reduces_risk' END AS direction, {r('c', 4)} AS logit_contribution
FROM rk WHERE rn <= 5
"""

_LS = with_labels_scored()

ORACLE["m4_metric_context"] = _LS + "," + rule_long_cte() + "," + metrics_ctes("rl", ["target"]) + f"""
SELECT {r('avg(pr_auc)', 6)} AS macro_pr_auc_holdout, {r('avg(positive_rate)', 6)} AS random_baseline_pr_auc,
 {r('avg(pr_auc) - avg(positive_rate)', 6)} AS uplift_vs_baseline FROM met
"""

ORACLE["m5_rule_probabilities"] = with_scored("telemetry") + f"""
SELECT telemetry_id,
 least(99e-2, greatest(1e-2, 1e-2 + 94e-2 * (overall_risk_score / 1e2))) AS prob_{TGT[0]},
""" + ",\n".join(
    f" least(99e-2, greatest(1e-2, 2e-2 + 92e-2 * ({r(f'{pfx}_score', 2)} / 1e2))) AS prob_{t}" for t, pfx in SYS_TARGETS
) + " FROM scored"

BLEND = 0.5929935889
QUALITY = 0.357484
_A, _RW = dbl(BLEND), dbl(1.0 - BLEND)
_Q = f"least(1e2, greatest(0e0, {dbl(QUALITY)} * 1e2))"


def _ov(pfx: str, t: str) -> str:
    ml = f"least(1e2, greatest(0e0, p_{t} * 1e2))"
    bl = f"least(1e2, greatest(0e0, {_RW} * {r(f'{pfx}_score', 2)} + {_A} * {ml}))"
    flags = f"{pfx}_flags" if pfx != "r" else "r_flags"
    name = SYS_NAME[pfx]
    return (f"{r(bl, 2)} AS {name}_risk_score, {lvl(bl)} AS {name}_level, "
            f"{aj(f'''list_append({flags}, 'ml_overlay_{t}=' || printf('%.1f', {ml}) || '_blend={BLEND:.2f}')''')} AS {name}_flags")


_OBL = f"least(1e2, greatest(0e0, {_RW} * overall_risk_score + {_A} * least(1e2, greatest(0e0, p_{TGT[0]} * 1e2))))"

ORACLE["v1_v2_overlay"] = _PIN + "," + scored_ctes("telemetry") + f"""
SELECT s.telemetry_id, {', '.join(_ov(pfx, t) for t, pfx in SYS_TARGETS)},
 {r(_OBL, 2)} AS overall_risk_score, {lvl(_OBL)} AS overall_level,
 CAST(least(1e2, greatest(0e0, confidence_score + CAST(round_even(({_Q} - 5e1) / 1e1, 0) AS INTEGER))) AS INTEGER) AS confidence_score,
 {SUMMARY} || ' ML overlay active with calibrated macro quality score ' || printf('%.1f', {_Q}) || '/100.' AS executive_summary
FROM scored s JOIN probs USING (telemetry_id)
"""

_SC = {k: r(f"{k}_score", 2) for k in ("p", "t", "w", "r")}
_N = "CAST(len(cascades) AS DOUBLE)"
_DF = "greatest(6e-1, least(25e-1, CASE WHEN x_dens > 0 THEN x_dens / 1e4 ELSE 1e0 END))"

ORACLE["v5_impact"] = with_scored("telemetry") + f""",
im AS (SELECT telemetry_id,
 ((34e-2 * {_SC['p']} + 16e-2 * {_SC['t']} + 24e-2 * {_SC['w']} + 26e-2 * {_SC['r']}) / 1e2) * (65e-1 * {_DF})
  * (1e0 + least(6e-1, 12e-2 * {_N})) * (22e-2 + 28e-2 * (CAST(confidence_score AS DOUBLE) / 1e2)) AS avoided,
 {_DF} AS dfac, least(45e0, 5e0 + (21e-2 * {_SC['r']}) + (18e-1 * {_N})) AS gain FROM scored)
SELECT telemetry_id, {r('greatest(0e0, avoided * (45000e0 * dfac))', 2)} AS estimated_cost_avoided_usd_72h,
 {r('greatest(0e0, avoided)', 2)} AS estimated_outage_hours_avoided_72h,
 {r('greatest(0e0, gain)', 2)} AS estimated_response_time_gain_percent FROM im
"""


def _zone(z) -> str:
    zid, name, mp, mt, mw, mr, bias, sens = z
    boost = f"least(8e0, {_N} * 14e-1)" if sens else f"least(4e0, {_N})"
    sc = (f"least(1e2, greatest(0e0, {dbl(mp)} * {_SC['p']} + {dbl(mt)} * {_SC['t']} + {dbl(mw)} * {_SC['w']}"
          f" + {dbl(mr)} * {_SC['r']} + {dbl(bias)} + {boost}))")
    return f"SELECT telemetry_id, '{zid}' AS zone_id, {sc} AS zone_score, {lvl(sc)} AS zone_level FROM scored"


ORACLE["v7_zone_scores"] = with_scored("telemetry") + "\nUNION ALL\n".join(_zone(z) for z in ZONES)

ORACLE["v8_zone_flows"] = with_scored("telemetry") + "\nUNION ALL\n".join(
    f"SELECT telemetry_id, '{a}' AS flow_from, '{b}' AS flow_to, '{lab}' AS flow_label, "
    f"least(95e-2, 5e-1 + {_N} * 7e-2) AS flow_strength FROM scored"
    for a, b, lab in [("west_industrial", "central_exchange", "Grid -> Junction"),
                      ("north_core", "central_exchange", "Signal Dependency"),
                      ("east_residential", "south_logistics", "Water -> Traffic")])


_LEVELS = sorted({pair for fields in STAGES.values() for pair in fields})
_STRESSED = sorted({c for c, _ in _LEVELS})


def _stage(stage: str) -> str:
    on = f"scenario_type IN ('{stage}', 'compound')"
    cast = lambda c, x: f"CAST({x} AS INTEGER)" if c in INT_FIELDS else x
    cols = [f"CASE WHEN {on} THEN coalesce({cast(c, f'{c}_{q}')}, {c}) ELSE {c} END AS {c}" for c, q in STAGES[stage]]
    return ", ".join(cols + ([f"CASE WHEN {on} THEN true ELSE heatwave_alert END AS heatwave_alert"] if stage == "heatwave" else []))


_STRESS = oracle_with("telemetry") + ",\nsv AS (" + " UNION ALL ".join(f"SELECT city, '{c}' AS field, {r(f'CAST({c} AS DOUBLE)', 1)} AS value FROM telemetry" for c in _STRESSED) + f"""),
sp AS (SELECT city, field, value, count(*) AS n FROM sv WHERE value IS NOT NULL GROUP BY ALL),
sr AS (SELECT *, sum(n) OVER (PARTITION BY city, field ORDER BY value) AS upto, sum(n) OVER (PARTITION BY city, field) AS total FROM sp),
sl AS (SELECT city AS stress_city, {", ".join(f"min(value) FILTER (field = '{c}' AND upto * 100 >= total * {q}) AS {c}_{q}" for c, q in _LEVELS)} FROM sr GROUP BY city),
sx AS (SELECT t.*, sl.*, s.scenario_type FROM telemetry t LEFT JOIN sl ON t.city IS NOT DISTINCT FROM sl.stress_city CROSS JOIN (VALUES ('baseline'), ('heatwave'), ('high_density'),
 ('failure_event'), ('compound')) s(scenario_type)),
sh AS (SELECT * REPLACE ({_stage('heatwave')}) FROM sx),
sd AS (SELECT * REPLACE ({_stage('high_density')}) FROM sh),
stressed AS (SELECT * REPLACE ({_stage('failure_event')}) FROM sd),
""" + scored_ctes("stressed")

ORACLE["v9_stress"] = _STRESS + f"""
SELECT telemetry_id, scenario_type, overall_risk_score, overall_level, {_SC['p']} AS power_grid_risk_score,
 {_SC['t']} AS transformer_overload_risk_score, {_SC['w']} AS water_pipeline_risk_score, {_SC['r']} AS traffic_infrastructure_risk_score
FROM scored
"""

_CONF = ["tp", "tn", "fp", "fn", "n"] + [r(c, 6) + f" AS {c}" for c in
                                         ("brier", "log_loss", "positive_rate", "accuracy", "precision", "recall", "f1")]

ORACLE["e1_e2_rule_confusion"] = _LS + "," + rule_long_cte() + "," + metrics_ctes("rl", ["target"]) + rnd(["target"] + _CONF, "met")

_PRED = oracle_with("telemetry", "incidents", "predictions") + ", pl AS (SELECT telemetry_id, y, p, 'predictions' AS source FROM predictions)"

ORACLE["e3_e4_prediction_calibration"] = _PRED + """,
bins AS (SELECT unnest(generate_series(0, 9)) AS bin),
ed AS (SELECT [0e0, 1e-1, 2e-1, CAST('0.30000000000000004' AS DOUBLE), 4e-1, 5e-1, CAST('0.6000000000000001' AS DOUBLE),
  CAST('0.7000000000000001' AS DOUBLE), 8e-1, 9e-1, 1e0] AS e),
pb AS (SELECT source, y, p, CASE """ + " ".join(
    f"WHEN p >= e[{i + 1}] AND p {'<=' if i == 9 else '<'} e[{i + 2}] THEN {i}" for i in range(10)) + f""" END AS bin FROM pl, ed),
g AS (SELECT source, bin, count(*) AS cnt, avg(p) AS pm, avg(CAST(y AS DOUBLE)) AS ym FROM pb WHERE bin IS NOT NULL GROUP BY ALL)
SELECT s.source, CAST(b.bin AS INTEGER) AS bin, ed.e[b.bin + 1] AS range_low, ed.e[b.bin + 2] AS range_high,
 coalesce(g.cnt, 0) AS count, {r('coalesce(g.pm, 0e0)', 6)} AS predicted_mean, {r('coalesce(g.ym, 0e0)', 6)} AS observed_rate
FROM (SELECT DISTINCT source FROM pl) s CROSS JOIN bins b CROSS JOIN ed LEFT JOIN g ON g.source = s.source AND g.bin = b.bin
"""

ORACLE["e3_rule_ece"] = _LS + "," + rule_long_cte() + "," + metrics_ctes("rl", ["target"]) + \
    f"SELECT target, {r('ece_10_bins', 6)} AS ece_10_bins FROM met_e"

ORACLE["e5_e7_prediction_curves"] = _PRED + "," + metrics_ctes("pl", ["source"]) + \
    f"SELECT source, {r('roc_auc', 6)} AS roc_auc, {r('pr_auc', 6)} AS pr_auc, {r('threshold', 6)} AS threshold FROM met_k2"

ORACLE["e5_e7_rule_curves"] = _LS + "," + rule_long_cte() + "," + metrics_ctes("rl", ["target"]) + \
    f"SELECT target, {r('roc_auc', 6)} AS roc_auc, {r('pr_auc', 6)} AS pr_auc, {r('threshold', 6)} AS threshold FROM met_k2"

ORACLE["e8_e9_e12_rule_macro"] = _LS + "," + rule_long_cte() + "," + metrics_ctes("rl", ["target"]) + f"""
SELECT {r('avg(pr_auc)', 6)} AS macro_pr_auc, {r('avg(positive_rate)', 6)} AS macro_random_baseline,
 {r('avg(pr_auc) - avg(positive_rate)', 6)} AS macro_uplift,
 {r('least(greatest(45e-2 + 4e-1 * avg(pr_auc), 4e-1), 75e-2)', 6)} AS blend_weight FROM met
"""

_IX = "ix AS (SELECT *, row_number() OVER (ORDER BY timestamp, city, telemetry_id) - 1 AS row_idx FROM scored),\n" \
      "nn AS (SELECT count(*) AS n FROM ix),\n" \
      "sp AS (SELECT n - greatest(1, CAST(floor(n * 2e-1) AS BIGINT)) AS split, n FROM nn)\n"

ORACLE["w1_w2_split"] = _LS + "," + _IX + """
SELECT telemetry_id, row_idx, CASE WHEN row_idx < split THEN 'train' ELSE 'holdout' END AS split FROM ix, sp
"""

_TESTS = _LS + "," + _IX + """,
par AS (SELECT n, greatest(150, CAST(floor(n * 5e-1) AS BIGINT)) AS mt, greatest(40, CAST(floor(n * 1e-1) AS BIGINT)) AS ts,
 greatest(20, CAST(floor(n * 1e-1) AS BIGINT)) AS st FROM nn),
wins AS (SELECT k, mt + k * st AS e, mt + k * st + ts AS te FROM (SELECT unnest(generate_series(0, (n - mt - ts) // st)) AS k, * FROM par)),
tests AS (SELECT ix.*, CAST(wins.k AS INTEGER) AS window_id FROM ix JOIN wins ON ix.row_idx >= wins.e AND ix.row_idx < wins.te),
"""

ORACLE["w3_e10_rule_backtest"] = _TESTS + rule_long_cte("tests", ", window_id") + "," + metrics_ctes("rl", ["target", "window_id"]) + "SELECT target, " + ", ".join(
    f"{r(f'avg({m})', 6)} AS {m}_mean, {r(f'stddev_pop({m})', 6)} AS {m}_std"
    for m in ("roc_auc", "pr_auc", "brier", "f1", "ece_10_bins")) + " FROM met GROUP BY target"

_MODELS = ("SELECT 'rule' AS model, target, y, p{k} FROM rl UNION ALL SELECT 'predictions', target, y, CAST(telemetry_id * 7919 % 1001 AS DOUBLE) / 1e3{k} FROM rl")

# windows repeat the rows of overlapping ranges; all ranges together hold each row once
ORACLE["e11_stability"] = _TESTS + rule_long_cte("tests", ", window_id") + ", wm AS (" + _MODELS.format(k=", window_id") + ")," + metrics_ctes("wm", ["model", "target", "window_id"], name="mw") + """,
um AS (SELECT model, target, y, p FROM (""" + _MODELS.format(k=", telemetry_id, window_id") + """) QUALIFY row_number() OVER (PARTITION BY model, target, telemetry_id ORDER BY window_id) = 1),
""" + metrics_ctes("um", ["model", "target"], name="mu") + f"""
SELECT model, target, 'pr_auc_std' AS measure, {r('stddev_pop(pr_auc)', 6)} AS value FROM mw GROUP BY model, target
UNION ALL SELECT model, 'all', 'mean_ece_10_bins', {r('avg(ece_10_bins)', 6)} FROM mu GROUP BY model
"""

ORACLE["w6_w7_l6_rule_compare"] = _LS + "," + _IX + """,
h AS (SELECT ix.*, row_idx - split AS h_idx FROM ix, sp WHERE row_idx >= split),
s AS (SELECT *, h_idx // 15 AS s_idx FROM h WHERE h_idx % 15 = 0),
sl AS (SELECT count(*) AS s_len FROM s),
picks AS (SELECT CASE WHEN i = 1199 THEN s_len - 1 ELSE CAST(floor(CAST(i AS DOUBLE) * (CAST(s_len - 1 AS DOUBLE) / 1199e0)) AS BIGINT) END AS pick
 FROM sl, (SELECT unnest(generate_series(0, 1199)) AS i)),
sample AS (SELECT s.* FROM s, sl WHERE sl.s_len <= 1200 OR s.s_idx IN (SELECT pick FROM picks)),
""" + rule_long_cte("sample") + "," + metrics_ctes("rl", ["target"]) + "SELECT target, n, " + ", ".join(
    f"{r(m, 6)} AS {m}" for m in ("positive_rate", "pr_auc", "roc_auc", "brier", "f1", "accuracy")) + " FROM met"

ORACLE["k1_history_newest"] = with_scored("telemetry") + """
SELECT 'asm_' || substr(sha256(concat_ws('|', CAST(telemetry_id AS VARCHAR), city)), 1, 12) AS assessment_id,
 telemetry_id, city, overall_risk_score
FROM scored ORDER BY timestamp DESC, assessment_id LIMIT 20
"""

def _texts(x: str) -> str:
    return f"CASE WHEN len({x}) = 0 THEN '[]' ELSE '[\"' || array_to_string({x}, '\",\"') || '\"]' END"


def _system_json(name: str, pfx: str) -> str:
    return (f"""'"{name}":{{"risk_score":' || CAST({pfx}_score AS VARCHAR) || ',"risk_level":"' || {lvl(f'{pfx}_score')} || '","primary_drivers":' || {_texts(f'{pfx}_drivers')}"""
            f""" || ',"compound_flags":' || {_texts(f'{pfx}_flags')} || '}}'""")


ORACLE["u6_reasoning_prompt"] = with_scored("telemetry") + f"""
SELECT telemetry_id, 'Generate an executive city infrastructure risk briefing.' || chr(10) || 'city=' || city || chr(10) || 'overall_score=' || printf('%.1f', overall_score) || chr(10)
 || 'overall_level=' || overall_level || chr(10) || 'systems={{' || """ + " || ',' || ".join(_system_json(SYS_NAME[k], k) for k in "ptwr") + f""" || '}}' || chr(10)
 || 'cascades=' || {_texts('cascades')} || chr(10) || 'confidence_score=' || CAST(confidence_score AS VARCHAR) || chr(10) || 'missing_fields=' || {_texts('missing_fields')} || chr(10)
 || 'Required style: concise, technical, actionable, no disclaimers.' AS reasoning_prompt FROM scored
"""

ORACLE["x1_stream_assessment"] = with_scored("telemetry") + """
SELECT telemetry_id, overall_risk_score, overall_level, confidence_score FROM scored
"""


def _blend(score: str, p: str) -> str:
    return f"least(1e2, greatest(0e0, {_RW} * {score} + {_A} * least(1e2, greatest(0e0, {p} * 1e2))))"


_OV_CTE = f"""
ov AS (SELECT s.*,
 {r(_blend(r('p_score', 2), 'p_power_failure_72h_label'), 2)} AS fp,
 {r(_blend(r('t_score', 2), 'p_transformer_overload_72h_label'), 2)} AS ft,
 {r(_blend(r('w_score', 2), 'p_water_failure_72h_label'), 2)} AS fw,
 {r(_blend(r('r_score', 2), 'p_traffic_failure_72h_label'), 2)} AS fr,
 {_OBL} AS ob,
 CAST(least(1e2, greatest(0e0, confidence_score + CAST(round_even(({_Q} - 5e1) / 1e1, 0) AS INTEGER))) AS INTEGER) AS conf2
 FROM scored s JOIN probs USING (telemetry_id))
"""

_DF2 = "greatest(6e-1, least(25e-1, CASE WHEN x_dens > 0 THEN x_dens / 1e4 ELSE 1e0 END))"
_AV2 = (f"((34e-2 * fp + 16e-2 * ft + 24e-2 * fw + 26e-2 * fr) / 1e2) * (65e-1 * {_DF2}) * (1e0 + least(6e-1, 12e-2 * {_N}))"
        f" * (22e-2 + 28e-2 * (CAST(conf2 AS DOUBLE) / 1e2))")

# the assessment blends the unrounded probabilities (no 6-place snapshot as in m2/v1)
PROBS_RAW_CTE = "probs AS (SELECT f.telemetry_id, " + ", ".join(
    f"{prob_sql(ti)} AS p_{t}" for ti, t in enumerate(TGT)) + " FROM feat f CROSS JOIN pst LEFT JOIN cw ON f.city = cw.city)\n"
_PIN_W = oracle_with("telemetry", "weather_obs", "city_coords") + "," + FEAT_CTE + "," + pinned_ctes() + "," + PROBS_RAW_CTE

ORACLE["v6_assessment"] = _PIN_W + "," + scored_ctes("telemetry") + "," + _OV_CTE + "," + weather_ctes("ov") + f"""
SELECT CASE WHEN copy < 2 THEN telemetry_id END AS telemetry_id, city,
 CASE WHEN hit THEN {r('least(1e2, ' + r('ob', 2) + ' + 15e-1)', 2)} ELSE {r('ob', 2)} END AS overall_risk_score,
 CASE WHEN hit THEN {lvl('least(1e2, ' + r('ob', 2) + ' + 15e-1)')} ELSE {lvl('ob')} END AS overall_level,
 conf2 AS confidence_score, weather_status,
 {r(f'greatest(0e0, ({_AV2}) * (45000e0 * {_DF2}))', 2)} AS estimated_cost_avoided_usd_72h,
 {r(f'greatest(0e0, {_AV2})', 2)} AS estimated_outage_hours_avoided_72h,
 {r(f'greatest(0e0, least(45e0, 5e0 + (21e-2 * fr) + (18e-1 * {_N})))', 2)} AS estimated_response_time_gain_percent,
 CAST(5 AS INTEGER) AS n_top_features, 25e-2 AS uplift_vs_baseline, CAST(3 AS INTEGER) AS n_assumptions
FROM (SELECT *, weather_status = 'ok' AND weather_anomaly_flag AS hit FROM wx WHERE humidity_percent IS NULL OR humidity_percent BETWEEN 0 AND 100), (SELECT unnest([0, 1, 2]) AS copy)
"""

ORACLE["v6_rejected"] = oracle_with("telemetry") + "SELECT telemetry_id, 'weather.humidity_percent' AS violations FROM telemetry WHERE humidity_percent > 100"

ORACLE["s2_csv_roundtrip"] = oracle_with("telemetry") + """
SELECT city, count(*) AS n, count(temperature_c) AS n_temperature, CAST(sum(recent_repairs_last_30_days) AS BIGINT) AS repairs, max(peak_load_percent) AS max_peak,
 CAST(sum(CASE WHEN heatwave_alert THEN 1 ELSE 0 END) AS BIGINT) AS heatwaves FROM telemetry GROUP BY city
"""

ORACLE["s5_labeled_sink"] = oracle_with("telemetry", "incidents") + "," + LABEL_CTES + """
SELECT CAST(CAST(t.timestamp AS DATE) AS VARCHAR) AS date, count(*) AS n, """ + ", ".join(f"CAST(sum(l.{t}) AS BIGINT) AS {t}" for t in TGT) + """
FROM telemetry t JOIN lbl l ON t.telemetry_id = l.telemetry_id GROUP BY CAST(t.timestamp AS DATE)
"""

ORACLE["s6_s7_history"] = with_scored("telemetry") + """
SELECT city, overall_level, count(*) AS n, count(*) AS n_ids FROM scored GROUP BY city, overall_level
"""

ORACLE["s2_csv_incidents_labeled"] = oracle_with("telemetry", "incidents") + "," + LABEL_CTES + f"""
SELECT city, 'incidents' AS source, count(*) AS n, CAST(sum(severity) AS BIGINT) AS total, CAST(sum(length(system)) AS BIGINT) AS text FROM incidents GROUP BY city
UNION ALL SELECT city, 'labeled', count(*), CAST(sum({' + '.join(TGT)}) AS BIGINT), count(temperature_c) FROM lab GROUP BY city
"""

# the labels are those of all incidents at once
ORACLE["s5_relabel"] = oracle_with("telemetry", "incidents") + "," + LABEL_CTES + """,
ends AS (SELECT CAST(min(timestamp) AS DATE) AS a, CAST(max(timestamp) AS DATE) AS b FROM incidents),
late AS (SELECT timestamp AS ti FROM incidents, ends WHERE city IS NOT NULL AND timestamp >= a + CAST((b - a) * 9 // 10 AS INTEGER)),
days AS (SELECT CAST(timestamp AS DATE) AS day, count(*) AS n, """ + ", ".join(f"CAST(sum({t}) AS BIGINT) AS {t}" for t in TGT) + """ FROM lab GROUP BY ALL)
SELECT CAST(day AS VARCHAR) AS date, n, """ + ", ".join(TGT) + """,
 EXISTS (SELECT 1 FROM late WHERE day BETWEEN CAST(ti - INTERVAL 72 HOURS AS DATE) AND CAST(ti AS DATE)) AS rewritten FROM days
"""

ORACLE["s9_pipeline_model"] = ORACLE["m2_probabilities"]

ORACLE["s9_model_roundtrip"] = ORACLE["m2_probabilities"]

ORACLE["p2_bad_text"] = """
SELECT event_id, CASE WHEN event_id % 7 < 2 THEN NULL ELSE CAST(event_id % 100 AS DOUBLE) END AS temperature_c,
 CAST(event_id % 9 AS DOUBLE) + CASE WHEN event_id % 2 = 0 THEN 5e-1 ELSE 0e0 END AS recent_repairs_last_30_days FROM events
"""

ORACLE["k2_sort"] = oracle_with("telemetry") + """
SELECT telemetry_id, CAST(row_number() OVER (PARTITION BY city ORDER BY timestamp, telemetry_id) AS INTEGER) AS place FROM telemetry
"""

ORACLE["w7_downsample"] = oracle_with("telemetry") + """,
ix AS (SELECT telemetry_id, row_number() OVER (ORDER BY timestamp, city, telemetry_id) - 1 AS row_idx, count(*) OVER () AS n FROM telemetry),
want AS (SELECT k, (SELECT max(n) FROM ix) AS n FROM range(100) AS r(k)),
pick AS (SELECT 100 AS wanted, CAST(CASE WHEN k = 99 THEN n - 1 ELSE floor(k * ((n - 1) / 99e0)) END AS BIGINT) AS row_idx FROM want UNION ALL SELECT 1, 0)
SELECT CAST(p.wanted AS INTEGER) AS wanted, i.row_idx, i.telemetry_id FROM pick p JOIN ix i ON p.row_idx = i.row_idx
"""

ORACLE["w4_w5_folds"] = _LS + "," + _IX + f""",
c AS (SELECT count(*) AS n FROM ix),
win AS (SELECT k AS window_id, greatest(150, n // 2) + k * greatest(20, n // 10) AS train_end, n FROM c, range(20) AS r(k)),
cal AS (SELECT window_id, train_end, least(greatest(80, CAST(floor(85e-2 * train_end) AS BIGINT)), train_end - 1) AS calibration
 FROM win WHERE train_end + greatest(40, n // 10) <= n),
fold AS (SELECT *, greatest(40, CAST(floor(calibration * 1e-1) AS BIGINT)) AS size FROM cal, range(4) AS r(f) WHERE calibration >= 160),
b AS (SELECT window_id, train_end, calibration, f, size, calibration // 2 + (calibration - size - calibration // 2) * f // 3 AS a FROM fold)
SELECT CAST(window_id AS INTEGER) AS window_id, CAST(train_end AS INTEGER) AS train_end, CAST(calibration AS INTEGER) AS calibration, CAST(f AS INTEGER) AS fold,
 CAST(a AS INTEGER) AS fold_train_end, CAST(a + size AS INTEGER) AS fold_valid_end,
 CAST((SELECT sum({TGT[0]}) FROM ix WHERE row_idx < a) AS BIGINT) AS positives FROM b
"""

ORACLE["l1_fit_checks"] = oracle_with("telemetry", "incidents") + "," + LABEL_CTES + "\nUNION ALL\n".join(
    f"""SELECT '{t}' AS target, count(*) AS n, CAST(sum({t}) AS BIGINT) AS positives, true AS converged,
 {r(f"count(*) / (2e0 * greatest(sum({t}), 1))", 6)} AS pos_weight, {r(f"count(*) / (2e0 * greatest(count(*) - greatest(sum({t}), 1), 1))", 6)} AS neg_weight,
 {r(f"sum({t}) / CAST(count(*) AS DOUBLE)", 6)} AS positive_rate FROM lbl""" for t in TGT)

# What holds of any fitted models: the folds that count, one chosen family a target, and that its mean is the best
ORACLE["l7_family_choice"] = _LS + "," + _IX + """,
p AS (SELECT split AS n, least(5, greatest(2, split // 40)) AS k, split // (least(5, greatest(2, split // 40)) + 1) AS part FROM sp),
f AS (SELECT i, n - part * i AS a, n - part * (i - 1) AS b FROM p, range(1, 6) AS r(i) WHERE i <= k AND n >= 80),
y AS (""" + " UNION ALL ".join(f"SELECT '{t}' AS target, row_idx, {t} AS y FROM ix" for t in TGT) + """),
o AS (SELECT target, i, min(y) FILTER (WHERE row_idx < a) <> max(y) FILTER (WHERE row_idx < a)
  AND min(y) FILTER (WHERE row_idx >= a AND row_idx < b) <> max(y) FILTER (WHERE row_idx >= a AND row_idx < b) AS counts FROM y, f GROUP BY ALL),
g AS (SELECT target, count(*) FILTER (WHERE counts) AS folds FROM o GROUP BY target)
SELECT target, family, CAST(n AS BIGINT) AS rows, folds, CAST(CASE WHEN folds > 0 THEN 1 ELSE 0 END AS BIGINT) AS n_chosen,
 CASE WHEN folds > 0 THEN true END AS chosen_is_best, CASE WHEN folds > 0 THEN true END AS in_range
FROM g, p, (SELECT unnest(['logistic_balanced', 'random_forest_balanced', 'extra_trees_balanced']) AS family)
"""

ORACLE["x5_stream_dedupe"] = oracle_with("telemetry") + "SELECT city, count(DISTINCT timestamp) AS n FROM telemetry GROUP BY city"

_COPIES = "(SELECT unnest([0, 1, 2]) AS copy)"
# on streams every row occurs once
ORACLE["x1_live_assessment"] = "SELECT * EXCLUDE (n_top_features, uplift_vs_baseline, n_assumptions) FROM (" + ORACLE["v6_assessment"].replace(_COPIES, "(SELECT 0 AS copy)") + ")"
ORACLE["x3_live_labels"] = ORACLE["j1_labels"]
ORACLE["x4_live_counts"] = ORACLE["w8_trailing_counts"].replace(_COPIES, "(SELECT 0 AS copy)")
ORACLE["x2_replayed_history"] = ORACLE["s6_s7_history"]
ORACLE["s4_timestamp_counts"] = oracle_with("telemetry") + """
SELECT count(*) AS rows, count(*) FILTER (WHERE telemetry_id % 50 = 0) AS unparsable, count(*) FILTER (WHERE telemetry_id % 50 <> 0 AND telemetry_id % 70 = 1) AS nulls,
 count(*) FILTER (WHERE telemetry_id % 50 <> 0 AND telemetry_id % 70 <> 1) AS parsed,
 CAST(sum(epoch_us(timestamp) // 1000000) FILTER (WHERE telemetry_id % 50 <> 0 AND telemetry_id % 70 <> 1) AS BIGINT) AS seconds FROM telemetry
"""
ORACLE["s8_report_versions"] = ORACLE["flagship_city_level"]
