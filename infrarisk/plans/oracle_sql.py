"""Hand-written DuckDB SQL for the oracle check (independent of the Spark expression builders).

Numeric literals are written in e-notation so DuckDB treats them as DOUBLE (not DECIMAL).
Rounding: ``CAST(printf('%.nf', x) AS DOUBLE)`` equals Python ``round`` (DuckDB ``round`` does not).
"""

from __future__ import annotations

from ..sources.fixtures import oracle_with


def r(x: str, n: int) -> str:
    return f"CAST(printf('%.{n}f', {x}) AS DOUBLE)"


def f(x: str, n: int) -> str:
    return f"printf('%.{n}f', {x})"


def cap(x: str) -> str:
    return f"least(1e2, greatest(0e0, {x}))"


def lvl(x: str) -> str:
    return (f"CASE WHEN {x} <= 35 THEN 'LOW' WHEN {x} <= 65 THEN 'MODERATE' "
            f"WHEN {x} <= 85 THEN 'HIGH' ELSE 'CRITICAL' END")


def lst(*items: str) -> str:
    """List of the non-null items, in order."""
    return f"list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)"


def b(cond: str) -> str:
    return f"(CASE WHEN {cond} THEN 1 ELSE 0 END)"


def when(cond: str, val: str, other: str = "0e0") -> str:
    return f"(CASE WHEN {cond} THEN {val} ELSE {other} END)"


DENSE_AGING = "(x_dens > 10000 AND (x_tage > 20 OR x_page > 25))"

# Rule scoring over a source relation with flat telemetry columns.
SCORED_CTES = """
s0 AS (
 SELECT *,
  coalesce(current_load_percent, 0e0) AS x_cur, coalesce(peak_load_percent, 0e0) AS x_peak,
  coalesce(historical_failure_rate_percent, 0e0) AS x_hist, coalesce(transformer_age_years, 0e0) AS x_tage,
  coalesce(heatwave_alert, false) AS x_hw, coalesce(rainfall_mm, 0e0) AS x_rain,
  coalesce(pressure_variance_percent, 0e0) AS x_pv, coalesce(pipeline_age_years, 0e0) AS x_page,
  coalesce(CAST(recent_repairs_last_30_days AS DOUBLE), 0e0) AS x_rep,
  coalesce(congestion_index, 0e0) AS x_cong,
  coalesce(CAST(signal_failure_reports_last_7_days AS DOUBLE), 0e0) AS x_sig,
  coalesce(population_density_per_km2, 0e0) AS x_dens
 FROM {src}
),
s1 AS (
 SELECT *,
  HITS_P AS p_hits, HITS_T AS t_hits, HITS_W AS w_hits, HITS_R AS r_hits,
  BASE_P AS p_base, BASE_T AS t_base, BASE_W AS w_base, BASE_R AS r_base,
  BONUS_P AS p_bonus, BONUS_T AS t_bonus, BONUS_W AS w_bonus, BONUS_R AS r_bonus,
  MISSING AS missing_fields
 FROM s0
),
s2 AS (
 SELECT *,
  CAP_P AS p_score, CAP_T AS t_score, CAP_W AS w_score, CAP_R AS r_pre_score,
  DRV_P AS p_drivers, DRV_T AS t_drivers, DRV_W AS w_drivers, DRV_R AS r_drivers,
  FLG_P AS p_flags, FLG_T AS t_flags, FLG_W AS w_flags, FLG_R AS r_flags0
 FROM s1
),
s3 AS (
 SELECT *,
  least(14e0, 5e0 + 12e-2 * (p_score - 66e0)) AS imp_p,
  least(12e0, 4e0 + 1e-1 * (w_score - 66e0)) AS imp_w,
  p_score >= 66 AS c_p, (w_score >= 66 AND x_dens > 10000) AS c_w, x_cong > 75 AS c_c, DENSE_AGING AS c_d
 FROM s2
),
s4 AS (
 SELECT *,
  (CASE WHEN c_p THEN imp_p ELSE 0e0 END) + (CASE WHEN c_w THEN imp_w ELSE 0e0 END) AS traffic_adjustment,
  1e0 + (CASE WHEN c_p THEN 3e-2 ELSE 0e0 END) + (CASE WHEN c_w THEN 3e-2 ELSE 0e0 END)
      + (CASE WHEN c_c THEN 2e-2 ELSE 0e0 END) + (CASE WHEN c_d THEN 5e-2 ELSE 0e0 END) AS cascade_multiplier,
  list_filter([
   CASE WHEN c_p THEN 'power_to_traffic_signal_dependency (impact +' || printf('%.1f', imp_p) || ' traffic risk)' END,
   CASE WHEN c_w THEN 'water_burst_to_traffic_disruption_in_dense_zones (impact +' || printf('%.1f', imp_w) || ' traffic risk)' END,
   CASE WHEN c_c THEN 'extreme_congestion_emergency_response_delay' END,
   CASE WHEN c_d THEN 'population_density_plus_aging_infrastructure_amplification' END], lambda x: x IS NOT NULL) AS cascades
 FROM s3
),
s5 AS (
 SELECT *,
  least(1e2, greatest(0e0, r_pre_score + traffic_adjustment)) AS r_score,
  CASE WHEN traffic_adjustment > 0 THEN list_append(r_flags0, 'cascading_adjustment_plus_' || printf('%.1f', traffic_adjustment))
       ELSE r_flags0 END AS r_flags,
  95e0 - CAST(len(missing_fields) AS DOUBLE) * 5e0
   - (CASE WHEN historical_failure_rate_percent IS NULL OR historical_failure_rate_percent < 5 THEN 1e1 ELSE 0e0 END)
   - (CASE WHEN (CASE WHEN x_hw THEN 1 ELSE 0 END) + (CASE WHEN x_rain > 20 THEN 1 ELSE 0 END)
        + (CASE WHEN x_cur > 80 THEN 1 ELSE 0 END) + (CASE WHEN x_cong > 70 THEN 1 ELSE 0 END)
        + (CASE WHEN x_rep > 2 THEN 1 ELSE 0 END) = 0 THEN 8e0 ELSE 0e0 END) AS conf_raw
 FROM s4
),
s6 AS (
 SELECT *,
  least(1e2, greatest(0e0, (33e-2 * p_score + 17e-2 * t_score + 25e-2 * w_score + 25e-2 * r_score) * cascade_multiplier)) AS overall_score,
  CAST(least(1e2, greatest(0e0, conf_raw)) AS INTEGER) AS confidence_score,
  -- rank of each system by score desc, ties in system order
  (CASE WHEN x_hw AND x_cur > 85 THEN 8e0 WHEN x_hw THEN 4e0 ELSE 0e0 END)
   + (CASE WHEN x_peak > 90 THEN 3e0 ELSE 0e0 END) + (CASE WHEN x_rain > 40 THEN 5e0 ELSE 0e0 END)
   + (CASE WHEN x_pv > 30 THEN 2e0 ELSE 0e0 END) + (CASE WHEN x_cong > 75 THEN 3e0 ELSE 0e0 END)
   + (CASE WHEN x_sig > 5 THEN 2e0 ELSE 0e0 END) + (CASE WHEN x_rep > 3 THEN 2e0 ELSE 0e0 END)
   + (CASE WHEN DENSE_AGING THEN 3e0 ELSE 0e0 END) AS proj_delta
 FROM s5
),
s7 AS (
 SELECT *,
  least(1e2, greatest(0e0, overall_score + proj_delta)) AS projected_score,
  list_sort([{'k': -p_score, 'o': 0, 'name': 'power_grid', 'score': p_score},
             {'k': -t_score, 'o': 1, 'name': 'transformer_overload', 'score': t_score},
             {'k': -w_score, 'o': 2, 'name': 'water_pipeline', 'score': w_score},
             {'k': -r_score, 'o': 3, 'name': 'traffic_infrastructure', 'score': r_score}]) AS ranked
 FROM s6
),
scored AS (
 SELECT *,
  LVL_OVERALL AS overall_level,
  ROUND_OVERALL AS overall_risk_score,
  replace(ranked[1].name, '_', ' ') || ', ' || replace(ranked[2].name, '_', ' ') AS top_two
 FROM s7
)
"""


def _sys_sql(prefix: str, rules: list[tuple[str, str, float]], base: str, default: str, flag_prefix: str,
             extra: tuple[str, str, str | None] | None):
    hits = " + ".join(b(c) for _, c, _ in rules)
    bonus = " + ".join(when(c, v) for _, c, v in rules)
    drivers = lst(*[f"CASE WHEN {c} THEN '{d}' END" for d, c, _ in rules])
    drv = f"CASE WHEN len({drivers}) = 0 THEN ['{default}'] ELSE {drivers} END"
    mult = f"(CASE WHEN {prefix}_hits >= 3 THEN 115e-2 WHEN {prefix}_hits = 2 THEN 110e-2 ELSE 1e0 END)"
    raw = f"(({prefix}_base + {prefix}_bonus) * {mult})"
    flag_items = [f"CASE WHEN {prefix}_hits >= 3 THEN '{flag_prefix}15pct' WHEN {prefix}_hits = 2 THEN '{flag_prefix}10pct' END"]
    if extra:
        cond, text, m = extra
        if m is not None:
            raw = f"({raw} * (CASE WHEN {cond} THEN {m} ELSE 1e0 END))"
        flag_items.append(f"CASE WHEN {cond} THEN '{text}' END")
    return hits, base, bonus, cap(raw), drv, lst(*flag_items)


def scored_ctes(src: str) -> str:
    p = _sys_sql("p", [("current_load_percent>85", "x_cur > 85", "8e0"), ("peak_load_percent>90", "x_peak > 90", "7e0"),
                       ("transformer_age_years>20", "x_tage > 20", "6e0"), ("heatwave_alert=true", "x_hw", "5e0"),
                       ("historical_failure_rate_percent>15", "x_hist > 15", "6e0")],
                 "(32e-2 * x_cur + 22e-2 * x_peak + 18e-2 * " + cap("(x_tage / 4e1) * 1e2") + " + 18e-2 * "
                 + cap("x_hist * 4e0") + " + 1e-1 * (CASE WHEN x_hw THEN 1e2 ELSE 0e0 END))",
                 "baseline_load_and_asset_profile", "multi_factor_amplification_",
                 ("x_hw AND x_cur > 85", "heatwave_plus_high_load_extra_amplification", "108e-2"))
    t = _sys_sql("t", [("peak_load_percent>90", "x_peak > 90", "10e0"), ("current_load_percent>85", "x_cur > 85", "8e0"),
                       ("transformer_age_years>20", "x_tage > 20", "9e0"),
                       ("historical_failure_rate_percent>15", "x_hist > 15", "4e0"), ("heatwave_alert=true", "x_hw", "4e0")],
                 "(38e-2 * x_peak + 34e-2 * x_cur + 2e-1 * " + cap("(x_tage / 35e0) * 1e2") + " + 8e-2 * "
                 + cap("x_hist * 35e-1") + ")",
                 "baseline_transformer_load_profile", "overload_intersection_amplification_",
                 ("x_peak > 90 AND x_tage > 20", "aging_assets_under_peak_demand", None))
    w = _sys_sql("w", [("pressure_variance_percent>30", "x_pv > 30", "10e0"), ("pipeline_age_years>25", "x_page > 25", "9e0"),
                       ("rainfall_mm>40", "x_rain > 40", "8e0"), ("recent_repairs_last_30_days>3", "x_rep > 3", "7e0")],
                 "(36e-2 * x_pv + 28e-2 * " + cap("(x_page / 6e1) * 1e2") + " + 22e-2 * " + cap("(x_rain / 8e1) * 1e2")
                 + " + 14e-2 * " + cap("(x_rep / 1e1) * 1e2") + ")",
                 "baseline_hydraulic_and_maintenance_profile", "water_stress_compound_amplification_",
                 ("x_rain > 40 AND x_pv > 30", "storm_pressure_instability_intersection", None))
    rr = _sys_sql("r", [("congestion_index>75", "x_cong > 75", "10e0"), ("signal_failure_reports_last_7_days>5", "x_sig > 5", "8e0"),
                        ("population_density_per_km2>10000", "x_dens > 10000", "7e0")],
                  "(48e-2 * x_cong + 3e-1 * " + cap("(x_sig / 15e0) * 1e2") + " + 22e-2 * " + cap("(x_dens / 2e4) * 1e2") + ")",
                  "baseline_traffic_and_signal_profile", "traffic_compound_amplification_", None)
    missing = lst(*[f"CASE WHEN {c} IS NULL THEN '{n}' END" for n, c in [
        ("weather.temperature_c", "temperature_c"), ("weather.humidity_percent", "humidity_percent"),
        ("weather.heatwave_alert", "heatwave_alert"), ("weather.rainfall_mm", "rainfall_mm"),
        ("power_grid.current_load_percent", "current_load_percent"), ("power_grid.peak_load_percent", "peak_load_percent"),
        ("power_grid.historical_failure_rate_percent", "historical_failure_rate_percent"),
        ("power_grid.transformer_age_years", "transformer_age_years"),
        ("water_system.pressure_variance_percent", "pressure_variance_percent"),
        ("water_system.pipeline_age_years", "pipeline_age_years"),
        ("water_system.recent_repairs_last_30_days", "recent_repairs_last_30_days"),
        ("traffic_system.congestion_index", "congestion_index"),
        ("traffic_system.signal_failure_reports_last_7_days", "signal_failure_reports_last_7_days"),
        ("population_density_per_km2", "population_density_per_km2")]])
    sql = SCORED_CTES.replace("{src}", src)
    for key, parts in (("P", p), ("T", t), ("W", w), ("R", rr)):
        hits, base, bonus, capped, drv, flg = parts
        sql = (sql.replace(f"HITS_{key} ", f"({hits}) ").replace(f"BASE_{key} ", f"{base} ")
               .replace(f"BONUS_{key} ", f"({bonus}) ").replace(f"CAP_{key} ", f"{capped} ")
               .replace(f"DRV_{key} ", f"{drv} ").replace(f"FLG_{key} ", f"{flg} "))
    sql = sql.replace("MISSING ", f"{missing} ").replace("DENSE_AGING", DENSE_AGING)
    sql = sql.replace("LVL_OVERALL ", lvl("overall_score") + " ").replace("ROUND_OVERALL ", r("overall_score", 2) + " ")
    return sql


def with_scored(*views: str, src: str = "telemetry") -> str:
    """``WITH`` fixture views + the scoring chain ending in relation ``scored``."""
    return oracle_with(*views) + "," + scored_ctes(src)
