"""Sources/sinks (history store, CSV, requests JSON) and streaming equals batch."""

import os
import uuid

from pyspark.sql import functions as F

from infrarisk.functions import validate as V
from infrarisk.operators import rules
from infrarisk.session import ensure_checkpoint_dir
from infrarisk.sources import fixtures as fx
from infrarisk.sources import io
from infrarisk.streaming import stream as X

SF = "/root/testdata/sf0.001"


def scratch(spark):
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/t-{uuid.uuid4().hex}"


def test_history_append_read_newest(spark):
    base = scratch(spark)
    s = rules.score(fx.telemetry(spark, SF))
    hist = io.to_history(s, ["city", "timestamp", "temperature_c"], ["overall_risk_score", "overall_level"])
    io.append_history(hist, base)
    io.append_history(hist.limit(5), base)  # replays keep their ids
    back = io.read_history(spark, base)
    assert back.count() == s.count() + 5
    assert back.select("assessment_id").distinct().count() == s.count()
    assert back.where(~F.col("assessment_id").rlike("^asm_[0-9a-f]{12}$")).count() == 0
    top = io.newest(back, 500).collect()
    assert len(top) == 200  # N is clipped to 1..200
    # corrupt lines are skipped, a missing store reads as empty
    local = base.replace("file:", "", 1)
    date_dirs = [d for d in os.listdir(local) if d.startswith("date=")]
    with open(os.path.join(local, date_dirs[0], "corrupt.json"), "w") as fh:
        fh.write("{not json\n")
    assert io.read_history(spark, base).count() == s.count() + 5
    assert io.read_history(spark, base + "-missing").count() == 0


def test_csv_roundtrip_and_labeled_sink(spark):
    base = scratch(spark)
    t = fx.telemetry(spark, SF).drop("telemetry_id")
    t.write.option("header", True).csv(f"{base}/tel")
    back = io.read_telemetry_csv(spark, f"{base}/tel")
    assert back.count() == t.count() and back.schema == io.TELEMETRY
    io.write_labeled(back.withColumn("overall_failure_72h_label", F.lit(0)), f"{base}/lab")
    assert spark.read.parquet(f"{base}/lab").count() == t.count()


def test_request_json_source(spark, example_request):
    base = scratch(spark)
    example_request.write.json(base)
    req = io.read_requests(spark, base)
    flat = V.flatten(req)
    assert flat.first()["recent_repairs_last_30_days"] == 5


def test_validation_and_coercion(spark):
    v = V.validate(fx.telemetry(spark, SF))
    assert v.where(~F.col("valid")).count() == 4  # humidity 140 rows (FIXTURES.md)
    ok, bad = V.split_valid(fx.telemetry(spark, SF))
    assert bad.first()["violations"] == ["weather.humidity_percent"]
    df = spark.createDataFrame([("1",), (" Yes",), ("n",), ("",), ("maybe",), (None,), ("0.0",)], "s string")
    assert [r[0] for r in df.select(V.to_bool("s")).collect()] == [True, True, False, False, True, False, True]
    txt = spark.createDataFrame([("12.5",), ("abc",), (None,)], "current_load_percent string")
    assert [r[0] for r in V.coerce_numeric(txt, ["current_load_percent"]).collect()] == [12.5, None, None]


def test_stream_equals_batch(spark):
    base = scratch(spark)
    tel = X.telemetry_stream(X.events_stream(spark, SF))
    out = rules.score(tel).select("telemetry_id", "overall_risk_score", "executive_summary")
    X.run_available_now(out, f"{base}/out", f"{base}/ck")
    got = spark.read.parquet(f"{base}/out")
    want = rules.score(fx.telemetry(spark, SF)).select("telemetry_id", "overall_risk_score", "executive_summary")
    assert got.count() == want.count()
    assert got.exceptAll(want).count() == 0


def test_stream_live_labels_match_batch_positives(spark):
    from infrarisk.operators import labels as LB
    tel, inc = fx.telemetry(spark, SF), fx.incidents(spark, SF)
    matches = X.live_label_matches(tel, inc)  # same operator applied to batch frames
    lab = X.labels_from_matches(matches)
    batch = LB.label(tel, inc).select("telemetry_id", "overall_failure_72h_label", "power_failure_72h_label")
    assert lab.select("telemetry_id", "overall_failure_72h_label", "power_failure_72h_label").exceptAll(batch).count() == 0


def test_stream_history_exactly_once(spark):
    base = scratch(spark)
    tel = X.telemetry_stream(X.events_stream(spark, SF))
    assessed = rules.score(tel)
    X.stream_history(assessed, f"{base}/hist", f"{base}/ck", ["city", "timestamp"], ["overall_risk_score"])
    # a second run with the same checkpoint finds nothing new: no duplicates
    X.stream_history(rules.score(X.telemetry_stream(X.events_stream(spark, SF))), f"{base}/hist", f"{base}/ck",
                     ["city", "timestamp"], ["overall_risk_score"])
    back = io.read_history(spark, f"{base}/hist")
    assert back.count() == fx.telemetry(spark, SF).count()


def test_parse_timestamps_and_sort(spark):
    import pytest
    from infrarisk.operators import splits as SP
    df = spark.createDataFrame([("2024-01-01 00:00:00", "b"), ("2024-01-02 00:00:00", "a")], "timestamp string, city string")
    parsed = V.parse_timestamps(df)
    assert dict(parsed.dtypes)["timestamp"] == "timestamp"
    assert [r["city"] for r in SP.sort_by_city_time(parsed).collect()] == ["a", "b"]
    broken = spark.createDataFrame([("not a time",), (None,), ("2024-01-01 00:00:00",)], "timestamp string")
    with pytest.raises(Exception, match="not a time"):
        V.parse_timestamps(broken).collect()
    assert V.parse_timestamps(broken.where("timestamp IS NULL")).collect()[0][0] is None  # a null source passes
    assert sum(r[0] is None for r in V.parse_timestamps(broken, strict=False).collect()) == 2


def test_stream_live_labels_driven(spark):
    """X3 on real streams: every emitted label agrees with the batch labels (rows whose 72 h
    window is still open at the end of the input are not emitted yet as negatives)."""
    from infrarisk.operators import labels as LB
    base = scratch(spark)
    tel = X.telemetry_stream(X.events_stream(spark, SF))
    inc = X.incidents_stream(X.events_stream(spark, SF))
    matches = X.live_label_matches(tel, inc).select("telemetry_id", "i_ts", "i_sys")
    X.run_available_now(matches, f"{base}/out", f"{base}/ck")
    got = X.labels_from_matches(spark.read.parquet(f"{base}/out"))
    want = LB.label(fx.telemetry(spark, SF), fx.incidents(spark, SF)).select(
        "telemetry_id", F.col("overall_failure_72h_label").alias("want"))
    joined = got.join(want, "telemetry_id")
    assert joined.count() > 0
    assert joined.where(F.col("overall_failure_72h_label") != F.col("want")).count() == 0


def test_stream_dedupe_and_trailing_counts(spark):
    """X5 keeps one row per (city, timestamp); X4 emits day-aligned 30-day window counts that never
    exceed the batch total of the city."""
    base = scratch(spark)
    tel = X.telemetry_stream(X.events_stream(spark, SF))
    X.run_available_now(X.dedupe(tel).select("telemetry_id", "city", "timestamp"), f"{base}/dd", f"{base}/ck1")
    dd = spark.read.parquet(f"{base}/dd")
    assert dd.count() == dd.select("city", "timestamp").distinct().count() == fx.telemetry(spark, SF).count()
    rep = spark.sql(fx.VIEW_SQL["repair_events"], events=X.events_stream(spark, SF))
    counts = X.trailing_counts_stream(rep, 30, "1 day", "1 day").select("city", "window.start", "n")
    X.run_available_now(counts, f"{base}/tc", f"{base}/ck2")
    out = spark.read.parquet(f"{base}/tc")
    totals = fx.repair_events(spark, SF).groupBy("city").count()
    assert out.count() > 0
    assert out.join(totals, "city").where(F.col("n") > F.col("count")).count() == 0


def test_broken_requests_are_quarantined(spark, example_request):
    base = scratch(spark)
    line = example_request.select(F.to_json(F.struct("*")).alias("value"))
    line.unionByName(spark.createDataFrame([("{broken",), ("",)], "value string")).coalesce(1).write.text(base)
    assert io.read_requests(spark, base).count() == 1
    assert [r.line for r in io.read_rejected_requests(spark, base).collect()] == ["{broken"]


def test_history_errors_are_raised(spark):
    import pytest

    base = scratch(spark)
    hist = io.to_history(rules.score(fx.telemetry(spark, SF)), ["city"], ["overall_level"])
    two = hist.limit(1).unionByName(hist.limit(1))
    assert two.select("assessment_id").distinct().count() == 1
    io.append_history(two, base)
    with pytest.raises(Exception, match="(?i)scheme|filesystem"):
        io.read_history(spark, "nosuchscheme://x/y").count()


def test_ids_of_equal_city_and_time(spark):
    t = fx.telemetry(spark, SF).limit(1)
    two = t.unionByName(t.withColumn("telemetry_id", F.col("telemetry_id") + 1))
    assert io.to_history(rules.score(two), ["city"], ["overall_level"]).select("assessment_id").distinct().count() == 2


def test_rejected_and_response(spark, example_request):
    from infrarisk.plans.assess import assess, rejected, respond

    flat = V.flatten(example_request).withColumn("telemetry_id", F.lit(1))
    both = flat.unionByName(flat.withColumns({"telemetry_id": F.lit(2), "humidity_percent": F.lit(140.0)}))
    out = respond(assess(both)).collect()
    assert [r.telemetry_id for r in out] == [1] and [r.telemetry_id for r in rejected(both).collect()] == [2]
    r = out[0].response
    assert r.systems.power_grid.risk_score == 100 and r.systems.water_pipeline.risk_score == 72.94 and r.confidence_score == 95
    assert r.impact_model.estimated_outage_hours_avoided_72h == 6.03 and r.impact_model.estimated_cost_avoided_usd_72h == 374644.75
    assert r.ml_insights is None and r.external_signal is None and r.overall_risk["24_hour_outlook"]


def test_fractions_and_white_space(spark):
    from infrarisk.operators.labels import normalize_system

    df = spark.createDataFrame([("3.5", 3.5, 3, " \tPower Grid\n")], "temperature_c string, recent_repairs_last_30_days double, signal_failure_reports_last_7_days int, s string")
    r = V.coerce_numeric(df).withColumn("s", normalize_system("s")).first()
    assert r.temperature_c == 3.5 and r.recent_repairs_last_30_days == 3.5 and r.signal_failure_reports_last_7_days == 3 and r.s == "power_grid"


def test_json_bundle(spark):
    import json

    base = scratch(spark)
    one = {"preprocessor": {"numeric_features": ["a", "b"], "city_categories": ["X", "Y"], "medians": {"a": 1.0, "b": 2.0}, "means": {"a": 0.5, "b": 0.0}, "stds": {"a": 2.0, "b": 0.0}},
           "model": {"weights": [0.4, -0.2, 0.1, -0.3], "bias": 0.05}, "threshold": 0.4}
    spark.createDataFrame([(json.dumps({"targets": {"t": one}, "global_metrics": {"macro_pr_auc_holdout": 0.3}}),)], "value string").coalesce(1).write.text(base)
    models, thresholds, world = io.read_bundle(spark, base)
    assert thresholds == {"t": 0.4} and world["macro_pr_auc_holdout"] == 0.3
    import math

    from infrarisk.operators.infer import predict

    df = spark.createDataFrame([("X", 3.0, None), ("Z", None, 1.0)], "city string, a double, b double")
    io.save_model(models, f"{base}-saved", thresholds)
    loaded, again = io.load_model(spark, f"{base}-saved")
    assert again == thresholds
    for m in (models, loaded):
        p = [r.p_t for r in predict(df, m).orderBy("city").collect()]
        want = [1 / (1 + math.exp(-(0.4 * (3 - 0.5) / 2 - 0.2 * 2 + 0.1 + 0.05))), 1 / (1 + math.exp(-(0.4 * (1 - 0.5) / 2 - 0.2 * 1 + 0.05)))]
        assert all(abs(x - y) < 1e-12 for x, y in zip(p, want, strict=True))


def _live(spark, build, slices=3):
    base = scratch(spark)
    events = X.replayed(spark, SF, f"{base}/events", slices)
    X.run_available_now(build(lambda v: X.view_stream(events, v), X.closing(events)), f"{base}/out", f"{base}/ck")
    return spark.read.parquet(f"{base}/out")


def test_live_processors_equal_batch(spark):
    """Labels, weather matches and trailing counts from state equal the batch operators, rows without a city or id included."""
    from pyspark.sql import functions as F

    from infrarisk.operators import labels as LB
    from infrarisk.operators import weather as WE
    from infrarisk.streaming import stateful as S

    S.use_rocksdb(spark)
    odd = lambda t: t.withColumns({"city": F.when(F.col("telemetry_id") % 17 != 0, F.col("city")), "telemetry_id": F.when(F.col("telemetry_id") % 13 != 0, F.col("telemetry_id"))})
    tel = odd(fx.telemetry(spark, SF))

    def same(got, want):
        got = got.select(*want.columns)
        assert got.count() == want.count() and got.exceptAll(want).count() == 0

    same(_live(spark, lambda view, ends: S.live_labels(odd(view("telemetry")), view("incidents"), ends=ends)), LB.label(tel, fx.incidents(spark, SF)))
    same(_live(spark, lambda view, ends: S.live_weather(odd(view("telemetry")), view("weather_obs"), 24, ends=ends)), WE.asof_weather(tel, fx.weather_obs(spark, SF), 24).drop("__wk"))
    kinds = {"a": ("repair_events", 30), "b": ("signal_events", 7)}
    same(_live(spark, lambda view, ends: S.live_counts(odd(view("telemetry")), {k: (view(v), d) for k, (v, d) in kinds.items()}, ends=ends)),
         LB.trailing_counts(tel, {k: (fx.view(spark, SF, v), d) for k, (v, d) in kinds.items()}))


def test_live_processors_share_slots(spark):
    """Cities share slots of state, so keys do not grow with cities; slices in several files arrive whole."""
    from infrarisk.operators import labels as LB
    from infrarisk.operators import weather as WE
    from infrarisk.streaming import stateful as S

    S.use_rocksdb(spark)
    base, tel = scratch(spark), fx.telemetry(spark, SF)
    events = X.replayed(spark, SF, f"{base}/events", 2, rows_per_file=200)
    view, ends = lambda v: X.view_stream(events, v), X.closing(events)
    assert tel.select("city").distinct().count() > 2
    made = {"labels": S.live_labels(view("telemetry"), view("incidents"), ends=ends, slots=2, bucket_hours=24), "weather": S.live_weather(view("telemetry"), view("weather_obs"), ends=ends, slots=2),
            "counts": S.live_counts(view("telemetry"), {"a": (view("repair_events"), 30)}, ends=ends, slots=2)}
    want = {"labels": LB.label(tel, fx.incidents(spark, SF)), "weather": WE.asof_weather(tel, fx.weather_obs(spark, SF)).drop("__wk"), "counts": LB.trailing_counts(tel, {"a": (fx.repair_events(spark, SF), 30)})}
    for name, got in made.items():
        X.run_available_now(got, f"{base}/{name}", f"{base}/ck-{name}")
        back = spark.read.parquet(f"{base}/{name}").select(*want[name].columns)
        assert back.count() == tel.count() and back.exceptAll(want[name]).count() == 0


def test_assess_keeps_rows(spark):
    """Repeated and null ids: one row in, one row out, with the weather of its own city and time."""
    from pyspark.sql import functions as F

    from infrarisk.plans.assess import assess

    obs, coords = fx.weather_obs(spark, SF), fx.city_coords(spark, SF)
    tel = fx.telemetry(spark, SF)
    once = assess(tel, weather_obs=obs, city_coords=coords).groupBy("weather_status").count().collect()
    thrice = tel.withColumn("copy", F.explode(F.array(*map(F.lit, range(3))))).withColumn("telemetry_id", F.when(F.col("copy") > 0, F.col("telemetry_id"))).drop("copy")
    assert {r[0]: r[1] for r in assess(thrice, weather_obs=obs, city_coords=coords).groupBy("weather_status").count().collect()} == {r[0]: 3 * r[1] for r in once}


def test_reports_without_a_manifest_are_not_read(spark):
    import pytest

    from infrarisk.sources import io

    base = scratch(spark)
    with pytest.raises(FileNotFoundError):
        io.read_report(spark, base)
    assert [io.publish_report(spark.range(n), base) for n in (2, 5)] == [1, 2]
    spark.range(9).write.parquet(f"{base}/versions/000003-lost")
    assert io.read_report(spark, base).count() == 5


def test_relabel_equals_a_full_run(spark):
    """Late incidents: same labels as all at once; other days' files stay; repeated rows, odd rows and a second run change nothing."""
    import datetime as dt

    from infrarisk.operators import labels as LB
    from infrarisk.plans.relabel import relabel, touched_dates
    from infrarisk.schema import TARGET_COLUMNS

    t0 = dt.datetime(2024, 3, 1)
    tel = [(i, t0 + dt.timedelta(hours=5 * i) if i % 17 else None, f"c{i % 3}" if i % 11 else None) for i in range(120)]
    tel = spark.createDataFrame(tel + tel[:30], "telemetry_id long, timestamp timestamp, city string")
    early = spark.createDataFrame([(t0 + dt.timedelta(hours=40), "c1", "power")], "timestamp timestamp, city string, system string")
    late = spark.createDataFrame([(t0 + dt.timedelta(days=12, hours=1), "c2", " Water Pipeline"), (t0 + dt.timedelta(days=3), "c0", "signals"),
                                  (t0 + dt.timedelta(days=12, hours=1), "c2", " Water Pipeline"), (None, "c1", "power"), (t0 + dt.timedelta(days=20), None, "power")], early.schema)
    path = f"{ensure_checkpoint_dir(spark)}/relabel-{uuid.uuid4().hex}"
    io.write_labeled(LB.label(tel, early), path)
    files = lambda: {(r["date"], r["f"]) for r in spark.read.parquet(path).select("date", F.input_file_name().alias("f")).distinct().collect()}
    before = files()
    days = relabel(spark, path, late)
    assert days == touched_dates(late) == [dt.date(2024, 3, d) for d in (1, 2, 3, 4, 10, 11, 12, 13)]
    kept = {x for x in before if x[0] not in days}
    assert kept and kept == {x for x in files() if x[0] not in days} and not {x for x in before if x[0] in days} & files()
    key = lambda df: sorted(map(str, df.select("telemetry_id", "timestamp", "city", *TARGET_COLUMNS).collect()))
    full = key(LB.label(tel, early.unionByName(late)))
    assert key(spark.read.parquet(path)) == full
    relabel(spark, path, late)
    assert key(spark.read.parquet(path)) == full
    settled = files()
    assert relabel(spark, path, late.where("city IS NULL")) == [] and files() == settled
