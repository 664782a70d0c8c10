"""MLlib fit reaches the same optimum as the weighted gradient objective; inference path."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from infrarisk.operators import features as FE
from infrarisk.operators import infer as IN
from infrarisk.plans import queries as Q
from infrarisk.plans import train as TR
from infrarisk.schema import MODEL_NUMERIC_FEATURES

SF = "/root/testdata/sf0.001"


def test_mllib_fit_matches_numpy_objective(spark):
    lab = Q.labeled(spark, SF)
    feats = FE.feature_frame(lab, include_targets=True, keep=["telemetry_id"])
    t = "overall_failure_72h_label"
    m = TR.fit_logistic(feats, t, 0.003, max_iter=500, tol=1e-12)
    pdf = IN.predict(feats, [m]).toPandas()
    # rebuild the design matrix the same way and check the gradient of the weighted objective is ~0
    X = np.column_stack([((pdf[c].astype(float).fillna(m.pre.medians[c]) - m.pre.means[c]) /
                          (m.pre.stds[c] if m.pre.stds[c] > 0 else 1.0)).to_numpy() for c in MODEL_NUMERIC_FEATURES])
    cw = dict(m.city_weights.toPandas().values)
    C = np.column_stack([(pdf["city"] == c).astype(float).to_numpy() for c in cw])
    Xf = np.hstack([X, C])
    w = np.array([m.weights[c] for c in MODEL_NUMERIC_FEATURES] + list(cw.values()))
    y = pdf[t].to_numpy().astype(float)
    n, pos = len(y), max(1, int(y.sum()))
    sw = np.where(y == 1, n / (2 * pos), n / (2 * max(1, n - pos)))
    p = 1 / (1 + np.exp(-(Xf @ w + m.bias)))
    grad_w = Xf.T @ ((p - y) * sw) / n + 0.003 * w
    grad_b = np.mean((p - y) * sw)
    assert np.abs(grad_w).max() < 1e-4 and abs(grad_b) < 1e-4
    assert np.allclose(p, pdf[f"p_{t}"].to_numpy(), atol=1e-9)


def test_unknown_city_gets_zero_weight(spark):
    feats = Q.features_of(spark, SF)
    m = Q.pinned_models(spark, SF, feats)[0]
    a = IN.predict(feats.limit(1), [m]).first()
    b = IN.predict(feats.limit(1).withColumn("city", F.lit("nowhere")), [m]).first()
    assert a["p_overall_failure_72h_label"] != b["p_overall_failure_72h_label"]
    top = IN.top_contributions(feats.limit(3), m).first()["top_features"]
    assert len(top) == 5 and all(x["impact"] >= 0 for x in top)
    assert abs(top[0]["logit_contribution"]) >= abs(top[-1]["logit_contribution"])


def test_fits_over_ranges_match_single_fits(spark):
    """All fits of a run converge to the optimum of the single fit; scoring and the inference model agree."""
    from infrarisk.operators import splits as SP
    from infrarisk.plans.fits import Fits, Job

    feats = FE.feature_frame(Q.labeled(spark, SF), include_targets=True, keep=["timestamp", "telemetry_id"])
    idx = SP.global_index(feats, Q.ORDER).cache()
    jobs = [Job((t, e, 0.006), t, e, 0.006) for t in ("overall_failure_72h_label", "traffic_failure_72h_label") for e in (200, 300)]
    fits = Fits(idx, jobs[:3], ends=(300,))
    at = fits.more(jobs[3:])
    assert at == {j.key: k for k, j in enumerate(jobs)}
    report = fits.report().collect()
    assert len(report) == 4 and all(r.converged and r.iterations > 0 for r in report) and {r.rows for r in report} == {200, 300}
    for k in (0, 3):
        j, m = jobs[k], fits.model(k)
        one = TR.fit_logistic(idx.where(F.col("row_idx") < j.end), j.target, j.l2, max_iter=500, tol=1e-12)
        assert np.allclose([m.weights[c] for c in MODEL_NUMERIC_FEATURES], [one.weights[c] for c in MODEL_NUMERIC_FEATURES], atol=5e-2)
        rows = idx.where((F.col("row_idx") >= 300) & (F.col("row_idx") < 360))
        p = {r.telemetry_id: r[f"p_{j.target}"] for r in IN.predict(rows, [one]).collect()}
        q = {r.telemetry_id: r[f"p_{j.target}"] for r in IN.predict(rows, [m]).collect()}
        assert max(abs(p[i] - q[i]) for i in p) < 0.02
        got = sorted(r.p for r in fits.score([(k, 300, 360)]).collect())
        assert np.allclose(got, sorted(q.values()), atol=1e-9)
    assert fits.score([(0, 300, 300)]).count() == 0
    fits.close()
    idx.unpersist()


def test_one_class_gives_no_model(spark):
    from infrarisk.operators import splits as SP
    from infrarisk.plans.fits import Fits, Job

    t = "overall_failure_72h_label"
    feats = FE.feature_frame(Q.labeled(spark, SF), include_targets=True, keep=["timestamp", "telemetry_id"])
    idx = SP.global_index(feats, Q.ORDER).withColumn(t, F.lit(0))
    fits = Fits(idx, [Job(t, t, 100, 0.001), Job("none", t, 0, 0.001)])
    assert not fits.weights and fits.report().count() == 0 and fits.score([(0, 0, 50)]).count() == 0
    fits.close()


def test_backtest_of_one_target(spark):
    from infrarisk.plans import backtest as BT

    t = "overall_failure_72h_label"
    long, summary, macro = BT.backtest(Q.labeled(spark, SF), [t], 0.5, 0.2, 0.3)
    rows = long.collect()
    assert len(rows) == 2 and {r.window_id for r in rows} == {0, 1} and all(0.05 <= r.threshold <= 0.95 for r in rows)
    s = summary.first()
    assert s.windows_evaluated == 2 and abs(s.pr_auc_mean - sum(r.pr_auc for r in rows) / 2) < 1e-12
    assert macro.first()[0] == s.pr_auc_mean


def test_family_choice(spark):
    from infrarisk.operators import splits as SP
    from infrarisk.plans import families as FM

    assert FM.time_series_folds(79) == [] and FM.time_series_folds(80) == [(28, 54), (54, 80)]
    assert FM.time_series_folds(600) == [(100, 200), (200, 300), (300, 400), (400, 500), (500, 600)]
    feats = FE.feature_frame(Q.labeled(spark, SF), include_targets=True, keep=["timestamp", "telemetry_id"])
    idx = SP.global_index(feats, Q.ORDER)
    t = ["overall_failure_72h_label"]
    got = {r.family: r for r in FM.choose_family(idx, 100, t, forest=FM.Forest(trees=3, depth=2)).collect()}
    assert set(got) == set(FM.FAMILIES) and sum(r.chosen for r in got.values()) == 1
    best = max(got.values(), key=lambda r: r.mean_pr_auc)
    assert [r.mean_pr_auc for r in got.values() if r.chosen] == [best.mean_pr_auc]
    none = FM.choose_family(idx, 50, t).collect()
    assert len(none) == 3 and not any(r.chosen or r.folds for r in none)


def test_medians_are_exact(spark):
    from infrarisk.operators import stats as ST

    rng = np.random.default_rng(3)
    rows = [(int(i % 3), float(rng.integers(0, 9)), None if i % 4 == 0 else float(rng.random()), None) for i in range(500)]
    df = spark.createDataFrame(rows, "g int, a double, b double, c double")
    pdf = df.toPandas()
    assert ST.medians(df, ["a", "b", "c"]) == {"a": pdf.a.median(), "b": pdf.b.median(), "c": 0.0}
    got = {(r.g, r.feature): r.median for r in ST.grouped_medians(df, ["a", "b"], ["g"]).collect()}
    assert got == {(g, c): p[c].median() for g, p in pdf.groupby("g") for c in ("a", "b")}


def test_ranges_know_their_rows(spark):
    """Medians, means, deviations and classes of nested ranges, each row being read once: as of each range alone."""
    from infrarisk.operators import splits as SP
    from infrarisk.operators import stats as ST
    from infrarisk.plans.fits import Ranges

    feats = FE.feature_frame(Q.labeled(spark, SF), include_targets=True, keep=["timestamp", "telemetry_id"])
    gap = F.when(F.col("row_idx") % 3 == 0, F.lit(float("nan"))).when(F.col("row_idx") >= 120, F.col("humidity_percent"))
    idx = SP.global_index(feats, Q.ORDER).withColumn("humidity_percent", gap).cache()
    ends = [0, 101, 10**6]
    ranges = Ranges(idx, ends)
    assert ranges.count[0] == 0 and ranges.count[101] == 101 and ranges.count[10**6] == idx.count()
    for e in ends[1:]:
        rows = idx.where(F.col("row_idx") < e)
        clean = rows.withColumn("humidity_percent", F.when(~F.isnan("humidity_percent"), F.col("humidity_percent")))
        pre = ST.fit_preprocessor(clean, MODEL_NUMERIC_FEATURES)
        med, mean, std = ranges.pre[e]
        assert med.tolist() == [pre.medians[c] for c in MODEL_NUMERIC_FEATURES]
        assert np.allclose(mean, [pre.means[c] for c in MODEL_NUMERIC_FEATURES], rtol=1e-9, atol=1e-12) and np.allclose(std, [pre.stds[c] for c in MODEL_NUMERIC_FEATURES], rtol=1e-9)
        assert ranges.positives[e][0] == rows.agg(F.sum("overall_failure_72h_label")).first()[0]
    # a value is one row, not a row a range: the widest table does not grow with ranges
    assert ST.prefix_medians(ranges.data.withColumn("block", F.lit(0)), "block", 30, ["x0"]).count() == 1
    ranges.close()
    idx.unpersist()


def test_training_run(spark):
    """Configs by folds, thresholds and metrics on the whole holdout, refit; strict mode keeps the training models."""
    targets = ["overall_failure_72h_label", "traffic_failure_72h_label"]
    lab = Q.labeled(spark, SF)
    n = lab.count()
    b = TR.train_models(lab, targets=targets)
    assert b.rows == n and set(b.targets) == set(targets) and 0.4 <= b.blend_weight <= 0.75
    for f in b.targets.values():
        assert f.holdout["n"] == max(1, int(n * 0.2))
        assert 0.05 <= f.threshold <= 0.95 and f.l2 in f.cv and max(v[0] for v in f.cv.values() if v[0] is not None) == f.cv[f.l2][0]
    names = {(r.target, r.metric) for r in TR.report_table(b).collect()}
    assert ("__global__", "macro_pr_auc_holdout") in names and (targets[0], "threshold") in names
    strict = TR.train_models(lab, targets=targets[:1], refit=False, embargo_rows=10)
    assert strict.targets[targets[0]].model.bias != b.targets[targets[0]].model.bias


def test_pipeline_stages(spark, tmp_path):
    """Learned stages equal the functions, survive saving, and give unknown and missing cities no weight."""
    import uuid

    from pyspark.ml import Pipeline, PipelineModel

    from infrarisk.operators import stages as SG
    from infrarisk.operators import stats as ST
    from infrarisk.session import ensure_checkpoint_dir

    rows = [(i, f"c{i % 3}" if i % 7 else None, float(i % 5) if i % 4 else None, float(i), 2.0) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, city string, a double, b double, constant double")
    names, scaled = ["a", "b", "constant"], ["za", "zb", "zc"]
    last = SG.LinearProbability(inputCols=scaled, outputCol="p", weights=[0.5, -0.25, 3.0], bias=0.125, cities=["c0", "c1"], cityWeights=[1.0, -2.0])
    fitted = Pipeline(stages=[SG.MedianScaler(inputCols=names, outputCols=scaled), last]).fit(df)
    pre = fitted.stages[0].preprocessor()
    assert (pre.medians, pre.means, pre.stds) == (lambda p: (p.medians, p.means, p.stds))(ST.fit_preprocessor(df, names))
    assert pre.stds["constant"] == 1.0
    path = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    fitted.write().save(path)
    got = {r["id"]: r["p"] for r in PipelineModel.load(path).transform(df).collect()}
    for i, city, a, b, _ in rows:
        za = ((pre.medians["a"] if a is None else a) - pre.means["a"]) / pre.stds["a"]
        z = 0.5 * za - 0.25 * (b - pre.means["b"]) / pre.stds["b"] + {"c0": 1.0, "c1": -2.0}.get(city, 0.0) + 0.125
        assert abs(got[i] - 1 / (1 + np.exp(-z))) < 1e-12
    nobody = SG.LinearProbability(inputCols=["b"], outputCol="p", weights=[0.0])
    assert {r["p"] for r in nobody.transform(df).collect()} == {0.5}


def test_city_weights_are_joined(spark):
    """Thousands of known cities cost a row one look-up: a broadcast join in the plan, no map searched from its start."""
    from infrarisk.operators import stages as SG

    n = 3000
    stage = SG.LinearProbability(inputCols=["b"], outputCol="p", weights=[1.0], cities=[f"c{k}" for k in range(n)], cityWeights=[k / n for k in range(n)])
    df = spark.createDataFrame([("c7", 0.0), ("c2999", 0.5), ("c3000", 0.5), (None, 0.5)], "city string, b double")
    got = stage.transform(df)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftOuter" in plan and "map(" not in plan and got.columns == ["city", "b", "p"]
    want = {"c7": 7 / n, "c2999": 0.5 + 2999 / n, "c3000": 0.5, None: 0.5}
    assert {r.city: r.p for r in got.collect()} == pytest.approx({c: 1 / (1 + 2.718281828459045 ** -z) for c, z in want.items()}, abs=1e-12)


def test_top_contributions_rank_once(spark):
    """the features of a row are sorted and summed once, not again for each filter and listed feature; ties keep feature order."""
    from infrarisk.operators import stats as ST

    names = ["a", "b", "c", "d"]
    pre = ST.Preprocessor(names, dict.fromkeys(names, 0.0), dict.fromkeys(names, 0.0), dict.fromkeys(names, 1.0))
    model = IN.LinearModel("t", pre, {"a": 1.0, "b": -1.0, "c": 0.5, "d": 0.0}, 0.0,
                           spark.createDataFrame([("X", -2.0)], "city string, weight double"))
    rows = spark.createDataFrame([("X", 2.0, 2.0, None, 7.0), ("Y", 0.0, 0.0, 0.0, 0.0), (None, 1.0, -3.0, 8.0, 1.0)], "city string, a double, b double, c double, d double")
    got = {r["city"]: [tuple(t) for t in r["top_features"]] for r in IN.top_contributions(rows, model, k=9).collect()}
    up, down = "increases_risk", "reduces_risk"
    assert got["X"] == [(1, "a", 0.3333, up, 2.0), (2, "b", 0.3333, down, -2.0), (3, "city=X", 0.3333, down, -2.0), (4, "c", 0.0, up, 0.0), (5, "d", 0.0, up, 0.0)]
    assert [t[1:3] for t in got["Y"]] == [("a", 0.0), ("b", 0.0), ("c", 0.0), ("d", 0.0), ("city=Y", 0.0)]
    assert [t[1:3] for t in got[None]][:3] == [("c", 0.5), ("b", 0.375), ("a", 0.125)]

    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        plan = Q.q_m3_top_features(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert plan.count("sort_array(") + plan.count("array_sort(") == 1 and plan.count("aggregate(") == 1


def test_fits_share_their_jobs(spark):
    """a pass over the rows is a job for all fits of a group, not a job for each iteration of each fit; each ends at its optimum."""
    from infrarisk.operators import splits as SP
    from infrarisk.plans.fits import Fits, Job

    feats = FE.feature_frame(Q.labeled(spark, SF), include_targets=True, keep=["timestamp", "telemetry_id"])
    gap = F.when(F.col("row_idx") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("humidity_percent"))
    idx = SP.global_index(feats, Q.ORDER).withColumn("humidity_percent", gap)
    fits = Fits(idx, [], ends=(150, 300))
    sc = spark.sparkContext
    sc.setJobGroup("fits-of-a-group", "")
    try:
        fits.more([Job((t, e, c["l2"]), t, e, c["l2"]) for t in ("overall_failure_72h_label", "traffic_failure_72h_label") for e in (150, 300) for c in TR.CONFIGS])
        jobs = len(sc.statusTracker().getJobIdsForGroup("fits-of-a-group"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(fits.weights) == 12 and all(w.converged for w in fits.weights.values()) and jobs <= 40
    rows = fits.data.orderBy("row").toPandas()
    for k, w in fits.weights.items():
        j = fits.jobs[k]
        own = rows[rows.row < j.end]
        med, mean, std = fits.pre[j.end]
        x = np.column_stack([(own[f"x{i}"].fillna(m).to_numpy(float) - mu) / s for i, (m, mu, s) in enumerate(zip(med, mean, std))])
        y = own[f"y{fits.targets.index(j.target)}"].to_numpy()
        up, down = fits.class_weights(j.target, j.end)
        p = 1 / (1 + np.exp(-(x @ w.coefficients[:29] + w.coefficients[29:][own.bucket] + w.intercept)))
        rest = np.where(y == 1, up, down) * (p - y) / len(y)
        assert np.abs(x.T @ rest + j.l2 * w.coefficients[:29]).max() < 1e-6 and abs(rest.sum()) < 1e-6
        assert np.abs(np.bincount(own.bucket, weights=rest, minlength=fits.width) + j.l2 * w.coefficients[29:]).max() < 1e-6
    fits.close()


def test_newton_goes_back_when_a_step_is_too_long(spark):
    """from a start far off, where a full step overshoots, halved steps still end at the same optimum."""
    from infrarisk.plans.newton import Problem, newton, packed

    rng = np.random.default_rng(5)
    rows = [(0, int(rng.integers(0, 4)), int(rng.random() < 0.3), float(rng.normal())) for _ in range(400)]
    table = packed(spark.createDataFrame(rows, "block int, bucket int, y0 int, x0 double"), 1, 1)
    zero, one = np.zeros(1), np.ones(1)
    problem = lambda w, b: Problem(0, 0, 400, (1.0, 1.0), 0.01, (zero, zero, one), np.array([w, 0, 0, 0, 0.0]), b)
    (near, b, n, ok), (far, b2, n2, ok2) = newton(table, [problem(0.0, 0.0), problem(6.0, -9.0)], 4, 1e-6, 100)
    assert ok and ok2 and n < n2 < 60
    assert np.allclose(near, far, atol=1e-5) and abs(b - b2) < 1e-5
    assert newton(table, [problem(0.0, 0.0)], 4, 1e-6, 1)[0][2:] == (1, False)
    table.unpersist()


def test_prefix_medians_of_any_doubles(spark):
    """middle ranks found digit by digit: signs, sizes, ties, infinities, NaN and null, empty first ranges, several tasks."""
    from infrarisk.operators import stats as ST

    rng = np.random.default_rng(11)
    odd = [float("inf"), float("-inf"), 0.0, -0.0, 5e-324, -5e-324, 1.7e308, None, float("nan")]
    rows = [(int(b), float(rng.normal() * 10.0 ** rng.integers(-300, 300)), float(rng.integers(-2, 3)), odd[i % 9] if i % 2 else float(i), None) for i, b in enumerate(rng.integers(1, 6, 700))]
    df = spark.createDataFrame(rows, "block int, wide double, ties double, odd double, none double").repartition(5)
    got = {r.feature: r.medians for r in ST.prefix_medians(df, "block", 7, ["wide", "ties", "odd", "none"]).collect()}
    for c, name in enumerate(("wide", "ties", "odd", "none"), 1):
        for b in range(7):
            known = sorted(v for r in rows if r[0] <= b and (v := r[c]) is not None and v == v)
            want = (known[(len(known) - 1) // 2] + known[len(known) // 2]) / 2 if known else None
            assert got[name][b] == want


def counted(df):
    """``df``, and an accumulator of the rows that were read of it."""
    seen = df.sparkSession.sparkContext.accumulator(0)

    def passed(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return df.mapInArrow(passed, df.schema), seen


def test_training_reads_labels_once(spark):
    """the labelled rows are made once, however often the index, the folds and the holdout read them."""
    lab = Q.labeled(spark, SF).cache()
    n = lab.count()
    once, seen = counted(lab)
    TR.train_models(once, targets=["overall_failure_72h_label"])
    assert seen.value == n


def test_config_choice_reads_rows_once(spark):
    """the indexed rows are made once for all folds, configurations and curves, and choosing again gives the same."""
    from infrarisk.operators import splits as SP

    feats = FE.feature_frame(Q.labeled(spark, SF), include_targets=True, keep=["timestamp", "telemetry_id"])
    idx = SP.global_index(feats, Q.ORDER).cache()
    n = idx.count()
    once, seen = counted(idx)
    got = TR.choose_config(once, 300, ["overall_failure_72h_label"])
    assert seen.value == n
    rows = got.collect()
    assert seen.value == n and rows == got.collect() and rows[0].folds == 4 and 0 < rows[0].mean_pr_auc < 1
    idx.unpersist()


def test_comparison_scores_rows_once(spark):
    """F2: metrics, reliability, prevalence and means of the comparison come from one pass over the scored rows."""
    from infrarisk.plans import backtest as BT

    lab = Q.labeled(spark, SF).cache()
    full = Q.TARGET_COLUMNS
    feats = FE.feature_frame(lab, include_targets=True)
    bundle = TR.Bundle({t: TR.Fitted(TR.fit_logistic(feats, t, 0.003, max_iter=5), 0.5, 0.003, {}, {}) for t in full}, 0.3, 0.6, 0)
    some = lab.where("telemetry_id % 3 = 0").cache()
    once, seen = counted(some)
    met, rel, prevalence, macro = BT.compare(lab, bundle, rows=once)
    want = some.agg(*[F.avg(t).alias(t) for t in full]).first().asDict()
    assert {r.target: r.class_prevalence for r in prevalence.collect()} == pytest.approx(want)
    assert met.count() == 15 and rel.count() == 150 and macro.count() == 3
    assert {r.n for r in met.collect()} == {some.count()} and seen.value == some.count()


def test_forests_split_as_brute_force(spark):
    """root splits are the best of the tried features, leaves hold the weighted shares of their rows, and forests share their jobs."""
    from infrarisk.plans import forest as FO
    from infrarisk.plans.newton import packed

    rng = np.random.default_rng(2)
    n, f, width = 600, 5, 4
    x = rng.normal(size=(n, f)).round(1)
    x[::7, 1] = np.nan
    bucket, block = rng.integers(0, width, n), np.arange(n) // 300
    y = (x[:, 0] + (bucket == 2) * 2 + rng.normal(size=n) > 0.5).astype(int)
    rows = [(int(i), int(block[i]), int(bucket[i]), int(y[i]), *[None if v != v else float(v) for v in x[i]]) for i in range(n)]
    table = packed(spark.createDataFrame(rows, "row long, block int, bucket int, y0 int, " + ", ".join(f"x{k} double" for k in range(f))).repartition(3), 1, f)
    edges, medians = [np.linspace(-2, 2, 9 + k) for k in range(f)], np.zeros(f)
    made = [FO.Forest(last, 0, (2.0, 0.5), medians, edges, boot, 10, 4, 3, 7) for last in (0, 1) for boot in (False, True)]
    table.count()
    sc = spark.sparkContext
    sc.setJobGroup("forests", "")
    try:
        FO.grow(table, made, f, width)
        assert len(sc.statusTracker().getJobIdsForGroup("forests")) <= 2 * 3
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    v = FO.binned(x.T, bucket, medians, edges)
    for k, g in enumerate(made):
        own = block <= g.last
        tried = np.sort(np.argpartition(np.random.default_rng([7, k, 0]).random((4, 1, f + width)), 2, axis=2)[..., :3], axis=2)
        assert g.values.shape == (4, 8)
        for t in range(4):
            times = FO.drawn(np.arange(n), 7 * 1009 + t) if g.bootstrap else np.ones(n)

            def weighed(part):
                w = np.where(y == 1, 2.0, 0.5) * times * part
                return w @ y, w.sum(), (times * part).sum()

            def gain(right):
                return sum(p * p / w + (w - p) ** 2 / w for p, w, c in (weighed(own & right), weighed(own & ~right))) if min(weighed(own & right)[2], weighed(own & ~right)[2]) >= 10 else -1.0

            best = max([gain(v[c] > b) for c in tried[t, 0] if c < f for b in range(FO.BINS - 1)] + [gain(v[f] == c - f) for c in tried[t, 0] if c >= f])
            col, lo, hi = (a[t][0] for a in g.splits[0])
            p, w, _ = weighed(own)
            if lo == FO.NEVER:
                assert best <= (p * p + (w - p) ** 2) / w * (1 + 1e-9)
            else:
                assert gain((v[col] > lo) & (v[col] <= hi)) == pytest.approx(best)
            leaf = FO.nodes(g.splits, t, v.ravel(), np.arange(n))
            for a in np.unique(leaf[own]):
                p, w, c = weighed(own & (leaf == a))
                if w:
                    assert c >= 10 and g.values[t, a] == pytest.approx(p / w)
    got = FO.score(table, [(3, made[0], 300, 600)]).toPandas()
    want = np.mean([made[0].values[t][FO.nodes(made[0].splits, t, v.ravel(), np.arange(n))] for t in range(4)], axis=0)
    assert sorted(got.p) == pytest.approx(sorted(want[300:])) and got.y.sum() == y[300:].sum() and set(got.asked) == {3}
    counts = np.bincount(FO.drawn(np.arange(200_000), 12).astype(int), minlength=4)[:4] / 200_000
    assert np.allclose(counts, [0.3679, 0.3679, 0.1839, 0.0613], atol=5e-3)
    table.unpersist()
