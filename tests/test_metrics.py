"""Distributed metrics against plain NumPy loops (ties included), index and splits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from infrarisk.operators import metrics as M
from infrarisk.operators import splits as SP


def np_curve(y, p):
    ps = np.unique(p)[::-1]
    pos, tot = y.sum(), len(y)
    ap, rank_sum, best = 0.0, 0.0, (-1.0, None)
    ctp = ccnt = 0
    for v in ps:
        m = p == v
        tp, cnt = y[m].sum(), m.sum()
        ctp += tp
        ccnt += cnt
        ap += (ctp / ccnt) * (tp / pos) if pos else 0.0
        rank_sum += tp * ((tot - ccnt) + (cnt + 1) / 2)
    # F1 threshold: ascending, strict >
    for v in np.unique(p):
        pred = p >= v
        tp = (pred & (y == 1)).sum()
        prec = tp / pred.sum() if pred.sum() else 0.0
        rec = tp / pos if pos else 0.0
        f1 = 2 * prec * rec / (prec + rec) if prec + rec else 0.0
        if f1 > best[0]:
            best = (f1, v)
    auc = (rank_sum - pos * (pos + 1) / 2) / (pos * (tot - pos))
    return ap, auc, min(0.95, max(0.05, best[1]))


@pytest.mark.parametrize("seed,levels", [(0, 7), (1, 1000), (2, 3)])
def test_curve_metrics_match_numpy(spark, seed, levels):
    rng = np.random.default_rng(seed)
    n = 2000
    p = rng.integers(0, levels, n) / levels
    y = (rng.random(n) < 0.2 + 0.6 * p).astype(int)
    df = spark.createDataFrame([(int(a), float(b), "g") for a, b in zip(y, p)], "y int, p double, g string")
    r = M.curve_metrics(df, ["g"]).first()
    ap, auc, thr = np_curve(y, p)
    assert r["pr_auc"] == pytest.approx(ap, abs=1e-12)
    assert r["roc_auc"] == pytest.approx(auc, abs=1e-12)
    assert r["threshold"] == pytest.approx(thr, abs=1e-12)


def test_running_sums_many_slices(spark):
    rng = np.random.default_rng(3)
    vals = rng.integers(0, 5, 5000)
    df = spark.createDataFrame([(i % 3, float(i), int(v)) for i, v in enumerate(vals)], "g int, o double, v long")
    out = M.running_sums(df, ["g"], "o", ["v"], descending=False, num_partitions=13).toPandas()
    for g, part in out.groupby("g"):
        part = part.sort_values("o")
        assert (part["cv"].to_numpy() == part["v"].cumsum().to_numpy()).all()


def test_confusion_and_ece(spark):
    y = np.array([1, 0, 1, 1, 0, 0, 1, 0])
    p = np.array([0.9, 0.8, 0.55, 0.3, 0.3, 0.1, 1.0, 0.30000000000000004])
    df = spark.createDataFrame([(int(a), float(b), "g") for a, b in zip(y, p)], "y int, p double, g string")
    r = M.classification_metrics(df, ["g"], 0.5).first()
    pred = p >= 0.5
    assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (3, 1, 1, 3)
    assert r["brier"] == pytest.approx(np.mean((p - y) ** 2))
    ece = 0.0
    edges = np.linspace(0, 1, 11)
    for i in range(10):
        m = (p >= edges[i]) & ((p < edges[i + 1]) if i < 9 else (p <= edges[i + 1]))
        if m.any():
            ece += abs(p[m].mean() - y[m].mean()) * m.mean()
    assert r["ece_10_bins"] == pytest.approx(ece)
    assert r["f1"] == pytest.approx(2 * 0.75 * 0.75 / 1.5)
    rel = M.reliability(df, ["g"]).orderBy("bin").collect()
    # 0.3 < 0.30000000000000004: the two 0.3s fall in bin 2, the edge value itself in bin 3
    assert len(rel) == 10 and rel[2]["count"] == 2 and rel[3]["count"] == 1 and rel[0]["count"] == 0


def test_global_index_matches_sort(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), int(t), f"c{int(c)}") for i, (t, c) in enumerate(zip(rng.integers(0, 50, 3000), rng.integers(0, 4, 3000)))]
    df = spark.createDataFrame(rows, "id long, t long, city string")
    got = SP.global_index(df, ["t", "city", "id"], num_partitions=7).select("id", "row_idx").toPandas()
    want = sorted(rows, key=lambda r: (r[1], r[2], r[0]))
    pos = {r[0]: k for k, r in enumerate(want)}
    assert all(pos[i] == k for i, k in zip(got["id"], got["row_idx"]))


def test_windows_and_folds():
    w = SP.expanding_windows(52560)
    assert len(w) == 5 and w[0][1] == 26280 and all(b[3] - b[2] == 5256 for b in w)
    assert SP.cv_folds(100, valid_size=40) == []
    folds = SP.cv_folds(1000, valid_size=40)
    assert [f[0] for f in folds] == [int(x) for x in np.linspace(500, 960, 4, dtype=int)]
    assert SP.calibration_split_point(90) == 80 and SP.calibration_split_point(80) == 79
    assert SP.calibration_split_point(1000) == 850
    assert SP.holdout_split_point(52560) == 42048


def test_window_membership_arithmetic(spark):
    n = 400
    df = spark.range(n).withColumnRenamed("id", "row_idx")
    got = SP.window_test_membership(df, n).select("row_idx", "window_id").collect()
    want = [(i, k) for k, (_, e, s, t) in enumerate(SP.expanding_windows(n)) for i in range(s, t)]
    assert sorted((r[0], r[1]) for r in got) == sorted(want)


def test_even_downsample_matches_linspace(spark):
    length, m = 1000, 37
    df = spark.range(length).withColumnRenamed("id", "i")
    got = sorted(r[0] for r in SP.even_downsample(df, length, m, "i").collect())
    assert got == sorted(set(np.linspace(0, length - 1, num=m, dtype=int).tolist()))


def test_running_sums_without_exchange_reuse(spark):
    """Wide rows, and no shared exchange: equal to a plain cumulative sum."""
    import numpy as np

    n = 200_000
    df = (spark.range(n).select((F.col("id") % 2).alias("g"), (F.xxhash64("id") % 1_000_003 / 2_000_006 + 0.5).alias("p0"), F.lit(1).alias("cnt"), (F.col("id") % 3 == 0).cast("int").alias("tp"),
                                *[F.xxhash64("id", F.lit(k)).alias(f"x{k}") for k in range(6)])
          .groupBy("g", F.col("p0").alias("p")).agg(F.sum("tp").alias("tp"), F.sum("cnt").alias("cnt"), F.max("x0").alias("x0"), F.max("x1").alias("x1")))
    before = spark.conf.get("spark.sql.exchange.reuse", "true")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        got = M.running_sums(df, ["g"], "p", ["tp", "cnt"]).select("g", "p", "tp", "cnt", "ctp", "ccnt").toPandas()
    finally:
        spark.conf.set("spark.sql.exchange.reuse", before)
    got = got.sort_values(["g", "p"], ascending=[True, False])
    for _, part in got.groupby("g"):
        assert np.array_equal(part.ctp, part.tp.cumsum()) and np.array_equal(part.ccnt, part.cnt.cumsum())
    assert got.cnt.sum() == n


def test_even_downsample_of_one(spark):
    df = spark.range(50)
    assert SP.even_downsample(df, 50, 1, "id").count() == 1
    assert SP.even_downsample(df, 50, 7, "id").count() == 7


def test_folds():
    for n in (160, 399, 400, 1000, 54321):
        folds = SP.cv_folds(n)
        assert len(folds) == 4 and folds[0][0] == n // 2 and folds[-1][1] == n and all(v - e == max(40, int(n * 0.1)) for e, v in folds)
    assert SP.cv_folds(159) == [] and SP.cv_folds(400, valid_size=40)[0] == (200, 240)


@pytest.mark.parametrize("ratios", [{}, {"test_ratio": 0.25, "step_ratio": 0.05}, {"min_train_ratio": 0.3, "test_ratio": 0.07, "step_ratio": 0.02}])
def test_blocks_add_up_to_windows(spark, ratios):
    """Metrics of overlapping windows from blocks equal those from the rows of every window."""
    n = 1500
    idx = spark.range(n).select(F.col("id").alias("row_idx"), (F.xxhash64("id") % 40 / 80 + 0.5).alias("p"), (F.xxhash64("id", F.lit(1)) % 3 == 0).cast("int").alias("y"))
    rows = M.points(SP.window_test_membership(idx, n, **ratios), ["window_id"]).collect()
    cut, spans = SP.window_blocks(idx, n, **ratios)
    pts = M.points(cut, ["block_id"])
    got = M.merged_points(pts, [], "block_id", spans).collect()
    key = lambda r: (r["window_id"], r["p"], r["tp"], r["cnt"])
    assert sorted(map(key, rows)) == sorted(map(key, got)) and rows
    assert sum(r["cnt"] for r in M.merged_points(pts, []).collect()) == cut.count()


def test_place_in_group(spark):
    """A group of two thirds of the rows, groups without a name, gaps in the numbers."""
    df = spark.range(900).select((F.col("id") * 7).alias("at"), F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 2 == 0, F.concat(F.lit("c"), (F.col("id") % 5).cast("string"))).alias("g"))
    got = SP.place_in_group(df, "g", "at").collect()
    assert len(got) == 900
    seen = {}
    for r in sorted(got, key=lambda r: r["at"]):
        seen[r["g"]] = seen.get(r["g"], 0) + 1
        assert r["place"] == seen[r["g"]]
    assert SP.place_in_group(df.where("false"), "g", "at").count() == 0
