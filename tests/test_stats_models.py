"""Scaler, imputation, class rate, metrics, ridge, attribution, losses."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadence.operators import attribution as AT
from cadence.operators import models as M
from cadence.operators import stats as S


@pytest.fixture()
def small(spark):
    rng = np.random.default_rng(3)
    n = 400
    x1, x2 = rng.normal(size=n), rng.normal(size=n)
    y = 3 * x1 - 2 * x2 + 1 + rng.normal(scale=0.1, size=n)
    split = np.where(np.arange(n) < 300, "train", "test")
    rows = [(f"k{i}", float(a), float(b), 7.0, None, float(c), s)
            for i, (a, b, c, s) in enumerate(zip(x1, x2, y, split))]
    return spark.createDataFrame(rows, "key string, x1 double, x2 double, const double, "
                                       "empty double, y double, split string")


def test_scaler_constant_and_empty(small):
    st = S.train_stats(small, ["x1", "const", "empty"])
    d = {r.feature: r for r in st.collect()}
    assert d["const"]["std"] == pytest.approx(0.0, abs=1e-12) and d["empty"]["mean"] is None
    z = S.standardize(S.impute(small, ["empty"], st, how="mean"), ["const"], st).collect()
    assert all(r.const == 0.0 and r.empty == 0.0 for r in z)


def test_non_finite_to_null(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (-float("inf"),), (1.0,)], "x double")
    assert [r.c for r in df.select(S.finite_or_null(F.col("x")).alias("c")).collect()] == [None, None, None, 1.0]


def test_class_rate_no_long_rows(spark):
    df = spark.createDataFrame([(10.0, "train"), (20.0, "train")], "CycleTime_sec double, split string")
    r = S.class_rate(df).first()
    assert r.long_rate == 0.0 and r.pos_weight == pytest.approx(1e6)


def test_metrics_constant_target(spark):
    df = spark.createDataFrame([(1.0, 1.0, "a"), (1.0, 1.0, "a"), (1.0, 2.0, "b"), (1.0, 0.0, "b")],
                               "y double, p double, g string")
    r = {x.g: x for x in M.regression_metrics(df, "y", "p", ["g"]).collect()}
    assert r["a"].r2 == 1.0 and r["b"].r2 == 0.0 and r["b"].mae == 1.0


def test_describe_matches_pandas(small):
    d = {r.column: r for r in S.describe(small, ["x1", "y"]).collect()}
    pdf = small.select("x1", "y").toPandas().describe()
    for c in ("x1", "y"):
        for ours, theirs in [("mean", "mean"), ("std", "std"), ("p25", "25%"), ("p50", "50%"), ("p75", "75%")]:
            assert d[c][ours] == pytest.approx(pdf.loc[theirs, c])


def test_ridge_closed_form_and_mllib(small):
    tr = small.filter("split = 'train'")
    model = M.ridge_fit(tr, ["x1", "x2"], "y", alpha=1.0)
    pdf = tr.toPandas()
    X = pdf[["x1", "x2"]].to_numpy()
    Xc, yc = X - X.mean(0), pdf.y - pdf.y.mean()
    w = np.linalg.solve(Xc.T @ Xc + np.eye(2), Xc.T @ yc)
    assert model.coef == pytest.approx(w, rel=1e-9)
    # the MLlib form inside the R4 pipeline gives the same fit on standardised features
    pipe = M.fit_pipeline(tr, ["x1", "x2"], "y", "Ridge")
    st = S.train_stats(tr, ["x1", "x2"], split=None, median=False)
    z = S.standardize(small, ["x1", "x2"], st)
    zm = M.ridge_fit(z.filter("split = 'train'"), ["x1", "x2"], "y")
    a = {r.key: r.pred for r in M.score(pipe, small, ["key"]).collect()}
    b = {r.key: r.pred for r in z.select("key", zm.predict(name="pred")).collect()}
    assert all(a[k] == pytest.approx(b[k], rel=1e-6, abs=1e-6) for k in a)


def test_attribution_and_permutation(small):
    tr, te = small.filter("split = 'train'"), small.filter("split = 'test'")
    model = M.ridge_fit(tr, ["x1", "x2"], "y")
    att = {r.feature: r.mean_abs_shap for r in AT.linear_attribution(te, model, tr).collect()}
    pdf, bg = te.toPandas(), tr.toPandas()
    for f, w in zip(model.features, model.coef):
        assert att[f] == pytest.approx(np.mean(np.abs(w * (pdf[f] - bg[f].mean()))))
    imp = {r.feature: r.importance for r in AT.permutation_importance(te, model, "key", "y").collect()}
    assert imp["x1"] > imp["x2"] > 0


def test_forest_beats_mean(small):
    tr = small.filter("split = 'train'")
    rf = M.fit_pipeline(tr, ["x1", "x2"], "y", "RF", rf_trees=20)
    m = M.regression_metrics(M.score(rf, small.filter("split = 'test'"), ["y"]), "y", "pred", []).first()
    sd = small.filter("split = 'test'").agg(F.stddev_pop("y")).first()[0]
    assert m.rmse < sd


def test_losses(spark):
    df = spark.createDataFrame([(0.0, 0.5, 0.9, 1), (0.0, 3.0, 0.1, 0)], "y double, p double, q double, l int")
    r = df.select(*M.loss_columns(F.col("y"), F.col("p"), F.col("q"), F.col("l"))).collect()
    assert r[0].huber == pytest.approx(0.125) and r[1].huber == pytest.approx(2.5)
    assert r[0].bce == pytest.approx(-np.log(0.9)) and r[1].bce == pytest.approx(-np.log(0.9))
    assert r[0].weighted_reg == pytest.approx(3.0 * 0.125)
    assert r[0].total == pytest.approx(0.05 * r[0].focal + 3.0 * 0.125)


def test_oversample_expected_draws(spark):
    df = spark.createDataFrame([(f"k{i}", 1 if i < 50 else 0) for i in range(1000)], "key string, long int")
    w = F.when(F.col("long") == 1, F.lit(20.0)).otherwise(F.lit(1.0))
    out = S.oversample(df, "key", w)
    n_long = out.filter("long = 1").count()
    # expected long draws: 1000 * 50*20 / (50*20 + 950) ~ 512.8
    assert abs(n_long - 512.8) < 60 and abs(out.count() - 1000) < 60
