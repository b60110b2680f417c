"""Permutation by a computed bijection, attribution of tree ensembles."""

import math
import time
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadence.operators import attribution as AT
from cadence.operators import models as M
from cadence.operators import trees as T


def places(n, seed):
    """The bijection in plain Python."""
    sums, keys = AT.shuffle_keys(n, seed)
    out = []
    for x in range(n):
        for s, k in zip(sums, keys):
            partner = (s + n - x) % n
            if AT._hash(max(x, partner), k) // 4096 % 2 == 1:
                x = partner
        out.append(x)
    return out


def test_the_shuffle_is_a_bijection_without_an_exchange(spark):
    for n in (1, 2, 3, 17, 1000):
        sums, keys = AT.shuffle_keys(n, 5)
        df = spark.range(n).withColumn("s", F.lit(sums).cast("array<long>")).withColumn("k", F.lit(keys).cast("array<long>"))
        df = AT.shuffled_place(df, "id", "s", "k", n, "to")
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
        got = [r.to for r in df.orderBy("id").collect()]
        assert got == places(n, 5) and sorted(got) == list(range(n))
    moved = [x for x in range(1000) if places(1000, 5)[x] != x]
    assert len(moved) > 950
    assert abs(np.corrcoef(np.arange(1000), places(1000, 5))[0, 1]) < 0.1


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 3))
    y = 3 * x[:, 0] + np.where(x[:, 1] > 0, 2.0, -2.0) + 0.1 * rng.normal(size=500)
    return spark.createDataFrame([(f"k{i:04d}", *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))],
                                 "key string, a double, b double, c double, y double")


@pytest.mark.parametrize("kind", ["Ridge", "RF"])
def test_importance_of_any_model(spark, rows, kind):
    feats = ["a", "b", "c"]
    model = M.fit_pipeline(rows, feats, "y", kind, **({"rf_trees": 5, "rf_depth": 4} if kind == "RF" else {}))
    data = rows.orderBy("key").toPandas()
    n, base = len(data), model.transform(rows).select(F.avg(F.abs(F.col("y") - F.col("pred")))).first()[0]
    got = {r.feature: r for r in AT.permutation_importance(rows, model, "key", "y", repeats=3, features=feats).collect()}
    for j, f in enumerate(feats):
        rises = []
        for r in range(3):
            moved = data.copy()
            moved[f] = data[f].to_numpy()[places(n, AT._hash(42, j * 1009 + r))]
            p = model.transform(spark.createDataFrame(moved)).select(F.avg(F.abs(F.col("y") - F.col("pred")))).first()[0]
            rises.append(p - base)
        assert got[f].importance == pytest.approx(np.mean(rises), rel=1e-9, abs=1e-12)
        assert got[f].spread == pytest.approx(np.std(rises), rel=1e-6, abs=1e-12)
    assert got["a"].importance > got["b"].importance > got["c"].importance
    assert AT.permutation_importance(rows.limit(0), model, "key", "y", features=feats).count() == 0


def expected(leaves, x, known):
    """The value of a set of known features: every leaf as likely as its conditions allow."""
    total = 0.0
    for leaf in leaves:
        p = leaf.value
        for f, lo, hi, z in zip(leaf.feature, leaf.low, leaf.high, leaf.share):
            p *= float(lo < x[f] <= hi) if f in known else z
        total += p
    return total


def brute(leaves, x):
    n = len(x)
    out = []
    for j in range(n):
        rest = [i for i in range(n) if i != j]
        out.append(sum(math.factorial(k) * math.factorial(n - 1 - k) / math.factorial(n)
                       * (expected(leaves, x, {*s, j}) - expected(leaves, x, set(s)))
                       for k in range(n) for s in combinations(rest, k)))
    return out


@pytest.mark.parametrize("kind, settings", [("RF", {"rf_trees": 7, "rf_depth": 5}), ("GBT", {"gbt_rounds": 6})])
def test_tree_attribution_is_shapley(spark, rows, kind, settings):
    feats = ["a", "b", "c"]
    model = M.fit_pipeline(rows, feats, "y", kind, **settings)
    ensemble = T.read_ensemble(spark, model.stages[-1])
    got = T.tree_attribution_rows(rows, model, feats, ["key"]).collect()
    assert len(got) == 1500
    by = {}
    for r in got:
        by.setdefault(r.key, {})[r.feature] = r
    for k in list(by)[:40]:
        x = [by[k][f].value for f in feats]
        assert [by[k][f].phi for f in feats] == pytest.approx(brute(ensemble.leaves, x), rel=1e-9, abs=1e-10)
    for parts in by.values():
        any_ = next(iter(parts.values()))
        assert any_.base + sum(r.phi for r in parts.values()) == pytest.approx(any_.pred, rel=1e-9, abs=1e-9)
    score = {r.feature: r.mean_abs_shap for r in T.tree_attribution(rows, model, feats).collect()}
    assert score["a"] > score["b"] > score["c"]


def test_attribution_works_once_for_rows_between_the_same_ends():
    """A batch of repeated rows is worked out once for each place between ends of conditions."""
    rng = np.random.default_rng(2)
    leaves = [T.Leaf(v, np.array([0, 1]), np.array([-np.inf, 0.1 * i]), np.array([0.2 * i, np.inf]), np.array([0.5, 0.4]))
              for i, v in enumerate(rng.normal(size=12))]
    e = T.Ensemble(leaves)
    seen = []
    work, e.work_out = e.work_out, lambda x: seen.append(len(x)) or work(x)
    x = np.round(rng.uniform(-1, 3, (5000, 2)), 2)
    got = e.attribute(x)
    assert np.array_equal(got, work(x)) and sum(seen) <= 13 * 13
    e.attribute(x[:100])
    assert sum(seen) <= 13 * 13
    x[0, 0] = np.nan
    assert np.array_equal(e.attribute(x[:3]), work(x[:3]))


def test_the_shuffle_is_arithmetic_on_batches(spark):
    """Many copies of many places in little time: no expression is evaluated round by round for a row."""
    n = 300_000
    plans = [AT.shuffle_keys(n, i) for i in range(20)]
    df = AT.shuffled_places(spark.range(n), "id", plans, n, "to")
    start = time.time()
    sums = df.select(*[F.sum(F.get("to", F.lit(i))).alias(f"s{i}") for i in range(20)]).first()
    assert set(sums) == {n * (n - 1) // 2} and time.time() - start < 60
    got = AT.shuffled_places(spark.range(100), "id", [AT.shuffle_keys(100, 5)], 100, "to").orderBy("id").collect()
    assert [r.to[0] for r in got] == places(100, 5)


def test_long_paths_are_integrated(monkeypatch):
    """Leaves with more features than the tables take give the same."""
    rng = np.random.default_rng(1)
    leaf = T.Leaf(2.5, np.arange(6), np.full(6, -0.5), np.full(6, 0.5), rng.uniform(0.2, 0.9, 6))
    x = rng.normal(size=(50, 6))
    tabled = T.Ensemble([leaf]).attribute(x)
    monkeypatch.setattr(T, "TABLED", 3)
    assert np.allclose(T.Ensemble([leaf]).attribute(x), tabled)
    assert np.allclose(tabled[0], brute([leaf], x[0]))
