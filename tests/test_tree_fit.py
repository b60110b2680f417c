"""Forests and boosting on sums of cells."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadence.operators import models as M
from cadence.operators import tree_fit as T


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.uniform(0, 10, (4000, 2)), 1)
    y = np.where(x[:, 0] > 5, 100.0, 0.0) + 3 * x[:, 1] + rng.normal(size=4000)
    return spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, y double")


def jobs(spark, group, work):
    """What ``work`` returns, and the number of Spark jobs that it ran."""
    sc = spark.sparkContext
    sc.setJobGroup(group, group)
    try:
        return work(), len(sc.statusTracker().getJobIdsForGroup(group))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def left(model, rows):
    """Share of the squares around the mean that a model leaves."""
    scored = model.transform(rows)
    return scored.select(F.avg((F.col("y") - F.col("pred")) ** 2) / F.var_pop("y")).first()[0]


def test_800_rounds_are_few_passes(spark, rows):
    model, n = jobs(spark, "rounds", lambda: M.fit_pipeline(rows, ["a", "b"], "y", "GBT"))
    assert model.stages[-1].getNumTrees == 800 and n < 100  # a job for each level of each round: thousands
    assert left(model, rows) < 0.002


def test_400_trees_are_one_pass(spark, rows):
    model, n = jobs(spark, "trees", lambda: M.fit_pipeline(rows, ["a", "b"], "y", "RF", rf_depth=5))
    assert model.stages[-1].getNumTrees == 400 and n < 60
    assert left(model, rows) < 0.02


@pytest.mark.parametrize("kind, kw", [("RF", {"rf_trees": 40, "rf_depth": 4}), ("GBT", {"gbt_rounds": 30})])
def test_as_good_as_mllib(spark, rows, kind, kw, monkeypatch):
    ours = M.fit_pipeline(rows, ["a", "b"], "y", kind, **kw)
    monkeypatch.setattr(T, "CELLS", 10)  # too many cells: MLlib's fit on rows
    theirs = M.fit_pipeline(rows, ["a", "b"], "y", kind, **kw)
    assert left(ours, rows) < 1.05 * left(theirs, rows) + 1e-4
    both = ours.transform(rows).withColumnRenamed("pred", "p").drop("_z0", "_z1", "features")
    both = theirs.transform(both).select(F.corr("p", "pred")).first()[0]
    assert both > 0.999
    assert ours.stages[-1].featureImportances.toArray() == pytest.approx(
        theirs.stages[-1].featureImportances.toArray(), abs=0.05)


def test_one_tree_is_the_best_tree(spark):
    """Every row, depth 1: the split that leaves the least squares, by brute force."""
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 6, (2, 300)), rng.normal(size=300)
    y += x[1] > 3
    cells, at = np.unique(x[0] * 6 + x[1], return_inverse=True)
    w, s = np.bincount(at).astype(float), np.bincount(at, y)
    cuts = [np.arange(5) + 0.5] * 2
    columns, value = T.grow(np.array(np.unravel_index(cells, (6, 6))), cuts, w, s, 1, 2, rng)
    best = min((sum(((y[m] - y[m].mean()) ** 2).sum() for m in (x[f] <= c, x[f] > c)), f, c) for f in (0, 1) for c in cuts[f])
    assert (columns[7][0], columns[8][0]) == best[1:]
    assert value[at] == pytest.approx(np.where(x[best[1]] <= best[2], *[y[m].mean() for m in (
        x[best[1]] <= best[2], x[best[1]] > best[2])]))


def test_null_labels_are_an_error(spark, rows):
    with pytest.raises(ValueError):
        M.fit_pipeline(rows.withColumn("y", F.when(F.col("a") > 1, F.col("y"))), ["a", "b"], "y", "RF", rf_trees=2)


def test_samples(spark, rows):
    """Poisson weights have mean and variance 1; a share keeps that share."""
    placed = spark.range(20000).select((F.col("id") % 10).cast("int").alias("cell"), F.lit(2.0).alias("y")).repartition(3)
    for rate, mean in ((None, 1.0), (0.8, 0.8)):
        out = T.sampled_sums(placed, np.arange(10), range(5, 9), rate, 1).collect()
        assert {r.t for r in out} == {5, 6, 7, 8}
        w, s = (sum(np.frombuffer(r[c]) for r in out) for c in ("w", "s"))
        assert w.sum() / 80000 == pytest.approx(mean, abs=0.02) and np.allclose(s, 2 * w)
    steps = T.poisson_cuts() / 2.0 ** 32
    p = np.diff(np.append(0, steps))
    assert (p * np.arange(len(p))).sum() == pytest.approx(1, abs=1e-7)


def test_the_contest_runs_all_rounds(spark, monkeypatch):
    """The boosting that the contest fits has the reference's 800 rounds."""
    from cadence.plans import entrypoints, q_models
    asked = {}

    def baselines(rows, roles, **settings):
        asked.update(settings)
        raise StopIteration
    monkeypatch.setattr(entrypoints, "baselines", baselines)
    with pytest.raises(StopIteration):
        q_models.r6_model_contest(spark, "/root/testdata/sf0.001")
    assert asked.get("gbt_rounds", M.GBT_ROUNDS) == 800


@pytest.mark.parametrize("kind, kw", [("RF", {"rf_trees": 9, "rf_depth": 5}), ("GBT", {"gbt_rounds": 40})])
def test_scores_walk_the_trees_once_a_cell(spark, rows, kind, kw):
    from cadence.operators import trees
    model = M.fit_pipeline(rows, ["a", "b"], "y", kind, **kw)
    got = {(r.a, r.b): r.pred for r in M.score(model, rows, ["a", "b"]).collect()}
    want = {(r.a, r.b): r.pred for r in model.transform(rows).collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)
    scorer = trees.Scorer(trees.read_trees(spark, model.stages[-1]))
    seen, work = [], scorer.work_out
    scorer.work_out = lambda x: seen.append(len(x)) or work(x)
    x = np.random.default_rng(1).normal(size=(200_000, 2))
    first = scorer.look_up(x)
    assert np.array_equal(first, scorer.look_up(x)) and sum(seen) <= 32 * 32
