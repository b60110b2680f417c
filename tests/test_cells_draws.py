"""Window statistics without windows, exact draws, window models, two-pass ranks, JSON arrays."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadence.operators import models as M
from cadence.operators import rowindex as RI
from cadence.operators import stats as S
from cadence.operators.sequences import last_step, window_index, windows
from cadence.plans import entrypoints as E
from cadence.sources import io


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    out = []
    for split, n in (("train", 60), ("val", 3), ("test", 25), ("short", 5)):
        for i in range(n):
            a = None if rng.random() < .15 else float("nan") if rng.random() < .1 else float(rng.normal())
            out.append((split, i, a, float(rng.normal() + 7), None, float(rng.uniform(10, 200))))
    rng.shuffle(out)
    return spark.createDataFrame([(s, int(i), a, float(b), None, float(y)) for s, i, a, b, _, y in out],
                                 "split string, at long, a double, b double, none double, CycleTime_sec double")


@pytest.mark.parametrize("inside", [True, False])
@pytest.mark.parametrize("length", [1, 5])
def test_cell_statistics_from_rows(spark, rows, inside, length):
    feats = ["a", "b", "none"]
    ix = window_index(rows, feats, ["at"], ["split", "at"], ["split"])
    win = RI.sliding_windows(ix, feats, length, target_inside=inside, meta=["split", "at"], same=["split"])
    placed = RI.with_place(ix, ["split"])
    near = lambda x, y: (x is None and y is None) or x == pytest.approx(y, rel=1e-10)
    want, got = S.window_cell_stats(win, 3).first(), S.row_cell_stats(placed, feats, length, inside).first()
    assert all(near(a, b) for k in ("_mu", "_sd") for a, b in zip(got[k], want[k]))
    (_, want), (_, got) = S.fit_window_scaler(win, 3), S.fit_row_scaler(placed, feats, length, inside)
    assert all(near(a, b) for k in ("_mu", "_sd") for a, b in zip(got.first()[k], want.first()[k]))
    want = S.timestep_means(win, 3).first()["_tm"]
    got = S.row_timestep_means(placed, feats, length, inside).first()["_tm"]
    assert all(g.t == w.t and all(near(a, b) for a, b in zip(g.m, w.m)) for g, w in zip(got, want))


@pytest.mark.parametrize("inside", [True, False])
@pytest.mark.parametrize("part", [[], ["split"]])
def test_last_step_without_windows(spark, rows, monkeypatch, inside, part):
    monkeypatch.setattr(RI, "BLOCK", 16)  # several blocks
    args = (["a", "b"], 4, ["at", "split"])
    kw = {"target_inside": inside, "meta": ["split", "at"], "partition": part}
    win = windows(rows, *args, **kw)
    got = last_step(rows, *args, **kw)
    assert "collect_list" not in got._jdf.queryExecution().executedPlan().toString()
    key = lambda r: (r.split, r.at)
    want = {key(r): (r.X[-1], r.y) for r in win.collect()}
    assert {key(r): ([r.a, r.b], r.y) for r in got.collect()}.keys() == want.keys()
    for r in got.collect():
        assert str(([r.a, r.b], r.y)) == str(want[key(r)])


def test_exact_draws(spark, monkeypatch):
    monkeypatch.setattr(RI, "BLOCK", 4)  # prefix sums over several levels
    df = spark.createDataFrame([(f"k{i}", 20.0 if i % 9 == 0 else 1.0) for i in range(500)], "key string, w double")
    for n in (None, 1, 77, 5000):
        out = S.oversample(df, "key", F.col("w"), draws=n)
        copies = {r.key: r["count"] for r in out.groupBy("key").count().collect()}
        n = n or 500
        assert sum(copies.values()) == n
        total = sum(r.w for r in df.collect())
        for r in df.collect():
            assert abs(copies.get(r.key, 0) - n * r.w / total) < 1
    assert S.oversample(df, "key", F.lit(0.0)).count() == 0 and S.oversample(df.limit(0), "key", F.col("w")).count() == 0


def test_window_classifier_is_the_weighted_optimum(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 3))
    y = np.where(rng.random(600) < 1 / (1 + np.exp(-(x @ [1.0, -2.0, 0.5] - 1))), 120.0, 30.0)
    win = spark.createDataFrame([([[float(v)] for v in r], float(t)) for r, t in zip(x, y)],
                                "X array<array<double>>, y double")
    model = M.fit_window_classifier(win)
    long = y >= 90
    w, z = np.where(long, (1 - long.mean()) / long.mean(), 1.0), np.c_[np.ones(600), x]
    beta = np.zeros(4)
    for _ in range(15):
        p = 1 / (1 + np.exp(-z @ beta))
        beta += np.linalg.solve(z.T @ (z * (w * p * (1 - p))[:, None]), z.T @ (w * (long - p)))
    assert np.allclose([model.intercept, *model.coef], beta, rtol=1e-8)
    got = [r.p for r in win.select(model.predict(F.col("X")).alias("p")).collect()]
    assert np.allclose(got, 1 / (1 + np.exp(-z @ beta)), rtol=1e-8)
    one = M.fit_window_classifier(win.filter("y < 90"))
    assert one.coef == [0.0] * 3 and 0 < win.select(one.predict(F.col("X"))).first()[0] < 1e-5
    flat = M.fit_window_regressor(win.withColumn("y", F.lit(5.0)))
    assert (flat.coef, flat.intercept) == ([0.0] * 3, 5.0)


def test_sequence_model_is_saved(spark):
    from test_entrypoints import R, _features
    f = _features(spark)
    model, _, _ = E.sequence_model(f, R, length=3, log_target=True)
    loaded = E.SequenceModel.load(spark, model.save(spark, io.scratch_path(spark, "model")))
    assert loaded == model
    assert E.score_latest(f, R, loaded).collect() == E.score_latest(f, R, model).collect()


def test_ranks_in_two_evaluations(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=30_000), np.full(20_000, 0.25)])
    rng.shuffle(x)
    df = spark.createDataFrame([(float(v), float(-v)) for v in x], "x double, y double").repartition(5)
    src = df.mapInArrow(counted, df.schema)
    got = {(r.feature, r.p): r.value for r in S.exact_quantiles(src, ["x", "y"], [0.0, 0.1, 0.5, 0.999, 1.0]).collect()}
    assert got == {(f, p): pytest.approx(np.quantile(s * x, p), rel=1e-15) for f, s in (("x", 1), ("y", -1))
                   for p in (0.0, 0.1, 0.5, 0.999, 1.0)}
    assert seen.value == 2 * len(x)


def test_a_bracket_that_misses(spark, monkeypatch):
    """A sketch of no accuracy: the rank is found in the table itself."""
    monkeypatch.setattr(RI, "SKETCH", 10 ** 9)  # brackets of no width
    real = F.percentile_approx
    monkeypatch.setattr(RI.F, "percentile_approx", lambda c, p, a: real(c, [0.9] * len(p), 100))
    df = spark.createDataFrame([(float(i * i),) for i in range(2000)], "x double")
    counts, got = RI.values_at_fractions(df, {"x": F.col("x")}, [0.5], lambda n, f: [int(n * f)])
    assert counts == {"x": 2000} and got == {("x", 1000): 1e6}


def test_json_arrays_are_split(spark, tmp_path):
    odd = ['plain', 'a "quoted" }{][ text', 'back\\slash \\" } end', '}', '{"not": "an object"}', '', '\\', '日本 }']
    data = [{"i": i, "s": odd[i % 8], "deep": {"x": [i, [1, {"k": "}"}]], "t": odd[(i + 3) % 8]}, "f": i / 7}
            for i in range(400)]
    data[7]["s"], data[9] = None, {"i": 9}
    (tmp_path / "one.json").write_text(json.dumps(data))
    (tmp_path / "two.json").write_text(json.dumps(data[:150], indent=2, ensure_ascii=False) + "\n")
    (tmp_path / "void.json").write_text(" [ ]\n")
    schema = "i long, s string, deep struct<x: string, t: string>, f double"
    name = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(name)
    try:
        spark.conf.set(name, "4KB")
        got = io.read_scoring_input(spark, str(tmp_path), schema, fmt="json", multiline=True).collect()
        split = spark.read.option("lineSep", "}").text(str(tmp_path / "one.json")).rdd.getNumPartitions()
    finally:
        spark.conf.set(name, old)
    assert split > 5
    plain = lambda d: (d["i"], d.get("s"), d.get("f"), d.get("deep", {}).get("t"))
    want = sorted(map(str, map(plain, data + data[:150])))
    assert sorted(str((r.i, r.s, r.f, r.deep.t if r.deep else None)) for r in got) == want
