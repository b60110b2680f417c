"""The command-level entry points on a small cycle table."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from cadence.plans import entrypoints as E
from cadence.roles import ColumnRoles

R = ColumnRoles(stream="A", cycle="B", time="C", label="D", series=("E",))


def _features(spark, n=240):
    rng = np.random.default_rng(11)
    t, rows = dt.datetime(2024, 1, 1), []
    for i in range(n):
        gap = int(rng.integers(20, 150))
        rows.append(("m1", i, t.strftime("%Y-%m-%d %H:%M:%S"), int(gap > 90),
                     f"[[{gap % 7},{gap % 5},{gap % 3}]]"))
        t += dt.timedelta(seconds=gap)
    raw = spark.createDataFrame(rows, "A string, B long, C string, D int, E string")
    from cadence.plans.etl import build_feature_table
    return build_feature_table(raw, R, max_gap=300)


def test_baselines_and_sequence(spark):
    f = _features(spark)
    b = E.baselines(f, R, kinds=("Ridge", "RF"), rf_trees=10)
    assert b.best in ("Ridge", "RF") and b.metrics.count() == 4
    model, preds, metrics = E.sequence_model(f, R, length=5)
    assert preds.count() > 0 and {r.split for r in metrics.collect()} <= {"val", "test"}
    s = E.score_latest(f, R, model).first()
    assert s.pred_sec is not None and 0.0 <= s.pred_long_prob <= 1.0
    t = E.scoring_template(f, R)
    assert t.count() == 1 and "CycleTime_sec" not in t.columns


def test_selection_and_attribution(spark):
    f = _features(spark)
    top = E.select_features(f, R, topk=3).collect()
    assert len(top) == 3 and top[0].mean_abs_shap >= top[-1].mean_abs_shap
    att = E.attribute_sequence(f, R, length=4).collect()
    assert len(att) == 10 and all(r.mean_abs_shap >= 0 for r in att if r.mean_abs_shap is not None)


def test_sequence_options(spark):
    f = _features(spark)
    model, preds, _ = E.sequence_model(f, R, length=5, log_target=True, oversample_long=20.0)
    r = preds.agg(F.min("pred_sec").alias("lo")).first()
    assert r.lo is not None and r.lo > -1.0          # expm1 of a prediction is > -1
    assert E.score_latest(f, R, model).count() == 1


def test_previous_target_as_a_feature(spark):
    f = _features(spark)
    model, preds, _ = E.sequence_model(f, R, length=4, prev_target=True)
    plain, all_preds, _ = E.sequence_model(f, R, length=4)
    assert model.features == [*plain.features, "prev_ct"]
    assert preds.count() == all_preds.count() - 2    # one row less in val and in test
    assert E.score_latest(f, R, model).first().pred_sec is not None


def test_saved_pipeline_scores_alike(spark):
    from cadence.sources import io
    f = _features(spark)
    model = E.baselines(f, R, kinds=("Ridge",)).models["Ridge"]
    loaded = E.load_pipeline(E.save_pipeline(model, io.scratch_path(spark, "pipeline")))
    a, b = (E.score_batch(f, m, ["B"]).orderBy("B").collect() for m in (model, loaded))
    assert a == b and len(a) > 0


def test_etl_from_csv_with_raw_table(spark):
    from cadence.sources import io
    rows = [("m1", i, f"2024-01-01 00:{i:02d}:00", i % 2, f"[[{i},{i + 1}]]") for i in range(20)]
    df = spark.createDataFrame(rows, "A string, B long, C string, D int, E string")
    path = io.write_csv(df, io.scratch_path(spark, "cycles"))
    raw_out, feat_out = io.scratch_path(spark, "raw"), io.scratch_path(spark, "feat")
    f = E.etl(spark, path, R, schema="A string, B long, C string, D int, E string",
              raw_out=raw_out, features_out=feat_out)
    assert f.count() == 19 and spark.read.parquet(raw_out).count() == 20
    assert {r.CycleTime_sec for r in f.collect()} == {60.0}


def test_etl_fails_without_times(spark):
    import pytest
    from cadence.sources import io
    df = spark.createDataFrame([("m1", 1, "junk", 0, "[[1]]")], "A string, B long, C string, D int, E string")
    path = io.write_csv(df, io.scratch_path(spark, "bad"))
    with pytest.raises(ValueError):
        E.etl(spark, path, R, schema="A string, B long, C string, D int, E string")


def test_etl_from_config(spark):
    from cadence.sources import io
    rows = [("", i, f"1/1/2024 0:{i:02d}", 0, "[[1,2]]", "[3]") for i in range(30)]
    df = spark.createDataFrame(rows, "A string, B long, C string, D int, E string, F string")
    path = io.write_csv(df, io.scratch_path(spark, "cfg"))
    cfg = {"time_series_columns": ["E", "F", "G"], "id_column": "null", "cycle_number_column": "B",
           "timestamp_column": "C", "good_bad_label_column": "D", "csv_path": path,
           "raw_parquet_path": io.scratch_path(spark, "raw"), "features_parquet_path": io.scratch_path(spark, "f"),
           "split": {"train": 0.5, "val": 0.25, "test": 0.25}, "max_gap_sec": 300}
    roles = ColumnRoles.from_config(cfg)
    assert roles.stream is None and roles.series == ("E", "F", "G")
    f = E.etl_from_config(spark, cfg, schema="A string, B long, C string, D int, E string, F string")
    counts = {r.split: r["count"] for r in f.groupBy("split").count().collect()}
    assert sum(counts.values()) == 29 and counts["train"] == 15     # fraction 0.5 honoured
    assert "F_mean_mean" in f.columns and "G_mean_mean" not in f.columns   # missing column skipped
