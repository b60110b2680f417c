"""Small operators: projections, filters, template fallback, last-n per
stream, ordered split, dependence pairs, stream windows per split."""

import pytest
from pyspark.sql import functions as F

from cadence.operators import attribution as AT
from cadence.operators import models as M
from cadence.operators.projection import (align_features, drop_case_insensitive, feature_columns,
                                          rename_roles, split_filter, stream_filter)
from cadence.operators.sequences import last_n_per_stream, latest_rows, template_row
from cadence.operators.splits import ordered_fraction_split


def test_projections(spark):
    df = spark.createDataFrame([(1, 2.0, "x", True)], "user_id long, Value double, s string, flag boolean")
    assert drop_case_insensitive(df, ["VALUE"]).columns == ["user_id", "s", "flag"]
    assert rename_roles(df, {"user_id": "A"}).columns[0] == "A"
    assert feature_columns(df, exclude=("user_id",)) == ["Value", "flag"]     # booleans count
    assert feature_columns(df, pattern="^V") == ["Value"]
    al = align_features(df, ["user_id"], ["flag", "missing", "Value"])
    assert al.columns == ["user_id", "flag", "missing", "Value"] and al.first().missing == 0.0
    with pytest.raises(ValueError):
        align_features(df, [], ["missing"], strict=True)


def test_filters_and_template_fallback(spark):
    df = spark.createDataFrame([("a", 1, "train", 5.0), ("b", 2, "val", 6.0)],
                               "A string, C long, split string, CycleTime_sec double")
    assert split_filter(df, value="val").count() == 1 and stream_filter(df, "A", "a").count() == 1
    t = template_row(df, ["C"])                        # no test row: latest row overall
    assert t.first().A == "b" and "CycleTime_sec" not in t.columns and "split" not in t.columns
    assert [r.C for r in latest_rows(df.drop("split"), ["C"], 5).collect()] == [2, 1]


def test_last_n_per_stream_and_ordered_split(spark):
    rows = [("a", i) for i in range(7)] + [("b", i) for i in range(2)]
    df = spark.createDataFrame(rows, "A string, C long")
    got = sorted((r.A, r.C) for r in last_n_per_stream(df, "A", ["C"], 3).collect())
    assert got == [("a", 4), ("a", 5), ("a", 6), ("b", 0), ("b", 1)]
    s = {r.C: r.split for r in ordered_fraction_split(df.filter("A = 'a'"), ["C"], 0.8).collect()}
    assert [s[i] for i in range(7)] == ["train"] * 5 + ["test"] * 2      # int(0.8 * 7) = 5


def test_dependence_pairs(spark):
    df = spark.createDataFrame([(float(i), float(2 * i % 5), float(3 * i)) for i in range(20)],
                               "x1 double, x2 double, y double")
    model = M.ridge_fit(df, ["x1", "x2"], "y")
    rows = AT.linear_attribution_rows(df.withColumn("k", F.monotonically_increasing_id()), model, df, ["k"])
    pairs = AT.dependence_pairs(rows, AT.linear_attribution(df, model, df), top=1)
    assert {r.feature for r in pairs.collect()} == {"x1"} and pairs.count() == 20


def test_small_helpers(spark):
    from cadence.functions.arrays import ch_len
    assert M.class_weight_at(1) == pytest.approx(0.01) and M.class_weight_at(9) == pytest.approx(0.05)
    df = spark.createDataFrame([([1.0, 2.0],), (None,)], "x array<double>")
    assert [r.n for r in df.select(ch_len(F.col("x")).alias("n")).collect()] == [2, None]
