"""Checks that stand in for the reference's own: feature-list order, cap,
empty splits, no split leak, finite scaled windows."""

import datetime as dt

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cadence.functions.arrays import SUMMARY_SUFFIXES
from cadence.operators import stats as S
from cadence.operators.cycles import next_row
from cadence.operators.projection import feature_columns
from cadence.operators.sequences import windows
from cadence.operators.splits import require_splits
from cadence.plans.etl import build_feature_table
from cadence.roles import ColumnRoles

SERIES = tuple("EFGHIJKLMNOP")
ROLES = ColumnRoles(stream="A", cycle="B", time="C", label="D", series=SERIES)


def _raw(spark, n=12):
    t0 = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        cells = [f"[[{i},{i + 1}],[{2 * i}]]" for _ in SERIES]
        rows.append(("m1", i, (t0 + dt.timedelta(seconds=30 * i)).strftime("%Y-%m-%d %H:%M:%S"), i % 2, *cells))
    schema = "A string, B long, C string, D int, " + ", ".join(f"{s} string" for s in SERIES)
    return spark.createDataFrame(rows, schema)


def test_feature_list_order(spark):
    feats = build_feature_table(_raw(spark), ROLES)
    golden = [f"{s}_{x}" for s in SERIES for x in SUMMARY_SUFFIXES]
    assert feature_columns(feats, ROLES) == golden                      # label excluded (default)
    assert feature_columns(feats, ROLES, include_label=True) == ["D"] + golden   # the shipped list: 121
    assert "split" not in feature_columns(feats, ROLES) and "CycleTime_sec" not in feature_columns(feats, ROLES)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(min_value=0, max_value=900), min_size=2, max_size=30), st.integers(1, 600))
def test_cap_property(spark, steps, cap):
    t0 = dt.datetime(2024, 1, 1)
    secs = np.cumsum(steps)
    rows = [("s", i, t0 + dt.timedelta(seconds=int(s))) for i, s in enumerate(secs)]
    df = spark.createDataFrame(rows, "A string, B long, C timestamp_ntz")
    got = next_row(df, ColumnRoles(stream="A", cycle="B", time="C", label=None), per_stream=False,
                   strict=True, max_gap=cap).select("B", "CycleTime_sec").collect()
    expect = {i: (float(steps[i + 1]) if 0 < steps[i + 1] <= cap else None) for i in range(len(steps) - 1)}
    expect[len(steps) - 1] = None
    assert {r.B: r.CycleTime_sec for r in got} == expect


def test_empty_split_raises(spark):
    df = spark.createDataFrame([(1.0, "train"), (2.0, "val")], "CycleTime_sec double, split string")
    with pytest.raises(RuntimeError):
        require_splits(df)


def test_scaled_windows_are_finite(spark):
    rows = [(i, "train" if i < 30 else "test", None if i % 7 == 0 else float(i % 5), 5.0,
             float("inf") if i == 3 else 1.0) for i in range(40)]
    df = spark.createDataFrame(rows, "B long, split string, a double, c double, d double")
    win = windows(df, ["a", "c", "d"], 4, ["B"], target_inside=True, meta=["B", "split"],
                  partition=["split"], target=None)
    stats = S.window_cell_stats(win, 3)
    z = S.standardize_windows(S.impute_windows(win, stats), stats)
    cells = z.select(F.explode(F.flatten("X")).alias("v")).collect()
    assert cells and all(v.v is not None and np.isfinite(v.v) for v in cells)
