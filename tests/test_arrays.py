"""A1-A12, G1 on the edge cells of FIXTURES.md F2."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cadence.functions import arrays as A

CELLS = [
    ('[[1,2.5,"x"],[NaN]]', [[1.0, 2.5, None], [float("nan")]]),
    ('[["1.5",2]]', [[1.5, 2.0]]),
    ("[1,2]", [[1.0, 2.0]]),
    ("[[1,null],[3]]", [[1.0], [3.0]]),
    ("[]", []),
    ("[[]]", [[]]),
    ("[[1,Infinity]]", [[1.0, float("inf")]]),
    ("[['3', None]]", [[3.0]]),
    ("[[true, false, 2]]", [[1.0, 0.0, 2.0]]),
    ("[[True, 1]]", [[1.0, 1.0]]),
    ('[["inf", "-Infinity", "1e3", " 2 "]]', [[float("inf"), float("-inf"), 1000.0, 2.0]]),
    ("junk", None),
    ("   ", None),
    ('{"a":1}', None),
    ("[1, 2", None),
    (None, None),
]


def _same(a, b):
    if a is None or b is None:
        return a is b
    if isinstance(a, list):
        return len(a) == len(b) and all(_same(x, y) for x, y in zip(a, b))
    if isinstance(a, float) and math.isnan(a):
        return isinstance(b, float) and math.isnan(b)
    return a == b


def test_parse_series_edge_cells(spark):
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(CELLS)], "i int, cell string")
    got = {r.i: r.p for r in df.select("i", A.parse_series("cell").alias("p")).collect()}
    for i, (cell, want) in enumerate(CELLS):
        assert _same(got[i], want), (cell, got[i], want)


def test_channel_stats_edges(spark):
    rows = [([],), ([4.0],), ([1.0, None, 3.0],), ([1.0, 2.0, 4.0],)]
    df = spark.createDataFrame(rows, "x array<double>")
    out = [r.s.asDict() for r in df.select(A.channel_stats(F.col("x")).alias("s")).collect()]
    empty, single, with_null, plain = out
    assert empty["len"] == 0 and empty["min"] is None and empty["mean"] == 0.0
    assert empty["std"] == 0.0 and empty["first"] is None and empty["sum"] == 0.0 and empty["slope"] is None
    assert single["std"] == 0.0 and single["slope"] == 0.0
    assert with_null["mean"] is None and with_null["min"] == 1.0
    assert plain["mean"] == pytest.approx(7 / 3)
    assert plain["std"] == pytest.approx(np.std([1, 2, 4], ddof=1))
    assert plain["slope"] == 3.0


def test_summary_null_modes(spark):
    df = spark.createDataFrame([(None,), ("[]",), ("[[1,2],[3]]",)], "E string")
    plain = df.select(*A.summarize_series(A.parse_series("E"), "E")).collect()
    assert plain[0]["E_len_mean"] is None and plain[1]["E_len_max"] is None
    assert plain[2]["E_len_mean"] == 1.5 and plain[2]["E_len_max"] == 2
    assert plain[2]["E_std_mean"] == pytest.approx((np.std([1, 2], ddof=1) + 0.0) / 2)
    ref = df.select(*A.summarize_series(A.parse_series("E"), "E", null_len="minus_one")).collect()
    assert ref[0]["E_len_mean"] == -1.0 and ref[0]["E_len_max"] == -1 and ref[0]["E_std_mean"] == 0.0
    assert ref[1]["E_len_mean"] == -1.0 and ref[0]["E_mean_mean"] is None


def test_higher_order_form_equals_explode_form(spark):
    rng = np.random.default_rng(7)
    rows = []
    for k in range(60):
        chans = [[float(v) for v in rng.normal(size=rng.integers(0, 6))] for _ in range(rng.integers(1, 4))]
        rows.append((k, chans))
    df = spark.createDataFrame(rows, "k long, P array<array<double>>")
    a = df.select("k", *A.summarize_series(F.col("P"), "E")).orderBy("k").collect()
    b = A.summarize_exploded(df, "P", "k", "E").orderBy("k").collect()
    for ra, rb in zip(a, b):
        for c in ra.asDict():
            x, y = ra[c], rb[c]
            assert (x is None and y is None) or x == pytest.approx(y), (c, x, y)


def test_rows_form_matches_array_form(spark):
    rows = [(1, 1, 5.0), (1, 2, 7.0), (1, 3, 6.0), (2, 1, 1.0)]
    df = spark.createDataFrame(rows, "k long, pos int, v double")
    r = {x.k: x for x in A.summarize_rows(df, "k", "v", ["pos"], "Q").collect()}
    assert r[1]["Q_first_mean"] == 5.0 and r[1]["Q_last_mean"] == 6.0 and r[1]["Q_slope_mean"] == 1.0
    assert r[2]["Q_std_mean"] == 0.0 and r[1]["Q_len_max"] == 3


def test_plain_cells_are_summarised_in_batches_as_by_expressions(spark, monkeypatch):
    """Ragged channels of plain numbers: the same bits as the expressions give; other cells stay theirs."""
    rng = np.random.default_rng(8)
    texts = [c for c, _ in CELLS] + ["[[1e5,-2.5E-3],[0]]", "[ [1 , 2],[3] ]", "[[01]]", "[[1 2]]", "[[-0.0]]", "[[1e400]]", "[[1],2]"]
    for _ in range(200):
        channels = [rng.normal(size=rng.integers(1, 20)).tolist() for _ in range(rng.integers(1, 4))]
        texts.append(str(channels).replace(" ", "" if rng.random() < 0.5 else " "))
    df = spark.createDataFrame([(i, t, t) for i, t in enumerate(texts)], "i int, E string, F string")
    fast = A.plain_summary(pa.array(texts))
    assert fast[-200:].null_count == 0 and fast[:16].null_count == 16
    for null_len in ("null", "minus_one"):
        summary = lambda: [tuple(r) for r in A.summarize_series_columns(df, ["E", "F"], null_len=null_len).orderBy("i").collect()]
        got = summary()
        with monkeypatch.context() as m:
            m.setattr(A, "PLAIN_CELL", "^never$")
            want = summary()
        assert [[repr(v) for v in r] for r in got] == [[repr(v) for v in r] for r in want]
