"""Dense positions with a hot key; window counts at n = L-1, L, L+1; streams."""

import numpy as np
from pyspark.sql import functions as F

from cadence.operators.rowindex import neighbour, with_row_index
from cadence.operators.sequences import windows, windows_with_fallback


def test_dense_index_with_hot_key(spark):
    rng = np.random.default_rng(1)
    n = 3000
    k1 = np.where(np.arange(n) < n // 3, 5, rng.integers(0, 100, n))   # a third share one key
    rows = [(int(a), i) for i, a in enumerate(k1)]
    df = spark.createDataFrame(rows, "k1 long, k2 long")
    got = with_row_index(df, ["k1", "k2"], num_partitions=6).select("k1", "k2", "_rn").collect()
    assert sorted(r._rn for r in got) == list(range(n))
    by_pos = [(r.k1, r.k2) for r in sorted(got, key=lambda r: r._rn)]
    assert by_pos == sorted(by_pos)
    sizes = (with_row_index(df, ["k1", "k2"], num_partitions=6).groupBy(F.spark_partition_id()).count()
             .collect())
    assert max(r["count"] for r in sizes) < n  # the hot key is not one partition


def _seq(spark, n, stream="s"):
    return spark.createDataFrame([(stream, i, float(i)) for i in range(n)], "A string, B long, v double")


def test_window_counts(spark):
    L = 4
    for n, inside, nxt in [(L - 1, 0, 0), (L, 1, 0), (L + 1, 2, 1)]:
        df = _seq(spark, n)
        assert windows(df, ["v"], L, ["B"], target_inside=True, meta=["B"], target="v").count() == inside
        assert windows(df, ["v"], L, ["B"], target_inside=False, meta=["B"], target="v").count() == nxt


def test_window_content_and_streams(spark):
    df = _seq(spark, 6, "a").unionByName(_seq(spark, 3, "b"))
    w = windows(df, ["v"], 3, ["B"], target_inside=False, meta=["A", "B"], partition=["A"], target="v")
    got = {(r.A, r.B): [x[0] for x in r.X] for r in w.collect()}
    assert got == {("a", 3): [0.0, 1.0, 2.0], ("a", 4): [1.0, 2.0, 3.0], ("a", 5): [2.0, 3.0, 4.0]}
    fb = windows_with_fallback(df, ["v"], 5, ["B"], "A", meta=["A", "B"], target="v")
    assert fb.count() == 1  # stream a has 6 = L + 1 rows: per-stream windows
    fb = windows_with_fallback(df, ["v"], 6, ["B"], "A", meta=["A", "B"], target="v")
    assert fb.count() == 9 - 6  # no stream is long enough: global windows


def test_null_feature_kept_in_window(spark):
    df = spark.createDataFrame([(i, None if i == 1 else float(i)) for i in range(4)], "B long, v double")
    w = windows(df, ["v"], 3, ["B"], target_inside=True, meta=["B"], target=None).collect()
    xs = {r.B: [x[0] for x in r.X] for r in w}
    assert xs[2] == [0.0, None, 2.0]


def test_neighbour_respects_stream(spark):
    df = _seq(spark, 3, "a").unionByName(_seq(spark, 2, "b"))
    ix = with_row_index(df, ["A", "B"])
    out = {(r.A, r.B): r.next_v for r in neighbour(ix, ["v"], 1, "next_", same=["A"]).collect()}
    assert out[("a", 2)] is None and out[("a", 0)] == 1.0 and out[("b", 1)] is None


def test_index_with_map_column(spark):
    df = spark.createDataFrame([(i, {"k": i}) for i in range(10)], "B long, m map<string,long>")
    assert sorted(r._rn for r in with_row_index(df, ["B"]).collect()) == list(range(10))
