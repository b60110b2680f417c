"""No caps, no size switches, exact ranks, and the cells that were read wrongly before."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadence.functions.arrays import parse_series
from cadence.functions.timeparse import parse_timestamp
from cadence.operators import models as M
from cadence.operators import stats as S
from cadence.operators.projection import feature_columns
from cadence.operators.rowindex import range_partitions, values_at_ranks, with_row_index
from cadence.operators.sequences import last_n_per_stream
from cadence.operators.splits import time_quantiles
from cadence.sources import io


def test_every_numeric_column_is_a_feature(spark):
    df = spark.createDataFrame([(1.0, 2.0, "t")], "_temp double, x double, name string")
    assert feature_columns(df) == ["_temp", "x"]


def test_all_valid_streams(spark):
    df = spark.createDataFrame([(s, i) for s in range(20) for i in range(11)], "A long, i long")
    assert S.stream_sizes(df, "A", 10).count() == 20
    assert S.stream_sizes(df, "A", 10, top=15).count() == 15


def test_range_sizing_reads_units(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet")
    name = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(name)
    try:
        spark.conf.set(name, "8KB")
        small = range_partitions(df)
        spark.conf.set(name, "8192")
        assert range_partitions(df) == small > 50
        spark.conf.set(name, "128MB")
        assert range_partitions(df) == 4
    finally:
        spark.conf.set(name, old)


def test_equal_rows_are_split_over_ranges(spark):
    for df in (spark.range(8000).select(F.lit(1).alias("k")),
               spark.range(8000).select((F.col("id") % 11).alias("k"))):
        ix = with_row_index(df, ["k"], num_partitions=8)
        assert sorted(r._rn for r in ix.collect()) == list(range(8000))
        sizes = [r["count"] for r in ix.groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) < 2 * 8000 / 8


def test_values_at_ranks(spark):
    rng = np.random.default_rng(4)
    data = {"hot": np.where(rng.random(3000) < 0.9, 5.0, rng.normal(size=3000)), "one": np.full(3000, 2.5),
            "far": rng.normal(size=3000) * 10.0 ** rng.integers(-300, 300, 3000),
            "ends": np.array([-1.7e308, 1.7e308] * 1500)}
    long = spark.createDataFrame([(n, float(v)) for n, x in data.items() for v in x], "feature string, v double")
    ranks = {n: [0, 17, 1499, 1500, 2999] for n in data}
    got = values_at_ranks(long, ranks)
    assert got == {(n, r): float(np.sort(x)[r]) for n, x in data.items() for r in ranks[n]}


def test_quantiles_without_rows(spark):
    df = spark.createDataFrame([(None,)], "t timestamp_ntz")
    assert time_quantiles(df, "t").first()._q == [None, None]


@pytest.mark.parametrize("cell, want", [
    ("[1,2] junk", None), ("[1] [2]", None), ('["1d","2f",3]', [[None, None, 3.0]]), ("[1,2,]", [[1.0, 2.0]]),
    ("[+1]", [[1.0]]), ("[1_000]", [[1000.0]]), ("[[1,null],[2]]", [[1.0], [2.0]]), ("[1e400]", [[float("inf")]]),
    ("['a',None,True]", [[None, 1.0]]), ("[[1,2],[3]", None), ('["]", 1]', [[None, 1.0]]), ("[]", []),
])
def test_cells(spark, cell, want):
    assert spark.createDataFrame([(cell,)], "c string").select(parse_series("c")).first()[0] == want


def test_time_does_not_depend_on_the_session_zone(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        df = spark.createDataFrame([("2024-03-10 02:30:00",), ("11/3/2024 1:30",)], "t string")
        got = [r.t for r in df.select(parse_timestamp("t").cast("string").alias("t")).collect()]
        assert got == ["2024-03-10 02:30:00", "2024-11-03 01:30:00"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_fingerprint_counts_repeats(spark):
    a = io.fingerprint(spark.createDataFrame([(1,), (1,)], "x long")).first()
    b = io.fingerprint(spark.createDataFrame([(2,), (2,)], "x long")).first()
    c = io.fingerprint(spark.createDataFrame([(1,), (1,)], "x long").repartition(2)).first()
    assert a != b and a == c and a.fingerprint_a != "0"


def test_last_rows_of_the_null_stream(spark):
    df = spark.createDataFrame([(s, i) for s in (None, "a") for i in range(4)], "A string, B long")
    got = {(r.A, r.B) for r in last_n_per_stream(df, "A", ["B"], 2).collect()}
    assert got == {(None, 2), (None, 3), ("a", 2), ("a", 3)}


def test_ridge_refuses_nulls_and_takes_many_features(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 1.0)], "x double, y double")
    with pytest.raises(ValueError):
        M.ridge_fit(df, ["x"], "y")
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 120)) + 1000.0
    y = x @ rng.normal(size=120) + rng.normal(size=200)
    names = [f"f{i}" for i in range(120)]
    rows = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)],
                                 ", ".join(f"{n} double" for n in [*names, "y"]))
    model = M.ridge_fit(rows, names, "y")
    xc, yc = x - x.mean(0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + np.eye(120), xc.T @ yc)
    assert np.allclose(model.coef, want, rtol=1e-6, atol=1e-8)
    pred = rows.select(model.predict("p")).collect()
    assert np.allclose([r.p for r in pred], x @ want + y.mean() - x.mean(0) @ want, rtol=1e-6)


def test_cluster_without_shared_folder_is_refused():
    from cadence.session import ensure_checkpoint_dir

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(Session())
