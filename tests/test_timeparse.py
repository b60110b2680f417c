"""The six layouts, junk, NULL; whole-second epochs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cadence.functions.timeparse import epoch_seconds, parse_timestamp, require_rows


def test_six_layouts(spark):
    cells = ["3/7/2024 9:05", "3/7/2024 09:05", "3/7/2024 9:05:07", "3/7/2024 09:05:07",
             "2024-03-07 09:05:07", "2024-03-07T09:05:07", "junk", "", None]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    got = [r.t for r in df.select(parse_timestamp("c").alias("t")).collect()]
    m, s = dt.datetime(2024, 3, 7, 9, 5), dt.datetime(2024, 3, 7, 9, 5, 7)
    assert got == [m, m, s, s, s, s, None, None, None]


def test_epoch_seconds_floor(spark):
    df = spark.createDataFrame([(dt.datetime(1970, 1, 1, 0, 0, 1, 900000),),
                                (dt.datetime(1969, 12, 31, 23, 59, 59, 500000),)], "t timestamp_ntz")
    assert [r.e for r in df.select(epoch_seconds("t").alias("e")).collect()] == [1, -1]


def test_no_timestamp_raises(spark):
    df = spark.createDataFrame([("junk",)], "c string").select(parse_timestamp("c").alias("C"))
    with pytest.raises(ValueError):
        require_rows(df.filter(F.col("C").isNotNull()), "C")
