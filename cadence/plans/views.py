"""Cycle tables derived from the driver tables.

Each view reads whole tables; its size grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.roles import ColumnRoles

EVENTS_ROLES = ColumnRoles(stream="A", cycle="B", time="C", label="D", series=())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cycles_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a cycle table: A=user_id, B=event_id, C=ts, D=event_type."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("A"), F.col("event_id").alias("B"),
                    F.col("ts").alias("C"), F.col("event_type").alias("D"),
                    F.col("value"))


def streams_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as short streams: A=conv_id, B=turn, text length as value.
    There is no time column, so C is a synthetic clock: one minute per turn."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("A"), F.col("turn").alias("B"),
                    F.timestamp_add("MINUTE", F.col("turn").cast("int"),
                                    F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias("C"),
                    F.col("role").alias("D"),
                    F.length("text").cast("double").alias("value"))


def series_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as a 4-channel series (64 floats -> 4 x 16, as doubles)."""
    e = table(spark, sf_dir, "embeddings")
    d = F.col("embedding").cast("array<double>")
    chans = F.array(*[F.slice(d, 1 + 16 * i, 16) for i in range(4)])
    return e.select(F.col("vec_id"), F.col("label"), chans.alias("E"))


def series_embed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same series as JSON text cells (the A1 input form)."""
    return series_embed(spark, sf_dir).select("vec_id", "label", F.to_json("E").alias("E"))


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem in long form: one row per (order, line) with its values."""
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                     "l_quantity", "l_extendedprice", "l_discount", "l_tax")


def reg_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as a regression table: features quantity, discount and the
    discount/tax ratio (NULL where tax is 0), target extendedprice, a row key
    from the integer line columns (unique in the driver tables) and a seeded
    70/15/15 train/val/test split by that key."""
    from cadence.operators.splits import random_split
    li = table(spark, sf_dir, "lineitem")
    key = F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    out = li.select(key.alias("row_key"), "l_quantity", "l_discount", "l_tax",
                    F.try_divide("l_discount", "l_tax").alias("tax_ratio"),
                    F.col("l_extendedprice").alias("y"))
    return random_split(out, "row_key", test_fraction=0.15, val_fraction=0.15)


def reg_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``reg_lines`` with a label that its features explain, and ridge cannot follow: a step at
    quantity 25, a product of quantity and discount, and a seeded residue of +-50 (the label of
    ``reg_lines`` has no signal: the test tables draw prices independently)."""
    from cadence.operators.splits import seeded_unit
    step = F.when(F.col("l_quantity") > 25, F.lit(1000.0)).otherwise(F.lit(0.0))
    residue = (seeded_unit(F.col("row_key"), 7) - 0.5) * 100.0
    return reg_lines(spark, sf_dir).withColumn(
        "y", step + F.col("l_quantity") * F.col("l_discount") * 400.0 + residue)
