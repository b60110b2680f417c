"""Time split, split summaries, seeded splits and samples."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.functions.timeparse import epoch_micros
from cadence.operators.rowindex import RN, with_row_index
from cadence.roles import SPLIT, TARGET

# Reference split fractions.
TRAIN_FRAC, VAL_FRAC = 0.70, 0.85


def time_quantiles(df: DataFrame, time_col: str, fractions=(TRAIN_FRAC, VAL_FRAC),
                   accuracy: int | None = None) -> DataFrame:
    """One-row frame ``_q`` with the time quantiles: the smallest time with
    at least the fraction of the rows at or before it, exact at any size, from two
    evaluations of ``df`` (``rowindex.values_at_fractions``).  ``accuracy`` opts for the mergeable
    ``percentile_approx`` sketch of that accuracy instead."""
    from cadence.operators.rowindex import values_at_fractions
    if accuracy is not None:
        return df.select(F.percentile_approx(time_col, list(fractions), accuracy).alias("_q"))
    kind = df.schema[time_col].dataType
    rank = lambda n, f: [max(n - math.floor(n - f * n), 1) - 1]
    counts, got = values_at_fractions(df, {"t": epoch_micros(time_col)}, list(fractions), rank)
    value = lambda us: F.lit(None).cast(kind) if us is None else _from_micros(int(us)).cast(kind)
    at = [got[("t", rank(counts["t"], f)[0])] if counts["t"] else None for f in fractions]
    return df.sparkSession.range(1).select(F.array(*[value(us) for us in at]).alias("_q"))


def _from_micros(us: int) -> Column:
    return F.lit((dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=us)).isoformat(" ")).cast("timestamp_ntz")


def assign_time_split(df: DataFrame, time_col: str, fractions=(TRAIN_FRAC, VAL_FRAC),
                      accuracy: int | None = None, name: str = SPLIT,
                      times: DataFrame | None = None) -> DataFrame:
    """``<= q70`` train, ``<= q85`` val, else test.

    The thresholds are a one-row frame joined by broadcast (size bound: one
    row).  ``times``: a cheaper frame with the same times, to take them from."""
    q = time_quantiles(df if times is None else times, time_col, fractions, accuracy)
    t = F.col(time_col)
    return (df.crossJoin(F.broadcast(q))
              .withColumn(name, F.when(t <= F.col("_q")[0], F.lit("train"))
                                 .when(t <= F.col("_q")[1], F.lit("val"))
                                 .otherwise(F.lit("test")))
              .drop("_q"))


def split_target_summary(df: DataFrame, target: str = TARGET, split: str = SPLIT) -> DataFrame:
    """G4 (+G11): per split mean target and row count, ordered by split."""
    return (df.groupBy(split)
              .agg(F.avg(target).alias("avg_cycle"), F.count(F.lit(1)).alias("n"))
              .orderBy(split))


def split_counts(df: DataFrame, target: str = TARGET, split: str = SPLIT) -> DataFrame:
    """Rows and non-null targets per split (NULL split kept)."""
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("rows"),
                                 F.count(target).alias("targets"))


def require_splits(df: DataFrame, target: str = TARGET, split: str = SPLIT,
                   names=("train", "val", "test")) -> None:
    """G5 guard: raise when a split has no row with a target (small result)."""
    got = {r[split]: r["targets"] for r in split_counts(df, target, split).collect()}
    empty = [n for n in names if not got.get(n)]
    if empty:
        raise RuntimeError(f"Empty split detected: {empty}; counts {got}")


def seeded_unit(key: Column, seed: int = 42) -> Column:
    """Reproducible pseudo-random number in [0, 1) from the row key (md5 of
    ``key:seed``): stable under repartitioning and re-execution."""
    h = F.substring(F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed)))), 1, 8)
    return F.conv(h, 16, 10).cast("double") / F.lit(float(16 ** 8))


def random_split(df: DataFrame, key: str, test_fraction: float = 0.2, seed: int = 42,
                 name: str = SPLIT, val_fraction: float = 0.0) -> DataFrame:
    """M7: seeded split by row key: 80/20 train/test by default, or
    train/val/test when ``val_fraction`` > 0."""
    u = seeded_unit(F.col(key), seed)
    train_end = round(1.0 - test_fraction - val_fraction, 12)
    return df.withColumn(name, F.when(u < F.lit(train_end), F.lit("train"))
                               .when(u < F.lit(round(1.0 - test_fraction, 12)), F.lit("val"))
                               .otherwise(F.lit("test")))


def ordered_fraction_split(df: DataFrame, order: list, fraction: float = 0.8,
                           name: str = SPLIT) -> DataFrame:
    """M8: first ``int(fraction * n)`` rows in ``order`` are train, rest test.

    Position from the distributed dense index, count from one aggregate."""
    ix = with_row_index(df, order)
    n = ix.select(F.count(F.lit(1)).alias("_n"))
    cut = F.floor(F.lit(fraction) * F.col("_n"))
    return (ix.crossJoin(F.broadcast(n))
              .withColumn(name, F.when(F.col(RN) < cut, F.lit("train")).otherwise(F.lit("test")))
              .drop("_n"))


def seeded_sample(df: DataFrame, key: Column | str, n: int, seed: int = 42) -> DataFrame:
    """M9: at most ``n`` rows, the first ``n`` in the md5 order of ``key:seed``
    (top ``n`` of each task, then a merge)."""
    k = F.col(key) if isinstance(key, str) else key
    h = F.md5(F.concat_ws(":", k.cast("string"), F.lit(str(seed))))
    return df.withColumn("_h", h).orderBy("_h").limit(n).drop("_h")
