"""Registered queries: one per operator id of SURVEY section 2.

Each entry is a function ``(spark, sf_dir) -> DataFrame`` that reads the
whole driver tables, plus (where SQL can say it) an equivalent DuckDB query
over the same tables.  Double columns are rounded to 8 significant digits
on both sides.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from cadence.plans.oracle import rounded

SIG_DIGITS = int(os.environ.get("CADENCE_SIG_DIGITS", "8"))


@dataclass
class Query:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    doubles: tuple[str, ...]


REGISTRY: dict[str, Query] = {}


def round_significant(x, digits: int = SIG_DIGITS):
    """Round to ``digits`` significant digits with plain IEEE operations
    (floor(x * 10^k + 0.5) / 10^k, k from log10|x|).  The oracle SQL does the
    same operations, so the two engines give bit-identical doubles whenever
    their raw results agree to about 1e-9 relative (8 digits).  -0.0 becomes 0.0; NaN and
    infinities pass through."""
    k = F.lit(digits - 1) - F.floor(F.log10(F.abs(x)))
    scale = F.pow(F.lit(10.0), k)
    r = (F.floor(x * scale + F.lit(0.5)).cast("double") / scale) + F.lit(0.0)
    return (F.when(x.isNull(), x)
             .when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), x)
             .when(x == 0, F.lit(0.0))
             .otherwise(r))


def finish(df: DataFrame) -> DataFrame:
    """Round doubles (and -0.0 -> 0.0) so results compare across engines."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            cols.append(round_significant(F.col(f.name).cast("double")).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def ts_text(c):
    """Timestamp as text with microseconds (engine-neutral output type)."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def query(name: str, sql: str | None = None, doubles: tuple[str, ...] = ()):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return finish(fn(spark, sf_dir))
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        REGISTRY[name] = Query(name, run, rounded(sql, list(doubles), SIG_DIGITS) if sql else None, doubles)
        return fn
    return deco


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {k: q.fn for k, q in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {k: q.sql for k, q in REGISTRY.items() if q.sql}


def _load() -> None:
    # importing the modules registers their queries
    from cadence.plans import q_cycles, q_arrays, q_sequences, q_stats, q_models, q_sources  # noqa: F401
