"""Projections built from the schema and role lists."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (BooleanType, ByteType, DecimalType, DoubleType, FloatType,
                               IntegerType, LongType, ShortType)

from cadence.roles import ColumnRoles

_NUMERIC = (BooleanType, ByteType, ShortType, IntegerType, LongType, FloatType, DoubleType,
            DecimalType)


def feature_columns(df: DataFrame, roles: ColumnRoles | None = None, exclude=(),
                    pattern: str | None = None, include_label: bool = False,
                    limit: int | None = None, numeric_only: bool = True) -> list[str]:
    """Numeric columns (booleans count) minus role columns and ``exclude``;
    optionally those matching ``pattern``, sorted and trimmed to ``limit``."""
    drop = set(exclude)
    if roles is not None:
        drop |= set(roles.meta())
        if include_label and roles.label:
            drop.discard(roles.label)
    out = []
    for f in df.schema.fields:
        if f.name in drop:
            continue
        if numeric_only and not isinstance(f.dataType, _NUMERIC):
            if not (include_label and roles is not None and f.name == roles.label):
                continue
        out.append(f.name)
    if pattern is not None:
        rx = re.compile(pattern)
        out = sorted(c for c in out if rx.search(c))
    return out[:limit] if limit else out


def project_features(df: DataFrame, keep: list[str], features: list[str]) -> DataFrame:
    """P3 as a projection (the scan reads only these columns)."""
    return df.select(*keep, *features)


def drop_case_insensitive(df: DataFrame, names) -> DataFrame:
    """P5: drop columns whose names match ``names`` ignoring case."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(c) for c in df.columns if c.lower() not in low])


def rename_roles(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """P5: rename to role names."""
    return df.withColumnsRenamed(mapping)


def align_features(df: DataFrame, keep: list[str], ordered: list[str], strict: bool = False,
                   fill: float = 0.0) -> DataFrame:
    """Columns in the order of ``ordered``; a missing one is ``fill``
    (zero padding) or an error when ``strict``."""
    missing = [c for c in ordered if c not in df.columns]
    if strict and missing:
        raise ValueError(f"features missing from the table: {missing}")
    cols = [F.col(c).cast("double").alias(c) if c in df.columns else F.lit(float(fill)).alias(c)
            for c in ordered]
    return df.select(*keep, *cols)


def split_filter(df: DataFrame, split: str = "split", value: str = "test") -> DataFrame:
    """One split; on a table written with ``partitionBy(split)`` this
    prunes partitions at the scan."""
    return df.filter(F.col(split) == value)


def stream_filter(df: DataFrame, stream: str, value) -> DataFrame:
    """One stream."""
    return df.filter(F.col(stream) == F.lit(value))
