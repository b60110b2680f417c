"""Multi-format timestamp parsing and epoch arithmetic.

Parsing returns TIMESTAMP_NTZ (wall clock), so results do not depend on the
session time zone; epoch seconds are taken from the wall clock the same way.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType, TimestampType

# The six accepted text layouts, tried in this order.
DEFAULT_FORMATS = (
    "M/d/yyyy H:mm",
    "M/d/yyyy HH:mm",
    "M/d/yyyy H:mm:ss",
    "M/d/yyyy HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
)

_EPOCH = "1970-01-01 00:00:00"  # cast from text: no zone takes part


def shape_of(fmt: str) -> str | None:
    """A loose regex that any text the layout ``fmt`` parses must match
    (numeric fields -> digits, literals as is); None when the layout has a
    letter this does not know (then no guard is used)."""
    out, i = ["^"], 0
    while i < len(fmt):
        ch = fmt[i]
        if ch == "'":
            j = fmt.index("'", i + 1)
            out.append(re.escape(fmt[i + 1:j]))
            i = j + 1
            continue
        if ch.isalpha():
            j = i
            while j < len(fmt) and fmt[j] == ch:
                j += 1
            if ch not in "yMdHhmsSDu":
                return None
            out.append("[+-]?[0-9]+" if ch in "yu" else "[0-9]+")
            i = j
            continue
        out.append(re.escape(ch))
        i += 1
    return "".join(out) + "$"


def parse_timestamp(col: Column | str, formats=DEFAULT_FORMATS) -> Column:
    """First format that parses wins; text no format parses gives NULL.

    Each layout is tried only on text of its shape (a cheap regex that is a
    necessary condition), so a row costs one real parse, not six.  The text is
    read as UTC and the instant turned back into a wall clock in UTC, so hours
    that a session zone skips or repeats read as they are written."""
    c = F.trim(F.col(col) if isinstance(col, str) else col)
    parsed = []
    for f in formats:
        p = F.try_to_timestamp(F.concat(c, F.lit("Z")), F.lit(f + "X"))
        shape = shape_of(f)
        parsed.append(F.when(c.rlike(shape), p) if shape else p)
    us = F.unix_micros(F.coalesce(*parsed))
    return F.timestamp_add("MICROSECOND", us, F.lit(_EPOCH).cast("timestamp_ntz"))


def to_wall_clock(df: DataFrame, name: str) -> DataFrame:
    """Make ``name`` a TIMESTAMP_NTZ column (strings are parsed with P1)."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, TimestampNTZType):
        return df
    if isinstance(dtype, TimestampType):
        return df.withColumn(name, F.col(name).cast("timestamp_ntz"))
    return df.withColumn(name, parse_timestamp(F.col(name).cast("string")))


def epoch_micros(ts: Column | str) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MICROSECOND", F.lit(_EPOCH).cast("timestamp_ntz"), c)


def epoch_seconds(ts: Column | str) -> Column:
    """Whole epoch seconds (floor), as the reference's cast to long."""
    us = epoch_micros(ts)
    return ((us - F.pmod(us, F.lit(1_000_000))) / F.lit(1_000_000)).cast("long")


def keep_parsed(df: DataFrame, time_col: str) -> DataFrame:
    """Keep rows with a timestamp."""
    return df.filter(F.col(time_col).isNotNull())


def require_rows(df: DataFrame, time_col: str) -> DataFrame:
    """P2 guard: fail with a message when no timestamp parsed."""
    if df.isEmpty():
        raise ValueError(
            f"No timestamps could be parsed in column '{time_col}'; "
            "pass the missing layout in `formats`.")
    return df
