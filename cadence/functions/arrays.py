"""Nested series cells and their statistics.

A cell holds text for an array of channels (``[[1,2],[3]]``) or a single
channel (``[1,2,3]``).  Parsing and all statistics are native expressions
(``from_json`` and higher-order functions), so the whole series summary is a
single projection without a shuffle.  Cells that hold only channels of plain
numbers are summarised in Arrow batches instead, all cells of a batch at once
(``plain_summary``), with the same results.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need not have this package

# Statistic names in output order (the feature table layout).
CHANNEL_STATS = ("len", "min", "max", "mean", "std", "first", "last", "sum", "slope")
SUMMARY_SUFFIXES = (
    "len_mean", "len_max", "min_mean", "max_mean", "mean_mean", "std_mean",
    "first_mean", "last_mean", "sum_mean", "slope_mean",
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# A number as Python's float() reads it: underscores between digits, no suffix.
_DIGITS = r"[0-9]+(?:_[0-9]+)*"
_NUMBER = (rf"^[+-]?(?:(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?"
           r"|(?i:inf|infinity|nan))$")
# A list of items or of lists, and nothing behind it (strings taken out before).
_SHAPE = r"^\[[^\[\]]*(?:\[[^\[\]]*\][^\[\]]*)*\]$"


# Numbers only: read straight as doubles, without a look at each item.
_PLAIN = r"^[\[\]0-9eE+\-., ]*$"


def _item(x: Column) -> Column:
    """One item as a number: quoted numbers, NaN and Infinity read as floats,
    booleans as 1/0 (as Python's ``float``), anything else NULL."""
    t = F.trim(F.regexp_replace(x, '^"|"$', ""))
    t = F.when(F.contains(t, F.lit("_")), F.regexp_replace(F.when(t.rlike(_NUMBER), t), "_", "")).otherwise(t)
    number = F.when(t.rlike(_NUMBER), t.try_cast("double"))
    return F.when(x == "true", F.lit(1.0)).when(x == "false", F.lit(0.0)).otherwise(number)


def _channel_of(items: Column) -> Column:
    kept = F.filter(items, lambda x: x.isNotNull())
    return F.transform(kept, _item)


def _parse_json(text: Column) -> Column:
    nested = F.from_json(text, "array<array<string>>")
    flat = F.from_json(text, "array<string>")
    as_nested = F.transform(nested, _channel_of)
    as_flat = F.array(_channel_of(flat))
    return (F.when(nested.isNotNull(), as_nested)
             .when(flat.isNotNull() & (F.size(flat) == 0), F.array().cast("array<array<double>>"))
             .when(flat.isNotNull(), as_flat))


def parse_series(cell: Column | str) -> Column:
    """A1: text cell -> array<array<double>>.

    NULL, blank and unparsable text, and text behind the list, give NULL; JSON
    first, then the common Python-literal spellings (single quotes,
    None/True/False, a trailing comma, a plus sign, underscores in numbers).
    Nulls inside a channel are dropped, non-numeric items become NULL, a flat
    array is one channel.
    """
    text = F.trim(_col(cell).cast("string"))
    bare = F.regexp_replace(text, r""""(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'""", "s")
    plain = F.from_json(F.when(text.rlike(_PLAIN), text), "array<array<double>>")
    literal = F.regexp_replace(text, "'", '"')
    literal = F.regexp_replace(literal, r"\bNone\b", "null")
    literal = F.regexp_replace(literal, r"\bTrue\b", "true")
    literal = F.regexp_replace(literal, r"\bFalse\b", "false")
    literal = F.regexp_replace(literal, r",\s*\]", "]")
    literal = F.regexp_replace(literal, r"([\[,]\s*)\+(?=[0-9.])", "$1")
    literal = F.regexp_replace(literal, r"(?<=[0-9])_(?=[0-9])", "")
    return F.when(bare.rlike(_SHAPE), F.coalesce(plain, _parse_json(text), _parse_json(literal))).cast(
        "array<array<double>>")


# --- A2-A10: statistics of one channel (array<double>) -------------------------

def ch_len(x: Column) -> Column:
    return F.array_size(x)


def ch_sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)


def ch_mean(x: Column, total: Column | None = None) -> Column:
    total = ch_sum(x) if total is None else total
    n = F.array_size(x)
    return total / F.when(n > 0, n).otherwise(F.lit(1.0))


def ch_std(x: Column, mean: Column | None = None) -> Column:
    """Sample std, two passes around the mean; fewer than 2 items -> 0."""
    mean = ch_mean(x) if mean is None else mean
    n = F.array_size(x)
    ss = F.aggregate(x, F.lit(0.0), lambda acc, v: acc + (v - mean) * (v - mean))
    return F.when(n > 1, F.sqrt(ss / (n - 1))).otherwise(F.lit(0.0))


def ch_first(x: Column) -> Column:
    return F.try_element_at(x, F.lit(1))


def ch_last(x: Column) -> Column:
    return F.try_element_at(x, F.lit(-1))


def channel_stats(x: Column) -> Column:
    """A2-A10 of one channel as a struct (sum and mean computed once, reused)."""
    return _stats_from_parts(_with_mean(_channel_parts(x)))


def _channel_parts(x: Column) -> Column:
    """First pass over a channel: the items, their count and sum."""
    return F.struct(x.alias("x"), F.array_size(x).alias("n"), ch_sum(x).alias("s"))


def _with_mean(p: Column) -> Column:
    n = p["n"]
    return F.struct(p["x"].alias("x"), n.alias("n"), p["s"].alias("s"),
                    (p["s"] / F.when(n > 0, n).otherwise(F.lit(1.0))).alias("m"))


def _stats_from_parts(p: Column) -> Column:
    """Second pass: every statistic from the items, their sum and their mean."""
    x, mean = p["x"], p["m"]
    first, last = ch_first(x), ch_last(x)
    return F.struct(
        p["n"].alias("len"),
        F.array_min(x).alias("min"),
        F.array_max(x).alias("max"),
        mean.alias("mean"),
        ch_std(x, mean).alias("std"),
        first.alias("first"),
        last.alias("last"),
        p["s"].alias("sum"),
        (last - first).alias("slope"),
    )


def _row_of(stat: Column) -> Column:
    return F.array(*[stat[name].cast("double") for name in CHANNEL_STATS])


def _channel_means(rows: Column) -> Column:
    """Mean of each statistic over the channels that have it, as one array:
    sums and counts of all of them in one pass each."""
    k = len(CHANNEL_STATS)
    zero = F.array(*[F.lit(0.0)] * k)
    total = F.aggregate(rows, zero, lambda a, r: F.zip_with(a, r, lambda x, v: x + F.coalesce(v, F.lit(0.0))))
    n = F.aggregate(rows, zero, lambda a, r: F.zip_with(a, r, lambda x, v: x + v.isNotNull().cast("double")))
    return F.zip_with(total, n, lambda t, c: F.when(c > 0, t / c))


def summarize_series(parsed: Column, prefix: str, null_len: str = "null") -> list[Column]:
    """Mean over channels of each statistic, max over channels of length.

    ``parsed`` is array<array<double>>.  NULL statistics are skipped by the
    mean (as SQL ``avg``).  A NULL or channel-less cell gives NULL everywhere
    (``null_len="null"``) or the reference numbers (``"minus_one"``: lengths
    -1, std 0, the rest NULL).
    """
    stats = F.transform(parsed, channel_stats)
    return _means(_channel_means(F.transform(stats, _row_of)), stats, parsed, prefix, null_len)


def _means(means: Column, stats: Column, parsed: Column, prefix: str, null_len: str) -> list[Column]:
    place = {f"{name}_mean": i for i, name in enumerate(CHANNEL_STATS)}
    empty = parsed.isNull() | (F.array_size(parsed) == 0)
    cols = []
    for suffix in SUMMARY_SUFFIXES:
        if suffix == "len_max":
            expr = F.array_max(F.transform(stats, lambda s: s["len"]))
        else:
            expr = means[place[suffix]]
        if null_len == "minus_one":
            if suffix == "len_mean":
                expr = F.when(empty, F.lit(-1.0)).otherwise(expr)
            elif suffix == "len_max":
                expr = F.when(empty, F.lit(-1)).otherwise(expr)
            elif suffix == "std_mean":
                expr = F.when(empty, F.lit(0.0)).otherwise(expr)
        cols.append(expr.alias(f"{prefix}_{suffix}"))
    return cols


# Channels of JSON numbers, none of them empty: nothing that needs a look at each item.
_JSON_NUMBER = r"-?(?:0|[1-9][0-9]{0,99})(?:\.[0-9]+)?(?:[eE][+-]?[0-9]{1,2})?"
_JSON_CHANNEL = rf"\[ *{_JSON_NUMBER} *(?:, *{_JSON_NUMBER} *)*\]"
PLAIN_CELL = rf"^\[ *{_JSON_CHANNEL} *(?:, *{_JSON_CHANNEL} *)*\]$"


def _fold(values: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sums of the runs of ``values`` that start at ``begin``, each item after item from the first, as
    ``aggregate`` adds them up."""
    out = np.zeros((len(begin), *values.shape[1:]))
    for k in range(size.max(initial=0)):
        has = np.flatnonzero(size > k)
        out[has] += values[begin[has] + k]
    return out


def plain_summary(cells: pa.Array) -> pa.Array:
    """The values of ``SUMMARY_SUFFIXES`` for every plain cell (``PLAIN_CELL``), NULL for any other."""
    plain = pc.fill_null(pc.match_substring_regex(cells, PLAIN_CELL), False).to_numpy(zero_copy_only=False)
    text = pc.replace_substring(pc.filter(cells, pa.array(plain)), " ", "")
    channels = pc.split_pattern(pc.utf8_slice_codeunits(text, 2, -2), "],[")
    of_cell = np.diff(channels.offsets.to_numpy())
    items = pc.split_pattern(channels.flatten(), ",")
    n = np.diff(items.offsets.to_numpy())
    x = items.flatten().cast(pa.float64()).to_numpy()
    ends = np.zeros((len(plain) + 1), np.int32)
    ends[1:] = np.cumsum(plain) * len(SUMMARY_SUFFIXES)
    if not len(x):
        values = np.zeros(0)
    else:
        begin = np.cumsum(n) - n
        total = _fold(x, begin, n)
        mean = total / n
        off = x - np.repeat(mean, n)
        std = np.where(n > 1, np.sqrt(_fold(off * off, begin, n) / np.maximum(n - 1, 1)), 0.0)
        first, last = x[begin], x[begin + n - 1]
        stats = np.stack([n.astype(float), np.minimum.reduceat(x, begin), np.maximum.reduceat(x, begin), mean, std,
                          first, last, total, last - first], axis=1)
        begin = np.cumsum(of_cell) - of_cell
        means = _fold(stats, begin, of_cell) / of_cell[:, None]
        values = np.insert(means, 1, np.maximum.reduceat(n, begin), axis=1).ravel()
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values), mask=pa.array(~plain))


def summarize_series_columns(df: DataFrame, columns, parse: bool = True,
                             null_len: str = "null", keep_raw: bool = False) -> DataFrame:
    """A12 over many columns with no shuffle; a missing column is skipped
    (the reference warns).

    Plain cells are summarised in Arrow batches, the others by narrow projections: parse each cell once, compute sums, means and
    statistics of each channel once, then the means over channels.  Spark does not merge a projection into
    the next when that would repeat an expensive expression, so each step
    runs once per row."""
    present = [c for c in columns if c in df.columns]
    if not present:
        return df
    keep = [c for c in df.columns if keep_raw or c not in present]
    texts = [c for c in present if parse and df.schema[c].dataType.simpleString() == "string"]
    fast = F.arrow_udf(plain_summary, "array<double>") if texts else None
    step = df.select("*", *[fast(F.col(c)).alias(f"__f_{c}") for c in texts])
    keep += [f"__f_{c}" for c in texts]
    rest = lambda c: F.when(F.col(f"__f_{c}").isNull(), F.col(c)) if c in texts else F.col(c)
    step = step.select(*keep, *[(parse_series(rest(c)) if parse else F.col(c)).alias(f"__p_{c}")
                                for c in present])
    step = step.select(*keep, *[F.transform(f"__p_{c}", _channel_parts).alias(f"__q_{c}")
                                for c in present], *[f"__p_{c}" for c in present])
    step = step.select(*keep, *[F.transform(f"__q_{c}", _with_mean).alias(f"__m_{c}")
                                for c in present], *[f"__p_{c}" for c in present])
    step = step.select(*keep, *[F.transform(f"__m_{c}", _stats_from_parts).alias(f"__s_{c}")
                                for c in present], *[f"__p_{c}" for c in present])
    step = step.select("*", *[F.transform(f"__s_{c}", _row_of).alias(f"__r_{c}") for c in present])
    step = step.select("*", *[_channel_means(F.col(f"__r_{c}")).alias(f"__t_{c}") for c in present])
    out = []
    for c in present:
        slow = _means(F.col(f"__t_{c}"), F.col(f"__s_{c}"), F.col(f"__p_{c}"), c, null_len)
        names = [f"{c}_{suffix}" for suffix in SUMMARY_SUFFIXES]
        if c in texts:
            found = [F.get(f"__f_{c}", F.lit(i)) for i in range(len(names))]
            found = [v.cast("int") if n.endswith("len_max") else v for n, v in zip(names, found)]
            slow = [F.when(F.col(f"__f_{c}").isNotNull(), v).otherwise(w).alias(n) for n, v, w in zip(names, found, slow)]
        out.extend(slow)
    return step.select(*[k for k in keep if k not in {f"__f_{c}" for c in texts}], *out)


def explode_channels(df: DataFrame, parsed_col: str, key: str, out: str = "channel") -> DataFrame:
    """One row per channel, keeping rows with no channel (NULL channel)."""
    return df.select(F.col(key), F.posexplode_outer(parsed_col).alias("ch_pos", out))


def summarize_exploded(df: DataFrame, parsed_col: str, key: str, prefix: str) -> DataFrame:
    """Test form of A12: explode channels, then ``groupBy(key)`` averages.

    Needs a unique ``key``; the main path (``summarize_series``) needs none.
    """
    ex = explode_channels(df, parsed_col, key)
    s = channel_stats(F.col("channel"))
    ex = ex.select(key, s.alias("s"))
    aggs = []
    for suffix in SUMMARY_SUFFIXES:
        stat, how = suffix.rsplit("_", 1)
        src = F.col(f"s.{stat}")
        aggs.append((F.max(src) if how == "max" else F.avg(src)).alias(f"{prefix}_{suffix}"))
    return ex.groupBy(key).agg(*aggs)


def summarize_rows(df: DataFrame, key: str, value: str, order: list[str], prefix: str) -> DataFrame:
    """A12 on a series stored as rows (one row per item, ``order`` inside a
    key): the same ten statistics as one aggregate per key.

    Unlike collecting the items into an array, every aggregate here is
    map-side combined (``min_by``/``max_by`` included), so a key that holds a
    third of all rows never lands whole on one task."""
    x = F.col(value).cast("double")
    pos = F.struct(*[F.col(c) for c in order])
    n = F.count(x)
    first = F.min_by(x, pos)
    last = F.max_by(x, pos)
    std = F.when(n > 1, F.stddev_samp(x)).otherwise(F.lit(0.0))
    return df.groupBy(key).agg(
        n.cast("double").alias(f"{prefix}_len_mean"),
        n.cast("int").alias(f"{prefix}_len_max"),
        F.min(x).alias(f"{prefix}_min_mean"),
        F.max(x).alias(f"{prefix}_max_mean"),
        (F.sum(x) / F.when(n > 0, n).otherwise(F.lit(1.0))).alias(f"{prefix}_mean_mean"),
        std.alias(f"{prefix}_std_mean"),
        first.alias(f"{prefix}_first_mean"),
        last.alias(f"{prefix}_last_mean"),
        F.sum(x).alias(f"{prefix}_sum_mean"),
        (last - first).alias(f"{prefix}_slope_mean"),
    )
