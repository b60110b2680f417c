"""Previous target, sequence windows, latest rows.

All windows come from ``rowindex``: a distributed dense position over
``partition columns + order`` and window functions inside blocks of positions,
never an unpartitioned ``Window`` and never one task per stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.operators.rowindex import RN, last_steps, neighbour, sliding_windows, with_row_index
from cadence.roles import SPLIT, TARGET, ColumnRoles


def previous_target(df: DataFrame, order: list[str], partition: list[str] | None = None,
                    target: str = TARGET, name: str = "prev_ct",
                    drop_missing: list[str] | None = None) -> DataFrame:
    """Previous row's target as a feature (``shift(1)`` inside each
    partition, e.g. the split), then rows with a NULL in ``drop_missing``
    are dropped (the reference drops NULLs over features + target)."""
    partition = partition or []
    ix = with_row_index(df, [*partition, *order])
    out = neighbour(ix, [target], offset=-1, prefix="_p_", same=partition)
    out = out.withColumnRenamed(f"_p_{target}", name).drop(RN)
    if drop_missing is not None:
        out = out.dropna(subset=list(dict.fromkeys(drop_missing + [name, target])))
    return out


def windows(df: DataFrame, features: list[str], length: int, order: list[str], *,
            target_inside: bool, meta: list[str], partition: list[str] | None = None,
            target: str | None = TARGET) -> DataFrame:
    """W5 (``target_inside=True``), W6 (next step, global), W7 (per stream:
    ``partition=[stream]``), W11 (per split: ``partition=[split]``)."""
    ix = window_index(df, features, order, meta, partition, target)
    return sliding_windows(ix, features, length, target_inside=target_inside,
                           meta=meta, target=target, same=partition)


def window_index(df: DataFrame, features: list[str], order: list[str], meta: list[str],
                 partition: list[str] | None = None, target: str | None = TARGET) -> DataFrame:
    """The row index that windows are cut from: numbered (and checkpointed) once, with only the
    columns the windows use.  Cell statistics come from it too, row by row."""
    partition = partition or []
    needed = [*partition, *order, *features, *meta, *([target] if target else [])]
    return with_row_index(df.select(*dict.fromkeys(needed)), [*partition, *order])


def windows_with_fallback(df: DataFrame, features: list[str], length: int, order: list[str],
                          stream: str, meta: list[str], target: str | None = TARGET) -> DataFrame:
    """Per-stream windows when some stream has ``length + 1`` rows,
    otherwise global windows.  The choice is one small aggregate."""
    longest = df.groupBy(stream).count().agg(F.max("count")).first()[0] or 0
    part = [stream] if longest >= length + 1 else []
    return windows(df, features, length, order, target_inside=False, meta=meta,
                   partition=part, target=target)


def last_step(df: DataFrame, features: list[str], length: int, order: list[str], *,
              target_inside: bool, meta: list[str], partition: list[str] | None = None,
              target: str | None = TARGET) -> DataFrame:
    """The last timestep of each window (``X[:, -1, :]``) as columns, by a rule on positions:
    no window is built."""
    ix = window_index(df, features, order, meta, partition, target)
    return last_steps(ix, features, length, target_inside=target_inside, meta=meta, target=target,
                      same=partition)


def order_number(df: DataFrame, order: list[str], stream: str | None = None,
                 name: str = "order_no") -> DataFrame:
    """0-based position in ``order``, per stream or global."""
    if stream is None:
        return with_row_index(df, order, name=name)
    from cadence.operators.rowindex import with_stream_index
    return with_stream_index(df, [stream], order, name=name).drop(RN)


def latest_rows(df: DataFrame, order: list[str], n: int = 5, split: str | None = SPLIT,
                split_value: str = "test") -> DataFrame:
    """The ``n`` latest rows of one split (of all rows when the table has
    no split column).  Top-k per partition, then a merge of k rows each."""
    src = df.filter(F.col(split) == split_value) if (split and split in df.columns) else df
    return src.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def template_row(df: DataFrame, order: list[str], split: str = SPLIT,
                 drop: tuple[str, ...] = (TARGET, "next_ts", SPLIT)) -> DataFrame:
    """The latest test row, or the latest row overall when there is no
    test row, with target, next time and split dropped."""
    test = latest_rows(df, order, 1, split, "test")
    anyrow = latest_rows(df, order, 1, None)
    pick = test.withColumn("_pref", F.lit(0)).unionByName(anyrow.withColumn("_pref", F.lit(1)))
    best = pick.orderBy("_pref").limit(1).drop("_pref")
    low = {d.lower() for d in drop}
    return best.select(*[c for c in best.columns if c.lower() not in low])


def scoring_window(df: DataFrame, features: list[str], length: int, order: list[str],
                   split: str = SPLIT, keys: tuple[str, ...] = ()) -> DataFrame:
    """O6 (global): the last ``length`` rows (of the test split, or of all rows
    when the test split has fewer) as one window row, oldest first."""
    has_split = split in df.columns
    test = df.filter(F.col(split) == "test") if has_split else df
    n_test = test.count() if has_split else length
    src = test if n_test >= length else df
    last = src.orderBy(*[F.col(c).desc() for c in order]).limit(length)
    rec = F.struct(*[F.col(c) for c in order],
                   F.array(*[F.col(c).cast("double") for c in features]).alias("_x"),
                   *[F.col(k) for k in keys if k not in order])
    return (last.agg(F.sort_array(F.collect_list(rec)).alias("_w"))
                .select(F.transform("_w", lambda r: r["_x"]).alias("X"),
                        F.element_at("_w", -1).alias("_last"))
                .select("X", *[F.col(f"_last.{k}").alias(k) for k in keys]))


def last_n_per_stream(df: DataFrame, stream: str, order: list[str], n: int) -> DataFrame:
    """O6 (per stream): the last ``n`` rows of every stream, NULL stream
    included: the first ``n`` positions of the stream in descending order (no
    window over a hot stream)."""
    from cadence.operators.rowindex import with_stream_index
    ix = with_stream_index(df, [stream], [F.col(c).desc() for c in order], name="_srn")
    return ix.filter(F.col("_srn") < n).drop("_srn", RN)
