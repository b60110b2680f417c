"""The gap to the next cycle as a target.

The reference takes ``lead`` over a window with no partition (one task for all
rows).  Two exact replacements:

* strict rule (``next cycle == cycle + 1``), the current ETL: per order key
  only the *last* row of a key can have a valid gap, and its next row is the
  *first* row of key + 1.  So: one aggregate per key (``max``/``min`` of a
  struct, map-side combined, a hot key costs nothing) and an equi-join on
  ``key + 1`` (J2).  No single task, no global sort.
* no rule (older ETLs): the dense position of ``rowindex`` and a lead inside
  blocks of positions, globally or within each stream (W1/W2).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.functions.timeparse import epoch_seconds
from cadence.operators.rowindex import RN, neighbour, row_hash, with_row_index
from cadence.roles import NEXT_TS, TARGET, ColumnRoles


def order_key(roles: ColumnRoles) -> Column:
    """Cycle number as long, or epoch seconds of the time when it is NULL."""
    tsl = epoch_seconds(roles.time)
    if roles.cycle is None:
        return tsl
    return F.coalesce(F.col(roles.cycle).cast("long"), tsl)


def whole_second_gap(ts: Column | str, next_ts: Column | str) -> Column:
    """Difference of whole epoch seconds (each floored first), as double."""
    return (epoch_seconds(next_ts) - epoch_seconds(ts)).cast("double")


def cap_gap(gap: Column, max_gap: float | None) -> Column:
    """Keep 0 < gap <= max_gap, else NULL (no cap: keep as is)."""
    if max_gap is None:
        return gap
    return F.when((gap > 0) & (gap <= F.lit(float(max_gap))), gap).cast("double")


def strict_next_cycle(df: DataFrame, roles: ColumnRoles, max_gap: float | None = 300) -> DataFrame:
    """W1+W3+J2+P6(+P7): rows whose next row in the global order
    (order key, whole seconds, stream id) has cycle number + 1.

    Adds ``next_ts`` and ``CycleTime_sec``; as the reference ETL, only rows
    with a valid, capped target are returned (``next_row`` keeps all rows).
    """
    if roles.cycle is None:
        raise ValueError("the strict rule needs a cycle column")
    cols = df.columns
    df = df.filter(F.col(roles.time).isNotNull())  # P2: a row without time has no place in the order
    tsl = epoch_seconds(roles.time)
    sid = F.col(roles.stream) if roles.stream else F.lit(None).cast("string")
    keyed = df.select(order_key(roles).alias("_key"), tsl.alias("_tsl"), sid.alias("_sid"),
                      row_hash(df).alias("_h"), *cols)
    # order inside a key: whole seconds, stream id, then a hash of the whole row
    rec = F.struct("_tsl", "_sid", "_h", *[F.col(c) for c in cols])
    last = keyed.groupBy("_key").agg(F.max(rec).alias("last"))
    # the first row of key + 1 needs five narrow columns only
    head = F.struct(tsl.alias("_tsl"), sid.alias("_sid"), F.col(roles.time).alias("_t"),
                    F.col(roles.cycle).cast("long").alias("_c"))
    first = (df.select((order_key(roles) - 1).alias("_key"), head.alias("_head"))
               .groupBy("_key").agg(F.min("_head").alias("nf")))
    per_key = last.join(first, "_key", "left")
    valid = (F.col(f"last.{roles.cycle}").isNotNull() & F.col("nf._c").isNotNull()
             & ((F.col("nf._c") - F.col(f"last.{roles.cycle}").cast("long")) == 1))
    gap = F.when(valid, whole_second_gap(F.col(f"last.{roles.time}"), F.col("nf._t")))
    out = (per_key.select(*[F.col(f"last.{c}").alias(c) for c in cols],
                          F.col("nf._t").alias(NEXT_TS),
                          cap_gap(gap, max_gap).alias(TARGET)))
    return out.filter(F.col(TARGET).isNotNull())


def next_row(df: DataFrame, roles: ColumnRoles, per_stream: bool,
             strict: bool = False, max_gap: float | None = None,
             drop_missing: bool = False) -> DataFrame:
    """W1/W2 (+W3, P6, P7): every row with the time of the next row.

    ``per_stream=True``: next row within the stream (``partitionBy(id)``),
    ordered by the order key (the first ETL); otherwise global order by
    (order key, whole seconds, stream id).
    """
    streams = [roles.stream] if (per_stream and roles.stream) else []
    key = order_key(roles).alias("_key")
    tsl = epoch_seconds(roles.time).alias("_tsl")
    base = df.select("*", key, tsl)
    order = [*streams, "_key"] + ([] if streams else ["_tsl"] + ([roles.stream] if roles.stream else []))
    ix = with_row_index(base, order)
    carry = [roles.time] + ([roles.cycle] if roles.cycle else [])
    nb = neighbour(ix, carry, offset=1, prefix="_n_", same=streams)
    gap = whole_second_gap(F.col(roles.time), F.col(f"_n_{roles.time}"))
    gap = F.when(F.col(f"_n_{roles.time}").isNotNull(), gap)
    if strict and roles.cycle:
        c = F.col(roles.cycle).cast("long")
        nc = F.col(f"_n_{roles.cycle}").cast("long")
        gap = F.when(c.isNotNull() & nc.isNotNull() & ((nc - c) == 1), gap)
    out = nb.select(*df.columns, F.col(f"_n_{roles.time}").alias(NEXT_TS),
                    cap_gap(gap, max_gap).alias(TARGET), F.col(RN))
    if drop_missing:
        out = drop_missing_target(out)
    return out


def drop_missing_target(df: DataFrame, target: str = TARGET) -> DataFrame:
    """P7."""
    return df.dropna(subset=[target])
