"""The ETL entry point (reference ``make etl``) as one DataFrame function.

raw -> P1 parse time -> P2 keep parsed -> A12 series summary (per row, before
any shuffle, so later shuffles carry 10 doubles per series instead of text)
-> G3 time split -> W1/W3/J2 strict gap + P6 cap + P7 filter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from cadence.functions.arrays import summarize_series_columns
from cadence.functions.timeparse import keep_parsed, to_wall_clock
from cadence.operators.cycles import next_row, strict_next_cycle
from cadence.operators.splits import assign_time_split
from cadence.roles import ColumnRoles


def build_raw_table(raw: DataFrame, roles: ColumnRoles, fractions=(0.70, 0.85),
                    accuracy: int | None = None, null_len: str = "null",
                    parse_series: bool = True, times: DataFrame | None = None) -> DataFrame:
    """Parsed time (P1/P2), per-row series summary (A12) and time split (G3),
    before any target: the reference's raw table.

    ``times``: the raw rows without what was joined to them, when the series come
    from a join.  The split's two passes over the times then leave the join out
    (it must neither drop nor repeat rows)."""
    parsed = lambda rows: keep_parsed(to_wall_clock(rows, roles.time), roles.time)
    df = parsed(raw)
    if roles.series:
        df = summarize_series_columns(df, list(roles.series), parse=parse_series, null_len=null_len)
    narrow = None if times is None else parsed(times.select(roles.time))
    return assign_time_split(df, roles.time, fractions, accuracy, times=narrow)


def add_target(df: DataFrame, roles: ColumnRoles, rule: str = "strict",
               max_gap: float | None = 300) -> DataFrame:
    """The gap to the next cycle by ``rule`` (see ``build_feature_table``)."""
    if rule == "strict":
        return strict_next_cycle(df, roles, max_gap)
    if rule == "per_stream":
        return next_row(df, roles, per_stream=True, max_gap=max_gap).drop("_rn")
    if rule == "global":
        return next_row(df, roles, per_stream=False, max_gap=max_gap, drop_missing=True).drop("_rn")
    raise ValueError(f"unknown rule {rule!r}")


def build_feature_table(raw: DataFrame, roles: ColumnRoles, max_gap: float | None = 300,
                        fractions=(0.70, 0.85), accuracy: int | None = None,
                        rule: str = "strict", null_len: str = "null",
                        parse_series: bool = True) -> DataFrame:
    """``rule``: ``strict`` (current ETL: global order, next cycle = +1,
    rows without a valid target dropped), ``per_stream`` (first ETL: lead
    within the stream, no sequence rule, NULL targets kept) or ``global``
    (lead in global order, no rule, rows without target dropped).  The cap
    ``max_gap`` applies to every rule; ``None`` keeps every gap (the first
    ETL had no cap)."""
    base = build_raw_table(raw, roles, fractions, accuracy, null_len, parse_series)
    return add_target(base, roles, rule, max_gap)
