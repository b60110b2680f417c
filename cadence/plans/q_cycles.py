"""Queries for the cycle operators: P1/P2, W1-W4, J2, P6, P7, G2-G6, G11."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadence.functions.timeparse import DEFAULT_FORMATS, keep_parsed, parse_timestamp
from cadence.operators.cycles import next_row, strict_next_cycle
from cadence.operators.sequences import previous_target
from cadence.operators.splits import (assign_time_split, split_counts, split_target_summary,
                                      time_quantiles)
from cadence.operators.stats import target_stats, train_mean
from cadence.plans.etl import build_feature_table
from cadence.plans.oracle import EVENTS_CT, EVENTS_SPLIT, GAP, ORDER_KEY, ts_text, with_ctes
from cadence.plans.registry import query, ts_text as sts
from cadence.plans.views import EVENTS_ROLES, cycles_events, table

R = EVENTS_ROLES


def events_features(spark, sf_dir):
    return build_feature_table(cycles_events(spark, sf_dir), R, max_gap=300)


def events_split(spark, sf_dir):
    return assign_time_split(cycles_events(spark, sf_dir), "C")


def text_time(ts="ts", key="event_id", kind="event_type"):
    """The time written as text in one of the six layouts (chosen by the row
    key), with an unparsable prefix on 'error' rows."""
    idx = F.pmod(F.col(key), F.lit(len(DEFAULT_FORMATS)))
    text = F.coalesce(*[F.when(idx == i, F.date_format(ts, f)) for i, f in enumerate(DEFAULT_FORMATS)])
    return F.when(F.col(kind) == "error", F.concat(F.lit("?"), text)).otherwise(text)


def events_text_time(spark, sf_dir):
    """events with the time as text (see ``text_time``)."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "event_type", text_time().alias("ts_text"))


_EXPECTED_TS = ("CASE WHEN event_type = 'error' THEN NULL ELSE "
                "CASE WHEN event_id % 6 < 2 THEN date_trunc('minute', ts) ELSE date_trunc('second', ts) END END")


@query("P1_parse_timestamp", f"SELECT event_id, {ts_text(_EXPECTED_TS)} AS parsed FROM events")
def p1_parse_timestamp(spark, sf_dir):
    t = events_text_time(spark, sf_dir)
    return t.select("event_id", sts(parse_timestamp("ts_text")).alias("parsed"))


@query("P2_keep_parsed", "SELECT event_type AS D, count(*) AS n FROM events "
       "WHERE event_type <> 'error' GROUP BY event_type")
def p2_keep_parsed(spark, sf_dir):
    t = events_text_time(spark, sf_dir).withColumn("C", parse_timestamp("ts_text"))
    return keep_parsed(t, "C").groupBy(F.col("event_type").alias("D")).agg(F.count(F.lit(1)).alias("n"))


@query("G2_time_quantiles", with_ctes(EVENTS_SPLIT) +
       f"SELECT {ts_text('q1')} AS q70, {ts_text('q2')} AS q85 FROM q")
def g2_time_quantiles(spark, sf_dir):
    q = time_quantiles(cycles_events(spark, sf_dir), "C")
    return q.select(sts(F.col("_q")[0]).alias("q70"), sts(F.col("_q")[1]).alias("q85"))


@query("G3_time_split", with_ctes(EVENTS_SPLIT) + "SELECT B, split FROM s")
def g3_time_split(spark, sf_dir):
    return events_split(spark, sf_dir).select("B", "split")


_LEAD_GLOBAL = with_ctes(EVENTS_SPLIT, f"""
l AS (SELECT *, lead(C) OVER w AS next_ts, lead(B) OVER w AS next_b FROM s
      WINDOW w AS (ORDER BY {ORDER_KEY}, floor(epoch(C)), A))""")


@query("W1_global_lead", _LEAD_GLOBAL + f"SELECT B, {ts_text('next_ts')} AS next_ts, "
       f"CASE WHEN next_ts IS NOT NULL THEN {GAP} END AS gap FROM l", doubles=("gap",))
def w1_global_lead(spark, sf_dir):
    out = next_row(events_split(spark, sf_dir), R, per_stream=False)
    return out.select("B", sts("next_ts").alias("next_ts"), F.col("CycleTime_sec").alias("gap"))


@query("W2_stream_lead", with_ctes(EVENTS_SPLIT, f"""
l AS (SELECT *, lead(C) OVER (PARTITION BY A ORDER BY {ORDER_KEY}) AS next_ts FROM s)""") +
       f"SELECT A, B, {ts_text('next_ts')} AS next_ts, "
       f"CASE WHEN next_ts IS NOT NULL THEN {GAP} END AS gap FROM l", doubles=("gap",))
def w2_stream_lead(spark, sf_dir):
    out = next_row(events_split(spark, sf_dir), R, per_stream=True)
    return out.select("A", "B", sts("next_ts").alias("next_ts"), F.col("CycleTime_sec").alias("gap"))


_STRICT = (f"CASE WHEN B IS NOT NULL AND next_b IS NOT NULL AND next_b - B = 1 "
           f"AND next_ts IS NOT NULL THEN {GAP} END")


@query("W3_strict_gap", _LEAD_GLOBAL + f"SELECT B, {_STRICT} AS gap FROM l", doubles=("gap",))
def w3_strict_gap(spark, sf_dir):
    out = next_row(events_split(spark, sf_dir), R, per_stream=False, strict=True)
    return out.select("B", F.col("CycleTime_sec").alias("gap"))


_CAPPED = f"CASE WHEN ({_STRICT}) > 0 AND ({_STRICT}) <= 300 THEN {_STRICT} END"


@query("P6_gap_cap", _LEAD_GLOBAL + f"SELECT B, {_CAPPED} AS CycleTime_sec FROM l",
       doubles=("CycleTime_sec",))
def p6_gap_cap(spark, sf_dir):
    out = next_row(events_split(spark, sf_dir), R, per_stream=False, strict=True, max_gap=300)
    return out.select("B", "CycleTime_sec")


@query("P7_drop_missing", _LEAD_GLOBAL + f"SELECT B, split, {_CAPPED} AS CycleTime_sec FROM l "
       f"WHERE ({_CAPPED}) IS NOT NULL", doubles=("CycleTime_sec",))
def p7_drop_missing(spark, sf_dir):
    out = next_row(events_split(spark, sf_dir), R, per_stream=False, strict=True, max_gap=300,
                   drop_missing=True)
    return out.select("B", "split", "CycleTime_sec")


@query("J2_next_cycle_join", with_ctes(EVENTS_CT) +
       f"SELECT A, B, D, split, {ts_text('next_ts')} AS next_ts, CycleTime_sec FROM feat",
       doubles=("CycleTime_sec",))
def j2_next_cycle_join(spark, sf_dir):
    out = strict_next_cycle(events_split(spark, sf_dir), R, max_gap=300)
    return out.select("A", "B", "D", "split", sts("next_ts").alias("next_ts"), "CycleTime_sec")


@query("G4_split_summary", with_ctes(EVENTS_CT) + """
SELECT split, avg(CycleTime_sec) AS avg_cycle, count(*) AS n FROM feat GROUP BY split
""", doubles=("avg_cycle",))
def g4_split_summary(spark, sf_dir):
    """Minimum slice: events -> time split -> strict gap -> per-split summary."""
    return split_target_summary(events_features(spark, sf_dir))


@query("G5_split_counts", _LEAD_GLOBAL + f"SELECT split, count(*) AS rows, "
       f"count({_CAPPED}) AS targets FROM l GROUP BY split")
def g5_split_counts(spark, sf_dir):
    out = next_row(events_split(spark, sf_dir), R, per_stream=False, strict=True, max_gap=300)
    return split_counts(out)


@query("G6_target_stats", with_ctes(EVENTS_CT) +
       "SELECT count(*) AS rows, max(CycleTime_sec) AS max_target FROM feat",
       doubles=("max_target",))
def g6_target_stats(spark, sf_dir):
    return target_stats(events_features(spark, sf_dir))


@query("G11_train_mean", with_ctes(EVENTS_CT) +
       "SELECT avg(CycleTime_sec) AS train_mean FROM feat WHERE split = 'train'",
       doubles=("train_mean",))
def g11_train_mean(spark, sf_dir):
    return train_mean(events_features(spark, sf_dir))


@query("W4_prev_target", with_ctes(EVENTS_CT, """
p AS (SELECT *, lag(CycleTime_sec) OVER (PARTITION BY split ORDER BY C, A, B) AS prev_ct FROM feat)""") +
       "SELECT B, split, prev_ct, CycleTime_sec FROM p WHERE prev_ct IS NOT NULL",
       doubles=("prev_ct", "CycleTime_sec"))
def w4_prev_target(spark, sf_dir):
    f = events_features(spark, sf_dir)
    out = previous_target(f, R.order(), partition=["split"], drop_missing=["value"])
    return out.select("B", "split", "prev_ct", "CycleTime_sec")
