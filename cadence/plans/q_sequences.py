"""Queries for sequence windows and latest rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadence.operators.rowindex import with_row_index
from cadence.operators.sequences import (last_n_per_stream, last_step, latest_rows,
                                         order_number, scoring_window, template_row, windows,
                                         windows_with_fallback)
from cadence.operators.stats import stream_sizes
from cadence.plans.oracle import EVENTS_CT, ts_text, with_ctes
from cadence.plans.q_cycles import events_features
from cadence.plans.registry import query, ts_text as sts
from cadence.plans.views import EVENTS_ROLES, streams_conv

R = EVENTS_ROLES
L = 5
ORDER = ["C", "A", "B"]


def _summ(win):
    """Window rows -> (sum, oldest, newest) of the single feature."""
    vals = F.transform("X", lambda r: r[0])
    return [F.size("X").alias("n"),
            F.aggregate(vals, F.lit(0.0), lambda a, v: a + v).alias("x_sum"),
            F.element_at(vals, 1).alias("x_first"), F.element_at(vals, -1).alias("x_last")]


def _win_sql(frame: str, partition: str = "", src: str = "feat", target: str = "CycleTime_sec",
             keys: str = "B, split", n: int = L) -> str:
    part = f"PARTITION BY {partition} " if partition else ""
    return (f"w AS (SELECT {keys}, {target} AS y, CAST(count(*) OVER ww AS INTEGER) AS n, sum(value) OVER ww AS x_sum, "
            f"first_value(value) OVER ww AS x_first, last_value(value) OVER ww AS x_last FROM {src} "
            f"WINDOW ww AS ({part}ORDER BY C, A, B ROWS BETWEEN {frame}))")


_D = ("x_sum", "x_first", "x_last", "y")


@query("W5_windows_inside", with_ctes(EVENTS_CT, _win_sql(f"{L - 1} PRECEDING AND CURRENT ROW")) +
       f"SELECT B, split, n, x_sum, x_first, x_last, y FROM w WHERE n = {L}", doubles=_D)
def w5_windows_inside(spark, sf_dir):
    f = events_features(spark, sf_dir)
    win = windows(f, ["value"], L, ORDER, target_inside=True, meta=["B", "split"])
    return win.select("B", "split", *_summ(win), "y")


@query("W6_windows_next", with_ctes(EVENTS_CT, _win_sql(f"{L} PRECEDING AND 1 PRECEDING")) +
       f"SELECT B, split, n, x_sum, x_first, x_last, y FROM w WHERE n = {L}", doubles=_D)
def w6_windows_next(spark, sf_dir):
    f = events_features(spark, sf_dir)
    win = windows(f, ["value"], L, ORDER, target_inside=False, meta=["B", "split"])
    return win.select("B", "split", *_summ(win), "y")


@query("W7_stream_windows", with_ctes(EVENTS_CT, _win_sql(f"{L} PRECEDING AND 1 PRECEDING", "A",
                                                            keys="A, B")) +
       f"SELECT A, B, n, x_sum, x_first, x_last, y FROM w WHERE n = {L}", doubles=_D)
def w7_stream_windows(spark, sf_dir):
    f = events_features(spark, sf_dir)
    win = windows(f, ["value"], L, ORDER, target_inside=False, meta=["A", "B"], partition=["A"])
    return win.select("A", "B", *_summ(win), "y")


@query("W11_split_windows", with_ctes(EVENTS_CT, _win_sql(f"{L - 1} PRECEDING AND CURRENT ROW", "split")) +
       f"SELECT B, split, n, x_sum, x_first, x_last, y FROM w WHERE n = {L}", doubles=_D)
def w11_split_windows(spark, sf_dir):
    f = events_features(spark, sf_dir)
    win = windows(f, ["value"], L, ORDER, target_inside=True, meta=["B", "split"], partition=["split"])
    return win.select("B", "split", *_summ(win), "y")


_CONV = """
c AS (SELECT conv_id AS A, turn AS B, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(turn AS INTEGER)) AS C,
             role AS D, CAST(length(text) AS DOUBLE) AS value FROM conversations),
m AS (SELECT max(cnt) AS mx FROM (SELECT count(*) AS cnt FROM c GROUP BY A))
"""
W8_LEN = 10


@query("W8_windows_fallback", with_ctes(
    _CONV,
    _win_sql(f"{W8_LEN} PRECEDING AND 1 PRECEDING", src="c", target="value", keys="A, B", n=W8_LEN),
    _win_sql(f"{W8_LEN} PRECEDING AND 1 PRECEDING", "A", src="c", target="value", keys="A, B",
             n=W8_LEN).replace("w AS", "ws AS", 1)) +
    f"SELECT A, B, n, x_sum, x_first, x_last, y FROM w WHERE n = {W8_LEN} AND (SELECT mx FROM m) < {W8_LEN + 1} "
    f"UNION ALL SELECT A, B, n, x_sum, x_first, x_last, y FROM ws WHERE n = {W8_LEN} "
    f"AND (SELECT mx FROM m) >= {W8_LEN + 1}", doubles=_D)
def w8_windows_fallback(spark, sf_dir):
    c = streams_conv(spark, sf_dir)
    win = windows_with_fallback(c, ["value"], W8_LEN, ORDER, "A", meta=["A", "B"], target="value")
    return win.select("A", "B", *_summ(win), "y")


@query("W8_windows_streams", with_ctes(
    _CONV, _win_sql("2 PRECEDING AND 1 PRECEDING", "A", src="c", target="value", keys="A, B", n=2)) +
    "SELECT A, B, n, x_sum, x_first, x_last, y FROM w WHERE n = 2 AND (SELECT mx FROM m) >= 3", doubles=_D)
def w8_windows_streams(spark, sf_dir):
    """The per-stream branch: conversations are longer than the window."""
    c = streams_conv(spark, sf_dir)
    win = windows_with_fallback(c, ["value"], 2, ORDER, "A", meta=["A", "B"], target="value")
    return win.select("A", "B", *_summ(win), "y")


@query("W9_last_step", with_ctes(EVENTS_CT, _win_sql(f"{L} PRECEDING AND 1 PRECEDING")) +
       f"SELECT B, x_last FROM w WHERE n = {L}", doubles=("x_last",))
def w9_last_step(spark, sf_dir):
    f = events_features(spark, sf_dir)
    win = last_step(f, ["value"], L, ORDER, target_inside=False, meta=["B"], target=None)
    return win.select("B", F.col("value").alias("x_last"))


@query("W9_last_step_streams", with_ctes(EVENTS_CT, _win_sql(f"{L} PRECEDING AND 1 PRECEDING", "A", keys="A, B")) +
       f"SELECT A, B, x_last, y FROM w WHERE n = {L}", doubles=("x_last", "y"))
def w9_last_step_streams(spark, sf_dir):
    f = events_features(spark, sf_dir)
    win = last_step(f, ["value"], L, ORDER, target_inside=False, meta=["A", "B"], partition=["A"])
    return win.select("A", "B", F.col("value").alias("x_last"), "y")


@query("W10_order_number", with_ctes(EVENTS_CT) +
       "SELECT A, B, row_number() OVER (PARTITION BY A ORDER BY C, B) - 1 AS order_no FROM feat")
def w10_order_number(spark, sf_dir):
    f = events_features(spark, sf_dir)
    return order_number(f, ["C", "B"], stream="A").select("A", "B", "order_no")


@query("W10_global_number", with_ctes(EVENTS_CT) +
       "SELECT A, B, row_number() OVER (ORDER BY C, A, B) - 1 AS order_no FROM feat")
def w10_global_number(spark, sf_dir):
    return order_number(events_features(spark, sf_dir), ORDER).select("A", "B", "order_no")


@query("O1_sorted_rows", with_ctes(EVENTS_CT) +
       "SELECT B, row_number() OVER (ORDER BY floor(epoch(C)), B, A) - 1 AS pos FROM feat")
def o1_sorted_rows(spark, sf_dir):
    """Deterministic sort (epoch seconds, cycle, id) as a dense position."""
    from cadence.functions.timeparse import epoch_seconds
    f = events_features(spark, sf_dir)
    ix = with_row_index(f, [epoch_seconds("C"), F.col("B"), F.col("A")], name="pos")
    return ix.select("B", "pos")


@query("O2_first5_by_cycle", with_ctes(EVENTS_CT) +
       f"SELECT A, B, {ts_text('C')} AS C, split FROM feat ORDER BY B, A, C LIMIT 5")
def o2_first5_by_cycle(spark, sf_dir):
    f = events_features(spark, sf_dir)
    return f.orderBy("B", "A", "C").limit(5).select("A", "B", sts("C").alias("C"), "split")


@query("O4_latest_rows", with_ctes(EVENTS_CT) +
       f"SELECT B, {ts_text('C')} AS C FROM feat WHERE split = 'test' ORDER BY C DESC, A DESC, B DESC LIMIT 5")
def o4_latest_rows(spark, sf_dir):
    f = events_features(spark, sf_dir)
    return latest_rows(f, ORDER, 5).select("B", sts("C").alias("C"))


@query("O5_template_row", with_ctes(EVENTS_CT) +
       f"SELECT A, B, {ts_text('C')} AS C, D, value FROM feat WHERE split = 'test' "
       "ORDER BY C DESC, A DESC, B DESC LIMIT 1", doubles=("value",))
def o5_template_row(spark, sf_dir):
    f = events_features(spark, sf_dir)
    t = template_row(f, ORDER)
    return t.select("A", "B", sts("C").alias("C"), "D", "value")


@query("O5_template_fallback", with_ctes(EVENTS_CT) +
       f"SELECT A, B, {ts_text('C')} AS C, D, value FROM feat WHERE split <> 'test' "
       "ORDER BY C DESC, A DESC, B DESC LIMIT 1", doubles=("value",))
def o5_template_fallback(spark, sf_dir):
    """A table without test rows: the latest row overall."""
    t = template_row(events_features(spark, sf_dir).filter(F.col("split") != "test"), ORDER)
    return t.select("A", "B", sts("C").alias("C"), "D", "value")


@query("O6_scoring_window", with_ctes(EVENTS_CT, """
t AS (SELECT * FROM feat WHERE split = 'test' ORDER BY C DESC, A DESC, B DESC LIMIT 5)""") +
       "SELECT CAST(count(*) AS INTEGER) AS n, sum(value) AS x_sum, arg_min(value, (C, A, B)) AS x_first, "
       "arg_max(value, (C, A, B)) AS x_last, arg_max(B, (C, A, B)) AS B FROM t",
       doubles=("x_sum", "x_first", "x_last"))
def o6_scoring_window(spark, sf_dir):
    f = events_features(spark, sf_dir)
    w = scoring_window(f, ["value"], 5, ORDER, keys=("B",))
    return w.select(*_summ(w), "B")


@query("O6_stream_last_rows", with_ctes(EVENTS_CT) +
       "SELECT A, B FROM (SELECT A, B, row_number() OVER (PARTITION BY A ORDER BY C DESC, B DESC) AS r "
       "FROM feat) WHERE r <= 5")
def o6_stream_last_rows(spark, sf_dir):
    f = events_features(spark, sf_dir)
    return last_n_per_stream(f, "A", ["C", "B"], 5).select("A", "B")


@query("G10_stream_sizes", with_ctes(EVENTS_CT) +
       "SELECT A, count(*) AS rows FROM feat GROUP BY A HAVING count(*) >= 11")
def g10_stream_sizes(spark, sf_dir):
    return stream_sizes(events_features(spark, sf_dir), "A", 10)


@query("G10_top_streams", with_ctes(EVENTS_CT) +
       "SELECT A, count(*) AS rows FROM feat GROUP BY A HAVING count(*) >= 6 ORDER BY rows DESC, A LIMIT 15")
def g10_top_streams(spark, sf_dir):
    """The listing of the largest streams."""
    return stream_sizes(events_features(spark, sf_dir), "A", 5, top=15)
