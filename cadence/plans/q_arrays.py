"""Queries for the array operators A1-A12 and G1 (embeddings as a 4-channel
series written as JSON text; lineitem as per-order series rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadence.functions import arrays as A
from cadence.plans.oracle import with_ctes
from cadence.plans.registry import query
from cadence.plans.views import order_lines, series_embed_text, table

# DuckDB: the four 16-value channels of each embedding, as doubles
_CH = """
ch AS (SELECT vec_id, CAST(i AS INTEGER) AS ch,
              CAST(embedding[16 * i + 1 : 16 * i + 16] AS DOUBLE[]) AS x
       FROM embeddings CROSS JOIN range(4) AS t(i))
"""
_STATS = {
    "len": "CAST(len(x) AS INTEGER)",
    "min": "list_min(x)",
    "max": "list_max(x)",
    "mean": "list_sum(x) / len(x)",
    "std": "CASE WHEN len(x) > 1 THEN list_aggregate(x, 'stddev_samp') ELSE 0.0 END",
    "first": "x[1]",
    "last": "x[-1]",
    "sum": "list_sum(x)",
    "slope": "x[-1] - x[1]",
}
_IDS = {"len": "A2", "min": "A3", "max": "A4", "mean": "A5", "std": "A6", "first": "A7",
        "last": "A8", "sum": "A9", "slope": "A10"}


def _parsed(spark, sf_dir):
    t = series_embed_text(spark, sf_dir)
    return t.select("vec_id", A.parse_series("E").alias("P"))


def _channels(spark, sf_dir):
    p = _parsed(spark, sf_dir)
    return p.select("vec_id", F.posexplode_outer("P").alias("ch", "x"))


@query("A1_parse_series", "SELECT vec_id, CAST(4 AS INTEGER) AS n_channels, CAST(len(embedding) AS INTEGER) "
       "AS n_items, list_sum(CAST(embedding AS DOUBLE[])) AS total FROM embeddings",
       doubles=("total",))
def a1_parse_series(spark, sf_dir):
    p = _parsed(spark, sf_dir)
    flat = F.flatten("P")
    return p.select("vec_id", F.size("P").alias("n_channels"), F.size(flat).alias("n_items"),
                    A.ch_sum(flat).alias("total"))


def _register_stat(stat):
    qid = f"{_IDS[stat]}_channel_{stat}"
    sql = with_ctes(_CH) + f"SELECT vec_id, ch, {_STATS[stat]} AS value FROM ch"

    @query(qid, sql, doubles=() if stat == "len" else ("value",))
    def run(spark, sf_dir):
        c = _channels(spark, sf_dir)
        return c.select("vec_id", "ch", A.channel_stats(F.col("x"))[stat].alias("value"))
    return run


for _s in A.CHANNEL_STATS:
    _register_stat(_s)


@query("A11_explode_channels", with_ctes(_CH) + "SELECT vec_id, ch, CAST(len(x) AS INTEGER) AS n_items FROM ch")
def a11_explode_channels(spark, sf_dir):
    ex = A.explode_channels(_parsed(spark, sf_dir), "P", "vec_id", out="x")
    return ex.select("vec_id", F.col("ch_pos").alias("ch"), F.size("x").alias("n_items"))


def _summary_sql(prefix="E"):
    cols = []
    for suffix in A.SUMMARY_SUFFIXES:
        stat, how = suffix.rsplit("_", 1)
        expr = _STATS[stat]
        agg = f"CAST(max({expr}) AS INTEGER)" if how == "max" else f"avg({expr})"
        cols.append(f"{agg} AS {prefix}_{suffix}")
    return with_ctes(_CH) + f"SELECT vec_id, {', '.join(cols)} FROM ch GROUP BY vec_id"


_SUMMARY_DOUBLES = tuple(f"E_{s}" for s in A.SUMMARY_SUFFIXES if s != "len_max")


@query("A12_series_summary", _summary_sql(), doubles=_SUMMARY_DOUBLES)
def a12_series_summary(spark, sf_dir):
    """Main path: parse + per-row higher-order functions, one projection."""
    t = series_embed_text(spark, sf_dir)
    return A.summarize_series_columns(t, ["E"]).drop("label")


@query("A12_missing_series", "SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN -1.0 ELSE 2.0 END AS E_len_mean, "
       "CAST(CASE WHEN vec_id % 3 = 0 THEN -1 ELSE 3 END AS INTEGER) AS E_len_max, "
       "CASE WHEN vec_id % 3 <> 0 THEN label + 1.0 END AS E_max_mean FROM embeddings",
       doubles=("E_len_mean", "E_max_mean"))
def a12_missing_series(spark, sf_dir):
    """The reference's numbers for a missing or empty cell: lengths -1 (``minus_one``)."""
    e = table(spark, sf_dir, "embeddings")
    cell = F.when(F.col("vec_id") % 6 == 0, F.lit(None)).when(F.col("vec_id") % 3 == 0, F.lit("[]")).otherwise(
        F.concat(F.lit("[[0, 1, "), (F.col("label") + 2).cast("string"), F.lit("], ["),
                 F.col("label").cast("string"), F.lit("]]")))
    out = A.summarize_series_columns(e.select("vec_id", cell.alias("E")), ["E"], null_len="minus_one")
    return out.select("vec_id", "E_len_mean", "E_len_max", "E_max_mean")


@query("G1_channel_mean", _summary_sql(), doubles=_SUMMARY_DOUBLES)
def g1_channel_mean(spark, sf_dir):
    """Test form: explode channels, group by key, average the statistics."""
    return A.summarize_exploded(_parsed(spark, sf_dir), "P", "vec_id", "E")


_ORDER = "(l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax)"


@query("A12_order_line_series", f"""
WITH s AS (SELECT l_orderkey, count(l_quantity) AS n, min(l_quantity) AS mn, max(l_quantity) AS mx,
                  sum(l_quantity) AS sm, stddev_samp(l_quantity) AS sd,
                  arg_min(l_quantity, {_ORDER}) AS fst, arg_max(l_quantity, {_ORDER}) AS lst
           FROM lineitem GROUP BY l_orderkey)
SELECT o.o_orderkey, CAST(n AS DOUBLE) AS Q_len_mean, CAST(n AS INTEGER) AS Q_len_max,
       mn AS Q_min_mean, mx AS Q_max_mean, sm / n AS Q_mean_mean,
       CASE WHEN n > 1 THEN sd WHEN n IS NOT NULL THEN 0.0 END AS Q_std_mean,
       fst AS Q_first_mean, lst AS Q_last_mean, sm AS Q_sum_mean, lst - fst AS Q_slope_mean
FROM orders o LEFT JOIN s ON o.o_orderkey = s.l_orderkey
""", doubles=tuple(f"Q_{s}" for s in A.SUMMARY_SUFFIXES if s != "len_max"))
def a12_order_line_series(spark, sf_dir):
    """Per-order series of line quantities, from rows (orders without lines
    keep NULL statistics)."""
    lines = order_lines(spark, sf_dir)
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
             "l_discount", "l_tax"]
    s = A.summarize_rows(lines, "l_orderkey", "l_quantity", order, "Q")
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    return o.join(s, o["o_orderkey"] == s["l_orderkey"], "left").drop("l_orderkey")
