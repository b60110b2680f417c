"""Queries for statistics, preparation and projections (G7-G9, M1-M9,
P3, P5, P9-P14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadence.operators import stats as S
from cadence.operators.projection import (align_features, drop_case_insensitive,
                                          feature_columns, rename_roles, split_filter)
from cadence.operators.rowindex import sliding_windows, with_place
from cadence.operators.sequences import previous_target, window_index
from cadence.operators.splits import (ordered_fraction_split, random_split, seeded_sample,
                                      seeded_unit)
from cadence.plans.oracle import EVENTS_CT, REG_LINES, md5_unit, with_ctes
from cadence.plans.q_cycles import events_features
from cadence.plans.registry import query
from cadence.plans.views import EVENTS_ROLES, reg_lines, table

FEATS = ["l_quantity", "l_discount", "tax_ratio"]


def _union(parts):
    return " UNION ALL ".join(parts)


_LKEY = "concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey)"


@query("M7_random_split", f"SELECT {_LKEY} AS row_key, "
       f"CASE WHEN {md5_unit(_LKEY)} < 0.8 THEN 'train' ELSE 'test' END AS split FROM lineitem")
def m7_random_split(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    key = F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("row_key")
    return random_split(li.select(key), "row_key").select("row_key", "split")


@query("G7_describe", with_ctes(REG_LINES) + _union([
    f"SELECT '{c}' AS column, CAST(count({c}) AS DOUBLE) AS count, avg({c}) AS mean, stddev_samp({c}) AS std, "
    f"min({c}) AS min, quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.5) AS p50, "
    f"quantile_cont({c}, 0.75) AS p75, max({c}) AS max FROM rl" for c in FEATS + ["y"]]),
    doubles=("count", "mean", "std", "min", "p25", "p50", "p75", "max"))
def g7_describe(spark, sf_dir):
    return S.describe(reg_lines(spark, sf_dir), FEATS + ["y"])


@query("G8_train_stats", with_ctes(REG_LINES) + _union([
    f"SELECT '{c}' AS feature, avg({c}) AS mean, stddev_pop({c}) AS std, quantile_cont({c}, 0.5) AS median "
    f"FROM rl WHERE split = 'train'" for c in FEATS]), doubles=("mean", "std", "median"))
def g8_train_stats(spark, sf_dir):
    return S.train_stats(reg_lines(spark, sf_dir), FEATS)


@query("G9_class_rate", with_ctes(EVENTS_CT, """
r AS (SELECT avg(CASE WHEN CycleTime_sec >= 90 THEN 1.0 ELSE 0.0 END) AS long_rate FROM feat WHERE split = 'train')""") +
       "SELECT long_rate, (1.0 - long_rate) / greatest(long_rate, 1e-6) AS pos_weight FROM r",
       doubles=("long_rate", "pos_weight"))
def g9_class_rate(spark, sf_dir):
    return S.class_rate(events_features(spark, sf_dir))


def _impute_sql(how):
    fn = "quantile_cont(tax_ratio, 0.5)" if how == "median" else "avg(tax_ratio)"
    return (with_ctes(REG_LINES) + f"SELECT row_key, coalesce(tax_ratio, (SELECT coalesce({fn}, 0.0) FROM rl "
            "WHERE split = 'train')) AS tax_ratio FROM rl")


@query("M1_impute_median", _impute_sql("median"), doubles=("tax_ratio",))
def m1_impute_median(spark, sf_dir):
    r = reg_lines(spark, sf_dir)
    st = S.train_stats(r, ["tax_ratio"])
    return S.impute(r, ["tax_ratio"], st, how="median").select("row_key", "tax_ratio")


@query("M2_impute_mean", _impute_sql("mean"), doubles=("tax_ratio",))
def m2_impute_mean(spark, sf_dir):
    r = reg_lines(spark, sf_dir)
    st = S.train_stats(r, ["tax_ratio"], median=False)
    return S.impute(r, ["tax_ratio"], st, how="mean").select("row_key", "tax_ratio")


@query("M4_standardize", with_ctes(REG_LINES, """
st AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_discount) AS md,
              stddev_pop(l_discount) AS sd FROM rl WHERE split = 'train')""") +
       "SELECT row_key, (l_quantity - mq) / sq AS l_quantity, (l_discount - md) / sd AS l_discount "
       "FROM rl CROSS JOIN st", doubles=("l_quantity", "l_discount"))
def m4_standardize(spark, sf_dir):
    r = reg_lines(spark, sf_dir)
    f = ["l_quantity", "l_discount"]
    return S.standardize(r, f, S.train_stats(r, f, median=False)).select("row_key", *f)


@query("M4_standardize_floor", with_ctes(REG_LINES, """
st AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq FROM rl WHERE split = 'train')""") +
       "SELECT row_key, (l_quantity - mq) / greatest(sq, 1e-8) AS l_quantity, "
       "CAST(0.0 AS DOUBLE) AS flat FROM rl CROSS JOIN st", doubles=("l_quantity", "flat"))
def m4_standardize_floor(spark, sf_dir):
    """The scoring path's form: a std of zero (the constant column) is floored at 1e-8."""
    r = reg_lines(spark, sf_dir).withColumn("flat", F.lit(3.0))
    f = ["l_quantity", "flat"]
    return S.standardize(r, f, S.train_stats(r, f, median=False), zero_std="floor").select("row_key", *f)


def _prev_ct_all(spark, sf_dir):
    f = events_features(spark, sf_dir)
    return previous_target(f, EVENTS_ROLES.order(), partition=["split"])


_LAGS = ", ".join(f"lag(prev_ct, {5 - t}) OVER o AS p{t}" for t in range(5))


@query("M3_timestep_impute", with_ctes(EVENTS_CT, f"""
pt AS (SELECT *, lag(CycleTime_sec) OVER (PARTITION BY split ORDER BY C, A, B) AS prev_ct FROM feat),
w AS (SELECT B, {_LAGS}, count(*) OVER (ORDER BY C, A, B ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS n
      FROM pt WINDOW o AS (ORDER BY C, A, B)),
v AS (SELECT * FROM w WHERE n = 5),
m AS (SELECT {', '.join(f'avg(p{t}) AS m{t}' for t in range(5))} FROM v)""") +
    f"SELECT B, {' + '.join(f'coalesce(p{t}, m{t})' for t in range(5))} AS x_sum, "
    f"CAST({' + '.join(f'(CASE WHEN p{t} IS NULL THEN 1 ELSE 0 END)' for t in range(5))} AS INTEGER) AS n_filled "
    "FROM v CROSS JOIN m", doubles=("x_sum",))
def m3_timestep_impute(spark, sf_dir):
    p = _prev_ct_all(spark, sf_dir)
    ix = window_index(p, ["prev_ct"], ["C", "A", "B"], ["B"], target=None)
    means = S.row_timestep_means(with_place(ix), ["prev_ct"], 5, target_inside=False)
    win = sliding_windows(ix, ["prev_ct"], 5, target_inside=False, meta=["B"])
    filled = win.select("B", F.aggregate(F.transform("X", lambda r: F.when(r[0].isNull(), 1).otherwise(0)),
                                         F.lit(0), lambda a, v: a + v).alias("n_filled"), "X")
    imp = S.impute_per_timestep(filled, 1, means)
    return imp.select("B", F.aggregate(F.transform("X", lambda r: r[0]), F.lit(0.0),
                                       lambda a, v: a + v).alias("x_sum"), "n_filled")


@query("M5_window_standardize", with_ctes(EVENTS_CT, """
w AS (SELECT B, split, count(*) OVER ww AS n, sum(value) OVER ww AS x_sum, sum(value * value) OVER ww AS x_sq,
             value AS x_last FROM feat
      WINDOW ww AS (PARTITION BY split ORDER BY C, A, B ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
v AS (SELECT * FROM w WHERE n = 5),
st AS (SELECT sum(x_sum) / (5.0 * count(*)) AS mu,
              sqrt(greatest(sum(x_sq) / (5.0 * count(*)) - pow(sum(x_sum) / (5.0 * count(*)), 2), 0)) AS sd
       FROM v WHERE split = 'train')""") +
       "SELECT B, split, (x_sum - 5 * mu) / greatest(sd, 1e-8) AS z_sum, (x_last - mu) / greatest(sd, 1e-8) AS z_last "
       "FROM v CROSS JOIN st", doubles=("z_sum", "z_last"))
def m5_window_standardize(spark, sf_dir):
    f = events_features(spark, sf_dir)
    ix = window_index(f, ["value"], ["C", "A", "B"], ["B", "split"], ["split"])
    cells = S.row_cell_stats(with_place(ix, ["split"]), ["value"], 5, target_inside=True)
    win = sliding_windows(ix, ["value"], 5, target_inside=True, meta=["B", "split"], same=["split"])
    z = S.standardize_windows(win, cells)
    vals = F.transform("X", lambda r: r[0])
    return z.select("B", "split", F.aggregate(vals, F.lit(0.0), lambda a, v: a + v).alias("z_sum"),
                    F.element_at(vals, -1).alias("z_last"))


@query("M6_oversample", with_ctes(EVENTS_CT, f"""
t AS (SELECT B, CASE WHEN CycleTime_sec >= 90 THEN CAST(20.0 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END AS w
      FROM feat WHERE split = 'train'),
tot AS (SELECT sum(w) AS sw, CAST(count(*) AS DOUBLE) AS n, {md5_unit("'draw'")} AS u FROM t),
o AS (SELECT B, w, coalesce(sum(w) OVER (ORDER BY md5(B || ':42') ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                            0) AS before FROM t),
c AS (SELECT B, CAST(ceil((before + w) * n / sw - u) - ceil(before * n / sw - u) AS INTEGER) AS copies
      FROM o CROSS JOIN tot)""") +
       "SELECT B, copies FROM c WHERE copies > 0")
def m6_oversample(spark, sf_dir):
    """As many draws as rows, exactly."""
    f = events_features(spark, sf_dir).filter(F.col("split") == "train")
    w = F.when(S.long_flag("CycleTime_sec") == 1, F.lit(20.0)).otherwise(F.lit(1.0))
    o = S.oversample(f, "B", w)
    return o.groupBy("B").agg(F.count(F.lit(1)).cast("int").alias("copies"))


@query("M8_ordered_split", with_ctes(EVENTS_CT) +
       "SELECT B, CASE WHEN row_number() OVER (ORDER BY C, A, B) - 1 < floor(0.8 * (SELECT count(*) FROM feat)) "
       "THEN 'train' ELSE 'test' END AS split FROM feat")
def m8_ordered_split(spark, sf_dir):
    f = events_features(spark, sf_dir).drop("split")
    return ordered_fraction_split(f, ["C", "A", "B"]).select("B", "split")


@query("M9_seeded_sample", with_ctes(REG_LINES) + "SELECT row_key FROM rl ORDER BY md5(row_key || ':42') LIMIT 5000")
def m9_seeded_sample(spark, sf_dir):
    return seeded_sample(reg_lines(spark, sf_dir), "row_key", 5000).select("row_key")


@query("P3_numeric_features", with_ctes(REG_LINES) + "SELECT row_key, l_quantity, l_discount, l_tax, tax_ratio FROM rl",
       doubles=("l_quantity", "l_discount", "l_tax", "tax_ratio"))
def p3_numeric_features(spark, sf_dir):
    r = reg_lines(spark, sf_dir)
    feats = feature_columns(r, exclude=("y", "split"))
    return r.select("row_key", *feats)


@query("P3_pattern_features", with_ctes(REG_LINES) + "SELECT row_key, l_discount, l_quantity FROM rl",
       doubles=("l_discount", "l_quantity"))
def p3_pattern_features(spark, sf_dir):
    """Features by name pattern, sorted, the first two."""
    r = reg_lines(spark, sf_dir)
    return r.select("row_key", *feature_columns(r, exclude=("y", "split"), pattern="^l_", limit=2))


@query("P5_role_projection", "SELECT user_id AS A, event_id AS B, event_type AS D FROM events")
def p5_role_projection(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    e = drop_case_insensitive(e, ["TS", "Value", "PROPS"])
    return rename_roles(e, {"user_id": "A", "event_id": "B", "event_type": "D"})


@query("P9_align_features", with_ctes(REG_LINES) +
       "SELECT row_key, tax_ratio, 0.0 AS not_in_table, l_quantity FROM rl", doubles=("tax_ratio", "not_in_table", "l_quantity"))
def p9_align_features(spark, sf_dir):
    r = reg_lines(spark, sf_dir)
    return align_features(r, ["row_key"], ["tax_ratio", "not_in_table", "l_quantity"])


@query("P10_long_flag", with_ctes(EVENTS_CT) +
       "SELECT B, CAST(CycleTime_sec >= 90 AS INTEGER) AS is_long FROM feat")
def p10_long_flag(spark, sf_dir):
    f = events_features(spark, sf_dir)
    return f.select("B", S.long_flag("CycleTime_sec").alias("is_long"))


@query("P11_log_target", with_ctes(EVENTS_CT) +
       "SELECT B, ln(1 + CycleTime_sec) AS log_y, exp(ln(1 + CycleTime_sec)) - 1 AS back FROM feat",
       doubles=("log_y", "back"))
def p11_log_target(spark, sf_dir):
    f = events_features(spark, sf_dir)
    ly = S.log_target(F.col("CycleTime_sec"))
    return f.select("B", ly.alias("log_y"), S.inverse_log_target(ly).alias("back"))


@query("P12_non_finite", with_ctes(REG_LINES) +
       "SELECT row_key, CASE WHEN l_tax <> 0 THEN l_discount / l_tax END AS x FROM rl", doubles=("x",))
def p12_non_finite(spark, sf_dir):
    r = reg_lines(spark, sf_dir)
    raw = (F.when((F.col("l_tax") == 0) & (F.col("l_discount") == 0), F.lit(float("nan")))
            .when(F.col("l_tax") == 0, F.lit(float("inf")) * F.signum(F.col("l_discount") + 1e-9))
            .otherwise(F.col("l_discount") / F.col("l_tax")))
    return r.select("row_key", S.finite_or_null(raw).alias("x"))


@query("P13_class_decision", with_ctes(EVENTS_CT) +
       f"SELECT B, CAST({md5_unit('B')} >= 0.5 AS INTEGER) AS is_long_pred FROM feat")
def p13_class_decision(spark, sf_dir):
    f = events_features(spark, sf_dir)
    return f.select("B", S.decide(seeded_unit(F.col("B"))).alias("is_long_pred"))


@query("P14_split_filter", with_ctes(EVENTS_CT) + "SELECT B, CycleTime_sec FROM feat WHERE split = 'test'",
       doubles=("CycleTime_sec",))
def p14_split_filter(spark, sf_dir):
    return split_filter(events_features(spark, sf_dir)).select("B", "CycleTime_sec")
