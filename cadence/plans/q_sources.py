"""Queries for sources and sinks (S1-S5, S8-S11) and the full ETL over text
times and text series (the reference's ``make etl`` on derived tables)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadence.functions.arrays import SUMMARY_SUFFIXES
from cadence.operators.splits import split_target_summary
from cadence.plans.etl import add_target, build_feature_table, build_raw_table
from cadence.plans.oracle import EVENTS_CT, EVENTS_TEXT_BASE, events_ct, ts_text, with_ctes
from cadence.plans.q_cycles import events_features, text_time
from cadence.plans.registry import query
from cadence.plans.registry import ts_text as sts
from cadence.plans.views import EVENTS_ROLES, table
from cadence.roles import ColumnRoles
from cadence.sources import io

_G4 = "SELECT split, avg(CycleTime_sec) AS avg_cycle, count(*) AS n FROM feat GROUP BY split"
CSV_SCHEMA = "A long, B long, C string, D string, value double"


def events_text_table(spark, sf_dir):
    """events with the time as text in six layouts (junk on 'error' rows)."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("A"), F.col("event_id").alias("B"),
                    text_time().alias("C"), F.col("event_type").alias("D"), "value")


@query("S1_csv_scan", with_ctes(events_ct(EVENTS_TEXT_BASE)) + _G4, doubles=("avg_cycle",))
def s1_csv_scan(spark, sf_dir):
    """Write the text cycle table as CSV, scan it back with an explicit
    schema, run the ETL (parse six layouts, split, strict gap)."""
    path = io.write_csv(events_text_table(spark, sf_dir), io.scratch_path(spark, "cycles_csv"))
    raw = io.read_csv(spark, path, CSV_SCHEMA)
    return split_target_summary(build_feature_table(raw, EVENTS_ROLES))


@query("S2_parquet_scan", "SELECT event_id, value FROM events WHERE value > 50", doubles=("value",))
def s2_parquet_scan(spark, sf_dir):
    return io.read_parquet(spark, f"{sf_dir}/events.parquet", ["event_id", "value"], F.col("value") > 50)


@query("S3_parquet_sink", with_ctes(EVENTS_CT) + "SELECT B, CycleTime_sec FROM feat WHERE split = 'test'",
       doubles=("CycleTime_sec",))
def s3_parquet_sink(spark, sf_dir):
    """Feature table written partitioned by split; the test split read back
    prunes to one partition folder."""
    path = io.write_parquet(events_features(spark, sf_dir), io.scratch_path(spark, "features"))
    back = io.read_parquet(spark, path, ["B", "CycleTime_sec"], F.col("split") == "test")
    return back


@query("S4_csv_sink", with_ctes(EVENTS_CT) + _G4, doubles=("avg_cycle",))
def s4_csv_sink(spark, sf_dir):
    summary = split_target_summary(events_features(spark, sf_dir))
    path = io.write_csv(summary, io.scratch_path(spark, "summary_csv"))
    return io.read_csv(spark, path, "split string, avg_cycle double, n long")


@query("S5_scoring_input", with_ctes(EVENTS_CT) + "SELECT A, B, value FROM feat WHERE split = 'test'",
       doubles=("value",))
def s5_scoring_input(spark, sf_dir):
    rows = events_features(spark, sf_dir).filter(F.col("split") == "test").select("A", "B", "value")
    path = io.scratch_path(spark, "score_json")
    rows.write.mode("overwrite").json(path)
    return io.read_scoring_input(spark, path, "A long, B long, value double", fmt="json")


@query("S8_cached_sql", with_ctes(EVENTS_CT) + _G4, doubles=("avg_cycle",))
def s8_cached_sql(spark, sf_dir):
    path = io.write_parquet(events_features(spark, sf_dir), io.scratch_path(spark, "features"))
    return io.cached_sql_summary(spark.read.parquet(path))


_PROFILE_COLS = [("A", "bigint"), ("B", "bigint"), ("C", "timestamp_ntz"), ("D", "string"),
                 ("value", "double"), ("split", "string"), ("next_ts", "timestamp_ntz"),
                 ("CycleTime_sec", "double")]


@query("S9_column_profile", with_ctes(EVENTS_CT) + " UNION ALL ".join(
    f"SELECT '{c}' AS column, '{t}' AS type, count(*) - count({c}) AS nulls, count(*) AS rows FROM feat"
    for c, t in _PROFILE_COLS))
def s9_column_profile(spark, sf_dir):
    f = events_features(spark, sf_dir).select(*[c for c, _ in _PROFILE_COLS])
    return io.column_profile(f)


@query("S10_round_trip", with_ctes(EVENTS_CT) +
       "SELECT count(*) AS written, count(*) AS read, true AS match FROM feat")
def s10_round_trip(spark, sf_dir):
    return io.round_trip(events_features(spark, sf_dir), io.scratch_path(spark, "roundtrip"))


_FP = ("md5(concat_ws(chr(31), A::VARCHAR, B::VARCHAR, " + ts_text("C") + ", coalesce(D, '\\N'), split, "
       + ts_text("next_ts") + ", CAST(CAST(CycleTime_sec AS BIGINT) AS VARCHAR)))")


@query("S11_fingerprint", with_ctes(EVENTS_CT, f"h AS (SELECT {_FP} AS h FROM feat)") +
       "SELECT CAST(sum(CAST('0x' || substr(h, 1, 15) AS BIGINT)) AS VARCHAR) AS fingerprint_a, "
       "CAST(sum(CAST('0x' || substr(h, 16, 15) AS BIGINT)) AS VARCHAR) AS fingerprint_b, count(*) AS rows FROM h")
def s11_fingerprint(spark, sf_dir):
    f = events_features(spark, sf_dir)
    return io.fingerprint(f.select("A", "B", sts("C").alias("C"), "D", "split", sts("next_ts").alias("next_ts"),
                                   F.col("CycleTime_sec").cast("long").alias("CycleTime_sec")))


@query("S5_scoring_csv", with_ctes(EVENTS_CT) + "SELECT A, B, value FROM feat WHERE split = 'test'",
       doubles=("value",))
def s5_scoring_csv(spark, sf_dir):
    rows = events_features(spark, sf_dir).filter(F.col("split") == "test").select("A", "B", "value")
    path = io.write_csv(rows, io.scratch_path(spark, "score_csv"))
    return io.read_scoring_input(spark, path, "A long, B long, value double")


@query("S5_scoring_json_array", with_ctes(EVENTS_CT) + "SELECT A, B, value FROM feat WHERE split = 'test'",
       doubles=("value",))
def s5_scoring_json_array(spark, sf_dir):
    """Files of one JSON array each; every file is split over tasks."""
    rows = events_features(spark, sf_dir).filter(F.col("split") == "test").select("A", "B", "value")
    path = io.write_json_arrays(rows, io.scratch_path(spark, "score_json_array"), 2, "B")
    return io.read_scoring_input(spark, path, "A long, B long, value double", fmt="json", multiline=True)


# --- the full ETL: text time (six layouts) + twelve text series columns ---------------

SERIES = tuple("EFGHIJKLMNOP")
SERIES_ROLES = ColumnRoles(stream="A", cycle="B", time="C", label="D", series=SERIES)
CHANNEL = 8  # values of a channel; a series is two channels that follow each other


def _start(i: int) -> int:
    """Where series ``i`` begins in a vector of 64 values (from 0)."""
    return 4 * i


def cycles_with_series(spark, sf_dir):
    """events (text time) with twelve series each, as JSON text: pieces of the embedding numbered
    event id modulo the number of embeddings (whose ids are 0, 1, ...)."""
    t = events_text_table(spark, sf_dir)
    emb = table(spark, sf_dir, "embeddings")
    count = emb.agg(F.count(F.lit(1)).alias("_n"))  # one row
    d = F.col("embedding").cast("array<double>")
    cells = [F.to_json(F.array(*[F.slice(d, _start(i) + CHANNEL * c + 1, CHANNEL) for c in (0, 1)])).alias(n)
             for i, n in enumerate(SERIES)]
    t = t.crossJoin(F.broadcast(count)).withColumn("_v", F.pmod("B", "_n")).drop("_n")
    # both sides grow with the data: dealt by vector, so the parsing behind it is spread too
    return t.join(emb.select(F.col("vec_id").alias("_v"), *cells).hint("merge"), "_v", "left").drop("_v")


_CH = f"""
ch AS (SELECT vec_id, s, CAST(embedding[4 * s + {CHANNEL} * c + 1 : 4 * s + {CHANNEL} * c + {CHANNEL}] AS DOUBLE[]) AS x
       FROM embeddings CROSS JOIN range(12) AS t(s) CROSS JOIN range(2) AS u(c)),
en AS (SELECT count(*) AS n FROM embeddings)
"""
_STAT = {"len": "len(x)", "min": "list_min(x)", "max": "list_max(x)", "mean": "list_sum(x) / len(x)",
         "std": "CASE WHEN len(x) > 1 THEN list_aggregate(x, 'stddev_samp') ELSE 0.0 END",
         "first": "x[1]", "last": "x[-1]", "sum": "list_sum(x)", "slope": "x[-1] - x[1]"}


def _series_sql():
    """One row for each vector: the summary of every series."""
    cols = []
    for i, name in enumerate(SERIES):
        for suffix in SUMMARY_SUFFIXES:
            stat, how = suffix.rsplit("_", 1)
            agg = f"max({_STAT[stat]})" if how == "max" else f"avg({_STAT[stat]})"
            agg += f" FILTER (WHERE s = {i})"
            cols.append((f"CAST({agg} AS INTEGER)" if how == "max" else agg) + f" AS {name}_{suffix}")
    return f"sm AS (SELECT vec_id, {', '.join(cols)} FROM ch GROUP BY vec_id)"


_SERIES_COLS = [f"{n}_{s}" for n in SERIES for s in SUMMARY_SUFFIXES]


@query("ETL_feature_table", with_ctes(events_ct(EVENTS_TEXT_BASE), _CH, _series_sql()) +
       f"SELECT feat.B, split, CycleTime_sec, {', '.join(_SERIES_COLS)} FROM feat CROSS JOIN en "
       "LEFT JOIN sm ON feat.B % en.n = sm.vec_id",
       doubles=("CycleTime_sec", *[c for c in _SERIES_COLS if not c.endswith("len_max")]))
def etl_feature_table(spark, sf_dir):
    """Flagship: text time in six layouts, twelve text series columns, per-row series summary
    before any shuffle, time split, strict next-cycle gap."""
    raw = build_raw_table(cycles_with_series(spark, sf_dir), SERIES_ROLES, times=events_text_table(spark, sf_dir))
    path = io.write_parquet(raw, io.scratch_path(spark, "raw"))  # parsed and summarised once
    out = add_target(io.read_parquet(spark, path), SERIES_ROLES)
    return out.select("B", "split", "CycleTime_sec", *_SERIES_COLS)
