"""Driver contract and a sample of the DuckDB oracle comparisons at sf0.001."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert "CycleTime_sec" in df.columns and "E_mean_mean" in df.columns
    assert df.count() >= 0


def test_oracle_keys_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 80


def _norm(v):
    return v + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", ["G4_split_summary", "J2_next_cycle_join", "A12_series_summary",
                                  "W6_windows_next", "R7_linear_attribution", "ETL_feature_table",
                                  "M3_timestep_impute", "S9_column_profile"])
def test_oracle_sample(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    sdf = entry.queries()[name](spark, SF)
    cols = sorted(sdf.columns)
    a = sorted((tuple(_norm(r[c]) for c in cols) for r in sdf.collect()), key=repr)
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    b = sorted((tuple(_norm(dict(zip(names, r))[c]) for c in cols) for r in cur.fetchall()), key=repr)
    assert sorted(names) == cols and a == b
