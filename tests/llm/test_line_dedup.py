import brute
from cadence.llm.line_dedup import line_dedup

SCHEMA = "doc_id long, text string, n_lines string, lang string"


def rows_of(df):
    return {(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in df.collect()}


def test_edges(spark):
    long = "a line that is long enough\n" * 3000 + "last"
    rows = [(3, "Same long line\nshort\n same LONG line \n", "x", None), (1, "same long line", "x", "en"),
            (2, None, None, None), (4, "", None, "en"), (7, "short\nshort", None, None),
            (8, "short", None, None), (5, long, None, None), (6, long, None, None),
            (9, "ÉCOLE ÉCOLE", None, None), (10, "école école", None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = brute.lines([(r[0], r[1]) for r in rows])
    out = line_dedup(docs)
    assert out.columns == ["doc_id", "text", "lang", "n_lines", "n_dropped"]
    assert rows_of(out) == {(k, *v[:2], v[2]) for k, v in want.items()}
    got = {r.doc_id: r for r in out.collect()}
    assert got[3].text == "short\n" and got[1].text == "same long line"
    assert got[10].n_dropped == 0  # only A-Z are lowered


def test_null_and_repeated_ids(spark):
    rows = [(None, "one long line here", "", ""), (1, "one long line here", "", ""),
            (2, "twice the same row", "", ""), (2, "twice the same row", "", "")]
    got = sorted((r.doc_id or 0, r.n_dropped) for r in
                 line_dedup(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(0, 0), (1, 1), (2, 0), (2, 0)]


def test_empty_table_and_threshold(spark):
    docs = spark.createDataFrame([(i, "shared by three\nshared by all!") for i in range(3)]
                                 + [(3, "shared by all!")], "doc_id long, text string")
    assert line_dedup(docs.limit(0)).count() == 0
    got = {r.doc_id: r.n_dropped for r in line_dedup(docs, min_docs=4).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 1}


def test_plan_is_native(spark, sf):
    plan = line_dedup(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
