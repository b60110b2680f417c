"""Hard negatives against all scores."""

import math

import numpy as np

from cadence.llm.hard_negatives import Running, Tile, hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label int, rank string, positives string"


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def plain(rows, ask, k=5, n=5, low=80, high=100):
    good = [(i, [math.floor(256 * x) for x in v], l) for i, v, l in rows if usable(v) and l is not None]
    out = []
    for a, v, l in good:
        if not ask(a):
            continue
        s = sorted((-sum(x * y for x, y in zip(v, c)), i, m) for i, c, m in good if i != a)
        for p, pid in [(-x, i) for x, i, m in s if m == l][:k]:
            fit = [(-x, i) for x, i, m in s if m != l and low * p <= 100 * -x <= high * p][:n]
            out += [(a, pid, r, c, p, x) for r, (x, c) in enumerate(fit, 1)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, v, l, "x", "y") for i, v, l in rows], SCHEMA)


def test_random_vectors_ties_and_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.integers(-3, 5, 12) / 9 + 0.2).tolist(), int(rng.integers(0, 4))) for i in range(400)]
    same = [0.5] * 12
    rows += [(1000 + i, same, i % 4) for i in range(60)]
    rows += [(500, None, 1), (600, [1.0, None], 1), (700, same, None), (800, [float("nan")], 2),
             (900, [], 0), (2000, [0.3, 0.4], 2), (2001, [1e12] * 12, 1), (2100, [1e12, -2e11], 1)]
    df = table(spark, rows)
    got = hard_negatives(df, df.filter("vec_id % 100 = 0"))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score",
                           "negative_score"]
    want = plain(rows, lambda a: a % 100 == 0)
    assert len(want) > 50 and sorted(tuple(r) for r in got.collect()) == want
    got = hard_negatives(df, df.filter("vec_id = 100"), positives=2, negatives=9, low=50, high=90)
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, lambda a: a == 100, 2, 9, 50, 90)


def test_whole_table(spark, sf):
    from cadence.llm.q_vectors import op12_hard_negatives
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label)
            for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = sorted(tuple(r) for r in op12_hard_negatives(spark, sf).collect())
    assert got == plain(rows, lambda a: a % 100 == 0) and got


def test_scan_leaves_candidates_out_and_stays_exact():
    rng = np.random.default_rng(7)
    v = np.floor(256 * rng.standard_normal((5000, 64)) * 0.8 ** np.arange(64)).astype(np.int64)
    tile = Tile(np.arange(5000), np.zeros(5000, np.int64), v)
    run, seen = Running(5, 30_000, 60_000), []

    def matters(low, high):
        seen.append(len(low))
        return run.matters(low, high)
    at, s = tile.scan(v[3], np.arange(5000) != 3, matters)
    full = v @ v[3]
    assert seen[-1] < 500 and (full[at] == s).all()
    run.take(tile.ids[at], s)
    fit = [(-x, i) for i, x in enumerate(full.tolist()) if i != 3 and 30_000 <= x <= 60_000]
    assert list(zip((-run.scores).tolist(), run.names.tolist())) == sorted(fit)[:5]


def test_null_and_repeated_ids(spark):
    df = table(spark, [(None, [1.0], 1), (0, [1.0], 1), (0, [2.0], 1), (1, [0.9], 2), (1, [0.9], 2),
                       (2, [1.0], 2)])
    got = sorted(tuple(r) for r in hard_negatives(df, df.filter("vec_id = 0")).collect())
    assert got == [(0, None, 1, 2, 65536, 65536), (0, None, 2, 1, 65536, 58880),
                   (0, None, 3, 1, 65536, 58880)]
    assert hard_negatives(df.limit(0), df.limit(0)).count() == 0
    assert hard_negatives(df, df.filter("vec_id IS NULL")).filter("anchor_id IS NULL").count() == 3
