import math

import brute
import numpy as np

from cadence.llm import topk
from cadence.llm.embedding_dedup import near_vectors
from cadence.llm.topk import top_k

SCHEMA = "vec_id long, embedding array<double>, rank string, kept string"


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def plain_top(rows, ask, k):
    good = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if usable(v)]
    out = set()
    for q, v in good:
        if ask(q):
            s = sorted((-sum(a * b for a, b in zip(v, c)), i) for i, c in good if i != q)
            out |= {(q, n, i, -x) for n, (x, i) in enumerate(s[:k], 1)}
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y") for i, v in rows], SCHEMA)


def test_top_k_with_ties_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.integers(-3, 4, 12) / 7).tolist()) for i in range(300)]
    rows += [(300, None), (320, [1.0, None]), (340, [1.0, float("nan")]), (360, [float("inf")]),
             (380, []), (400, [0.5, 0.5]), (401, [1e12] * 12), (420, [-1e12, 3e9])]
    df = table(spark, rows)
    got = top_k(df, df.filter("vec_id % 20 = 0"), k=7)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert {tuple(r) for r in got.collect()} == plain_top(rows, lambda q: q % 20 == 0, 7)


def test_top_k_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = {tuple(r) for r in top_k(df, df.filter("vec_id % 20 = 0")).collect()}
    assert got == plain_top(rows, lambda q: q % 20 == 0, 20)


def test_bounds_prune_and_stay_exact():
    """Vectors whose mass lies in the first dimensions: most candidates go early."""
    rng = np.random.default_rng(5)
    v = np.floor(64 * rng.standard_normal((3000, 64)) * 0.7 ** np.arange(64)).astype(np.int64)
    ids = np.arange(3000)
    q, c, s = topk.Candidates(ids, v).top(ids[:40], v[:40], 10)
    full = v[:40] @ v.T
    for i in range(40):
        full[i, i] = -(1 << 60)
        order = np.lexsort((ids, -full[i]))[:10]
        assert c[q == i].tolist() == order.tolist() and s[q == i].tolist() == full[i, order].tolist()


def test_top_k_few_and_null_ids(spark):
    df = table(spark, [(None, [1.0]), (0, [1.0]), (0, [1.0]), (1, [2.0])])
    got = sorted(tuple(r) for r in top_k(df, df.filter("vec_id = 0")).collect())
    assert got == [(0, 1, 1, 8192), (0, 2, None, 4096)]
    assert top_k(df.limit(0), df.limit(0)).count() == 0


def plain_links(rows, cosine=0.95):
    good = {n: (i, np.asarray(v, float) / max(map(abs, v))) for n, (i, v) in enumerate(rows)
            if usable(v) and any(v)}
    links, n_links = [], [0] * len(rows)
    for a, (i, x) in good.items():
        for b, (j, y) in good.items():
            if a < b:
                w = min(len(x), len(y))
                if x[:w] @ y[:w] / np.linalg.norm(x) / np.linalg.norm(y) >= cosine:
                    links.append((i, j))
                    n_links[a] += 1
                    n_links[b] += 1
    comp = brute.smallest_reachable({i for i, _ in rows}, links)
    return sorted((i, n, comp[i], comp[i] == i) for (i, _), n in zip(rows, n_links))


def test_links_of_groups_and_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = []
    for g in range(40):
        base = rng.standard_normal(32)
        for _ in range(rng.integers(1, 12)):
            rows.append((len(rows), (base + rng.standard_normal(32) * 0.3 * rng.random()).tolist()))
    hot = rng.standard_normal(32)
    rows += [(1000 + i, hot.tolist()) for i in range(150)]
    rows += [(2000 + i, (hot + rng.standard_normal(32) * 0.12).tolist()) for i in range(150)]
    rows += [(3000, None), (3001, [0.0] * 32), (3002, [1.0, None]), (3003, [float("nan")]), (3004, []),
             (3005, (hot * 1e300).tolist()), (3006, (hot * 1e-300).tolist()), (3007, hot[:31].tolist())]
    df = table(spark, rows)
    got = near_vectors(df)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(tuple(r) for r in got.collect()) == plain_links(rows)


def test_links_of_repeated_and_null_ids(spark):
    df = table(spark, [(None, [1.0, 0.0]), (5, [1.0, 0.0]), (5, [1.0, 0.0]), (6, [0.0, 1.0])])
    got = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in near_vectors(df).collect())
    assert got == [(0, 2, None, True), (5, 2, None, False), (5, 2, None, False), (6, 0, 6, True)]
    assert near_vectors(df.limit(0)).count() == 0
