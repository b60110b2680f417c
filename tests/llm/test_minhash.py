import random

import brute
import numpy as np

from cadence.llm.components import components
from cadence.llm.minhash import COORDS, EMPTY, U, keep_one, keep_unlike, near_duplicates, sketches
from cadence.llm.shingles import shingle_sets


def test_shingle_sets_count_as_the_plain_ones():
    texts = ["", " \n", "One two", "one  TWO", "a b c d e", "a b c d e f a b c d e f", "É é x\x85y z w v"]
    got = shingle_sets([t.encode() for t in texts])
    assert [len(s) for s in got] == [len(brute.shingles(t)) for t in texts]
    assert got[2].tolist() == got[3].tolist() != got[4].tolist()


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 1 << 62, n).astype(U)) for n in (1, 3, 40, 5000)]
    rows = sketches([*sets, np.zeros(0, U)], 512)
    assert (rows[:4] != EMPTY).all() and (rows[4] == EMPTY).all()
    a, b = sets[3][:4000], sets[3][1000:]
    x, y = sketches([a, b], 2048)
    assert abs((x == y).mean() - 3000 / 5000) < 0.06
    assert COORDS == rows.shape[1] or COORDS == 252


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 140)] + \
            [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)]
    df = spark.createDataFrame(links, "a long, b long")
    names = {x for a, b in links if a != b for x in (a, b)}
    want = brute.smallest_reachable(names, links)
    assert {r.id: r.component for r in components(df, "a", "b").collect()} == want
    assert components(df.limit(0), "a", "b").count() == 0


def variants(rng, n, words, edits):
    base = [f"w{rng.randrange(10 ** 6)}" for _ in range(words)]
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(words)] = f"x{rng.randrange(10 ** 6)}"
        yield " ".join(w)


def test_groups_around_the_threshold(spark):
    """Exact and near copies, chains, groups whose pairs lie on both sides of the threshold."""
    rng = random.Random(8)
    texts = [None, "", " \n ", "one two", "ONE  two", "one three"]
    for words, n, edits in ((60, 40, 3), (200, 60, 8), (20, 20, 1), (12, 10, 2)):
        texts += list(variants(rng, n, words, edits))
    chain = [f"c{i}" for i in range(300)]
    texts += [" ".join(chain[i:i + 100]) for i in range(0, 60, 6)]  # neighbours are linked
    texts += ["shared passage of seven words stands here " + " ".join(f"u{rng.random()}" for _ in range(9))
              for _ in range(60)]
    rng.shuffle(texts)
    rows = list(enumerate(texts, 1))
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, kept string")
    want = brute.near(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs).collect()}
    assert got == {k: (n, c, k == c) for k, (n, c) in want.items()}


def test_whole_table_and_keep_one(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute.near([(r.doc_id, r.text) for r in docs.collect()])
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(k for k, (_, c) in want.items() if k == c)


def test_ids(spark):
    t = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(None, t), (4, t), (4, t), (5, "other words"), (5, t + " more")],
                                 "doc_id long, text string")
    got = near_duplicates(docs).collect()
    assert len(got) == 5 and {r.component_id for r in got} == {None}
    assert [r.doc_id for r in got if r.kept] == [None]
    assert keep_one(docs).count() == 1
    assert near_duplicates(docs.limit(0)).count() == 0 and keep_one(docs.limit(0)).count() == 0


def test_unlike_texts_of_one_id_stay(spark):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10 ** 6)}"
    base = [" ".join(word() for _ in range(60)) for _ in range(40)]
    rows = [(None, t) for t in base] + [(7, base[0] + " end"), (7, base[1] + " end"), (7, base[2])]
    rows += [(8, base[3] + " end"), (None, base[4]), (None, ""), (None, None), (9, "one two"), (9, "three four")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(((r.doc_id or 0, r.text or "") for r in keep_unlike(docs).collect()))
    assert kept == sorted([(0, t) for t in base] + [(0, ""), (0, ""), (9, "one two"), (9, "three four")])
    assert keep_unlike(docs.limit(0)).count() == 0


def test_every_text_of_an_id_has_its_wide_sketch(spark):
    """Groups around the threshold whose texts share ids: components of ids against brute force."""
    rng = random.Random(8)
    texts = []
    for words, n, edits in ((60, 40, 3), (200, 60, 8), (20, 20, 1)):
        texts += list(variants(rng, n, words, edits))
    rng.shuffle(texts)
    plain = brute.near(list(enumerate(texts)))
    ids = [i // 2 for i in range(len(texts))]
    links = [(ids[i], ids[c]) for i, (_, c) in plain.items()]
    want = brute.smallest_reachable(set(ids), links)
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    got = near_duplicates(docs).collect()
    assert len(got) == len(texts) and all(r.component_id == want[r.doc_id] for r in got)
    unlike = {texts[i] for i, (_, c) in plain.items() if i == c}
    assert len(keep_unlike(docs).collect()) == len(unlike)


def test_the_row_that_stays_is_the_same_for_any_partitioning(spark):
    t = " ".join(f"w{i}" for i in range(30))
    rows = [(k, t if (k or 9) < 3 else f"{t} {k}", s) for k in (1, 1, 2, 2, 5, None, None) for s in "abc"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [sorted(map(str, keep_unlike(docs.repartition(n)).collect())) for n in (1, 3, 8)]
    assert got[0] == got[1] == got[2] and len(got[0]) == 1
