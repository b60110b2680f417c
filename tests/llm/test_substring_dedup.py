import random

import brute
import numpy as np

from cadence.llm.bwt import prefixes_below, repeated_starts, suffix_order
from cadence.llm.substring_dedup import substring_dedup


def test_prefixes_against_sorted_suffixes():
    """Symbol 0 ends a text; up to there the shared prefixes are those of sorted suffixes."""
    rng = np.random.default_rng(2)
    for n in (1, 2, 7, 60, 300, 2000):
        s = rng.integers(0, 4, n) * (rng.random(n) < 0.95)
        s[-1] = 0
        order = suffix_order(s, 8)
        got = prefixes_below(s, order, 8)
        for i in range(1, n):
            a, b = (s[j:j + 8].tolist() for j in order[i - 1:i + 1])
            a, b = (x[:x.index(0) + 1] if 0 in x else x for x in (a, b))
            if a != b:
                want = next(j for j, (x, y) in enumerate(zip(a, b)) if x != y)
                assert got[i] == want
            elif 0 not in a:
                assert got[i] == -1


def test_repeated_starts_against_search():
    rng = random.Random(1)
    for _ in range(800):
        length, letters = rng.choice([1, 2, 3, 5, 8]), rng.choice([b"ab", b"abc", b"\x00\xffab"])
        texts = [bytes(rng.choice(letters) for _ in range(rng.randrange(20)))
                 for _ in range(rng.randrange(1, 8))]
        owners = np.array([rng.randrange(5) for _ in texts])
        for t, o, g in zip(texts, owners, repeated_starts(texts, owners, length)):
            assert list(g) == [i for i in range(len(t) - length + 1)
                               if any(t[i:i + length] in x for x, p in zip(texts, owners) if p < o)]


def check(spark, rows):
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, kept string")
    want = brute.substrings(rows)
    got = {r.doc_id: r for r in substring_dedup(docs).collect()}
    assert len(got) == len(rows)
    for k, (data, gone) in want.items():
        spans = sum(g > p for p, g in zip(b"\0" + gone, gone))
        assert (got[k].n_bytes, got[k].n_removed, got[k].n_spans) == (len(data), sum(gone), spans), k
        assert bytes(got[k].kept) == bytes(c for c, g in zip(data, gone) if not g)
    return sum(sum(gone) for _, gone in want.values())


def test_pieces_of_one_another(spark):
    """Cut and joined texts: matches of 49, 50 and more bytes, low variety, runs, umlauts."""
    rng = random.Random(9)
    base = ["".join(rng.choice("abcdefgh ü\n") for _ in range(400)) for _ in range(4)]
    rows = [(0, None), (1, ""), (2, "a" * 3000), (3, "ab" * 500), (4, "a" * 49), (5, "a" * 50)]
    for k in range(6, 90):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            b, n = rng.choice(base), rng.choice([20, 45, 49, 50, 51, 60, 150, 400])
            at = rng.randrange(max(1, len(b) - n))
            parts += [b[at:at + n], "".join(rng.choice("xyz") for _ in range(rng.randrange(4)))]
        rows.append((k, "".join(parts)))
    assert check(spark, rows) > 5000


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert check(spark, [(r.doc_id, r.text) for r in docs.collect()]) > 1000


def test_ids(spark):
    t = "this text is a little longer than fifty bytes, so that it counts. "
    rows = [(None, t), (5, t + "tail"), (6, t * 400), (6, t * 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_removed) for r in substring_dedup(docs).collect())
    # of a repeat in one document only what a smaller document holds goes: here t, and at the
    # borders nothing, as no smaller document holds t + t
    assert got[:2] == [(0, 0), (5, len(t))] and got[2] == got[3]
    assert substring_dedup(docs.limit(0)).count() == 0
