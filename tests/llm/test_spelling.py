"""Spelling variants against all pairs."""

import random
import re
import zlib
from collections import Counter

from cadence.llm import spelling
from cadence.llm.spelling import group_variants, near_words, remainders, signatures

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(counts, ratio=5):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        top = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = top if top is not None and counts[top] >= ratio * counts[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])
    return sorted((w, form[w], root(w), counts[w], len(near[w]), counts.get(form[w])) for w in counts)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def edited(rng, w, alphabet):
    i, c = rng.randrange(len(w)), rng.choice(alphabet)
    return rng.choice([w[:i] + w[i + 1:], w[:i] + c + w[i:], w[:i] + c + w[i + 1:]])


def vocabulary(rng, size, alphabet="abceéï"):
    words = {"".join(rng.choice(alphabet) for _ in range(rng.randrange(6, 10))) for _ in range(size // 3)}
    while len(words) < size:
        words.add(edited(rng, rng.choice(sorted(words)), alphabet))
    return {w: int(5 * 1.8 ** rng.randrange(0, 16)) for w in sorted(words)}


def test_signatures_are_exact():
    rng = random.Random(1)
    for alphabet in ("ab", "abcdeéïxyz"):
        for _ in range(3000):
            a = "".join(rng.choice(alphabet) for _ in range(rng.randrange(6, 12)))
            b = edited(rng, a, alphabet)
            if a == b:
                continue
            a, b = sorted((a, b), key=len, reverse=True)
            for keys in (signatures, remainders):
                x, y = set(keys(a)), set(keys(b))
                if len(a) == len(b):
                    assert {k for k, r in x if r == 0} & {k for k, r in y if r == 0}
                else:
                    assert {k for k, r in x if r == 1} & {k for k, r in y if r == 2}
    assert len(list(signatures("spelling"))) == 15 + 8


def test_variants_against_all_pairs(spark):
    counts = vocabulary(random.Random(2), 1500)
    words = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    got = rows(group_variants(words))
    want = brute(counts)
    assert got == want and sum(r[1] is not None and r[2] != r[1] for r in want) > 10
    assert rows(group_variants(words, ratio=2)) == brute(counts, 2)


def test_hot_buckets(spark, monkeypatch):
    """All words are permutations and near permutations of the same letters: one large bucket."""
    monkeypatch.setattr(spelling, "HOT", 8)
    rng = random.Random(3)
    words = set()
    while len(words) < 600:
        w = "".join(rng.sample("abcdefg", 7))
        words |= {w, edited(rng, w, "abcdefgh")}
    counts = {w: rng.choice([5, 30, 200]) for w in words}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    pairs = near_words(df).collect()
    assert len(pairs) == len({frozenset((r.a, r.b)) for r in pairs})
    assert rows(group_variants(df)) == brute(counts)


def of_documents(docs):
    counts = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(UP)
            h = zlib.crc32(f"{i}:{run}".encode()) if i is not None else 1
            counts[run[:h % len(run)] + run[h % len(run) + 1:] if h % 199 == 0 else run] += 1
    return brute({w: n for w, n in counts.items() if len(w) >= 6 and n >= 5})


def test_whole_table(spark, sf):
    from cadence.llm.q_words import op11_spelling
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert rows(op11_spelling(spark, sf)) == of_documents(docs)


def test_odd_documents(spark, tmp_path):
    from cadence.llm.q_words import op11_spelling
    words = ["Straßen", "straßen", "strassen", "STRASSEN", "ÀÉÎõüÿ", "x" * 5000, "x" * 4999, "ábcdefg",
             "foo×bar÷", "don't", "ſtation", "station"]
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice(words) for _ in range(60)), "w") for i in range(400)]
    docs += [(None, "station " * 20, "w"), (7, None, "w"), (8, "", "w"), (9, "nation " * 7 + "stations " * 5, "w")]
    spark.createDataFrame(docs, "doc_id long, text string, word string").write.parquet(f"{tmp_path}/documents.parquet")
    assert rows(op11_spelling(spark, tmp_path)) == of_documents([d[:2] for d in docs])
    empty = spark.createDataFrame([], "word string, n long")
    assert group_variants(empty).collect() == []
