"""Spelling variant grouping with PartEnum signatures.

A word is the multiset of its letters, seen as a binary vector with one place for each letter and
occurrence number. One replaced code point changes two places, one inserted or deleted code point
one place. The places are parted into ``PARTS`` (``PARTS_NEXT``) groups; vectors that differ in two
(one) places agree on all groups but some two (one), so the signatures of all those choices are
exact: equal ones are joined, and the pairs verified by their edit distance.

Buckets of more than ``HOT`` words are not joined: their words meet again by what is left of them
without one code point, in buckets that the alphabet bounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.llm.common import UPPER, arrow_schema, stage

#: Groups of places for words of the same length (two places differ) and for words whose lengths
#: differ by one (one place differs).
PARTS, PARTS_NEXT = 6, 4
#: Words of a bucket that are compared with each other.
HOT = 1024
#: How many times as often a word's form must occur.
RATIO = 5
#: Roles in a bucket: same length, the longer word, the shorter word.
SAME, LONGER, SHORTER = 0, 1, 2

_MASK = (1 << 64) - 1


def _mix(*numbers: int) -> int:
    """A 64-bit hash of a few numbers."""
    h = 0x9E3779B97F4A7C15
    for n in numbers:
        h = ((h ^ n) * 0xBF58476D1CE4E5B9) & _MASK
        h ^= h >> 29
    return h - (1 << 64) if h >> 63 else h


def signatures(word: str) -> Iterator[tuple[int, int]]:
    """(signature, role) of a word. A group's places are summed as hashes, whatever their order;
    words that meet by a collision only are told apart when they are verified."""
    same, near = [0] * PARTS, [0] * PARTS_NEXT
    seen: dict[str, int] = {}
    for c in word:
        k = seen[c] = seen.get(c, 0) + 1
        place = _mix(ord(c), k) & _MASK
        same[(ord(c) + k) % PARTS] += place
        near[(ord(c) + k) % PARTS_NEXT] += place
    n, total = len(word), sum(same)
    for i, j in combinations(range(PARTS), 2):
        yield _mix(SAME, n, i, j, (total - same[i] - same[j]) & _MASK), SAME
    for i in range(PARTS_NEXT):
        left = (total - near[i]) & _MASK
        yield _mix(LONGER, n - 1, i, left), LONGER
        yield _mix(LONGER, n, i, left), SHORTER


_BASE = np.uint64(0x5851F42D4C957F2D)


def remainders(word: str) -> Iterator[tuple[int, int]]:
    """(key, role) of a word by what is left of it without one code point.

    Words of one length that differ at one place are equal without it; a word that is one code point
    shorter is what is left of the longer one. Polynomial hashes give all of them in linear time."""
    c = np.array([ord(x) for x in word], np.uint64)
    n = len(c)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.append(np.uint64(1), np.full(n, _BASE)))
        whole = np.cumsum(c * powers[1:])
        moved = np.append(np.cumsum((c * powers[:-1])[::-1])[::-1], np.uint64(0))
        left = np.append(np.uint64(0), whole[:-1]) + moved[1:]
    for p, h in enumerate(left.tolist()):
        yield _mix(SAME, n, p, h), SAME
    for h in set(left.tolist()):
        yield _mix(LONGER, n - 1, h), LONGER
    yield _mix(LONGER, n, int(whole[-1])), SHORTER


KEYED = "key long, role int, word string, n long"


def _keyed(of: Callable[[str], Iterator[tuple[int, int]]]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(KEYED)
        for b in batches:
            words, n = b.column("word"), b.column("n")
            keys, roles, rows = [], [], []
            for i, w in enumerate(words.to_pylist()):
                for key, role in of(w):
                    keys.append(key)
                    roles.append(role)
                    rows.append(i)
                if len(rows) > 1 << 17 or i + 1 == len(words):
                    yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(roles, pa.int32()),
                                           words.take(pa.array(rows, pa.int32())),
                                           n.take(pa.array(rows, pa.int32()))], schema=schema)
                    keys, roles, rows = [], [], []
    return run


def _meet(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs (a, na, b, nb) of one key that are one edit apart."""
    a = left.filter(F.col("role") != SHORTER).select("key", F.col("role").alias("ra"), F.col("word").alias("a"),
                                                     F.col("n").alias("na"))
    b = right.filter(F.col("role") != LONGER).select("key", F.col("role").alias("rb"), F.col("word").alias("b"),
                                                     F.col("n").alias("nb"))
    met = a.join(b, "key").filter(((F.col("ra") == SAME) & (F.col("rb") == SAME) & (F.col("a") < F.col("b")))
                                  | ((F.col("ra") == LONGER) & (F.col("rb") == SHORTER)))
    return met.filter(F.levenshtein("a", "b", 1) == 1).select("a", "na", "b", "nb")


def near_words(words: DataFrame) -> DataFrame:
    """(a, na, b, nb): each pair of different words of (word, n) that are one inserted, deleted or
    replaced code point apart, once. ``word`` must be distinct, and neither null nor empty.

    Scale: rows grow with the words. Each bucket of signatures yields at most ``HOT`` squared
    comparisons, inside the join; a hot one's words go on with buckets of remainders, which hold one
    word for each letter of the alphabet (or, for a remainder that is a word, one for each letter and
    place). Nothing is dropped, and no bucket's pairs are written but those that are near."""
    keyed = stage(words.select("word", "n").mapInArrow(_keyed(signatures), KEYED), "word-signatures")
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    sized = keyed.join(sizes, "key")
    small = sized.filter(F.col("size") <= HOT)
    hot = sized.filter(F.col("size") > HOT).groupBy("word").agg(F.first("n").alias("n"))
    left = stage(hot.mapInArrow(_keyed(remainders), KEYED), "word-remainders")
    return _meet(small, small).union(_meet(left, left)).dropDuplicates(["a", "b"])


def count_words(runs: DataFrame, min_chars: int = 6, min_count: int = 5) -> DataFrame:
    """(word, n) of a column ``word``: words of enough code points that occur often enough. A null
    word is none. Counts are combined map-side, so a very common word is one row a task."""
    return (runs.filter(F.length("word") >= min_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") >= min_count))


def runs_of(text: Column, at_least: int = 6) -> Column:
    """The maximal runs of letters (A-Z, a-z, U+00C0 to U+00FF) of a text that have ``at_least``
    code points, A-Z in lower case."""
    found = F.regexp_extract_all(text, F.lit(f"[A-Za-zÀ-ÿ]{{{at_least},}}"), F.lit(0))
    return F.transform(found, lambda w: F.translate(w, UPPER, UPPER.lower()))


def group_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root (string), n, n_near, form_n (long) of each row of (word, n).

    Near words are one inserted, deleted or replaced code point apart. A word's form is its near
    word of largest n (ties: smallest in code-point order) if that is at least ``ratio`` times its
    own n; else null, as form_n. root follows the forms to the last one; without a form it is the
    word itself. n_near counts near words. An empty table gives an empty result; words must be
    distinct, with n above 0.

    Scale: a word has a bounded number of near words (each place and letter), so neither a word nor
    a form is a hot key. Forms grow by ``ratio`` at each step, so that doubling the steps followed
    ends after five rounds at most (two and more: ``ratio`` above 1)."""
    if ratio < 2:
        raise ValueError("forms must occur twice as often at least, or chains would not end")
    words = stage(words.select("word", "n"), "words")
    pairs = near_words(words)
    both = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("nb").alias("m")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("na").alias("m")))).alias("x")).select("x.*")
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"),
                                    F.min(F.struct((-F.col("m")).alias("less"), "other")).alias("best"))
    formed = F.coalesce(-F.col("best.less") >= ratio * F.col("n"), F.lit(False))
    found = stage(words.join(best, "word", "left").select(
        "word", F.when(formed, F.col("best.other")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(formed, -F.col("best.less")).alias("form_n")), "word-forms")
    ends = found.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:  # after i rounds every word has gone 2^i steps, or to its end
        further = ends.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ends = stage(ends.join(further, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("went")), "word-roots")
        if ends.filter("went").isEmpty():
            break
        ends = ends.drop("went")
    return (found.join(ends.drop("went"), "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
