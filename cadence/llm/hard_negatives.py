"""Hard-negative mining by a vertical scan of branch-and-bound ("BOND") kind.

Vectors stand dimension by dimension, each dimension with its smallest and largest value. An anchor
reads the dimensions in the order of its own components, largest magnitude first. What the unread
dimensions can still add to an inner product lies between the sums of their smallest and largest
contributions, so every candidate has an interval; those whose interval cannot matter any more
leave the bitmap. Two scans: the first finds each anchor's positives, the second the best
candidates inside the score window of each positive.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadence.llm.common import arrow_schema, id_back, id_key, shuffle_partitions, stage
from cadence.llm.vectors import matrix, widen

#: Dimensions of one step; vectors a task holds, at most and at least (about); anchors of a block;
#: vectors of a tile.
STEP, HELD, LEAST, ANCHORS, TILE = 8, 40_000, 2000, 256, 8192
#: Below this share of live candidates the bitmap becomes a list.
SPARSE = 0.3
LIMIT = 1 << 62
#: Doubles hold every integer up to here.
EXACT = 1 << 53


class Tile:
    """Vectors in vertical layout: a row for each dimension, with its smallest and largest value."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, values: np.ndarray):
        self.ids, self.labels, self.whole = ids, labels, values
        self.down = np.ascontiguousarray(values.T, np.float64)
        self.low, self.high = self.down.min(axis=1), self.down.max(axis=1)
        self.reach = np.maximum(np.abs(self.low), np.abs(self.high))

    def scan(self, anchor: np.ndarray, alive: np.ndarray,
             matters: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Places and inner products of the candidates that are alive at the end.

        ``matters(low, high)`` says of each candidate whether its interval can still matter. Every
        value is an integer, and all of them stay exact in doubles (larger ones go another way).
        """
        dims = min(len(anchor), len(self.down))
        a = anchor[:dims].astype(np.float64)
        if np.abs(a) @ self.reach[:dims] >= EXACT:
            at = np.flatnonzero(alive)
            s = self.whole[at][:, :dims].astype(object) @ anchor[:dims].astype(object)
            return at, np.array([min(max(x, -LIMIT), LIMIT) for x in s], np.int64)
        order = np.argsort(-np.abs(a), kind="stable")
        order = order[a[order] != 0]  # a zero adds nothing
        ends = a[order] * self.low[order], a[order] * self.high[order]
        rest = [np.append(np.cumsum(e[::-1])[::-1], 0.0)
                for e in (np.minimum(*ends), np.maximum(*ends))]
        at = np.flatnonzero(alive)
        wide = len(at) > SPARSE * len(alive)  # scores of the whole tile, or only those of ``at``
        s = np.zeros(len(alive) if wide else len(at))
        for lo in range(0, len(order), STEP):
            part, hi = order[lo:lo + STEP], min(lo + STEP, len(order))
            if wide:
                s += a[part] @ self.down[part]
                now = s[at]
            else:
                s += a[part] @ self.down[np.ix_(part, at)]
                now = s
            keep = matters(now + rest[0][hi], now + rest[1][hi])
            if not keep.all():
                at = at[keep]
                if not wide:
                    s = s[keep]
                elif len(at) <= SPARSE * len(alive):
                    s, wide = s[at], False
            if not len(at):
                break
        return at, (s[at] if wide else s).astype(np.int64)


def best(names: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: higher scores first, ties to smaller names."""
    return np.lexsort((names, ~scores))[:k]  # ~ reverses the order without overflow


class Running:
    """The k best of one window of scores, over several tiles."""

    def __init__(self, k: int, low: float = -np.inf, high: float = np.inf):
        self.k, self.low, self.high = k, low, high
        self.names, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def bar(self) -> float:
        """Scores under it are not wanted."""
        return max(self.low, float(self.scores[-1])) if len(self.scores) == self.k else self.low

    def matters(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether an interval reaches the window, at or above the k-th score sure to be in it."""
        bar = self.bar()
        sure = low[(low >= bar) & (high <= self.high)]
        if len(sure) > self.k:
            bar = max(bar, np.partition(sure, len(sure) - self.k)[len(sure) - self.k])
        return (high >= bar) & (low <= self.high)

    def take(self, names: np.ndarray, scores: np.ndarray) -> None:
        into = (scores >= self.low) & (scores <= self.high)
        names = np.concatenate([self.names, names[into]])
        scores = np.concatenate([self.scores, scores[into]])
        top = best(names, scores, self.k)
        self.names, self.scores = names[top], scores[top]


PACKED = "slot int, kind int, n int, ids binary, labels binary, vals binary, windows binary"


def _pack(kind: int, slots: int, scale: float):
    """Candidates (kind 0) go to their slot; blocks of anchors (kind 1) to every slot, with the
    places, ids, scores and windows (lowest, highest score) of their positives."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(PACKED)
        for b in batches:
            good, x = matrix(b.column("v"))
            v = np.clip(np.floor(scale * x[good]), -LIMIT, LIMIT).astype(np.int64)
            ids, labels = (np.asarray(b.column(c))[good] for c in ("k", "l"))
            if kind == 0:
                slot = np.asarray(b.column("slot"))[good]
                order = np.argsort(slot, kind="stable")
                cuts = np.flatnonzero(np.diff(slot[order])) + 1
                groups = [(int(slot[g[0]]), g) for g in np.split(order, cuts) if len(g)]
                windows = [b""] * len(groups)
            else:
                blocks = [np.arange(lo, min(lo + ANCHORS, len(ids)))
                          for lo in range(0, len(ids), ANCHORS)]
                groups = [(s, g) for g in blocks for s in range(slots)]
                told = [[]] * len(good)
                if "positives" in b.schema.names:
                    told = b.column("positives").to_pylist()
                told = [t for t, ok in zip(told, good) if ok]
                windows = [_windows([told[i] for i in g]) for _, g in groups]
            for lo in range(0, len(groups), 64):
                part = groups[lo:lo + 64]
                cols = ([s for s, _ in part], [kind] * len(part), [len(g) for _, g in part],
                        [ids[g].tobytes() for _, g in part], [labels[g].tobytes() for _, g in part],
                        [v[g].tobytes() for _, g in part], windows[lo:lo + 64])
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, schema)],
                                      schema=schema)
    return run


def _windows(told: list[list[dict]]) -> bytes:
    """(anchor's place, positive's place, id, score, lowest, highest) of each positive."""
    rows = [(i, p["place"], p["c"], p["score"], p["low"], p["high"])
            for i, ps in enumerate(told) for p in ps]
    return np.array(rows, np.int64).reshape(-1, 6).tobytes()


def _unpack(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = [np.frombuffer(r["vals"], np.int64).reshape(r["n"], -1) for r in rows]
    width = max(p.shape[1] for p in parts)
    ids, labels = (np.frombuffer(b"".join(r[c] for r in rows), np.int64) for c in ("ids", "labels"))
    return ids, labels, np.concatenate([widen(p, width) for p in parts])


FOUND = "q long, place int, p long, p_score long, c long, score long"


def _mine(k: int, negatives: bool):
    """A slot's candidates come first, then blocks of anchors: the k best of the anchor's label, or
    of the other labels inside each window."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(FOUND)
        slot, held, tiles = None, [], []
        for b in batches:
            for row in b.to_pylist():
                if row["slot"] != slot:
                    slot, held, tiles = row["slot"], [], []
                if row["kind"] == 0:
                    held.append(row)
                    continue
                if held:
                    cols = _unpack(held)
                    tiles = [Tile(*(c[lo:lo + TILE] for c in cols))
                             for lo in range(0, len(cols[0]), TILE)]
                    held = []
                ids, labels, values = _unpack([row])
                windows = np.frombuffer(row["windows"], np.int64).reshape(-1, 6)
                out = []
                for i, (q, label, v) in enumerate(zip(ids, labels, values)):
                    if negatives:
                        mine = windows[windows[:, 0] == i]
                        runs = [Running(k, w[4], w[5]) for w in mine]
                        heads = [w[1:4] for w in mine]
                    else:
                        runs, heads = [Running(k)], [(0, 0, 0)]
                    for t in tiles if runs else ():
                        alive = (t.labels == label) != negatives
                        alive &= t.ids != q
                        at, s = t.scan(v, alive, lambda lo, hi: np.logical_or.reduce(
                            [r.matters(lo, hi) for r in runs]))
                        for r in runs:
                            r.take(t.ids[at], s)
                    for (place, p, p_score), r in zip(heads, runs):
                        out += [(q, place, p, p_score, c, s) for c, s in zip(r.names, r.scores)]
                if out:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), schema)],
                                          schema=schema)
    return run


def hard_negatives(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5,
                   low: int = 80, high: int = 100, scale: float = 256.0, vec_id: str = "vec_id",
                   embedding: str = "embedding", label: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Components become floor(scale * x); the score of a row is its inner product with the anchor;
    higher scores come first, ties by smaller ids. An anchor's positives are the first ``positives``
    rows of its label. For each positive of score p come the first ``negatives`` rows of another
    label whose score n satisfies low * p <= 100 * n <= high * p: none, if p is negative.

    Rows with a null label, a null vector, or a null or non-finite component take no part, as
    anchors neither. Rows with the anchor's own id are no candidates of it. A null id is one id
    smaller than all others; repeated ids are that many candidates, and a repeated anchor asks
    with its smallest (label, vector). A shorter vector counts as filled up with zeros. Scores are
    held within 62 bits. Other columns are not read. Empty tables give an empty result.

    Scale: candidates are dealt into slots of about ``HELD`` by a hash, whatever their label, and
    stand in a scratch table for both scans; blocks of anchors go to every slot, a task holds one
    slot and one block. Each slot returns at most ``positives`` (then ``positives * negatives``)
    rows an anchor; their merge is a partitioned rank. The work grows with anchors times rows, as
    each anchor asks against all rows.
    """
    spark = vectors.sparkSession
    cols = [id_key(vec_id).alias("k"), F.col(f"`{label}`").cast("long").alias("l"),
            F.col(f"`{embedding}`").cast("array<double>").alias("v")]
    every = vectors.select(*cols).filter("l IS NOT NULL AND v IS NOT NULL")
    asked = (anchors.select(*cols).filter("l IS NOT NULL AND v IS NOT NULL")
             .filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x)
                              & (F.abs(x) < F.lit(float("inf")))))
             .groupBy("k").agg(F.min(F.struct("l", "v")).alias("m")).select("k", "m.l", "m.v"))
    total = every.count()
    slots = max(1, min(shuffle_partitions(spark), -(-total // LEAST)), -(-total // HELD))
    every = every.withColumn("slot", F.pmod(F.xxhash64("k", "l", "v"), F.lit(slots)).cast("int"))
    every = stage(every.mapInArrow(_pack(0, slots, scale), PACKED), "hard-negative-slots")

    def scan(blocks: DataFrame, k: int, wanted: bool) -> DataFrame:
        packed = every.union(blocks.mapInArrow(_pack(1, slots, scale), PACKED))
        found = (packed.repartitionById(slots, "slot").sortWithinPartitions("slot", "kind")
                 .mapInArrow(_mine(k, wanted), FOUND))
        rank = F.row_number().over(W.partitionBy("q", "place").orderBy(F.desc("score"), "c"))
        return found.withColumn("rank", rank).filter(F.col("rank") <= k)

    score = F.col("score").cast("decimal(20,0)")
    first = (scan(asked, positives, False)
             .withColumn("low", F.ceil(score * low / 100).cast("long"))
             .withColumn("high", F.floor(score * high / 100).cast("long")).filter("low <= high")
             .groupBy("q").agg(F.sort_array(F.collect_list(F.struct(
                 F.col("rank").alias("place"), "c", "score", "low", "high"))).alias("positives")))
    second = scan(asked.join(first, F.col("k") == F.col("q")).drop("q"), negatives, True)
    return second.select(id_back(F.col("q")).alias("anchor_id"), id_back(F.col("p")).alias("positive_id"),
                         "rank", id_back(F.col("c")).alias("negative_id"),
                         F.col("p_score").alias("positive_score"), F.col("score").alias("negative_score"))
