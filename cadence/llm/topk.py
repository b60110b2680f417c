"""Exact top-k search by columnar branch and bound.

Candidates stand in vertical layout, dimension by dimension. For a block of queries the inner
products grow one block of dimensions at a time. What the missing dimensions can still add or take
is at most the product of the two remaining norms, so each query has a lower bound for its k-th
score, and candidates whose upper bound is below it go. When few are left, the survivors are
compacted into pairs and finished alone.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadence.llm.common import arrow_schema, id_back, id_key, shuffle_partitions
from cadence.llm.vectors import matrix, widen

#: Dimensions of one step; candidates a task holds, at most and at least (about); queries of a
#: block; candidates of a tile.
DIMS, HELD, LEAST, QUERIES, TILE = 8, 40_000, 2000, 256, 4096
#: The survivors are compacted when they are under this share.
SPARSE = 0.15
LIMIT = 1 << 62


def quantise(x: np.ndarray) -> np.ndarray:
    """floor(64 * x), held within 62 bits."""
    return np.clip(np.floor(64 * x), -LIMIT, LIMIT).astype(np.int64)


def _rest(v: np.ndarray) -> np.ndarray:
    """(rows, steps + 1): norm of the dimensions from each step on, rounded up."""
    cuts = np.arange(0, v.shape[1] + DIMS, DIMS)
    square = np.concatenate([np.zeros((len(v), 1)), np.cumsum(v[:, ::-1] ** 2, axis=1)], axis=1)
    return np.sqrt(square[:, np.maximum(v.shape[1] - cuts, 0)]) * (1 + 1e-9)


def _exact_large(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Scores that doubles cannot hold, with Python integers, held within 64 bits."""
    s = q.astype(object) @ c.astype(object).T
    return np.clip(s, -(1 << 63), (1 << 63) - 1).astype(np.int64)


class Candidates:
    """Vectors of one slot: ids, and values by dimension."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        self.ids, self.whole = ids, values
        self.large = np.abs(values).max(initial=0)
        self.down = np.ascontiguousarray(values.T, np.float64)  # a row for each dimension
        self.rest = _rest(values.astype(np.float64))

    def top(self, ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
        """query ids, candidate ids, scores of each query's k best here, ties to smaller ids."""
        width = max(q.shape[1], self.whole.shape[1])
        if np.abs(q).max(initial=0) * float(self.large) * max(1, width) >= 1 << 53:
            s = _exact_large(widen(q, width), widen(self.whole, width))
            pairs = [self._best(ids[i], s[i], np.arange(len(self.ids)), k) for i in range(len(q))]
            return tuple(np.concatenate(x) for x in zip(*pairs))
        dims = min(q.shape[1], self.whole.shape[1])  # beyond them one side is zero
        qf = q[:, :dims].astype(np.float64)
        q_rest = _rest(qf)
        own = self.ids[None, :] == ids[:, None]
        alive = ~own
        s = np.zeros(alive.shape)
        for step, lo in enumerate(range(0, dims, DIMS)):
            s += qf[:, lo:lo + DIMS] @ self.down[lo:lo + DIMS][:, :]
            spread = q_rest[:, step + 1, None] * self.rest[None, :, min(step + 1, self.rest.shape[1] - 1)]
            if alive.shape[1] > k:
                low = np.where(alive, s - spread, -np.inf)
                bar = np.partition(low, alive.shape[1] - k, axis=1)[:, alive.shape[1] - k]
                alive &= s + spread >= bar[:, None]
            if lo + DIMS < dims and alive.mean() < SPARSE:
                r, c = np.nonzero(alive)
                tail = np.arange(lo + DIMS, dims)
                part = s[r, c]
                for a in range(0, len(r), 1 << 16):
                    x = slice(a, a + (1 << 16))
                    part[x] += np.einsum("ij,ij->i", qf[r[x]][:, tail], self.whole[c[x]][:, tail])
                s[r, c] = part
                break
        pairs = [self._best(ids[i], s[i, c := np.flatnonzero(alive[i])].astype(np.int64), c, k)
                 for i in range(len(q))]
        return tuple(np.concatenate(x) for x in zip(*pairs))

    def _best(self, query: int, scores: np.ndarray, at: np.ndarray, k: int):
        keep = self.ids[at] != query
        scores, names = scores[keep], self.ids[at][keep]
        order = np.lexsort((names, ~scores))[:k]  # ~ reverses the order without overflow
        return np.full(len(order), query), names[order], scores[order]


PACKED = "slot int, kind int, n int, ids binary, vals binary"


def _pack(kind: int, slots: int):
    """Candidates (kind 0) go to the slot of their id's hash; query blocks (kind 1) to all."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(PACKED)
        for b in batches:
            good, x = matrix(b.column("v"))
            ids, v = np.asarray(b.column("k"))[good], quantise(x[good])
            slot = np.asarray(b.column("slot"))[good]
            if kind == 0:
                order = np.argsort(slot, kind="stable")
                cuts = np.flatnonzero(np.diff(slot[order])) + 1
                groups = [(int(slot[g[0]]), g) for g in np.split(order, cuts) if len(g)]
            else:
                blocks = [np.arange(lo, min(lo + QUERIES, len(ids)))
                          for lo in range(0, len(ids), QUERIES)]
                groups = [(s, g) for g in blocks for s in range(slots)]
            for lo in range(0, len(groups), 64):
                part = groups[lo:lo + 64]
                cols = ([s for s, _ in part], [kind] * len(part), [len(g) for _, g in part],
                        [ids[g].tobytes() for _, g in part], [v[g].tobytes() for _, g in part])
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, schema)],
                                      schema=schema)
    return run


def _unpack(ids: list[bytes], vals: list[bytes], ns: list[int]) -> tuple[np.ndarray, np.ndarray]:
    parts = [np.frombuffer(v, np.int64).reshape(n, -1) for v, n in zip(vals, ns)]
    width = max(p.shape[1] for p in parts)
    return np.frombuffer(b"".join(ids), np.int64), np.concatenate([widen(p, width) for p in parts])


def _search(k: int):
    """A slot's candidates first, then query blocks, each answered against the whole slot."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema("q long, c long, score long")
        slot, held, tables = None, [], []
        for b in batches:
            for row in b.to_pylist():
                if row["slot"] != slot:
                    slot, held, tables = row["slot"], [], []
                if row["kind"] == 0:
                    held.append(row)
                    continue
                if held:
                    ids, vals = _unpack(*([h[c] for h in held] for c in ("ids", "vals", "n")))
                    tables = [Candidates(ids[lo:lo + TILE], vals[lo:lo + TILE])
                              for lo in range(0, len(ids), TILE)]
                    held = []
                ids, q = _unpack([row["ids"]], [row["vals"]], [row["n"]])
                found = [t.top(ids, q, k) for t in tables]
                if found:
                    yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*found)],
                                          schema=schema)
    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, vec_id: str = "vec_id",
          embedding: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` best rows of ``vectors`` for each query.

    Components become floor(64 * x); the score is their inner product; ties go to smaller ids; a
    query's own id is no candidate of it. Vectors that are null or hold a null or non-finite
    component take no part. A shorter vector counts as filled up with zeros. A null id is one id
    smaller than all others; a repeated candidate id is that many candidates; of a repeated query
    id the smallest vector asks. Other columns are not read. Empty tables give an empty result.

    Scale: candidates are dealt into slots of about ``HELD`` by the hash of their id, query blocks
    go to every slot, and a task holds one slot and one block. Each slot returns k rows a query;
    their merge is a partitioned rank.
    """
    spark = vectors.sparkSession
    cols = [id_key(vec_id).alias("k"), F.col(f"`{embedding}`").alias("v")]
    every, asked = vectors.select(*cols), queries.select(*cols)
    total = every.count()
    slots = max(1, min(shuffle_partitions(spark), -(-total // LEAST)), -(-total // HELD))
    every = every.withColumn("slot", F.pmod(F.xxhash64("k", "v"), F.lit(slots)).cast("int"))
    asked = asked.groupBy("k").agg(F.min("v").alias("v")).withColumn("slot", F.lit(0))
    packed = (every.mapInArrow(_pack(0, slots), PACKED)
              .union(asked.mapInArrow(_pack(1, slots), PACKED)))
    found = (packed.repartitionById(slots, "slot").sortWithinPartitions("slot", "kind")
             .mapInArrow(_search(k), "q long, c long, score long"))
    rank = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "c"))
    return (found.withColumn("rank", rank).filter(F.col("rank") <= k)
            .select(id_back(F.col("q")).alias("query_id"), "rank",
                    id_back(F.col("c")).alias("vec_id"), "score"))
