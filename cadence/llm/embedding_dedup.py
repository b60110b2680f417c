"""Embedding near-dedup by collision-counting projections.

Every vector is projected on many random lines. Two vectors collide on a line if the projection
of one lies in the window centred at the other's. Vectors are sorted by the first line and cut
into slots; a block of vectors meets the slots that its wide first window reaches; there the
collisions of each pair on the other lines are counted, and pairs with enough of them are verified
by their cosine in double precision.

Calibration: two unit vectors with cosine c are sqrt(2 - 2c) apart, and a Gaussian line shows that
distance times a standard normal number. So the chance that a pair at the threshold misses a
window, and misses too many of them, is known and the same for all data.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.llm.common import arrow_schema, id_back, id_key, shuffle_partitions, stage
from cadence.llm.components import components
from cadence.llm.vectors import matrix, widen

#: Lines that are counted; half windows in standard deviations of a pair at the threshold, on the
#: sorted line and on the others; collisions that a pair needs. A pair at the threshold is lost
#: with a chance under 6e-7 on the sorted line and 5e-7 on the others (5 of 16 windows missed,
#: each 1 in 100); a closer pair far more rarely.
LINES, FIRST_WINDOW, WINDOW, NEEDED = 16, 5.0, 2.576, 12
#: Vectors of a block, of a slot, and of a tile of the counting.
BLOCK, SLOT, TILE = 512, 16_000, 2048
SEED = 11


def lines(width: int) -> np.ndarray:
    """(LINES + 1, width) directions; those of a shorter width are a prefix of these."""
    out = np.empty((LINES + 1, width))
    for j in range(width):
        out[:, j] = np.random.default_rng([SEED, j]).standard_normal(LINES + 1)
    return out


UNIT = "k long, usable boolean, place double, unit binary"


def _unit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        good, x = matrix(b.column("v"))
        top = np.abs(x).max(axis=1, initial=0)
        good &= top > 0
        x[good] /= top[good, None]  # so that squares neither overflow nor vanish
        x[good] /= np.sqrt((x[good] ** 2).sum(axis=1))[:, None]
        place = x @ lines(x.shape[1])[0]
        x = np.ascontiguousarray(x) + 0.0
        # trailing zeros say nothing: vectors that differ by them alone are equal
        last = x.shape[1] - np.argmax((x != 0)[:, ::-1], axis=1) if x.shape[1] else np.zeros(len(x), int)
        unit = [x[i, :last[i]].tobytes() if g else None for i, g in enumerate(good)]
        yield pa.record_batch([b.column("k"), pa.array(good), pa.array(place),
                               pa.array(unit, pa.binary())], schema=arrow_schema(UNIT))


def _rows(units: list[bytes]) -> np.ndarray:
    parts = [np.frombuffer(u) for u in units]
    out = np.zeros((len(parts), max(map(len, parts))))
    for row, p in zip(out, parts):
        row[:len(p)] = p
    return out


BLOCKED = "slot int, kind int, source int, n int, ids binary, weights binary, places binary, vals binary"


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted vectors packed into blocks; the slot is the range of the sorted line."""
    slot, schema = TaskContext.get().partitionId(), arrow_schema(BLOCKED)
    for b in batches:
        for lo in range(0, b.num_rows, BLOCK):
            p = b.slice(lo, BLOCK)
            x = _rows(p.column("unit").to_pylist())
            cols = [[slot], [0], [slot], [p.num_rows],
                    *([np.asarray(p.column(c)).tobytes()] for c in ("rep", "w", "place")),
                    [x.tobytes()]]
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, schema)],
                                  schema=schema)


def _copies(starts: np.ndarray, ends: np.ndarray, reach: float):
    """Each block once more for every other slot that its window reaches. A pair of slots meets in
    one of the two: the higher one if the sum of their numbers is even, else the lower."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                own = row.column("slot")[0].as_py()
                places = np.frombuffer(row.column("places")[0].as_py())
                near = np.flatnonzero((starts <= places.max() + reach)
                                      & (ends >= places.min() - reach))
                even = (near + own) % 2 == 0
                for s in near[((near > own) & even) | ((near < own) & ~even)].tolist():
                    yield (row.set_column(0, "slot", pa.array([s], pa.int32()))
                           .set_column(1, "kind", pa.array([1], pa.int32())))
    return run


class Side:
    """Unpacked blocks: ids, weights, unit vectors and their places on all lines."""

    def __init__(self, rows: list[dict]):
        vals = [np.frombuffer(r["vals"]).reshape(r["n"], -1) for r in rows]
        width = max(v.shape[1] for v in vals)
        self.x = np.concatenate([widen(v, width) for v in vals])
        self.ids, self.weights = (np.frombuffer(b"".join(r[c] for r in rows), np.int64)
                                  for c in ("ids", "weights"))
        self.at = (lines(width) @ self.x.T).astype(np.float32)  # a row for each line

    def part(self, lo: int, hi: int) -> Side:
        out = object.__new__(Side)
        out.x, out.at = self.x[lo:hi], self.at[:, lo:hi]
        out.ids, out.weights = self.ids[lo:hi], self.weights[lo:hi]
        return out


def _linked(a: Side, b: Side, cosine: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``a`` and ``b`` that are linked; with ``same`` each pair once."""
    unit = math.sqrt(2 - 2 * cosine)
    gap = lambda i: np.abs(a.at[i][:, None] - b.at[i][None, :])
    count = np.zeros((len(a.ids), len(b.ids)), np.int8)
    for i in range(1, LINES + 1):
        count += gap(i) <= np.float32(WINDOW * unit + 1e-5)
    passed = (count >= NEEDED) & (gap(0) <= np.float32(FIRST_WINDOW * unit + 1e-5))
    if same:
        passed &= np.arange(len(a.ids))[:, None] < np.arange(len(b.ids))[None, :]
    r, c = np.nonzero(passed)
    if len(r) * 8 > passed.size:  # a dense block of near copies
        width = max(a.x.shape[1], b.x.shape[1])
        ok = (widen(a.x, width) @ widen(b.x, width).T)[r, c] >= cosine
    else:
        width = min(a.x.shape[1], b.x.shape[1])
        ok = np.einsum("ij,ij->i", a.x[r][:, :width], b.x[c][:, :width]) >= cosine
    return r[ok], c[ok]


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the same components as the links (a, b): every id with the smallest id that
    these links reach."""
    ids, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = np.split(flat, 2)
    label = np.arange(len(ids))
    while True:
        low = label.copy()
        np.minimum.at(low, u, label[v])
        np.minimum.at(low, v, label[u])
        low = low[low]
        if (low == label).all():
            return ids, ids[label]
        label = low


FOUND = "kind int, a long, b long"


def _compare(cosine: float):
    """A slot's vectors first, then the blocks that come to it. Emits (0, id, links) and forest
    edges (1, id, smallest id): a row or two for each vector, never the pairs."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(FOUND)
        slot, held, side = None, [], None

        def meet(a: Side, b: Side, same: bool) -> Iterator[pa.RecordBatch]:
            for lo in range(0, len(b.ids), TILE):
                tile = b.part(lo, lo + TILE)
                r, c = _linked(a, tile, cosine, same)
                if len(r):
                    more = [np.bincount(r, tile.weights[c], len(a.ids)),
                            np.bincount(c, a.weights[r], len(tile.ids))]
                    ids = np.concatenate([a.ids, tile.ids])
                    n = np.concatenate(more).astype(np.int64)
                    u, v = _stars(a.ids[r], tile.ids[c])
                    out = ([0] * int((n > 0).sum()) + [1] * len(u),
                           np.concatenate([ids[n > 0], u]), np.concatenate([n[n > 0], v]))
                    yield pa.record_batch([pa.array(x, f.type) for x, f in zip(out, schema)],
                                          schema=schema)

        def inside(rows: list[dict]) -> Iterator[pa.RecordBatch]:
            parts = [Side([r]) for r in rows]
            for i, a in enumerate(parts):
                yield from meet(a, a, True)
                if parts[i + 1:]:
                    yield from meet(a, Side(rows[i + 1:]), False)

        for b in batches:
            for row in b.to_pylist():
                if row["slot"] != slot:
                    if held:
                        yield from inside(held)
                    slot, held, side = row["slot"], [], None
                if row["kind"] == 0:
                    held.append(row)
                    continue
                if held:
                    yield from inside(held)
                    side, held = Side(held), []
                if side is not None:
                    yield from meet(Side([row]), side, False)
        if held:
            yield from inside(held)
    return run


def near_vectors(vectors: DataFrame, cosine: float = 0.95, vec_id: str = "vec_id",
                 embedding: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``.

    Two rows are linked if the cosine of their vectors is ``cosine`` at least. n_links counts the
    other rows linked to a row; component_id is the smallest id that links reach; kept marks it.
    Vectors that are null, all zeros, or hold a null or non-finite component have no links. A
    shorter vector counts as filled up with zeros. A null id is one id smaller than all others;
    rows that repeat an id count as rows, and share one component. Other columns are not read. An
    empty table gives an empty result.

    Equal directions become one row with a weight before anything is compared, so a large group
    of exact copies costs one vector. A slot holds about ``SLOT`` vectors and a block ``BLOCK``,
    whatever their values. What leaves a comparison is counts and forest edges, a few rows a
    vector even where thousands of vectors are near copies of each other. The pairs that are
    counted are those within the first window: about three in four for vectors in all directions,
    so the work grows with the square of the number of distinct vectors; see the README.
    """
    spark = vectors.sparkSession
    d = vectors.select(id_key(vec_id).alias("k"), F.col(f"`{embedding}`").alias("v"))
    unit = stage(d.mapInArrow(_unit, UNIT), "unit-vectors")
    reps = (unit.filter("usable").groupBy("unit")
            .agg(F.min("k").alias("rep"), F.count("*").alias("w"), F.first("place").alias("place")))
    reps = stage(reps, "representatives")
    slots = max(shuffle_partitions(spark), -(-reps.count() // SLOT))
    blocks = (reps.repartitionByRange(slots, "place", "rep").sortWithinPartitions("place")
              .mapInArrow(_blocks, BLOCKED))
    blocks = stage(blocks, "blocks")
    ends = blocks.mapInArrow(_slot_ends, "slot int, lo double, hi double")
    ends = ends.groupBy("slot").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()
    known = 1 + max((r.slot for r in ends), default=-1)  # two numbers for each range we chose
    starts, stops = np.full(known, np.inf), np.full(known, -np.inf)
    for r in ends:
        starts[r.slot], stops[r.slot] = r.lo, r.hi
    reach = FIRST_WINDOW * math.sqrt(2 - 2 * cosine) + 1e-5
    copies = blocks.mapInArrow(_copies(starts, stops, reach), BLOCKED)
    found = stage(blocks.union(copies).repartitionById(slots, "slot")
                  .sortWithinPartitions("slot", "kind").mapInArrow(_compare(cosine), FOUND),
                  "found")
    more = found.filter("kind = 0").groupBy("a").agg(F.sum("b").alias("more"))
    classes = stage(reps.join(more, reps.rep == more.a, "left").select(
        "unit", "rep", (F.col("w") - 1 + F.coalesce("more", F.lit(0))).alias("links")), "classes")
    rows = unit.join(classes, "unit", "left").select("k", "rep", "links")
    rows = stage(rows, "rows")
    own = rows.filter("rep is not null").select(F.col("k").alias("a"), F.col("rep").alias("b"))
    comp = components(found.filter("kind = 1").select("a", "b").union(own), "a", "b")
    out = rows.join(comp, rows.k == comp.id, "left").select(
        "k", F.coalesce("links", F.lit(0)).alias("n"), F.coalesce("component", "k").alias("c"))
    return out.select(id_back(F.col("k")).alias("vec_id"), F.col("n").alias("n_links"),
                      id_back(F.col("c")).alias("component_id"), (F.col("k") == F.col("c")).alias("kept"))


def _slot_ends(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        places = [np.frombuffer(p) for p in b.column("places").to_pylist()]
        yield pa.record_batch([b.column("slot"), pa.array([p.min() for p in places], pa.float64()),
                               pa.array([p.max() for p in places], pa.float64())],
                              names=["slot", "lo", "hi"])
