"""MinHash near-dedup with fast similarity sketches, banding and exact verification.

A sketch has ``COORDS`` coordinates. In round i every shingle goes to one hashed bin with a hashed
value; a bin keeps the smallest value of the first round that reached it. After as many rounds as
coordinates, round COORDS + j puts every shingle into bin j, so every coordinate is filled, for
sets of any size. Large sets finish in a few rounds.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadence.llm.common import arrow_schema, free, id_back, id_key, stage, text_slices
from cadence.llm.components import components
from cadence.llm.shingles import U, mix, shingle_sets

#: Bands of ``ROWS`` coordinates: a pair at similarity 0.85 is missed by all 42 bands once in
#: 400 million times, (1 - 0.85**6)**42; a pair at 0.8 three times in a million; a pair at 0.9
#: never in practice.
BANDS, ROWS = 42, 6
COORDS = BANDS * ROWS
#: Members of a bucket that one task compares with as many others.
BLOCK = 1000
#: Coordinates of the wide sketches, which only members of mixed groups get; what agreement may
#: fall short of the threshold, in standard deviations.
WIDE, DEVIATIONS = 2048, 5
SEEDS = mix(np.arange(1, 2 * WIDE + 1, dtype=U) * U(0x9E3779B97F4A7C15))
EMPTY = U((1 << 64) - 1)


def sketches(sets: list[np.ndarray], coords: int = COORDS) -> np.ndarray:
    """(sets, coords) coordinates; rows of empty sets stay EMPTY."""
    out = np.full((len(sets), coords), EMPTY, U)
    flat = out.ravel()
    items = np.concatenate([*sets, np.zeros(0, U)])
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    for i in range(2 * coords):
        if not len(items):
            break
        h = mix(items ^ SEEDS[i])
        value = (h & U(0xFFFFFFFF)) | U(i << 32)
        if i < coords:
            bins = (((h >> U(32)) * U(coords)) >> U(32)).astype(np.int64)
        else:
            bins = np.full(len(items), i - coords)
        np.minimum.at(flat, owner * coords + bins, value)  # earlier rounds have smaller values
        if i < 8 or i % 16 == 0:
            open_ = (out == EMPTY).any(axis=1)[owner]
            items, owner = items[open_], owner[open_]
    return out


def band_keys(coords: np.ndarray) -> np.ndarray:
    """(sets, BANDS) hashes of the bands."""
    keys = np.broadcast_to(SEEDS[:BANDS], (len(coords), BANDS)).copy()
    for j in range(ROWS):
        keys = mix(keys ^ coords[:, j::ROWS]) + U(j)
    return keys


SIGNED = "k long, n long, s1 long, s2 long, bands array<long>"


def _sign(width: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(SIGNED)
        for b in batches:
            texts = b.column("t").cast(pa.binary())
            for lo, hi in text_slices(texts, 1 << 20):
                sets = shingle_sets(texts.slice(lo, hi - lo).to_pylist(), width)
                coords = sketches(sets)
                bands = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32()),
                    pa.array(band_keys(coords).view(np.int64).ravel()))
                sums = [(len(s), s.sum(dtype=U), mix(s ^ SEEDS[0]).sum(dtype=U)) for s in sets]
                n, s1, s2 = (np.array(c, U).view(np.int64) for c in zip(*sums))
                yield pa.record_batch([b.column("k").slice(lo, hi - lo), pa.array(n), pa.array(s1),
                                       pa.array(s2), bands], schema=schema)
    return run


def _verify(percent: int, width: int):
    """Keeps the pairs whose whole shingle sets are similar enough."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int | None, bytes, np.ndarray] = (None, b"", np.zeros(0, U))
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                ids = part.column("b").to_pylist()
                texts = part.column("tb").cast(pa.binary()).to_pylist()
                ours = shingle_sets(part.column("ta").cast(pa.binary()).to_pylist(), width)
                ok = []
                for mine, k, t in zip(ours, ids, texts):
                    if k != last[0] or t != last[1]:
                        last = (k, t, shingle_sets([t], width)[0])
                    both = len(np.intersect1d(mine, last[2], assume_unique=True))
                    union = len(mine) + len(last[2]) - both
                    ok.append(union > 0 and 100 * both >= percent * union)
                yield part.select(["a", "b"]).filter(pa.array(ok))
    return run


def _links(pairs: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """Pairs (a, b) with both texts, streamed into the verification by the joins themselves."""
    with_a = pairs.join(texts.select(F.col("k").alias("a"), F.col("t").alias("ta")), "a")
    with_b = with_a.join(texts.select(F.col("k").alias("b"), F.col("t").alias("tb")), "b")
    return (with_b.select("a", "b", "ta", "tb")
            .mapInArrow(_verify(percent, width), "a long, b long"))


def _widen(width: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("t").cast(pa.binary())
            for lo, hi in text_slices(texts, 1 << 20):
                rows = sketches(shingle_sets(texts.slice(lo, hi - lo).to_pylist(), width), WIDE)
                low = [r.tobytes() for r in (rows & U(255)).astype(np.uint8)]
                yield pa.record_batch([b.column("k").slice(lo, hi - lo), pa.array(low, pa.binary())],
                                      names=["k", "wide"])
    return run


def _agree(percent: int, across: bool):
    """Pairs of two blocks of one group, of different components, whose wide sketches agree to
    within ``DEVIATIONS`` of the threshold; ``across``: only of different hubs."""
    p = percent / 100
    least = WIDE * p - DEVIATIONS * (WIDE * p * (1 - p)) ** 0.5

    def run(table: pa.Table) -> pa.Table:
        k, comp, hub, side = (table.column(c).to_numpy() for c in ("k", "comp", "hub", "side"))
        rows = np.frombuffer(b"".join(table.column("wide").to_pylist()), np.uint8)
        rows = rows.reshape(len(k), WIDE)
        out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in np.flatnonzero(side != 1):
            fit = (side != 0) & (comp != comp[i]) & ((side != 2) | (k > k[i]))
            if across:
                fit &= hub != hub[i]
            other = np.flatnonzero(fit)
            # an eighth of the coordinates first, at six deviations
            eighth = rows[other, :WIDE // 8] == rows[i, :WIDE // 8]
            other = other[eighth.sum(axis=1) >= WIDE * p / 8 - (WIDE * p - least) / 8 ** 0.5 * 1.2]
            near = other[(rows[other] == rows[i]).sum(axis=1) >= least]
            out_a.append(np.full(len(near), k[i]))
            out_b.append(k[near])
        return pa.table({"a": np.concatenate(out_a), "b": np.concatenate(out_b)})
    return run


def _rest(members: DataFrame, star: DataFrame, comp: DataFrame, texts: DataFrame, percent: int,
          width: int) -> DataFrame:
    """Candidate pairs that share a bucket but no component yet.

    Documents of one hub are compared in the hub's group, those of different hubs that share a
    bucket in the bucket. Groups of one component need nothing. The others are cut into blocks of
    about ``BLOCK``; each pair of blocks is one group of a bounded size. Agreement of wide sketches
    leaves the pairs near or above the threshold, which are verified on whole sets.
    """
    nodes = (members.select("k").distinct().join(comp, F.col("k") == F.col("id"), "left")
             .join(star, F.col("k") == F.col("a"), "left")
             .select("k", F.coalesce("component", "k").alias("comp"),
                     F.coalesce("b", "k").alias("hub")))
    nodes = stage(nodes, "nodes")
    shared = stage(members.select("key", "k").join(nodes, "k"), "bucket-nodes")

    def mixed(m: DataFrame, across: bool) -> DataFrame:
        ends = m.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"),
                                    F.min("hub").alias("u"), F.max("hub").alias("v"),
                                    F.count("*").alias("m"))
        ends = ends.filter("lo != hi and u != v" if across else "lo != hi")
        return m.join(ends.select("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")),
                      "key")

    parts = [(stage(mixed(nodes.withColumn("key", F.col("hub")), False), "hub-groups"), False),
             (stage(mixed(shared, True), "mixed-buckets"), True)]
    ids = parts[0][0].select("k").union(parts[1][0].select("k")).distinct()
    wide = stage(texts.join(ids, "k", "left_semi").mapInArrow(_widen(width), "k long, wide binary")
                 .groupBy("k").agg(F.min("wide").alias("wide")), "wide-sketches")
    pairs = []
    for m, across in parts:
        m = (m.withColumn("own", F.pmod(F.xxhash64("k", "key"), F.col("blocks")).cast("int"))
             .join(wide, "k")
             .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
        side = (F.when(F.col("own") == F.col("with"), 2).when(F.col("own") < F.col("with"), 0)
                .otherwise(1))
        m = m.select("key", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"),
                     side.alias("side"), "k", "comp", "hub", "wide")
        pairs.append(m.groupBy("key", "i", "j").applyInArrow(_agree(percent, across),
                                                             "a long, b long"))
    return (pairs[0].union(pairs[1])
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def _nodes(docs: DataFrame, text: str, doc_id: str, *more: Column) -> tuple[DataFrame, bool]:
    """Rows of ids (k), node keys (x) and texts (t), and ``more``; and whether ids repeat.

    Where no id repeats, the id is the key. Otherwise each distinct pair of id and text, told apart by
    two 64-bit hashes (h1, h2, columns of the rows too), is numbered in a scratch table.
    """
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    d = docs.select(id_key(doc_id).alias("k"), t.alias("t"), *more)
    repeat = d.groupBy("k").agg(F.count("*").alias("m")).filter("m > 1").limit(1).count() > 0
    if not repeat:
        return d.withColumn("x", F.col("k")), False
    d = d.withColumns({"h1": F.xxhash64("t"), "h2": F.xxhash64(F.lit("second"), "t")})
    keys = stage(d.select("k", "h1", "h2").distinct().withColumn("x", F.monotonically_increasing_id()), "node-keys")
    return d.join(keys, ["k", "h1", "h2"]), True


def _similar(d: DataFrame, repeat: bool, percent: int, width: int) -> tuple[DataFrame, DataFrame]:
    """Signed nodes (k, n, ...) and components (id, component) of nodes that links reach."""
    spark = d.sparkSession
    if repeat:
        d = stage(d.groupBy(F.col("x").alias("k")).agg(F.min("t").alias("t")), "nodes-texts")
    else:
        d = d.select(F.col("x").alias("k"), "t")
    signed = stage(d.mapInArrow(_sign(width), SIGNED), "signed")
    known = signed.filter("n > 0")
    classes = known.groupBy("s1", "s2").agg(F.min("k").alias("rep"))
    member_of = stage(known.select("k", "s1", "s2").join(classes, ["s1", "s2"])
                      .select("k", "rep").distinct(), "classes")
    reps = (known.join(classes, ["s1", "s2"]).filter("k = rep")
            .select("k", "bands").distinct())
    bands = stage(reps.select("k", F.explode("bands").alias("key")).distinct(), "bands")
    sizes = bands.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1")
    members = stage(bands.join(sizes, "key"), "members")

    score = members.groupBy("k").agg(F.sum("m").alias("score"))
    order = F.struct("score", F.bitwise_not("k").alias("low"))
    hubs = (members.join(score, "k").groupBy("key").agg(F.max_by("k", order).alias("hub")))
    shared = (members.select("key", "k").join(hubs, "key").filter("k != hub")
              .groupBy("k", "hub").agg(F.count("*").alias("n")))
    star = shared.groupBy("k").agg(F.max_by("hub", F.struct("n", F.bitwise_not("hub").alias("low")))
                                   .alias("hub"))
    star = stage(star.select(F.col("k").alias("a"), F.col("hub").alias("b")), "stars")
    free(spark)
    texts = stage(d.join(members.select("k").distinct(), "k", "left_semi"), "texts")
    first = stage(_links(star, texts, percent, width), "links-to-hubs")
    same = member_of.filter("k != rep").select(F.col("k").alias("a"), F.col("rep").alias("b"))
    rest = _rest(members, star, components(first, "a", "b"), texts, percent, width)
    second = stage(_links(stage(rest, "pairs"), texts, percent, width), "links-of-rest")
    return signed, components(first.union(second).union(same), "a", "b")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
                    percent: int = 85, width: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Two documents are linked if 100 * intersection >= ``percent`` * union of their sets of
    distinct ``width``-word shingles (words lower-cased in A-Z; fewer words: the whole sequence).
    component_id is the smallest id that links reach, kept marks it.

    A null text, or one without words, has no shingles and no links. A null id is one id smaller
    than all others. Rows that repeat an id share its component and have the links of all of them:
    every text is compared on its own, then the components of an id's texts are joined. Other
    columns are not read. An empty table gives an empty result.

    Steps: sign every document in one narrow pass; documents of equal sets become one (two 64-bit
    sums over the hashes); band keys are grouped with partial aggregation, and each bucket links
    its members to the member that shares most buckets, one link a document. Those are verified on
    whole sets and contracted. Only buckets that still hold several components compare their
    members, in blocks. So a bucket of m copies costs m verifications, not m * m.
    """
    d, repeat = _nodes(docs, text, doc_id)
    signed, comp = _similar(d, repeat, percent, width)
    if repeat:
        signed = stage(d.select("k", "x").join(signed.select(F.col("k").alias("x"), "n"), "x"), "rows")
        linked = signed.select("k", "x").distinct().join(comp, F.col("x") == F.col("id"))
        low = linked.groupBy("component").agg(F.min("k").alias("low"))
        comp = components(linked.join(low, "component"), "k", "low")
    out = signed.select("k", "n").join(comp, signed.k == comp.id, "left").select(
        "k", "n", F.coalesce("component", "k").alias("c"))
    return out.select(id_back(F.col("k")).alias("doc_id"), F.col("n").alias("n_shingles"),
                      id_back(F.col("c")).alias("component_id"),
                      (F.col("k") == F.col("c")).alias("kept"))


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = 85,
             width: int = 5) -> DataFrame:
    """``docs`` with one document of each group of near duplicates, the one of the smallest id.

    Of rows that repeat an id one stays: that whose text has the smallest hash.
    """
    near = near_duplicates(docs, text, doc_id, percent, width)
    kept = near.filter("kept").select(id_key("doc_id").alias("k")).distinct()
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                    id_key(doc_id).alias("k"), F.xxhash64(F.col(f"`{text}`")).alias("h"))
    first = F.row_number().over(W.partitionBy("k").orderBy("h"))
    return d.withColumn("n", first).filter("n = 1").join(kept, "k").select("row.*")


def keep_unlike(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = 85,
                width: int = 5) -> DataFrame:
    """``docs`` without the rows that resemble another: of each component of linked texts one row
    stays, of the smallest id.

    A row goes only if links lead from its text to the one that stays, whatever its id: unlike
    texts that share an id, or have none, all stay, and so do texts without words. Of rows with the
    same id and text the one with the smallest hash of all columns stays, however rows are dealt.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    d, repeat = _nodes(docs, text, doc_id, row)
    _, comp = _similar(d.select("k", "x", "t"), repeat, percent, width)
    if not repeat:
        gone = comp.filter("id != component").select(F.col("id").alias("x"))
        return d.select("x", "row").join(gone, "x", "left_anti").select("row.*")
    linked = (d.select("k", "h1", "h2", "x").distinct().join(comp, F.col("x") == F.col("id"))
              .withColumn("place", F.struct("k", "h1", "h2")))
    first = linked.groupBy("component").agg(F.min("place").alias("first"))
    gone = stage(linked.join(first, "component").filter("place != first").select("x"), "unkept")
    rows = d.withColumn("worded", F.col("t").rlike(r"[^\x20\x09-\x0D]"))
    # equal texts of one id: the row of the smallest hash, combined map-side
    least = F.struct(F.xxhash64("row").alias("a"), F.xxhash64(F.lit("second"), "row").alias("b"))
    once = rows.filter("worded").groupBy("x").agg(F.min_by("row", least).alias("row"))
    return (rows.filter("NOT worded").select("row")
            .union(once.join(gone, "x", "left_anti").select("row")).select("row.*"))
