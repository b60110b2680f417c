"""Mixing sources to target weights by Pfair scheduling.

Every source hands out blocks of documents. Block j of a source of weight w may go from slot
floor((j - 1) / w) on and must be out by slot ceil(j / w); of the blocks that may go, the one with
the earliest deadline goes first. With weights that sum to 1, every deadline is met, so at no slot
is a source a whole block ahead of or behind its share.

Weights are held exactly, as fractions. Over their common denominator the schedule repeats: only one
frame of that many slots is scheduled, a table of a fixed size, and the slot of a block follows from
its number. A source that has run out leaves its slots empty, so the others go on in proportion to
their weights.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Mapping
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadence.llm.common import shuffle_partitions

#: Slots of a frame, at most.
FRAME = 100_000
#: Rows numbered by one task.
NUMBERED = 8192
REST = "\0rest"


def shares(weights: Mapping[str, float], frame: int = FRAME) -> dict[str, int]:
    """Slots of each source in a frame that holds the weights exactly: the fractions that their
    decimal forms say, of their sum, over the least common denominator. An error if that is more
    than ``frame``."""
    exact = {s: Fraction(str(w)) for s, w in weights.items()}
    total = sum(exact.values())
    exact = {s: w / total for s, w in exact.items()}
    slots = math.lcm(*[w.denominator for w in exact.values()])
    if slots > frame:
        raise ValueError(f"these weights need a frame of {slots} slots, more than {frame}: round them")
    return {s: int(w * slots) for s, w in exact.items()}


def schedule(slots: Mapping[str, int]) -> dict[str, list[int]]:
    """The slots of one frame for every source: release times and deadlines, earliest deadline
    first, ties to the name that sorts first."""
    frame = sum(slots.values())
    out: dict[str, list[int]] = {s: [] for s in slots}
    later = [(0, s) for s in sorted(slots)]  # (release time, source): a heap
    ready: list[tuple[int, str]] = []  # (deadline, source): a heap
    for t in range(frame):
        while later and later[0][0] <= t:
            s = heapq.heappop(later)[1]
            heapq.heappush(ready, (-(-(len(out[s]) + 1) * frame // slots[s]), s))
        s = heapq.heappop(ready)[1]
        out[s].append(t)
        if len(out[s]) < slots[s]:
            heapq.heappush(later, (len(out[s]) * frame // slots[s], s))
    return out


def mix_sources(docs: DataFrame, weights: Mapping[str | None, float], block: int = 32,
                source: str = "source", doc_id: str = "doc_id", seed: int = 7,
                frame: int = FRAME) -> DataFrame:
    """The columns of ``docs`` and mix_slot, mix_place: order by both for the mixed sequence.

    ``weights`` names sources and their target shares of the documents. Sources that it does not
    name, and null, share the weight under ``None`` as one source (default: the mean of the
    others). Every row comes out once: none is dropped or repeated to meet a weight. Blocks hold
    ``block`` documents of one source (the last one maybe fewer), in the order of md5 of ``seed``
    and id. Slots of a source that has run out do not occur.

    Input columns of the two names are replaced. ``text`` is carried, not read. A null id is an
    id; rows that repeat an id are rows, side by side in the order of a hash of their columns but
    ``text``. An empty table gives an empty result.

    Scale: documents are numbered inside (source, range of the md5), about ``NUMBERED`` rows a
    group, so a source with a third of all rows is many groups. Broadcast is one frame: as many rows
    as the weights' common denominator, whatever the data; ``frame`` bounds it, and weights that need
    more are an error.
    """
    keep = [c for c in docs.columns if c not in ("mix_slot", "mix_place")]
    named = {s: w for s, w in weights.items() if s is not None}
    rest = weights.get(None, sum(Fraction(str(w)) for w in named.values()) / len(named) if named else 1)
    if min([rest, *named.values()]) <= 0:
        raise ValueError("weights must be positive")
    slots = shares({**named, REST: rest}, frame)
    frame = sum(slots.values())
    plan = docs.sparkSession.createDataFrame(
        [(s, i, len(at), slot) for s, at in schedule(slots).items() for i, slot in enumerate(at)],
        "s string, i int, each int, slot int")
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit(""))))
    label = F.col(f"`{source}`").cast("string")
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), key.alias("h"),
                    F.xxhash64(*[F.col(f"`{c}`") for c in keep if c != "text"]).alias("tie"),
                    F.when(label.isin(*named), label).otherwise(F.lit(REST)).alias("s"))
    buckets = max(1, -(-docs.count() // NUMBERED))
    part = F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * buckets / (1 << 32))
    d = d.withColumn("b", part)
    sizes = d.groupBy("s", "b").agg(F.count("*").alias("n"))
    before = W.partitionBy("s").orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select("s", "b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = W.partitionBy("s", "b").orderBy("h", "tie")
    placed = (d.withColumn("n", F.row_number().over(inside) - 1).join(sizes, ["s", "b"])
              .withColumn("n", F.col("n") + F.col("before"))
              .withColumn("j", F.floor(F.col("n") / block)))
    each = F.broadcast(plan.select("s", "each").distinct())  # a row for each weight
    placed = placed.join(each, "s").withColumn("i", (F.col("j") % F.col("each")).cast("int"))
    placed = placed.join(F.broadcast(plan.select("s", "i", "slot")), ["s", "i"])
    slot = F.floor(F.col("j") / F.col("each")) * frame + F.col("slot")
    return placed.select(*[F.col(f"row.`{c}`").alias(c) for c in keep],
                         slot.cast("long").alias("mix_slot"),
                         (F.col("n") % block).cast("int").alias("mix_place"))


def in_mixed_order(mixed: DataFrame) -> DataFrame:
    """Rows dealt to tasks by ranges of the mixed sequence and sorted: files written from this, by
    name and in each file, hold the sequence."""
    n = shuffle_partitions(mixed.sparkSession)
    return (mixed.repartitionByRange(n, "mix_slot", "mix_place")
            .sortWithinPartitions("mix_slot", "mix_place"))


def with_file_order(mixed: DataFrame) -> DataFrame:
    """``mixed``, read from files, with ``mix_file`` and ``mix_row``: where each row stands in them."""
    return mixed.select("*", F.col("_metadata.file_name").alias("mix_file"), F.col("_metadata.row_index").alias("mix_row"))


def places_in_files(mixed: DataFrame, block: int = 32) -> DataFrame:
    """The columns of ``mixed`` with mix_slot, mix_place in the place of ``mix_file``, ``mix_row``: the
    sequence that the files hold, cut into blocks of ``block`` rows. Nothing is scheduled again.

    Broadcast is one row a file: how many rows stand in the files before it. (Longer names are later
    ones: the numbers in them have five digits or more.)"""
    keep = [c for c in mixed.columns if c not in ("mix_slot", "mix_place", "mix_file", "mix_row")]
    sizes = mixed.groupBy("mix_file").agg(F.count("*").alias("n")).withColumn("all", F.lit(0))
    before = W.partitionBy("all").orderBy(F.length("mix_file"), "mix_file").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select("mix_file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    at = F.col("before") + F.col("mix_row")
    return mixed.join(F.broadcast(sizes), "mix_file").select(
        *[F.col(f"`{c}`") for c in keep], F.floor(at / block).cast("long").alias("mix_slot"),
        (at % block).cast("int").alias("mix_place"))
