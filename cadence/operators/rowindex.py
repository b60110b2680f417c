"""Dense row positions, neighbours and sliding windows without a single task.

``Window.orderBy(...)`` with no partition moves every row to one task, and
``Window.partitionBy(stream)`` puts a hot stream (say a third of all rows) on
one task.  Here the order is cut into ranges by ``repartitionByRange`` on the
*whole* composite order key (a hot stream is split by its time column, rows
that are equal in every column by their place in the input), rows are counted
per range, and a row's global position is the size of earlier ranges plus its
place inside its range.  The number of ranges follows the estimated input
size; the per-range sizes are one number per range (a bound we choose), joined
back as a small local table.

The indexed rows are checkpointed to the cluster's checkpoint folder, so the
numbering is fixed once and survives lost executors.

Neighbours (lead/lag) and sliding windows are plain window functions inside
blocks of ``BLOCK`` positions.  The rows at a block's ends stand in the next
block too, so one exchange by block is enough, and a block holds at most
``BLOCK`` rows and two short ends whatever the data skew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadence.session import ensure_checkpoint_dir, shuffle_partitions

RN = "_rn"
BLOCK = 8192  # positions of one block of neighbours and windows
_LOCAL_BITS = 33  # monotonically_increasing_id keeps the record number in the low 33 bits


def _cols(cols) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def row_hash(df: DataFrame) -> Column:
    """64-bit hash of a whole row (map columns, which Spark cannot hash, are
    left out): the tie-break that makes an order total and reproducible."""
    from pyspark.sql.types import MapType
    cols = [F.col(f.name) for f in df.schema.fields if not isinstance(f.dataType, MapType)]
    return F.xxhash64(*cols) if cols else F.lit(0).cast("long")


def _input_bytes(df: DataFrame) -> int:
    """Bytes of the plan's leaf inputs (file sizes for scans).  The root's
    estimate is not used: without cost-based statistics Spark multiplies the
    sizes of joined sides, which overshoots by orders of magnitude."""
    total = 0
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves().iterator()
    while leaves.hasNext():
        raw = leaves.next().stats().sizeInBytes()
        size = raw if isinstance(raw, int) else int(raw.toString())
        if 0 < size < (1 << 62):          # unknown leaves report Long.MaxValue
            total += size
    return total


def range_partitions(df: DataFrame) -> int:
    """Number of ranges for the index: at least the shuffle partitions, and
    about one per ``spark.sql.files.maxPartitionBytes`` of input, so a range
    stays sortable in one task at any data size."""
    spark = df.sparkSession
    size = str(spark.conf.get("spark.sql.files.maxPartitionBytes", "128MB"))
    target = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(size)
    return max(shuffle_partitions(spark), 1, -(-_input_bytes(df) // max(target, 1)))


def with_row_index(df: DataFrame, order: list, name: str = RN,
                   num_partitions: int | None = None, tiebreak: bool = True) -> DataFrame:
    """Add ``name``: 0-based position of each row in ``order`` (ascending,
    NULLs first, as SQL ``ORDER BY``).

    ``tiebreak`` appends a hash of the whole row so that the order is total
    and the numbering is reproducible; rows equal in every column are
    interchangeable, and split over ranges by their place in the input.
    """
    spark = df.sparkSession
    n = num_partitions or range_partitions(df)
    keys = _cols(order)
    if tiebreak:
        df = df.withColumn("_tb", row_hash(df)).withColumn(
            "_tp", F.xxhash64(F.monotonically_increasing_id()))
        keys = keys + [F.col("_tb"), F.col("_tp")]
    ranged = (df.repartitionByRange(n, *keys)
                .sortWithinPartitions(*keys)
                .withColumn("_pid", F.spark_partition_id())
                .withColumn("_loc", F.monotonically_increasing_id()
                            .bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))))
    ensure_checkpoint_dir(spark)
    ranged = ranged.drop("_tb", "_tp").checkpoint(eager=True)
    # one count per range partition (n values, a bound we choose): read once
    # from the checkpoint, so every later use of the index is a plain
    # projection of the checkpointed rows
    sizes = dict(ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n")).collect())
    offsets, acc = [], 0
    for pid in range(n):
        offsets.append((pid, acc))
        acc += sizes.get(pid, 0)
    # a local table of n rows: joined by broadcast, nothing recomputed
    off = spark.createDataFrame(offsets, "_pid int, _off long")
    return (ranged.join(F.broadcast(off), "_pid")
                  .withColumn(name, F.col("_off") + F.col("_loc"))
                  .drop("_pid", "_loc", "_off"))


def with_stream_index(df: DataFrame, streams: list[str], order: list,
                      name: str = "_srn", global_name: str = RN) -> DataFrame:
    """W10 per stream: 0-based position inside each stream.

    From the global index over ``streams + order``: position minus the first
    position of the stream.  The stream-start table has one row per stream;
    Spark broadcasts it only when its measured size is under the broadcast
    threshold, and AQE splits a hot stream on the other side of the join."""
    ix = with_row_index(df, [*streams, *order], name=global_name)
    starts = ix.groupBy(*streams).agg(F.min(global_name).alias("_start"))
    for s in streams:
        starts = starts.withColumnRenamed(s, f"_s_{s}")
    cond = [ix[s].eqNullSafe(starts[f"_s_{s}"]) for s in streams]
    return (ix.join(starts, on=cond)
              .withColumn(name, F.col(global_name) - F.col("_start"))
              .drop("_start", *[f"_s_{s}" for s in streams]))


def _blocks(ix: DataFrame, before: int, after: int, rn: str) -> tuple[DataFrame, Window]:
    """Rows with the block they stand in (``_blk``), those at an end of a block
    also in the neighbouring one (``_end``): ``before`` rows ahead of a block
    and ``after`` behind it.  And the window over a block by position."""
    size = max(BLOCK, 2 * (before + after))
    own, place = F.floor(F.col(rn) / size), F.pmod(F.col(rn), F.lit(size))
    to = F.array_compact(F.array(own, F.when(place >= size - before, own + 1),
                                 F.when(place < after, own - 1)))
    out = (ix.withColumn("_own", own).withColumn("_blk", F.explode(to))
             .withColumn("_end", F.col("_blk") != F.col("_own")).drop("_own"))
    return out, Window.partitionBy("_blk").orderBy(rn)


def neighbour(ix: DataFrame, carry: list[str], offset: int = 1, prefix: str = "next_",
              same: list[str] | None = None, rn: str = RN) -> DataFrame:
    """Lead (``offset>0``) or lag (``offset<0``) of ``carry`` by position.

    With ``same`` (stream columns) a neighbour from another stream is
    missing, exactly as ``Window.partitionBy(stream)`` would give."""
    same = same or []
    rows, by_position = _blocks(ix, max(-offset, 0), max(offset, 0), rn)
    rec = F.struct(*[F.col(c) for c in dict.fromkeys([*carry, *same])])
    out = rows.withColumn("_nb", F.lead(rec, offset).over(by_position)).filter(~F.col("_end"))
    ok = F.col("_nb").isNotNull()
    for s in same:
        ok = ok & F.col(s).eqNullSafe(F.col(f"_nb.{s}"))
    return out.select(*ix.columns, *[F.when(ok, F.col(f"_nb.{c}")).alias(f"{prefix}{c}")
                                     for c in carry])


def sliding_windows(ix: DataFrame, features: list[str], length: int, *,
                    target_inside: bool, meta: list[str], target: str | None = None,
                    same: list[str] | None = None, rn: str = RN) -> DataFrame:
    """Fixed-length windows of ``features`` rows, keyed by their target row.

    ``target_inside=True`` (W5): rows i-L+1..i, target of row i.
    ``target_inside=False`` (W6): rows i-L..i-1, target of row i.
    With ``same`` a window never crosses a stream (W7) or split (W11);
    positions with fewer than ``length`` rows before them give no window.

    Output: ``meta`` of the target row, ``_rn`` of the target, ``X``
    (array of ``length`` rows, each an array of feature values, oldest first)
    and ``y`` (the target value, if ``target``).
    """
    same = same or []
    last = 0 if target_inside else 1
    rows, by_position = _blocks(ix, length - 1 + last, 0, rn)
    row = F.array(*[F.col(c).cast("double") for c in features])
    rows = rows.select(rn, "_blk", "_end", row.alias("_x"),
                       *dict.fromkeys([*same, *meta, *([target] if target else [])]))
    frame = by_position.rowsBetween(-(length - 1 + last), -last)
    rec = F.struct(F.col("_x"), *[F.col(c) for c in same])
    members = F.col("_w")
    if same:
        members = F.filter(members, lambda m: _same(m, same))
    return (rows.withColumn("_w", F.collect_list(rec).over(frame)).filter(~F.col("_end"))
                .withColumn("_w", members)
                .filter(F.size("_w") == length)
                .select(*meta, rn, F.col("_w._x").alias("X"),
                        *([F.col(target).cast("double").alias("y")] if target else [])))


def _same(member: Column, cols: list[str]) -> Column:
    cond = F.lit(True)
    for c in cols:
        cond = cond & member[c].eqNullSafe(F.col(c))
    return cond


def with_prefix_sum(ix: DataFrame, value: str, name: str, rn: str = RN) -> tuple[DataFrame, float]:
    """``name``: the sum of ``value`` over all earlier positions; and the total.

    Sums are taken in blocks of ``BLOCK`` positions, those in blocks of ``BLOCK`` blocks, and so on,
    each level map-side combined, until one block holds them all; on the way back each level adds
    what stands before it.  No window sees more than ``BLOCK`` rows, at any size."""
    rows = ix.withColumn("_b", F.floor(F.col(rn) / BLOCK).cast("long"))
    sums = [rows.groupBy("_b").agg(F.sum(value).alias("_s")).checkpoint(eager=True)]
    while (sums[-1].agg(F.max("_b")).first()[0] or 0) >= BLOCK:
        up = sums[-1].groupBy(F.floor(F.col("_b") / BLOCK).cast("long").alias("_b")).agg(F.sum("_s").alias("_s"))
        sums.append(up.checkpoint(eager=True))
    before = lambda w: F.coalesce(F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    top = sums.pop().withColumn("_all", F.lit(0))
    total = top.agg(F.sum("_s")).first()[0] or 0.0
    ahead = top.select("_b", before(Window.partitionBy("_all").orderBy("_b")).alias("_ahead"))
    while sums:
        level = sums.pop().withColumn("_up", F.floor(F.col("_b") / BLOCK).cast("long"))
        inside = level.withColumn("_in", before(Window.partitionBy("_up").orderBy("_b")))
        ahead = inside.join(ahead.withColumnRenamed("_b", "_up"), "_up").select(
            "_b", (F.col("_ahead") + F.col("_in")).alias("_ahead"))
    inside = Window.partitionBy("_b").orderBy(rn).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0.0))).join(ahead, "_b")
    return out.withColumn(name, F.col("_ahead") + F.col("_in")).drop("_b", "_in", "_ahead"), float(total)


def with_place(ix: DataFrame, same: list[str] | None = None, rn: str = RN) -> DataFrame:
    """``_place`` (from 0) and ``_size``: where a row stands in its group ``same`` (all rows without
    one) and how many rows that has.  The groups' ends are one map-side combined aggregate; they
    come back by a plain join, which Spark broadcasts only if their measured size allows it."""
    same = same or []
    ends = ix.groupBy(*same).agg(F.min(rn).alias("_start"), F.count(F.lit(1)).alias("_size"))
    if not same:
        out = ix.crossJoin(F.broadcast(ends))  # one row
    else:
        ends = ends.withColumnsRenamed({c: f"_s_{c}" for c in same})
        out = ix.join(ends, on=[F.col(c).eqNullSafe(F.col(f"_s_{c}")) for c in same])
    return out.withColumn("_place", F.col(rn) - F.col("_start")).drop("_start", *[f"_s_{c}" for c in same])


def windows_holding(length: int, target_inside: bool) -> Column:
    """How many windows hold a row of ``with_place``: a window of ``length`` rows may begin at places
    0 to size - length (one less if its target is the row behind it)."""
    last = F.col("_size") - length - (0 if target_inside else 1)
    first = F.greatest(F.col("_place") - (length - 1), F.lit(0))
    return F.greatest(F.least(F.col("_place"), last) - first + 1, F.lit(0))


def at_timestep(t: int, length: int, target_inside: bool) -> Column:
    """Whether a row of ``with_place`` is timestep ``t`` of some window."""
    begin = F.col("_place") - t
    return (begin >= 0) & (begin <= F.col("_size") - length - (0 if target_inside else 1))


def last_steps(ix: DataFrame, features: list[str], length: int, *, target_inside: bool, meta: list[str],
               target: str | None = None, same: list[str] | None = None, rn: str = RN) -> DataFrame:
    """The last timestep of every window of ``sliding_windows``, without the windows: the target row
    itself (``target_inside``) or the row before it, where enough rows of the group stand before.
    One lag over a flag says so.  Output: ``meta``, ``rn``, the feature columns, and ``y``."""
    same = same or []
    back = length - 1 if target_inside else length
    rows, by_position = _blocks(ix, back, 0, rn)
    mark = F.struct(F.lit(1).alias("_one"), *[F.col(c) for c in same])
    rows = rows.withColumn("_head", F.lag(mark, back).over(by_position) if back else mark)
    if not target_inside:
        step = F.lag(F.struct(*[F.col(c).cast("double").alias(c) for c in features])).over(by_position)
    else:
        step = F.struct(*[F.col(c).cast("double").alias(c) for c in features])
    rows = rows.withColumn("_step", step).filter(~F.col("_end")).filter(F.col("_head").isNotNull())
    for c in same:
        rows = rows.filter(F.col(c).eqNullSafe(F.col(f"_head.{c}")))
    return rows.select(*meta, rn, *[F.col("_step").getField(c).alias(c if c not in meta else f"x_{c}") for c in features],
                       *([F.col(target).cast("double").alias("y")] if target else []))


# --- values at given ranks, exact at any size ---------------------------------

PARTS = 1024  # value ranges counted in one pass for each interval


def values_at_ranks(values: DataFrame, ranks: dict[str, list[int]]) -> dict[tuple[str, int], float]:
    """The values at 0-based ``ranks`` of each feature of (feature, v), v not
    NULL and finite.

    Each pass cuts the intervals that still hold a wanted rank into ``PARTS``
    equal value ranges and counts them (combined map-side, so a constant or a
    hot value is one number per task), then goes on with the ranges that hold
    the ranks, shrunk to their smallest and largest value.  Nothing is sorted
    and no value meets others in one task; the driver gets one row for each
    wanted rank and pass."""
    spark = values.sparkSession
    values = values.filter(F.col("feature").isin(*ranks)) if ranks else values.limit(0)
    found: dict[tuple[str, int], float] = {}
    ends = values.groupBy("feature").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
    open_ = [(r.feature, r.lo, r.hi, 0, sorted(ranks[r.feature])) for r in ends]
    while open_:
        rest = []
        for feature, lo, hi, before, wanted in open_:
            if lo == hi:
                found.update({(feature, r): lo for r in wanted})
            else:
                rest.append((feature, lo, hi, before, wanted))
        if not rest:
            break
        kind = values.schema["v"].dataType.simpleString()
        cuts = spark.createDataFrame([(i, *r) for i, r in enumerate(rest)],
                                     f"_i int, feature string, _lo {kind}, _hi {kind}, _before long, "
                                     "_ranks array<long>")
        half = lambda c: F.col(c).cast("double") / 2  # noqa: E731 - so that a difference cannot overflow
        width = half("_hi") - half("_lo")
        part = (F.when(width > 0, F.least(F.floor((half("v") - half("_lo")) / width * PARTS),
                                          F.lit(PARTS - 1)))
                .otherwise((F.col("v") > F.col("_lo")).cast("long")))
        counted = (values.join(F.broadcast(cuts), "feature")
                   .filter((F.col("v") >= F.col("_lo")) & (F.col("v") <= F.col("_hi")))
                   .groupBy("_i", part.alias("_p"))
                   .agg(F.count(F.lit(1)).alias("_n"), F.min("v").alias("lo"), F.max("v").alias("hi")))
        upto = Window.partitionBy("_i").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
        counted = (counted.withColumn("_sofar", F.coalesce(F.sum("_n").over(upto), F.lit(0)))
                   .join(F.broadcast(cuts.select("_i", "feature", "_before", "_ranks")), "_i")
                   .withColumn("_first", F.col("_before") + F.col("_sofar"))
                   .withColumn("_here", F.filter("_ranks", lambda r: (r >= F.col("_first"))
                                                 & (r < F.col("_first") + F.col("_n"))))
                   .filter(F.size("_here") > 0))
        open_ = [(r.feature, r.lo, r.hi, r["_first"], list(r["_here"]))
                 for r in counted.select("feature", "lo", "hi", "_first", "_here").collect()]
    return found


# --- values at fractions of a table, in two evaluations of it ------------------------------

SKETCH = 10_000  # accuracy of the sketch that brackets a rank


def values_at_fractions(df: DataFrame, values: dict[str, Column], fractions: list[float], ranks
                        ) -> tuple[dict[str, int], dict[tuple[str, int], float]]:
    """How many values (not NULL) each of ``values`` has, and those at 0-based ranks
    ``ranks(n, fraction)``, each within a rank or so of ``fraction * n``.

    ``df`` is evaluated twice, whatever its size: one aggregate of counts and mergeable sketches, whose
    error bound brackets every rank; then the values inside the brackets, some four in ten thousand,
    go to a scratch table while the values below them are counted (``observe``).  ``values_at_ranks``
    finds the ranks in that table.  Should a bracket miss its rank, that value is looked for in
    ``df`` itself."""
    from pyspark.sql import Observation

    from cadence.sources.io import scratch_path
    spark = df.sparkSession
    cols = df.select(*[c.alias(f"_v{i}") for i, c in enumerate(values.values())])
    v = [F.col(f"_v{i}") for i in range(len(values))]
    ends = [min(max(f + s * 2 / SKETCH, 0.0), 1.0) for f in fractions for s in (-1, 1)]
    row = cols.agg(*[x for c in v for x in (F.count(c), F.percentile_approx(c, ends, SKETCH))]).first()
    counts = {name: row[2 * i] for i, name in enumerate(values)}
    wanted = []  # (column, rank, lowest, highest value of its bracket)
    for i, name in enumerate(values):
        for k, f in enumerate(fractions if counts[name] else ()):
            wanted += [(i, r, *row[2 * i + 1][2 * k:2 * k + 2]) for r in sorted(set(ranks(counts[name], f)))]
    found: dict[tuple[str, int], float] = {}
    names = list(values)
    if not wanted:
        return counts, found
    seen = Observation()
    inside = [v[i].between(F.lit(lo), F.lit(hi)) for i, _, lo, hi in wanted]
    told = cols.observe(seen, *[F.count(F.when(v[i] < F.lit(lo), 1)).alias(f"b{j}") for j, (i, _, lo, _) in enumerate(wanted)],
                        *[F.count(F.when(w, 1)).alias(f"n{j}") for j, w in enumerate(inside)])
    near = F.array_compact(F.array(*[F.when(w, F.struct(F.lit(str(j)).alias("feature"), v[i].alias("v")))
                                     for j, (w, (i, *_)) in enumerate(zip(inside, wanted))]))
    path = scratch_path(spark, "brackets")
    told.select(F.inline(near)).write.parquet(path)
    below = seen.get
    places = {str(j): [r - below[f"b{j}"]] for j, (_, r, _, _) in enumerate(wanted)
              if 0 <= r - below[f"b{j}"] < below[f"n{j}"]}
    kind = cols.schema["_v0"].dataType.simpleString()
    got = values_at_ranks(spark.read.schema(f"feature string, v {kind}").parquet(path), places)
    missed: dict[str, list[int]] = {}
    for j, (i, r, _, _) in enumerate(wanted):
        if str(j) in places:
            found[names[i], r] = got[str(j), places[str(j)][0]]
        else:
            missed.setdefault(names[i], []).append(r)
    if missed:
        long = cols.select(F.inline(F.array(*[F.struct(F.lit(n).alias("feature"), c.alias("v"))
                                              for n, c in zip(names, v)]))).filter(F.col("v").isNotNull())
        found.update(values_at_ranks(long, missed))
    return counts, found
