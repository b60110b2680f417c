"""Suffix-array dedup: removes long byte strings that a smaller document holds.

Strings of ``LENGTH`` bytes are compared through anchors. An anchor is a position whose hash of
``ANCHOR`` bytes is the smallest of some window of ``LENGTH`` bytes, so equal strings have an equal
anchor at the same place in them, and an anchor's context (everything that a string around it can
reach) holds every string of which it is the smallest. Contexts that are equal are merged into
that of the smallest document, before anything but hashes moves. What is left, the distinct
contexts of anchors in several documents, goes by anchor to the interval expansion on a
Burrows-Wheeler transform (``bwt.py``), which finds the strings that different contexts share.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.llm.bwt import repeated_starts
from cadence.llm.common import (arrow_schema, free, id_back, id_key, shuffle_partitions, stage,
                                text_slices)
from cadence.llm.shingles import U, _powers, mix

LENGTH, ANCHOR = 50, 24
REACH = LENGTH - ANCHOR
#: Bytes of a chunk of documents, anchors of a bucket, and bytes of one transform.
CHUNK, BUCKET, TEXT = 1 << 20, 400_000, 1 << 20
LOW32 = U((1 << 32) - 1)
_RNG = np.random.default_rng(50)
_ROLL, _CONTEXT = (_RNG.integers(1, 1 << 63, 256, dtype=np.int64).astype(U) for _ in range(2))
_FACTORS = [U(int(x) | 1) for x in _RNG.integers(1, 1 << 62, 8)]


def _slide(x: np.ndarray, width: int, what) -> np.ndarray:
    """``what`` (minimum or maximum) over each window of ``width``, by doubling."""
    out, span = x, 1
    while span < width:
        step = min(span, width - span)
        out = what(out[:-step], out[step:])
        span += step
    return out


def _roll(data: np.ndarray) -> np.ndarray:
    """Hash of the ``ANCHOR`` bytes from each position, by doubling."""
    h, span = _ROLL[data], 1
    for f in _FACTORS:
        if span == ANCHOR:
            break
        step = min(span, ANCHOR - span)
        h = h[:len(h) - step] * f + h[step:]
        span += step
    return h


class Anchors:
    """The anchors of a chunk of documents, one entry for each distinct (anchor, context).

    a, c: hashes; entry: the entry of each position; at, lo, hi: position and its context's
    bounds in ``data``; doc: index of its document; first: the smallest id with that entry.
    Entries are sorted by the upper half of a.
    """

    def __init__(self, ids: np.ndarray, texts: list[bytes]):
        sizes = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        data = self.data = np.frombuffer(b"".join(texts), np.uint8)
        if len(data) < LENGTH or sizes.max(initial=0) < LENGTH:
            at = np.zeros(0, np.int64)
        else:
            hashes = _roll(data)
            h = (hashes >> U(32)).astype(np.uint32) | np.uint32(1)
            low = _slide(h, REACH + 1, np.minimum)  # of each string of LENGTH bytes
            across = np.zeros(len(low), bool)
            for e in self.ends[:-1]:  # strings that run over a document's end
                across[max(0, e - LENGTH + 1):e] = True
            low[across] = 0
            edge = np.zeros(REACH, np.uint32)
            best = _slide(np.concatenate((edge, low, edge)), REACH + 1, np.maximum)
            at = np.flatnonzero(best == h)
        self.doc = np.searchsorted(self.ends, at, side="right")
        self.at = at
        self.lo = np.maximum(at - REACH, self.starts[self.doc])
        self.hi = np.minimum(at + LENGTH, self.ends[self.doc])
        power, inverse = _powers(len(data) + 1)[:2]
        sums = np.zeros(len(data) + 1, U)
        np.cumsum(_CONTEXT[data] * power[:len(data)], out=sums[1:])
        shape = ((self.hi - self.lo) * 64 + (at - self.lo)).astype(U)
        c = mix((sums[self.hi] - sums[self.lo]) * inverse[self.lo] + mix(shape))
        a = mix(hashes[at]) if len(at) else np.zeros(0, U)
        owner = ids[self.doc]
        # by bucket, then by both hashes; stable, so that every pass numbers entries alike
        order = np.argsort((a & ~LOW32) | (mix(a ^ mix(c)) >> U(32)), kind="stable")
        a, c, owner = a[order], c[order], owner[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
        self.entry = np.empty(len(a), np.int64)
        self.entry[order] = np.cumsum(new) - 1
        starts = np.flatnonzero(new)
        self.a, self.c = a[starts], c[starts]
        self.first = np.minimum.reduceat(owner, starts) if len(a) else owner
        self.several = (np.maximum.reduceat(owner, starts) if len(a) else owner) > self.first

    def buckets(self, n: int) -> list[tuple[int, int, int]]:
        """(bucket, from, to): entries by ranges of the anchor's hash."""
        b = ((self.a >> U(32)) * U(n) >> U(32)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(b)) + 1
        bounds = [0, *cuts.tolist(), len(b)]
        return [(int(b[lo]), lo, hi) for lo, hi in zip(bounds, bounds[1:]) if hi > lo]


CHUNKED = "chunk long, ids binary, ends binary, data binary"


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    chunk, schema = TaskContext.get().partitionId() << 32, arrow_schema(CHUNKED)
    for b in batches:
        texts = b.column("t").cast(pa.binary())
        for lo, hi in text_slices(texts, CHUNK):
            part = texts.slice(lo, hi - lo).to_pylist()
            ids = np.asarray(b.column("k").slice(lo, hi - lo))
            cols = ([chunk], [ids.tobytes()], [np.cumsum([len(t) for t in part]).tobytes()],
                    [b"".join(part)])
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, schema)],
                                  schema=schema)
            chunk += 1


def _open(row: dict) -> tuple[np.ndarray, list[bytes]]:
    ids, ends = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["ends"], np.int64)
    return ids, [row["data"][e - n:e] for e, n in zip(ends, np.diff(ends, prepend=0))]


def _emit(rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(rows), 256):
        cols = zip(*rows[lo:lo + 256])
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


#: Six bytes of each hash, and the place of the smallest document in a list of its own.
HASHES = "bucket int, chunk long, n int, hashes binary, docs binary, several binary"


def _six(x: np.ndarray) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_six(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel()


def _hashes(buckets: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(HASHES)
        for b in batches:
            for row in b.to_pylist():
                x = Anchors(*_open(row))
                out = []
                for bucket, lo, hi in x.buckets(buckets):
                    out.append((bucket, row["chunk"], hi - lo, _six(x.a[lo:hi]) + _six(x.c[lo:hi]),
                                _pack_ids(x.first[lo:hi]), np.packbits(x.several[lo:hi]).tobytes()))
                yield from _emit(out, schema)
    return run


def _pack_ids(ids: np.ndarray) -> bytes:
    """Distinct ids as steps, and for each id its place among them, in as few bytes as will do."""
    names, which = np.unique(ids, return_inverse=True)
    steps = np.diff(names.view(U), prepend=names[:1].view(U))
    wide = int(steps.max()) >= 1 << 32
    return (struct.pack("<IBq", len(names), wide, names[0]) + steps.astype("<u8" if wide else "<u4").tobytes()
            + which.astype("<u2" if len(names) <= 0x10000 else "<u4").tobytes())


def _unpack_ids(data: bytes) -> np.ndarray:
    n, wide, first = struct.unpack_from("<IBq", data)
    steps = np.frombuffer(data, "<u8" if wide else "<u4", n, 13).astype(U)
    which = np.frombuffer(data, "<u2" if n <= 0x10000 else "<u4", offset=13 + n * (8 if wide else 4))
    return (np.cumsum(steps, dtype=U).view(np.int64) + first)[which]


#: 1: a smaller document of another chunk has this context; 2: no smaller one has, and the anchor
#: has other contexts, in several documents.
HELD, SHIP = 1, 2
VERDICTS = "bucket int, chunk long, verdicts binary"


def _judge(rows: list[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    sizes = [r["n"] for r in rows]
    a = np.concatenate([_from_six(r["hashes"][:6 * n]) for r, n in zip(rows, sizes)])
    c = np.concatenate([_from_six(r["hashes"][6 * n:]) for r, n in zip(rows, sizes)])
    doc = np.concatenate([_unpack_ids(r["docs"]) for r in rows])
    several = np.concatenate([np.unpackbits(np.frombuffer(r["several"], np.uint8), count=n)
                              for r, n in zip(rows, sizes)])
    # anchors together, and their contexts but for rare ties, which only make two of one context
    order = np.argsort((a << U(16)) | (c & U(0xFFFF)))
    a, c, doc, several = a[order], c[order], doc[order], several[order]
    new_a = np.concatenate(([True], a[1:] != a[:-1]))
    new_c = new_a | np.concatenate(([True], c[1:] != c[:-1]))
    starts = np.flatnonzero(new_a)
    of_a = np.cumsum(new_a) - 1
    spread = (np.minimum.reduceat(doc, starts) < np.maximum.reduceat(doc, starts))
    spread |= np.maximum.reduceat(several, starts) > 0
    contexts = np.add.reduceat(new_c.astype(np.int64), starts)
    least = np.minimum.reduceat(doc, np.flatnonzero(new_c))[np.cumsum(new_c) - 1]
    verdict = np.where(doc > least, HELD, np.where((spread & (contexts > 1))[of_a], SHIP, 0))
    back = np.empty(len(order), np.uint8)
    back[order] = verdict
    cuts = np.cumsum(sizes)[:-1]
    yield from _emit([(r["bucket"], r["chunk"], v.tobytes())
                      for r, v in zip(rows, np.split(back, cuts)) if v.any()], schema)


def _by_bucket(work, ddl: str):
    """Rows sorted by bucket: ``work`` on all rows of each."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, schema = [], arrow_schema(ddl)
        for b in batches:
            for row in b.to_pylist():
                if rows and rows[-1]["bucket"] != row["bucket"]:
                    yield from work(rows, schema)
                    rows = []
                rows.append(row)
        if rows:
            yield from work(rows, schema)
    return run


#: Contexts to compare: their entries in (chunk, bucket), hashes of their anchors, owners, bytes.
SHIPPED = "bucket int, chunk long, entries binary, anchors binary, owners binary, lefts binary, " \
          "sizes binary, data binary"


def _verdicts_of(x: Anchors, row: dict, buckets: int) -> np.ndarray:
    verdicts = np.zeros(len(x.a), np.uint8)
    told = {v["bucket"]: v["verdicts"] for v in row["told"] or ()}
    for bucket, lo, hi in x.buckets(buckets):
        if told.get(bucket):
            verdicts[lo:hi] = np.frombuffer(told[bucket], np.uint8)
    return verdicts


def _ship(buckets: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(SHIPPED)
        for b in batches:
            for row in b.to_pylist():
                ids, texts = _open(row)
                x = Anchors(ids, texts)
                verdicts = _verdicts_of(x, row, buckets)
                # of each entry, a position in its smallest document
                some = np.flatnonzero((verdicts == SHIP)[x.entry] & (ids[x.doc] == x.first[x.entry]))
                entries, pick = np.unique(x.entry[some], return_index=True)
                at = some[pick]
                out = []
                for bucket, lo, hi in x.buckets(buckets):
                    p, q = np.searchsorted(entries, (lo, hi))
                    if p == q:
                        continue
                    parts = [row["data"][i:j] for i, j in zip(x.lo[at[p:q]], x.hi[at[p:q]])]
                    out.append((bucket, row["chunk"], (entries[p:q] - lo).tobytes(),
                                x.a[entries[p:q]].tobytes(), x.first[entries[p:q]].tobytes(),
                                (x.at - x.lo)[at[p:q]].astype(np.uint8).tobytes(),
                                np.array([len(t) for t in parts], np.uint8).tobytes(),
                                b"".join(parts)))
                yield from _emit(out, schema)
    return run


#: Found strings: entry of (chunk, bucket) and offset in its context of each run of starts.
FOUND = "bucket int, chunk long, entries binary, starts binary, ends binary"


def _halves(anchors: np.ndarray, owners: np.ndarray, lefts: np.ndarray, sizes: np.ndarray,
            data: np.ndarray) -> np.ndarray:
    """Contexts that can share a string with one of another owner: a string around an anchor holds
    half of its reach before the anchor or half of it behind, so one of these must be shared."""
    half = REACH // 2
    power, inverse = _powers(len(data) + 1)[:2]
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(_CONTEXT[data] * power[:len(data)], out=sums[1:])
    at = np.cumsum(sizes) - sizes + lefts
    keep = np.zeros(len(anchors), bool)
    for lo, hi, there in ((at - half, at, lefts >= half),
                          (at + ANCHOR, at + ANCHOR + half, sizes - lefts - ANCHOR >= half)):
        which = np.flatnonzero(there)
        lo, hi = lo[which], hi[which]
        key = mix(((sums[hi] - sums[lo]) * inverse[lo]) ^ mix(anchors[which]))
        order = np.lexsort((owners[which], key))
        key, who = key[order], owners[which][order]
        new = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
        starts = np.flatnonzero(new)
        if len(starts):
            several = np.minimum.reduceat(who, starts) < np.maximum.reduceat(who, starts)
            keep[which[order]] |= several[np.cumsum(new) - 1]
    return keep


def _expand(rows: list[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Transforms over groups of whole anchors, about ``TEXT`` bytes each."""
    read = lambda c, kind: np.concatenate([np.frombuffer(r[c], kind) for r in rows])
    sizes, lefts = read("sizes", np.uint8).astype(np.int64), read("lefts", np.uint8).astype(np.int64)
    anchors, owners, entries = read("anchors", U), read("owners", np.int64), read("entries", np.int64)
    data = b"".join(r["data"] for r in rows)
    source = np.repeat(np.arange(len(rows)), [len(r["sizes"]) for r in rows])
    ends = np.cumsum(sizes)
    some = np.flatnonzero(_halves(anchors, owners, lefts, sizes, np.frombuffer(data, np.uint8)))
    order = some[np.argsort(anchors[some], kind="stable")]
    new = np.flatnonzero(np.concatenate(([True], anchors[order][1:] != anchors[order][:-1])))
    part = np.cumsum(sizes[order] + 1)[new] // TEXT if len(order) else np.zeros(0, np.int64)
    cuts = new[np.flatnonzero(np.diff(part)) + 1]  # anchors that end in one stretch go together
    found: list[list[np.ndarray]] = [[] for _ in rows]
    for group in np.split(order, cuts) if len(order) else []:
        texts = [data[ends[i] - sizes[i]:ends[i]] for i in group]
        for i, s in zip(group, repeated_starts(texts, owners[group], LENGTH)):
            if len(s):
                gap = np.flatnonzero(np.diff(s) > 1)
                first = s[np.concatenate(([0], gap + 1))]
                last = s[np.concatenate((gap, [len(s) - 1]))]
                found[source[i]].append(np.stack((np.full(len(first), entries[i]), first, last)))
    out = []
    for r, f in zip(rows, found):
        if f:
            e, s, t = np.concatenate(f, axis=1)
            out.append((r["bucket"], r["chunk"], e.tobytes(), s.tobytes(), t.tobytes()))
    yield from _emit(out, schema)


RESULT = "k long, n_bytes long, n_removed long, n_spans long, kept binary"


def _cover(x: Anchors, ids: np.ndarray, row: dict, buckets: int) -> np.ndarray:
    """Which bytes of a chunk to remove."""
    verdicts = _verdicts_of(x, row, buckets)
    change = np.zeros(len(x.data) + 1, np.int64)

    def mark(lo: np.ndarray, hi: np.ndarray) -> None:
        np.add.at(change, lo, 1)
        np.add.at(change, hi, -1)

    # a whole context that a smaller document has, in this chunk or in another
    whole = ((verdicts == HELD)[x.entry] | (ids[x.doc] > x.first[x.entry])) & (x.hi - x.lo >= LENGTH)
    mark(x.lo[whole], x.hi[whole])
    order = np.argsort(x.entry, kind="stable")
    first = np.searchsorted(x.entry[order], np.arange(len(x.a) + 1))  # of each entry in that order
    base = {b: lo for b, lo, _ in x.buckets(buckets)}
    for found in row["found"] or ():
        entry, lo, hi = (np.frombuffer(found[c], np.int64) for c in ("entries", "starts", "ends"))
        a = first[entry + base[found["bucket"]]]
        n = first[entry + base[found["bucket"]] + 1] - a  # every position of the entry
        which = order[np.arange(n.sum()) + np.repeat(a - (np.cumsum(n) - n), n)]
        mark(x.lo[which] + np.repeat(lo, n), x.lo[which] + np.repeat(hi, n) + LENGTH)
    return np.cumsum(change[:-1]) > 0


def _finish(buckets: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(RESULT)
        for b in batches:
            for row in b.to_pylist():
                ids, texts = _open(row)
                x = Anchors(ids, texts)
                gone = _cover(x, ids, row, buckets)
                out = []
                for k, t, lo, hi in zip(ids.tolist(), texts, x.starts, x.ends):
                    g = gone[lo:hi]
                    n = int(g.sum())
                    spans = int(g[:1].sum() + (g[1:] & ~g[:-1]).sum()) if n else 0
                    kept = x.data[lo:hi][~g].tobytes() if n else t
                    out.append((k, len(t), n, spans, kept))
                yield from _emit(out, schema)
    return run


def substring_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for every row of ``docs``.

    Removed is each byte of a text (in UTF-8) covered by a string of 50 bytes that also starts in
    a document with a smaller id; strings overlap freely and are judged on the input. n_spans
    counts the maximal removed runs; kept (binary) is what remains.

    A null text is empty. A null id is one id smaller than all others. Rows that repeat an id are
    one document: none removes from another. Other columns are not read. An empty table gives an
    empty result.

    Scale: what moves of the whole corpus is about one hash pair for 14 bytes, one for equal
    contexts of a chunk, dealt by the anchor's hash into buckets of about ``BUCKET``; then the
    chunks themselves twice, to meet their verdicts and what was found. Contexts move only where
    an anchor has several. Everything is judged exactly, up to collisions of 96-bit hashes.
    """
    spark = docs.sparkSession
    d = docs.select(id_key(doc_id).alias("k"),
                    F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    chunks = stage(d.mapInArrow(_chunks, CHUNKED), "chunks", compression="zstd")
    size = chunks.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    buckets = max(shuffle_partitions(spark), -(-size // (14 * BUCKET)))

    def by_bucket(rows: DataFrame, work, ddl: str, name: str) -> DataFrame:
        dealt = rows.repartition(buckets, "bucket").sortWithinPartitions("bucket")
        return stage(dealt.mapInArrow(_by_bucket(work, ddl), ddl), name)

    verdicts = by_bucket(chunks.mapInArrow(_hashes(buckets), HASHES), _judge, VERDICTS, "verdicts")
    told = chunks.join(verdicts.groupBy("chunk").agg(
        F.collect_list(F.struct("bucket", "verdicts")).alias("told")), "chunk", "left")
    free(spark)
    found = by_bucket(told.mapInArrow(_ship(buckets), SHIPPED), _expand, FOUND, "found")
    found = found.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "entries", "starts", "ends"))
                                       .alias("found"))
    free(spark)
    out = told.join(found, "chunk", "left").mapInArrow(_finish(buckets), RESULT)
    return out.select(id_back(F.col("k")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")
