"""Token ids in length-delimited binary records with a separate offset index.

A record is

    u64 n | u32 masked crc32 of those 8 bytes | payload of n bytes | u32 masked crc32 of the payload | 0x0A

in little-endian order, where a payload is ``i64 doc_id | u8 width | ids of that width``. The
closing 0x0A is the record end that Spark's text writer puts; lengths, not that byte, delimit the
records. Spark's own writer makes the files, so the folder can be in any store Spark writes to and
a lost task leaves nothing half written.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadence.llm.common import arrow_schema, id_back, id_key

#: Fixed values of the format.
MASK_DELTA = 0xA282EAD8
HEAD = struct.Struct("<QI")
META = struct.Struct("<qB")
TAIL = struct.Struct("<I")
END = b"\n"
#: ASCII punctuation, and a character that is a blank to some versions of Unicode.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
ODD = "\u180e"
#: Words that a worker remembers with their ids.
CACHE = 800_000


def masked_crc(data: bytes) -> int:
    """crc32 rotated by 15 bits plus a constant, so that a checksum of a checksum stays sound."""
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(doc_id: int, width: int, ids: bytes) -> bytes:
    payload = META.pack(doc_id, width) + ids
    n = struct.pack("<Q", len(payload))
    return b"".join((n, TAIL.pack(masked_crc(n)), payload, TAIL.pack(masked_crc(payload))))


def read_frame(data, at: int) -> tuple[int, np.ndarray, int]:
    """doc_id, ids (unsigned 32 bit) and the next offset; raises if a checksum is wrong."""
    n, crc = HEAD.unpack_from(data, at)
    if masked_crc(bytes(data[at:at + 8])) != crc:
        raise ValueError(f"record at {at}: the length is damaged")
    lo = at + HEAD.size
    payload = bytes(data[lo:lo + n])
    if len(payload) < n or masked_crc(payload) != TAIL.unpack_from(data, lo + n)[0]:
        raise ValueError(f"record at {at}: the payload is damaged")
    doc_id, width = META.unpack_from(payload)
    ids = np.frombuffer(payload, "<u2" if width == 2 else "<u4", offset=META.size)
    return doc_id, ids.astype("<u4"), lo + n + TAIL.size + len(END)


def _byte_letters() -> dict[int, str]:
    """The printable letter that a byte-level vocabulary writes for each byte: printable Latin-1
    characters stand for themselves, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Irregular(Exception):
    """Blanks next to blanks: the text is encoded whole."""


class Words(dict):
    """Ids of words as little-endian bytes, through the tokenizers library; remembers them.

    ``lead`` stands before each word: a blank, or nothing at the start of a line. A run of letters
    is one word to the library's model, and a run of ASCII punctuation behind it another.
    """

    def __init__(self, tok, lead: str):
        self.tok, self.model, self.lead = tok, tok.model, lead
        self.kind = "<u2" if tok.get_vocab_size() <= 0x10000 else "<u4"
        self.letters = _byte_letters()
        self.marks: dict[str, bytes] = {}

    def raw(self, text: str) -> bytes:
        return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def __missing__(self, word: str) -> bytes:
        if not word or word[0] in ODD or word[-1] in ODD or word[0].isspace() or word[-1].isspace():
            raise Irregular
        core = word.rstrip(PUNCTUATION)
        if not core.isalpha():
            ids = self.raw(self.lead + word)
        elif core != word:
            mark = word[len(core):]
            if mark not in self.marks:
                self.marks[mark] = self.raw(mark)
            ids = self[core] + self.marks[mark]
        else:
            data = (self.lead + word).encode().decode("latin-1").translate(self.letters)
            ids = np.asarray([t.id for t in self.model.tokenize(data)], self.kind).tobytes()
        self[word] = ids
        return ids


class TextEncoder:
    """Ids of a text as little-endian bytes.

    A byte-level vocabulary splits a text before each single blank and around each single newline
    that stands between two other characters, whatever stands further off. So the words of such
    texts are encoded once; texts with other blanks go to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        tok = Tokenizer.from_file(path)
        self.special = [t.content for t in tok.get_added_tokens_decoder().values()]
        self.first, self.spaced = Words(tok, ""), Words(tok, " ")
        self.kind = self.first.kind
        self.width = int(self.kind[-1])
        self.newline = self.first.raw("\n")

    def encode(self, text: str) -> bytes:
        for words in (self.first, self.spaced):
            if len(words) > CACHE or len(words.marks) > CACHE:
                words.clear()
                words.marks.clear()
        if any(s in text for s in self.special):
            return self.first.raw(text)
        try:
            lines = []
            for line in text.split("\n"):
                words = line.split(" ")
                lines.append(b"".join([self.first[words[0]],
                                       *map(self.spaced.__getitem__, words[1:])]))
            return self.newline.join(lines)
        except Irregular:
            return self.first.raw(text)


_ENCODERS: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """One for each worker process and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]


def _frames(path: str, end_id: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard, seq = encoder(path), TaskContext.get().partitionId(), 0
        end = np.asarray([end_id], enc.kind).tobytes()
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                out = [frame(k, enc.width, enc.encode(t) + end) for k, t
                       in zip(part.column("k").to_pylist(), part.column("t").to_pylist())]
                yield pa.record_batch([pa.array([shard] * len(out), pa.int32()),
                                       pa.array(range(seq, seq + len(out)), pa.int64()),
                                       pa.array(out, pa.binary())], names=["shard", "seq", "frame"])
                seq += len(out)
    return run


def write_records(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0,
                  text: str = "text", doc_id: str = "doc_id",
                  shard_bytes: int = 16 << 20) -> None:
    """Encode every whole text, append ``end_id``, write ``path``/records and ``path``/index.

    Shards are ranges of ids, about ``shard_bytes`` of text each; records stand in ascending id
    order, over shards and in each. A null text is empty and gives only the end id; a null id
    comes first (stored as the smallest 64-bit integer). Rows of one id are ordered by a hash of
    their text and each get a record. An empty table gives no record. Other columns are not read.

    Scale: the texts move once, to the tasks of their ranges; a task streams its range, so only a
    batch and the remembered words are in memory. The index takes one pass over the files.
    """
    spark = docs.sparkSession
    d = docs.select(id_key(doc_id).alias("k"),
                    F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    size = d.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    d = d.withColumn("h", F.xxhash64("t"))
    dealt = d.repartitionByRange(shards, "k", "h").sortWithinPartitions("k", "h")
    framed = dealt.select("k", "t").mapInArrow(_frames(tokenizer, end_id),
                                               "shard int, seq long, frame binary")
    (framed.sortWithinPartitions("shard", "seq")
     .select("shard", F.col("frame").cast("string").alias("value"))
     .write.partitionBy("shard").text(f"{path}/records"))
    _write_index(spark, path)


SCAN = "shard int, seq long, k long, offset long, size long, n_tokens long, ids_crc32 long"


def _scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = arrow_schema(SCAN)
    for b in batches:
        for shard, content in zip(b.column("shard").to_pylist(), b.column("content")):
            data = memoryview(content.as_buffer())
            rows, at, seq = [], 0, 0
            while at < len(data):
                k, ids, nxt = read_frame(data, at)
                rows.append((shard, seq, k, at, nxt - at, len(ids), zlib.crc32(ids.tobytes())))
                at, seq = nxt, seq + 1
            for lo in range(0, len(rows), 10_000):
                cols = zip(*rows[lo:lo + 10_000])
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, schema)],
                                      schema=schema)


def _files(spark: SparkSession, path: str) -> DataFrame:
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "part-*")
             .option("recursiveFileLookup", True).load(f"{path}/records"))
    shard = F.regexp_extract("path", r"/shard=([0-9]+)/", 1).cast("int")
    return files.select(shard.alias("shard"), "content")


def scan_records(spark: SparkSession, path: str) -> DataFrame:
    """Read all record files back, checksums included: a row for each record."""
    return _files(spark, path).mapInArrow(_scan, SCAN)


def _write_index(spark: SparkSession, path: str) -> None:
    """shard, seq, doc_id, offset, size, n_tokens and start: the tokens of all records before.

    Running sums: in a shard, over the shards of a group of 1,000, and over the groups.
    """
    own = scan_records(spark, path).drop("ids_crc32")
    own.write.parquet(f"{path}/index-own")
    own = spark.read.parquet(f"{path}/index-own")
    before = lambda *by: (W.partitionBy(*by[:-1]).orderBy(by[-1])
                          .rowsBetween(W.unboundedPreceding, -1))
    shards = own.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    shards = shards.withColumn("part", F.floor(F.col("shard") / 1000))
    parts = shards.groupBy("part").agg(F.sum("n").alias("n"))
    parts = parts.select("part", F.sum("n").over(before(F.lit(0), "part")).alias("far"))
    shards = (shards.withColumn("near", F.sum("n").over(before("part", "shard")))
              .join(parts, "part")
              .select("shard", (F.coalesce("far", F.lit(0)) + F.coalesce("near", F.lit(0)))
                      .alias("base")))
    inside = own.withColumn("sofar", F.sum("n_tokens").over(before("shard", "seq")))
    (inside.join(shards, "shard")
     .select("shard", "seq", id_back(F.col("k")).alias("doc_id"), "offset", "size", "n_tokens",
             (F.col("base") + F.coalesce("sofar", F.lit(0))).alias("start"))
     .write.parquet(f"{path}/index"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/index")


def _fetch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = arrow_schema("place long, doc_id long, ids binary")
    for b in batches:
        for content, places, offsets in zip(b.column("content"), b.column("places").to_pylist(),
                                            b.column("offsets").to_pylist()):
            data = memoryview(content.as_buffer())
            for lo in range(0, len(places), 1000):
                got = [read_frame(data, at) for at in offsets[lo:lo + 1000]]
                yield pa.record_batch([
                    pa.array(places[lo:lo + 1000], pa.int64()),
                    pa.array([None if k == -(1 << 63) else k for k, _, _ in got], pa.int64()),
                    pa.array([x.tobytes() for _, x, _ in got], pa.binary())], schema=schema)


def read_shuffled(spark: SparkSession, path: str, seed: int, share: float = 1.0) -> DataFrame:
    """Records by the index alone, at a place drawn by ``seed``: place, doc_id, ids (binary,
    unsigned 32 bit). ``share`` under 1 reads that share of the records. Order by place, or
    repartitionByRange on it, to feed a trainer."""
    place = F.xxhash64(F.lit(seed), "shard", "seq").alias("place")
    want = read_index(spark, path).select("shard", "offset", place)
    if share < 1:
        want = want.filter(F.pmod("place", F.lit(1_000_000)) < int(share * 1_000_000))
    want = want.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("offset", "place")))
                                     .alias("w"))  # a shard's records: bounded by shard_bytes
    return (_files(spark, path).join(want, "shard")
            .select("content", F.col("w.place").alias("places"), F.col("w.offset").alias("offsets"))
            .mapInArrow(_fetch, "place long, doc_id long, ids binary"))


def records_digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32: lengths and checksums from the files, starts from the
    index."""
    got = scan_records(spark, path).select("shard", "seq", "k", "n_tokens", "ids_crc32")
    starts = read_index(spark, path).select("shard", "seq", "start")
    return got.join(starts, ["shard", "seq"]).select(
        id_back(F.col("k")).alias("doc_id"), "start", "n_tokens", "ids_crc32")
