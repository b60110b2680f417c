import zlib

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from cadence.llm import token_records as T
from cadence.llm.common import scratch

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_frames_and_damage():
    ids = np.array([5, 0, 50256], "<u2")
    data = T.END.join((T.frame(7, 2, ids.tobytes()), T.frame(-(1 << 63), 2, b""), b""))
    k, got, nxt = T.read_frame(data, 0)
    assert (k, got.tolist()) == (7, [5, 0, 50256])
    assert T.read_frame(data, nxt)[:1] == (-(1 << 63),) and T.read_frame(data, nxt)[2] == len(data)
    for at in range(len(T.frame(7, 2, ids.tobytes()))):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            T.read_frame(bytes(bad), 0)


def test_encoder_equals_library():
    import random
    rng, enc, tok = random.Random(3), T.TextEncoder(PATH), Tokenizer.from_file(PATH)
    parts = ["a", "th", "'s", " ", "\n", ",", ".", "é", "1", "ⅷ", "²", "漢", "😀", "\t", " ",
             "́", "!", "  ", " x", "\0", "\x1c", "᠎", "ª", "<|endoftext|>"]
    for _ in range(5000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(9)))
        assert enc.encode(t) == np.asarray(tok.encode(t, add_special_tokens=False).ids, "<u2").tobytes()


def digest(rows):
    tok, start, out = Tokenizer.from_file(PATH), 0, []
    for k, t in rows:
        ids = np.asarray([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((k, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_round_trip_of_a_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    path = scratch(spark, "records")
    T.write_records(docs, path, PATH, shard_bytes=30_000)
    got = sorted(tuple(r) for r in T.records_digest(spark, path).collect())
    assert got == digest(sorted((r.doc_id, r.text) for r in docs.collect()))
    index = T.read_index(spark, path).collect()
    assert len({r.shard for r in index}) > 3
    # shards and records stand in ascending order
    order = [r.doc_id for r in sorted(index, key=lambda r: (r.shard, r.offset))]
    assert order == sorted(order)
    # shuffled reads by the index: every record once, another order for another seed
    a, b = (T.read_shuffled(spark, path, s).orderBy("place").collect() for s in (1, 2))
    assert sorted(r.doc_id for r in a) == order and [r.doc_id for r in a] != [r.doc_id for r in b]
    want = {k: n for k, _, n, _ in got}
    assert all(len(r.ids) == 4 * want[r.doc_id] for r in a)


def test_edge_rows(spark):
    rows = [(2, "b"), (None, "null id"), (1, None), (3, ""), (3, "x " * 40_000), (3, "x " * 40_000)]
    docs = spark.createDataFrame([(*r, 1, "s") for r in rows],
                                 "doc_id long, text string, shard int, seq string")
    path = scratch(spark, "records")
    T.write_records(docs, path, PATH)
    got = sorted((tuple(r) for r in T.records_digest(spark, path).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, 1, 2, 3, 3, 3]
    assert [r[1] for r in got] == [sum(x[2] for x in got[:i]) for i in range(6)]
    assert {r[2:] for r in got} == {r[2:] for r in digest(rows)}
    empty = scratch(spark, "records")
    T.write_records(docs.limit(0), empty, PATH)
    assert T.records_digest(spark, empty).count() == 0 and T.read_shuffled(spark, empty, 1).count() == 0
