import hashlib
import random

import numpy as np
import public_tokenizers
import sentencepiece

from cadence.llm.pieces import PieceCodec, encode_pieces, piece_digest

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)


def want(text):
    ids = LIBRARY.encode(text, add_bos=True, add_eos=True)
    return ids, LIBRARY.decode(ids)


def test_codec_equals_library():
    codec, rng = PieceCodec(PATH), random.Random(1)
    words = list(codec.ids)
    texts = [" " * n for n in range(60)] + ["a" + " " * n + "b" for n in range(60)]
    for i in range(6000):
        make = (lambda: rng.choice("aeinrst e.\n"), lambda: rng.choice(words),
                lambda: rng.choice("thing ▁ éß漢😀\0\tÀ一́"),
                lambda: rng.choice(words).replace("▁", " "))[i % 4]
        texts.append("".join(make() for _ in range(rng.randrange(12))))
    for t in texts:
        ids, text = want(t)
        got = np.frombuffer(codec.encode(t), "<u4")
        assert got.tolist() == ids and codec.decode(got) == text, repr(t)


def test_long_text_without_blanks():
    codec, t = PieceCodec(PATH), "abcdefghij" * 30_000
    assert np.frombuffer(codec.encode(t), "<u4").tolist() == want(t)[0]


def test_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in piece_digest(docs, PATH).collect()}
    for r in docs.collect():
        ids, text = want(r.text or "")
        assert got[r.doc_id] == (len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(),
                                 hashlib.sha256(text.encode()).hexdigest())


def test_edge_rows(spark):
    docs = spark.createDataFrame([(None, None, "a"), (1, "", "b"), (1, "Zwei  Wörter", "c")],
                                 "doc_id long, text string, ids string")
    got = encode_pieces(docs, PATH)
    assert got.columns == ["doc_id", "text", "n_tokens", "ids", "decoded"]
    assert [(r.n_tokens, r.decoded) for r in got.collect()] == [(2, ""), (2, ""),
                                                               (len(want("Zwei  Wörter")[0]), "Zwei  Wörter")]
    assert encode_pieces(docs.limit(0), PATH).count() == 0
