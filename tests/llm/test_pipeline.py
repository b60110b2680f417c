"""The pipeline against a plain version of each stage on that stage's own input."""

import hashlib

import brute
import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline as P
from cadence.llm.common import stage
from cadence.llm.mixing import REST, schedule, shares
from cadence.llm.q_mixing import BLOCK, SEED, WEIGHTS


def test_stages(spark, tmp_path):
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in
            spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(9001, None, None, None, None), (9002, " 1 2 3", "en", "src0", 6), (9003, "", None, "src1", 0),
             (9004, rows[0][1], "en", "new", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, step in P.STAGES:
        seen[name + " in"] = docs.collect()
        docs = stage(step(spark, docs, str(tmp_path)), name)
        if name != "pieces":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen[name] = docs.select("*", "_metadata.file_name", "_metadata.row_index").collect()

    lettered = {r[0] for r in rows if any(c.isalpha() for c in r[1] or "")}
    assert {r.doc_id for r in seen["language"]} == lettered and 9002 not in lettered
    assert {(r.doc_id, r.text) for r in seen["language"]} == {r[:2] for r in rows if r[0] in lettered}

    want = brute.lines([(r.doc_id, r.text) for r in seen["lines in"]])
    assert {(r.doc_id, r.text, r.n_chars) for r in seen["lines"]} == \
           {(k, t, len(t)) for k, (_, _, t) in want.items()}

    want = brute.near([(r.doc_id, r.text) for r in seen["near in"]])
    assert {r.doc_id for r in seen["near"]} == {k for k, (_, c) in want.items() if k == c}

    named = [s for s in WEIGHTS if s is not None]
    slots = shares({**{s: WEIGHTS[s] for s in named}, REST: WEIGHTS[None]})
    plan, frame = schedule(slots), sum(slots.values())
    by, order = {}, []
    for r in seen["mix in"]:
        by.setdefault(r.source if r.source in named else REST, []).append(r.doc_id)
    for s, ids in by.items():
        ids.sort(key=lambda k: hashlib.md5(f"{SEED}:{k}".encode()).hexdigest())
        for n, k in enumerate(ids):
            frames, i = divmod(n // BLOCK, len(plan[s]))
            order.append((frames * frame + plan[s][i], n % BLOCK, k))
    written = sorted(seen["mix"], key=lambda r: (r.file_name, r.row_index))
    assert [r.doc_id for r in written] == [k for _, _, k in sorted(order)]

    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in seen["mix"]}
    assert sorted(r.doc_id for r in seen["pieces"]) == sorted(texts)
    for r in seen["pieces"]:
        ids = lib.encode(texts[r.doc_id], add_bos=True, add_eos=True)
        assert r.ids_sha256 == hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()

    out = P.run(spark, str(tmp_path))
    assert sorted(map(tuple, out.collect())) == sorted(tuple(r)[:-2] for r in seen["pieces"])


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_near_at_four_fifths(spark, tmp_path):
    """Pairs from 0.80 up to 0.85 are near duplicates, pairs below 0.80 are not."""
    words = lambda p: [f"{p}{i}" for i in range(104)]
    cut = lambda w, n: " ".join(w[:n])
    a, b, c = words("a"), words("b"), words("c")  # prefixes of 100 shingles: n - 4 of them shared
    rows = [(1, cut(a, 104)), (2, cut(a, 86)), (3, cut(b, 104)), (4, cut(b, 84)), (5, cut(c, 104)), (6, cut(c, 83))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.near(rows, percent=80)
    kept = {r.doc_id for r in dict(P.STAGES)["near"](spark, docs, str(tmp_path)).collect()}
    assert kept == {k for k, (_, comp) in want.items() if k == comp} == {1, 3, 5, 6}


def test_result_has_the_mixed_sequence(spark, tmp_path):
    """A hot source: the rows of the result, ordered by their places, are the mixed files."""
    steps = dict(P.STAGES)
    rows = [(k, f"text {k}", "en", "src0" if k % 3 else f"src{k % 7}", 9) for k in range(1500)] + [(7, "again", "en", None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    mixed = stage(steps["mix"](spark, docs, str(tmp_path)), "mix")
    files = mixed.select("doc_id", "_metadata.file_name", "_metadata.row_index").collect()
    out = stage(steps["pieces"](spark, mixed.repartition(5), str(tmp_path)), "pieces").collect()
    out.sort(key=lambda r: (r.mix_slot, r.mix_place))
    files.sort(key=lambda r: (r.file_name, r.row_index))
    assert len({(r.mix_slot, r.mix_place) for r in out}) == len(rows)
    assert [r.doc_id for r in out] == [r.doc_id for r in files]


def test_language_decides(spark, tmp_path):
    """Text of no learned language goes; without labels every text with a letter stays."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
            .select("doc_id", "text", "lang", "source", "n_chars").collect()]
    foreign = ["\u6f22\u5b57" * 200, "xq zvk wqj kxz vjq " * 40, "\u03b1\u03b2\u03b3 \u03b4\u03b5 " * 80]
    rows += [(900_000 + i, t, None, None, len(t)) for i, t in enumerate(foreign)]
    rows += [(910_000, "\u6f22", None, None, 1), (910_001, " 1 2", "en", None, 4), (910_002, None, "en", None, None)]
    docs = spark.createDataFrame(rows, schema)
    step = dict(P.STAGES)["language"]
    gone = {r[0] for r in rows} - {r.doc_id for r in step(spark, docs, str(tmp_path)).collect()}
    assert gone == {900_000, 900_001, 900_002, 910_001, 910_002}

    # a language without labels, in the script of those that have some
    some = docs.filter("doc_id < 900000").withColumn("lang", F.when(F.col("lang") != "de", F.col("lang")))
    stay = {r.doc_id for r in step(spark, some, str(tmp_path)).collect()}
    assert {r[0] for r in rows if r[0] < 900_000 and r[2] != "de"} <= stay
    foreign = {r[0] for r in rows if r[2] == "de" and len(r[1]) >= 256}  # shorter ones may pass
    assert len(foreign - stay) > 0.95 * len(foreign)

    bare = docs.withColumn("lang", F.lit(None).cast("string"))
    gone = {r[0] for r in rows} - {r.doc_id for r in step(spark, bare, str(tmp_path)).collect()}
    assert gone == {910_001, 910_002}


def test_rare_learned_script_stays(spark, tmp_path):
    """A learned language in a script of its own with little labelled text loses no document."""
    rng = np.random.default_rng(4)
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
            .select("doc_id", "text", "lang", "source", "n_chars").collect()]
    han = [chr(0x4E00 + i) for i in range(1500)]
    rows += [(500_000 + i, "".join(rng.choice(han, 300)), "zh" if i < 8 else None, "z", 300) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stay = {r.doc_id for r in dict(P.STAGES)["language"](spark, docs, str(tmp_path)).collect()}
    assert {500_000 + i for i in range(200)} <= stay


def test_the_mix_decides_the_places(spark, tmp_path):
    """The result's places are those of the files that mixing wrote, not a schedule made again."""
    rows = [(k, f"text {k}", "en", f"src{k % 3}", 9) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    places = {}
    for name, order in (("up", "doc_id"), ("down", F.desc("doc_id"))):
        mixed = stage(docs.repartitionByRange(3, order).sortWithinPartitions(order), name)
        out = stage(dict(P.STAGES)["pieces"](spark, mixed, str(tmp_path)), "pieces")
        places[name] = [r.doc_id for r in out.orderBy("mix_slot", "mix_place").collect()]
    assert places == {"up": list(range(300)), "down": list(range(299, -1, -1))}
