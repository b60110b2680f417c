import random
import zlib

from cadence.llm.language import SAMPLE_ROWS, STRETCH, Parser, identify, predict_language, suffix_automaton, training_sample


def plain_phrases(training, text):
    n = at = 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at:at + size + 1] in training:
            size += 1
        n, at = n + 1, at + size
    return n


def test_automaton_holds_exactly_the_substrings():
    rng = random.Random(1)
    for _ in range(40):
        t = [rng.randrange(3) for _ in range(rng.randrange(1, 14))]
        step = suffix_automaton(t)
        subs = {tuple(t[i:j]) for i in range(len(t)) for j in range(i, len(t) + 1)}
        for s in subs | {tuple(rng.randrange(3) for _ in range(5)) for _ in range(20)}:
            state, ok = 0, True
            for c in s:
                ok = ok and c in step[state]
                state = step[state].get(c, 0)
            assert ok == (s in subs)


def test_phrases_against_search():
    rng = random.Random(2)
    training = {"a": "abracadabra alakazam", "b": "blub blab blob"}
    parser = Parser(training)
    texts = ["".join(rng.choice("abrlkz uo") for _ in range(rng.randrange(1, STRETCH))) for _ in range(60)]
    counts, _, _ = parser.phrases(texts)
    for t, row in zip(texts, counts):
        t = " ".join(t.split()) + (" " if t[-1:] == " " and t.strip() else "")
        if t.strip():
            assert row.tolist() == [plain_phrases(training[n], t) for n in ("a", "b")]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = {r.doc_id: r for r in identify(docs).collect()}
    rows = docs.collect()
    assert len(found) == len(rows)
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(found[r.doc_id].lang_pred == r.lang for r in held) / len(held) > 0.97
    assert {r.doc_id for r in held} == {k for k, f in found.items() if f.held_out}
    assert all(0 <= f.score <= 1 for f in found.values())


def test_training_rows(spark):
    rows = [(i, f"word{i}", "xx" if i % 2 else "yy") for i in range(40)] + [(50, "no label", None), (None, "n", "zz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    want = {}
    for k, t, lang in rows[:40]:
        if zlib.crc32(str(k).encode()) % 5:
            want.setdefault(lang, set()).add(t)
    assert {k: set(v.split("\n")) for k, v in training_sample(docs).items()} == want


def test_edge_rows(spark):
    schema = "doc_id long, text string, lang string, lang_pred string"
    rows = [(1, None, "en", "x"), (None, "", "en", "x"), (2, " 12 ..", "en", "x"), (2, "the house", None, "x"),
            (3, "das haus und " * 20_000, None, "x"), (4, "漢字", None, "x")]
    docs = spark.createDataFrame(rows, schema)
    training = {"en": "the house and the garden", "de": "das haus und der garten"}
    got = predict_language(docs, training)
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "lang_score", "lang_bits"]
    assert [r.lang_pred for r in got.collect()] == ["und", "und", "und", "en", "de", "de"]
    assert {r.lang_pred for r in predict_language(docs, {}).collect()} == {"und"}
    assert identify(docs.limit(0)).count() == 0


def test_letters_beyond_the_table():
    """Scripts of thousands of letters: phrases as by plain search, languages told apart."""
    rng = random.Random(3)
    han = [chr(0x4E00 + i) for i in range(900)] + [chr(0x20000 + i) for i in range(100)]
    kana, hangul = [chr(0x3041 + i) for i in range(80)], [chr(0xAC00 + i) for i in range(700)]
    scripts = {"ja": kana + han[:300], "ko": hangul, "zh": han}
    words = {n: ["".join(rng.choice(s) for _ in range(rng.randrange(1, 5))) for _ in range(400)]
             for n, s in scripts.items()}
    text = lambda n, k: " ".join(rng.choice(words[n]) for _ in range(k))
    training = {n: text(n, 1500) for n in scripts}
    parser = Parser(training)
    assert parser.rare > 1000
    texts = [text(n, 25)[:STRETCH] for n in scripts for _ in range(20)]
    counts, _, _ = parser.phrases(texts)
    for t, row in zip(texts, counts):
        assert row.tolist() == [plain_phrases(training[n], t) for n in sorted(training)]
    found = [p for p, _, _ in parser.predict(texts)]
    assert found == [n for n in scripts for _ in range(20)]


def test_every_label_is_learned(spark):
    rows = [(i, f"text {i}", f"l{i % 300}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(training_sample(docs)) == 300


def test_sample_is_bounded_whatever_repeats(spark, monkeypatch):
    """Rows that repeat an id, or id and text, are no way around ``SAMPLE_ROWS``."""
    from pyspark.sql.classic.dataframe import DataFrame as Frame
    rows = [(1, f"text {i}", "xx") for i in range(3000)] + [(2, "same", "yy")] * 3000
    rows += [(3 + i, f"text {i}", "yy") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen, plain = [], Frame.collect
    monkeypatch.setattr(Frame, "collect", lambda self: seen.append(plain(self)) or seen[-1])
    training = training_sample(docs)
    by = [r.l for got in seen for r in got]
    assert max(by.count("xx"), by.count("yy")) <= SAMPLE_ROWS
    assert {n: len(set(t.split("\n"))) for n, t in training.items()} == {"xx": 400, "yy": 400}
    assert training == training_sample(docs.repartition(7))


def test_text_that_mixes_learned_languages_is_cheap():
    """Bits of a stretch are those of its best language, so a mixed text has no more than its parts."""
    rng = random.Random(6)
    words = {n: ["".join(rng.choice(s) for _ in range(rng.randrange(3, 8))) for _ in range(60)]
             for n, s in (("a", "abcdefg"), ("b", "mnopqrs"))}
    text = lambda n, k: "".join(rng.choice(words[n]) + " " for _ in range(k))
    parser = Parser({n: text(n, 2000) for n in words})
    parts = [text(n, 400)[:4 * STRETCH] for n in "ab"]
    bits = [b for _, _, b in parser.predict([*parts, "".join(parts), "xyz " * 300])]
    assert abs(bits[2] - (bits[0] + bits[1]) / 2) < 1e-9 and bits[3] > 3 * bits[2]
