"""Secret scans against the plain patterns."""

import hashlib
import random
import re

import pytest

from cadence.llm.secrets import BASE, RULES, Rule, find_secrets, trigram_query

PLAIN = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                          re.I | re.A), lambda m: len(m[2]) >= 12),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 16),
}


def brute(text):
    kinds = list(PLAIN)
    found = [(m.start(), kinds.index(k), m.end()) for k, (p, ok) in PLAIN.items()
             for m in p.finditer(text) if ok(m)]
    return ",".join(f"{kinds[k]}:{lo}:{hi}" for lo, k, hi in sorted(found))


def base_of(spans):
    return ",".join(s for s in spans.split(",") if s.split(":")[0] in PLAIN)


def run(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in find_secrets(docs).collect()}


def test_random_strings_against_patterns(spark):
    rng = random.Random(3)
    words = ["password", "PassWd", "secret", "Token", "api_key", "APIKEY", "AKIA", "deadbeef0", "0123456789abcdef",
             "=", ":", " ", '"', "'", "ABCDEF12", "xyz", "é", "\U0001f600", "\n", ".", "_", "-", "-----BEGIN "]
    texts = ["".join(rng.choice(words) for _ in range(rng.randrange(1, 14))) for _ in range(4000)]
    got = run(spark, texts)
    hits = 0
    for i, t in enumerate(texts):
        want = brute(t)
        hits += want != ""
        assert base_of(got[i].spans) == want, t
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in PLAIN] == [want.count(k) for k in PLAIN]
    assert hits > 500


def test_added_rules(spark):
    texts = ["x -----BEGIN RSA PRIVATE KEY----- y", "ghp_" + "a1B2" * 9, "xoxb-12345678901-ab", "AIza" + "x" * 35,
             "eyJhbGciOiJI.eyJzdWIiOiIx.abcdefghijk sk_live_" + "Z9" * 12, "ghq_" + "a1B2" * 9]
    got = run(spark, texts)
    assert got[0].spans == "private_key:2:33" and got[1].spans == "code_host:0:40"
    assert got[2].spans == "chat:0:19" and got[3].spans == "cloud_api:0:39"
    assert got[5].spans == "" and got[4].n_web_token == 0 and got[4].n_payment == 1
    assert all(r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in got.values())


def test_queries_hold_for_every_match():
    rng = random.Random(4)
    rules = [r.pattern for r in RULES] + ["a(bcd|efg)+h", "(ab|cd){2,}xyz", "x?yzw[ab]?cde", "(one|two|three)four$",
                                          "[a-z]bc", "(abc)*de"]
    alphabet = ["password", "token", "api", "_", "key", "AKIA", "gho_", "a", "bcd", "efg", "h", "ab", "cd", "xyz", "x",
                "yzw", "cde", "one", "two", "three", "four", "=", "abc", "de", "Q" * 40]
    for p in rules:
        query = trigram_query(p)
        for _ in range(3000):
            t = "".join(rng.choice(alphabet) for _ in range(6))
            for m in re.finditer(p, t):
                low = m[0].lower()
                assert query is None or any(all(g in low for g in c) for c in query), (p, m[0])
    assert trigram_query("[a-z]bc") is None and trigram_query("(abc)*de") is None
    assert trigram_query("a(bcd|efg)+h") is not None
    assert [r.kind for r in BASE if trigram_query(r.pattern) is None] == ["hex"]


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in find_secrets(docs).collect()}
    rows = docs.collect()
    assert len(got) == len(rows) and sum(bool(brute(r.text or "")) for r in rows) > 2
    for r in rows:
        assert base_of(got[r.doc_id].spans) == brute(r.text or "")
        assert (got[r.doc_id].source, got[r.doc_id].text) == (r.source, r.text)


def test_edge_rows(spark):
    key = "token=abcdefghijkl"
    rows = [(1, None, "a", "x"), (1, "", "b", "x"), (None, key, "c", "x"), (None, key, "c", "x"), (2, "", "d", "x"),
            (3, "é " * 300_000 + key, "e", "x"), (4, f"{key} " * 30_000, "f", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, k string")
    got = sorted(find_secrets(docs).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    assert [r.n_assign for r in got] == [0, 0, 0, 1, 30_000, 1, 1]
    assert got[3].spans == "assign:600000:600018" and got[5].spans == "assign:0:18"
    assert got[4].spans.split(",")[29_999] == f"assign:{19 * 29_999}:{19 * 29_999 + 18}"
    assert {r.k for r in got} == {"x"} and got[0].text is None
    assert find_secrets(docs.limit(0)).count() == 0


@pytest.mark.parametrize("rules", [(Rule("hex", r"[0-9a-f]{16,}"),), (Rule("t", "tok[a-z]+", least=6),)])
def test_other_rules(spark, rules):
    docs = spark.createDataFrame([(1, "tokab tokabc 0123456789abcdef0")], "doc_id long, text string")
    r = find_secrets(docs, rules, base=1).first()
    assert r.spans == ("hex:13:30" if rules[0].kind == "hex" else "t:6:12")
