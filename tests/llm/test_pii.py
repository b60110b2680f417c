"""Anchor expansion against the plain patterns."""

import hashlib
import random
import re

from cadence.llm.pii import BASE, Finder, find_pii, luhn, redact

PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def valid(kind, s):
    digits = re.sub("[^0-9]", "", s)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in s.split(".")),
            "card": 13 <= len(digits) <= 19 and luhn(digits),
            "phone": 9 <= len(digits) <= 15}[kind]


def brute(text):
    return [(k, m.start(), m.end()) for k in BASE for m in PATTERNS[k].finditer(text)
            if valid(k, m[0])]


def test_random_strings_against_patterns():
    rng, finder = random.Random(5), Finder()
    for alphabet in ("a@.-+ 1", "0123456789.", "0123456789 -+()", "ab@.x1 25+é,\n"):
        for _ in range(4000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))
            got = [(BASE[k], lo, hi) for k, lo, hi in finder.spans(text) if k < 4]
            assert got == brute(text), text


def test_planted_values():
    finder = Finder()
    text = ("Mail jo.x+1@a-b.co.uk, ip 10.0.0.255 or 256.1.1.1, card 4111 1111 1111 1111, "
            "call +44 (0)20 7946-0958. See https://x.org/a?b=1. IBAN: DE89 3704 0044 0532 0130 00")
    got = {(k, text[lo:hi]) for k, lo, hi in finder.spans(text)}
    assert {(0, "jo.x+1@a-b.co.uk"), (1, "10.0.0.255"), (2, "4111 1111 1111 1111"),
            (3, "+44 (0)20 7946-0958"), (4, "https://x.org/a?b=1"),
            (5, "DE89 3704 0044 0532 0130 00")} <= got
    assert [(BASE[k], lo, hi) for k, lo, hi in finder.spans(text) if k < 4] == brute(text)


def test_linear_on_long_runs():
    finder = Finder()
    assert finder.spans("1" * 300_000) == [] and finder.spans("a" * 300_000 + "@") == []
    assert finder.spans("1.2." * 100_000) is not None


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in find_pii(docs).collect()}
    assert len(got) == docs.count()
    hits = 0
    for r in docs.collect():
        want = brute(r.text or "")
        hits += len(want)
        told = ",".join(f"{k}:{lo}:{hi}" for k, lo, hi in want)
        assert got[r.doc_id].base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert [got[r.doc_id][f"n_{k}"] for k in BASE] == [sum(w[0] == k for w in want) for k in BASE]
        assert got[r.doc_id].spans.startswith(told)
    assert hits > 20


def test_edge_rows(spark):
    rows = [(1, None, "a"), (1, "", "b"), (None, "x@y.zz", "c"), (2, "né " * 50_000 + "1.2.3.4", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = find_pii(docs).collect()
    assert [(r.doc_id, r.n_email, r.n_ip) for r in got] == [
        (1, 0, 0), (1, 0, 0), (None, 1, 0), (2, 0, 1)]
    assert got[2].spans == "email:0:6" and got[3].spans == "ip:150000:150007"
    assert find_pii(docs.limit(0)).count() == 0
    assert [r.text for r in redact(docs).collect()][:3] == [None, "", "[email]"]
