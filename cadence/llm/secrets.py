"""Secret scans with a trigram inverted index, with DataFrame functions only.

Each rule's regex is read once, on the driver, into a Boolean query: every match holds all trigrams
of one of its clauses. The index holds the postings (trigram, document) of the trigrams that the
rules ask for; intersecting postings gives a rule's candidate documents, and the regex runs on those
alone. Rules without a mandatory trigram scan all documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.llm.common import id_key, stage


@dataclass(frozen=True)
class Rule:
    """``kind``, a regex in the syntax that Java and Python share, and the length in code points
    that its group ``group`` must have (0: the whole match); shorter matches are dropped, and use
    up their text. ``either_case``: A-Z and a-z are one in the regex."""
    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    either_case: bool = False


#: Fixed values. hex and access say the least length in the regex: a run, or the first ``AKIA`` of
#: one, that is too short holds no longer match either.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         group=2, least=12, either_case=True),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
#: Well-known forms of keys.
ADDED = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("code_host", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("cloud_api", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("payment", r"sk_live_[A-Za-z0-9]{24,}"),
)
RULES = BASE + ADDED

#: What a regex may match, as alternatives: literal text, with a gap for anything else.
GAP = "\0"
#: Characters of a class, and alternatives, that are followed one by one; beyond them is a gap.
CHOICES, ALTERNATIVES = 8, 64


def _texts(tree: Iterable) -> set[str]:
    """The alternatives of a parsed regex, in lower case. A gap stands for any text, so that giving
    up detail only makes the query wider."""
    out = {""}
    for op, arg in tree:
        op = str(op)
        if op == "LITERAL":
            new = {chr(arg).lower()}
        elif op == "IN" and all(str(o) == "LITERAL" for o, _ in arg) and len(arg) <= CHOICES:
            new = {chr(c).lower() for _, c in arg}
        elif op == "SUBPATTERN":
            new = _texts(arg[-1])
        elif op == "BRANCH":
            new = set().union(*map(_texts, arg[1]))
        elif op == "MAX_REPEAT" and arg[0] == 0 and arg[1] == 1:
            new = {""} | _texts(arg[2])
        elif op == "MAX_REPEAT" and arg[0] > 0:  # once at least, then any text
            once = _texts(arg[2])
            new = once if arg[1] == 1 else {a + GAP + b for a in once for b in once}
        else:
            new = {"" if op == "AT" else GAP}
        out = {a + b for a in out for b in new}
        if len(out) > ALTERNATIVES:
            out = {a + GAP for a in {t.split(GAP)[0] for t in out}}
        if len(out) > ALTERNATIVES:
            out = {GAP}
    return out


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Clauses of trigrams in lower case: every match of ``pattern`` has all trigrams of one clause.
    None: there is a match without any trigram that could be asked for."""
    clauses = set()
    for text in _texts(re._parser.parse(pattern)):
        parts = text.split(GAP)
        clauses.add(frozenset(p[i:i + 3] for p in parts for i in range(len(p) - 2)))
    if frozenset() in clauses:
        return None
    return sorted((c for c in clauses if not any(o < c for o in clauses)), key=sorted)


def trigram_index(docs: DataFrame, trigrams: list[str], key: list[str], text: str) -> DataFrame:
    """Postings (trigram, *key): which of ``trigrams`` the lower-cased text holds.

    Narrow; a text is searched for each trigram, so nothing grows with the trigrams of a text, and
    a long text gives no more rows than there are trigrams."""
    low = docs.select(*key, F.lower(text).alias("t"))
    held = F.array_compact(F.array(*[F.when(F.contains("t", F.lit(g)), F.lit(g)) for g in trigrams]))
    return low.select(F.explode(held).alias("trigram"), *key)


def candidates(index: DataFrame, queries: list[list[frozenset[str]]], key: list[str]) -> DataFrame:
    """(*key, rules): places of the queries that a document's postings fulfil; none: no row.

    The postings are intersected document by document, so a trigram that every document holds is no
    hot key; a document has at most as many postings as there are trigrams."""
    held = index.groupBy(*key).agg(F.collect_set("trigram").alias("held"))
    clause = lambda c: F.size(F.array_except(F.array(*map(F.lit, sorted(c))), "held")) == 0
    rules = []
    for i, clauses in enumerate(queries):
        fits = clause(clauses[0])
        for c in clauses[1:]:
            fits = fits | clause(c)
        rules.append(F.when(fits, F.lit(i)))
    return (held.select(*key, F.array_compact(F.array(*rules)).alias("rules"))
            .filter(F.size("rules") > 0))


SPAN = "array<struct<start:int,kind:int,end:int>>"
#: Spans collected before they are put aside, so that collecting stays linear in their number.
CHUNK = 256


def _spans(text: Column, rule: Rule, kind: int) -> Column:
    """Spans of one rule's valid matches. The pieces between the matches and the matches themselves
    tell the places: leftmost matches without overlap, as the regex engine finds them."""
    pattern = F.lit(f"(?i){rule.pattern}" if rule.either_case else rule.pattern)
    sizes = lambda parts: F.transform(parts, lambda p: F.length(p))
    steps = F.arrays_zip(
        sizes(F.split(text, pattern, -1)).alias("gap"),
        sizes(F.regexp_extract_all(text, pattern, F.lit(0))).alias("n"),
        sizes(F.regexp_extract_all(text, pattern, F.lit(rule.group))).alias("tested"))
    none = F.array().cast(SPAN)
    start = F.struct(F.lit(0).alias("at"), none.alias("now"), F.array().cast(f"array<{SPAN}>").alias("past"))

    def step(acc: Column, s: Column) -> Column:
        lo = acc["at"] + s["gap"]
        valid = F.coalesce(s["tested"] >= max(rule.least, 1), F.lit(False))  # the last piece has no match
        full = F.size(acc["now"]) >= CHUNK
        span = F.array(F.struct(lo.alias("start"), F.lit(kind).alias("kind"), (lo + s["n"]).alias("end")))
        return F.struct(
            (lo + F.coalesce(s["n"], F.lit(0))).alias("at"),
            F.when(~valid, acc["now"]).when(full, span).otherwise(F.concat(acc["now"], span)).alias("now"),
            F.when(valid & full, F.concat(acc["past"], F.array(acc["now"]))).otherwise(acc["past"]).alias("past"))
    return F.aggregate(steps, start, step, lambda acc: F.concat(F.flatten(acc["past"]), acc["now"]))


def _told(spans: Column, kinds: list[str]) -> Column:
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: int = len(BASE),
                 text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The columns of ``docs`` and n_<kind> (long) of every rule, base_sha256 (of the spans of the
    first ``base`` rules) and spans (``kind:start:end`` by start, then rule; code points, end
    exclusive).

    Input columns of those names are replaced. Matches of one rule are leftmost and do not overlap.
    A null text counts as empty: no spans, the checksum of ''. Null or repeated ids and repeated
    rows change nothing: a document is known by its id and its text's hash, and one that shares
    both is one candidate. An empty table gives an empty result.

    Scale: the index is a scratch table of (trigram, id, hash) rows; postings meet by document. The
    candidates come back to the texts by a plain join, which Spark turns into a broadcast only
    where their measured size allows it.
    """
    kinds = [r.kind for r in rules]
    new = [f"n_{k}" for k in kinds] + ["base_sha256", "spans"]
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in new]).alias("row"),
                    id_key(doc_id).alias("k"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    d = d.withColumn("h", F.xxhash64("t"))
    asked = {i: q for i, r in enumerate(rules) if (q := trigram_query(r.pattern)) is not None}
    key = ["k", "h"]
    if asked:
        trigrams = sorted(set().union(*[c for q in asked.values() for c in q]))
        index = stage(trigram_index(d, trigrams, key, "t"), "trigram-postings")
        places = list(asked)
        found = candidates(index, list(asked.values()), key)
        d = d.join(found.withColumn("rules", F.transform("rules", lambda i: F.get(
            F.array(*map(F.lit, places)), i))), key, "left")
    else:
        d = d.withColumn("rules", F.lit(None).cast("array<int>"))
    none = F.array().cast(SPAN)
    spans = []
    for i, r in enumerate(rules):
        if i in asked:
            run = F.coalesce(F.array_contains("rules", i), F.lit(False))
        else:
            run = F.col("t").rlike(f"(?i){r.pattern}" if r.either_case else r.pattern)
        spans.append(F.when(run, _spans(F.col("t"), r, i)).otherwise(none))
    d = d.select("row", F.array_sort(F.concat(*spans)).alias("s"))
    of_kind = lambda i: F.filter("s", lambda s: s["kind"] == i)
    return d.select(
        "row.*", *[F.size(of_kind(i)).cast("long").alias(f"n_{k}") for i, k in enumerate(kinds)],
        F.sha2(_told(F.filter("s", lambda s: s["kind"] < base), kinds), 256).alias("base_sha256"),
        _told(F.col("s"), kinds).alias("spans"))
