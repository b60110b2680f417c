"""Personal data by anchor expansion.

An Aho-Corasick automaton finds the anchors (at-signs, plus-signs, digits, URL schemes and
identifier cues) in one pass over a text. From each anchor a small deterministic parser expands to
the span's boundaries and validates it. No pattern is tried where there is no anchor, so the time
is linear in the text, whatever it holds.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.llm.common import arrow_schema

#: Kinds in the order of results; the first four are the base kinds.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account")
#: Cues that announce an account or identity number, and URL schemes.
CUES = ("account", "acct", "iban", "ssn", "social security", "passport", "konto", "cuenta",
        "compte")
SCHEMES = ("http://", "https://", "ftp://")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE_RUN = re.compile(r"[ ().0-9-]+")
_URL_REST = re.compile(r"[^\s<>\"'`{}|\\^]+")
_URL_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*")
_CUE_GAP = re.compile(r"(?:[ ]?(?:no|nr|number|nummer|id)\b\.?)?[ ]{0,2}[:#=]?[ ]{0,2}", re.I)
_ACCOUNT = re.compile(r"[A-Za-z]{0,4}[0-9](?:[ -]?[0-9A-Z])*")
_DIGITS = frozenset("0123456789")


def _anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for d in "0123456789":
        found.add_word(d, ("digit", 1))
    found.add_word("@", ("at", 1))
    found.add_word("+", ("plus", 1))
    for s in SCHEMES:
        for form in (s, s.upper()):
            found.add_word(form, ("scheme", len(s)))
    for c in CUES:
        for form in {c, c.upper(), c.title(), c.capitalize()}:
            found.add_word(form, ("cue", len(c)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """Local part back to ``floor`` (the end of the last email), domain forward."""
    lo = at
    while lo > floor and text[lo - 1] in _LOCAL_CHARS:
        lo -= 1
    m = _DOMAIN.match(text, at + 1) if lo < at else None
    return (lo, m.end()) if m else None


def _is_ip(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in s.split("."))


def _is_card(s: str) -> bool:
    digits = s.replace(" ", "").replace("-", "")
    return 13 <= len(digits) <= 19 and luhn(digits)


def _phone(text: str, plus: int) -> tuple[int, int] | None:
    """A digit, then the longest run of its characters cut back to its last digit."""
    if plus + 1 >= len(text) or text[plus + 1] not in _DIGITS:
        return None
    m = _PHONE_RUN.match(text, plus + 2)
    if not m:
        return None
    hi = m.end()
    while hi > plus + 2 and text[hi - 1] not in _DIGITS:
        hi -= 1
    return (plus, hi) if hi > plus + 3 else None


def _url(text: str, lo: int, rest: int) -> tuple[int, int] | None:
    """Scheme, host, and what follows without closing punctuation."""
    if not _URL_HOST.match(text, rest):
        return None
    return lo, lo + len(text[lo:_URL_REST.match(text, rest).end()].rstrip(".,;:!?)]"))


def _account(text: str, after: int) -> tuple[int, int] | None:
    """The number behind a cue: 6 to 34 letters and digits, 6 digits at least."""
    m = _ACCOUNT.match(text, _CUE_GAP.match(text, after).end())
    if not m:
        return None
    body = m[0].replace(" ", "").replace("-", "")
    return m.span() if len(body) <= 34 and sum(c in _DIGITS for c in body) >= 6 else None


class Finder:
    def __init__(self):
        self.anchors = _anchors()

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(kind's place in KINDS, start, end) in order; ends are exclusive.

        Every base kind is found leftmost and without overlap in its own kind: a parser starts
        behind the last match of its kind, and matches that fail validation use up their text.
        """
        end = [0] * len(KINDS)
        out = []
        for last, (what, n) in self.anchors.iter(text):
            at = last - n + 1
            if what == "digit":
                if at >= end[1]:
                    m = _IP.match(text, at)
                    if m:
                        end[1] = m.end()
                        if _is_ip(m[0]):
                            out.append((1, at, m.end()))
                    else:  # no address begins in this run of digits
                        end[1] = _run_end(text, at)
                if at >= end[2]:
                    m = _CARD.match(text, at)
                    if m:
                        end[2] = m.end()
                        if _is_card(m[0]):
                            out.append((2, at, m.end()))
            elif what == "at":
                span = _email(text, at, end[0])
                if span:
                    end[0] = span[1]
                    out.append((0, *span))
            elif what == "plus":
                span = _phone(text, at) if at >= end[3] else None
                if span:
                    end[3] = span[1]
                    if 9 <= sum(c in _DIGITS for c in text[span[0]:span[1]]) <= 15:
                        out.append((3, *span))
            elif what == "scheme":
                span = _url(text, at, last + 1) if at >= end[4] else None
                if span:
                    end[4] = span[1]
                    out.append((4, *span))
            elif at == 0 or not text[at - 1].isalnum():
                span = _account(text, last + 1) if at >= end[5] else None
                if span:
                    end[5] = span[1]
                    out.append((5, *span))
        return sorted(out)


_RUN = re.compile(r"[0-9]+")


def _run_end(text: str, at: int) -> int:
    return _RUN.match(text, at).end()


_FINDER: list[Finder] = []


def _find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if not _FINDER:
        _FINDER.append(Finder())
    finder, schema = _FINDER[0], arrow_schema(SPANS)
    for b in batches:
        rows = []
        for text in b.column("text").to_pylist():
            spans = finder.spans(text or "")
            told = [f"{KINDS[k]}:{lo}:{hi}" for k, lo, hi in spans]
            n = [0] * len(KINDS)
            for k, _, _ in spans:
                n[k] += 1
            base = ",".join(told[:sum(n[:len(BASE)])])
            rows.append((*n, hashlib.sha256(base.encode()).hexdigest(), ",".join(told)))
        cols = zip(*rows) if rows else [[]] * (len(KINDS) + 2)
        found = [pa.array(c, f.type) for c, f in zip(cols, list(schema)[1:])]
        yield pa.record_batch([b.column("row"), *found], names=["row", *schema.names[1:]])


SPANS = "row int, n_email long, n_ip long, n_card long, n_phone long, n_url long, " \
        "n_account long, base_sha256 string, spans string"


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``docs`` and n_email, n_ip, n_card, n_phone, n_url, n_account (long),
    base_sha256 and spans (``kind:start:end`` by kind, then start; code points, end exclusive).

    Input columns of those names are replaced. A null text counts as empty: no spans, the
    checksum of ''. Ids are not read, so null or repeated ids change nothing. Narrow: no shuffle.
    """
    new = SPANS.split(", ")[1:]
    names = {c.split(" ")[0] for c in new}
    keep = [c for c in docs.columns if c not in names]
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"),
                    F.col(f"`{text}`").alias("text"))
    row = d.schema["row"].dataType
    out = d.mapInArrow(_find, f"row {row.simpleString()}, " + ", ".join(new))
    return out.select("row.*", *[c.split(" ")[0] for c in new])


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``[kind]``; overlapping spans become one
    mark, named by the span that starts first. A null text stays null."""
    def run(batches):
        if not _FINDER:
            _FINDER.append(Finder())
        for b in batches:
            out = []
            for t in b.column(text).to_pylist():
                parts, at = [], 0
                for k, lo, hi in sorted(_FINDER[0].spans(t or ""), key=lambda s: s[1:]):
                    if lo >= at:
                        parts += [t[at:lo], f"[{KINDS[k]}]"]
                    at = max(at, hi)
                out.append(None if t is None else "".join([*parts, t[at:]]))
            yield b.set_column(b.schema.get_field_index(text), text, pa.array(out, pa.string()))
    return docs.mapInArrow(run, docs.schema)
