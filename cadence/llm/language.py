"""Language identification by cross-parsing entropy.

Labelled text of every language becomes a suffix automaton. A text is cut greedily into the
longest phrases that the automaton knows; the language that needs the fewest phrases, normalised
to bits by the log of its training length, is the text's language.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadence.llm.common import arrow_schema, text_slices

UNKNOWN = "und"
#: Bounds of the training sample, the only thing that is sampled: rows of a language, characters of
#: a row, and of a language (an even share of ``TOTAL_CHARS``, but ``LANG_CHARS`` at least).
SAMPLE_ROWS, ROW_CHARS, TOTAL_CHARS, LANG_CHARS = 400, 600, 240_000, 1_200
#: Rows ranked for each row of the sample; the range that hashes are cut in.
SPARE, RANGE = 4, 1 << 40
#: Letters with a column in the table (the others have sorted keys); texts are parsed in stretches
#: of so many symbols.
LETTERS, STRETCH = 90, 256
#: Stretches that a language's calibration needs at least; deviations that a recognised text may lie
#: above.
CALIBRATED, DEVIATIONS = 20, 10


def held_out(doc_id: str = "doc_id") -> Column:
    """A fifth of the ids, by crc32 of the id as text. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(f"`{doc_id}`").cast("string")) % 5 == 0, F.lit(False))


def training_sample(docs: DataFrame, text: str = "text", lang: str = "lang",
                    doc_id: str = "doc_id") -> dict[str, str]:
    """Labelled text by language, outside the held-out fifth, within the bounds above.

    The rows of a language are those with the smallest hashes of id and text; rows that repeat both
    are one. A sketch of each language's distinct hashes says which share of the hash range holds
    some ``SAMPLE_ROWS`` rows ``SPARE`` times over; only those are ranked, and no more than
    ``SAMPLE_ROWS`` of a language reach the driver, however rows repeat.
    """
    d = docs.select(F.col(f"`{doc_id}`").alias("k"), F.col(f"`{text}`").alias("t"),
                    F.col(f"`{lang}`").alias("l"))
    d = d.filter(F.col("l").isNotNull() & F.col("t").isNotNull()
                 & (F.crc32(F.col("k").cast("string")) % 5 != 0))
    d = d.withColumn("h", F.xxhash64("k", "t")).withColumn("u", F.pmod("h", F.lit(RANGE)))
    sizes = d.groupBy("l").agg(F.approx_count_distinct("h").alias("m"))
    share = F.least(F.lit(1.0), F.lit(float(SPARE * SAMPLE_ROWS)) / F.greatest("m", F.lit(1)))
    some = (d.join(F.broadcast(sizes.select("l", share.alias("share"))), "l")  # one row a label
            .filter(F.col("u") < F.col("share") * RANGE)
            .groupBy("l", "u", "h").agg(F.min(F.substring("t", 1, ROW_CHARS)).alias("t")))
    rank = F.row_number().over(W.partitionBy("l").orderBy("u", "h"))
    rows = some.withColumn("n", rank).filter(F.col("n") <= SAMPLE_ROWS).select("l", "u", "h", "t").collect()
    texts: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r.l, r.u, r.h)):
        texts.setdefault(r.l, []).append(r.t)
    each = max(LANG_CHARS, TOTAL_CHARS // max(1, len(texts)))
    return {name: "\n".join(parts)[:each] for name, parts in texts.items()}


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings; state 0 is the start."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[new] = twin
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
        last = new
    return step


def letter(c: str) -> str:
    return c.lower()[:1]


class Parser:
    """The automata of all languages in one table, and the parse of many texts at once.

    Every letter of the training text has a symbol. Transitions by blanks and the ``LETTERS`` most
    frequent letters are columns of the table, those by other letters are sorted keys.
    """

    def __init__(self, training: dict[str, str]):
        self.names = sorted(training)
        counts = Counter(letter(c) for t in training.values() for c in t if c.isalpha())
        letters = [c for c, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))]
        dense = min(LETTERS, len(letters))
        self.other, self.pad = dense + 1, dense + 2  # other: letters that no training text has
        self.width = dense + 3
        self.own = {c: i if i <= dense else i + 2 for i, c in enumerate(letters, 1)}
        self.rare = len(letters) - dense  # their symbols follow the columns
        self.symbol = np.zeros(0x10000, np.min_scalar_type(self.width + self.rare))  # 0: no letter
        for i in range(0x10000):
            c = chr(i)
            if c.isalpha():
                self.symbol[i] = self.own.get(letter(c), self.other)
        # an automaton has at most two states a character, and a row for no phrase
        states = sum(2 * len(t) + 2 for t in training.values())
        self.kind = np.int32 if 2 * states * self.width < 1 << 31 else np.int64
        tables, self.idle, self.bits, base = [], [], [], 0
        self.keys, self.next, self.begin = [], [], []  # of transitions by rare letters
        for name in self.names:
            symbols = self._symbols(training[name])
            step = suffix_automaton(symbols.tolist())
            rare = sorted((self._key(s + base, c), t + base) for s, nexts in enumerate(step)
                          for c, t in nexts.items() if c >= self.width)
            self.keys.append(np.array([k for k, _ in rare], np.int64))
            self.next.append(np.array([t for _, t in rare], np.int64) * self.width)
            # where no transition goes on, a phrase begins: by the start's own transition or none
            begin = np.full(self.rare, base + len(step), np.int64)
            for c, t in step[0].items():
                if c >= self.width:
                    begin[c - self.width] = base + t
            table = self._table(step, base)
            base += len(table)
            self.idle.append((base - 1) * self.width)
            self.bits.append(math.log2(max(2, len(symbols))))
            self.begin.append(begin * self.width)
            tables.append(table)
        self.table = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int64)

    def _key(self, state, symbol):
        return state * self.rare + (symbol - self.width)

    def _rare(self, lang: int, state: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states (times ``width``) by rare letters, and whether a phrase begins."""
        keys, after = self.keys[lang], self.begin[lang][symbols - self.width]
        begins = np.ones(len(symbols), bool)
        if len(keys):
            wanted = self._key(state.astype(np.int64) // self.width, symbols)
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            found = keys[at] == wanted
            after, begins = np.where(found, self.next[lang][at], after), ~found
        return after, begins

    def _table(self, step: list[dict[int, int]], base: int) -> np.ndarray:
        """Next state times ``width``, doubled, plus 1 where a phrase begins with the symbol.

        The last row is where no phrase is open: every symbol begins one there, and one that the
        training text lacks is a phrase of its own and leads there.
        """
        idle = len(step)
        out = np.full((idle + 1, self.width), -1, self.kind)
        for s, nexts in enumerate(step):
            for c, t in nexts.items():
                if c < self.width:
                    out[s, c] = t
        begins = out < 0
        np.copyto(out, np.where(out[0] < 0, idle, out[0]).astype(self.kind), where=begins)
        out += base
        out *= 2 * self.width
        out += begins
        out[:, self.pad] = (base + idle) * self.width * 2
        return out

    def _symbols(self, text: str) -> np.ndarray:
        return self._normalised([text])[0]

    def _normalised(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all texts and how many each has: letters in lower case, each run of other
        characters one blank."""
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        symbols = self.symbol[np.minimum(points, 0xFFFF)]
        for p in np.unique(points[points > 0xFFFF]):
            symbols[points == p] = self.own.get(letter(chr(p)), self.other) if chr(p).isalpha() else 0
        doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        keep = np.ones(len(points), bool)
        if len(points):
            keep[0] = symbols[0] != 0
            keep[1:] = (symbols[1:] != 0) | ((symbols[:-1] != 0) & (doc[1:] == doc[:-1]))
        return symbols[keep], np.bincount(doc[keep], minlength=len(texts))

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(texts, languages) phrase counts, the number of symbols of each text, and the bits of each
        text if every stretch may be in another language.

        A text is parsed in stretches; no phrase runs over their ends.
        """
        symbols, sizes = self._normalised(texts)
        rows = -(-sizes // STRETCH)
        starts = np.cumsum(rows) - rows
        place = np.arange(len(symbols)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        grid = np.full((STRETCH, int(rows.sum())), self.pad, symbols.dtype)
        grid[place % STRETCH, np.repeat(starts, sizes) + place // STRETCH] = symbols
        owner = np.repeat(np.arange(len(texts)), rows)
        out = np.zeros((len(texts), len(self.names)))
        least = np.full(grid.shape[1], np.inf)  # bits of each stretch in its best language
        rare = [np.flatnonzero(column >= self.width) if self.rare else () for column in grid]
        near = np.where(grid < self.width, grid, self.other).astype(grid.dtype) if self.rare else grid
        for lang, idle in enumerate(self.idle):
            state = np.full(grid.shape[1], idle, self.table.dtype)
            count = np.zeros(grid.shape[1], np.int32)
            for i, column in enumerate(near):
                step = self.table.take(state + column)
                begins, after = step & 1, step >> 1
                if len(rare[i]):
                    at = rare[i]
                    after[at], begins[at] = self._rare(lang, state[at], grid[i, at].astype(np.int64))
                count += begins
                state = after
            out[:, lang] = np.bincount(owner, count, minlength=len(texts))
            np.minimum(least, count * self.bits[lang], out=least)
        return out, sizes, np.bincount(owner, least, minlength=len(texts))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """(language, score, bits a symbol): ties go to the name that sorts first; the score is
        the runner-up's share of the two best languages' bits, 1 if there is no runner-up; the bits
        are those of the best language of each stretch, so that text that mixes learned languages
        is as cheap as text in one."""
        out: list[tuple[str, float, float]] = []
        counts, sizes, mixed = self.phrases([t or "" for t in texts])
        for c, n, m in zip(counts * np.asarray(self.bits), sizes, mixed):
            if not n or not self.names:
                out.append((UNKNOWN, 0.0, 0.0))
                continue
            best = int(np.argmin(c))
            rest = np.delete(c, best)
            score = rest.min() / (rest.min() + c[best]) if len(rest) else 1.0
            out.append((self.names[best], float(score), float(m / n)))
        return out


def bits_bounds(training: dict[str, str]) -> dict[str, tuple[float, float]]:
    """Of each language, the median bits a symbol of unseen text and the deviation above it;
    stretches below the median are left out of that, as repeated ones have hardly any bits.

    The automata of the first halves of the training text parse stretches of the second halves.
    Half the text knows fewer phrases, so the bounds are on the generous side. A language with fewer
    than ``CALIBRATED`` stretches has none.
    """
    halves = {n: (t[:len(t) // 2], t[len(t) // 2:]) for n, t in training.items()}
    parts = {n: [b[i:i + STRETCH] for i in range(0, len(b) - STRETCH + 1, STRETCH)] for n, (_, b) in halves.items()}
    parts = {n: p for n, p in parts.items() if len(p) >= CALIBRATED}
    parser = Parser({n: a for n, (a, _) in halves.items()}) if parts else None
    out = {}
    for name, stretches in parts.items():
        bits = np.array([b for p, _, b in parser.predict(stretches) if p != UNKNOWN])
        if len(bits) >= CALIBRATED:
            median = np.median(bits)
            out[name] = float(median), float(np.sqrt(np.mean((bits[bits >= median] - median) ** 2)))
    return out


def recognised(training: dict[str, str], text: str = "text") -> Column:
    """Of ``predict_language``'s result: whether a text is in a learned language.

    Its bits a symbol may exceed the median of the predicted language by ``DEVIATIONS`` deviations of
    that language; texts shorter than the stretches of the calibration vary more and get a wider
    bound. Of a language with too little text for a calibration, every text with a letter is
    recognised; nothing is turned away for a lack of labels.
    """
    letters = F.coalesce(F.col(f"`{text}`").rlike(r"\p{L}"), F.lit(False))
    bounds = bits_bounds(training)
    if not bounds:
        return letters
    of = F.try_element_at(F.create_map(*[x for n, (m, dev) in bounds.items() for x in (
        F.lit(n), F.array(F.lit(m), F.lit(dev)))]), F.col("lang_pred"))
    size = F.greatest(F.length(F.col(f"`{text}`")), F.lit(1))
    wider = F.sqrt(F.greatest(F.lit(1.0), STRETCH / size))
    return letters & F.coalesce(F.col("lang_bits") <= of[0] + DEVIATIONS * of[1] * wider, F.lit(True))


_PARSERS: dict[int, Parser] = {}


def predict_language(docs: DataFrame, training: dict[str, str], text: str = "text") -> DataFrame:
    """The columns of ``docs`` and lang_pred, lang_score (0 to 1), lang_bits (a symbol, each stretch
    in its best language). Input columns of those names are replaced.

    ``und`` with score 0: a null text, a text without a letter, or an empty training sample.
    Only ``text`` is read. Narrow: the training text (bounded) travels with the task, each worker
    builds the automata once.
    """
    names = ["lang_pred", "lang_score", "lang_bits"]
    keep = [c for c in docs.columns if c not in names]
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"),
                    F.col(f"`{text}`").alias("text"))
    key = hash(tuple(sorted(training.items())))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _PARSERS:
            _PARSERS.clear()
            _PARSERS[key] = Parser(training)
        parser, schema = _PARSERS[key], arrow_schema("p string, s double, b double")
        for b in batches:
            texts = b.column("text")
            for lo, hi in text_slices(texts, 1 << 19):
                cols = zip(*parser.predict(texts.slice(lo, hi - lo).to_pylist()))
                yield pa.record_batch([b.column("row").slice(lo, hi - lo),
                                       *(pa.array(c, f.type) for c, f in zip(cols, schema))],
                                      names=["row", *names])

    kinds = f"row {d.schema['row'].dataType.simpleString()}, lang_pred string, lang_score double, " \
            "lang_bits double"
    return d.mapInArrow(run, kinds).select("row.*", *names)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned on four fifths, predicted for all."""
    found = predict_language(docs.select("doc_id", "text"), training_sample(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred",
                        F.col("lang_score").alias("score"))
