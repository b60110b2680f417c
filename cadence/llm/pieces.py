"""SentencePiece encoding and decoding for merge-type (BPE) models, by a prefix table.

In a merge-type vocabulary every prefix of a word has exactly one possible last token: the token
that ends there, as an Aho-Corasick automaton reports it, and is compatible with the last token of
what stands before it. Two neighbours are compatible if undoing their merges one by one never
meets a merge across their border that would have come first. So one pass fills the table and one
pass backwards reads the ids off.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.llm.common import arrow_schema

#: Words and neighbour tests that a worker remembers.
CACHE = 300_000
SPACE = "▁"
_PARTS = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")
_RUN = re.compile(f"{SPACE}*")


class PieceCodec(dict):
    """Encodes and decodes as the model file says.

    Taken from the file: pieces, scores, byte pieces, begin and end id. Supported: merge-type
    models with byte fallback, no normalisation rules and a blank put before the text. The codec
    is the dictionary of the words it remembers, each with its ids as bytes.
    """

    def __init__(self, path: str):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bos, self.eos = sp.bos_id(), sp.eos_id()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        self.byte_id = {}
        self.shown: list[bytes] = []  # what an id decodes to
        self.raw_byte = np.zeros(n, bool)
        for i, p in enumerate(self.pieces):
            if sp.is_byte(i):
                self.byte_id[int(p[1:-1], 16)] = i
                self.raw_byte[i] = True
                self.shown.append(bytes([int(p[1:-1], 16)]))
            else:
                self.shown.append(b"" if special[i] else p.replace(SPACE, " ").encode())
        self.ids = {p: i for i, p in enumerate(self.pieces) if not special[i] and not sp.is_byte(i)}
        # merge order: equal scores share a rank, and then the leftmost pair goes first
        scores = {p: sp.get_score(i) for p, i in self.ids.items()}
        order = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True), 1)}
        self.rank = {p: order[s] if len(p) > 1 else 0 for p, s in scores.items()}
        self.halves: dict[str, tuple[str, str]] = {}
        found = ahocorasick.Automaton()
        for p in self.ids:
            if p.strip(SPACE) == "" and len(p) > 1:
                continue  # runs of blanks have a rule of their own
            if len(p) == 1 or self._reachable(p):
                found.add_word(p, (self.ids[p], len(p)))
        found.make_automaton()
        self.found = found
        self.fits: dict[int, bool] = {}
        self.chars = frozenset(p for p in self.ids if len(p) == 1)

    def _reachable(self, piece: str) -> bool:
        """Whether merging a piece's own characters gives the piece; notes its last merge."""
        parts = list(piece)
        if any(c not in self.ids for c in parts):
            return False
        while len(parts) > 1:
            ranks = [(self.rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:]))
                     if a + b in self.rank]
            if not ranks:
                return False
            i = min(ranks)[1]
            if len(parts) == 2:
                self.halves[piece] = (parts[0], parts[1])
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return True

    def _compatible(self, left: str, right: str) -> bool:
        """Undo the later of the two last merges until a border merge wins or nothing is left."""
        rank, halves = self.rank, self.halves
        bound = None  # a border merge of a rank below this would have come first
        while True:
            across = rank.get(left + right)
            if across is not None and (bound is None or across < bound):
                return False
            if left not in halves and right not in halves:
                return True
            # of equal ranks the left merge came first, so the right one is undone first
            if right not in halves or (left in halves and rank[left] > rank[right]):
                bound, left = rank[left], halves[left][1]
            else:
                bound, right = rank[right] + 1, halves[right][0]

    def _last_tokens(self, word: str) -> list[int]:
        """For every prefix of ``word`` the id of its last token, -1 where there is none."""
        last = [-1] * len(word)
        fits = self.fits
        for end, (token, size) in self.found.iter(word):
            if last[end] >= 0:
                continue
            if size > end:
                last[end] = token
                continue
            prev = last[end - size]
            if prev >= 0:
                pair = prev << 32 | token
                ok = fits.get(pair)
                if ok is None:
                    ok = fits[pair] = self._compatible(self.pieces[prev], self.pieces[token])
                if ok:
                    last[end] = token
        return last

    def _known_run(self, word: str) -> list[int]:
        last, out, end = self._last_tokens(word), [], len(word)
        while end:
            token = last[end - 1]
            out.append(token)
            end -= len(self.pieces[token])
        return out[::-1]

    def _blanks(self, n: int) -> list[int]:
        """A run of blanks: all its merges have one score, so the leftmost pair always goes."""
        grown: list[int] = []  # lengths of the tokens so far; the last one may still grow
        for _ in range(n):
            grown.append(1)
            while len(grown) > 1 and SPACE * (grown[-2] + grown[-1]) in self.ids:
                grown[-2:] = [grown[-2] + grown[-1]]
        return [self.ids[SPACE * g] for g in grown]

    def __missing__(self, word: str) -> bytes:
        ids = self[word] = np.asarray(self._word(word), "<u4").tobytes()
        return ids

    def _word(self, word: str) -> list[int]:
        """A word with the blanks before it."""
        blanks = _RUN.match(word).end()
        if blanks > 1:
            rest = self._chars(word[blanks - 1:])
            if rest[0] == self.ids[SPACE]:
                return self._blanks(blanks) + rest[1:]
            return self._blanks(blanks - 1) + rest
        return self._chars(word)

    def _chars(self, word: str) -> list[int]:
        """Stretches of known characters by the table, others as bytes."""
        if self.chars.issuperset(word):
            return self._known_run(word)
        out, at = [], 0
        for i, c in enumerate(word):
            if c not in self.ids:
                out += self._known_run(word[at:i]) + [self.byte_id[b] for b in c.encode()]
                at = i + 1
        return out + self._known_run(word[at:])

    def encode(self, text: str) -> bytes:
        """All ids, begin and end included, as little-endian unsigned 32-bit integers."""
        body = b""
        if text:
            marked = SPACE + text.replace(" ", SPACE)
            if "\0" in text or SPACE * 2 in marked:
                words = _PARTS.findall(marked)
            else:
                words = marked.replace(SPACE, "\0" + SPACE).replace("\n", "\0\n\0").split("\0")
            if len(self) > CACHE:
                self.clear()
            if len(self.fits) > CACHE:
                self.fits.clear()
            body = b"".join(map(self.__getitem__, words))
        return b"".join((np.uint32(self.bos).tobytes(), body, np.uint32(self.eos).tobytes()))

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids: byte pieces as UTF-8 (each wrong byte one U+FFFD), without the blank
        that encoding puts in front."""
        data = b"".join(map(self.shown.__getitem__, ids.tolist()))
        start = next((i for i in ids.tolist() if self.shown[i]), None)
        if start is not None and not self.raw_byte[start] and data[:1] == b" ":
            data = data[1:]
        try:
            return data.decode()
        except UnicodeDecodeError:
            return data.decode(errors="replace")


_CODECS: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    """One for each worker process and model."""
    if path not in _CODECS:
        _CODECS[path] = PieceCodec(path)
    return _CODECS[path]


def encode_pieces(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """The columns of ``docs`` and n_tokens, ids (binary, unsigned 32 bit, begin and end
    included), decoded (the text that those ids decode to).

    Input columns of those names are replaced. A null text is empty: begin and end id only.
    Ids are not read. Narrow: no shuffle; a worker remembers at most ``CACHE`` words.
    """
    names = ["n_tokens", "ids", "decoded"]
    keep = [c for c in docs.columns if c not in names]
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"),
                    F.col(f"`{text}`").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, schema = codec(model), arrow_schema("n_tokens long, ids binary, decoded string")
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                ids = [c.encode(t or "") for t in part.column("text").to_pylist()]
                decoded = [c.decode(np.frombuffer(x, "<u4")) for x in ids]
                cols = ([len(x) // 4 for x in ids], ids, decoded)
                yield pa.record_batch([part.column("row"), *(pa.array(x, f.type) for x, f
                                                             in zip(cols, schema))],
                                      names=["row", *names])

    kinds = f"row {d.schema['row'].dataType.simpleString()}, n_tokens long, ids binary, decoded string"
    return d.mapInArrow(run, kinds).select("row.*", *names)


def digest_texts(docs: DataFrame, model: str) -> DataFrame:
    """``docs`` with a struct of n_tokens, ids_sha256, decoded_sha256 in the place of the text."""
    digest = F.struct("n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))
    return encode_pieces(docs, model).withColumn("text", digest).select(*docs.columns)


def piece_digest(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    return encode_pieces(docs.select("doc_id", "text"), model).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
