"""SentencePiece (merge type) encoding by backtracking, and decoding.

A merge-type encoding is the one tokenisation in which every two neighbours,
merged again from characters, come out as those same two tokens. The encoder
takes the longest vocabulary match at each position (found for all positions
in one Aho-Corasick pass), checks it against the token before by re-merging
the pair, shortens it or steps back where that fails, and keeps a bitfield of
positions from which no tokenisation goes on. Texts are cut before each run of
blanks, which no token crosses; the cuts' ids are kept for words seen lately.

Edge cases: a null or empty text has the end id alone; any text length is
encoded whole; characters outside the vocabulary become their UTF-8 bytes;
repeated rows encode alike; other columns pass through, but for the names the
operator adds.
"""

from __future__ import annotations

import codecs
import re
from array import array
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare

BLANK = "▁"
_BLANK = BLANK.encode()
_CUTS = re.compile(rb" +[^ ]*")


def read_model(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, kind) of each id, through the library's own readers."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    kinds = ((m.IsUnknown, 2), (m.IsControl, 3), (m.IsUnused, 5), (m.IsByte, 6))
    return [(m.IdToPiece(i), m.GetScore(i), next((k for f, k in kinds if f(i)), 1)) for i in range(m.GetPieceSize())]


class PieceCodec:
    """Exact encoder and decoder for an identity-normalised merge model with byte fallback."""

    def __init__(self, path: str, end_id: int = 2, most: int = 400_000):
        model = read_model(path)
        self.end_id, self.most = end_id, most
        self.id_of = {p: i for i, (p, _, kind) in enumerate(model) if kind == 1}
        self.text_of = {i: p for p, i in self.id_of.items()}
        self.score = {p: model[i][1] for p, i in self.id_of.items()}
        self.byte_id = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(model) if kind == 6}
        if any(BLANK in p.lstrip(BLANK) for p in self.id_of) or len(self.byte_id) != 256:
            raise ValueError("the model has pieces that cross a blank, or no byte fallback")
        self.chars = frozenset(p for p in self.id_of if len(p) == 1)
        self.trie = ahocorasick.Automaton()
        for p, i in self.id_of.items():
            self.trie.add_word(p, (len(p) - 1, i))
        self.trie.make_automaton()
        #: The next shorter token that begins a token, -1 if none.
        self.shorter = {i: next((self.id_of[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in self.id_of), -1) for p, i in self.id_of.items()}
        self.size = {i: len(p) for p, i in self.id_of.items()}
        self.pairs: dict[int, bool] = {}
        self.cuts: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.out = [b""] * len(model)
        for p, i in self.id_of.items():
            self.out[i] = p.replace(BLANK, " ").encode()
        for b, i in self.byte_id.items():
            self.out[i] = bytes([b])
        self.is_byte = np.zeros(len(model), bool)
        self.is_byte[list(self.byte_id.values())] = True

    def merged(self, text: str) -> list[str]:
        """Merging by score, leftmost first: the definition, used on pairs."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, a: int, b: int) -> bool:
        """Whether the two tokens, merged again from characters, stay as they are."""
        x, y = self.text_of[a], self.text_of[b]
        got = self.merged(x + y) == [x, y]
        if len(self.pairs) > 4_000_000:
            self.pairs.clear()
        self.pairs[a << 16 | b] = got
        return got

    def known(self, text: str) -> list[int] | None:
        """Ids of a text of which every character is in the vocabulary."""
        whole = self.id_of.get(text)
        if whole is not None:
            return [whole]  # the longest match at the start, with nothing before it
        n = len(text)
        longest = [-1] * n
        for end, (back, token) in self.trie.iter(text):  # by end, so the longest match of a start comes last
            longest[end - back] = token
        size, shorter, pairs = self.size, self.shorter, self.pairs
        alive = bytearray(b"\x01") * (n + 1)
        tokens: list[int] = []
        at, token = 0, longest[0]
        while True:
            last = tokens[-1] if tokens else -1
            while True:
                end = at + size[token]
                if alive[end]:
                    if last < 0:
                        ok = True
                    else:
                        ok = pairs.get(last << 16 | token)
                        if ok is None:
                            ok = self.fits(last, token)
                    if ok:
                        tokens.append(token)
                        at = end
                        if at == n:
                            return tokens
                        token = longest[at]
                        break
                token = shorter[token]
                if token < 0:
                    alive[at] = 0
                    if not tokens:
                        return None
                    token = tokens.pop()
                    at -= size[token]
                    break

    def ids_of_cut(self, text: str) -> list[int]:
        """Ids of blanks and what follows up to the next blank."""
        if self.chars.issuperset(text):
            if text[1:2] != BLANK and (got := self.known(text)) is not None:
                return got
            parts = [text]
        else:
            parts = re.split("([" + "".join(re.escape(c) for c in {c for c in text if c not in self.id_of}) + "])", text)
        out: list[int] = []
        for k, part in enumerate(parts):
            if not part:
                continue
            if k % 2:
                out += [self.byte_id[b] for b in part.encode()]
                continue
            blanks = len(part) - len(part.lstrip(BLANK))
            if blanks > 2:  # pieces of blanks have tied scores, where only merging itself is exact
                out += self.after_blanks(part, blanks)
                continue
            got = self.known(part)
            out += [self.id_of[p] for p in self.merged(part)] if got is None else got
        return out

    def after_blanks(self, part: str, blanks: int) -> list[int]:
        """The last blank joins the word as it would alone; the blanks before it merge among themselves."""
        word = self.known(part[blanks - 1 :])
        first = self.text_of[word[0]] if word else ""
        if word and len(first) > 1 and first[1:].strip(BLANK):
            return [*self.blank_run(blanks - 1), *word]
        return [*self.blank_run(blanks), *(self.known(part[blanks:]) or [] if len(part) > blanks else [])]

    def blank_run(self, n: int) -> list[int]:
        """Ids of n blanks; equal scores merge from the left, so long runs settle into the largest piece."""
        big = max(len(p) for p in self.id_of if not p.strip(BLANK))
        head = []
        while n > 8 * big:
            head.append(self.id_of[BLANK * big])
            n -= big
        return head + [self.id_of[p] for p in self.merged(BLANK * n)]

    def _ids(self, cut: bytes) -> bytes:
        """Ids of a cut, as little-endian 32-bit bytes; cut has its leading blanks but one."""
        got = self.older.get(cut)
        if got is None:
            got = array("i", self.ids_of_cut(BLANK + cut.decode("utf-8", "replace").replace(" ", BLANK))).tobytes()
        if len(self.cuts) >= self.most:
            self.older, self.cuts = self.cuts, _Kept(self)
        if len(cut) <= 64:
            self.cuts[cut] = got
        return got

    def encode_bytes(self, raw: bytes) -> bytes:
        """Ids of a text and the end id, as little-endian 32-bit bytes."""
        end = np.array([self.end_id], "<i4").tobytes()
        if not raw:
            return end
        if not isinstance(self.cuts, _Kept):
            self.cuts = _Kept(self)
        if _BLANK in raw:
            raw = raw.replace(_BLANK, b" ")
        if b"  " in raw or raw[0] == 32:
            words = [x[1:] for x in _CUTS.findall(b" " + raw)]
        else:
            words = raw.split(b" ")
        parts = []
        for k in range(0, len(words), 100_000):  # the kept words may be replaced in between
            parts.append(b"".join(map(self.cuts.__getitem__, words[k : k + 100_000])))
        parts.append(end)
        return b"".join(parts)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes((text or "").encode()), "<i4").tolist()

    def decode(self, ids) -> str:
        """The text of ids: pieces with blanks as spaces, runs of byte ids as UTF-8, without the first blank."""
        ids = np.asarray(ids, np.int64)
        data = b"".join(map(self.out.__getitem__, ids.tolist()))
        if self.is_byte[ids].any():
            text = self._with_bytes(ids)
        else:
            text = data.decode()
        return text[1:] if text[:1] == " " else text

    def _with_bytes(self, ids: np.ndarray) -> str:
        flags = self.is_byte[ids]
        out, start = [], 0
        for end in [*(np.flatnonzero(np.diff(flags)) + 1).tolist(), len(ids)]:
            data = b"".join(map(self.out.__getitem__, ids[start:end].tolist()))
            out.append(bytes_text(data) if flags[start] else data.decode())
            start = end
        return "".join(out)


codecs.register_error("tessel-each-byte", lambda e: ("�", e.start + 1))


def bytes_text(data: bytes) -> str:
    """UTF-8 with one replacement character for every byte that belongs to no character."""
    return data.decode("utf-8", "tessel-each-byte")


class _Kept(dict):
    def __init__(self, codec: PieceCodec):
        super().__init__()
        self.codec = codec

    def __missing__(self, cut: bytes) -> bytes:
        return self.codec._ids(cut)


@cache
def codec(path: str) -> PieceCodec:
    """One codec a Python worker, with the words it has seen lately."""
    return PieceCodec(path)


def _array_of(ids: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4")))


def recode(docs: DataFrame, model_path: str, text: str = "text", ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` with the ids of ``text`` (end id included) and the text they decode to, in place of it; null as empty."""
    prepare(docs.sparkSession)
    kept = [c for c in docs.columns if c not in (text, ids, out)]
    schema = docs.select(*[F.col(f"`{c}`") for c in kept]).schema.add(ids, T.ArrayType(T.IntegerType())).add(out, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for batch in batches:
            coded = [own.encode_bytes(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            texts = [own.decode(np.frombuffer(x, "<i4")) for x in coded]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], _array_of(coded), pa.array(texts, pa.string())], [*kept, ids, out])

    raw = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    return docs.select(*[F.col(f"`{c}`") for c in kept], raw.alias("__raw")).mapInArrow(run, schema)


def encode(docs: DataFrame, model_path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the ids of ``text`` (end id included) in place of it; null as empty."""
    prepare(docs.sparkSession)
    kept = [c for c in docs.columns if c not in (text, out)]
    schema = docs.select(*[F.col(f"`{c}`") for c in kept]).schema.add(out, T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for batch in batches:
            ids = [own.encode_bytes(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], _array_of(ids)], [*kept, out])

    raw = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    return docs.select(*[F.col(f"`{c}`") for c in kept], raw.alias("__raw")).mapInArrow(run, schema)


def decode(docs: DataFrame, model_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` with the text of ``ids`` added; null ids give an empty text."""
    prepare(docs.sparkSession)
    kept = [c for c in docs.columns if c != out]
    schema = docs.select(*[F.col(f"`{c}`") for c in kept]).schema.add(out, "string")
    at = kept.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for batch in batches:
            texts = [own.decode(x.values.to_numpy() if x.is_valid else []) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*kept, out])

    return docs.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)
