"""Exact encoding by a merge-type sentencepiece model, by backtracking, and decoding.

A sequence of pieces is the encoding of a text exactly when merging any two neighbours' joint text anew gives these two pieces:
the first merge across a border would show in that pair already. So pieces are taken from left to right, the longest match first
(one pass of an Aho-Corasick automaton finds these), each tested against the piece before it. Where none fits, the place is marked
in a bitfield, the last piece is given back and a shorter one tried. A text up to a place has one encoding only, so a place that
has failed once has failed for good, and the work is linear.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import slices, unused

BLANK = "▁"
#: Kinds of pieces and of models in the format of model files.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MERGE_TYPE = 2


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a message of a model file: number and value (whole numbers, or bytes for anything longer)."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            if byte < 128:
                return out
            shift += 7

    while at < len(data):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
            continue
        length = {1: 8, 5: 4}.get(tag & 7) or number()
        yield tag >> 3, data[at : at + length]
        at += length


class Remembered(dict):
    """The ids of words, as bytes; those of words not seen lately are worked out."""

    def __init__(self, encoder: PieceEncoder):
        self.encoder, self.older = encoder, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            coded = self.encoder.coded
            ids = b"".join([coded[n] for n in self.encoder.split(word)])
        if len(word) <= 64:
            self[word] = ids
        return ids


class PieceEncoder:
    """Encodes texts by a merge-type model with byte fallback; remembers the ids of recent words and pairs within bounds.

    Normalising and decoding are the library's. Models of another type, without byte fallback or with user-defined or unused
    pieces are refused with ValueError.
    """

    def __init__(self, path: str, remember: int = 300_000):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        self.library, self.remember = SentencePieceProcessor(model_file=path), remember
        with open(path, "rb") as f:
            model = list(_fields(f.read()))
        trainer = dict(_fields(next(v for k, v in model if k == 2)))
        kinds = [dict(_fields(v)).get(3, NORMAL) for k, v in model if k == 1]
        if trainer.get(3) != MERGE_TYPE or not trainer.get(35) or {USER_DEFINED, UNUSED} & set(kinds):
            raise ValueError("only models of the merge type with byte fallback and without user-defined and unused pieces")
        pieces = [self.library.id_to_piece(i) for i in range(len(kinds))]
        scores = {p: self.library.get_score(i) for i, p in enumerate(pieces) if kinds[i] == NORMAL}
        self.scores = scores
        self.byte_ids = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        # symbols have numbers: the pieces that their own merges give (no other is ever seen), then characters that are no piece
        self.names: list[str] = [p for p in scores if len(p) == 1 or self.merged(p) == [p]]
        self.numbers = {p: n for n, p in enumerate(self.names)}
        self.coded = [pack("<i", self.library.piece_to_id(p)) for p in self.names]
        self.sizes = [len(p) for p in self.names]
        self.shorter = [next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in self.numbers), p[0]) for p in self.names]
        self.shorter = [self.number(p) for p in self.shorter]
        self.automaton = ahocorasick.Automaton()
        for n, p in enumerate(self.names):
            self.automaton.add_word(p, n)
        self.automaton.make_automaton()
        # merges never cross a character that no piece holds, nor the start of blanks if pieces hold these at their start only
        leading = not any(BLANK in p.lstrip(BLANK) for p in scores)
        line = "\n" if not any("\n" in p for p in scores) else ""
        self.segments = re.compile(f"{BLANK}*[^{BLANK}{line}]+|{BLANK}+|\n+" if leading else f"[^{line}]+|\n+" if line else "(?s:.+)")
        self.memory = Remembered(self)
        self.pairs: dict[int, bool] = {}

    def number(self, symbol: str) -> int:
        """The symbol's number; a character that is no piece gets one when it is first seen, with the ids of its bytes."""
        if symbol not in self.numbers:
            self.numbers[symbol] = len(self.names)
            self.names.append(symbol)
            self.coded.append(b"".join(pack("<i", self.byte_ids[b]) for b in symbol.encode("utf-8", "replace")))
            self.sizes.append(1)
            self.shorter.append(self.numbers[symbol])
        return self.numbers[symbol]

    def merged(self, text: str) -> list[str]:
        """The text's symbols after all merges, best score first and leftmost of equal ones; for short texts."""
        score, none = self.scores.get, -np.inf
        parts = list(text)
        gains = [score(a + b, none) for a, b in zip(parts, parts[1:])]
        while gains and (best := max(gains)) > none:
            i = gains.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del gains[i]
            if i:
                gains[i - 1] = score(parts[i - 1] + parts[i], none)
            if i < len(gains):
                gains[i] = score(parts[i] + parts[i + 1], none)
        return parts

    def fits(self, left: int, right: int) -> bool:
        """Whether these two symbols stay apart when their joint text is merged anew; remembered."""
        if len(self.pairs) > 4 * self.remember:
            self.pairs = {}
        a, b = self.names[left], self.names[right]
        known = self.pairs[left << 21 | right] = self.merged(a + b) == [a, b]
        return known

    def split(self, text: str) -> list[int]:
        """The numbers of a normalised text's symbols."""
        sizes, shorter, matches = self.sizes, self.shorter, self.automaton.iter_long
        longest = [-1] * len(text)  # from each place; those that follow one another come first, others when they are asked for
        for end, piece in matches(text):
            longest[end - sizes[piece] + 1] = piece

        def match(at: int) -> int:
            end, piece = next(matches(text, at), (-1, -1))
            longest[at] = piece if end - sizes[piece] + 1 == at else self.number(text[at])
            return longest[at]

        failed = bytearray((len(text) >> 3) + 1)
        known, out, last = self.pairs.get, [], -1
        at, piece = 0, -1
        if text:
            piece = longest[0] if longest[0] >= 0 else match(0)
        while at < len(text):
            end = at + sizes[piece]
            fit = not failed[end >> 3] >> (end & 7) & 1
            if fit and last >= 0:
                fit = known(last << 21 | piece)
                if fit is None:
                    fit = self.fits(last, piece)
                    known = self.pairs.get
            if fit:
                out.append(piece)
                at, last = end, piece
                if at < len(text):
                    piece = longest[at]
                    if piece < 0:
                        piece = match(at)
            elif sizes[piece] > 1:
                piece = shorter[piece]
            else:
                failed[at >> 3] |= 1 << (at & 7)
                piece = out.pop()
                at -= sizes[piece]
                last = out[-1] if out else -1
        return out

    def encode(self, text: str) -> np.ndarray:
        """The ids of the whole text, as 32-bit numbers.

        Words seen lately are remembered in two generations: when the younger is full it becomes the older, so that frequent
        words stay. Words of more than 64 characters seldom come again and are not remembered.
        """
        if not text:
            return np.empty(0, "<i4")
        if len(self.memory) > self.remember:
            self.memory.older = dict(self.memory)
            self.memory.clear()
        return np.frombuffer(b"".join(map(self.memory.__getitem__, self.segments.findall(self.library.normalize(text)))), "<i4")

    def decode(self, ids: np.ndarray) -> str:
        return self.library.decode(ids.tolist())


@lru_cache(2)
def encoder(path: str) -> PieceEncoder:
    """One encoder for each worker process."""
    return PieceEncoder(path)


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, model: str | None = None) -> DataFrame:
    """One row for each row of docs: id_col, ids (array of int: the whole text's, without begin and end), decoded (text of these ids).

    Null counts as empty: no ids, an empty text. Other columns of docs are left out. model: a sentencepiece file of the merge type
    with byte fallback that every executor can read at this path. No shuffle; a task holds one batch of texts.
    """
    path = model or default_path()
    more = [unused(c, [id_col]) for c in ("ids", "decoded")]

    def run(batches):
        enc = encoder(path)
        for part in slices(batches, 1):
            ids = [enc.encode(t or "") for t in part.column(1).to_pylist()]
            values = pa.array(np.concatenate(ids) if ids else np.empty(0, "i4"), pa.int32())
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), values)
            yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(map(enc.decode, ids), pa.string())], names=[id_col, *more])

    base = docs.select(F.col(id_col), F.col(text_col).alias(unused("text", [id_col])))
    return base.mapInArrow(run, f"`{id_col}` {base.schema[0].dataType.simpleString()}, {more[0]} array<int>, {more[1]} string")
