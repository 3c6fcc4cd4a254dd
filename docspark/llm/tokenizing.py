"""Token counts and ids of whole texts, with overlap resynchronisation for huge documents.

A huge text is encoded in overlapping chunks with offsets. Two neighbouring chunks are spliced at a common boundary that is
proven stable: a byte-level pre-tokeniser cuts a text from left to right and looks one character ahead, so once both chunks
cut at the same place they go on alike, up to the last cuts before the left chunk's end. If the overlap has no such place it
is widened.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from struct import pack

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import append_columns

LATIN_END = 0x250


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _ranges(category: str) -> str:
    """Regex ranges of the code points below LATIN_END whose Unicode category begins so."""
    found = [c for c in range(LATIN_END) if unicodedata.category(chr(c)).startswith(category)]
    edges = [(c, next(d for d in range(c, LATIN_END + 1) if d + 1 not in found)) for c in found if c - 1 not in found]
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in edges)


class Encoder:
    """Encodes texts by a tokenizers file of the byte-level BPE kind, chunk by chunk, remembering the ids of recent words.

    Of a text whose characters all lie below U+0250 the words are cut by an equal pattern of Python's re and only words not
    seen lately go to the library's model; other texts go to the library whole, with offsets. The memory is bounded.
    """

    def __init__(self, path: str, chunk: int = 1 << 15, overlap: int = 256, remember: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.chunk, self.overlap, self.remember = Tokenizer.from_file(path), chunk, overlap, remember
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.byte_level = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        letters, numbers, space = _ranges("L"), _ranges("N"), r"\t-\r \x85\xa0"
        self.words = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{letters}]+| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+|[{space}]+(?![^{space}])|[{space}]+")
        self.beyond = re.compile("[^\0-ɏ]")
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        self.visible = {b: chr(256 + i) for i, b in enumerate(others)}
        self.memory: dict[str, bytes] = {}

    def _remembered(self, words: list[str]) -> list[bytes]:
        """Each word's ids by the library's model, as little-endian 32-bit bytes; the memory starts anew when it is full."""
        if len(self.memory) > self.remember:
            self.memory = {}
        memory = self.memory
        once: dict[str, bytes] = {}  # long words (base64, minified code) seldom come again and would fill the memory
        for w in {w for w in words if w not in memory}:
            got = [t.id for t in self.tokenizer.model.tokenize(w.encode("utf-8", "replace").decode("latin-1").translate(self.visible))]
            (memory if len(w) <= 64 else once)[w] = pack(f"<{len(got)}I", *got)
        return [memory.get(w) or once[w] for w in words] if once else [memory[w] for w in words]

    def pieces(self, text: str) -> tuple[list[int], list[bytes]]:
        """The ends (in characters) of the text's words, as the pre-tokeniser cuts them, and each word's ids."""
        if not text.isascii() and self.beyond.search(text) or any(s in text for s in self.specials):
            return self._by_library(text)
        words = self.words.findall(text)
        ends, at = [], 0
        for w in words:
            at += len(w)
            ends.append(at)
        return ends, self._remembered(words)

    def _by_library(self, text: str) -> tuple[list[int], list[bytes]]:
        import numpy as np

        got = self.tokenizer.encode(text, add_special_tokens=False)
        ids, owners, offsets = np.array(got.ids, "<u4"), got.word_ids, got.offsets
        last = [i for i in range(len(ids)) if i + 1 == len(ids) or owners[i] is None or owners[i + 1] != owners[i]]
        starts = [0, *(i + 1 for i in last[:-1])]
        return [offsets[i][1] for i in last], [ids[a : b + 1].tobytes() for a, b in zip(starts, last)]

    def encode(self, text: str) -> Iterator[bytes]:
        """The ids of the whole text, as bytes of little-endian unsigned 32-bit numbers, a chunk at a time."""
        if not self.byte_level:
            import numpy as np

            yield np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
            return
        if len(text) <= self.chunk:
            if not any(s in text for s in self.specials) and (text.isascii() or not self.beyond.search(text)):
                yield b"".join(self._remembered(self.words.findall(text)))
            else:
                yield b"".join(self._by_library(text)[1])
            return
        yield from self._spliced(text)

    def _spliced(self, text: str) -> Iterator[bytes]:
        start, done = 0, 0  # the chunk's first character; characters whose ids are out
        ends, ids = self.pieces(text[: self.chunk])
        while True:
            stop = start + ends[-1] if ends else start
            if stop >= len(text):
                yield b"".join(i for e, i in zip(ends, ids) if start + e > done)
                return
            overlap = self.overlap
            while True:
                nxt = max(start + 1, stop - overlap)
                more_ends, more_ids = self.pieces(text[nxt : nxt + self.chunk + overlap])
                guard = max((len(s) for s in self.specials), default=0) + 2
                # common cuts: not the left chunk's last words, which its end may have cut short, nor the right chunk's first
                left = {start + e for e in ends[:-2] if start + e < stop - guard}
                common = next((nxt + e for e in more_ends[1:] if nxt + e in left and nxt + e > max(done, nxt + guard)), None)
                if common is not None:
                    break
                if nxt <= start + 1 or nxt <= done:  # the overlap is the whole chunk: encode a longer one instead
                    ends, ids = self.pieces(text[start : start + 2 * (stop - start) + self.chunk])
                    stop = start + ends[-1]
                    if stop >= len(text):
                        break
                    overlap = self.overlap
                else:
                    overlap *= 2
            if stop >= len(text):
                continue
            yield b"".join(i for e, i in zip(ends, ids) if done < start + e <= common)
            start, done, ends, ids = nxt, common, more_ends, more_ids


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process."""
    return Encoder(path)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, tokenizer: str | None = None, limit: int = 512) -> DataFrame:
    """One row for each row of docs: id_col, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Tokens are those of the whole text by the tokenizer file (tokenizers .json or sentencepiece .model), without added
    special tokens; a special string inside a text is treated as the library does by default. Null counts as empty: 0 and 0.
    """
    path = tokenizer or default_path()

    def run(texts):
        if path.endswith(".model"):
            import sentencepiece

            counts = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode([t or "" for t in texts], num_threads=1)]
        else:
            enc = encoder(path)
            counts = [sum(map(len, enc.encode(t))) >> 2 if t else 0 for t in texts]
        return counts, [c > limit for c in counts]

    base = docs.select(F.col(id_col), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text__"))
    return append_columns(base, "text__", run, "n_tokens long, over_limit boolean").drop("text__")
