"""Hierarchical multi-length packing of documents into training sequences.

Every task tokenises its documents and routes them to context-size tiers (powers of two up to the longest). Each tier is
packed into sequences of its size; the gap of a sequence is filled from its own tier, then from shorter tiers, and at last
by cutting a document. What is left at the end of a task is laid out in ever shorter power-of-two sequences, so nothing is
padded. Sequences of one tier form step groups of equal token counts. No rows are shuffled.
"""

from __future__ import annotations

from bisect import bisect_right, insort

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import slices
from docspark.llm.tokenizing import default_path, encoder

NAMES = ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "tier", "step_group"]


class Packer:
    """Packs the documents of one task. Items are (length, order, id, start, ids, doc_tokens); rows come out as lists."""

    def __init__(self, part: int, longest: int, shortest: int, step_tokens: int):
        self.longest, self.step_tokens, self.base = longest, step_tokens, part << 32
        self.tiers = []
        while longest >= shortest:
            self.tiers.append(longest)
            longest //= 2
        self.waiting = {t: [] for t in self.tiers}
        self.sequences, self.order, self.tokens, self.rows = 0, 0, dict.fromkeys(self.tiers, 0), []

    def add(self, doc, ids: bytes) -> None:
        """Whole windows of a long document become full sequences at once; the rest waits in the shortest tier that holds it."""
        n, at = len(ids) // 4, 0
        while n - at >= self.longest:
            self._emit(self.longest, [(self.longest, 0, doc, at, ids[at * 4 : (at + self.longest) * 4], n)])
            at += self.longest
        if n > at:
            self._wait((n - at, self.order, doc, at, ids[at * 4 :], n))
            self.order += 1

    def _wait(self, item) -> None:
        tier = min(t for t in self.tiers if t >= min(item[0], self.longest))
        insort(self.waiting[tier], item, key=lambda x: x[:2])

    def _emit(self, tier: int, items: list) -> None:
        offset, group = 0, self.tokens.get(tier, 0) // self.step_tokens
        for length, _, doc, start, ids, n in items:
            self.rows.append((doc, start, length, ids, n, self.base + self.sequences, offset, tier, group))
            offset += length
        self.sequences += 1
        if tier in self.tokens:
            self.tokens[tier] += offset

    def _take(self, tier: int, room: int):
        """The longest waiting item of the tier that fits the room."""
        items = self.waiting[tier]
        k = bisect_right(items, room, key=lambda x: x[0]) - 1
        return items.pop(k) if k >= 0 else None

    def _cut(self, room: int):
        """A piece of just that length from the front of the shortest waiting item above it; the rest waits again."""
        for tier in reversed(self.tiers):
            items = self.waiting[tier]
            if items and items[-1][0] > room:
                k = bisect_right(items, room, key=lambda x: x[0])
                length, order, doc, start, ids, n = items.pop(k)
                self._wait((length - room, order, doc, start + room, ids[room * 4 :], n))
                return room, order, doc, start, ids[: room * 4], n
        return None

    def _fill(self, tier: int, capacity: int) -> list:
        items, room = [], capacity
        below = [t for t in self.tiers if t <= tier] + sorted(t for t in self.tiers if t > tier)
        while room:
            item = next((x for t in below if (x := self._take(t, room))), None) or self._cut(room)
            if item is None:
                break
            items.append(item)
            room -= item[0]
        return items

    def total(self) -> int:
        return sum(x[0] for items in self.waiting.values() for x in items)

    def pack(self, last: bool = False) -> list:
        """Pack what waits, tier by tier from the longest; before the end the words of about one window stay to fill gaps later."""
        total = self.total()
        for tier in self.tiers:
            while self.waiting[tier] and total >= tier + (0 if last else self.longest):
                items = self._fill(tier, tier)
                total -= tier
                self._emit(tier, items)
        if last:
            capacity = self.longest
            while total:
                while capacity > total:
                    capacity //= 2
                self._emit(capacity, self._fill(self.tiers[0], capacity))
                total -= capacity
        rows, self.rows = self.rows, []
        return rows


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, tokenizer: str | None = None, end_id: int = 0, longest: int = 1024, shortest: int = 128, step_tokens: int = 8192, buffer_tokens: int = 1_000_000) -> DataFrame:
    """Rows are pieces of documents: id_col, start, length, ids (binary, little-endian uint32), doc_tokens, sequence_id, offset, tier, step_group.

    A document is its text's token ids and then end_id (null text: end_id alone); each id lies in one piece. A sequence's
    pieces are gapless from offset 0 and fill its tier, a power of two up to `longest`. Sequence numbers are unique over the
    table, step groups over a task and tier. Equal ids or repeated rows are packed each for itself; an empty table gives none.
    """
    path = tokenizer or default_path()

    def run(batches):
        enc, end = encoder(path), end_id.to_bytes(4, "little")
        packer, held = Packer(TaskContext.get().partitionId(), longest, shortest, step_tokens), 0
        kind = None

        def out(rows):
            for at in range(0, len(rows), 4096):
                cols = list(zip(*rows[at : at + 4096]))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()])], names=NAMES)

        for part in slices(batches, 1):
            kind = part.schema.field(0).type
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                ids = b"".join(enc.encode(text or "")) + end
                packer.add(doc, ids)
                held += len(ids) // 4
            if held >= buffer_tokens:
                yield from out(packer.pack())
                held = packer.total()
        yield from out(packer.pack(last=True))

    kind = docs.schema[id_col].dataType.simpleString()
    got = docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier int, step_group long")
    return got.withColumnRenamed("id", id_col)
