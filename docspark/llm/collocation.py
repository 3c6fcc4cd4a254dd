"""Phrases whose words come together more often than by chance, mined by partitioning (SON).

A phrase that occurs T times overall occurs at least T * w times in some shard, w being the shard's share of the corpus. So every
shard is mined completely at that lowered support, by length of phrase; the phrases frequent in any shard are joined, and a last
pass counts all of them over the whole corpus exactly. A shard is a hashed quarter of the documents, not a task: with a fixed
T the support would sink to one in small shards and nothing would be ruled out.

Words are mined together with pairs, longer phrases if both of their parts are frequent. The mining passes count 64-bit keys (equal
keys of different phrases only add candidates); the last pass counts texts of phrases, compared byte by byte.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.llm.common import lookup, slices, table

#: Bytes that end a piece become line feeds, tabs become blanks.
ENDS = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n\n\n\n\n\n\n\n\n ")
BLANK, END = 32, 10
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Masks of the lowest 0 to 8 bytes of a 64-bit number.
LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
HELD = 4_000_000


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MIX
    h = (h ^ (h >> np.uint64(29))) * MIX
    return h ^ (h >> np.uint64(32))


class Words:
    """The words of some texts, as spans of one buffer of bytes in which runs of blanks are single: first, size, a 64-bit hash, and
    whether the next word follows in the same piece."""

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer(b"\n".join([t.lower().translate(ENDS) for t in texts] + [b""]), np.uint8)
        blank = raw == BLANK
        blank[1:] &= blank[:-1]
        blank[:1] = False
        kept = raw[~blank] if blank.any() else raw
        self.bytes = np.concatenate([kept, np.zeros(8, np.uint8)])
        inside = np.concatenate([[False], (kept != BLANK) & (kept != END), [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.first, stop = edges[0::2], edges[1::2]
        self.size = stop - self.first
        self.goes_on = np.zeros(len(stop), bool)
        if len(stop):
            self.goes_on[:-1] = (self.first[1:] - stop[:-1] == 1) & (self.bytes[stop[:-1]] == BLANK)
        self.eights = np.ndarray((len(kept) + 1,), "<u8", self.bytes, 0, (1,))  # the eight bytes from every place on
        self.hash = self._hashed()

    def block(self, first: np.ndarray, size: np.ndarray, k: int) -> np.ndarray:
        """The k-th eight bytes of spans, zero beyond their end."""
        return self.eights[first + 8 * k] & LOW[np.minimum(size - 8 * k, 8)]

    def _hashed(self) -> np.ndarray:
        import xxhash

        h = self.size.astype(np.uint64)
        on = np.arange(len(h))
        for k in range(8):
            if not len(on):
                break
            h[on] = _mixed(h[on] ^ self.block(self.first[on], self.size[on], k))
            on = on[self.size[on] > 8 * k + 8]
        for i in on.tolist():  # words of more than 64 bytes
            h[i] = xxhash.xxh3_64_intdigest(self.text(self.first[i], self.size[i]))
        return h

    def text(self, first: int, size: int) -> bytes:
        return self.bytes[first : first + size].tobytes()

    def counts(self, first: np.ndarray, size: np.ndarray, keys: np.ndarray) -> Iterator[tuple[bytes, int]]:
        """Each text among the spans and how often it occurs. Spans of one key are compared with the first one byte by byte."""
        while len(first):
            order = np.argsort(keys, kind="stable")
            first, size, keys = first[order], size[order], keys[order]
            heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            head = np.repeat(heads, np.diff(np.append(heads, len(keys))))
            same = size == size[head]
            on = np.flatnonzero(same & (head != np.arange(len(head))))
            k = 0
            while len(on):
                differs = self.block(first[on], size[on], k) != self.block(first[head[on]], size[on], k)
                same[on[differs]] = False
                on = on[~differs]
                k += 1
                on = on[size[on] > 8 * k]
            for f, n, c in zip(first[heads].tolist(), size[heads].tolist(), np.add.reduceat(same.astype(np.int64), heads).tolist()):
                yield self.text(f, n), c
            first, size, keys = first[~same], size[~same], keys[~same]


def _grams(words: Words, most: int, salt: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length m from 1 to most: m, the words that a phrase of m words begins with, and its key."""
    word = _mixed(words.hash + np.uint64(salt))
    places, keys = np.arange(len(word)), _mixed(word)
    yield 1, places, keys
    for m in range(2, most + 1):
        on = words.goes_on[places + m - 2]
        places = places[on]
        keys = _mixed(keys[on] * np.uint64(31) + word[places + m - 1])
        yield m, places, keys


def _among(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys may be in the set."""
    at = keys >> np.uint64(64 - int(len(bitmap)).bit_length() + 1 - 6)
    return (bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _bitmap(keys: DataFrame, most_bits: int) -> np.ndarray:
    """A bitmap over the keys' topmost bits: eight bits a key, but not more than 2**most_bits bits."""
    bits = min(most_bits, max(12, math.ceil(math.log2(max(1, keys.count()) * 8))))
    at = F.shiftrightunsigned("key", 64 - bits)
    words = keys.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(key, {64 - bits}) & 63 as int))")).alias("mask")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words["word"].to_numpy()] = words["mask"].to_numpy().view(np.uint64)
    return out


def _by_group(batches, shards: int) -> Iterator[tuple[bytes, int, list[bytes]]]:
    """Texts of one language and one shard each time: lang, shard, texts. Batches have text and lang as binary."""
    for part in slices(batches, 0, 8 << 20):
        groups: dict[tuple[bytes, int], list[bytes]] = {}
        for t, lang in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            groups.setdefault((lang, crc32(t) % shards), []).append(t)
        for (lang, shard), texts in groups.items():
            yield lang, shard, texts


def _summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts (one each, without counts)."""
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[heads], np.diff(np.append(heads, len(keys))) if counts is None else np.add.reduceat(counts, heads)


def _mined(docs: DataFrame, lengths: list[int], shards: int, below, support: list[int], buckets: int) -> DataFrame:
    """Keys of the phrases of these numbers of words that are frequent in some shard (the shard in a key's lowest bits is cleared).

    below: the broadcast bitmap of those one word shorter than the shortest, or None; such a phrase counts only if both of its
    parts are among them. Each task sends sorted distinct keys with counts, packed, to the owners of ranges of keys, which add
    them up. buckets, a power of two, is the number of owners.
    """
    low, shift = np.uint64(shards - 1), np.uint64(64 - (buckets.bit_length() - 1)) if buckets > 1 else None

    def packed(held):
        keys, counts = _summed(np.concatenate(held))
        owner = (keys >> shift).astype(np.int64) if shift is not None else np.zeros(len(keys), np.int64)
        cuts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])).tolist() + [len(keys)]
        for at in range(0, len(cuts) - 1, 4096):
            spans = list(zip(cuts[at : at + 4096], cuts[at + 1 : at + 4097]))
            columns = [pa.array([int(owner[a]) for a, _ in spans], pa.int64()), pa.array([keys[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([counts[a:b].astype("<u4").tobytes() for a, b in spans], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["bucket", "keys", "counts"])

    def run(batches):
        held, n_held = [], 0
        for lang, shard, texts in _by_group(batches, shards):
            words = Words(texts)
            before = None
            for m, places, keys in _grams(words, lengths[-1], crc32(lang)):
                if m == lengths[0] - 1 and below is not None:
                    before = np.zeros(len(words.size) + 1, bool)
                    before[places] = _among(below.value, keys)
                if m in lengths:
                    if m == lengths[0] and before is not None:
                        keys = keys[before[places] & before[places + 1]]
                    held.append(keys & ~low | np.uint64(shard))
                    n_held += len(keys)
            if n_held > HELD:
                yield from packed(held)
                held, n_held = [], 0
        if n_held:
            yield from packed(held)

    least = np.array(support)

    def owned(group: pa.Table) -> pa.Table:
        keys, counts = (np.concatenate([np.frombuffer(b, kind) for b in group[c].to_pylist()]) for c, kind in (("keys", "<u8"), ("counts", "<u4")))
        keys, counts = _summed(keys, counts.astype(np.int64))
        keys = keys[counts >= least[(keys & low).astype(np.int64)]] & ~low
        return pa.table([pa.array(np.unique(keys).view(np.int64))], names=["key"])

    return table(docs.select("text", "lang").mapInArrow(run, "bucket long, keys binary, counts binary").groupBy("bucket").applyInArrow(owned, "key long"), "local")


def _counted(docs: DataFrame, most: int, maps: dict) -> DataFrame:
    """lang, phrase, m, n: exact counts in the whole corpus of the phrases that the maps may hold and, as phrase "" with m = 0, of words."""

    def run(batches):
        sums: dict[tuple[bytes, int], dict[bytes, int]] = {}

        def flushed():
            rows = [(lang, phrase, m, n) for (lang, m), found in sums.items() for phrase, n in found.items()]
            for at in range(0, len(rows), 50_000):
                columns = list(zip(*rows[at : at + 50_000]))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int64())], names=["lang", "phrase", "m", "n"])

        for lang, _, texts in _by_group(batches, 1):
            if sum(map(len, sums.values())) > 1_000_000:
                yield from flushed()
                sums = {}
            words = Words(texts)
            total = sums.setdefault((lang, 0), {})
            total[b""] = total.get(b"", 0) + len(words.size)
            for m, places, keys in _grams(words, most, crc32(lang)):
                on = _among(maps[max(m, 2)].value, keys)
                first, last = words.first[places[on]], places[on] + m - 1
                found = sums.setdefault((lang, m), {})
                for phrase, n in words.counts(first, words.first[last] + words.size[last] - first, keys[on]):
                    found[phrase] = found.get(phrase, 0) + n
        yield from flushed()

    counted = docs.select("text", "lang").mapInArrow(run, "lang binary, phrase binary, m int, n long")
    return counted.groupBy("lang", "phrase", "m").agg(F.sum("n").alias("n")).withColumn("lang", F.col("lang").cast("string")).withColumn("phrase", F.col("phrase").cast("string"))


def score(a: str, left: str, right: str) -> Column:
    """floor(10**6 a a / (left right)) of counts, exactly: in decimals of 38 digits, which hold it for counts below 10**16."""
    return F.expr(f"cast(cast(`{a}` as decimal(19,0)) * cast(`{a}` as decimal(19,0)) * cast(1000000 as decimal(7,0)) as decimal(38,0)) div cast(cast(`{left}` as decimal(19,0)) * cast(`{right}` as decimal(19,0)) as decimal(38,0))")


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", *, least: int = 10, most_words: int = 3, overlap: int = 50, top: int = 2000, shards: int = 4, most_bits: int = 26, bucket_bytes: int = 16 << 20
) -> DataFrame:
    """The first `top` phrases of each language: lang, rank, phrase, a, l, r, n, score (numbers long).

    A-Z are lowered; pieces end at .,;:!? and U+000A to U+000D, words are runs of anything but blank and tab. a: occurrences
    of the phrase (2 to most_words words, a >= least), l and r those of the parts of its lowest-scoring cut (ties: the
    shortest first part), n: all words of the language, score: floor(10**6 a a / (l r)), exact in decimals of 38 digits. A phrase is
    dropped if a longer one holds its words in a row and occurs at least `overlap` percent as often. Null text: empty;
    null language: und. Repeated rows count each time; languages without phrases give no rows.

    Bounds: bitmaps of candidates have at most 2**most_bits bits; the more candidates beyond that, the more phrases are counted that are
    none, with equal results. shards is a power of two. A task holds some 4 million keys at a time, or those of about bucket_bytes of text.
    """
    if shards & (shards - 1):
        raise ValueError("shards must be a power of two")
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    docs = docs.select(text.alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).cast("binary").alias("lang"))
    sizes = {r.shard: r.size for r in docs.groupBy(F.pmod(F.crc32("text"), F.lit(shards)).alias("shard")).agg(F.sum(F.octet_length("text")).alias("size")).collect()}
    total = sum(sizes.values()) or 1
    support = [-(-least * sizes.get(k, 0) // total) or 1 for k in range(shards)]
    buckets = 1 << max(0, math.ceil(math.log2(max(1, total / bucket_bytes))))
    maps, below = {}, None
    for lengths in [[1, 2], *([m] for m in range(3, most_words + 1))]:
        local = _mined(docs, lengths, shards, below, support, buckets)
        below = maps[lengths[-1]] = spark.sparkContext.broadcast(_bitmap(local, most_bits))
    counted = _counted(docs, most_words, maps)
    counts = table(counted.withColumn("key", F.concat_ws("\n", "lang", "phrase")), "phrases")  # words hold no line feed
    sums = counts.where("m = 0").select("lang", F.col("n").alias("words"))
    often = table(counts.where((F.col("m") > 0) & (F.col("n") >= least)), "often")
    found = often.where("m > 1")
    part = lambda k, first: F.concat_ws("\n", "lang", F.array_join(F.slice("w", F.lit(1) if first else k + 1, k if first else F.col("m") - k), " "))
    cut = F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k")
    cuts = found.withColumn("w", F.split("phrase", " ")).select("*", cut)
    cuts = table(cuts.select("key", "lang", "phrase", "m", F.col("n").alias("a"), "k", part(F.col("k"), True).alias("left"), part(F.col("k"), False).alias("right")), "cuts")
    cuts = lookup(cuts, often.select(F.col("key").alias("left"), F.col("n").alias("l")), "left")
    cuts = lookup(table(cuts, "cuts"), often.select(F.col("key").alias("right"), F.col("n").alias("r")), "right")
    scored = cuts.groupBy("key").agg(F.min(F.struct(score("a", "l", "r").alias("score"), "k", "lang", "phrase", "a", "l", "r")).alias("best")).select("key", "best.*")
    # every run of words inside a longer phrase, with that phrase's count; each is itself as frequent, so it is among the candidates
    span = F.explode(F.expr(f"flatten(transform(sequence(2, m - 1), s -> transform(sequence(1, m - s + 1), i -> array_join(slice(w, i, s), ' '))))")).alias("inner")
    inner = found.where("m > 2").withColumn("w", F.split("phrase", " ")).select("lang", "n", span)
    longer = inner.groupBy(F.concat_ws("\n", "lang", "inner").alias("key")).agg(F.max("n").alias("longer"))
    kept = scored.join(longer, "key", "left").where(F.col("longer").isNull() | (F.col("longer").cast("decimal(19,0)") * 100 < F.col("a").cast("decimal(19,0)") * overlap))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    some = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(32)))  # first the best of each of 32 parts: one language may have most phrases
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    first = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return first.join(F.broadcast(sums), "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", F.col("words").alias("n"), "score")
