"""Near-duplicate documents by word n-gram Jaccard, joined on PartEnum signatures.

Sets fall into size bands. Two sets of a band pair that reach the threshold differ in at most k elements. The domain is cut in
two levels: into n1 > k / 2 partitions, of which some then holds at most one difference, and each of these into three parts, of
which two then hold the same elements of both sets. So each partition gives a signature for each of its three subsets of two
parts, a hash of the set's elements in them, and similar sets share one. Subsets with one element or none say little: s spare
partitions make up for up to s partitions with such a subset, which then go unsigned. Only sets with more than s of these sign
their single elements too, and only those with more than s partitions with an empty subset also these. Nothing is lost.

Of the sets that share a signature only pairs with the signature's leader are verified at first (a star). If all of them
hold, or their ends are connected by others, the group is done. Only members left apart from the leader's component are
compared with the group's members of other components, each pair once: in the smallest of the groups that both are in. A parity sketch, which can only underestimate the difference, drops
hopeless pairs before any set is fetched.
"""

from __future__ import annotations

from math import ceil, exp, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import bitmap_filter, components, lookup, may_contain, slices, table

MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
SKETCH_WORDS = 4
WIDE_FROM = 512
FIRST_KEYS = 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, remembered; bounded by clear() between batches."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        h = xxh64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


def shingle_sets(texts: list[str | None], n: int, words: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed n-word shingles of all texts, sorted within each, and where each text's begin (len+1 bounds).

    A text with fewer than n words is one shingle as a whole, one without words none. A-Z are lower-cased, nothing else.
    """
    if len(words) > 120_000:
        words.clear()
    lists = [t.encode("utf-8", "surrogatepass").lower().split() if t else [] for t in texts]
    counts = np.array([len(x) for x in lists], np.int64)
    h = np.fromiter((words[w] for x in lists for w in x), np.uint64, int(counts.sum()))
    starts = np.cumsum(counts) - counts
    hashes, owners = [], []
    if len(h) >= n:
        roll = np.zeros(len(h) - n + 1, np.uint64)
        for k in range(n):
            roll = mix(roll + h[k : len(h) - n + 1 + k] + np.uint64(k + 1))
        owner = np.repeat(np.arange(len(texts)), counts)
        whole = owner[: len(roll)] == owner[n - 1 :]
        hashes.append(roll[whole])
        owners.append(owner[: len(roll)][whole])
    for i in np.flatnonzero((counts > 0) & (counts < n)):
        part = np.zeros(1, np.uint64)
        for k in range(counts[i]):
            part = mix(part + h[starts[i] + k : starts[i] + k + 1] + np.uint64(k + 1))
        hashes.append(mix(part + counts[i : i + 1].astype(np.uint64)))
        owners.append(np.array([i]))
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    sh, ow = np.concatenate(hashes), np.concatenate(owners)
    order = np.lexsort((sh, ow))
    sh, ow = sh[order], ow[order]
    new = np.ones(len(sh), bool)
    new[1:] = (sh[1:] != sh[:-1]) | (ow[1:] != ow[:-1])
    sh, ow = sh[new], ow[new]
    return sh, np.searchsorted(ow, np.arange(len(texts) + 1))


def bands(num: int, den: int, largest: int) -> list[tuple[int, int]]:
    """Size bands [low, high] for the threshold num/den: sets that reach it are in the same or in neighbouring bands."""
    out, low = [], 1
    while low <= largest:
        high = low * den // num
        out.append((low, high))
        low = high + 1
    return out


def parts_of(high: int, num: int, den: int) -> tuple[int, int]:
    """For the pairs of a band with largest size high and the band below: largest difference k and number of partitions."""
    k = floor(2 * high * (den - num) / (den + num) + 1e-9)
    least = k // 2 + 1
    mean = 2 / 3 * high * num / den / least  # elements of a subset
    return k, least + min(1 + least // 2, 1 + ceil(4.5 * least * exp(-mean) * (1 + mean)))


def signatures(sh: np.ndarray, bounds: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, index of the set) of all sets; sets of which only equal ones can reach the threshold sign their whole."""
    sizes = np.diff(bounds)
    if not sizes.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    all_bands = bands(num, den, int(sizes.max()))
    highs = np.array([h for _, h in all_bands])
    band = np.searchsorted(highs, sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    top = bands(num, den, int(highs[-1]) + 1)
    params = np.array([parts_of(h, num, den) for _, h in top], np.int64)
    # a set and one of the band above are smaller together, differ in less and so leave more spare partitions
    below = np.array([0] + [floor((a + b) * (den - num) / (den + num) + 1e-9) for (_, a), (_, b) in zip(top, top[1:])], np.int64)
    scrambled = mix(sh ^ np.uint64(0x9E3779B97F4A7C15))
    sigs, owners = [], []
    for step in (0, 1):
        b = band + step
        k, parts = params[np.minimum(b, len(params) - 1)].T
        salt = mix(b.astype(np.uint64) + np.uint64(77))
        whole = np.flatnonzero((sizes > 0) & (k == 0)) if step == 0 else np.zeros(0, np.int64)
        if len(whole):
            sums = np.add.reduceat(np.append(mix(sh), np.uint64(0)), np.minimum(bounds[:-1], len(sh)))
            sigs.append(mix(mix(sums[whole]) + salt[whole]))
            owners.append(whole)
        live = (sizes > 0) & (k > 0)
        spare = parts - 1 - (below[np.minimum(b, len(below) - 1)] if step else k) // 2
        cells = np.where(live, 3 * parts, 0)
        first = np.cumsum(cells) - cells
        use = live[owner]
        cell = first[owner[use]] + (scrambled[use] % cells[owner[use]].astype(np.uint64)).astype(np.int64)
        total = np.zeros(int(cells.sum()), np.uint64)
        np.add.at(total, cell, mix(sh[use]))
        n = np.bincount(cell, minlength=len(total)).reshape(-1, 3)
        total = mix(total + np.tile(np.array([11, 13, 17], np.uint64), len(n))).reshape(-1, 3)
        own = np.repeat(np.arange(len(sizes)), cells // 3)
        inner = np.arange(len(n)) - first[own] // 3
        pairs = [(0, 1), (0, 2), (1, 2)]
        held = np.stack([n[:, i] + n[:, j] for i, j in pairs], 1)
        fewest = held.min(1)
        light, bare = (np.bincount(own[fewest <= m], minlength=len(sizes)) > spare for m in (1, 0))
        least = np.where(bare, 0, np.where(light, 1, 2))[own]
        for j, (x, y) in enumerate(pairs):
            signed = held[:, j] >= least
            sigs.append(mix(mix(total[signed, x] + total[signed, y] + (3 * inner[signed] + j).astype(np.uint64)) + salt[own[signed]]))
            owners.append(own[signed])
    return np.concatenate(sigs), np.concatenate(owners)


def sketches(sh: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Parity of the number of elements in each of 256 cells: two sets differ in at least as many elements as their sketches in bits."""
    cells = 64 * SKETCH_WORDS
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    bit = (mix(sh + np.uint64(5)) % np.uint64(cells)).astype(np.int64)
    odd = (np.bincount(owner * cells + bit, minlength=(len(bounds) - 1) * cells) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(-1, cells), axis=1).view(np.int64)


def wide_sketches(sh: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """Such parities of long sets, in 0.7 to 1.4 cells an element (a power of two); empty for sets that 256 cells can tell apart."""
    h, out = mix(sh + np.uint64(5)), []
    for i, j in zip(bounds[:-1], bounds[1:]):
        if j - i < WIDE_FROM:
            out.append(b"")
            continue
        cells = 1 << int(0.7 * (j - i)).bit_length()
        odd = np.bincount((h[i:j] & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
        out.append(np.packbits(odd.astype(np.uint8), bitorder="little").tobytes())
    return out


def wide_apart(x: str, y: str):
    """In how many cells two wide sketches differ, the longer one folded; 0 where one is null. Sizes within a ratio of 2."""
    differ = lambda a, b: f"aggregate(zip_with({a}, {b}, (p, q) -> bit_count(p ^ q)), 0, (n, v) -> n + v)"
    fold = lambda a: f"zip_with(slice({a}, 1, cast(size({a}) / 2 as int)), slice({a}, cast(size({a}) / 2 as int) + 1, cast(size({a}) / 2 as int)), (p, q) -> p ^ q)"
    return F.expr(
        f"case when {x} is null or {y} is null then 0 when size({x}) = size({y}) then {differ(x, y)} "
        f"when size({x}) = 2 * size({y}) then {differ(fold(x), y)} when 2 * size({x}) = size({y}) then {differ(x, fold(y))} else 0 end"
    )


SCHEMA = "kind int, key long, id long, leader long, size long, same long, s0 long, s1 long, s2 long, s3 long, wide array<long>"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
WIDE = pa.list_(pa.int64())


def _signed(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Rows (key, id, more): a signature and the smallest id that has it in this buffer (more is null), a member and, in more, its
    leader of the buffer (8 bytes), and one for each document with its size, sum and sketches (48 bytes or longer)."""

    def run(batches):
        words = WordHashes()

        def rows(key, ident, more=None):
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ident), pa.nulls(len(key), pa.binary()) if more is None else pa.array(more, pa.binary())], names=["key", "id", "more"])

        def members(key, ident, leader):
            return rows(key, ident, [x.tobytes() for x in leader])

        held: list = []

        def flush():
            sig, ids = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
            held.clear()
            order = np.lexsort((ids, sig))
            sig, ids = sig[order], ids[order]
            first = np.append(True, sig[1:] != sig[:-1]) if len(sig) else np.zeros(0, bool)
            leader = ids[np.maximum.accumulate(np.where(first, np.arange(len(sig)), 0))] if len(sig) else ids
            yield rows(sig[first], ids[first])
            more = ~first & (leader != ids)
            if more.any():
                yield members(sig[more], ids[more], leader[more])

        waiting = 0
        for part in slices(batches, 1, 1 << 20):
            ids = np.asarray(part.column(0).cast(pa.int64()), np.int64)
            sh, bounds = shingle_sets(part.column(1).to_pylist(), n, words)
            sizes = np.diff(bounds)
            sums = np.zeros(len(ids), np.uint64)
            if (sizes > 0).any():
                sums[sizes > 0] = np.add.reduceat(mix(sh + np.uint64(9)), bounds[:-1][sizes > 0])
            facts = np.column_stack([sizes, sums.view(np.int64), sketches(sh, bounds)])
            yield rows(mix(ids.view(np.uint64)), ids, [f.tobytes() + w for f, w in zip(facts, wide_sketches(sh, bounds))])
            # of equal sets only the smallest id signs; the others follow it
            order = np.lexsort((ids, sums, sizes))
            z, q = sizes[order], sums[order]
            new = np.append(True, (z[1:] != z[:-1]) | (q[1:] != q[:-1]))
            lead = ids[order][np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
            copies = ~new & (z > 0) & (lead != ids[order])
            if copies.any():
                yield members(q[copies], ids[order][copies], lead[copies])
            signing = np.zeros(len(ids), bool)
            signing[order[new]] = True
            sig, own = signatures(sh, bounds, num, den)
            take = signing[own]
            held.append((sig[take], ids[own[take]]))
            waiting += int(take.sum())
            if waiting > 300_000:
                yield from flush()
                waiting = 0
        if held:
            yield from flush()

    return docs.mapInArrow(run, "key long, id long, more binary")


def _stars(batches):
    """Sorted rows of _signed to rows of SCHEMA: kind 1 for a member and its leader, the signature's first and smallest id, kind 2 for a document."""
    last_key = last_id = None

    def members(key, ids, leader):
        m = len(key)
        return pa.RecordBatch.from_arrays([pa.array(np.ones(m, np.int32)), pa.array(key), pa.array(ids), pa.array(leader), *[pa.nulls(m, pa.int64())] * 6, pa.nulls(m, WIDE)], names=COLUMNS)

    for b in batches:
        other = np.flatnonzero(np.asarray(b.column(2).is_valid()))
        key, ids = np.asarray(b.column(0)), np.asarray(b.column(1))
        if len(other):
            more = b.column(2).take(pa.array(other)).to_pylist()
            led = np.array([len(x) == 8 for x in more])
            if led.any():
                yield members(key[other[led]], ids[other[led]], np.frombuffer(b"".join(x for x in more if len(x) == 8), np.int64))
            if not led.all():
                full, at = [x for x in more if len(x) > 8], other[~led]
                facts = np.stack([np.frombuffer(x[:48], np.int64) for x in full], 1)
                wide = pa.array([np.frombuffer(x[48:], np.int64) if len(x) > 48 else None for x in full], WIDE)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), 2, np.int32)), pa.array(key[at]), pa.array(ids[at]), pa.nulls(len(at), pa.int64()), *map(pa.array, facts), wide], names=COLUMNS)
        own = np.ones(len(key), bool)
        own[other] = False
        key, ids = key[own], ids[own]
        if not len(key):
            continue
        first = np.append(key[0] != last_key if last_key is not None else True, key[1:] != key[:-1])
        at = np.maximum.accumulate(np.where(first, np.arange(len(key)), -1))
        leader = np.where(at >= 0, ids[np.maximum(at, 0)], last_id if last_id is not None else 0)
        last_key, last_id = key[-1], leader[-1]
        more = ~first & (leader != ids)
        if more.any():
            yield members(key[more], ids[more], leader[more])


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """(id, shingles): the hashed shingle set of each row, as a sorted array."""

    def run(batches):
        words = WordHashes()
        for part in slices(batches, 1):
            sh, bounds = shingle_sets(part.column(1).to_pylist(), n, words)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(sh.view(np.int64)))], names=["id", "shingles"])

    return docs.mapInArrow(run, "id long, shingles array<long>")


def _bitmaps(docs: DataFrame, n: int) -> DataFrame:
    """(id, bits): a parity sketch like sketches(), of at least four cells an element, so it is a sixteenth of the set's size."""

    def run(batches):
        words = WordHashes()
        for part in slices(batches, 1):
            sh, bounds = shingle_sets(part.column(1).to_pylist(), n, words)
            h, out = mix(sh + np.uint64(5)), []
            for i, j in zip(bounds[:-1], bounds[1:]):
                cells = max(256, 1 << int(4 * (j - i)).bit_length())
                odd = np.bincount((h[i:j] & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
                out.append(np.packbits(odd.astype(np.uint8), bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.binary())], names=["id", "bits"])

    return docs.mapInArrow(run, "id long, bits binary")


def _close(num: int, den: int):
    """Keeps pairs whose bitmaps do not rule them out; the longer bitmap is folded to the shorter one's cells first."""

    def run(batches):
        for b in batches:
            keep = []
            for size_a, size_b, x, y in zip(*(b.column(i).to_pylist() for i in range(2, 6))):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                while len(x) > len(y):
                    x = x[: len(x) // 2] ^ x[len(x) // 2 :]
                while len(y) > len(x):
                    y = y[: len(y) // 2] ^ y[len(y) // 2 :]
                keep.append((den + num) * int(np.bitwise_count(x ^ y).sum()) <= (den - num) * (size_a + size_b))
            yield b.select(["a", "b", "size_a", "size_b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verified(pairs: DataFrame, docs: DataFrame, info: DataFrame, n: int, num: int, den: int, bits: int) -> DataFrame:
    """Of the pairs (a, b) those with den * intersection >= num * union, whole sets compared."""
    of = lambda side: info.select(F.col("id").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("size", "same", "s0", "s1", "s2", "s3", "wide")])
    known = lookup(table(pairs, "tried"), of("a"), "a").join(of("b"), "b")  # a leader may have very many pairs, a member has few
    small, large = F.least("size_a", "size_b"), F.greatest("size_a", "size_b")
    # |A ^ B| <= (|A|+|B|) (den-num)/(den+num) for pairs that hold; the sketches differ in no more bits than the sets in elements
    apart = sum((F.bit_count(F.col(f"s{i}_a").bitwiseXOR(F.col(f"s{i}_b"))) for i in range(SKETCH_WORDS)), F.lit(0))
    known = known.where((den * small >= num * large) & (small > 0) & ((den + num) * apart <= (den - num) * (small + large)) & ((den + num) * wide_apart("wide_a", "wide_b") <= (den - num) * (small + large)))
    equal = (F.col("size_a") == F.col("size_b")) & (F.col("same_a") == F.col("same_b"))
    known = table(known.select("a", "b", "size_a", "size_b", equal.alias("equal")), "pairs")
    open_pairs = known.where("not equal").drop("equal")

    def ends_of(pairs):
        ends = pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct()
        words = table(bitmap_filter(ends, bits), "pair-ends")
        return may_contain(docs, "id", words, "wanted", bits).where("wanted").select("id", "text")

    maps = _bitmaps(ends_of(open_pairs), n).dropDuplicates(["id"])
    close = open_pairs.join(maps.select(F.col("id").alias("a"), F.col("bits").alias("bits_a")), "a").join(maps.select(F.col("id").alias("b"), F.col("bits").alias("bits_b")), "b")
    close = close.select("a", "b", "size_a", "size_b", "bits_a", "bits_b").mapInArrow(_close(num, den), "a long, b long, size_a long, size_b long")
    open_pairs = table(close, "close-pairs")
    sets = _sets(ends_of(open_pairs), n).dropDuplicates(["id"])
    left = open_pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").select("a", "b", "size_a", "size_b", "x")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    good = both.where(den * common >= num * (F.col("size_a") + F.col("size_b") - common)).select("a", "b")
    return known.where("equal").select("a", "b").union(good)


def _apart(member: DataFrame, heads: DataFrame, comp: DataFrame) -> DataFrame:
    """(key, m, cm, off) of the groups (key) that are not one component; off tells the members outside their head's component cm."""
    comp_of = lambda side: comp.select(F.col("v").alias(f"v_{side}"), F.col("component").alias(f"c_{side}"))
    member = member.join(comp_of("m"), F.col("m") == F.col("v_m"), "left").select("key", "m", F.coalesce("c_m", "m").alias("cm"))
    heads = heads.join(comp_of("h"), F.col("head") == F.col("v_h"), "left").select("key", F.coalesce("c_h", "head").alias("ch"))
    known = member.join(heads, "key").select("key", "m", "cm", (F.col("cm") != F.col("ch")).alias("off"))
    return known.join(known.where("off").select("key").distinct(), "key", "left_semi")


def _split_groups(stars: DataFrame, tried: DataFrame, comp: DataFrame, bits: int) -> DataFrame:
    """The stars of the groups of which an edge (b, a) has its ends in different components; tried has the stars' edges, each once.

    A group's edges connect it, so the others are one component. Edges and groups are looked up in bitmaps first: of the stars only
    those that pass are shuffled.
    """
    for c in ("a", "b"):
        tried = tried.join(comp.select(F.col("v").alias(f"v_{c}"), F.col("component").alias(f"c_{c}")), F.col(c) == F.col(f"v_{c}"), "left")
    split = table(tried.where(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select("a", "b"), "split-edges")

    def among(rows, found, on):
        words = table(bitmap_filter(found.select(F.col("look").alias("key")), bits), "split-map")
        return may_contain(rows, "look", words, "maybe", bits).where("maybe").join(found.drop("look"), on, "left_semi")

    edge = F.xxhash64(F.least("a", "b"), F.greatest("a", "b"))
    keys = table(among(stars.withColumn("look", edge).withColumn("lo", F.least("a", "b")).withColumn("hi", F.greatest("a", "b")), split.select(F.col("a").alias("lo"), F.col("b").alias("hi"), edge.alias("look")), ["lo", "hi"]).select("key").distinct(), "split-keys")
    return among(stars.withColumn("look", F.col("key")), keys.withColumn("look", F.col("key")), "key").select("key", "b", "a")


def _cross(apart: DataFrame, one: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of members of one group and different components, one of them off; sizes and sketches decide inside the join which can hold.

    Each row carries the FIRST_KEYS smallest of its groups. Where two rows have a common one, the smallest such is the smallest
    group of both, and the pair is made only there; pairs without one are made in each common group and made distinct after.
    """
    firsts = apart.groupBy("m").agg(F.slice(F.sort_array(F.collect_set("key")), 1, FIRST_KEYS).alias("k"))
    about = one.drop("same", "kind", "key", "leader").join(firsts, F.col("m") == F.col("id")).drop("m")
    side = lambda x: about.select(*[F.col(c).alias(f"{c}_{x}") for c in about.columns])
    left = apart.where("off").select("key", F.col("m").alias("f"), F.col("cm").alias("cf")).join(side("f"), F.col("f") == F.col("id_f"))
    right = apart.join(side("m"), F.col("m") == F.col("id_m"))
    small, large = F.least("size_f", "size_m"), F.greatest("size_f", "size_m")
    differ = sum((F.bit_count(F.col(f"s{i}_f").bitwiseXOR(F.col(f"s{i}_m"))) for i in range(SKETCH_WORDS)), F.lit(0))
    likely = (den * small >= num * large) & ((den + num) * differ <= (den - num) * (small + large)) & ((den + num) * wide_apart("wide_f", "wide_m") <= (den - num) * (small + large))
    once = (F.col("cf") != F.col("cm")) & (~F.col("off") | (F.col("f") < F.col("m")))
    here = F.coalesce(F.array_min(F.array_intersect("k_f", "k_m")), F.col("l.key")) == F.col("l.key")
    pairs = left.alias("l").join(right.alias("r"), (F.col("l.key") == F.col("r.key")) & once & likely & here)
    return pairs.select(F.least("f", "m").alias("a"), F.greatest("f", "m").alias("b")).distinct()


def _linked(docs: DataFrame, num: int, den: int, n: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """Of documents (id, text; one text an id) the rows (id, n_shingles), each as often as it comes, and links (a, b) that connect what
    is linked."""
    signed = _signed(docs, n, num, den)
    found = signed.repartition("key").sortWithinPartitions("key", "id").mapInArrow(_stars, SCHEMA)
    found = table(found, "stars")
    info = found.where("kind = 2").select("id", "size", "same", "s0", "s1", "s2", "s3", "wide")
    stars = found.where("kind = 1").select("key", F.col("id").alias("b"), F.col("leader").alias("a"))
    one = info.dropDuplicates(["id"])
    tried = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = table(_verified(tried, docs, one, n, num, den, bits), "links")
    comp = components(links)
    stars = table(_split_groups(stars, tried, comp, bits), "split-stars")
    member = stars.select("key", F.col("b").alias("m")).union(stars.select("key", F.col("a").alias("m"))).distinct()
    heads = stars.groupBy("key").agg(F.min("a").alias("head"))
    apart = table(_apart(member, heads, comp), "apart")
    if apart.limit(1).count():
        rest = _cross(apart, one, num, den).join(tried, ["a", "b"], "left_anti")
        links = links.union(table(_verified(rest, docs, one, n, num, den, bits), "links"))
    return info.select("id", F.col("size").alias("n_shingles")), links


def _text_key():
    return F.xxhash64("id", F.coalesce("text", F.lit("")))


def _named_apart(docs: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """Where ids have several texts: the documents with a hash of id and text for those ids, and names (key, id) of these hashes; else
    None. Only the ids' hashes are shuffled to find out."""
    h = _text_key()
    several = table(docs.select("id", h.alias("h")).groupBy("id").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi").select("id"), "several-texts")
    if several.isEmpty():
        return None
    words = table(bitmap_filter(several.select(F.col("id").alias("key"))), "several-texts-map")
    marked = may_contain(docs, "id", words, "maybe")
    maybe = marked.where("maybe").join(several.withColumn("several", F.lit(True)), "id", "left")
    keyed = maybe.select("id", "text", F.when(F.col("several"), h).otherwise(F.col("id")).alias("key"))
    keyed = table(keyed, "keyed")
    return marked.where("not maybe").select("id", "text").union(keyed.select(F.col("key").alias("id"), "text")), table(keyed.where("key <> id").select("key", "id").distinct(), "names")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = 5, threshold: tuple[int, int] = (80, 100), bits: int = 23) -> DataFrame:
    """One row for each row of docs: id_col, n_shingles, component_id (the smallest id reachable by links, itself included).

    Two documents link when the Jaccard similarity of their sets of word n-grams reaches threshold (numerator, denominator).
    Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased. Null, empty and blank texts have no shingles and link with nothing.
    Ids are integers; rows with the same id count as one document: its links are those of all its texts, n_shingles is that of the
    row's own. A null id links with nothing and has a null component. Shingles, and different texts of one id, are compared as
    64-bit hashes.
    """
    num, den = threshold
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    known_ids = base.where("id is not null")
    apart = _named_apart(known_ids)
    if apart is None:
        rows, links = _linked(known_ids, num, den, words, bits)
        comp = components(links)
        found = rows.join(comp, rows.id == comp.v, "left").select("id", "n_shingles", F.coalesce("component", "id").alias("component_id"))
    else:
        keyed, names = apart
        rows, links = _linked(keyed, num, den, words, bits)
        # the texts of one id are tied together at their id, so components are of ids
        named = lambda c: F.coalesce(F.col(f"id_{c}"), F.col(c)).alias(c)
        for c in ("a", "b"):
            links = links.join(names.select(F.col("key").alias(c), F.col("id").alias(f"id_{c}")), c, "left").select(named(c), "b" if c == "a" else "a")
        comp = components(links.where("a <> b"))
        rows = rows.withColumnRenamed("id", "key").join(names, "key", "left").select(F.coalesce("id", "key").alias("id"), "n_shingles")
        found = rows.join(comp, rows.id == comp.v, "left").select("id", "n_shingles", F.coalesce("component", "id").alias("component_id"))
    out = found.select(F.col("id").alias(id_col), "n_shingles", "component_id")
    nameless = _sets(base.where("id is null"), words).select(F.col("id").alias(id_col), F.size("shingles").cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return out.union(nameless)


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs, all columns, without the rows whose near-duplicate group has a smaller id; of repeated ids all rows stay or go."""
    groups = near_duplicates(docs, id_col, text_col, **how).where(f"`{id_col}` <> component_id").select(F.col(id_col).alias("key")).distinct()
    gone = table(groups, "near-copies")
    words = table(bitmap_filter(gone), "near-copies-map")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"))
    marked = may_contain(rows, "id", words, "maybe")
    maybe = marked.where("maybe").join(gone, F.col("id") == F.col("key"), "left_anti")
    return marked.where("not maybe").select("row.*").union(maybe.select("row.*"))
