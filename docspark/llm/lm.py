"""Language-model scores from a hashed maximum-entropy model with class-factored softmax.

Words are the leaves of a tree of nested classes with at most WIDTH branches a node, deeper the rarer they are: P(word | context) is the
product of one small softmax for each node on the word's path. The scores of a node's branches add up rows of one weight
table, which hashes of (n-gram or skip feature of the context, node) point to; so the words of a class are told apart by
softmax as well. Words that are not frequent share leaves by their ending and have their share of it by their count.

Training is distributed: tasks sum up what their documents show and what the model expects of them, and each weight follows
that gradient. Words never leave Spark as a whole: a bounded number of frequent ones is broadcast, the others meet their
counts in a join.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import fold_of, slices, table

WIDTH, ENDINGS = 16, 64
#: Rows of the weight table for each feature: the word before, the two words before, the word two back.
REGIONS = (1 << 16, 1 << 17, 1 << 16)
ROWS = sum(REGIONS)
BLOCK, TILE, TOKENS = 4096, 1 << 13, 1 << 20
BEGIN_HASH, END_HASH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD80)
MIX = np.uint64(0xBF58476D1CE4E5B9)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX
    return x ^ (x >> np.uint64(29))


LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
LETTERS = mix(LOWER.astype(np.uint64) + BEGIN_HASH)
_POWERS = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 to base**(n-1), at least, modulo 2**64."""
    if len(_POWERS.get(base, ())) < n:
        steps = np.full(1 << (n - 1).bit_length(), base & (2**64 - 1), np.uint64)
        steps[0] = 1
        _POWERS[base] = np.cumprod(steps)
    return _POWERS[base]


def tokens_of(texts: list[str | None], piece: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """All texts' tokens, each text closed by the end token: word hashes and tokens per text.

    The low bits of a word's hash (modulo ENDINGS) come from its last three bytes; the others are a polynomial in its bytes (A-Z lower-cased)
    modulo 2**64, read off prefix sums over the whole buffer. A long buffer is cut at white space into pieces, so that only the hashes grow with it.
    """
    parts = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    buffer = np.frombuffer(b"\n" + b"\n".join(parts) + b"\n", np.uint8)
    space = (buffer == 32) | (buffer - np.uint8(9) < 5)
    edges = np.diff(space.view(np.int8))
    starts, ends = np.flatnonzero(edges == -1) + 1, np.flatnonzero(edges == 1) + 1
    hashes, lo = np.zeros(len(starts), np.uint64), 0
    odd, inverse = int(MIX) | 1, pow(int(MIX) | 1, -1, 2**64)
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + piece, "right")))
        a, z = int(starts[lo]), int(ends[hi - 1])
        sums = np.zeros(z - a + 1, np.uint64)
        np.cumsum(np.take(LETTERS, buffer[a:z]) * powers(odd, z - a)[: z - a], out=sums[1:])
        hashes[lo:hi] = mix((sums[ends[lo:hi] - a] - sums[starts[lo:hi] - a]) * powers(inverse, z - a)[starts[lo:hi] - a])
        lo = hi
    last, size = np.zeros(len(starts), np.uint32), np.minimum(ends - starts, 3).astype(np.uint8)
    for k in (1, 2, 3):
        last = (last << np.uint32(8)) | (np.take(LOWER, np.take(buffer, ends - k)) * (size >= k))
    last = last.astype(np.uint64)
    closing = np.cumsum([len(p) + 1 for p in parts])
    words = np.diff(np.searchsorted(starts, closing, "right"), prepend=0)
    at = np.ones(len(starts) + len(texts), bool)
    at[np.cumsum(words + 1) - 1] = False
    out, low = np.full(len(at), END_HASH), np.uint64(ENDINGS - 1)
    out[at] = (hashes & ~low) | ((mix(last) >> np.uint64(20)) & low)
    return out, words + 1


class Tree:
    """Nested classes over leaves of given mass, a Huffman code of WIDTH digits: node and branch of each leaf by level (-1 below the leaf), log share of each branch."""

    def __init__(self, mass: np.ndarray):
        size = len(mass)
        heap = [(m, k) for k, m in enumerate(mass.tolist())] + [(0.0, -1)] * (-(size - 1) % (WIDTH - 1))
        heapq.heapify(heap)
        inner: list[list[int]] = []  # the children of node k, which is number size + k in the heap
        while len(heap) > 1:
            least = [heapq.heappop(heap) for _ in range(WIDTH)]
            heapq.heappush(heap, (sum(m for m, _ in least), size + len(inner)))
            inner.append([c for _, c in least if c >= 0])
        self.nodes, self.branches, count = [], [], len(inner)
        level = [(count - 1, [])] if count else []
        while level:
            node, branch, deeper = np.full(size, -1, np.int32), np.zeros(size, np.int32), []
            for k, path in level:
                for b, c in enumerate(inner[k]):
                    if c < size:
                        for (n, was), up in zip([*path, (k, b)], [*zip(self.nodes, self.branches), (node, branch)]):
                            up[0][c], up[1][c] = n, was
                    else:
                        deeper.append((c - size, [*path, (k, b)]))
            self.nodes.append(node)
            self.branches.append(branch)
            level = deeper
        shares = np.zeros((count, WIDTH))
        for node, branch in zip(self.nodes, self.branches):
            on = node >= 0
            np.add.at(shares, (node[on], branch[on]), mass[on])
        with np.errstate(divide="ignore"):
            self.bias = np.maximum(np.log(shares / shares.sum(1, keepdims=True)), -1e4).astype(np.float32)

    def steps(self, leaves: np.ndarray):
        """For each level: which of the tokens have a node there, the nodes and the branches they take."""
        for node, branch in zip(self.nodes, self.branches):
            mine = node[leaves]
            on = np.flatnonzero(mine >= 0)
            if len(on):
                yield on, mine[on], branch[leaves[on]]


class Leaves:
    """Finds the leaf and log10(count+1) of words by hash: frequent words have one each, the others share those of their ending."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.leaf, self.logs = np.append(hashes[order], np.uint64(2**64 - 1)), order, np.log10(counts + 1.0)
        bits = len(order).bit_length() + 2
        self.shift = np.uint64(64 - bits)
        self.starts = np.searchsorted(self.hashes[:-1], np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # the first place of the hash's leading bits, and on from there; no hash is larger than the one at the end
        at = self.starts[hashes >> self.shift].astype(np.int64)
        below = np.flatnonzero(self.hashes[at] < hashes)
        while len(below):
            at[below] += 1
            below = below[self.hashes[at[below]] < hashes[below]]
        known = (self.hashes[at] == hashes) & (at < len(self.leaf))
        leaf = (hashes & np.uint64(ENDINGS - 1)).astype(np.int64) + len(self.leaf)
        leaf[known] = self.leaf[at[known]]
        return leaf, known


def contexts(hashes: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """Hashes of each token's features, in the order of REGIONS; before a text's first word stands BEGIN_HASH."""
    starts, begin = np.cumsum(counts) - counts, np.full(2, BEGIN_HASH)
    one = np.append(begin[:1], hashes)[: len(hashes)]
    two = np.append(begin, hashes)[: len(hashes)]
    one[starts] = two[starts] = BEGIN_HASH
    two[starts[counts > 1] + 1] = BEGIN_HASH
    return [one, (one * MIX) ^ two, two]


def at_node(feature: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Hashes of features at nodes."""
    x = node.astype(np.uint64)
    x *= BEGIN_HASH
    x += feature
    x *= MIX
    x ^= x >> np.uint64(32)
    return x


def rows_of(feature: np.ndarray, node: np.ndarray, k: int) -> np.ndarray:
    """Rows of the weight table for feature number k at the nodes."""
    x = at_node(feature, node)
    x &= np.uint64(REGIONS[k] - 1)
    x += np.uint64(sum(REGIONS[:k]))
    return x.view(np.int64)


def groups(tree: Tree, leaves: np.ndarray, features: list[np.ndarray]):
    """The tokens' steps down the tree in tiles: nodes and rows of groups of steps, how many each has, and the steps' branches, a group's together.

    The two words before a token settle all its features, so steps that have these and the node in common meet the same scores:
    these are worked out once. Groups come in order of their rows for the two words, the largest region, which is gone through once.
    """
    first, bits, third = (np.uint64(r.bit_length() - 1) for r in REGIONS)
    rest, place = np.uint64(64) - bits, np.uint64(TOKENS - 1)
    names = np.uint64(60) - first - third  # bits for a node, of which there are fewer than words
    for lo in range(0, len(leaves), TOKENS):
        for on, node, taken in tree.steps(leaves[lo : lo + TOKENS]):
            x = at_node(features[1][lo : lo + TOKENS][on], node)
            x = (x << rest) | (x >> bits)  # the bits of the row lead
            # what else a step needs, in one number: its branch, its node and the other two rows
            more = (taken.astype(np.uint64) << names) | node.astype(np.uint64)
            for k, wide in ((0, first), (2, third)):
                more <<= wide
                more |= at_node(features[k][lo : lo + TOKENS][on], node) & np.uint64(REGIONS[k] - 1)
            # the last bits give way to the step's place, so that numbers are sorted and no places; x itself tells groups apart
            order = np.sort((x & ~place) | np.arange(len(x), dtype=np.uint64))
            order = (order & place).view(np.int64)
            x, more = x[order], more[order]
            heads = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
            bounds = np.append(heads, len(x))
            taken = (more >> np.uint64(60)).view(np.int64)
            for at in range(0, len(heads), TILE):
                some = heads[at : at + TILE]
                facts, steps = more[some], slice(bounds[at], bounds[min(at + TILE, len(heads))])
                rows = [(facts >> third) & np.uint64(REGIONS[0] - 1), x[some] >> rest, facts & np.uint64(REGIONS[2] - 1)]
                nodes = ((facts >> (first + third)) & ((np.uint64(1) << names) - np.uint64(1))).view(np.int64)
                yield nodes, [r.view(np.int64) + sum(REGIONS[:k]) for k, r in enumerate(rows)], np.diff(bounds[at : at + TILE + 1]), taken[steps]


def exponentials(weights: np.ndarray, bias: np.ndarray, nodes: np.ndarray, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """exp of the scores of the nodes' branches, and their sums. Weights stay within 8, so float32 holds them."""
    z, more = (np.empty((len(nodes), WIDTH), np.float32) for _ in range(2))
    np.take(bias, nodes, axis=0, out=z, mode="clip")
    for r in rows:
        z += np.take(weights, r, axis=0, out=more, mode="clip")
    np.exp(z, out=z)
    return z, z @ np.ones(WIDTH, np.float32)


def add_rows(sums: np.ndarray, rows: np.ndarray, p: np.ndarray, mark: np.ndarray) -> None:
    """Adds p's rows to those of sums. Of the rows that name one place, the last is written as a whole, the others are added singly."""
    mark[rows] = at = np.arange(len(rows), dtype=np.int32)
    last = mark[rows] == at
    some, others = np.flatnonzero(last), np.flatnonzero(~last)
    to = rows[some]
    new = np.take(sums, to, axis=0, mode="clip")
    new += np.take(p, some, axis=0)
    line = np.dtype((np.void, WIDTH * sums.itemsize))
    sums.view(line).ravel()[to] = new.view(line).ravel()
    if len(others):
        np.add.at(sums.reshape(-1), (rows[others, None] * WIDTH + np.arange(WIDTH)).ravel(), np.take(p, others, axis=0).ravel())


def _blocks(matrices: list[np.ndarray]):
    """The matrices' rows in blocks, as a record batch (block, data); blocks of zeros are left out. Spark packs them as it deals them."""
    blocks = [np.concatenate([m[at : at + BLOCK] for m in matrices]) for at in range(0, ROWS, BLOCK)]
    some = [k for k, b in enumerate(blocks) if b.any()]
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([blocks[k].tobytes() for k in some], pa.binary())], names=["block", "data"])


def _summed(parts: DataFrame, matrices: int, tasks: int) -> list[np.ndarray]:
    """Sums of the tasks' matrices, of many tasks in two levels so that no task gets the blocks of all; the result has a fixed size."""

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(matrices * BLOCK * WIDTH)
        for x in group.data:
            total += np.frombuffer(x, np.float32)
        return pd.DataFrame({"block": group.block[:1], "data": [total.astype(np.float32).tobytes()]})

    if tasks > 16:
        parts = parts.withColumn("part", F.spark_partition_id() % math.isqrt(tasks)).groupBy("block", "part").applyInPandas(add, "block int, data binary")
    out = [np.zeros((ROWS, WIDTH), np.float32) for _ in range(matrices)]
    for r in parts.groupBy("block").applyInPandas(add, "block int, data binary").collect():
        for m, data in enumerate(np.frombuffer(r.data, np.float32).reshape(matrices, BLOCK, WIDTH)):
            out[m][r.block * BLOCK : (r.block + 1) * BLOCK] = data
    return out


def _count_words(batches):
    """(word hash, count), added up over some million tokens at a time."""
    held, waiting = [], 0

    def out():
        words, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], names=["word", "n"])

    for part in slices(batches, 0):
        words, _ = tokens_of(part.column(0).to_pylist())
        held.append(words)
        waiting += len(words)
        if waiting > 1 << 22:
            yield out()
            held, waiting = [], 0
    if held:
        yield out()


def _frequent(words: DataFrame, most: int) -> pd.DataFrame:
    """The words (word, n) said oftener than some number of times, chosen so that they are at most `most`."""
    grade = F.when(F.col("n") < 1024, F.col("n")).otherwise(1024 + F.floor(F.log2("n") * 64))
    graded = words.withColumn("grade", grade.cast("long"))
    found, above = 0, 0
    for r in graded.groupBy("grade").count().orderBy(F.desc("grade")).collect():  # some thousand grades at most
        found += r["count"]
        if found > most:
            above = r.grade
            break
    return graded.where(F.col("grade") > above).select("word", "n").toPandas().sort_values(["n", "word"], ascending=[False, True])


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, folds: int = 7, held: int = 2, frequent: int = 1 << 16, rounds: int = 3, rate: float = 0.5, calm: float = 3.0) -> DataFrame:
    """One row for each row of docs: id_col, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are [^\\x20\\x09-\\x0D]+ of the whole text with A-Z lower-cased, and one end token; a null text has the end token
    alone. All rows outside the held-out fold train, a null id among them, and repeated rows as often as they occur: counts
    come from all of them, and each takes part in the gradient of every round. base_score adds log10((c+1)/(N+V+1)); score is the
    model's log10 probability, words of a leaf having their counts' share of it, and all unknown ones of an ending one count.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(fold_of(id_col, folds) == held, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    train = base.where("not held_out")
    words = table(train.select("text").mapInArrow(_count_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    top = _frequent(words, frequent)
    sums = np.zeros((2, ENDINGS))
    for r in words.groupBy(F.col("word").bitwiseAND(ENDINGS - 1).alias("ending")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        sums[:, r.ending] += (r.n, r.v)
    tokens, kinds = int(sums[0].sum()), int(sums[1].sum())
    np.subtract.at(sums, (slice(None), top.word.to_numpy(np.int64) & (ENDINGS - 1)), np.stack([top.n.to_numpy(float), np.ones(len(top))]))
    rest = sums.sum(0) + 1
    tree = Tree(np.append(top.n.to_numpy(float), rest))
    setup = sc.broadcast((Leaves(top.word.to_numpy(np.int64).view(np.uint64), top.n.to_numpy(float)), tree))
    # a message has the size of the weights, so one stands for three input partitions; but each core has one
    tasks = max(sc.defaultParallelism, train.rdd.getNumPartitions() // 3)
    weights, seen = np.zeros((ROWS, WIDTH), np.float32), None
    for _ in range(rounds if tokens else 0):
        shared = sc.broadcast(weights)

        def gradient(batches, shared=shared, first=seen is None):
            (known, tree), w = setup.value, shared.value.copy()  # numpy's own memory has large pages
            sums = [np.zeros((ROWS, WIDTH), np.float32) for _ in range(1 + first)]
            total, waiting, mark = [], 0, np.zeros(ROWS, np.int32)
            for part in slices(batches, 0, 6 * TOKENS):
                hashes, lengths = tokens_of(part.column(0).to_pylist())
                leaves, features = known.find(hashes)[0], contexts(hashes, lengths)
                for node, rows, number, taken in groups(tree, leaves, features):
                    p, s = exponentials(w, tree.bias, node, rows)
                    p *= (number / s).astype(np.float32)[:, None]
                    for r in rows:
                        add_rows(sums[0], r, p, mark)
                        if first:
                            np.add.at(sums[1].reshape(-1), np.repeat(r * WIDTH, number) + taken, np.float32(1))
                    waiting += len(taken)
                    if waiting > 1 << 23:  # below that float32 counts exactly
                        total = total or [np.zeros((ROWS, WIDTH)) for _ in sums]
                        for t, x in zip(total, sums):
                            t += x
                            x[:] = 0
                        waiting = 0
            for t, x in zip(total, sums):
                t += x
                x[:] = t
            yield _blocks(sums)

        given, *counted = _summed(train.select("text").coalesce(tasks).mapInArrow(gradient, "block int, data binary"), 1 if seen is not None else 2, tasks)
        seen = counted[0] if counted else seen  # what the documents show is the same in every round
        shared.destroy()
        # the gradient of the log likelihood, seen - given, divided by the logarithmic mean of the two
        weights = np.clip(weights + rate * np.log((seen + calm) / (given + calm)), -8, 8)
    model = sc.broadcast(weights)
    within = np.append(np.zeros(len(top)), np.log10(rest))

    def score(batches):
        (known, tree), w = setup.value, model.value.copy()
        for part in slices(batches, 2):
            hashes, lengths = tokens_of(part.column(2).to_pylist())
            leaves, common = known.find(hashes)
            features, gain = contexts(hashes, lengths), np.zeros(len(leaves))
            for at in range(0, len(leaves), TILE):
                for on, node, taken in tree.steps(leaves[at : at + TILE]):
                    p, s = exponentials(w, tree.bias, node, [rows_of(f[at : at + TILE][on], node, i) for i, f in enumerate(features)])
                    gain[at + on] += np.log(np.take(p, np.arange(0, p.size, WIDTH) + taken) / s)
            gain = gain / math.log(10) - within[leaves]
            starts = np.cumsum(lengths) - lengths
            rare = ~common
            logs = np.zeros(len(leaves))
            logs[common] = known.logs[leaves[common]]
            bounds = np.append(0, np.cumsum(np.add.reduceat(rare.astype(np.int64), starts))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0), part.column(1), pa.array(lengths), pa.array(np.add.reduceat(common.astype(np.int64), starts)),
                    pa.array(np.add.reduceat(logs, starts)), pa.array(np.add.reduceat(gain, starts)),
                    pa.ListArray.from_arrays(pa.array(bounds), pa.array(hashes[rare].view(np.int64))),
                ],
                names=["id", "held_out", "n_tokens", "known", "logs", "gain", "rare"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    scored = base.mapInArrow(score, f"id {kind}, held_out boolean, n_tokens long, known long, logs double, gain double, rare array<long>")
    scored = table(scored.withColumn("rid", F.monotonically_increasing_id()), "scored")
    model.destroy()
    setup.destroy()
    # each document's rare words with their counts, added up per document
    others = scored.select("rid", F.explode("rare").alias("word")).join(words.select("word", "n"), "word")
    others = others.groupBy("rid").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("n") + 1)).alias("more_logs"))
    more_logs = F.coalesce("more_logs", F.lit(0.0))
    return scored.drop("rare").join(others, "rid", "left").select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + more_logs - F.col("n_tokens") * float(np.log10(tokens + kinds + 1))).alias("base_score"), (F.col("gain") + more_logs).alias("score"),
    )
