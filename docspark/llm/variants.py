"""Spelling variants: words one inserted, deleted or replaced character apart, grouped under their commonest form.

Words lie in a trie of frequency vectors: a level for the length, then one for how many letters of each of sixteen letter groups a
word has. A word one edit away differs by a surplus of at most one in one group and a deficit of at most one in another; a
search goes down depth first, spends that budget at each level, and compares letters only at the leaves it reaches. Surplus and
deficit both: a replacement; a surplus alone: the searching word has one letter more. So the longer word finds the shorter one, and
of two words of one length the one whose surplus lies in the earlier group finds the other.

On Spark the first levels are columns: a word goes to the nodes of these levels that its budget reaches, if they exist, and every node
holds the trie of the further levels. The number of such levels follows from the vocabulary, so that nodes stay small; a node
that is still large is cut into chunks, each of which meets every chunk of the words searching in it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import slices, table

GROUPS = 16
LETTERS = [*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]
RUNS = re.compile("[a-zÀ-ÿ]+")
CELLS = 1 << 20


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, least_letters: int = 5, least: int = 3, typo_every: int | None = None) -> DataFrame:
    """word, n: the runs of A-Z, a-z and U+00C0 to U+00FF of all texts, A-Z lowered, of so many letters and occurrences at least.

    typo_every: a run whose crc32 of "id:run" this number divides loses its letter at crc32 % length, in all its occurrences in that
    row; lengths and occurrences are those after that. Null text: no words; null id: an empty one. Repeated rows count each time.
    """

    def run(batches):
        sums: dict[str, int] = {}

        def flushed():
            words = list(sums)
            for at in range(0, len(words), 1 << 16):
                part = words[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([sums[w] for w in part], pa.int64())], names=["word", "n"])

        for part in slices(batches, 1):
            for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                seed = crc32(f"{key}:".encode()) if typo_every else 0
                for w, n in Counter(RUNS.findall(text.lower().decode("utf-8", "replace"))).items():
                    if typo_every and (h := crc32(w.encode(), seed)) % typo_every == 0:
                        w = w[: h % len(w)] + w[h % len(w) + 1 :]
                    if len(w) >= least_letters:
                        sums[w] = sums.get(w, 0) + n
            if len(sums) > 500_000:
                yield from flushed()
                sums = {}
        yield from flushed()

    texts = docs.where(F.col(text_col).isNotNull()).select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _matrix(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), length)


def _vectors(letters: np.ndarray) -> np.ndarray:
    """How many letters of each group each word has."""
    return np.stack([(letters % GROUPS == g).sum(1, dtype=np.int32) for g in range(GROUPS)], 1)


def _descend(nodes: np.ndarray, searching: np.ndarray, surplus: int, deficit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Depth first through the trie of the vectors `nodes` (sorted): pairs (places in searching, places in nodes) at the leaves.

    A node is a range of the sorted vectors at a level; the searching words that still have the budget go down together.
    """
    every = np.arange(len(searching))
    stack = [(0, len(nodes), 0, every, np.full(len(every), surplus), np.full(len(every), deficit))]
    while stack:
        lo, hi, level, alive, more, less = stack.pop()
        if level == GROUPS or len(alive) * (hi - lo) <= 256:
            yield np.repeat(alive, hi - lo), np.tile(np.arange(lo, hi), len(alive))
            continue
        counts, own = nodes[lo:hi, level], searching[alive, level]
        edges = [0, *(np.flatnonzero(np.diff(counts)) + 1).tolist(), hi - lo]
        for a, b in zip(edges, edges[1:]):
            off = own - counts[a]
            on = (off <= more) & (-off <= less)
            if on.any():
                stack.append((lo + a, lo + b, level + 1, alive[on], (more - np.maximum(off, 0))[on], (less + np.minimum(off, 0))[on]))


def _one_apart(long: np.ndarray, short: np.ndarray) -> np.ndarray:
    """Which rows are one edit apart: letters of equally long words, or of words of which the first are one letter longer."""
    n = short.shape[1]
    if long.shape[1] == n:
        return (long != short).sum(1) == 1
    head = np.logical_and.accumulate(long[:, :n] == short, 1).sum(1)
    tail = np.logical_and.accumulate((long[:, 1:] == short)[:, ::-1], 1).sum(1)
    return head + tail >= n


def _near_in_node(group: pa.Table) -> pa.Table:
    """Pairs of a chunk of a node's words and a chunk of those searching there: word, n, near, near_n, each way round."""
    here, inner = group["searching"].to_numpy(), group["inner"].to_numpy()
    words, counts = group["word"].to_pylist(), group["n"].to_numpy()
    own = np.flatnonzero(~here)
    out: list[tuple] = []
    if len(own):
        length = len(words[own[0]])
        letters = _matrix([words[i] for i in own], length)
        vectors = _vectors(letters)
        order = np.lexsort(vectors.T[::-1])
        own, letters, vectors = own[order], letters[order], vectors[order]
        lengths = np.array([len(w) for w in words])
        for longer in (0, 1):
            asking = np.flatnonzero(here & (lengths == length + longer))
            if not len(asking):
                continue
            theirs = _matrix([words[i] for i in asking], length + longer)
            for q, w in _descend(vectors, _vectors(theirs), 1, 1 - longer):
                step = max(1, (4 << 20) // length)
                for at in range(0, len(q), step):
                    qi, wi = q[at : at + step], w[at : at + step]
                    near = _one_apart(theirs[qi], letters[wi])
                    for i, j in zip(asking[qi[near]].tolist(), own[wi[near]].tolist()):
                        if longer or not inner[i] or words[i] < words[j]:  # in one node both find each other
                            out += [(words[i], counts[i], words[j], counts[j]), (words[j], counts[j], words[i], counts[i])]
    columns = list(zip(*out)) or [[]] * 4
    return pa.table([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.int64())], names=["word", "n", "near", "near_n"])


def _node(length, counts: list):
    return F.concat_ws(",", length, *counts)


def _levels(levels: int) -> list:
    """How many letters of each of the first groups the column word has."""
    letters = ["".join(chr(c) for c in LETTERS if c % GROUPS == g) for g in range(levels)]
    return [F.length("word") - F.length(F.translate("word", one, "")) for one in letters]


def near_words(words: DataFrame, *, cells: int = CELLS) -> DataFrame:
    """word, n, near, near_n: all pairs of words (unique; word, n) that one edit separates, each way round.

    Words hold a-z and U+00C0 to U+00FF only. cells bounds the letters that a task compares at a time on either side.
    """
    words = words.select("word", "n")
    for levels in (0, 2, 4, 6, 8):
        vocabulary = words.select("word", "n", F.length("word").alias("len"), F.array(*_levels(levels) or [F.lit(0)]).alias("v"))
        at = [F.get("v", F.lit(i)) for i in range(levels)]
        nodes = vocabulary.groupBy(_node(F.col("len"), at).alias("node")).agg(F.sum("len").alias("letters"))
        if (nodes.agg(F.max("letters")).first()[0] or 0) <= cells:
            break
    rest = F.col("len") - sum(at, F.lit(0))
    moved = lambda i, j: [c - int(k == i) + int(k == j) for k, c in enumerate(at)]
    same = [(F.lit(True), F.col("len"), at, True)]
    swaps = [(at[i] > 0, F.col("len"), moved(i, j), False) for i in range(levels) for j in range(i + 1, levels + 1)]
    drops = [(at[i] > 0, F.col("len") - 1, moved(i, None), False) for i in range(levels)] + [(rest > 0, F.col("len") - 1, at, False)]
    targets = F.array_compact(F.array(*[F.when(may, F.struct(_node(n, c).alias("node"), F.lit(inner).alias("inner"))) for may, n, c, inner in same + swaps + drops]))
    nodes = table(nodes, "nodes")
    asking = vocabulary.select("word", "n", F.explode(targets).alias("t")).select("t.node", "t.inner", "word", "n").join(nodes.select("node"), "node", "left_semi")
    asking = table(asking, "asking")
    sizes = asking.groupBy("node").agg(F.sum(F.length("word")).alias("asked")).join(nodes, "node")
    parts = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / cells)).cast("int")
    sizes = table(sizes.select("node", parts("letters").alias("own_parts"), parts("asked").alias("ask_parts")), "sizes")
    part_of = lambda n: F.pmod(F.xxhash64("word"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    searching = asking.join(sizes, "node").withColumn("ask", part_of("ask_parts")).select("node", every("own_parts").alias("own"), "ask", "word", "n", F.lit(True).alias("searching"), "inner")
    stored = vocabulary.select(_node(F.col("len"), at).alias("node"), "word", "n").join(sizes, "node").withColumn("own", part_of("own_parts"))
    stored = stored.select("node", "own", every("ask_parts").alias("ask"), "word", "n", F.lit(False).alias("searching"), F.lit(False).alias("inner"))
    return searching.unionByName(stored).groupBy("node", "own", "ask").applyInArrow(_near_in_node, "word string, n long, near string, near_n long")


def spelling_variants(words: DataFrame, *, ratio: int = 2, cells: int = CELLS) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word (unique; word, n).

    form: the near word (one inserted, deleted or replaced character away) of largest n, of equal ones the first in code-point
    order, if that n is at least ratio times the word's own; else null, as form_n. root: the end of the chain of forms, the word
    itself where it has none. Counts grow along a chain, so it ends; chains are followed by doubling, in about log log n rounds.
    """
    words = table(words.select("word", "n"), "words")
    near = near_words(words, cells=cells).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    formed = F.when(-F.col("best.less") >= F.col("n") * ratio, F.struct(F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n"))).alias("f")
    known = table(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), formed).select("word", "n", "n_near", "f.form", "f.form_n"), "forms")
    ends = known.where("form is not null").select("word", F.col("form").alias("end"))
    while True:
        on = ends.select(F.col("word").alias("end"), F.col("end").alias("further"))
        moved = table(ends.join(on, "end", "left").select("word", F.coalesce("further", "end").alias("end"), F.col("further").isNotNull().alias("moved")), "ends")
        ends = moved.select("word", "end")
        if moved.where("moved").isEmpty():
            break
    return known.join(ends, "word", "left").select("word", "form", F.coalesce("end", "word").alias("root"), "n", "n_near", "form_n")
