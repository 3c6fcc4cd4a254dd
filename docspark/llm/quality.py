"""Document quality by a byte-level convolutional network in numpy.

Learned filters slide over overlapping chunks that cover the whole text. Each chunk is max-pooled, the chunks' maxima are
combined (mean, largest, smallest) and a small dense head gives one probability. Training uses a bounded sample of labelled
rows; scoring broadcasts the weights (a few tens of kB) and reads every byte of every text.
"""

from __future__ import annotations

import tempfile
from collections import Counter

import numpy as np
from numpy.lib.stride_tricks import as_strided
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import append_columns, fold_of, table, unused

CHUNK, WIDTH, STEP, EMBED, FILTERS, HIDDEN = 512, 8, 2, 8, 24, 16
ADVANCE = CHUNK - WIDTH
PLACES = (CHUNK - WIDTH) // STEP + 1


def chunks_of(text: str | None) -> np.ndarray:
    """The text's bytes as rows of CHUNK bytes that overlap by WIDTH, zero-padded."""
    raw = (text or "").encode("utf-8", "replace")
    n = max(1, -(-(len(raw) - WIDTH) // ADVANCE))
    flat = np.frombuffer(raw.ljust((n - 1) * ADVANCE + CHUNK, b"\0"), np.uint8)
    return as_strided(flat, (n, CHUNK), (ADVANCE, 1))


def _patches(net: dict, chunks: np.ndarray) -> np.ndarray:
    e = net["embed"][chunks]
    s = e.strides
    return as_strided(e, (len(chunks), PLACES, WIDTH * EMBED), (s[0], s[1] * STEP, s[2])).reshape(len(chunks) * PLACES, WIDTH * EMBED)


def pooled(net: dict, chunks: np.ndarray, tile: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """Each chunk's largest activation of each filter, and where it is."""
    best = np.empty((len(chunks), FILTERS), np.float32)
    where = np.empty((len(chunks), FILTERS), np.int64)
    for at in range(0, len(chunks), tile):
        part = chunks[at : at + tile]
        act = (_patches(net, part) @ net["filters"]).reshape(len(part), PLACES, FILTERS) + net["bias"]
        where[at : at + tile] = act.argmax(1)
        best[at : at + tile] = act.max(1)
    return np.maximum(best, 0), where


def combine(maxima: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Per document: mean, largest and smallest of its chunks' maxima."""
    counts = np.diff(np.append(starts, len(maxima)))[:, None]
    return np.hstack([np.add.reduceat(maxima, starts) / counts, np.maximum.reduceat(maxima, starts), np.minimum.reduceat(maxima, starts)]).astype(np.float32)


def head(net: dict, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = np.tanh(v @ net["w1"] + net["b1"])
    return h, 1 / (1 + np.exp(-np.clip(h @ net["w2"] + net["b2"], -30, 30)))


def fit_network(docs: list[np.ndarray], y: np.ndarray, epochs: int = 14, batch: int = 32, rate: float = 0.004, seed: int = 7, tile: int = 512) -> dict:
    """Adam on the log loss; the pooling passes gradients to each filter's best place only."""
    rng = np.random.default_rng(seed)
    net = {
        "embed": rng.normal(0, 0.5, (256, EMBED)), "filters": rng.normal(0, 0.15, (WIDTH * EMBED, FILTERS)), "bias": np.zeros(FILTERS),
        "w1": rng.normal(0, 0.1, (3 * FILTERS, HIDDEN)), "b1": np.zeros(HIDDEN), "w2": rng.normal(0, 0.3, HIDDEN), "b2": np.zeros(1),
    }
    net = {k: v.astype(np.float32) for k, v in net.items()}
    if not docs:
        return net
    m1, m2, t = {k: np.zeros_like(v) for k, v in net.items()}, {k: np.zeros_like(v) for k, v in net.items()}, 0
    net["b2"][:] = np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
    for epoch in range(epochs):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), batch):
            mine = order[at : at + batch]
            chunks = np.concatenate([docs[i] for i in mine])
            starts = np.cumsum([0] + [len(docs[i]) for i in mine[:-1]])
            best, where = pooled(net, chunks)
            v = combine(best, starts)
            h, p = head(net, v)
            d = ((p - y[mine]) / len(mine)).astype(np.float32)
            g = {"w2": h.T @ d, "b2": np.array([d.sum()])}
            dh = np.outer(d, net["w2"]) * (1 - h * h)
            g |= {"w1": v.T @ dh, "b1": dh.sum(0)}
            dv = dh @ net["w1"].T
            sizes = np.diff(np.append(starts, len(chunks)))
            owner = np.repeat(np.arange(len(mine)), sizes)
            dm = dv[owner, :FILTERS] / sizes[owner][:, None]
            for k in (1, 2):
                hit = best == v[owner, k * FILTERS : (k + 1) * FILTERS]
                dm += dv[owner, k * FILTERS : (k + 1) * FILTERS] * hit / np.maximum(1, np.add.reduceat(hit, starts)[owner])
            dm = dm * (best > 0)
            g |= {"filters": np.zeros_like(net["filters"]), "bias": dm.sum(0), "embed": np.zeros_like(net["embed"])}
            for lo in range(0, len(chunks), tile):
                some, mine_dm = chunks[lo : lo + tile], dm[lo : lo + tile]
                at_bytes = np.take_along_axis(some[:, None, :], (where[lo : lo + tile] * STEP)[:, :, None] + np.arange(WIDTH), 2)
                patch = net["embed"][at_bytes].reshape(len(some), FILTERS, WIDTH * EMBED)
                g["filters"] += np.einsum("cfk,cf->kf", patch, mine_dm)
                back = (mine_dm[:, :, None] * net["filters"].T[None]).reshape(-1, EMBED)
                flat = at_bytes.reshape(-1)
                g["embed"] += np.stack([np.bincount(flat, back[:, j], 256) for j in range(EMBED)], 1)
            t += 1
            for k in net:
                m1[k] = 0.9 * m1[k] + 0.1 * g[k]
                m2[k] = 0.99 * m2[k] + 0.01 * g[k] ** 2
                net[k] = (net[k] - rate * (1 - 0.9 * epoch / epochs) * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)
    return net


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", *, folds: int = 5, held: int = 0, sample: int = 2500) -> dict:
    """The network, learned from at most `sample` labelled rows (the smallest by hash of the id) outside the held-out fold.

    Every chunk of a sampled text teaches; the driver keeps the chunks in a file, not in memory. Rows with a null id, a null label or a label other than 0 and 1 teach nothing; several labels of one
    document count as the smallest. Without any labelled row the scores are constant.
    """
    chosen = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)")
        .where(F.crc32(F.col("id").cast("string").cast("binary")) % folds != held)
        .groupBy("id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample)
    )
    joined = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").select("id", "text", "y")

    def cut(batches):
        import pyarrow as pa

        for b in batches:
            rows = [chunks_of(t).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(rows, pa.binary())], names=["id", "y", "chunks"])

    kind = docs.schema[id_col].dataType.simpleString()
    lesson, places, at = table(joined.mapInArrow(cut, f"id {kind}, y int, chunks binary").withColumn("digest", F.sha2("chunks", 256)), "lesson"), [], 0
    # of repeated ids there may be more rows than ids
    left = Counter((r.id, r.digest) for r in lesson.orderBy(F.xxhash64("id"), "id", "digest").select("id", "digest").limit(sample).collect())
    with tempfile.TemporaryFile() as file:
        for r in lesson.toLocalIterator():
            if not left[r.id, r.digest]:
                continue
            left[r.id, r.digest] -= 1
            file.write(r.chunks)
            places.append((r.id, r.y, r.digest, at, len(r.chunks)))
            at += len(r.chunks)
        file.flush()
        docs = [np.memmap(file, np.uint8, "r", at, (size // CHUNK, CHUNK)) for *_, at, size in sorted(places)]
        return fit_network(docs, np.array([p[1] for p in sorted(places)], np.float32))


def _scorer(net: dict, threshold: float):
    def run(texts):
        rows = [chunks_of(t) for t in texts]
        starts = np.cumsum([0] + [len(r) for r in rows[:-1]])
        best, _ = pooled(net, np.concatenate(rows))
        p = head(net, combine(best, starts))[1].astype(np.float64)
        return p, (p >= threshold).astype(np.int32)

    return run


def classify(docs: DataFrame, net: dict, id_col: str = "doc_id", text_col: str = "text", *, folds: int = 5, held: int = 0, threshold: float = 0.3) -> DataFrame:
    """One row for each row of docs: id_col, held_out, score (0 to 1), predicted. Null and empty texts get the score of no bytes."""
    base = docs.select(F.col(id_col), F.coalesce(fold_of(id_col, folds) == held, F.lit(False)).alias("held_out"), F.col(text_col).alias("text__"))
    return append_columns(base, "text__", _scorer(net, threshold), "score double, predicted int").drop("text__")


def keep_good(docs: DataFrame, net: dict, text_col: str = "text", *, threshold: float = 0.3) -> DataFrame:
    """docs, all columns, without the rows that the network rejects."""
    score, keep = unused("score__", docs.columns), unused("keep__", docs.columns)
    return append_columns(docs, text_col, _scorer(net, threshold), f"`{score}` double, `{keep}` int").where(F.col(keep) == 1).drop(score, keep)
