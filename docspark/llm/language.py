"""Language identification by multinomial naive Bayes over hashed character n-grams.

Training counts the hashed n-grams of every training document for each language; the log-probabilities form one matrix of
fixed size, which is broadcast. Scoring adds up the matrix rows of a text's n-grams in numpy, batch by batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import append_columns, fold_of, slices

BUCKETS, ORDERS = 1 << 15, (1, 2, 3)
MIX = np.uint32(0x9E3779B1)


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of the lower-cased texts' character 1- to 3-grams, and the text of each; none reaches over a text's end."""
    low = [(t or "").lower() for t in texts]
    chars = np.frombuffer("\0".join([*low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t) + 1 for t in low], np.int64)
    owner = np.repeat(np.arange(len(low)), sizes)
    owner[np.cumsum(sizes) - 1] = -1  # the separators; a text may hold their character itself
    buckets, owners = [], []
    for n in ORDERS:
        if len(chars) < n:
            continue
        h = np.full(len(chars) - n + 1, n, np.uint32)
        for k in range(n):
            c = chars[k : len(chars) - n + 1 + k]
            h = (h ^ c) * MIX
            h ^= h >> np.uint32(15)
        whole = (owner[: len(h)] == owner[n - 1 :]) & (owner[: len(h)] >= 0)
        buckets.append((h[whole] % np.uint32(BUCKETS)).astype(np.int64))
        owners.append(owner[: len(h)][whole])
    b, o = np.concatenate(buckets), np.concatenate(owners)
    order = np.argsort(o, kind="stable")
    return b[order], o[order]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, folds: int = 3, held: int = 1, group: int = 256, smooth: float = 0.5) -> tuple[list[str], np.ndarray]:
    """(languages, log-probability matrix [BUCKETS + 1, languages]; the last row holds the priors).

    Learns from all rows outside the held-out fold with a text and a language; repeated rows count as often as they occur. The
    counts of `group` languages at a time are added up in each task. Without any training row there are no languages and all
    predictions are und.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where("text is not null and lang is not null").where(F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % folds != held, F.lit(True))).select("text", "lang")
    counted = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs, parts = sorted(counted), [np.zeros((BUCKETS, 0), np.float32)]
    for at in range(0, len(langs), group):
        some = langs[at : at + group]
        mine = rows if len(langs) <= group else rows.where(F.col("lang").between(some[0], some[-1]))
        cells = _counted(mine, some) + smooth
        parts.append(np.log(cells / cells.sum(0)).astype(np.float32))
    prior = np.array([counted[x] for x in langs], float)
    return langs, np.vstack([np.hstack(parts), np.log(prior / max(1, prior.sum()))]).astype(np.float32)


def _counted(rows: DataFrame, langs: list[str]) -> np.ndarray:
    """Counts of hashed n-grams by bucket and language."""
    number, width = {x: k for k, x in enumerate(langs)}, len(langs)

    def count(batches):
        total = np.zeros(BUCKETS * width, np.int64)
        for part in slices(batches, 0):
            b, o = grams(part.column(0).to_pylist())
            lang = np.array([number[x] for x in part.column(1).to_pylist()])
            total += np.bincount(b * width + lang[o], minlength=BUCKETS * width)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["cell", "n"])

    got = rows.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    cells = np.zeros(BUCKETS * width)
    cells[got.cell.to_numpy(int)] = got.n.to_numpy()
    return cells.reshape(BUCKETS, width)


def _posterior(model: tuple[list[str], np.ndarray], sharp: float):
    """Of each text the best language, its whole log score, its log score with bounded evidence, and the log sum of the latter over all languages."""

    def run(texts):
        langs, matrix = model.value
        b, o = grams(texts)
        sums, counts = np.zeros((len(texts), len(langs))), np.bincount(o, minlength=len(texts))
        if len(b):
            first = np.flatnonzero(np.append(True, o[1:] != o[:-1]))
            sums[o[first]] = np.add.reduceat(matrix[b], first, axis=0, dtype=np.float64)
        soft, whole = sums * np.minimum(1, sharp / np.maximum(1, counts))[:, None] + matrix[-1], sums + matrix[-1]
        best, top, row = whole.argmax(1), soft.max(1), np.arange(len(texts))
        return [langs[k] for k in best.tolist()], whole[row, best], soft[row, best], top + np.log(np.exp(soft - top[:, None]).sum(1))

    return run


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text", *, folds: int = 3, held: int = 1, sharp: float = 30.0, group: int = 256) -> DataFrame:
    """One row for each row of docs: id_col, held_out, lang_pred, score.

    score is the posterior of the predicted language with the evidence of at most `sharp` n-grams' worth, so that long texts do
    not all score 1. A null text or one without a letter (Unicode category L) is und with score 0; equal scores go to the first
    language. Repeated rows and ids give repeated results. The matrix is broadcast for `group` languages at a time.
    """
    langs, matrix = model
    sc = docs.sparkSession.sparkContext
    known = F.coalesce(F.col("text__").rlike(r"\p{L}"), F.lit(False))
    scored = docs.select(F.col(id_col).alias("id__"), F.coalesce(fold_of(id_col, folds) == held, F.lit(False)).alias("held_out"), F.col(text_col).alias("text__"))
    each = []
    for k, at in enumerate(range(0, len(langs), group)):
        part = sc.broadcast((langs[at : at + group], np.ascontiguousarray(matrix[:, at : at + group])))
        scored = append_columns(scored, "text__", _posterior(part, sharp), f"lang{k} string, whole{k} double, soft{k} double, all{k} double")
        each.append(F.struct(F.col(f"whole{k}").alias("whole"), F.lit(-k).alias("order"), F.col(f"lang{k}").alias("lang"), F.col(f"soft{k}").alias("soft")))
    id_ = F.col("id__").alias(id_col)
    if not each:
        return scored.select(id_, "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    best = F.array_max(F.array(*each))
    share = 1 / sum((F.exp(F.col(f"all{k}") - best["soft"]) for k in range(len(each))), F.lit(0.0))
    return scored.select(id_, "held_out", F.when(known, best["lang"]).otherwise("und").alias("lang_pred"), F.when(known, F.least(share, F.lit(1.0))).otherwise(0.0).alias("score"))
