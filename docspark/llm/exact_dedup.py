"""Exact duplicates by an exchange of Golomb-coded fingerprints.

Each input partition sends its sorted distinct fingerprints, Golomb-coded by owner range. An owner decodes what all
partitions sent and answers each with a bitmap of the fingerprints that others sent too. Only rows of such fingerprints
(suspects) are shuffled, and their texts are compared byte for byte.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import bitmap_filter, may_contain, table

FINGERPRINT_BITS = 60


def golomb_encode(values: np.ndarray, m: int) -> bytes:
    """Sorted distinct non-negative integers as gaps in Golomb code with parameter m: quotients in unary, remainders in fixed width."""
    gaps = np.diff(values.astype(np.int64), prepend=np.int64(0))
    q, r = gaps // m, gaps % m
    unary = np.ones(int(q.sum()) + len(q), np.uint8)
    unary[np.cumsum(q + 1) - 1] = 0
    width = max(1, int(m - 1).bit_length())
    rest = ((r[:, None] >> np.arange(width - 1, -1, -1)) & 1).astype(np.uint8)
    return np.packbits(unary).tobytes() + np.packbits(rest).tobytes()


def golomb_decode(blob: bytes, n: int, m: int) -> np.ndarray:
    """The integers that golomb_encode was given."""
    if not n:
        return np.zeros(0, np.int64)
    bits = np.unpackbits(np.frombuffer(blob, np.uint8))
    ends = np.flatnonzero(bits == 0)[:n]
    q = np.diff(ends, prepend=-1) - 1
    width = max(1, int(m - 1).bit_length())
    start = 8 * -(-(int(ends[-1]) + 1) // 8)
    rest = bits[start : start + n * width].reshape(n, width)
    r = rest.astype(np.int64) @ (1 << np.arange(width - 1, -1, -1, dtype=np.int64))
    return np.cumsum(q * m + r)


def duplicate_fingerprints(fps: DataFrame, owners: int) -> DataFrame:
    """The values of column fp (long, 0 to 2**60) that occur in more than one row, as column key.

    Rows of the exchange: a message for each partition and owner, a bitmap back for each message with a duplicate.
    """
    span = -(-(1 << FINGERPRINT_BITS) // owners)

    def send(batches):
        got = [np.asarray(b.column(0)) for b in batches]
        values, counts = np.unique(np.concatenate(got) if got else np.zeros(0, np.int64), return_counts=True)
        cuts = np.searchsorted(values, np.arange(owners + 1, dtype=np.int64) * span)
        rows = []
        for o in range(owners):
            mine, n = values[cuts[o] : cuts[o + 1]] - o * span, int(cuts[o + 1] - cuts[o])
            if n:
                m = max(1, round(0.69 * span / n))
                rows.append((TaskContext.get().partitionId(), o, n, m, golomb_encode(mine, m), np.packbits(counts[cuts[o] : cuts[o + 1]] > 1).tobytes()))
        names = ["part", "owner", "n", "m", "gaps", "twice"]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    # as many senders as owners at most, so that a message stays worth its header however many partitions there are
    senders = max(owners, fps.sparkSession.sparkContext.defaultParallelism)
    sent = table(fps.select("fp").coalesce(senders).mapInArrow(send, "part int, owner int, n int, m long, gaps binary, twice binary"), "fingerprints")

    def answer(group: pd.DataFrame) -> pd.DataFrame:
        lists = [golomb_decode(g, n, m) for g, n, m in zip(group.gaps, group.n, group.m)]
        values, counts = np.unique(np.concatenate(lists), return_counts=True)
        rows = []
        for part, owner, n, own, twice in zip(group.part, group.owner, group.n, lists, group.twice):
            flags = (counts[np.searchsorted(values, own)] > 1) | np.unpackbits(np.frombuffer(twice, np.uint8))[:n].astype(bool)
            if flags.any():
                rows.append((part, owner, np.packbits(flags).tobytes()))
        return pd.DataFrame(rows, columns=["part", "owner", "bitmap"])

    answers = sent.groupBy("owner").applyInPandas(answer, "part int, owner int, bitmap binary")

    def expand(batches):
        for b in batches:
            for o, n, m, gaps, bitmap in zip(*(b.column(i).to_pylist() for i in range(5))):
                own = golomb_decode(gaps, n, m)[np.unpackbits(np.frombuffer(bitmap, np.uint8))[:n].astype(bool)]
                yield pa.RecordBatch.from_arrays([pa.array(own + o * span, pa.int64())], names=["key"])

    return sent.join(answers, ["part", "owner"]).select("owner", "n", "m", "gaps", "bitmap").mapInArrow(expand, "key long").distinct()


def _marked(docs: DataFrame, id_col: str, text_col: str, per_owner: int, bitmap: int, normalise):
    """docs as row, id, body, fp, suspect: false only where no other row has the fingerprint.

    Suspects are told by a bitmap of eight bits or more a duplicated fingerprint; beyond `bitmap` of these, by a join on them.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    text = normalise(text) if normalise else text
    keyed = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), text.alias("body"))
    keyed = keyed.withColumn("fp", F.expr(f"xxhash64(body) & {(1 << FINGERPRINT_BITS) - 1}L"))
    twice = table(duplicate_fingerprints(keyed, max(8, -(-docs.count() // per_owner))), "suspects")
    n = twice.count()
    if n > bitmap:
        return keyed.join(twice.withColumnRenamed("key", "fp").withColumn("suspect", F.lit(True)), "fp", "left").withColumn("suspect", F.coalesce("suspect", F.lit(False)))
    bits = max(20, (8 * n).bit_length())
    return may_contain(keyed, "fp", table(bitmap_filter(twice, bits), "suspect-bits"), "suspect", bits)


def _groups(suspects: DataFrame):
    """Suspect rows with a row key and digest, and the groups of equal texts among them, by digest.

    Texts are compared whole, as grouping keys; the written groups carry the digest alone, so a large group of copies meets
    its one row in a join that Spark can split.
    """
    suspects = table(suspects.withColumn("rid", F.monotonically_increasing_id()).withColumn("sha", F.sha2("body", 256)), "suspect-rows")
    best = F.max(F.struct(F.col("id"), F.col("rid")))
    return suspects, table(suspects.groupBy("body").agg(best.alias("best"), F.count("*").alias("size"), F.first("sha").alias("sha")).drop("body"), "copies")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, per_owner: int = 4_000_000, bitmap: int = 1 << 23, normalise=None) -> DataFrame:
    """One row for each row of docs: id_col, keep_id, group_size, kept, text_sha256.

    Of rows with equal (normalised) texts the one with the largest id is kept; a null text counts as empty, a null id is
    the smallest, and of fully repeated rows exactly one is kept. Other columns of docs are not looked at. An empty table
    gives an empty table. normalise: Column -> Column, none by default.
    """
    marked = _marked(docs.select(id_col, text_col), id_col, text_col, per_owner, bitmap, normalise).drop("row")
    single = marked.where("not suspect").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.sha2("body", 256).alias("text_sha256"))
    suspects, groups = _groups(marked.where("suspect").select("id", "body"))
    several = suspects.select("id", "rid", "sha").join(groups, "sha").select("id", F.col("best.id").alias("keep_id"), F.col("size").alias("group_size"), (F.col("best.rid") == F.col("rid")).alias("kept"), F.col("sha").alias("text_sha256"))
    return single.union(several).withColumnRenamed("id", id_col)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, per_owner: int = 4_000_000, bitmap: int = 1 << 23, normalise=None) -> DataFrame:
    """docs, all columns, without the rows that exact_dedup would not keep."""
    marked = _marked(docs, id_col, text_col, per_owner, bitmap, normalise)
    suspects, groups = _groups(marked.where("suspect").select("row", "id", "body"))
    best = groups.select(F.col("best.rid").alias("rid"))
    return marked.where("not suspect").select("row.*").union(suspects.join(best, "rid", "left_semi").select("row.*"))
