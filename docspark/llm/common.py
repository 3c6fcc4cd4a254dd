"""Helpers that the training-data operators share: shared-folder tables, bounded filters, components, batches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_CLASS = r"[^\x20\x09-\x0D]+"

_own_dir: tempfile.TemporaryDirectory | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir); a temporary one only in local mode where that is unset.

    On a cluster without the setting this raises, for executors' own folders are not seen by each other. Tables stay there as long
    as DataFrames built on them may be read; the application's folder can be swept when it has ended.
    """
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not re.fullmatch(r"local(\[[0-9*,]+\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = tempfile.TemporaryDirectory(prefix="docspark-")
    return f"file://{_own_dir.name}"


def table(df: DataFrame, name: str) -> DataFrame:
    """df, written once as Parquet in the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/docspark-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(name: str, taken: Iterable[str]) -> str:
    """A column name that differs from all of taken, whatever their case."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def fold_of(id_col: str, folds: int):
    """crc32 of the id as text, modulo folds; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def slices(batches: Iterable[pa.RecordBatch], column: int, max_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that one string column holds about max_bytes at most (a longer text comes alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        step = max(1, int(batch.num_rows * max_bytes // max(1, batch.column(column).nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def append_columns(df: DataFrame, text_col: str, fn, fields: str) -> DataFrame:
    """df with further columns that fn(texts) computes for each batch; the other columns pass through as Arrow data.

    fn takes a list of texts (None for null) and returns one list or array for each of the fields ("name type, ...").
    """
    from pyspark.sql.types import StructType, _parse_datatype_string

    more = _parse_datatype_string(fields)
    at = df.columns.index(text_col)
    kinds = [{"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}[f.dataType.simpleString()] for f in more]
    names = df.columns + [f.name for f in more]

    def run(batches):
        for part in slices(batches, at):
            got = fn(part.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(g, type=k) for g, k in zip(got, kinds, strict=True))], names=names)

    return df.mapInArrow(run, StructType([*df.schema.fields, *more.fields]))


def bitmap_filter(keys: DataFrame, bits: int = 23) -> DataFrame:
    """A hashed bitmap over the distinct values of keys' column "key" (long), as (word, mask) rows.

    At most 2**(bits-6) rows whatever the number of keys, so it may be broadcast. No key is missed; others pass with a
    probability that grows with the number of keys.
    """
    h = F.xxhash64("key")
    return (
        keys.select(F.pmod(F.shiftright(h, 6), F.lit(1 << (bits - 6))).alias("word"), F.expr("shiftleft(1L, cast(pmod(xxhash64(key), 64) as int))").alias("bit"))
        .groupBy("word")
        .agg(F.bit_or("bit").alias("mask"))
    )


def may_contain(df: DataFrame, key: str, words: DataFrame, flag: str, bits: int = 23) -> DataFrame:
    """df with the boolean column flag: false only where key is surely not among the keys that words was built of."""
    w = words.select(F.col("word").alias("_word"), F.col("mask").alias("_mask"))
    joined = df.join(F.broadcast(w), F.pmod(F.shiftright(F.xxhash64(key), 6), F.lit(1 << (bits - 6))) == F.col("_word"), "left")
    return joined.withColumn(flag, F.coalesce(F.expr(f"(shiftright(_mask, cast(pmod(xxhash64({key}), 64) as int)) & 1) = 1"), F.lit(False))).drop("_word", "_mask")


def hot_values(df: DataFrame, on: str) -> DataFrame:
    """The values of the column that have more than an eighth of a shuffle partition's share of the rows.

    They are at most eight times as many as there are shuffle partitions, whatever the size of df, so they may be broadcast.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = df.count()
    return table(df.where(F.col(on).isNotNull()).groupBy(on).count().where(F.col("count") * (8 * parts) > n).select(on), "hot")


def lookup(df: DataFrame, right: DataFrame, on: str, hot: DataFrame | None = None) -> DataFrame:
    """df left-joined with right, whose values of `on` are unique. Hot values of df meet their row of right in a broadcast join, so
    that no task gets all rows of one value; the others are shuffled. df should be a table, for it is read twice.
    """
    hot = hot_values(df, on) if hot is None else hot
    few = F.broadcast(hot.join(right, on))
    often = df.join(F.broadcast(hot), on, "left_semi").join(few, on, "left")
    return df.join(F.broadcast(hot), on, "left_anti").join(right, on, "left").unionByName(often)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of the edges (a, b): rows (v, component), component being the smallest vertex reached.

    Each round takes the smallest label of the neighbours and then the label's own label, so a path of n vertices needs
    about log n rounds. Every round is a shuffle of labels with partial aggregation; vertices with very many edges and labels of
    very many vertices are looked up by broadcast. Nothing comes to the driver but counts.
    """
    both = table(edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = table(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("component")), "labels")
    hubs = hot_values(both, "b")
    for _ in range(rounds):
        near = lookup(both, labels.withColumnRenamed("v", "b"), "b", hubs).groupBy("a").agg(F.min("component").alias("m"))
        near = table(labels.join(near, labels.v == near.a).select("v", F.col("component").alias("old"), F.least("component", "m").alias("l")), "near")
        up = labels.select(F.col("v").alias("l"), F.col("component").alias("ul"))
        moved = table(lookup(near, up, "l").select("v", "old", F.coalesce(F.least("l", "ul"), "l").alias("component")), "labels")
        changed = moved.where("component < old").limit(1).count()
        labels = moved.select("v", "component")
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")
