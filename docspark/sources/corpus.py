"""Reading and writing corpora."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def scan_corpus(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """A corpus table; with a schema nothing is inferred."""
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def export_text_sink(texts: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Write without overwriting: an existing path is an error."""
    texts.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)


def binary_inventory(spark: SparkSession, path: str, block: int = 1 << 20) -> DataFrame:
    """Distinct files below path by content: sha256, length, first bytes, number of copies.

    Files of a file system that all machines mount (file:) are read a block at a time, whatever their size. Those of other stores
    come through Spark's reader, each whole as one row.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)

    def digests(batches):
        for batch in batches:
            rows = []
            for name in batch.column("path").to_pylist():
                with open(name.removeprefix("file:"), "rb") as f:
                    part, length, digest = f.read(max(block, 8)), 0, hashlib.sha256()
                    magic = part[:8].hex().upper()
                    while part:
                        digest.update(part)
                        length += len(part)
                        part = f.read(block)
                rows.append((digest.hexdigest(), length, magic))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.string()))] if rows else [pa.array([], t) for t in (pa.string(), pa.int64(), pa.string())], names=["sha256", "length", "magic"])

    some = files.select("path").first()  # names alone: no content is read; all files below a path lie in one store
    if some and some.path.startswith("file:"):
        each = files.select("path").mapInArrow(digests, "sha256 string, length long, magic string")
    else:
        each = files.select(F.sha2("content", 256).alias("sha256"), "length", F.hex(F.substring("content", 1, 8)).alias("magic"))
    return each.groupBy("sha256").agg(F.first("length").alias("length"), F.first("magic").alias("magic"), F.count("*").alias("copies"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares (spark.checkpoint.dir); in a temporary one only in local mode where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='docspark-')}"
    return f"{named.rstrip('/')}/docspark-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
