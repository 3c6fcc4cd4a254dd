"""The library's tables, derived from the given ones: as DataFrames, and the same as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docspark.functions.deal import dealt

LINES_PER_PAGE = 4


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def runs(spark, d) -> DataFrame:
    """A row for each line of a document: doc_id, line_no, text."""
    docs = read(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text")).withColumn("line_no", F.col("line_no").cast("long"))


RUNS = """runs AS (
    SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS line_no, unnest(l) AS text
    FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))"""


def pages(spark, d) -> DataFrame:
    """Pages of four lines: doc_id, page_index, text. Built from the array of lines, without a shuffle."""
    docs = read(spark, d, "documents").where("text is not null").select("doc_id", F.split("text", "\n").alias("l"))
    parts = F.expr(f"transform(sequence(0, (size(l) - 1) div {LINES_PER_PAGE}), i -> array_join(slice(l, cast(i * {LINES_PER_PAGE} + 1 as int), {LINES_PER_PAGE}), '\n'))")
    return docs.select("doc_id", F.posexplode(parts).alias("page_index", "text")).withColumn("page_index", F.col("page_index").cast("long"))


PAGES = f"""{RUNS}, doc_pages AS (
    SELECT doc_id, line_no // {LINES_PER_PAGE} AS page_index, string_agg(text, chr(10) ORDER BY line_no) AS text
    FROM runs GROUP BY ALL)"""


def plan(spark, d) -> DataFrame:
    """Orders as workspaces, their lines as pages."""
    by = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    li = read(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    li = li.withColumn("pos", (F.row_number().over(by) - 1).cast("long"))
    return li.select(F.col("l_orderkey").alias("workspace_id"), "pos", F.concat_ws("-", "l_orderkey", "pos").alias("page_id"), F.col("l_partkey").alias("source_id"), (F.col("l_suppkey") % 5).alias("page_index"), F.lit(0).alias("rotation"))


PLAN = """plan AS (
    SELECT l_orderkey AS workspace_id, pos, l_orderkey || '-' || pos AS page_id, l_partkey AS source_id, l_suppkey % 5 AS page_index, 0 AS rotation
    FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS pos FROM lineitem))"""


def outline(spark, d) -> DataFrame:
    """Customers as documents: level 0 the customer, 1 the orders, 2 their lines; targets are orders and, from 10**9 on, parts."""
    c, o, lines = read(spark, d, "customer"), read(spark, d, "orders"), plan(spark, d)
    none = F.lit(-1).cast("long")
    row = lambda doc, level, k1, k2, target: [F.col(doc).cast("long").alias("doc_id"), F.lit(level).alias("level"), k1.alias("k1"), k2.alias("k2"), target.cast("long").alias("target")]
    top = c.select(*row("c_custkey", 0, none, none, F.lit(None)))
    o = o.select("o_orderkey", "o_custkey").join(c.select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    middle = o.select(*row("o_custkey", 1, F.col("o_orderkey"), none, F.col("o_orderkey")))
    leaf = lines.join(o, lines.workspace_id == o.o_orderkey).select(*row("o_custkey", 2, F.col("o_orderkey"), F.col("pos"), F.col("source_id") + 1_000_000_000))
    u = top.unionByName(middle).unionByName(leaf)
    by = Window.partitionBy("doc_id").orderBy("k1", "k2")
    return dealt(u, "doc_id").select("doc_id", (F.row_number().over(by) - 1).cast("long").alias("idx"), "level", F.concat_ws("/", "doc_id", "k1", "k2").alias("item_id"), "target")


OUTLINE = f"""{PLAN}, outline AS (
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k1, k2) - 1 AS idx, level, doc_id || '/' || k1 || '/' || k2 AS item_id, target FROM (
        SELECT c_custkey AS doc_id, 0 AS level, -1 AS k1, -1 AS k2, NULL::BIGINT AS target FROM customer
        UNION ALL SELECT o_custkey, 1, o_orderkey, -1, o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)
        UNION ALL SELECT o_custkey, 2, o_orderkey, pos, source_id + 1000000000 FROM plan JOIN orders ON o_orderkey = workspace_id WHERE o_custkey IN (SELECT c_custkey FROM customer)))"""


def permissions(spark, d) -> DataFrame:
    return read(spark, d, "labels").select("doc_id", (F.col("toxic") != 1).alias("copy"), (F.col("quality") != 0).alias("edit"))


def sessions(spark, d) -> DataFrame:
    """Events as an edit log: session_id, ts, event_id, action, state."""
    e = read(spark, d, "events")
    action = F.when(F.col("event_type") == "error", "undo").when(F.col("event_type") == "signup", "redo").otherwise("commit")
    return e.select(F.col("user_id").alias("session_id"), "ts", "event_id", action.alias("action"), F.col("event_id").alias("state"))


LOG = """log AS (
    SELECT user_id AS session_id, ts, event_id, CASE event_type WHEN 'error' THEN 'undo' WHEN 'signup' THEN 'redo' ELSE 'commit' END AS action, event_id AS state
    FROM events)"""
