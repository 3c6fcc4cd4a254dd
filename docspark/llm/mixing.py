"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over training time (0 to 1), piecewise linear. Its integral is the source's share of the
words; the source's documents are laid out in a random but fixed order along its cumulative demand, and inverting that
demand gives each copy of a document its training position. The result is sorted by position over range partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.llm.common import WORD_CLASS, table


def word_count(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in the text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_CLASS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source_size and target of each source of sizes (source, size); one row per source, null a source of its own.

    Sources by code point, null last, weigh 5, 2, 1, repeating. They share `share` times all words by weight; a target
    stops at `most` times its source's size and the excess is shared again by weight until none is above. With the sources
    sorted by size/weight, those that stop come first, so one running sum finds them all.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    one = Window.partitionBy(F.lit(0))
    per = per.withColumn("k", F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())) - 1)
    per = per.withColumn("weight", F.element_at(F.array(F.lit(5.0), F.lit(2.0), F.lit(1.0)), (F.col("k") % 3 + 1).cast("int")))
    by = one.orderBy(F.col("source_size") / F.col("weight"), "k")
    earlier = by.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("left", share * F.sum("source_size").over(one) - most * F.coalesce(F.sum("source_size").over(earlier), F.lit(0)))
    per = per.withColumn("rate", F.col("left") / (F.sum("weight").over(one) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0))))
    per = per.withColumn("open", F.when(F.col("rate") * F.col("weight") <= most * F.col("source_size"), F.col("rate")))
    first = F.first("open", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    stopped = F.min(F.when(F.col("open").isNotNull(), F.struct(F.col("source_size") / F.col("weight"), F.col("k")))).over(one)
    per = per.withColumn("rate1", first).withColumn("from", stopped)
    is_open = F.struct(F.col("source_size") / F.col("weight"), F.col("k")) >= F.col("from")
    target = F.when(F.coalesce(is_open, F.lit(False)), F.col("rate1") * F.col("weight")).otherwise(most * F.col("source_size"))
    return per.select("source", "source_size", target.cast("double").alias("target"), "weight", "k")


def schedule(k: Column) -> tuple[Column, Column]:
    """Weight of source number k at the start and the end of training (linear between): warm-up, steady and late sources in turn."""
    at = (k % 3 + 1).cast("int")
    return F.element_at(F.array(F.lit(1.0), F.lit(1.0), F.lit(0.5)), at), F.element_at(F.array(F.lit(0.5), F.lit(1.0), F.lit(1.0)), at)


def position(share: Column, start: Column, end: Column) -> Column:
    """Time t at which the integral of a linear weight from start to end reaches `share` of its whole: the inverse of cumulative demand."""
    # start*t + (end-start)*t^2/2 = share*(start+end)/2, in the form without cancellation
    area = share * (start + end) / 2
    return 2 * area / (start + F.sqrt(start * start + 2 * (end - start) * area))


def _taken(docs: DataFrame, id_col: str, size: Column, source_col: str, seed: int) -> DataFrame:
    """row, id, size, source_size, target, start (words of the source before this row), weight schedule.

    The running sum has two levels: sums of about sqrt(rows) random buckets of each source, then inside each bucket; so no
    task gets a whole source.
    """
    source = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n"))
    base = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), source.alias("skey"), size.alias("size"))
    buckets = max(1, round(docs.count() ** 0.5))
    base = base.withColumn("u", F.xxhash64(F.lit(seed), F.col("id").cast("string"), "skey", "size"))
    base = base.withColumn("bucket", F.pmod(F.shiftright("u", 20), F.lit(buckets)))
    sums = table(base.groupBy("skey", "bucket").agg(F.first("source").alias("source"), F.sum("size").alias("size")), "mix-sizes")
    before = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("skey", "bucket", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    start, end = schedule(F.col("k"))
    skey = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))
    wanted = targets(sums).select(skey.alias("skey"), "source_size", "target", start.alias("w0"), end.alias("w1"))
    inside = Window.partitionBy("skey", "bucket").orderBy("u", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    base = base.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return base.join(offsets.join(wanted, "skey"), ["skey", "bucket"]).withColumn("start", F.col("offset") + F.col("inner"))


def _pass(n: int) -> Column:
    """Words of the row that fall to pass n: the part of [start, start+size) below the words that pass n still wants."""
    wanted = F.round("target").cast("long") - n * F.col("source_size")
    return F.greatest(F.lit(0), F.least("size", wanted - F.col("start"))).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, seed: int = 17) -> DataFrame:
    """One row for each row of docs, range-sorted by position: id_col, size, source_size, target, taken, position, position2.

    Size is the number of words. A source's words, in a fixed random order of its documents, are taken from the front: twice
    over if the target asks for it, the document at the end of a pass in part, so the words taken meet the target. position
    and position2 are the training times (0 to 1) of the first and second copy, null if not taken. Null and empty texts have
    size 0 and take nothing; a null id is an id like any other; fully repeated rows may swap their results.
    """
    sized = table(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")), "sized")
    rows = _taken(sized, "id", F.col("size"), "source", seed)
    first, second = _pass(0), _pass(1)
    at = lambda done: F.least(F.lit(1.0), position(F.try_divide(done + F.col("start") + F.col("size") / 2, F.col("target")), F.col("w0"), F.col("w1")))
    mixed = rows.select(
        F.col("id").alias(id_col), "size", "source_size", "target", (first + second).alias("taken"),
        F.when(first > 0, at(F.lit(0))).alias("position"), F.when(second > 0, at(F.col("source_size"))).alias("position2"),
    )
    order = F.col("position").asc_nulls_last(), F.col(id_col)
    return mixed.repartitionByRange(*order).sortWithinPartitions(*order)


def training_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, seed: int = 17, length_col: str | None = None) -> DataFrame:
    """The mix itself: a row of docs for each copy taken, all columns, range-sorted by training position; documents without words leave it.

    A copy taken in part keeps so many words from its front and, if length_col names the column of the text's length, has it
    set anew; the others are unchanged.
    """
    rows = _taken(docs, id_col, word_count(F.col(text_col)), source_col, seed)
    copy = lambda n: F.struct(_pass(n).alias("words"), (n * F.col("source_size") + F.col("start") + F.col("size") / 2).alias("at"))
    rows = rows.withColumn("copy", F.explode(F.array(copy(0), copy(1)))).where("copy.words > 0")
    rows = rows.withColumn("position", position(F.try_divide(F.col("copy.at"), F.col("target")), F.col("w0"), F.col("w1")))
    text = F.col(f"row.{text_col}")
    kept = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1)), F.lit(1), F.col("copy.words").cast("int")), "")
    cut = F.when(F.col("copy.words") < F.col("size"), kept).otherwise(text)
    out = rows.withColumn("cut", cut)
    changed = {text_col: F.col("cut")} | ({length_col: F.when(F.col("copy.words") < F.col("size"), F.length("cut")).otherwise(F.col(f"row.{length_col}")).cast(docs.schema[length_col].dataType)} if length_col else {})
    return out.repartitionByRange(F.col("position"), F.col("id"), F.col("copy.at")).sortWithinPartitions("position", "id", "copy.at").select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
