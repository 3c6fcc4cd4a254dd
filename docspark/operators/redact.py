"""Redaction by rectangles over the characters of pages: PAGE columns and chars, an array of text, x, y, width, height in reading order.

A page's marks come to it as one array; characters and marks of a batch of pages are compared in numpy, and only results become
rows. Where a page's characters follow from its other columns (its text), give them as an expression `chars`: the page then meets
its marks as it is, and is taken apart behind the join, so that no shuffle or sort holds characters.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions.fold import let, splice

PAGE = ["doc_id", "page_index"]


def _meets(c: Column, m: Column) -> Column:
    """Whether the character's box and the mark overlap."""
    return (c["x"] < m["mx"] + m["mw"]) & (c["x"] + c["width"] > m["mx"]) & (c["y"] < m["my"] + m["mh"]) & (c["y"] + c["height"] > m["my"])


def _hits(batch: pa.RecordBatch, touching: bool) -> tuple[pa.StructArray, np.ndarray, np.ndarray, np.ndarray]:
    """All characters of a batch of pages with marks, the page of each, its place there, and whether a mark meets it."""
    flat = lambda name: (batch.column(name).flatten(), pc.fill_null(pc.list_value_length(batch.column(name)), 0).to_numpy(zero_copy_only=False))
    number = lambda rows, f: rows.field(f).cast(pa.float64()).to_numpy(zero_copy_only=False)
    (chars, sizes), (marks, counts) = flat("chars"), flat("marks")
    page = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(page)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    left, top = number(chars, "x"), number(chars, "y")
    right, bottom = left + number(chars, "width"), top + number(chars, "height")
    x, y = number(marks, "mx"), number(marks, "my")
    r, b = x + number(marks, "mw"), y + number(marks, "mh")
    under = np.less_equal if touching else np.less
    first, hit = np.cumsum(counts) - counts, np.zeros(len(page), bool)
    for k in range(int(counts.max(initial=0))):
        on = np.flatnonzero((counts > k)[page] & ~hit)
        m = first[page[on]] + k
        hit[on] = under(left[on], r[m]) & under(x[m], right[on]) & under(top[on], b[m]) & under(y[m], bottom[on])
    return chars, page, place, hit


def _marked(pages: DataFrame, marks: DataFrame, found, more: str, chars: Column | None) -> DataFrame:
    """Rows that found(batch) gives for the pages with marks: an index of pages and the further columns."""
    per_page = marks.groupBy(*PAGE).agg(F.collect_list(F.struct("mx", "my", "mw", "mh")).alias("_marks"))
    j = pages.join(per_page, PAGE).select(*PAGE, (F.col("chars") if chars is None else chars).alias("chars"), F.col("_marks").alias("marks"))
    names = PAGE + [c.split(" ")[0] for c in more.split(", ")]

    def run(batches):
        for batch in batches:
            page, *columns = found(batch)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(page)) for c in PAGE] + columns, names=names)

    keys = ", ".join(f"{c} {j.schema[c].dataType.simpleString()}" for c in PAGE)
    return j.mapInArrow(run, f"{keys}, {more}")


def mark_glyphs(pages: DataFrame, marks: DataFrame, touching: bool = False, chars: Column | None = None) -> DataFrame:
    """Characters that a mark (page, mx, my, mw, mh) meets: page, char_index, text."""

    def found(batch):
        each, page, place, hit = _hits(batch, touching)
        return page[hit], pa.array(place[hit], pa.int64()), each.field("text").filter(pa.array(hit))

    return _marked(pages, marks, found, "char_index long, text string", chars)


def missed_marks(pages: DataFrame, marks: DataFrame, chars: Column | None = None) -> DataFrame:
    """Marks (page, mark_id, mx, my, mw, mh) that meet no character; a page with such a mark is not to be redacted."""
    per_page = marks.groupBy(*PAGE).agg(F.collect_list(F.struct("mark_id", "mx", "my", "mw", "mh")).alias("_marks"))
    j = per_page.join(pages.withColumn("_there", F.lit(True)), PAGE, "left")
    missed = let(F.when(F.col("_there"), F.col("chars") if chars is None else chars), lambda all_chars: F.filter("_marks", lambda m: ~F.coalesce(F.exists(all_chars, lambda c: _meets(c, m)), F.lit(False))))
    return j.select(*PAGE, F.explode(missed).alias("m")).select(*PAGE, "m.*")


def mark_ranges(pages: DataFrame, marks: DataFrame, touching: bool = False, bridge_spaces: bool = True, chars: Column | None = None) -> DataFrame:
    """Ranges of characters that marks meet: page, start, stop. Neighbouring hits are one range and, with bridge_spaces, so are hits
    between which there are only spaces; spaces before the first hit and behind the last one are left alone."""

    def found(batch):
        each, page, place, hit = _hits(batch, touching)
        at = np.flatnonzero(hit)
        solid = np.cumsum(~pc.fill_null(pc.equal(each.field("text"), " "), False).to_numpy(zero_copy_only=False)) if bridge_spaces else np.arange(len(hit))
        # between two hits of a page there are only spaces if the later one is the next solid character, or none lies between
        gap = solid[at[1:] - 1] - solid[at[:-1]]
        new = np.concatenate([[True], (page[at[1:]] != page[at[:-1]]) | (gap > 0)]) if len(at) else np.zeros(0, bool)
        heads = np.flatnonzero(new)
        last = at[np.append(heads[1:], len(at)) - 1] if len(heads) else at
        return page[at[heads]], pa.array(place[at[heads]], pa.int64()), pa.array(place[last] + 1, pa.int64())

    return _marked(pages, marks, found, "start long, stop long", chars)


def area_ranges(pages: DataFrame, marks: DataFrame, chars: Column | None = None) -> DataFrame:
    """mark_ranges where touching a mark counts, spaces are not bridged and marks may meet nothing."""
    return mark_ranges(pages, marks, touching=True, bridge_spaces=False, chars=chars)


def _spans(ranges: DataFrame) -> DataFrame:
    return ranges.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))


def apply_redaction(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    """pages (page, text) without the characters in ranges, how many went, and how many ranges (blocks of text) were met."""
    j = pages.join(_spans(ranges), PAGE, "left")
    j = j.withColumn("redacted", F.when(F.col("spans").isNull(), F.col("text")).otherwise(splice(F.col("text"), F.col("spans"))))
    return j.select(*PAGE, F.col("redacted").alias("text"), (F.length("text") - F.length("redacted")).cast("long").alias("removed"), F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("affected"))


def redaction_audit(before: DataFrame, after: DataFrame, ranges: DataFrame) -> DataFrame:
    """Per page: whether after has, by value, what is left of before without the ranges' characters; a page that only one has is not exact."""
    kept = F.when(F.col("spans").isNull(), F.col("text")).otherwise(splice(F.col("text"), F.col("spans")))
    want = before.join(_spans(ranges), PAGE, "left").select(*PAGE, kept.alias("want"), F.lit(True).alias("was"))
    j = want.join(after.select(*PAGE, "text", F.lit(True).alias("still")), PAGE, "full_outer")
    return j.select(*PAGE, (F.col("was").isNotNull() & F.col("still").isNotNull() & F.col("want").eqNullSafe(F.col("text"))).alias("exact"))
