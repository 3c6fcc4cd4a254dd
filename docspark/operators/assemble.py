"""Documents, exports, page selection and recognised words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def document_info(pages: DataFrame, key: str = "doc_id", permissions: DataFrame | None = None) -> DataFrame:
    """Pages, characters and longest page of each document and, if pages have width and height, sizes: the distinct ones, in order of
    the first page of each. With permissions (key and a boolean for each right) also denied: the rights that are false, sorted;
    a document without a row there has none."""
    found = [F.count("*").alias("page_count"), F.sum(F.length("text")).cast("long").alias("chars"), F.max(F.length("text")).cast("long").alias("longest_page")]
    if {"width", "height"} <= set(pages.columns):
        ordered = F.array_sort(F.collect_list(F.struct("page_index", "width", "height")))
        found.append(F.array_distinct(F.transform(ordered, lambda p: F.struct(p["width"].alias("width"), p["height"].alias("height")))).alias("sizes"))
    info = pages.groupBy(key).agg(*found)
    if permissions is None:
        return info
    rights = sorted(c for c in permissions.columns if c != key)
    denied = F.array_compact(F.array(*[F.when(~F.col(c), c) for c in rights]))
    return info.join(permissions.select(key, denied.alias("denied")), key, "left").withColumn("denied", F.coalesce("denied", F.array().cast("array<string>")))


def export_text(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """The pages' texts in order, parted by a form feed line, with counts of pages, empty pages and bytes."""
    g = pages.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("page_index", "text"))).alias("p"))
    text = F.array_join(F.transform("p", lambda x: F.coalesce(x["text"], F.lit(""))), "\n\f\n")
    return g.select(key, text.alias("text"), F.size("p").cast("long").alias("page_count"), F.size(F.filter("p", lambda x: F.coalesce(F.trim(x["text"]), F.lit("")) == "")).cast("long").alias("empty_pages"), F.octet_length(text).cast("long").alias("bytes"))


def select_pages(pages: DataFrame, requests: DataFrame, key: str = "doc_id") -> DataFrame:
    """Pages that a request names, in document order, each once, and error: null, or why the request selects nothing (one row, without page).

    requests: key, mode (all, current or range), current_page (page_index), expr (1-based, such as 1,3-5). Errors: no_pages,
    current (no such page), syntax (a part is not a number or a range), bounds (a range is empty or leaves 1 to the page count).
    """
    counts = pages.groupBy(F.col(key).alias("n_key")).agg(F.count("*").alias("n"), F.collect_set("page_index").alias("there"))
    r = requests.join(counts, F.col(key) == F.col("n_key"), "left").drop("n_key")
    part = r"\s*[0-9]{1,9}\s*(-\s*[0-9]{1,9}\s*)?"
    ends = F.transform(F.split("expr", ","), lambda p: F.struct(F.trim(F.split(p, "-")[0]).try_cast("int").alias("lo"), F.trim(F.element_at(F.split(p, "-"), -1)).try_cast("int").alias("hi")))
    in_range = F.col("mode") == "range"
    error = (
        F.when(F.col("n").isNull(), "no_pages").when((F.col("mode") == "current") & ~F.coalesce(F.array_contains("there", F.col("current_page")), F.lit(False)), "current")
        .when(in_range & ~F.coalesce(F.col("expr").rlike(f"^{part}(,{part})*$"), F.lit(False)), "syntax")
        .when(in_range & F.exists(ends, lambda x: (x["lo"] < 1) | (x["hi"] < x["lo"]) | (x["hi"] > F.col("n"))), "bounds")
    )
    r = r.withColumn("error", error)
    wanted = F.when(F.col("mode") == "all", F.array_sort("there")).when(F.col("mode") == "current", F.array("current_page")).otherwise(F.array_distinct(F.flatten(F.transform(ends, lambda x: F.sequence(x["lo"] - 1, x["hi"] - 1).cast("array<bigint>")))))
    good = r.where("error is null").select(key, F.explode(wanted).alias("page_index"), "error")
    return good.join(pages, [key, "page_index"]).unionByName(r.where("error is not null").select(key, "error"), allowMissingColumns=True)


def verify_manifest(actual: DataFrame, manifest: DataFrame, key: str = "doc_id", slack: float = 0.01) -> DataFrame:
    """Each document's first failed check against a manifest: missing, unexpected, digest, pages, size, sample, scan_text, else ok.

    Both: key, sha256, pages, width, height (within slack); actual: text; manifest: sample (to be part of the text, null for none)
    and scan (such a document has no text).
    """
    cols = ("sha256", "pages", "width", "height")
    m = manifest.select(key, *[F.col(c).alias(f"want_{c}") for c in cols], "sample", "scan")
    j = actual.select(key, *cols, "text").join(m, key, "full_outer")
    off = F.greatest(*[F.abs(F.col(c) - F.col(f"want_{c}")) for c in ("width", "height")]) > slack
    blank = F.coalesce(F.trim("text"), F.lit("")) == ""
    status = (
        F.when(F.col("pages").isNull(), "missing").when(F.col("want_pages").isNull(), "unexpected").when(F.col("sha256") != F.col("want_sha256"), "digest").when(F.col("pages") != F.col("want_pages"), "pages")
        .when(off, "size").when(F.col("sample").isNotNull() & ~F.coalesce(F.contains("text", "sample"), F.lit(False)), "sample").when(F.col("scan") & ~blank, "scan_text").otherwise("ok")
    )
    return j.select(key, status.alias("status"))


def image_page_fit(images: DataFrame, width: float, height: float, margin: float) -> DataFrame:
    """images (image_id, w, h) with the page turned to the image's orientation, the scale and the centred box."""
    turned = (F.col("w") > F.col("h")) != F.lit(width > height)
    pw, ph = F.when(turned, height).otherwise(width).cast("double"), F.when(turned, width).otherwise(height).cast("double")
    scale = F.least((pw - 2 * margin) / F.col("w"), (ph - 2 * margin) / F.col("h"))
    return images.select("image_id", pw.alias("page_w"), ph.alias("page_h"), F.round(scale, 6).alias("scale"), F.round((pw - F.col("w") * scale) / 2, 6).alias("x"), F.round((ph - F.col("h") * scale) / 2, 6).alias("y"))


def image_budget(images: DataFrame, group: str, max_item: int, max_total: int) -> DataFrame:
    """images (group, pos, pixels) with whether each is within the item budget and the running total within the other."""
    run = F.sum("pixels").over(Window.partitionBy(group).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return images.withColumn("total", run).withColumn("accepted", (F.col("pixels") <= max_item) & (F.col("total") <= max_total))


def export_raster_plan(pages: DataFrame, dpi: int) -> DataFrame:
    """Pixel size of pages (width, height in points) and whether it is over 12,000 a side or 24 million in all."""
    w, h = F.round(F.col("width") * dpi / 72).cast("long"), F.round(F.col("height") * dpi / 72).cast("long")
    return pages.withColumn("px_w", w).withColumn("px_h", h).withColumn("too_large", (w > 12_000) | (h > 12_000) | (w * h > 24_000_000))


def ocr_char_boxes(words: DataFrame, keys: list[str]) -> DataFrame:
    """Each word's box (x, width) parted evenly into its characters'."""
    n = F.length("text")
    return words.where(n > 0).select(*keys, "x", "width", n.alias("n"), F.posexplode(F.expr("transform(sequence(1, length(text)), i -> substring(text, i, 1))")).alias("j", "char")).select(
        *keys, F.col("j").cast("long").alias("j"), "char", (F.col("x") + F.col("j") * F.col("width") / F.col("n")).alias("char_x"), (F.col("width") / F.col("n")).alias("char_width")
    )


def ocr_review(words: DataFrame, threshold: float = 80) -> DataFrame:
    """Words per bucket: existing, removed, uncertain (confidence under the threshold) or accepted, in that order."""
    bucket = F.when(F.col("existing"), "existing").when(F.col("removed"), "removed").when(F.col("confidence") < threshold, "uncertain").otherwise("accepted")
    return words.groupBy("doc_id", bucket.alias("bucket")).agg(F.count("*").alias("n_words"))


def _refused(c, width: float, height: float) -> Column:
    """The first reason for which a word is not valid, null if it is; c gives its columns or fields by name."""
    bad_box = (c("x") < 0) | (c("y") < 0) | (c("x") + c("width") > width) | (c("y") + c("height") > height)
    return F.when(F.length(F.trim(c("text"))) == 0, "empty").when(c("text").rlike(r"\p{Cc}"), "control").when(~c("confidence").between(0, 100), "confidence").when(bad_box, "outside")


def ocr_validate(words: DataFrame, width: float, height: float) -> DataFrame:
    """words with the first reason for which each is not valid, null if it is."""
    return words.withColumn("reason", _refused(F.col, width, height))


def ocr_page_validate(words: DataFrame, width: float, height: float, page: list[str], line: str = "line", most_lines: int = 10_000, most_words: int = 20_000, most_bytes: int = 2 << 20, most_chars: int = 100_000) -> DataFrame:
    """Per page: n_words, n_chars and reason, why its recognised text is refused as a whole (null if it is not): raster (no area, a side
    over 6,000 or over 20 million points), lines, words, bytes or chars (too many), or the first reason of a word in order.

    words may also be pages with their words as one array in order (page, words, as ocr_word_arrays gives them), which are not
    shuffled; a page without words gives no row.
    """
    raster = not (0 < width <= 6000 and 0 < height <= 6000 and width * height <= 20_000_000)
    if "words" in words.columns:
        texts = F.filter(F.transform("words", lambda w: w["text"]), lambda x: x.isNotNull())
        total = lambda size: F.when(F.size(texts) > 0, F.aggregate(F.transform(texts, size), F.lit(0).cast("long"), lambda a, n: a + n))
        reasons = F.filter(F.transform("words", lambda w: _refused(lambda n: w[n], width, height)), lambda r: r.isNotNull())
        g = words.where("size(words) > 0").select(
            *page, F.size("words").cast("long").alias("n_words"), total(F.length).alias("n_chars"), total(F.octet_length).alias("bytes"),
            F.size(F.array_distinct(F.array_compact(F.transform("words", lambda w: w[line])))).alias("lines"), F.struct(F.get(reasons, F.lit(0)).alias("reason")).alias("first"),
        )
    else:
        order = [c for c in ("block", "paragraph", line, "word") if c in words.columns]
        g = ocr_validate(words, width, height).groupBy(*page).agg(
            F.count("*").alias("n_words"), F.sum(F.length("text")).cast("long").alias("n_chars"), F.sum(F.octet_length("text")).alias("bytes"), F.count_distinct(line).alias("lines"),
            F.min(F.when(F.col("reason").isNotNull(), F.struct(*order, "reason"))).alias("first"),
        )
    over = F.when(F.lit(raster), "raster").when(F.col("lines") > most_lines, "lines").when(F.col("n_words") > most_words, "words").when(F.col("bytes") > most_bytes, "bytes").when(F.col("n_chars") > most_chars, "chars")
    return g.select(*page, "n_words", "n_chars", F.coalesce(over, F.col("first.reason")).alias("reason"))


def _spread(start: np.ndarray, stop: np.ndarray, most: int):
    """Pairs (k, place) for the places from start[k] to stop[k], about most of them at a time."""
    count = np.maximum(stop - start, 0)
    total, at = np.cumsum(count), 0
    while at < len(count):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        k, n = np.repeat(np.arange(at, to), count[at:to]), count[at:to]
        yield k, start[k] + np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n)
        at = to


def _points_in_boxes(points: np.ndarray, boxes: np.ndarray, cell: float, most: int = 1 << 20):
    """Pairs (point, box) where the point lies in the box, some at a time. points: page, x, y; boxes: page, left, top, right, bottom.

    The points of a page lie in strips of the height cell, sorted by x there; a box meets those of its strips between its sides.
    """
    kept, boxed = np.flatnonzero(np.isfinite(points).all(axis=0)), np.flatnonzero(~np.isnan(boxes).any(axis=0))
    strip = np.floor(points[2, kept] / cell)
    kept = kept[order := np.lexsort((points[1, kept], strip, points[0, kept]))]
    (page, x, y), strip, n = points[:, kept], strip[order], len(kept)
    own, left, top, right, bottom = boxes[:, boxed]
    strips, across = np.unique(strip), np.sort(x)
    group = lambda page, rank: page.astype(np.int64) * (len(strips) + 1) + rank
    groups, number = np.unique(group(page, np.searchsorted(strips, strip)), return_inverse=True)
    spot = number * (n + 1) + np.searchsorted(across, x)
    first = np.searchsorted(groups, group(own, np.searchsorted(strips, np.floor(top / cell))))
    last = np.searchsorted(groups, group(own, np.searchsorted(strips, np.floor(bottom / cell), "right")))
    low, high = np.searchsorted(across, left), np.searchsorted(across, right, "right")
    for b, g in _spread(first, last, most):
        for k, p in _spread(np.searchsorted(spot, g * (n + 1) + low[b]), np.searchsorted(spot, g * (n + 1) + high[b]), most):
            hit = (y[p] >= top[b[k]]) & (y[p] <= bottom[b[k]])
            yield kept[p[hit]], boxed[b[k[hit]]]


def ocr_exclude_existing(words: DataFrame, native: DataFrame | None, page: list[str], cell: float = 24.0, tol: float = 0.5, step: int = 1 << 16) -> DataFrame:
    """words (page, x, y, width, height and others) without those whose centre lies in a native box (page, x, y, width, height), grown by
    tol, or the other way round.

    words may also be pages (page, words, native: arrays of the others), native is None then, which are not shuffled. One page is one
    array; a task looks at pages of about step words and boxes at a time.
    """
    if native is not None:
        box, columns = F.struct("x", "y", "width", "height"), words.columns
        w = words.groupBy(*page).agg(F.collect_list(F.struct(*[c for c in columns if c not in page])).alias("words"))
        pages = w.join(native.groupBy(*page).agg(F.collect_list(box).alias("native")), page, "left")
    else:
        pages, columns = words, [*page, *words.schema["words"].dataType.elementType.names]
    fields = pages.schema["words"].dataType.elementType
    out = StructType([StructField(c, pages.schema[c].dataType) for c in page] + [StructField(f.name, f.dataType) for f in fields])

    def run(batches):
        for batch in batches:
            size = sum(pc.fill_null(pc.list_value_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("words", "native"))
            total, at = np.cumsum(size), 0
            while at < len(batch):
                to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + step, "right")))
                part, at = batch.slice(at, to - at), to
                sides = []
                for c in ("words", "native"):
                    column = part.column(c)
                    each, count = column.flatten(), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
                    x, y, width, height = (each.field(f).cast(pa.float64()).to_numpy(zero_copy_only=False) for f in ("x", "y", "width", "height"))
                    own = np.repeat(np.arange(len(part), dtype=np.float64), count)
                    sides.append((each, np.stack([own, x + width / 2, y + height / 2]), np.stack([own, x - tol, y - tol, x + width + tol, y + height + tol])))
                (each, centres, grown), (_, theirs, boxes) = sides
                keep = np.ones(centres.shape[1], bool)
                for point, _ in _points_in_boxes(centres, boxes, cell):
                    keep[point] = False
                for _, mine in _points_in_boxes(theirs, grown, cell):
                    keep[mine] = False
                left = pa.array(np.flatnonzero(keep))
                at_page = pa.array(centres[0, keep].astype(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(c).take(at_page) for c in page] + [each.field(f.name).take(left) for f in fields], names=out.names)

    return pages.select(*page, "words", "native").mapInArrow(run, out).select(*columns)


def ocr_targets(plan: DataFrame) -> DataFrame:
    """Distinct source pages with the numbers of their occurrences."""
    return plan.groupBy("source_id", "page_index").agg(F.count("*").alias("occurrences"), F.array_join(F.array_sort(F.collect_list(F.concat_ws("/", "workspace_id", "pos"))), ",").alias("places"))
