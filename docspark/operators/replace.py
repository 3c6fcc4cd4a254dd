"""Planning and applying find-and-replace over runs of text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions.fold import splice


def interval_overlaps(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """ranges with overlaps: whether the interval meets another of its group."""
    by = Window.partitionBy(*keys).orderBy("start", "stop")
    before = F.max("stop").over(by.rowsBetween(Window.unboundedPreceding, -1)) > F.col("start")
    after = F.lead("start").over(by) < F.col("stop")  # the next one starts first of all that follow
    return ranges.withColumn("overlaps", F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False)))


def match_ownership(matches: DataFrame, spans: DataFrame, key: str = "doc_id", bucket: int = 256) -> DataFrame:
    """Each match (key, start, stop) with the run and the part of its text that hold it (run, source_start, source_stop; null if they
    are not one), and blocker, why it cannot be edited.

    spans: key, char_start, char_stop, run, source_start, valid, supported: a stretch of the page's characters comes from the run's
    text from source_start on; valid: the characters are those of the run there; characters without a span belong to no run.
    Blockers, in this order: InvalidMapping (a span is not valid), CrossObject (several runs), Unmapped (a character of no run),
    OverlappingSource (some of the run's text is shown by several characters of the page), InvalidMapping (the characters do not follow one
    another in the run), Ineligible (the run is not supported).

    The join is on stretches of `bucket` characters, so that in a long text only spans near a match meet it.
    """
    stretch = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bucket), F.floor(F.greatest(F.col(a), F.col(b) - 1) / bucket)))
    spans = spans.where("char_start < char_stop").select(key, "char_start", "char_stop", "run", "source_start", "valid", "supported")
    # a sweep over each run's text: +1 where a span begins, -1 where it ends; the pieces with a depth of two or more are shown twice
    stop = (F.col("source_start") + F.col("char_stop") - F.col("char_start")).alias("at")
    edges = spans.select(key, "run", F.col("source_start").alias("at"), F.lit(1).alias("by")).unionByName(spans.select(key, "run", stop, F.lit(-1).alias("by")))
    along = Window.partitionBy(key, "run").orderBy("at")
    depth = edges.groupBy(key, "run", "at").agg(F.sum("by").alias("by")).withColumn("depth", F.sum("by").over(along.rowsBetween(Window.unboundedPreceding, 0))).withColumn("to", F.lead("at").over(along))
    twice = depth.where("depth > 1").groupBy(key, "run").agg(F.collect_list(F.struct("at", "to")).alias("twice"))
    spans = spans.join(twice, [key, "run"], "left")
    m = matches.select(key, "start", "stop").distinct().withColumn("near", stretch("start", "stop"))
    r = spans.withColumnRenamed(key, "span_key").withColumn("span_near", stretch("char_start", "char_stop"))
    meets = (F.col(key) == F.col("span_key")) & (F.col("near") == F.col("span_near")) & (F.col("start") < F.col("char_stop")) & (F.col("stop") > F.col("char_start"))
    first, last = F.greatest("start", "char_start"), F.least("stop", "char_stop")
    j = m.join(r, meets, "left").withColumn("shift", F.col("source_start") - F.col("char_start")).withColumn("low", first + F.col("shift")).withColumn("high", last + F.col("shift"))
    j = j.withColumn("shown_twice", F.exists("twice", lambda t: (t["at"] < F.col("high")) & (t["to"] > F.col("low"))))
    # a match and a span may meet in several stretches: once each
    once = j.groupBy(key, "start", "stop", "char_start").agg(*[F.first(c).alias(c) for c in ("run", "shift", "low", "high", "valid", "supported", "shown_twice")])
    g = once.groupBy(key, "start", "stop").agg(
        F.count_distinct("run").alias("n_runs"), F.min("run").alias("run"), F.sum(F.col("high") - F.col("low")).alias("held"), F.min("shift").alias("least"), F.max("shift").alias("most"), F.min("low").alias("low"),
        F.bool_or(~F.col("valid")).alias("wrong"), F.bool_or("shown_twice").alias("twice"), F.bool_and("supported").alias("supported"),
    )
    reason = (
        F.when(F.col("wrong"), "InvalidMapping").when(F.col("n_runs") > 1, "CrossObject").when((F.col("n_runs") == 0) | (F.col("held") < F.col("stop") - F.col("start")), "Unmapped").when(F.col("twice"), "OverlappingSource")
        .when(F.col("least") != F.col("most"), "InvalidMapping").when(~F.col("supported"), "Ineligible")
    )
    g = g.withColumn("blocker", reason)
    known = F.col("blocker").isNull() | (F.col("blocker") == "Ineligible")
    return g.select(key, "start", "stop", F.when(known, F.col("run")).alias("run"), F.when(known, F.col("low")).alias("source_start"), F.when(known, F.col("low") + F.col("held")).alias("source_stop"), "blocker")


def plan_replacement(matches: DataFrame, runs: DataFrame, replacement: str, keys: list[str], text: str = "text", longest: int = 4096, page: str = "doc_id") -> DataFrame:
    """One edit for each run that changes: keys, expected_text, new_text, n_matches, blocker, can_apply.

    matches: keys, start, stop, selected. The pieces between selected matches are put together with the replacement. Blockers:
    ReplacementTooLong (bytes), NeedsRemoval (nothing is left), NeedsParagraphLayout (a line break is left). can_apply is false for all
    edits of a page that has a blocked one.
    """
    chosen = matches.where("selected").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    new = splice(F.col("body"), F.col("spans"), replacement)
    j = runs.select(*keys, F.col(text).alias("body")).join(chosen, keys)
    out = j.select(*keys, F.col("body").alias("expected_text"), new.alias("new_text"), F.size("spans").cast("long").alias("n_matches"))
    same = F.col("new_text") == F.col("expected_text")
    blocker = F.when(F.octet_length("new_text") > longest, "ReplacementTooLong").when(F.col("new_text") == "", "NeedsRemoval").when(~same & F.col("new_text").rlike(r"[\r\n\x0b\x0c\x{85}\x{2028}\x{2029}]"), "NeedsParagraphLayout")
    out = out.withColumn("blocker", blocker).where(~same | F.col("blocker").isNotNull())
    return out.withColumn("can_apply", F.count("blocker").over(Window.partitionBy(page)) == 0)


def plan_document_replacement(edits: DataFrame, key: str = "doc_id", page: str = "page_index", max_edits: int = 64, max_pages: int = 32, max_bytes: int = 512 * 1024) -> DataFrame:
    """Per document: edits, selected and blocked matches, pages, bytes (before and after), and the first blocker of
    SelectedMatchesBlocked, PageBatchBlocked, TooManyEdits, TooManyPages and BatchBytes; a blocked document has no edits to apply.

    edits may have batch_blocker: why the page's edits cannot be applied together (see validate_batch), null if they can."""
    free = F.col("blocker").isNull()
    edits = edits if "batch_blocker" in edits.columns else edits.withColumn("batch_blocker", F.lit(None).cast("string"))
    g = edits.groupBy(key).agg(
        F.count(F.when(free, 1)).alias("n_edits"), F.sum("n_matches").alias("n_matches"), F.coalesce(F.sum(F.when(~free, F.col("n_matches"))), F.lit(0)).cast("long").alias("n_blocked"),
        F.count_distinct(F.when(free, F.col(page))).alias("n_pages"), F.coalesce(F.sum(F.when(free, F.octet_length("expected_text") + F.octet_length("new_text"))), F.lit(0)).cast("long").alias("n_bytes"),
        F.count(F.when(free, F.col("batch_blocker"))).alias("batches"),
    )
    reason = F.when(F.col("n_blocked") > 0, "SelectedMatchesBlocked").when(F.col("batches") > 0, "PageBatchBlocked").when(F.col("n_edits") > max_edits, "TooManyEdits").when(F.col("n_pages") > max_pages, "TooManyPages").when(F.col("n_bytes") > max_bytes, "BatchBytes")
    return g.withColumn("blocker", reason).drop("batches")


def apply_edits(runs: DataFrame, edits: DataFrame, keys: list[str], doc: str = "doc_id", text: str = "text") -> DataFrame:
    """runs with the edits' new texts and applied, all or nothing for each document: it stays as it is if an edit's expected text is
    not the current one, if its run is missing or there twice, or if two edits aim at one run. Every run comes out once."""
    e = edits.groupBy(*keys).agg(F.count("*").alias("edits"), F.min("expected_text").alias("expected_text"), F.min("new_text").alias("new_text"))
    j = runs.withColumn("is_run", F.lit(True)).withColumn("same_key", F.count("*").over(Window.partitionBy(*keys))).join(e, keys, "full_outer")
    good = F.coalesce(F.col("is_run"), F.lit(False)) & (F.col("edits") == 1) & (F.col("same_key") == 1) & F.col("expected_text").eqNullSafe(F.col(text))
    fits = F.coalesce(F.bool_and(F.when(F.col("edits").isNotNull(), F.coalesce(good, F.lit(False)))).over(Window.partitionBy(doc)), F.lit(True))
    j = j.withColumn("applied", fits & F.col("edits").isNotNull()).where("is_run")
    return j.withColumn(text, F.when(F.col("applied"), F.col("new_text")).otherwise(F.col(text))).select(*runs.columns, "applied")


def stale_edits(runs: DataFrame, edits: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Edits whose run is missing, repeated or has another text than expected."""
    now = runs.groupBy(*keys).agg(F.count("*").alias("n"), F.min(text).alias("now"))
    return edits.join(now, keys, "left").where("n is null or n <> 1 or not (now <=> expected_text)").drop("n", "now")


def affected_pages(edits: DataFrame, keys: list[str]) -> DataFrame:
    return edits.select(*keys).distinct()


def validate_batch(edits: DataFrame, keys: list[str], path: str = "path", batch: str = "doc_id", max_edits: int = 64, max_pages: int = 32) -> DataFrame:
    """edits that are not allowed, and why: path (empty or over 13 steps), text (expected_text of 1 to 16384 bytes, new_text of 1 to
    4096), prefix (its path begins with another edit's on the same page), repeated (another has the same path), too_many_edits or
    too_many_pages (of the batch: all its edits)."""
    whole = edits.select(*keys, F.col(path).alias("outer_path")).distinct()
    steps = F.transform(F.sequence(F.lit(1), F.greatest(F.size(path) - 1, F.lit(1))), lambda i: F.slice(path, F.lit(1), i))
    inner = edits.where(F.size(path) > 1).select(*keys, path).distinct().withColumn("outer_path", F.explode(steps))
    inside = inner.join(whole, [*keys, "outer_path"], "left_semi").select(*keys, path).distinct().withColumn("inside", F.lit(True))
    pages = edits.groupBy(batch).agg(F.count("*").alias("n_edits"), F.count_distinct(*keys).alias("n_pages"))
    j = edits.withColumn("same_path", F.count("*").over(Window.partitionBy(*keys, path))).join(inside, [*keys, path], "left").join(pages, batch)
    size = lambda c, most: F.coalesce(F.octet_length(c), F.lit(0)).between(1, most)
    reason = (
        F.when(~F.size(path).between(1, 13), "path").when(~size("expected_text", 16 * 1024) | ~size("new_text", 4096), "text").when(F.col("inside"), "prefix").when(F.col("same_path") > 1, "repeated")
        .when(F.col("n_edits") > max_edits, "too_many_edits").when(F.col("n_pages") > max_pages, "too_many_pages")
    )
    return j.withColumn("reason", reason).where("reason is not null").select(*edits.columns, "reason")


def apply_workspace_result(plan: DataFrame, overlays: DataFrame, page_patches: DataFrame, overlay_patches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(plan, overlays) after a replacement: patched pages point to their new source page, patched overlays take the new text.

    page_patches: page_id, new_source_id, new_page_index. overlay_patches: doc_id, line_no, new_text, null deleting the overlay.
    """
    p = plan.join(page_patches, "page_id", "left")
    p = p.select(*[F.coalesce(f"new_{c}", c).alias(c) if c in ("source_id", "page_index") else F.col(c) for c in plan.columns])
    o = overlays.join(overlay_patches.withColumn("patched", F.lit(True)), ["doc_id", "line_no"], "left").where("patched is null or new_text is not null")
    return p, o.select("doc_id", "line_no", F.coalesce("new_text", "text").alias("text"))


def plan_workspace_replacement(plan: DataFrame, native: DataFrame, added: DataFrame, selected: DataFrame) -> DataFrame:
    """Matches of page text (source_id, page_index, start, visible) and of added text (page_id, start, visible) at every place of a plan:
    the visible ones numbered together for each page, with selected, whether selected (page_id, ordinal) names them. A selection
    that names no match comes as a row of its own with error unknown_selection."""
    n = plan.join(native.where("visible"), ["source_id", "page_index"]).select("workspace_id", "page_id", F.lit("page").alias("scope"), "start")
    o = plan.select("workspace_id", "page_id").join(added.where("visible"), "page_id").select("workspace_id", "page_id", F.lit("overlay").alias("scope"), "start")
    by = Window.partitionBy("workspace_id", "page_id").orderBy(F.desc("scope"), "start")
    matches = n.unionByName(o).withColumn("ordinal", (F.row_number().over(by) - 1).cast("long"))
    j = matches.join(selected.select("page_id", "ordinal").distinct().withColumn("selected", F.lit(True)), ["page_id", "ordinal"], "full_outer")
    return j.withColumn("error", F.when(F.col("scope").isNull(), "unknown_selection")).withColumn("selected", F.coalesce("selected", F.lit(False)))


def overlay_replacement(overlays: DataFrame, needle: str, replacement: str, text: str = "text") -> DataFrame:
    """Overlays with every occurrence replaced; those left without text go."""
    return overlays.withColumn(text, F.replace(F.col(text), F.lit(needle), F.lit(replacement))).where(F.length(text) > 0)
