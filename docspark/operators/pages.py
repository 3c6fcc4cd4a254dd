"""Organising and composing page plans. A plan is (workspace_id, pos from 0, page_id, source_id, page_index, rotation)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WS = "workspace_id"


def renumber(plan: DataFrame, *order) -> DataFrame:
    return plan.withColumn("pos", (F.row_number().over(Window.partitionBy(WS).orderBy(*order)) - 1).cast("long"))


def _marked(plan: DataFrame, selected: DataFrame) -> DataFrame:
    """plan with sel: whether the page is among selected (workspace_id, pos)."""
    return plan.join(selected.select(WS, "pos", F.lit(True).alias("sel")), [WS, "pos"], "left").withColumn("sel", F.coalesce("sel", F.lit(False)))


def move_pages(plan: DataFrame, selected: DataFrame, boundary: DataFrame) -> DataFrame:
    """Selected pages packed in order at a boundary (workspace_id, at): before it only the pages not selected count."""
    m = _marked(plan, selected).join(boundary, WS, "left")
    bucket = F.when(F.col("sel"), 1).when(F.col("pos") < F.coalesce("at", F.lit(0)), 0).otherwise(2)
    return renumber(m.withColumn("bucket", bucket), "bucket", "pos").select(*plan.columns)


def duplicate_pages(plan: DataFrame, selected: DataFrame) -> DataFrame:
    """Copies of the selected pages after the last of them. The copy of page x is x-copy, or x-copy-2 and so on where the workspace
    has such pages already."""
    m = _marked(plan, selected).withColumn("last", F.max(F.when(F.col("sel"), F.col("pos"))).over(Window.partitionBy(WS)))
    taken = lambda k: F.regexp_extract("page_id", r"^(?s)(.*)-copy(?:-([0-9]{1,9}))?$", k)
    used = plan.where(F.col("page_id").rlike(r"(?s)-copy(-[0-9]{1,9})?$")).groupBy(WS, taken(1).alias("page_id")).agg(F.max(F.coalesce(F.expr("try_cast(regexp_extract(page_id, '-([0-9]+)$', 1) as bigint)"), F.lit(1))).alias("used"))
    new_id = F.concat("page_id", F.lit("-copy"), F.coalesce(F.concat(F.lit("-"), (F.col("used") + 1).cast("string")), F.lit("")))
    copies = m.where("sel").join(used, [WS, "page_id"], "left").withColumn("new_id", new_id)
    copies = copies.select(*[F.col("new_id" if c == "page_id" else c).alias(c) for c in plan.columns], F.col("last").alias("k1"), F.lit(1).alias("k2"))
    return renumber(m.select(*plan.columns, F.col("pos").alias("k1"), F.lit(0).alias("k2")).unionByName(copies), "k1", "k2", "pos").select(*plan.columns)


def insert_pages(plan: DataFrame, pages: DataFrame, index: DataFrame) -> DataFrame:
    """pages (plan columns) before position `at` of each workspace, clamped to its length."""
    a = plan.join(index, WS, "left").select(*plan.columns, F.when(F.col("pos") < F.coalesce("at", F.lit(0)), 0).otherwise(2).alias("k"))
    return renumber(a.unionByName(pages.select(*plan.columns, F.lit(1).alias("k"))), "k", "pos").select(*plan.columns)


def delete_pages(plan: DataFrame, selected: DataFrame) -> DataFrame:
    """The plan without the selected pages; a workspace that would lose all of them stays as it is."""
    m = _marked(plan, selected)
    whole = F.bool_and("sel").over(Window.partitionBy(WS))
    return renumber(m.withColumn("whole", whole).where("whole or not sel"), "pos").select(*plan.columns)


def rotate_pages(plan: DataFrame, selected: DataFrame, direction: int) -> DataFrame:
    turned = F.pmod(F.col("rotation") + 90 * direction, F.lit(360))
    return _marked(plan, selected).withColumn("rotation", F.when(F.col("sel"), turned).otherwise(F.col("rotation"))).select(*plan.columns)


def compose(pages: DataFrame, slots: DataFrame, selection: DataFrame | None = None) -> DataFrame:
    """A new plan from sources: selection (workspace_id, ord, slot, page_index, rotation), or all pages by slot and page.

    slots: workspace_id, slot, source_id; pages: source_id, page_index.
    """
    if selection is None:
        j = slots.join(pages, "source_id").withColumn("rotation", F.lit(0))
        return renumber(j, "slot", "page_index").select(WS, "pos", "source_id", "page_index", "rotation")
    j = selection.join(slots, [WS, "slot"]).join(pages, ["source_id", "page_index"])
    return renumber(j, "ord").select(WS, "pos", "source_id", "page_index", "rotation")


def alias_sources(slots: DataFrame) -> DataFrame:
    """slots with the first slot of the workspace that has the same source."""
    return slots.withColumn("alias_slot", F.min("slot").over(Window.partitionBy(WS, "source_id")))


def is_identity_plan(plan: DataFrame, counts: DataFrame) -> DataFrame:
    """Whether each workspace shows all its pages (counts: workspace_id, n) in the original order, unrotated."""
    same = plan.groupBy(WS).agg(F.bool_and((F.col("page_index") == F.col("pos")) & (F.col("rotation") == 0)).alias("same"), F.count("*").alias("shown"))
    return same.join(counts.select(WS, "n"), WS, "left").select(WS, F.coalesce(F.col("same") & (F.col("shown") == F.col("n")), F.lit(False)).alias("identity"))


def split_every(plan: DataFrame, n: int) -> DataFrame:
    """Contiguous parts of n pages: workspace_id, part, first, stop."""
    g = plan.groupBy(WS, F.expr(f"pos div {n}").alias("k")).agg(F.min("pos").alias("first"), (F.max("pos") + 1).alias("stop"))
    return g.select(WS, F.concat(F.lit("part-"), F.lpad((F.col("k") + 1).cast("string"), 4, "0")).alias("part"), "first", "stop")


def split_at(plan: DataFrame, starts: DataFrame) -> DataFrame:
    """Parts that begin at page 0 and at the given positions (workspace_id, pos) inside the plan."""
    sizes = plan.groupBy(WS).agg(F.count("*").alias("n"))
    s = starts.join(sizes, WS).where("pos > 0 and pos < n").select(WS, F.col("pos").alias("first"), "n").distinct().unionByName(sizes.select(WS, F.lit(0).cast("long").alias("first"), "n"))
    by = Window.partitionBy(WS).orderBy("first")
    return s.select(WS, F.concat(F.lit("part-"), F.lpad(F.row_number().over(by).cast("string"), 4, "0")).alias("part"), "first", F.coalesce(F.lead("first").over(by), "n").alias("stop"))


def validate_partition(parts: DataFrame, plan: DataFrame) -> DataFrame:
    """Whether the parts cover each plan exactly once, in order."""
    by = Window.partitionBy(WS).orderBy("first")
    p = parts.withColumn("ok", F.coalesce(F.lag("stop").over(by), F.lit(0)) == F.col("first")).groupBy(WS).agg(F.bool_and("ok").alias("ok"), F.max("stop").alias("last"))
    return plan.groupBy(WS).agg(F.count("*").alias("n")).join(p, WS, "left").select(WS, F.coalesce(F.col("ok") & (F.col("last") == F.col("n")), F.lit(False)).alias("valid"))


def assign_parts(plan: DataFrame, parts: DataFrame) -> DataFrame:
    """Each page's part: the last one that begins at or before it."""
    starts = parts.select(WS, F.col("first").alias("pos"), "part")
    j = plan.join(starts, [WS, "pos"], "left")
    return j.withColumn("part", F.last("part", ignorenulls=True).over(Window.partitionBy(WS).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))


def replace_page_occurrence(plan: DataFrame, requests: DataFrame) -> DataFrame:
    """plan after one occurrence (workspace_id, pos) got other content: requests: workspace_id, pos, new_source, n_pages.

    The source's pages in the workspace go on as pages of its new version. If the page is there once, it keeps its index. If it
    repeats, the version has one page more, of index n_pages: the occurrence moves there, or, if it is the first one, the
    others do. A workspace with several requests stays as it is.
    """
    one = requests.withColumn("asked", F.count("*").over(Window.partitionBy(WS))).where("asked = 1").select(WS, F.col("pos").alias("at"), "new_source", "n_pages")
    same = plan.withColumns({"first_pos": F.min("pos").over(Window.partitionBy(WS, "source_id", "page_index")), "times": F.count("*").over(Window.partitionBy(WS, "source_id", "page_index"))})
    target = same.select(WS, F.col("pos").alias("at"), F.col("source_id").alias("old_source"), F.col("page_index").alias("old_index"), (F.col("first_pos") == F.col("pos")).alias("leads"), "times")
    j = plan.join(one.join(target, [WS, "at"]), WS, "left")
    mine = F.coalesce(F.col("source_id") == F.col("old_source"), F.lit(False))
    moves = mine & (F.col("times") > 1) & (F.col("page_index") == F.col("old_index")) & ((F.col("pos") == F.col("at")) != F.col("leads"))
    changed = {"source_id": F.when(mine, F.col("new_source")), "page_index": F.when(moves, F.col("n_pages"))}
    return j.select(*[changed[c].otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in plan.columns])


def validate_plan(plan: DataFrame, pages: DataFrame, slack: float = 0.25, most: int = 10_000) -> DataFrame:
    """Violations: duplicate ids, rotations that are no quarter turns, pages that the source lacks, sizes (width, height) off by more
    than slack, and pages beyond the largest number of a plan."""
    n = F.count("*").over(Window.partitionBy(WS, "page_id"))
    known = pages.select("source_id", "page_index", F.col("width").alias("real_w"), F.col("height").alias("real_h"), F.lit(True).alias("there"))
    j = plan.withColumn("n_ids", n).join(known, ["source_id", "page_index"], "left")
    off = (F.abs(F.col("width") - F.col("real_w")) > slack) | (F.abs(F.col("height") - F.col("real_h")) > slack)
    reason = F.when(F.col("n_ids") > 1, "duplicate_id").when(~F.col("rotation").isin(0, 90, 180, 270), "rotation").when(F.col("there").isNull(), "missing_page").when(off, "size").when(F.col("pos") >= most, "too_many_pages")
    return j.withColumn("reason", reason).where("reason is not null").select(WS, "pos", "reason")


def plan_digest(plan: DataFrame) -> DataFrame:
    """A digest of each plan's content, page ids left out."""
    row = F.concat_ws("|", F.lpad(F.col("pos").cast("string"), 10, "0"), "source_id", "page_index", "rotation")
    return plan.groupBy(WS).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(row)), "\n"), 256).alias("digest"))


def plan_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows that only one of two plans has, ids left out, with the side."""
    cols = [WS, "pos", "source_id", "page_index", "rotation"]
    a, b = before.select(*cols), after.select(*cols)
    return a.exceptAll(b).withColumn("side", F.lit("before")).unionByName(b.exceptAll(a).withColumn("side", F.lit("after")))


def overlay_diff(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """Pages whose overlays (workspace, pos, z: their order on the page, and columns; ids are not looked at) differ: workspace, pos and
    the least z at which they do. Where one side has fewer overlays, that is the first one that it lacks."""
    content = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)

    def listed(o: DataFrame, name: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(WS, "pos").orderBy("z")) - 1
        return o.select(WS, "pos", place.cast("long").alias("place"), content.alias(name))

    j = listed(before, "was").join(listed(after, "now"), [WS, "pos", "place"], "full_outer").where("not (was <=> now)")
    return j.groupBy(WS, "pos").agg(F.min("place").alias("first_difference"))


def authorize(plan: DataFrame, permissions: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """The first denial of each workspace by page order: permissions (source_id and a boolean for each right, null or no row allowing
    it); rules: the rights that the intent needs, with the reason to give, in order."""
    reason = F.coalesce(*[F.when(~F.col(right), why) for right, why in rules])
    j = plan.join(permissions, "source_id", "left").withColumn("reason", reason)
    first = F.min(F.when(F.col("reason").isNotNull(), F.struct("pos", "source_id", "reason"))).alias("d")
    return j.groupBy(WS).agg(first).select(WS, F.col("d.pos").alias("denied_at"), F.col("d.source_id").alias("denied_source"), F.col("d.reason").alias("reason"))


def combinable(plan: DataFrame, sources: DataFrame) -> DataFrame:
    """Whether a workspace's sources (source_id, assemble, context) all allow assembly and share one context."""
    return plan.select(WS, "source_id").distinct().join(sources, "source_id").groupBy(WS).agg((F.bool_and("assemble") & (F.count_distinct("context") <= 1)).alias("combinable"))
