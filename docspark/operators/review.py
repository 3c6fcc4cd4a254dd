"""Comments, form fields and document properties."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def review_list(plan: DataFrame, comments: DataFrame, added: DataFrame) -> DataFrame:
    """Comments (source_id, page_index, annotation_index, text) at each place of their page, and comments and highlights added to a place
    (workspace_id, pos, annotation_index, kind, text), with a title also where the text is blank."""
    old = plan.join(comments, ["source_id", "page_index"]).select("workspace_id", "pos", "annotation_index", F.lit("native").alias("kind"), "text")
    both = old.unionByName(added.where("kind in ('comment', 'highlight')").select("workspace_id", "pos", "annotation_index", "kind", "text"))
    title = F.coalesce(F.nullif(F.trim("text"), F.lit("")), F.when(F.col("kind") == "highlight", "Highlight").otherwise("Empty comment"))
    return both.select("workspace_id", "pos", "annotation_index", "kind", title.alias("title"))


def comment_eligibility(comments: DataFrame) -> DataFrame:
    """Why a comment cannot be edited, by precedence: signature, locked (128), hidden (2), rich, reply."""
    bit = lambda n: F.col("flags").bitwiseAND(n) != 0
    return comments.withColumn("reason", F.when(F.col("is_signature"), "signature").when(bit(128), "locked").when(bit(2), "hidden").when(F.col("is_rich"), "rich").when(F.col("reply_to").isNotNull(), "reply"))


def comments_with_replies(comments: DataFrame, doc: str = "conv_id", index: str = "turn") -> DataFrame:
    """Comments that others reply to; these are not deletable."""
    targets = comments.where("reply_to is not null").select(doc, F.col("reply_to").alias(index)).distinct()
    return comments.join(targets, [doc, index], "left_semi")


def edit_comments(comments: DataFrame, edits: DataFrame, keys: list[str]) -> DataFrame:
    """comments with new texts where the expected text is the current one; applied tells which. Two edits of a comment change nothing."""
    one = edits.groupBy(*keys).agg(F.count("*").alias("n"), F.min("expected_text").alias("expected_text"), F.min("new_text").alias("new_text")).where("n = 1").drop("n")
    j = comments.join(one, keys, "left")
    fits = F.coalesce(F.col("expected_text") == F.col("text"), F.lit(False))
    return j.withColumn("applied", fits).withColumn("text", F.when(fits, F.col("new_text")).otherwise(F.col("text"))).drop("expected_text", "new_text")


def delete_comments(comments: DataFrame, deletes: DataFrame, keys: list[str]) -> DataFrame:
    """comments without those whose delete (keys, expected_text) fits and that nobody replies to."""
    kept = comments_with_replies(comments, *keys).select(*keys, F.lit(True).alias("has_replies"))
    j = comments.join(deletes.select(*keys, "expected_text").dropDuplicates(keys), keys, "left").join(kept, keys, "left")
    return j.where("expected_text is null or expected_text <> text or has_replies").drop("expected_text", "has_replies")


def form_inventory(widgets: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row per document and field: name, value as text, kind and whether it is empty."""
    long = widgets.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value"), F.lit("choice" if dict(widgets.dtypes)[c] == "int" else "text").alias("kind")) for c in columns])).alias("f"))
    return long.select(key, "f.name", "f.value", "f.kind", F.coalesce(F.length(F.trim("f.value")) == 0, F.lit(True)).alias("empty"))


def fill_forms(fields: DataFrame, requests: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(fields with accepted answers, rejected requests with the reason): the expected value must be the current one, a text
    single-line, a choice among the options, and no other request may ask for the same field."""
    j = requests.withColumn("asked", F.count("*").over(Window.partitionBy(*keys))).join(fields.select(*keys, "value", "kind", "options"), keys, "left")
    reason = F.when(F.col("asked") > 1, "repeated").when(F.col("kind").isNull(), "missing").when(~F.col("expected").eqNullSafe(F.col("value")), "stale").when((F.col("kind") == "text") & F.col("answer").rlike("[\r\n]"), "line_break").when((F.col("kind") == "choice") & ~F.array_contains("options", F.col("answer")), "option")
    j = j.withColumn("reason", reason)
    accepted = j.where("reason is null").select(*keys, "answer")
    filled = fields.join(accepted, keys, "left").withColumn("value", F.coalesce("answer", "value")).drop("answer")
    return filled, j.where("reason is not null").select(*keys, "answer", "reason")


#: Bits of a field's own flags and of its widget's.
READ_ONLY, REQUIRED, MULTILINE, PASSWORD, EDITABLE, FILE, SEVERAL, RICH = 1 << 0, 1 << 1, 1 << 12, 1 << 13, 1 << 18, 1 << 20, 1 << 21, 1 << 25
INVISIBLE, HIDDEN, NO_VIEW, LOCKED = 1 << 0, 1 << 1, 1 << 5, 1 << 6
KINDS = {2: "checkbox", 3: "radio", 4: "combo", 5: "list", 6: "text", 7: "signature"}


def form_states(widgets: DataFrame) -> DataFrame:
    """What can be done with each widget: widgets (label, name, native_kind, field_flags, widget_flags and whatever else) with kind, label
    (the name where it is empty), read_only, required, multiline, password, multi_select, editable, visible and reason.

    reason, why it cannot be filled: read_only, hidden (or locked), kind (neither toggle, choice nor text), content (files, rich text).
    """
    field = lambda bit: F.col("field_flags").bitwiseAND(F.lit(bit)) != 0
    widget = lambda bits: F.col("widget_flags").bitwiseAND(F.lit(bits)) != 0
    native = F.col("native_kind")
    kind = reduce(lambda c, k: c.when(native == k, KINDS[k]), list(KINDS)[1:], F.when(native == 2, KINDS[2])).otherwise("unsupported")
    reason = (
        F.when(field(READ_ONLY), "read_only").when(widget(INVISIBLE | HIDDEN | NO_VIEW | LOCKED), "hidden").when(~F.coalesce(native.between(2, 6), F.lit(False)), "kind")
        .when((native == 6) & (field(FILE) | field(RICH)), "content")
    )
    flags = {"read_only": field(READ_ONLY), "required": field(REQUIRED), "multiline": (native == 6) & field(MULTILINE), "password": (native == 6) & field(PASSWORD), "multi_select": (native == 5) & field(SEVERAL), "editable": (native == 4) & field(EDITABLE)}
    return widgets.withColumns({**flags, "kind": kind, "label": F.coalesce(F.nullif("label", F.lit("")), "name"), "visible": ~widget(INVISIBLE | HIDDEN | NO_VIEW), "reason": reason})


def fill_fields(fields: DataFrame, requests: DataFrame, keys: list[str], longest: int = 32_768) -> tuple[DataFrame, DataFrame]:
    """(fields with accepted answers, rejected requests with why): fields as form_states gives them, with options and value, a struct of
    text, checked and indices of which one is set; requests: keys, expected and answer, such structs.

    An answer is taken if its field is there and may be filled, no other request names it, expected is the current value (line
    ends aside) and the answer fits the field's kind: a text without NUL, of at most `longest` UTF-16 units and one line unless
    the field is multiline; a toggle, but a radio button is not switched off; rows of a choice that rise, lie among the options, are at
    most one unless it takes several and at least one in a combo. Reasons, in this order: repeated, missing, that of the field,
    stale, type, text, line_break, radio, rows.
    """
    one_line = lambda c: F.regexp_replace(c, "\r\n?", "\n")
    even = lambda c: F.struct(one_line(F.col(c)["text"]).alias("text"), F.col(c)["checked"].alias("checked"), F.col(c)["indices"].alias("indices"))
    known = fields.select(*keys, F.col("kind").alias("f_kind"), F.col("reason").alias("f_reason"), F.col("value").alias("f_value"), F.col("options").alias("f_options"), F.col("multiline").alias("f_multiline"), F.col("multi_select").alias("f_multi"))
    j = requests.withColumn("asked", F.count("*").over(Window.partitionBy(*keys))).join(known, keys, "left").withColumn("new", even("answer"))
    sort = lambda c: F.when(c["text"].isNotNull(), "text").when(c["checked"].isNotNull(), "toggle").when(c["indices"].isNotNull(), "choice")
    new, rows = F.col("new"), F.col("new")["indices"]
    choice = F.col("f_kind").isin("combo", "list")
    fits = ((sort(new) == "choice") & choice) | ((sort(new) == sort(F.col("f_value"))) & (sort(new) != "choice"))
    units = F.length(F.encode(new["text"], "UTF-16BE")) / 2
    wrong_rows = F.exists(rows, lambda i: (i < 0) | (i >= F.size("f_options"))) | (F.array_sort(F.array_distinct(rows)) != rows) | (~F.col("f_multi") & (F.size(rows) > 1)) | ((F.col("f_kind") == "combo") & (F.size(rows) == 0))
    reason = (
        F.when(F.col("asked") > 1, "repeated").when(F.col("f_kind").isNull(), "missing").when(F.col("f_reason").isNotNull(), F.col("f_reason")).when(~even("expected").eqNullSafe(F.col("f_value")), "stale")
        .when(~F.coalesce(fits, F.lit(False)), "type").when(new["text"].contains("\0") | (units > longest), "text").when(new["text"].contains("\n") & ~F.col("f_multiline"), "line_break")
        .when((F.col("f_kind") == "radio") & ~new["checked"], "radio").when((sort(new) == "choice") & wrong_rows, "rows")
    )
    j = j.withColumn("why", reason)
    filled = fields.join(j.where("why is null").select(*keys, "new"), keys, "left").withColumn("value", F.coalesce("new", "value")).drop("new")
    return filled, j.where("why is not null").select(*keys, "answer", F.col("why").alias("reason"))


def propagate_shared_fields(fields: DataFrame, accepted: DataFrame, doc: str, name: str = "name") -> DataFrame:
    """All widgets of a field take its accepted value."""
    return fields.join(accepted.select(doc, name, F.col("value").alias("new_value")), [doc, name], "left").withColumn("value", F.coalesce("new_value", "value")).drop("new_value")


def effective_names(nodes: DataFrame, max_depth: int = 32) -> DataFrame:
    """Dotted full names from (doc_id, node_id, parent_id, name), and whether one repeats in its document.

    Each round puts the ancestor's name so far before one's own and goes on from that ancestor's ancestor, so that a depth of
    n needs about log n joins.
    """
    names = nodes.select("doc_id", "node_id", F.col("parent_id").alias("up"), F.col("name").alias("full_name"))
    for _ in range(max(1, (max_depth - 1).bit_length())):
        above = names.select("doc_id", F.col("node_id").alias("up"), F.col("up").alias("next"), F.col("full_name").alias("upper"))
        names = names.join(above, ["doc_id", "up"], "left").select("doc_id", "node_id", F.col("next").alias("up"), F.concat_ws(".", "upper", "full_name").alias("full_name"))
    return names.drop("up").withColumn("repeats", F.count("*").over(Window.partitionBy("doc_id", "full_name")) > 1)


def resolve_choices(fields: DataFrame) -> DataFrame:
    """The options that requested rows of a choice field pick: fields (options, rows, multiple) with picked and reason.

    Rows must rise strictly, lie in range, and be at most one unless the field takes several.
    """
    rising = F.array_sort(F.array_distinct("rows")) == F.col("rows")
    inside = F.forall("rows", lambda i: (i >= 0) & (i < F.size("options")))
    reason = F.when(~rising, "order").when(~inside, "range").when((F.size("rows") > 1) & ~F.col("multiple"), "several")
    f = fields.withColumn("reason", reason)
    return f.withColumn("picked", F.when(F.col("reason").isNull(), F.transform("rows", lambda i: F.get("options", i))))


def field_removal_impact(fields: DataFrame, doc: str, name: str, page: str) -> DataFrame:
    """Widgets and pages that go with each field."""
    return fields.groupBy(doc, name).agg(F.count("*").alias("widgets"), F.array_join(F.array_sort(F.collect_set(page)), ",").alias("pages"))


def metadata_merge(primary: DataFrame, secondary: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Each field from the first source that has it; conflicts lists the fields on which both differ."""
    b = secondary.select(key, *[F.col(f).alias(f"{f}__b") for f in fields])
    conflicts = F.array_join(F.array_compact(F.array(*[F.when(F.col(f) != F.col(f"{f}__b"), f) for f in fields])), ",")
    return primary.join(b, key, "full_outer").select(key, *[F.coalesce(f, f"{f}__b").alias(f) for f in fields], conflicts.alias("conflicts"))


def metadata_edit(meta: DataFrame, edits: DataFrame, key: str, fields: list[str], longest: int = 16 * 1024) -> DataFrame:
    """meta after edits (key, op, clear, fields) and error. op update sets the given fields (an empty text clears one) and, with clear,
    empties the others; remove empties all. Errors, which change nothing: nothing_given, text (characters that XML lacks, or too long)."""
    e = edits.select(key, "op", "clear", *[F.col(f).alias(f"{f}__e") for f in fields])
    given = [F.col(f"{f}__e") for f in fields]
    bad = reduce(lambda a, b: a | b, [F.coalesce((F.octet_length(g) > longest) | g.rlike(r"[^\t\n\r\x{20}-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]"), F.lit(False)) for g in given])
    update = F.col("op") == "update"
    error = F.when(update & F.coalesce(*given).isNull(), "nothing_given").when(update & bad, "text")
    j = meta.join(e, key, "left").withColumn("error", error)
    new = [
        F.when(F.col("op").isNull() | F.col("error").isNotNull(), F.col(f)).when(F.col("op") == "remove", None).when(g.isNotNull(), F.nullif(g, F.lit(""))).when(~F.coalesce("clear", F.lit(False)), F.col(f)).alias(f)
        for f, g in zip(fields, given)
    ]
    return j.select(key, *new, "error")


def metadata_of_composition(plan: DataFrame, meta: DataFrame, fields: list[str]) -> DataFrame:
    """The metadata of each workspace's first source."""
    first = plan.groupBy("workspace_id").agg(F.min_by("source_id", "pos").alias("source_id"))
    return first.join(meta, "source_id", "left").select("workspace_id", "source_id", *fields)
