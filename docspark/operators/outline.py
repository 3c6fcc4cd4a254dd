"""Outlines as pre-order lists with levels, links and reading history."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from docspark.functions.deal import dealt

DOC = "doc_id"
#: Stands for a level that is null: no item is above, below or beside it.
NO_LEVEL = np.iinfo(np.int64).max


def validate_outline(o: DataFrame) -> DataFrame:
    """Items that break the rules: first level 0, no level skipped on the way down, depth under 32, unique ids and, if o has
    color (an array of numbers or null), these finite and from 0 to 1."""
    by = Window.partitionBy(DOC).orderBy("idx")
    before = F.lag("level").over(by)
    reason = F.when(before.isNull() & (F.col("level") != 0), "first_level").when(F.col("level") > before + 1, "skipped_level").when(F.col("level") >= 32, "depth").when(F.count("*").over(Window.partitionBy(DOC, "item_id")) > 1, "duplicate_id")
    if "color" in o.columns:
        reason = reason.when(F.exists("color", lambda v: v.isNull() | F.isnan(v) | (v < 0) | (v > 1)), "color")
    return o.withColumn("reason", reason).where("reason is not null").select(DOC, "idx", "reason")


def _documents(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows, in order of their documents, in batches that hold every document whole."""
    joined = lambda some: pa.Table.from_batches(some).combine_chunks().to_batches()[0]
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            cut = int(_heads(batch)[-1])
            if cut:
                yield joined([*kept, batch.slice(0, cut)])
                kept = [batch.slice(cut)]
            elif kept and kept[0].column(DOC)[0].as_py() != batch.column(DOC)[0].as_py():
                yield joined(kept)
                kept = [batch]
            else:
                kept.append(batch)
    if kept:
        yield joined(kept)


def _by_document(rows: DataFrame, schema: StructType, run: Callable[[pa.RecordBatch], list], order: tuple[str, ...] = ("idx",)) -> DataFrame:
    """What run gives, column by column, for batches of whole documents, their rows in order. Rows are dealt and sorted once; a
    document's outline is all that Python holds of them."""
    names = schema.names

    def each(batches):
        for batch in _documents(batches):
            yield pa.RecordBatch.from_arrays(run(batch), names=names)

    return dealt(rows, DOC).sortWithinPartitions(DOC, *order).mapInArrow(each, schema)


def _new(values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)


def _heads(batch: pa.RecordBatch) -> np.ndarray:
    """The rows that documents begin at."""
    return _new(pc.dictionary_encode(batch.column(DOC), null_encoding="encode").indices.to_numpy())


def _numbers(batch: pa.RecordBatch, name: str, null: int = 0) -> np.ndarray:
    return pc.fill_null(batch.column(name).cast(pa.int64()), null).to_numpy(zero_copy_only=False)


def _spread(heads: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of n rows where its group begins and where it ends."""
    sizes = np.diff(np.append(heads, n))
    return np.repeat(heads, sizes), np.repeat(heads + sizes, sizes)


def _last(level: np.ndarray, k: int) -> np.ndarray:
    """For each row the last row of level k up to it, -1 if there is none."""
    return np.maximum.accumulate(np.where(level == k, np.arange(len(level)), -1))


def _parents(first: np.ndarray, level: np.ndarray, max_level: int) -> np.ndarray:
    """The last earlier row one level up in the document, -1 if there is none. One pass for each level that occurs."""
    out = np.full(len(level), -1)
    for k in np.unique(level[(level > 0) & (level <= max_level)]):
        mine = level == k
        out[mine] = _last(level, k - 1)[mine]
    return np.where(out < first, -1, out)


def _ends(stop: np.ndarray, level: np.ndarray, max_level: int) -> np.ndarray:
    """The first later row whose level is not deeper, or the end of the group."""
    out, n = stop.copy(), len(level)
    for k in np.unique(level[level < max_level]):
        mine = level == k
        after = np.append(np.minimum.accumulate(np.where(level <= k, np.arange(n), n)[::-1])[::-1][1:], n)
        out[mine] = np.minimum(after, stop)[mine]
    return out


def _grouped(first: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order that brings rows of one group (a row's number, -1 for those of the document without one) together, and in
    that order where the group begins and ends."""
    key = np.where(group < 0, -1 - first, group)
    order = np.argsort(key, kind="stable")
    return order, *_spread(_new(key[order]), len(order))


def _siblings(first: np.ndarray, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row its place among its siblings, and the rows of those before and after it, -1 if there is none."""
    order, begin, end = _grouped(first, parent)
    at = np.arange(len(order))
    place, before, after = (np.full(len(order), -1) for _ in range(3))
    place[order] = at - begin
    before[order[at > begin]] = order[at[at > begin] - 1]
    after[order[at < end - 1]] = order[at[at < end - 1] + 1]
    return place, before, after


def _shape(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row where its document begins and ends, and its level."""
    return *_spread(_heads(batch), batch.num_rows), _numbers(batch, "level", NO_LEVEL)


def _picked(values: pa.Array, rows: np.ndarray) -> pa.Array:
    """The values of these rows, null for -1."""
    return values.take(pa.array(rows, mask=rows < 0))


def _more(o: DataFrame, **columns) -> StructType:
    return StructType([*o.schema.fields, *[StructField(n, t) for n, t in columns.items()]])


def outline_parents(o: DataFrame, max_level: int = 32) -> DataFrame:
    """parent (idx of the last earlier item one level up), prev_sibling, next_sibling, first_child and last_child of each item of a valid outline.

    Documents are dealt and sorted once; their items are then looked at as arrays.
    """
    kind = o.schema["idx"].dataType

    def run(batch):
        first, _, level = _shape(batch)
        parent = _parents(first, level, max_level)
        _, before, after = _siblings(first, parent)
        eldest, youngest = (np.full(batch.num_rows, -1) for _ in range(2))
        child = np.flatnonzero(parent >= 0)
        eldest[parent[child[::-1]]], youngest[parent[child]] = child[::-1], child  # of equal places the last one stays
        return [*batch.columns, *[_picked(batch.column("idx"), r) for r in (parent, before, after, eldest, youngest)]]

    return _by_document(o, _more(o, parent=kind, prev_sibling=kind, next_sibling=kind, first_child=kind, last_child=kind), run)


def branch_end(o: DataFrame, max_level: int = 32) -> DataFrame:
    """branch_end: the first later idx whose level is not deeper, or one past the document's last."""

    def run(batch):
        _, stop, level = _shape(batch)
        idx = _numbers(batch, "idx")
        return [*batch.columns, pa.array(_places(idx, _ends(stop, level, max_level), stop), batch.column("idx").type)]

    return _by_document(o, _more(o, branch_end=o.schema["idx"].dataType), run)


def _places(idx: np.ndarray, rows: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The idx of these rows, one past the document's last for its end."""
    return np.where(rows < stop, idx[np.minimum(rows, len(idx) - 1)], idx[stop - 1] + 1)


def _mapped(value, pages: dict):
    """A value of an action with its pages mapped, None where one is gone. A page is an object that holds nothing but page."""
    if isinstance(value, list):
        return [_mapped(v, pages) if isinstance(v, (dict, list)) else v for v in value]
    if not isinstance(value, dict):
        return value
    if len(value) == 1 and "page" in value:
        new = pages.get(str(value["page"]))
        return None if new is None else {"page": type(value["page"])(new)}
    out = {k: _mapped(v, pages) if isinstance(v, (dict, list)) else v for k, v in value.items()}
    place = out.get("D")
    if out.get("S") == "GoTo" and not (isinstance(place, list) and place and isinstance(place[0], dict) and place[0].keys() == {"page"}):
        return None
    following = out.get("Next")
    if isinstance(following, list):
        following = out["Next"] = [v for v in following if v is not None]
    if "Next" in out and (following is None or following == []):
        del out["Next"]
    return out


#: A page in the text of an action: its name in quotes or its number.
PAGE_VALUE = r'"page"\s*:\s*(?:"([^"]*)"|(-?[0-9]+))'
_JSON = json.JSONEncoder(separators=(",", ":"), ensure_ascii=False)


def _map_actions(rows: pa.RecordBatch, pages: dict) -> pa.Array:
    def one(text):
        new = _mapped(json.loads(text), pages)
        return None if new is None else _JSON.encode(new)

    return pa.array([None if a is None else one(a) for a in rows.column("action").to_pylist()], pa.string())


def _aimed(o: DataFrame, aim, page_map: DataFrame) -> DataFrame:
    """o with _item (true), _name (the page that aim names), _new (its new page as text) and new_target, and if o has action a row
    without its columns for each further page that is named there and is still there, so that all of them come to the document."""
    columns, name = o.columns, aim.cast("string")
    if "action" in columns:
        names = F.array_distinct(F.transform(F.regexp_extract_all("action", F.lit(f"({PAGE_VALUE})"), F.lit(1)), lambda m: F.regexp_replace(m, r'^"page"\s*:\s*|"', "")))
        entry = lambda item, n: F.struct(F.lit(item).alias("item"), n.alias("name"))
        further = F.transform(F.filter(F.coalesce(names, F.array().cast("array<string>")), lambda n: ~n.eqNullSafe(F.col("_aim"))), lambda n: entry(False, n))
        o = o.withColumn("_aim", name).withColumn("_e", F.explode(F.concat(F.array(entry(True, F.col("_aim"))), further)))
        o = o.select(*[c if c in (DOC, "idx") else F.when(F.col("_e.item"), F.col(c)).alias(c) for c in columns], F.col("_e.item").alias("_item"), F.col("_e.name").alias("_name"))
    else:
        o = o.withColumn("_item", F.lit(True)).withColumn("_name", name)
    # items without an aim would all be dealt to one task
    o = o.withColumn("_deal", F.hash(F.coalesce("_name", F.col(DOC).cast("string"))))
    known = page_map.select(F.col("target").cast("string").alias("_known"), F.hash(F.col("target").cast("string")).alias("_known_deal"), "new_target", F.col("new_target").cast("string").alias("_new"))
    j = o.join(known, (F.col("_name") == F.col("_known")) & (F.col("_deal") == F.col("_known_deal")), "left").where("_item or _new is not null")
    return j.select(*columns, "_item", "_name", "_new", "new_target")


def _pages(batch: pa.RecordBatch) -> dict:
    there = batch.filter(pc.is_valid(batch.column("_new")))
    return dict(zip(there.column("_name").to_pylist(), there.column("_new").to_pylist()))


def remap_actions(o: DataFrame, page_map: DataFrame) -> DataFrame:
    """o (doc_id, idx, action: JSON text) with the pages in its actions through page_map (target, new_target).

    A page that is gone becomes null; an action that goes to such a page becomes null with all in it, and so does one among those
    that follow another, which then drops out of the list; a list without entries is left out. Only the pages that an outline's
    actions name come to it.
    """
    columns = o.columns

    def run(batch):
        rows = batch.filter(batch.column("_item"))
        action = _map_actions(rows, _pages(batch))
        return [action if c == "action" else rows.column(c) for c in columns]

    return _by_document(_aimed(o, F.lit(None), page_map).drop("new_target"), o.schema, run)


def remap_outline(o: DataFrame, page_map: DataFrame, max_level: int = 32) -> DataFrame:
    """Targets through page_map (target, new_target); an item whose page is gone stays, without target, if a descendant's is there.

    Items without a target stay as they are. If o has action (JSON text), an item without a target whose action goes to a page counts
    as aiming at that page, and what is left of the actions comes out (see remap_actions).
    """
    acts, aim = "action" in o.columns, F.col("target")
    if acts:
        there = F.when(F.get_json_object("action", "$.S") == "GoTo", F.get_json_object("action", "$.D[0].page"))
        aim = F.coalesce("target", there.cast(o.schema["target"].dataType))
    columns = [DOC, "idx", "level", "item_id", "target", *(["action"] if acts else [])]
    j = _aimed(o.select(*columns), aim, page_map).withColumn("target", F.when(F.col("target").isNotNull(), F.col("new_target"))).drop("new_target")

    def run(batch):
        rows = batch.filter(batch.column("_item"))
        _, stop, level = _shape(rows)
        lives = pc.or_(pc.is_null(rows.column("_name")), pc.is_valid(rows.column("_new"))).to_numpy(zero_copy_only=False)
        living = np.append(0, np.cumsum(lives))
        below = living[_ends(stop, level, max_level)] - living[1:]
        rows = rows.filter(pa.array(lives | (below > 0)))
        return [_map_actions(rows, _pages(batch)) if c == "action" else rows.column(c) for c in columns]

    return _by_document(j, j.select(*columns).schema, run)


def _paths(first: np.ndarray, level: np.ndarray, max_level: int) -> pa.Array:
    place, _, _ = _siblings(first, _parents(first, level, max_level))
    parts = []
    for k in np.unique(level[level < max_level]):
        last = _last(level, k)
        parts.append(pa.array(place[last], mask=(level <= k) | (last < first)).cast(pa.string()))
    path = pc.binary_join_element_wise(*parts, pa.array(place).cast(pa.string()), "/", null_handling="skip")
    return pc.if_else(pa.array(level == NO_LEVEL), pa.scalar(None, pa.string()), path)


def outline_paths(o: DataFrame, max_level: int = 32) -> DataFrame:
    """o with parent and path: the places among their siblings of the item's ancestors and of itself, from the top, such as 0/2/1."""

    def run(batch):
        first, _, level = _shape(batch)
        return [*batch.columns, _picked(batch.column("idx"), _parents(first, level, max_level)), _paths(first, level, max_level)]

    return _by_document(o, _more(o, parent=o.schema["idx"].dataType, path=StringType()), run)


def outline_diff(before: DataFrame, after: DataFrame, columns: list[str], max_level: int = 32) -> DataFrame:
    """Items in which two outlines of a document differ, ids and all else but `columns` left out: doc_id, path, side, change.

    change: content (the items at that path differ), only (the other side has no item there). Equal outlines give no row; an item
    moved among its siblings shows at both of its places. Both outlines of a document meet as rows of one sort.
    """
    content = F.unhex(F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)).alias("content")
    both = before.select(DOC, F.lit(False).alias("late"), "idx", "level", content).unionByName(after.select(DOC, F.lit(True).alias("late"), "idx", "level", content))

    def run(batch):
        first, _, level = _shape(batch)
        late = batch.column("late").to_numpy(zero_copy_only=False)
        side = _spread(_new(2 * first + late), batch.num_rows)[0]
        path = _paths(side, level, max_level)
        codes = pc.fill_null(path.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
        at = np.arange(batch.num_rows)
        # places that have no path meet nothing
        was, now = (pd.DataFrame({"doc": first[m], "path": np.where(codes[m] < 0, -1 - at[m], codes[m]), name: at[m]}) for m, name in ((~late, "was"), (late, "now")))
        j = was.merge(now, on=["doc", "path"], how="outer")
        was, now = (j[c].fillna(-1).to_numpy(np.int64) for c in ("was", "now"))
        alone = (was < 0) | (now < 0)
        same = pc.fill_null(pc.equal(_picked(batch.column("content"), was), _picked(batch.column("content"), now)), False).to_numpy(zero_copy_only=False)
        was, now = was[alone | ~same], now[alone | ~same]
        rows = np.concatenate([was[was >= 0], now[now >= 0]])
        only = np.concatenate([now[was >= 0] < 0, was[now >= 0] < 0])
        named = lambda flags, yes, no: pc.if_else(pa.array(flags, pa.bool_()), yes, no)
        return [batch.column(DOC).take(pa.array(rows)), path.take(pa.array(rows)), named(late[rows], "after", "before"), named(only, "only", "content")]

    schema = StructType([before.schema[DOC], *[StructField(n, StringType()) for n in ("path", "side", "change")]])
    return _by_document(both, schema, run, ("late", "idx"))


def outline_counts(o: DataFrame, max_level: int = 32) -> DataFrame:
    """descendants of each item that are shown when it is open: those without a closed item in between; negative for a closed item.

    o has closed (boolean). Each item lies in the region of its nearest closed ancestor; in a region, an open item's descendants
    are the rows up to the next one that is not deeper, and a closed item shows the region that it heads.
    """

    def run(batch):
        first, _, level = _shape(batch)
        closed = batch.column("closed").to_numpy(zero_copy_only=False)
        region = np.full(batch.num_rows, -1)
        for k in np.unique(level[level < max_level])[::-1]:
            last = _last(level, k)
            head = (region < 0) & (level > k) & (level != NO_LEVEL) & (last >= first) & closed[last]
            region[head] = last[head]
        order, _, end = _grouped(first, region)
        shown = np.zeros(batch.num_rows, np.int64)
        shown[order] = _ends(end, level[order], max_level) - np.arange(batch.num_rows) - 1
        inside = np.bincount(region[region >= 0], minlength=batch.num_rows)
        return [batch.column(DOC), batch.column("idx"), pa.array(np.where(closed, -inside, shown), pa.int64())]

    rows = o.select(DOC, "idx", "level", F.coalesce("closed", F.lit(False)).alias("closed"))
    return _by_document(rows, StructType([o.schema[DOC], o.schema["idx"], StructField("descendants", LongType())]), run)


def edit_outline(o: DataFrame, edits: DataFrame, max_level: int = 32) -> DataFrame:
    """Outlines after one edit each: doc_id, idx, level, item_id, title, target, numbered anew.

    o: doc_id, idx, level, item_id, title, target. edits: doc_id, at (idx of the item), op, new_id, new_title, new_target. add puts
    a child at the end of the item's branch (at the outline's end where at is null), retitle and retarget change the item, remove takes
    its branch away, up and down swap its branch with that of the sibling before or after. Edits that cannot be done change
    nothing: an item that is not there, a blank title, a child below the last level, no such sibling, several edits of a document.
    The edit comes to its document as one more row.
    """
    columns = ["idx", "level", "item_id", "title", "target"]
    asked = edits.select(DOC, F.col("at").cast("long").alias("idx"), F.lit(None).cast(o.schema["level"].dataType).alias("level"), F.col("new_id").alias("item_id"), F.trim("new_title").alias("title"), F.col("new_target").alias("target"), F.coalesce("op", F.lit("")).alias("op"))
    rows = o.select(DOC, F.col("idx").cast("long").alias("idx"), *columns[1:], F.lit(None).cast("string").alias("op")).unionByName(asked)

    def run(batch):
        edit = pc.is_valid(batch.column("op")).to_numpy(zero_copy_only=False)
        both, asks = np.flatnonzero(~edit), np.flatnonzero(edit)
        doc = np.repeat(np.arange(len(_heads(batch))), np.diff(np.append(_heads(batch), batch.num_rows)))
        once = np.bincount(doc[asks], minlength=doc[-1] + 1) == 1
        mine = np.full(doc[-1] + 1, -1)  # the only edit of a document
        mine[doc[asks]] = asks
        mine[~once] = -1
        items = batch.take(pa.array(both))
        if not items.num_rows:
            return [batch.column(c).slice(0, 0) for c in (DOC, *columns)]
        first, stop, level = _shape(items)
        idx = _numbers(items, "idx")
        _, before, after = _siblings(first, _parents(first, level, max_level))
        ends = _places(idx, _ends(stop, level, max_level), stop)
        ask = mine[doc[both]]  # of each item
        ops, ats = np.array(batch.column("op").fill_null("").to_pylist(), object), _numbers(batch, "idx")
        given = pc.is_valid(batch.column("idx")).to_numpy(zero_copy_only=False)
        titled = pc.fill_null(pc.greater(pc.utf8_length(batch.column("title")), 0), False).to_numpy(zero_copy_only=False)
        spot = np.full(batch.num_rows, -1)  # the item that an edit is about
        hit = (ask >= 0) & given[ask] & (idx == ats[ask])
        spot[ask[hit]] = np.flatnonzero(hit)
        head = np.full(batch.num_rows, -1)  # the first item of the edit's outline
        head[ask[ask >= 0]] = first[ask >= 0]
        todo = np.unique(ask[ask >= 0])
        todo = todo[(spot[todo] >= 0) | ((ops[todo] == "add") & ~given[todo])]
        todo = todo[~np.isin(ops[todo], ["add", "retitle"]) | titled[todo]]
        depth = np.where(spot >= 0, level[spot], -1) + 1
        todo = todo[(ops[todo] != "add") | (depth[todo] < max_level)]
        # the branch [low, middle) goes behind [middle, high); one that is removed is [low, middle)
        low, middle, high = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
        at = lambda e: spot[e]
        up = todo[ops[todo] == "up"]
        up = up[before[at(up)] >= 0]
        low[up], middle[up], high[up] = idx[before[at(up)]], idx[at(up)], ends[at(up)]
        down = todo[ops[todo] == "down"]
        down = down[after[at(down)] >= 0]
        low[down], middle[down], high[down] = idx[at(down)], ends[at(down)], ends[after[at(down)]]
        out = todo[ops[todo] == "remove"]
        low[out], middle[out] = idx[at(out)], ends[at(out)]
        is_ = lambda some: np.isin(ask, some)
        moves, inner, outer = is_(np.concatenate([up, down])), (idx >= low[ask]) & (idx < middle[ask]), (idx >= middle[ask]) & (idx < high[ask])
        key = np.where(moves & inner, idx + high[ask] - middle[ask], np.where(moves & outer, idx + low[ask] - middle[ask], idx))
        kept = np.flatnonzero(~(is_(out) & inner))
        adds = todo[ops[todo] == "add"]
        add_key = np.where(given[adds], ends[at(adds)], idx[stop[head[adds]] - 1] + 1)
        taken = np.concatenate([both[kept], adds])
        order = np.lexsort((np.append(np.ones(len(kept)), np.zeros(len(adds))), np.append(key[kept], add_key), doc[taken]))
        new = taken[order]
        source = lambda op: np.append(np.where(hit & is_(todo[ops[todo] == op]), ask, both)[kept], adds)[order]
        deep = pa.array(np.append(level[kept], depth[adds])[order], mask=np.append(level[kept] == NO_LEVEL, np.zeros(len(adds), bool))[order]).cast(batch.column("level").type)
        picked = lambda c, rows: batch.column(c).take(pa.array(rows))
        number = np.arange(len(new)) - _spread(_new(doc[new]), len(new))[0]
        return [picked(DOC, new), pa.array(number, pa.int64()), deep, picked("item_id", new), picked("title", source("retitle")), picked("target", source("retarget"))]

    return _by_document(rows, rows.select(DOC, *columns).schema, run)


def merge_outlines(outlines: DataFrame) -> DataFrame:
    """Outlines of many documents (workspace_id, slot, ...) one after the other, and whether an id repeats."""
    by = Window.partitionBy("workspace_id").orderBy("slot", "idx")
    return outlines.withColumn("new_idx", (F.row_number().over(by) - 1).cast("long")).withColumn("repeats", F.count("*").over(Window.partitionBy("workspace_id", "item_id")) > 1)


def extract_links(pages: DataFrame, html: str = "html") -> DataFrame:
    """A row for each link of each page: page_id, ordinal, href, name (the text of the link, tags taken out and blanks collapsed).

    Tag and attribute names in either case; the address in double quotes, single quotes or none. A link that is not closed has no name.
    """
    anchor = r'(?is)(<a\s(?:[^>"\']|"[^"]*"|\'[^\']*\')*?>)((?:(?!</?a[\s>]).)*+)(</a\s*>)?'
    all_of = lambda k: F.regexp_extract_all(html, F.lit(anchor), F.lit(k))
    each = pages.select("page_id", F.filter(F.arrays_zip(all_of(1).alias("tag"), all_of(2).alias("inner"), all_of(3).alias("end")), lambda a: a["tag"].rlike(r"(?i)[\s\"']href\s*=")).alias("found"))
    each = each.select("page_id", F.posexplode("found").alias("ordinal", "a"))
    value = lambda k: F.regexp_extract("a.tag", r'(?is)[\s"\']href\s*=\s*(?:"([^"]*)"|\'([^\']*)\'|([^\s>"\']+))', k)
    name = F.trim(F.regexp_replace(F.regexp_replace("a.inner", "(?s)<[^>]*>", ""), r"\s+", " "))
    return each.select("page_id", F.col("ordinal").cast("long").alias("ordinal"), F.concat(value(1), value(2), value(3)).alias("href"), F.when(F.col("a.end") != "", name).alias("name"))


def remap_links(links: DataFrame, plan: DataFrame) -> DataFrame:
    """links (source_id, page_index, to_index) for each place of their page in the plan: to this copy of it, else to the first
    place of the target in the workspace; links to pages that are gone are dropped."""
    places = plan.select("workspace_id", "pos", "source_id", "page_index")
    first = plan.groupBy("workspace_id", "source_id", F.col("page_index").alias("to_index")).agg(F.min("pos").alias("first_pos"))
    j = places.join(links, ["source_id", "page_index"]).join(first, ["workspace_id", "source_id", "to_index"])
    return j.select("workspace_id", "pos", "ordinal", F.when(F.col("to_index") == F.col("page_index"), F.col("pos")).otherwise(F.col("first_pos")).alias("to_pos"))


def dangling_links(links: DataFrame, urls: DataFrame) -> DataFrame:
    """Links whose target is not among urls (url)."""
    return links.join(urls.select(F.col("url").alias("href")).distinct(), "href", "left_anti")


def reading_history(nav: DataFrame, pages: DataFrame, limit: int = 100) -> DataFrame:
    """The last `limit` locations of each session, those left out that repeat the one before (page and zoom equal, x and y moved under
    0.5); of these the ones on pages (page) that are still there."""
    by = Window.partitionBy("session_id").orderBy("ts", "event_id")
    moved = lambda c: F.abs(F.lag(c).over(by) - F.col(c)) >= 0.5
    same = (F.lag("page").over(by) == F.col("page")) & (F.lag("zoom").over(by) == F.col("zoom")) & ~moved("x") & ~moved("y")
    kept = nav.withColumn("same", F.coalesce(same, F.lit(False))).where("not same")
    return kept.withColumn("back", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("ts"), F.desc("event_id"))).cast("long")).where(F.col("back") <= limit).drop("same").join(pages.select("page").distinct(), "page", "left_semi")
