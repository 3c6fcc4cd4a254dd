"""Literal search over pages of text."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions.fold import let, scan
from docspark.functions.text import BLANKS, casefold, collapse_whitespace, folds

WORD = r"[\p{L}\p{M}\p{N}\p{Pc}\u200C\u200D]"
#: Set between the letters that one character folds to: matches may not begin or end beside it.
JOINT = "\uFDD0"


@dataclass(frozen=True)
class Options:
    match_case: bool = False
    whole_words: bool = False


@cache
def _spellings() -> dict[str, str]:
    """For each folded character all characters that fold to it alone, itself among them."""
    out: dict[str, str] = {}
    for c, f in folds().items():
        if len(f) == 1:
            out[f] = out.get(f, f) + c
    return out


def _quoted(text: str) -> str:
    return re.sub(r"([^\w])", r"\\\1", text)


def _words(query: str) -> list[str]:
    words = [w for w in re.split(f"[{BLANKS}]+", query) if w]
    if not words:
        raise ValueError("the query is blank")
    return words


def expands(query: str, opts: Options = Options()) -> bool:
    """Whether some character folds to several letters that the folded query holds together."""
    words = [w.casefold() for w in _words(query)]
    return not opts.match_case and any(f in w for f in folds().values() if len(f) > 1 for w in words)


def pattern(query: str, opts: Options = Options()) -> str:
    """The query as a Java regular expression over target(text): runs of blanks are alike, whole words end where no word goes on."""
    words = _words(query)
    if opts.match_case:
        body = f"[{BLANKS}]+".join(map(_quoted, words))
    elif expands(query, opts):
        letters = [[_quoted(chr(ord(c) + 1) if c == JOINT else c) for c in w.casefold()] for w in words]
        body = f"(?<!{JOINT}){f'[{BLANKS}]+'.join(f'{JOINT}?'.join(w) for w in letters)}(?!{JOINT})"
    else:
        one = lambda c: f"[{''.join(map(_quoted, _spellings()[c]))}]" if c in _spellings() else _quoted(c)
        body = f"[{BLANKS}]+".join("".join(map(one, w.casefold())) for w in words)
    if opts.whole_words:
        body = f"(?<!{WORD})(?<!{WORD}['’])(?={WORD}){body}(?<={WORD})(?!{WORD})(?!['’]{WORD})"
    return body


def target(text: Column, query: str, opts: Options = Options()) -> Column:
    """What the query's pattern is matched with: the text, or its case folding where a character may fold to several letters."""
    return casefold(text, JOINT) if expands(query, opts) else text


def search_count(pages: DataFrame, query: str, opts: Options = Options(), text: str = "text") -> DataFrame:
    """pages with n_matches and has_text. Letters match by full case folding: ß and ss, the ligature and fi are alike, but a match
    never takes a part of what one character folds to."""
    found = F.regexp_count(target(F.col(text), query, opts), F.lit(pattern(query, opts)))
    return pages.withColumn("n_matches", found.cast("long")).withColumn("has_text", F.length(collapse_whitespace(F.col(text))) > 0)


def search_matches(pages: DataFrame, query: str, opts: Options = Options(), text: str = "text") -> DataFrame:
    """One row per match that does not overlap an earlier one: the page's other columns, ordinal, start, stop (code points of the text
    as it is), matched. Matches as in search_count; linear in the text and in the number of matches."""
    return _rows(pages, pattern(query, opts), text, target(F.col(text), query, opts) if expands(query, opts) else None)


def _rows(pages: DataFrame, body: str, text: str, folded: Column | None = None) -> DataFrame:
    """A row for each match of a pattern in the text, or in its folding with joints."""
    keys = [c for c in pages.columns if c != text]
    rows = pages.select(*keys, *([F.col(text).alias("_text")] if folded is not None else []), (F.col(text) if folded is None else folded).alias("_in"))
    rows = rows.withColumn("_found", F.regexp_extract_all("_in", F.lit(f"({body})"), F.lit(1))).where(F.size("_found") > 0)
    # a character that folds to k letters has k - 1 joints beside them: two characters too many for each joint
    length = F.length if folded is None else lambda c: 2 * F.length(F.replace(c, F.lit(JOINT), F.lit(""))) - F.length(c)
    steps = F.arrays_zip(F.transform(F.split("_in", body, -1), length).alias("gap"), F.transform("_found", length).alias("taken"))
    go = lambda at, x: let(at + x["gap"], lambda b: F.struct((b + x["taken"]).alias("s"), F.struct(b.alias("start"), (b + x["taken"]).alias("stop")).alias("o")))
    spans = scan(F.slice(steps, F.lit(1), F.size("_found")), F.lit(0), go, "struct<start: int, stop: int>")
    if folded is None:
        return _exploded(rows, keys, F.arrays_zip(spans.alias("at"), F.col("_found").alias("matched")))
    # the folded match is not what stands in the text
    shown = lambda letters: F.transform(spans, lambda m: F.struct(m.alias("at"), F.array_join(F.slice(letters, m["start"] + 1, m["stop"] - m["start"]), "").alias("matched")))
    return _exploded(rows, keys, let(F.split("_text", ""), shown))


def _exploded(rows: DataFrame, keys: list[str], found: Column) -> DataFrame:
    rows = rows.select(*keys, F.posexplode(found).alias("ordinal", "m"))
    return rows.select(*keys, F.col("ordinal").cast("long").alias("ordinal"), F.col("m.at.start").cast("long").alias("start"), F.col("m.at.stop").cast("long").alias("stop"), F.col("m.matched").alias("matched"))


def search_whole_word(pages: DataFrame, query: str, match_case: bool = False, text: str = "text") -> DataFrame:
    """search_count of whole words; apostrophes inside words join them."""
    return search_count(pages, query, Options(match_case, True), text)


def search_limit(matches: DataFrame, keys: list[str], n: int = 1000) -> DataFrame:
    """The first n matches of each page; truncated only where a further one exists."""
    page = Window.partitionBy(*keys)
    return matches.withColumn("rank", F.row_number().over(page.orderBy("start"))).withColumn("truncated", F.max("rank").over(page) > n).where(F.col("rank") <= n).drop("rank")


def search_union(native: DataFrame, added: DataFrame, id_cols: list[str]) -> DataFrame:
    """Matches of page text and of added text together, with their scope and a match id."""
    both = native.withColumn("scope", F.lit("page")).unionByName(added.withColumn("scope", F.lit("overlay")))
    return both.withColumn("match_id", F.concat_ws(":", *id_cols, "scope", "start"))


def _rolled(text: str, k: int) -> np.ndarray:
    """A hash of each group of k characters in a row."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
    h = np.full(max(len(codes) - k + 1, 0), k, np.uint64)
    for j in range(k):
        h = (h ^ codes[j : j + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def _letters_hash(texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None or not t else int(_rolled(t, len(t))[0]) for t in texts], dtype="Int64")


def _letter_groups(docs: DataFrame, anchored: DataFrame, lengths: list[int], bits: int) -> DataFrame:
    """(doc_id, h) for the groups of characters in docs (doc_id, body) that may be anchors. The anchors' bitmap is all that is sent."""
    slots = 1 << bits
    seen = anchored.where("k < 0").groupBy(F.shiftright(F.pmod("h", F.lit(slots)), 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(h, {slots}) % 64 as int))")).alias("mask"))
    words = np.zeros(slots >> 6, np.int64)
    for r in seen.collect():  # at most 2**bits / 64 numbers
        words[r.word] = r.mask
    bitmap = np.unpackbits(words.view(np.uint8), bitorder="little").astype(bool)

    def run(batches):
        for batch in batches:
            found = []
            for text in batch.column("body").to_pylist():
                each = [h[bitmap[h & (slots - 1)]] for h in (_rolled(text, k) for k in lengths)]
                found.append(np.unique(np.concatenate(each)))
            sizes = [len(f) for f in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(np.repeat(np.arange(len(sizes)), sizes))), pa.array(np.concatenate(found), pa.int64())], names=["doc_id", "h"])

    # dealt while it is still text: a table of few files would be gone through in as few tasks
    dealt = docs.repartition("doc_id").select("doc_id", F.lower("body").alias("body"))
    return dealt.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, h long")


def search_many(docs: DataFrame, queries: DataFrame, anchor: int = 4, text: str = "text", bits: int = 20) -> DataFrame:
    """(doc_id, item_id) where the document contains the query's text, whatever stands round it: equi-join on an anchor, then an exact test.

    A query's anchor are its inner words: its first and last word may be parts of the document's words; those between are whole
    ones, for the query itself has blanks on both sides of them. A query without inner words is anchored by its first `anchor`
    characters, at whatever place of the document. A bitmap of the queries' anchors (2**bits bits) drops a document's other word
    and character groups before they become rows. A document meets its candidates as one array, so that it is neither copied nor
    lower-cased for each. An empty query is in every document.
    """
    words = lambda c: F.split(F.lower(c), "[ \n\t]+")
    q = queries.where("text is not null").select("item_id", F.col("text").alias("needle")).withColumn("w", words(F.col("needle"))).withColumn("k", F.least(F.lit(anchor), F.size("w") - 2))
    q = q.withColumn("k", F.when(F.col("k") > 0, F.col("k")).otherwise(-F.least(F.lit(anchor), F.length(F.lower("needle")))))
    inner = F.xxhash64(F.array_join(F.slice("w", F.lit(2), F.greatest("k", F.lit(1))), " "), "k")
    letters = F.pandas_udf(_letters_hash, "long")(F.when(F.col("k") < 0, F.substring(F.lower("needle"), F.lit(1), -F.col("k"))))
    q = q.withColumn("letters", letters).withColumn("h", F.when(F.col("k") > 0, inner).otherwise(F.col("letters")))
    anchored, empty = q.where("k <> 0").select("item_id", "needle", "k", "h"), q.where("k = 0").select("item_id")
    d = docs.select("doc_id", F.col(text).alias("body")).where("body is not null")
    lengths = sorted(r.k for r in q.select("k").distinct().collect())  # at most twice `anchor` numbers and 0
    everywhere = d.select("doc_id").join(empty) if 0 in lengths else None  # that is the result itself
    lengths = [k for k in lengths if k]
    if not lengths:
        return everywhere if everywhere is not None else d.select("doc_id").join(empty).limit(0)
    found = [_letter_groups(d, anchored, [-k for k in lengths if k < 0], bits)] if lengths[0] < 0 else []
    if lengths[-1] > 0:
        at = F.pmod("h", F.lit(1 << bits))
        masks = anchored.where("k > 0").groupBy(F.shiftright(at, 6).cast("int").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(h, {1 << bits}) % 64 as int))")).alias("mask"))
        every = docs.sparkSession.range(1 << (bits - 6)).select(F.col("id").cast("int").alias("word")).join(F.broadcast(masks), "word", "left")
        bitmap = every.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", F.coalesce("mask", F.lit(0).cast("long")).alias("mask")))), lambda x: x["mask"]).alias("bitmap"))
        known = lambda h: F.expr("1L").bitwiseAND(F.call_function("shiftright", F.get("bitmap", F.shiftright(F.pmod(h, F.lit(1 << bits)), 6).cast("int")), (F.pmod(h, F.lit(1 << bits)) % 64).cast("int"))) == 1

        def grams(parts, k):
            """The hashes of groups of k words in a row that may be anchors."""
            starts = F.when(F.size(parts) >= k, F.sequence(F.lit(1), F.size(parts) - k + 1)).otherwise(F.array().cast("array<int>"))
            return F.filter(F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(parts, i, k), " "), F.lit(k))), known)

        of_words = F.array_distinct(let(words(F.col("body")), lambda w: F.flatten(F.array(*[grams(w, k) for k in lengths if k > 0]))))
        dealt = d.repartition("doc_id").withColumn("one", F.lit(1)).join(F.broadcast(bitmap.withColumn("one", F.lit(1))), "one")
        found.append(dealt.select("doc_id", F.explode(of_words).alias("h")))
    groups = reduce(DataFrame.unionByName, found)
    asked = anchored.groupBy("h", "item_id", F.lower("needle").alias("needle")).agg(F.count("*").cast("int").alias("times"))
    hits = groups.join(asked, "h").groupBy("doc_id").agg(F.collect_set(F.struct("item_id", "needle", "times")).alias("hits"))
    holds = let(F.lower("body"), lambda body: F.filter("hits", lambda c: F.contains(body, c["needle"])))
    hits = d.join(hits, "doc_id").select("doc_id", F.explode(F.flatten(F.transform(holds, lambda c: F.array_repeat(c["item_id"], c["times"])))).alias("item_id"))
    return hits.unionByName(everywhere) if everywhere is not None else hits


def next_prev_match(matches: DataFrame, cursors: DataFrame, key: str = "doc_id") -> DataFrame:
    """For each cursor the next match at or after it and the previous one before it, each going round."""
    j = cursors.join(matches.select(key, "start"), key)
    ahead, behind = F.col("start") >= F.col("cursor"), F.col("start") < F.col("cursor")
    return j.groupBy(key, "cursor").agg(
        F.coalesce(F.min(F.when(ahead, F.col("start"))), F.min("start")).alias("next_start"),
        F.coalesce(F.max(F.when(behind, F.col("start"))), F.max("start")).alias("prev_start"),
    )


def search_restricted(matches: DataFrame, permissions: DataFrame, key: str = "doc_id") -> DataFrame:
    """Matches whose text is hidden where the document may not be copied."""
    p = permissions.select(key, F.col("copy").alias("may_copy"))
    return matches.join(p, key, "left").withColumn("matched", F.when(F.coalesce("may_copy", F.lit(True)), F.col("matched"))).drop("may_copy")


def match_rects(matches: DataFrame, boxes: DataFrame, keys: list[str], chars: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """The rectangles that cover each match: keys, ordinal, line (from 0), x, y, width, height.

    boxes: keys, chars (the page's characters in order, an array of text, x, y, width, height) and vertical (whether lines run down
    the page, as on one turned by 90 or 270 degrees). A character joins the rectangle before it if they share at least half of
    the thinner one's thickness and lie no farther apart than that; the rectangle is the one grown so far, not the last
    character. Blank characters and boxes without an area or with infinite edges are passed over. Where chars follow from other
    columns of boxes, give them as chars(start, stop), an expression for those of a match: only these are then taken out of a page.
    """
    number = "double"
    box = lambda c: F.struct(c["text"].alias("text"), *[c[k].cast(number).alias(a) for a, k in (("x", "x"), ("y", "y"), ("w", "width"), ("h", "height"))])
    finite = lambda v: ~F.isnan(v) & (F.abs(v) < float("inf"))
    solid = lambda c: (F.length(collapse_whitespace(c["text"])) > 0) & (c["w"] > 0) & (c["h"] > 0) & finite(c["x"]) & finite(c["y"]) & finite(c["w"]) & finite(c["h"])
    # a page's matches come to its characters as one array, so that these are not copied for each match
    per_page = matches.groupBy(*keys).agg(F.collect_list(F.struct("ordinal", "start", "stop")).alias("_matches"))
    j = boxes.withColumn("vertical", F.coalesce("vertical", F.lit(False))).join(per_page, keys)
    given = chars or (lambda start, stop: F.slice("chars", (start + 1).cast("int"), (stop - start).cast("int")))
    taken = lambda m: F.filter(F.transform(given(m["start"], m["stop"]), box), solid)
    names = ("line", "x0", "y0", "x1", "y1")
    kind = f"struct<line: int, {', '.join(f'{n}: {number}' for n in names[1:])}>"

    def grown(r: Column, c: Column) -> Column:
        right, below = c["x"] + c["w"], c["y"] + c["h"]
        across, along = F.least(r["x1"], right) - F.greatest(r["x0"], c["x"]), F.least(r["y1"], below) - F.greatest(r["y0"], c["y"])
        shared, apart = F.when(F.col("vertical"), across).otherwise(along), -F.when(F.col("vertical"), along).otherwise(across)
        thick = F.when(F.col("vertical"), F.least(r["x1"] - r["x0"], c["w"])).otherwise(F.least(r["y1"] - r["y0"], c["h"]))
        joins = F.coalesce((r["line"] >= 0) & (shared >= thick * 0.5) & (F.greatest(apart, F.lit(0.0)) <= thick), F.lit(False))

        def state(on: Column) -> Column:
            edges = [F.when(on, F.least(r["x0"], c["x"])).otherwise(c["x"]), F.when(on, F.least(r["y0"], c["y"])).otherwise(c["y"]), F.when(on, F.greatest(r["x1"], right)).otherwise(right), F.when(on, F.greatest(r["y1"], below)).otherwise(below)]
            return F.struct(*[v.alias(n) for n, v in zip(names, [r["line"] + F.when(on, 0).otherwise(1), *edges])])

        return let(let(joins, state), lambda v: F.struct(v.alias("s"), v.alias("o")))

    start = F.struct(F.lit(-1).alias("line"), *[F.lit(None).cast(number).alias(n) for n in names[1:]])
    last = lambda states: F.filter(states, lambda v, i: F.coalesce(F.get(states, i + 1)["line"] != v["line"], F.lit(True)))
    each = lambda m: F.transform(let(scan(taken(m), start, grown, kind), last), lambda r: F.struct(m["ordinal"].alias("ordinal"), *[r[n].alias(n) for n in names]))
    rects = j.select(*keys, F.explode(F.flatten(F.transform("_matches", each))).alias("r"))
    return rects.select(*keys, "r.ordinal", "r.line", F.col("r.x0").alias("x"), F.col("r.y0").alias("y"), (F.col("r.x1") - F.col("r.x0")).alias("width"), (F.col("r.y1") - F.col("r.y0")).alias("height"))


#: Classes of the default rules for word boundaries (marks and format characters go with the character before them).
WITH = r"[\p{M}\u200C\u200D\p{Cf}&&[^\u200B]]*"
ALONE = r"[\p{IsHan}\p{IsHiragana}]"
KATAKANA = r"[\p{IsKatakana}\u3031-\u3035\u309B\u309C\u30A0\u30FC\uFF70]"
LETTER = rf"[\p{{IsAlphabetic}}&&[^\p{{M}}\p{{IsHan}}\p{{IsHiragana}}\p{{IsKatakana}}\u30FC\uFF70\p{{IsThai}}\p{{IsLao}}\p{{IsKhmer}}\p{{IsMyanmar}}]]"
MID_LETTER = r"[.:'·‘’․‧︓﹒﹕＇．：\u0387\u05F4]"
MID_NUMBER = r"[.,;'‘’․⁄﹐﹒﹔＇，．；\u037E\u0589\u060C\u060D\u066C\u07F8\uFE10\uFE14]"
JOINS = r"[\p{Pc}\u202F]"
_RUN = rf"(?:(?:{LETTER}{WITH}(?:{MID_LETTER}{WITH}(?={LETTER}))?|\p{{Nd}}{WITH}(?:{MID_NUMBER}{WITH}(?=\p{{Nd}}))?)+|(?:{KATAKANA}{WITH})+)"
WORD_SEGMENT = rf"(?:{JOINS}{WITH})*{_RUN}(?:(?:{JOINS}{WITH})+{_RUN})*(?:{JOINS}{WITH})*|{ALONE}{WITH}|[\p{{IsThai}}\p{{IsLao}}\p{{IsKhmer}}\p{{IsMyanmar}}]+"


@cache
def _simple_spellings() -> dict[str, str]:
    """For each character all characters of the same simple case folding, which never changes a text's length."""
    simple = {c: (f if len(f) == 1 else c.lower()) for c, f in folds().items()}
    groups: dict[str, str] = {}
    for c, f in simple.items():
        if len(f) == 1 and f != c:
            groups[f] = groups.get(f, f) + c
    return {c: g for g in groups.values() for c in g}


def find_in_paragraph(paragraphs: DataFrame, query: str, opts: Options = Options(), text: str = "text") -> DataFrame:
    """Places of a literal query, blanks and line breaks as they are: paragraph columns, ordinal, start, stop, matched.

    A match may not cut a grapheme cluster (marks, Hangul syllables, pairs of flag letters, joined emoji); letters are alike by
    simple case folding. With whole_words it begins where a word begins and ends where one ends, by the default rules for word
    boundaries (a Han or Hiragana character is a word of its own, there is no dictionary). Only accepted matches are passed
    over whole, so a refused one does not hide a later one that overlaps it. CR LF and CR in the query count as LF.
    """
    query = re.sub("\r\n?", "\n", query)
    if not query:
        raise ValueError("the query is empty")
    same = {} if opts.match_case else _simple_spellings()
    body = "".join(f"[{''.join(map(_quoted, same[c]))}]" if c in same else _quoted(c) for c in query)
    keys = [c for c in paragraphs.columns if c != text]
    found = F.regexp_extract_all(text, F.lit(f"(?=({body}))"), F.lit(1))  # at every place, overlapping ones too
    before = F.transform(F.split(text, f"(?={body})", -1), F.length)
    rows = paragraphs.select(*keys, F.col(text).alias("_in"), found.alias("_found"), before.alias("_before")).where(F.size("_found") > 0)
    # one character a place: | where a cluster, or a word, begins or ends; null where every place is an edge of a cluster
    dots = lambda n: F.repeat(F.lit("."), n)
    drawn = lambda parts, draw: F.array_join(F.transform(parts, draw), "").cast("binary")
    clusters = F.concat(drawn(F.regexp_extract_all("_in", F.lit(r"(\X)"), F.lit(1)), lambda c: F.concat(F.lit("|"), dots(F.length(c) - 1))), F.lit(b"|"))
    rows = rows.withColumn("_edges", F.when(~F.col("_in").rlike(r"^[\x00-\x0C\x0E-\xAC\xAE-\u02FF]*+$"), clusters))
    if opts.whole_words:
        rows = rows.withColumn("_words", F.regexp_extract_all("_in", F.lit(f"(?s)({WORD_SEGMENT}|.)"), F.lit(1)))
        is_word = lambda w: w.rlike(f"{LETTER}|\\p{{Nd}}|{KATAKANA}|{ALONE}|[\\p{{IsThai}}\\p{{IsLao}}\\p{{IsKhmer}}\\p{{IsMyanmar}}]")
        begin = drawn(F.col("_words"), lambda w: F.when(is_word(w), F.concat(F.lit("|"), dots(F.length(w) - 1))).otherwise(dots(F.length(w))))
        end = drawn(F.col("_words"), lambda w: F.when(is_word(w), F.concat(dots(F.length(w) - 1), F.lit("|"))).otherwise(dots(F.length(w))))
        rows = rows.select(*keys, "_found", "_before", "_edges", begin.alias("_begin"), F.concat(F.lit(b"."), end).alias("_end"))
    # the pieces before the places: none is cut off in front of a match at the very beginning
    gaps = F.when(F.size("_before") > F.size("_found"), F.slice("_before", F.lit(1), F.size("_found"))).otherwise(F.concat(F.array(F.lit(0)), F.slice("_before", F.lit(1), F.size("_found") - 1)))
    at = lambda flags, place: F.substring(flags, place + 1, F.lit(1)) == F.lit(b"|")

    def go(s, x):
        def tried(place):
            stop = place + F.length(x["m"])
            taken = (place >= s["free"]) & F.coalesce(at(F.col("_edges"), place) & at(F.col("_edges"), stop), F.lit(True))
            if opts.whole_words:
                taken = taken & at(F.col("_begin"), place) & at(F.col("_end"), stop)
            return let(taken, lambda t: F.struct(F.struct(place.alias("at"), F.when(t, stop).otherwise(s["free"]).alias("free")).alias("s"), F.struct(place.alias("start"), stop.alias("stop"), x["m"].alias("m"), t.alias("taken")).alias("o")))

        return let(s["at"] + x["gap"], tried)

    tries = scan(F.arrays_zip(gaps.alias("gap"), F.col("_found").alias("m")), F.struct(F.lit(0).alias("at"), F.lit(0).alias("free")), go, "struct<start: int, stop: int, m: string, taken: boolean>")
    rows = rows.select(*keys, F.filter(tries, lambda t: t["taken"]).alias("_taken"))
    return _exploded(rows, keys, F.transform("_taken", lambda t: F.struct(F.struct(t["start"].alias("start"), t["stop"].alias("stop")).alias("at"), t["m"].alias("matched"))))
