"""Text of pages from characters, form fields and recognised words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.functions.text import normalize_line_endings

PAGE = ["doc_id", "page_index"]
GONE = "￿"  # stands for a character off the page while a page's text is put together; no text holds it


def page_text(chars: DataFrame, width: float, height: float) -> DataFrame:
    """Page text of chars (page, char_index, text, x, y, width, height).

    Characters off the page go, and a line break takes the place of such a group and of the blanks around it, so that words
    never fuse; blanks at either end go too. chars may also be pages (page, chars: an array of text, x, y, width, height in
    order), which are not shuffled.
    """
    seen = lambda c: (c["x"] < width) & (c["y"] < height) & (c["x"] + c["width"] > 0) & (c["y"] + c["height"] > 0)
    piece = lambda c: F.when(seen(c) | c["text"].rlike(r"^\s*$"), c["text"]).otherwise(GONE)
    if "chars" in chars.columns:
        g = chars.where("size(chars) > 0")
        text = F.array_join(F.transform("chars", piece), "")
    else:
        row = F.struct("text", "x", "y", "width", "height")
        g = chars.select(*PAGE, "char_index", piece(row).alias("piece")).groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("char_index", "piece"))).alias("p"))
        text = F.array_join(F.transform("p", lambda c: c["piece"]), "")
    text = F.regexp_replace(F.regexp_replace(text, f"^[\\s{GONE}]+|[\\s{GONE}]+$", ""), f"\\s*{GONE}[\\s{GONE}]*", "\n")
    return g.select(*PAGE, normalize_line_endings(text).alias("text"))


def form_values_text(fields: DataFrame) -> DataFrame:
    """Per document the lines "label: value" under [Form fields], and how many fields were skipped.

    fields: doc_id, pos, label, name, kind, value, checked and, if there are such, options and selected (row numbers). A label falls
    back to the name, then to "Unnamed field". Choices show the texts of their selected options (rows that are none are left
    out), a checkbox Checked or Unchecked; a radio button counts only if checked, with its first option, its value or "Selected".
    Line ends become line feeds. Passwords, signatures and unsupported kinds are skipped.
    """
    given = lambda c: F.nullif(F.trim(c), F.lit(""))
    fields = fields.withColumns({c: F.lit(None).cast(t) for c, t in (("options", "array<string>"), ("selected", "array<int>")) if c not in fields.columns})
    label = F.coalesce(given("label"), given("name"), F.lit("Unnamed field"))
    skipped = F.col("kind").isin("password", "signature", "unsupported")
    shown = ~skipped & ((F.col("kind") != "radio") | F.coalesce("checked", F.lit(False)))
    picked = F.array_join(F.filter(F.transform("selected", lambda i: F.when(i >= 0, F.get("options", i))), lambda x: x.isNotNull()), ", ")
    value = F.when(F.size("selected") > 0, picked).when(F.col("kind") == "checkbox", F.when(F.coalesce("checked", F.lit(False)), "Checked").otherwise("Unchecked"))
    value = value.when(F.col("kind") == "radio", F.coalesce(F.get("options", F.lit(0)), "value", F.lit("Selected"))).otherwise(F.coalesce("value", F.lit("")))
    f = fields.select("doc_id", "pos", F.concat(label, F.lit(": "), normalize_line_endings(value)).alias("line"), shown.alias("shown"), skipped.alias("skipped"))
    g = f.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.when(F.col("shown"), F.struct("pos", "line")))).alias("l"), F.count_if("skipped").alias("skipped_fields"))
    text = F.when(F.size("l") > 0, F.concat(F.lit("[Form fields]\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n"))).otherwise("")
    return g.select("doc_id", text.alias("text"), "skipped_fields")


def ocr_words(pages: DataFrame) -> DataFrame:
    """Words of nested pages: page, block, paragraph, line and word (each counted in the one that holds it), page_line (over the whole page),
    and the word's own columns.

    pages: page, blocks, an array of paragraphs: array of lines: array of words: array of structs. What is empty gives no rows.
    """
    lines = F.flatten(F.flatten(F.transform("blocks", lambda b, i: F.transform(b["paragraphs"], lambda p, j: F.transform(p["lines"], lambda x, k: F.struct(i.cast("long").alias("block"), j.cast("long").alias("paragraph"), k.cast("long").alias("line"), x["words"].alias("words")))))))
    each = pages.select(*PAGE, F.posexplode(lines).alias("page_line", "l")).select(*PAGE, "l.block", "l.paragraph", "l.line", F.col("page_line").cast("long").alias("page_line"), F.posexplode("l.words").alias("word", "w"))
    return each.select(*PAGE, "block", "paragraph", "line", "page_line", F.col("word").cast("long").alias("word"), "w.*")


def ocr_word_arrays(pages: DataFrame) -> DataFrame:
    """The words that ocr_words gives as rows, as one array of each page in order: page, words. Nothing is shuffled."""
    lines = F.flatten(F.flatten(F.transform("blocks", lambda b, i: F.transform(b["paragraphs"], lambda p, j: F.transform(p["lines"], lambda x, k: F.struct(i.cast("long").alias("block"), j.cast("long").alias("paragraph"), k.cast("long").alias("line"), x["words"].alias("words")))))))
    nested = pages.select(*PAGE, lines.alias("lines"))
    own = nested.schema["lines"].dataType.elementType["words"].dataType.elementType.names
    word = lambda x, k: lambda w, n: F.struct(x["block"].alias("block"), x["paragraph"].alias("paragraph"), x["line"].alias("line"), k.cast("long").alias("page_line"), n.cast("long").alias("word"), *[w[c].alias(c) for c in own])
    return nested.select(*PAGE, F.flatten(F.transform("lines", lambda x, k: F.transform(x["words"], word(x, k)))).alias("words"))


def ocr_flatten(pages: DataFrame) -> DataFrame:
    """Words with their ordinals from nested pages (page, lines: array of arrays of words); lines without words give none."""
    lines = pages.select(*PAGE, F.posexplode("lines").alias("line", "words"))
    words = lines.select(*PAGE, "line", F.posexplode("words").alias("word", "text"))
    return words.select(*PAGE, F.col("line").cast("long"), F.col("word").cast("long"), "text")


def ocr_reading_text(words: DataFrame, native: DataFrame) -> DataFrame:
    """Native text of each page (page, text), then its recognised words: a space between words, a line break between lines."""
    lines = words.groupBy(*PAGE, "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word", "text"))), lambda w: w["text"]), " ").alias("text"))
    read = lines.groupBy(*PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda w: w["text"]), "\n").alias("read"))
    return native.join(read, PAGE, "full_outer").select(*PAGE, F.concat_ws("\n", F.nullif("text", F.lit("")), "read").alias("text"))


def font_coverage(docs: DataFrame, fonts: dict[str, list[tuple[int, int]]]) -> DataFrame:
    """Per document and font: how many distinct characters its code point ranges (inclusive) leave out, and these in order."""
    points = F.array_sort(F.array_distinct(F.transform(F.filter(F.split("text", ""), lambda c: c != ""), F.ascii)))

    def missing(ranges):
        def bare(p):
            out = F.lit(True)
            for lo, hi in ranges:
                out = out & ~p.between(lo, hi)
            return out

        return F.filter("points", bare)

    d = docs.select("doc_id", points.alias("points"))
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("font"), missing(r).alias("missing")) for name, r in fonts.items()]))
    return d.select("doc_id", each.alias("f")).select("doc_id", "f.font", F.size("f.missing").cast("long").alias("n_missing"), F.array_join(F.transform("f.missing", lambda p: p.cast("string")), ",").alias("missing"))
