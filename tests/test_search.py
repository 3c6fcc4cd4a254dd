"""Search by full case folding, rectangles of matches, and search in paragraphs, against rules written anew."""

import random
import time
import unicodedata

import pytest

from docspark.functions.text import BLANKS, folds
from docspark.operators import search


def is_word(c):
    return unicodedata.category(c)[0] in "LMN" or unicodedata.category(c) == "Pc" or c in "‌‍"


def places(text, query, case=False, whole=False):
    """Folded letters one after the other, each with the place it comes from and whether a character begins or ends there."""
    letters, came, edge = [], [], {0}
    for i, c in enumerate(text):
        new = " " if c in BLANKS_SET else c if case else c.casefold()
        if new == " " and (not letters or letters[-1] == " "):
            continue
        letters += new
        came += [i] * len(new)
        edge |= {len(letters) - len(new), len(letters)}
    whole_text = "".join(letters)
    needle = " ".join(w for w in "".join(" " if c in BLANKS_SET else c if case else c.casefold() for c in query).split(" ") if w)

    def word_at(k):
        if not 0 <= k < len(whole_text):
            return False
        inside = whole_text[k] in "'’" and 0 < k < len(whole_text) - 1 and is_word(whole_text[k - 1]) and is_word(whole_text[k + 1])
        return is_word(whole_text[k]) or inside

    out, at = [], 0
    while (at := whole_text.find(needle, at)) >= 0:
        end = at + len(needle)
        fits = at in edge and end in edge and (not whole or word_at(at) and word_at(end - 1) and not word_at(at - 1) and not word_at(end))
        if fits:
            out.append([came[at], came[end - 1] + 1])
        at = end if fits else at + 1
    return out


import re  # noqa: E402

BLANKS_SET = {chr(i) for i in range(0x10000) if re.fullmatch(f"[{BLANKS}]", chr(i))}


def found(spark, texts, query, **opts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = search.search_matches(df, query, search.Options(opts.get("case", False), opts.get("whole", False))).collect()
    got = [[] for _ in texts]
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.ordinal == len(got[r.doc_id]) and r.matched == texts[r.doc_id][r.start : r.stop]
        got[r.doc_id].append([r.start, r.stop])
    counts = search.search_count(df, query, search.Options(opts.get("case", False), opts.get("whole", False))).collect()
    assert {r.doc_id: r.n_matches for r in counts} == {i: len(g) if texts[i] is not None else None for i, g in enumerate(got)}
    return got


@pytest.mark.parametrize("query", ["ss", "FI", "ffi", "ŉ", "ΐ", "İ", "st", "եւ", "k", "Å", "ς", "ᾳ", "θ", "π", "ǆ", "ẞ", "s", "i"])
def test_every_character_finds_its_equals_and_no_part(spark, query):
    texts = [c for c in folds()] + sorted({f for f in folds().values()}) + [a + b for a in "sſßfﬁİi" for b in "sſßfﬁİi"]
    assert found(spark, texts, query) == [places(t, query) for t in texts]


@pytest.mark.parametrize("query,case,whole", [("ss", False, False), ("ffi", False, True), ("f i", False, False), ("ßs", False, True), ("i̇s", False, False), ("is", True, False), ("s's", False, True), ("sss", False, False)])
def test_equals_rules_on_random_texts(spark, query, case, whole):
    rng = random.Random(query)
    texts = ["".join(rng.choice(["s", "S", "ß", "ẞ", "f", "ﬁ", "ﬀ", "ﬃ", "i", "İ", "̇", "ſ", " ", " ", "\n", "'", "’", "-", "\u0085", "﷐"]) for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    assert found(spark, [*texts, "", None], query, case=case, whole=whole) == [places(t, query, case, whole) for t in [*texts, ""]] + [[]]


def test_time_grows_with_the_matches(spark):
    for query, word in (("the", "the "), ("ss", "ß s ")):
        took = []
        for n in (10_000, 40_000):
            df = spark.createDataFrame([(1, word * n)], "doc_id long, text string")
            search.search_matches(df, query).count()
            t = time.time()
            last = search.search_matches(df, query).orderBy("start").collect()[-1]
            took.append(time.time() - t)
            assert (last.ordinal, last.start) == (n - 1, (n - 1) * 4)
        assert took[1] < 8 * took[0] + 2  # a quadratic fold takes 16 times as long


def grown(chars, vertical):
    rects = []
    for t, x, y, w, h in chars:
        if t in " \n" or w <= 0 or h <= 0:
            continue
        if rects:
            a, b, c, d = rects[-1]
            across, down = min(c, x + w) - max(a, x), min(d, y + h) - max(b, y)
            shared, apart, thick = (across, -down, min(c - a, w)) if vertical else (down, -across, min(d - b, h))
            if shared >= thick / 2 and max(apart, 0) <= thick:
                rects[-1] = (min(a, x), min(b, y), max(c, x + w), max(d, y + h))
                continue
        rects.append((x, y, x + w, y + h))
    return [(k, a, b, c - a, d - b) for k, (a, b, c, d) in enumerate(rects)]


def test_rectangles_grow(spark):
    rng = random.Random(2)
    pages, matches, want = [], [], []
    for doc in range(200):
        vertical = bool(doc % 2)
        chars = [(rng.choice("abc \n"), float(k * 5 + rng.choice([0, 0, 0, 9, 30])), float(rng.choice([0, 0, 3, 5, -4, 14])), float(rng.choice([0, 4, 6, 6])), float(rng.choice([5, 12, 12, -1]))) for k in range(12)]
        if vertical:
            chars = [(t, y, x, h, w) for t, x, y, w, h in chars]
        pages.append((doc, chars, vertical if doc % 5 else None if not vertical else True))
        for o, (a, b) in enumerate([(0, 12), (3, 5), (6, 7), (2, 9)]):
            matches.append((doc, o, a, b))
            want += [(doc, o, *r) for r in grown(chars[a:b], vertical)]
    boxes = spark.createDataFrame(pages, "doc_id long, chars array<struct<text: string, x: double, y: double, width: double, height: double>>, vertical boolean")
    got = search.match_rects(spark.createDataFrame(matches, "doc_id long, ordinal long, start long, stop long"), boxes, ["doc_id"])
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_the_last_character_alone_would_decide_otherwise(spark):
    chars = [("t", 0.0, 0.0, 6.0, 12.0), ("h", 6.0, 0.0, 6.0, 5.0), ("e", 12.0, 5.0, 6.0, 12.0), (" ", 18.0, float("nan"), 6.0, 12.0), ("x", float("inf"), 0.0, 6.0, 12.0)]
    boxes = spark.createDataFrame([(1, chars, None)], "doc_id long, chars array<struct<text: string, x: double, y: double, width: double, height: double>>, vertical boolean")
    got = search.match_rects(spark.createDataFrame([(1, 0, 0, 5)], "doc_id long, ordinal long, start long, stop long"), boxes, ["doc_id"]).collect()
    assert [tuple(r) for r in got] == [(1, 0, 0, 0.0, 0.0, 18.0, 17.0)]


@pytest.mark.parametrize(
    "text,query,whole,want",
    [
        ("cafe cafe\u0301 cafe", "cafe", False, [0, 11]),
        ("\u1100\u1161 \u1100\u1161\u11a8", "\u1100\u1161", False, [0]),  # a syllable of two letters is no part of one of three
        ("\uac00\u11a8", "\uac00", False, []),
        ("🇫🇷🇩🇪 🇷🇩", "🇷🇩", False, [5]),  # the middle of two flags is no flag
        ("👨‍👩‍👧 👩", "👩", False, [6]),
        ("👍🏽 👍", "👍", False, [3]),
        ("a\r\nb\nc", "\n", False, [4]),
        ("can't can", "can", True, [6]),
        ("don’t won’t", "t", True, []),
        ("3.14 14 3,141", "14", True, [5]),
        ("x_y y", "y", True, [4]),
        ("end. end", "end", True, [0, 5]),
        ("カタカナ カナ", "カナ", True, [5]),
        ("中文 字", "中", True, [0]),
        ("a-a-a", "a-a", True, [0]),
        ("xa-a-a", "a-a", True, [3]),
        ("aaa", "aa", False, [0]),
        ("ΣΑΣ ς", "σ", False, [0, 2, 4]),
        ("Straße ẞ", "ss", False, []),  # simple folding keeps lengths
        ("Straße ẞ", "ß", False, [4, 7]),
        ("a  b a b", "a  b", False, [0]),
        ("s.t. U.S.A. usa", "u.s.a", True, [5]),
        ("", "a", True, []),
        (None, "a", True, []),
    ],
)
def test_paragraph_edges(spark, text, query, whole, want):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = search.find_in_paragraph(df, query, search.Options(False, whole)).orderBy("start").collect()
    assert [r.start for r in got] == want
    assert all(r.matched == text[r.start : r.stop] and r.ordinal == k for k, r in enumerate(got))
