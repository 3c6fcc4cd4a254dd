"""Literal fixtures for semantics that the given tables do not show."""

import pytest

from docspark.operators import assemble, history, layout, outline, pages, redact, replace, search


@pytest.mark.parametrize(
    "text,query,case,whole,want",
    [
        ("Λόγος ΛΌΓΟΣ λόγοσ", "λόγος", False, False, [[0, 5], [6, 11], [12, 17]]),
        ("Grüße aus der GASSE", "gasse", False, False, [[14, 19]]),
        ("Maß halten, MASS nehmen", "mass", False, False, [[0, 3], [12, 16]]),
        ("rain rainy, Rain.", "rain", False, True, [[0, 4], [12, 16]]),
        ("won't won", "won", False, True, [[6, 9]]),
        ("no-no-no", "no-no", False, True, [[0, 5]]),
        ("papapa", "papa", False, False, [[0, 4]]),
        ("left\t \n right", "left right", False, False, [[0, 13]]),
        ("cost (a+b)? yes", "(a+b)?", False, False, [[5, 11]]),
        ("Oak oak OAK", "OAK", True, False, [[8, 11]]),
    ],
)
def test_search(spark, text, query, case, whole, want):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = search.search_matches(df, query, search.Options(case, whole)).collect()
    assert [[r.start, r.stop] for r in sorted(got, key=lambda r: r.start)] == want


def test_search_many_whatever_stands_round_the_passage(spark):
    needle = "One two three four five six"
    bodies = [f'said "{needle}" and', f"({needle},", f"x —{needle}s", f"\r{needle}", f"\u00a0{needle}.", "one two  three four five six", "none", None]
    docs = spark.createDataFrame(list(enumerate(bodies)), "doc_id long, text string")
    needles = [needle, "two three", "ive", "two three four", "\none", " two three ", "a b c", ""]
    q = spark.createDataFrame(list(enumerate(needles)), "item_id long, text string")
    want = sorted((i, j) for i, b in enumerate(bodies) for j, n in enumerate(needles) if b is not None and n.lower() in b.lower())
    assert sorted(map(tuple, search.search_many(docs, q).collect())) == want


def test_replacement_takes_text_literally(spark):
    runs = spark.createDataFrame([(1, 0, "before cat CAT cat after")], "doc_id long, line_no long, text string")
    m = search.search_matches(runs, "cat").selectExpr("*", "true AS selected")
    assert replace.plan_replacement(m, runs, r"$&\1", ["doc_id", "line_no"]).first().new_text == r"before $&\1 $&\1 $&\1 after"
    one = m.selectExpr("doc_id", "line_no", "start", "stop", "ordinal = 1 AS selected")
    assert replace.plan_replacement(one, runs, "dog", ["doc_id", "line_no"]).first().new_text == "before cat dog cat after"


def test_redaction_audit_compares_by_value(spark):
    page = "doc_id long, page_index long, text string"
    before = spark.createDataFrame([(1, k, "a secret 𝒳 here") for k in range(6)] + [(1, 6, None)], page)
    ranges = spark.createDataFrame([(1, k, 2, 8) for k in range(6)] + [(1, 0, 4, 6)], "doc_id long, page_index long, start long, stop long")
    texts = {0: "a  𝒳 here", 1: "a secr𝒳 re", 2: "a  𝒳 hers", 3: "a secret 𝒳 here", 5: "a  𝒳 here", 6: None, 7: "new"}
    got = redact.redaction_audit(before, spark.createDataFrame([(1, k, t) for k, t in texts.items()], page), ranges)
    assert sorted((r.page_index, r.exact) for r in got.collect()) == [(0, True), (1, False), (2, False), (3, False), (4, False), (5, True), (6, True), (7, False)]
    after = redact.apply_redaction(before, ranges.where("stop = 8"))
    assert all(r.exact for r in redact.redaction_audit(before, after, ranges).collect())


def plan(spark, n=5):
    return spark.createDataFrame([(1, i, "abcdefg"[i], 7, i, 0) for i in range(n)], "workspace_id long, pos long, page_id string, source_id long, page_index long, rotation int")


def ids(df):
    return "".join(r.page_id[0] for r in df.orderBy("pos").collect())


@pytest.mark.parametrize("at,want", [(0, "cdfabeg"), (7, "abegcdf"), (5, "abecdfg"), (6, "abecdfg"), (3, "abcdfeg")])
def test_move(spark, at, want):
    sel = spark.createDataFrame([(1, 2), (1, 3), (1, 5)], "workspace_id long, pos long")
    assert ids(pages.move_pages(plan(spark, 7), sel, spark.createDataFrame([(1, at)], "workspace_id long, at long"))) == want


def test_duplicate_delete_insert(spark):
    p, sel = plan(spark, 6), spark.createDataFrame([(1, 0), (1, 4)], "workspace_id long, pos long")
    assert ids(pages.duplicate_pages(p, sel)) == "abcdeaef"
    assert ids(pages.delete_pages(p, sel)) == "bcdf"
    assert ids(pages.delete_pages(p, p.select("workspace_id", "pos"))) == "abcdef"
    assert ids(pages.insert_pages(p, p.where("pos = 2"), spark.createDataFrame([(1, 50)], "workspace_id long, at long"))) == "abcdefc"


def log(spark, actions):
    rows = [(1, f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}", i, a, s) for i, (a, s) in enumerate(actions)]
    return spark.createDataFrame(rows, "session_id long, ts string, event_id long, action string, state long").selectExpr("session_id", "cast(ts AS timestamp) ts", "event_id", "action", "state")


#: 130 states of which the last 100 before the present are kept, then three steps back and one forth.
ACTIONS = [("commit", k) for k in range(130)] + [("undo", -1)] * 3 + [("redo", -1)]


def test_history(spark):
    assert tuple(history.replay_history(log(spark, ACTIONS)).first()) == (1, 127, 98, 2)
    assert tuple(history.replay_history(log(spark, [*ACTIONS, ("commit", 500), ("redo", -1), *[("undo", -1)] * 150])).first()) == (1, 29, 0, 99)


def test_deadline_cuts_bursts(spark):
    got = history.checkpoint_coalesce(log(spark, ACTIONS[:20]), 1.5, 5).collect()
    assert sorted(r.changes for r in got) == [5, 5, 5, 5]


def test_edits_are_all_or_nothing(spark):
    runs = spark.createDataFrame([(d, k, f"t{d}{k}") for d in range(5) for k in range(2)], "doc_id long, line_no long, text string")
    edits = [(0, 0, "t00", "A"), (0, 1, "t01", "B"), (1, 0, "t10", "A"), (1, 7, "gone", "B"), (2, 0, "t20", "A"), (2, 0, "t20", "B"), (3, 0, "other", "A"), (3, 1, "t31", "B")]
    got = replace.apply_edits(runs, spark.createDataFrame(edits, "doc_id long, line_no long, expected_text string, new_text string"), ["doc_id", "line_no"])
    assert sorted((r.doc_id, r.line_no, r.text) for r in got.collect() if r.applied) == [(0, 0, "A"), (0, 1, "B")]
    assert got.count() == 10 and sorted(r.text for r in got.where("not applied").collect()) == sorted(f"t{d}{k}" for d in range(1, 5) for k in range(2))


LEVELS = [0, 1, 2, 2, 1, 2, 3, 0, 1]


def outlined(spark, **more):
    from pyspark.sql import functions as F

    o = spark.createDataFrame([(1, i, v, f"i{i}", f"i{i}", i) for i, v in enumerate(LEVELS)], "doc_id long, idx long, level int, item_id string, title string, target long")
    return o.withColumns({k: F.expr(v) for k, v in more.items()})


@pytest.mark.parametrize(
    "at,op,want",
    [
        (1, "add", "i0 i1 i2 i3 + i4 i5 i6 i7 i8"), (None, "add", "i0 i1 i2 i3 i4 i5 i6 i7 i8 +"), (4, "up", "i0 i4 i5 i6 i1 i2 i3 i7 i8"), (1, "down", "i0 i4 i5 i6 i1 i2 i3 i7 i8"),
        (0, "down", "i7 i8 i0 i1 i2 i3 i4 i5 i6"), (4, "down", "i0 i1 i2 i3 i4 i5 i6 i7 i8"), (1, "up", "i0 i1 i2 i3 i4 i5 i6 i7 i8"), (4, "remove", "i0 i1 i2 i3 i7 i8"), (30, "remove", "i0 i1 i2 i3 i4 i5 i6 i7 i8"),
    ],
)
def test_edit_outline(spark, at, op, want):
    e = spark.createDataFrame([(1, at, op, "+", "new", 9)], "doc_id long, at long, op string, new_id string, new_title string, new_target long")
    got = outline.edit_outline(outlined(spark), e).orderBy("idx").collect()
    assert " ".join(r.item_id for r in got) == want and [r.idx for r in got] == list(range(len(got)))
    if op == "add":
        assert [(r.level, r.target) for r in got if r.item_id == "+"] == [(2 if at else 0, 9)]


def test_outline_counts_with_closed_items(spark):
    got = outline.outline_counts(outlined(spark, closed="idx in (1, 5)")).orderBy("idx").collect()
    assert [r.descendants for r in got] == [3, -2, 0, 0, 1, -1, 0, 1, 0]


def test_remap_outline_keeps_ancestors_of_living_items(spark):
    pages_left = spark.createDataFrame([(6, 60), (8, 80)], "target long, new_target long")
    got = outline.remap_outline(outlined(spark), pages_left).orderBy("idx").collect()
    assert [(r.idx, r.target) for r in got] == [(0, None), (4, None), (5, None), (6, 60), (7, None), (8, 80)]


def test_selectable_spans_compare_with_the_first_box(spark):
    chars = [("a", 0.0), ("b", 0.015), ("c", 0.03), (" ", 0.03), ("d", 5.0), ("e", 5.02)]
    df = spark.createDataFrame([(1, 0, i, t, x, 0.0, 6.0, 9.0) for i, (t, x) in enumerate(chars)], "doc_id long, page_index long, char_index long, text string, x double, y double, width double, height double")
    got = layout.selectable_spans(df).orderBy("start").collect()
    assert [(r.start, r.stop, r.text) for r in got] == [(0, 2, "ab"), (2, 3, "c"), (3, 4, " "), (4, 6, "de")]
    assert abs(got[0].width - 6.015) < 1e-9


def test_select_pages_reports_what_is_wrong(spark):
    p = spark.createDataFrame([(d, k, "t") for d in range(1, 8) for k in range(3)], "doc_id long, page_index long, text string")
    asked = [(1, "range", None, "1,x,3"), (2, "range", None, "3, 1-2,2"), (3, "range", None, "2-4"), (4, "current", 1, None), (5, "current", 3, None), (6, "all", None, None), (7, "range", None, "0"), (8, "all", None, None)]
    got = assemble.select_pages(p, spark.createDataFrame(asked, "doc_id long, mode string, current_page long, expr string")).collect()
    found = {}
    for r in got:
        found.setdefault(r.doc_id, []).append(r.error or r.page_index)
    assert {k: sorted(v) for k, v in found.items()} == {1: ["syntax"], 2: [0, 1, 2], 3: ["bounds"], 4: [1], 5: ["current"], 6: [0, 1, 2], 7: ["bounds"], 8: ["no_pages"]}


def test_casefold_of_all_characters(spark):
    from docspark.functions import text as T

    words = ["ＡＢＣ", "oﬀice", "Ⅷ", "Straße", "İstanbul", "ǅ", "ΣΊΣΥΦΟΣ", "plain", "𐐀", "ŉ ẖ ΐ", None]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r[0] for r in df.select(T.casefold(df.w)).collect()] == [w.casefold() if w else w for w in words]


def test_sink_does_not_overwrite(spark, tmp_path):
    from pyspark.errors import AnalysisException

    from docspark.sources import corpus

    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "doc_id long, text string, lang string")
    corpus.export_text_sink(df, str(tmp_path / "out"), ("lang",))
    assert sorted(map(tuple, corpus.scan_corpus(spark, str(tmp_path / "out"), df.schema).collect())) == [(1, "a", "x"), (2, "b", "y")]
    with pytest.raises(AnalysisException):
        corpus.export_text_sink(df, str(tmp_path / "out"))


def test_inventory_counts_equal_files(spark, tmp_path):
    import hashlib

    from docspark.sources import corpus

    (tmp_path / "in" / "deep").mkdir(parents=True)
    for name, data in (("a", b"%PDF-1.7 x"), ("b", b"%PDF-1.7 x"), ("deep/c", b"\x89PNG")):
        (tmp_path / "in" / name).write_bytes(data)
    got = {r.sha256: (r.length, r.magic, r.copies) for r in corpus.binary_inventory(spark, str(tmp_path / "in")).collect()}
    assert got == {hashlib.sha256(b"%PDF-1.7 x").hexdigest(): (10, b"%PDF-1.7".hex().upper(), 2), hashlib.sha256(b"\x89PNG").hexdigest(): (4, "89504E47", 1)}


def test_repeated_requests_change_nothing(spark):
    from docspark.operators import review

    c = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "conv_id long, turn long, text string")
    e = spark.createDataFrame([(1, 0, "a", "x"), (1, 0, "a", "y"), (1, 1, "b", "z")], "conv_id long, turn long, expected_text string, new_text string")
    assert sorted((r.turn, r.text, r.applied) for r in review.edit_comments(c, e, ["conv_id", "turn"]).collect()) == [(0, "a", False), (1, "z", True)]


def test_search_many_short_needles_as_arrays(spark):
    bodies = ["a 𝒳y\u0000z b", "ÄÖÜ äöü", "abc" * 50, "x", "", None]
    docs = spark.createDataFrame(list(enumerate(bodies)), "doc_id long, text string")
    q = spark.createDataFrame([(1, "𝒳Y"), (1, "abca"), (2, "äö"), (3, "y\u0000Z"), (4, "X"), (4, "x"), (5, "bcab"), (6, "abcabcabd")], "item_id long, text string")
    found = search.search_many(docs, q)
    want = sorted((i, r.item_id) for i, b in enumerate(bodies) for r in q.collect() if b is not None and r.text.lower() in b.lower())
    assert sorted(map(tuple, found.collect())) == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "split(lower(body" not in plan and "MapInArrow" in plan  # characters are hashed in numpy, not by an expression for each group
