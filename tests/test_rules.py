"""Rules that the given tables reach seldom or not at all, on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from docspark.functions.fold import scan, splice
from docspark.operators import layout, outline, pages, redact, replace, review, search


def test_scan_and_splice(spark):
    rows = [(list(range(n)),) for n in (0, 1, 127, 128, 129, 1000)] + [(None,)]
    got = spark.createDataFrame(rows, "x array<long>").select("x", scan(F.col("x"), F.lit(0).cast("long"), lambda s, x: F.struct((s + x).alias("s"), (s + x).alias("o")), "bigint").alias("y")).collect()
    for r in got:
        assert r.y == (None if r.x is None else [sum(r.x[: k + 1]) for k in range(len(r.x))])
    spans = [("a secret 𝒳 here", [(2, 8)], "a <> 𝒳 here"), ("abcdef", [(0, 2), (1, 3), (5, 6)], "<><>de<>"), ("abc", [], "abc"), ("", [(0, 0)], "<>"), (None, [(0, 1)], None)]
    df = spark.createDataFrame([(t, s) for t, s, _ in spans], "t string, s array<struct<start: long, stop: long>>")
    assert [r[0] for r in df.select(splice(F.col("t"), F.col("s"), "<>")).collect()] == [w for _, _, w in spans]


def test_ownership_in_two_coordinate_systems(spark):
    # characters 0-5 come from run 1, 5-10 go on there, 10-15 from run 2 with a letter left out at 12, 20-25 from run 1 again
    spans = [(1, 0, 5, 1, 0, True, True), (1, 5, 10, 1, 5, True, True), (1, 10, 12, 2, 0, True, True), (1, 12, 15, 2, 3, True, True), (1, 15, 20, 3, 0, True, False), (1, 20, 22, 1, 8, True, True), (1, 30, 35, 4, 0, False, True), (1, 40, 40, 5, 0, False, True)]
    matches = {(2, 7): None, (9, 11): "CrossObject", (11, 13): "InvalidMapping", (10, 12): None, (13, 15): None, (16, 18): "Ineligible", (19, 24): "CrossObject", (21, 24): "Unmapped", (24, 28): "Unmapped", (8, 9): "OverlappingSource", (7, 8): None, (30, 31): "InvalidMapping", (29, 31): "InvalidMapping", (39, 41): "Unmapped"}
    m = spark.createDataFrame([(1, a, b) for a, b in matches], "doc_id long, start long, stop long")
    s = spark.createDataFrame(spans, "doc_id long, char_start long, char_stop long, run long, source_start long, valid boolean, supported boolean")
    for bucket in (4, 256):
        got = {(r.start, r.stop): r for r in replace.match_ownership(m, s, bucket=bucket).collect()}
        assert {k: r.blocker for k, r in got.items()} == matches
        assert (got[2, 7].run, got[2, 7].source_start, got[2, 7].source_stop) == (1, 2, 7) and got[13, 15].source_start == 4 and got[16, 18].run == 3 and got[9, 11].run is None


def test_page_batches_block_a_document(spark):
    e = spark.createDataFrame([(1, 0, "a", "b", 1, None, None), (2, 0, "a", "b", 1, None, "prefix"), (3, 0, "a", "b", 1, "NeedsRemoval", "prefix")], "doc_id long, page_index long, expected_text string, new_text string, n_matches long, blocker string, batch_blocker string")
    got = {r.doc_id: r.blocker for r in replace.plan_document_replacement(e).collect()}
    assert got == {1: None, 2: "PageBatchBlocked", 3: "SelectedMatchesBlocked"}
    assert {r.blocker for r in replace.plan_document_replacement(e.drop("batch_blocker")).collect()} == {None, "SelectedMatchesBlocked"}


def chars(text, width=10.0):
    return [(c, k * width, 0.0, width, 10.0) for k, c in enumerate(text)]


BOXES = "doc_id long, page_index long, chars array<struct<text: string, x: double, y: double, width: double, height: double>>"
MARKS = "doc_id long, page_index long, mark_id long, mx double, my double, mw double, mh double"


def test_ranges_bridge_blanks_between_hits_only(spark):
    page = spark.createDataFrame([(1, 0, chars("ab   cd e\n f  ")), (1, 1, []), (1, 2, None)], BOXES)
    marks = spark.createDataFrame([(1, 0, 0, 11.0, 1.0, 5.0, 5.0), (1, 0, 1, 51.0, 1.0, 5.0, 5.0), (1, 0, 2, 81.0, 1.0, 5.0, 5.0), (1, 0, 3, 111.0, 1.0, 30.0, 5.0), (1, 0, 4, 500.0, 1.0, 5.0, 5.0), (1, 1, 5, 0.0, 0.0, 5.0, 5.0)], MARKS)
    ranges = lambda **k: sorted((r.start, r.stop) for r in redact.mark_ranges(page, marks, **k).collect())
    assert ranges() == [(1, 6), (8, 9), (11, 14)]
    assert ranges(bridge_spaces=False) == [(1, 2), (5, 6), (8, 9), (11, 14)]
    assert sorted((r.page_index, r.mark_id) for r in redact.missed_marks(page, marks).collect()) == [(0, 4), (1, 5)]
    edge = spark.createDataFrame([(1, 0, 0, 20.0, 10.0, 10.0, 5.0)], MARKS)
    assert [(r.start, r.stop) for r in redact.area_ranges(page, edge).collect()] == [(1, 4)] and redact.mark_ranges(page, edge).count() == 0
    assert sorted((r.char_index, r.text) for r in redact.mark_glyphs(page, marks).collect())[:2] == [(1, "b"), (5, "c")]


LEVELS = [0, 1, 2, 2, 1, 2, 3, 0, 1]


def outlined(spark, **more):
    o = spark.createDataFrame([(1, i, v, f"i{i}", f"i{i}", i) for i, v in enumerate(LEVELS)], "doc_id long, idx long, level int, item_id string, title string, target long")
    return o.withColumns({k: F.expr(v) for k, v in more.items()})


def action(spark, value):
    o = spark.createDataFrame([(1, 0, None if value is None else json.dumps(value))], "doc_id long, idx long, action string")
    got = outline.remap_actions(o, spark.createDataFrame([(1, 10), (2, 20)], "target long, new_target long")).first().action
    return None if got is None else json.loads(got)


def test_actions(spark):
    go = lambda *d: {"S": "GoTo", "D": list(d)}
    page = lambda k: {"page": k}
    cases = [
        (go(page(1), "Fit"), go(page(10), "Fit")), (go(page(9), "Fit"), None), (go("name"), None), ({"S": "GoTo"}, None), (None, None),
        ({"S": "URI", "URI": 'a"page":9'}, {"S": "URI", "URI": 'a"page":9'}),
        ({"S": "Hide", "T": [page(9), [page(2)]]}, {"S": "Hide", "T": [None, [page(20)]]}),
        ({"S": "URI", "Next": [go(page(9)), go(page(2)), {"S": "X"}]}, {"S": "URI", "Next": [go(page(20)), {"S": "X"}]}),
        ({"S": "URI", "Next": [go(page(9))]}, {"S": "URI"}), ({"S": "URI", "Next": go(page(9))}, {"S": "URI"}), ({"S": "URI", "Next": go(page(1))}, {"S": "URI", "Next": go(page(10))}),
        ({"S": "R", "x": {"deep": [{"Next": [go(page(9)), {"S": "Y", "Next": []}]}]}}, {"S": "R", "x": {"deep": [{"Next": [{"S": "Y"}]}]}}),
        (go({"page": "1"}), go({"page": "10"})),
    ]
    for value, want in cases:
        assert action(spark, value) == want, value


def test_an_action_aims_where_there_is_no_target(spark):
    o = outlined(spark, action="case when idx in (2, 6) then concat('{\"S\":\"GoTo\",\"D\":[{\"page\":', idx, '}]}') when idx = 3 then '{\"S\":\"URI\"}' end").withColumn("target", F.expr("case when idx in (2, 3, 6) then null else target end"))
    got = outline.remap_outline(o, spark.createDataFrame([(6, 60), (8, 80)], "target long, new_target long")).orderBy("idx").collect()
    assert [(r.idx, r.target, r.action) for r in got] == [(0, None, None), (1, None, None), (3, None, '{"S":"URI"}'), (4, None, None), (5, None, None), (6, None, '{"S":"GoTo","D":[{"page":60}]}'), (7, None, None), (8, 80, None)]


def test_outline_diff_names_places(spark):
    o = outlined(spark)
    other = o.withColumn("item_id", F.concat(F.lit("z"), "item_id"))
    assert outline.outline_diff(o, other, ["level", "title", "target"]).count() == 0
    changed = other.withColumn("title", F.when(F.col("idx") == 6, "new").otherwise(F.col("title"))).where("idx <> 8")
    got = sorted(map(tuple, outline.outline_diff(o, changed, ["level", "title", "target"]).collect()))
    assert got == [(1, "0/1/0/0", "after", "content"), (1, "0/1/0/0", "before", "content"), (1, "1/0", "before", "only")]
    assert [r.path for r in outline.outline_paths(o).orderBy("idx").collect()] == ["0", "0/0", "0/0/0", "0/0/1", "0/1", "0/1/0", "0/1/0/0", "1", "1/0"]


def test_overlay_diff_looks_at_order_not_ids(spark):
    cols = "workspace_id long, pos long, z long, overlay_id string, text string, x double"
    a = spark.createDataFrame([(1, 0, 1, "p", "a", 1.0), (1, 0, 5, "q", None, 1.0), (1, 1, 0, "r", "b", 1.0), (1, 2, 0, "s", "c", 1.0), (1, 2, 1, "t", "d", 1.0)], cols)
    b = spark.createDataFrame([(1, 0, 0, "P", "a", 1.0), (1, 0, 1, "Q", None, 1.0), (1, 1, 0, "R", "b", 2.0), (1, 2, 1, "S", "c", 1.0), (1, 3, 0, "T", "e", 1.0)], cols)
    assert sorted(map(tuple, pages.overlay_diff(a, b, ["text", "x"]).collect())) == [(1, 1, 0), (1, 2, 1), (1, 3, 0)]


def test_outline_colours(spark):
    o = outlined(spark, color="case idx when 1 then array(0.0D, 1.0D, 0.5D) when 2 then array(0.0D, 1.1D, 0.5D) when 3 then array(double('NaN'), 0.0D, 0.0D) end")
    assert sorted(map(tuple, outline.validate_outline(o).collect())) == [(1, 2, "color"), (1, 3, "color")]


def test_links(spark):
    html = """<a href="/a">One <b>two</b>
      three</a><A class='x' HREF='/b?x=1'>B</A><a name="top">no</a><a href=/c>C<a href="/d">D</a><abbr href="no">x</abbr><a data-href="n" href = "/e>f"></a>"""
    got = outline.extract_links(spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")).orderBy("ordinal").collect()
    assert [(r.ordinal, r.href, r.name) for r in got] == [(0, "/a", "One two three"), (1, "/b?x=1", "B"), (2, "/c", None), (3, "/d", "D"), (4, "/e>f", "")]


def test_copies_of_copies_have_their_own_ids(spark):
    p = spark.createDataFrame([(1, 0, "a", 7, 0, 0), (1, 1, "b", 7, 1, 0)], "workspace_id long, pos long, page_id string, source_id long, page_index long, rotation int")
    first = spark.createDataFrame([(1, 0)], "workspace_id long, pos long")
    for want in (["a", "a-copy", "b"], ["a", "a-copy-2", "a-copy", "b"], ["a", "a-copy-3", "a-copy-2", "a-copy", "b"]):
        p = spark.createDataFrame(pages.duplicate_pages(p, first).collect(), p.schema)
        assert [r.page_id for r in p.orderBy("pos").collect()] == want


ROW = "doc_id long, page_index long, baseline double, row long, left double, right double, size double, first_text string, n_runs long, sizes array<double>"


def blocks(spark, *rows, mixed=True):
    df = spark.createDataFrame([(1, 0, float(b), 1, float(x), float(r), float(max(z)), "text", 3, [float(v) for v in z]) for b, x, r, z in rows], ROW)
    return [r.block for r in layout.segment_paragraphs(df, mixed=mixed).orderBy("baseline", ascending=False).collect()]


def test_rows_of_mixed_sizes_share_one(spark):
    assert blocks(spark, (100, 0, 90, [10]), (88, 0, 90, [10, 14]), (74, 0, 90, [14, 10])) == [0, 0, 0]
    assert blocks(spark, (100, 0, 90, [10]), (88, 0, 90, [10, 14]), (74, 0, 90, [14])) == [0, 0, 1]  # neighbours share 14, all three nothing
    assert blocks(spark, (100, 0, 90, [14, 10]), (84, 0, 90, [10, 14]), (70, 0, 90, [14])) == [0, 0, 0]
    assert blocks(spark, (100, 0, 90, [10]), (88, 0, 90, [10, 14]), mixed=False) == [0, 1]
    # the shared size measures the alignment, the largest one the leading
    assert blocks(spark, (100, 0, 90, [4, 20]), (80, 3, 96, [4, 20])) == [0, 1] and blocks(spark, (100, 0, 90, [20, 4]), (80, 3, 96, [4, 20])) == [0, 0]


def test_text_in_the_way_of_a_block(spark):
    cols = "doc_id long, page_index long, run long, block long, text string, left double, right double, bottom double, top double, baseline double, size double"
    run = lambda n, b, t, x, y, s=10.0: (1, 0, n, b, t, x, x + 30, y - 2, y + 0.8 * s, y, s)
    rows = [
        run(0, 1, "block", 100.0, 500.0), run(1, None, "up", 132.0, 506.0), run(2, None, "far", 145.0, 500.0), run(3, None, "1.", 68.0, 500.0), run(4, None, "1.", 132.0, 500.0),
        run(5, None, "  ", 132.0, 500.0), run(6, None, "low", 100.0, 488.0), run(7, 2, "two", 60.0, 500.0), run(8, 1, "own", 131.0, 500.0),
    ]
    got = sorted((r.block, r.other) for r in layout.neighbour_conflicts(spark.createDataFrame(rows, cols)).collect())
    near = lambda a, b: max(a[5] - b[6], b[5] - a[6], 0) <= a[10] and abs(a[9] - b[9]) <= 0.75 * a[10] and b[8] > a[9] - 0.25 * a[10] and b[7] < a[9] + 1.1 * a[10]
    want = sorted({(a[3], b[2]) for a in rows for b in rows if a[3] is not None and a[3] != b[3] and b[4].strip() and near(a, b) and not (b[4] == "1." and a[9] == b[9] and b[6] <= a[5])})
    assert got == want and (1, 1) in got and (1, 3) not in got and (1, 4) in got
    # pages of runs are not shuffled, and few pairs at a time give the same
    fields = "struct<run: long, block: long, text: string, left: double, right: double, bottom: double, top: double, baseline: double, size: double>"
    whole = spark.createDataFrame([(1, 0, [r[2:] for r in rows]), (2, 0, []), (3, 0, [r[2:] for r in rows])], f"doc_id long, page_index long, runs array<{fields}>")
    pages = layout.neighbour_conflicts(whole, pairs=2)
    assert sorted((r.doc_id, r.block, r.other) for r in pages.collect()) == sorted((d, *w) for d in (1, 3) for w in want)
    assert "Exchange" not in pages._jdf.queryExecution().toString()


def test_deleting_comments(spark):
    c = spark.createDataFrame([(1, 0, "a", None), (1, 1, "b", None), (1, 2, "c", None), (1, 3, "d", 2)], "conv_id long, turn long, text string, reply_to long")
    d = spark.createDataFrame([(1, 0, "a"), (1, 1, "other"), (1, 2, "c"), (1, 9, "x")], "conv_id long, turn long, expected_text string")
    left = review.delete_comments(c, d, ["conv_id", "turn"])
    assert sorted(r.turn for r in left.collect()) == [1, 2, 3]


def test_pages_meet_marks_as_text(spark):
    pages = spark.createDataFrame([(1, 0, "ab cd"), (1, 1, "xyz"), (2, 0, "other")], "doc_id long, page_index long, text string")
    boxed = F.transform(F.split("text", ""), lambda c, i: F.struct(c.alias("text"), (i * 6).alias("x"), F.lit(0).alias("y"), F.lit(6).alias("width"), F.lit(12).alias("height")))
    marks = spark.createDataFrame([(1, 0, 7, 7, 2, 6, 4), (1, 1, 8, 90, 2, 5, 5), (3, 0, 9, 0, 0, 9, 9)], "doc_id long, page_index long, mark_id long, mx int, my int, mw int, mh int")
    whole = pages.withColumn("chars", boxed)
    for job in (redact.mark_glyphs, redact.mark_ranges, redact.area_ranges, redact.missed_marks):
        got = job(pages, marks, chars=boxed)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, job(whole, marks).collect()))
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "transform(" in plan[: plan.index("Join")] and "transform(" not in plan[plan.index("Join") :]
    assert sorted(r.mark_id for r in redact.missed_marks(pages, marks, boxed).collect()) == [8, 9]
    assert [(r.start, r.stop) for r in redact.mark_ranges(pages, marks, chars=boxed).collect()] == [(1, 3)]


def test_only_a_match_is_taken_out_of_its_page(spark):
    pages = spark.createDataFrame([(1, "say the\nthe end", False)], "doc_id long, text string, vertical boolean")
    box = lambda c, at: F.struct(c.alias("text"), (at * 6).alias("x"), F.lit(0).alias("y"), F.lit(6).alias("width"), F.lit(12).alias("height"))
    some = lambda start, stop: F.transform(F.split(F.substring("text", (start + 1).cast("int"), (stop - start).cast("int")), ""), lambda c, k: box(c, start + k))
    found = search.search_matches(pages.select("doc_id", "text"), "the")
    want = search.match_rects(found, pages.withColumn("chars", F.transform(F.split("text", ""), box)), ["doc_id"]).collect()
    assert len(want) == 2 and sorted(search.match_rects(found, pages, ["doc_id"], some).collect()) == sorted(want)
