import numpy as np

from docspark.operators import assemble, recognised
from docspark.plans import queries


def test_page_arrays_of_words_equal_rows_of_them(spark):
    line = lambda *words: ([(t, c) for t, c in words],)
    blocks = [([([line(("One", 5), ("two", 9))],), ([line(), line(("", 1), ("long words", 200))],)],), ([([line((None, 3))],)],)]
    kind = "doc_id long, page_index long, blocks array<struct<paragraphs: array<struct<lines: array<struct<words: array<struct<text: string, confidence: long>>>>>>>>"
    blocks = [([(lines[0],) for lines in b[0]],) for b in blocks]
    pages = spark.createDataFrame([(1, 0, blocks), (1, 1, blocks[:1]), (1, 2, []), (2, 0, blocks[1:])], kind)
    rows = recognised.ocr_words(pages)
    arrays = recognised.ocr_word_arrays(pages)
    again = arrays.selectExpr("doc_id", "page_index", "inline(words)")
    assert sorted(map(str, again.collect())) == sorted(map(str, rows.collect())) and again.columns == rows.columns
    box = "0 AS x, 0 AS y, 10 AS width, 10 AS height"
    for most in ({}, {"most_words": 3}, {"most_chars": 5}, {"most_lines": 1}):
        want = assemble.ocr_page_validate(rows.selectExpr("*", *box.split(", ")), 100, 100, ["doc_id", "page_index"], "page_line", **most)
        got = assemble.ocr_page_validate(boxed(arrays), 100, 100, ["doc_id", "page_index"], "page_line", **most)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def boxed(arrays):
    names = arrays.schema["words"].dataType.elementType.names
    return arrays.selectExpr("doc_id", "page_index", f"transform(words, w -> named_struct({', '.join(f'{n!r}, w.{n}' for n in names)}, 'x', 0, 'y', 0, 'width', 10, 'height', 10)) AS words")


def test_exclude_existing_equals_all_pairs(spark):
    rng = np.random.default_rng(5)
    spot = lambda far: None if rng.random() < 0.03 else float(rng.integers(-far, far)) / 4
    size = lambda: float(rng.choice([0, 0.5, 5, 20, 300], p=[0.1, 0.1, 0.4, 0.35, 0.05]))
    box = lambda p: (spot(500 * p), spot(500 * p), size(), size())
    words = {p: [(f"{p}/{k}", *box(p)) for k in range(n)] for p, n in ((1, 60), (2, 200), (3, 5), (4, 0), (6, 1))}
    native = {p: [box(p) for _ in range(n)] for p, n in ((1, 25), (2, 120), (3, 0), (4, 7), (5, 3), (6, 1))}
    words[6], native[6] = [("6/0", 10.0, 0.0, 20.0, 10.0)], [(24.5, 0.0, 12.0, 10.0)]  # the box's centre lies on the very edge of the grown word
    mid = lambda at, size: at + size / 2
    holds = lambda b, c: None not in (*b, *c) and all(b[k] - 0.5 <= mid(c[k], c[k + 2]) <= b[k] + b[k + 2] + 0.5 for k in (0, 1))
    want = sorted((p, w[0]) for p, ws in words.items() for w in ws if not any(holds(w[1:], b) or holds(b, w[1:]) for b in native.get(p, [])))
    assert 80 < len(want) < 220 and (6, "6/0") not in want
    kind = "x double, y double, width double, height double"
    w = spark.createDataFrame([(*i[:1], p, *i[1:]) for p, ws in words.items() for i in ws], f"word_id string, page long, {kind}")
    n = spark.createDataFrame([(p, *b) for p, bs in native.items() for b in bs], f"page long, {kind}")
    arrays = spark.createDataFrame([(p, ws, native.get(p)) for p, ws in words.items()] + [(9, None, [])], f"page long, words array<struct<word_id: string, {kind.replace(' double', ': double')}>>, native array<struct<{kind.replace(' double', ': double')}>>")
    for step in (1, 100, 1 << 16):
        got = assemble.ocr_exclude_existing(w, n, ["page"], step=step)
        assert got.columns == w.columns and sorted((r.page, r.word_id) for r in got.collect()) == want
        got = assemble.ocr_exclude_existing(arrays, None, ["page"], cell=7.0, step=step)
        assert sorted((r.page, r.word_id) for r in got.collect()) == want
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert assemble.ocr_exclude_existing(w, n.limit(0), ["page"]).count() == w.count()


def test_words_are_made_where_they_are_compared(spark):
    """What is dealt to tasks is a row for each line, without words or cells of a grid."""
    plan = queries.e5_ocr_exclude_existing(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "Join" not in plan and "Aggregate" not in plan
    assert plan.index("MapInArrow") < plan.index("transform(") < plan.index("RepartitionByExpression")
