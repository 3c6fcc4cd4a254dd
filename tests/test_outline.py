import random

import pytest
from pyspark.sql import functions as F

from docspark.operators import outline

COLS = "doc_id long, idx long, level int, item_id string, title string, target long"


def made(docs: int, longest: int, seed: int):
    """Outlines, some with skipped levels; a list of (doc_id, idx, level)."""
    r, rows = random.Random(seed), []
    for d in range(docs):
        level = 0
        for i in range(r.randint(1, longest)):
            rows.append((d, 2 * i, level))
            level = min(r.randint(0, level + 1 + (d % 5 == 4)), 33)
    return rows


def plain(rows):
    """For each item its parent, the end of its branch and its path, by going over its document for each."""
    docs, out = {}, {}
    for d, i, v in rows:
        docs.setdefault(d, []).append((i, v))
    for d, items in docs.items():
        parent = {i: max((j for j, w in items if j < i and w == v - 1), default=None) for i, v in items}
        place = {i: sum(parent[j] == parent[i] for j, _ in items if j < i) for i, _ in items}
        for i, v in items:
            above = [max((j for j, w in items if j < i and w == k), default=None) for k in range(v)]
            end = min((j for j, w in items if j > i and w <= v), default=items[-1][0] + 1)
            out[d, i] = (parent[i], end, "/".join(str(place[j]) for j in [*above, i] if j is not None))
    return out


def test_outlines_across_batches(spark):
    rows = made(300, 30, 1) + [(1000, 2 * i, i % 3) for i in range(700)]
    want = plain(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
    try:
        o = spark.createDataFrame([(d, i, v, f"{d}/{i}", "t", i) for d, i, v in rows], COLS).orderBy(F.rand(3))
        ends = {(r.doc_id, r.idx): r.branch_end for r in outline.branch_end(o).collect()}
        paths = {(r.doc_id, r.idx): (r.parent, r.path) for r in outline.outline_paths(o).collect()}
        assert {k: (paths[k][0], ends[k], paths[k][1]) for k in ends} == want and len(paths) == len(want)
        kids = {}
        for (d, i), (p, _, _) in sorted(want.items()):
            kids.setdefault((d, p), []).append(i)
        for r in outline.outline_parents(o).collect():
            kin, mine = kids[r.doc_id, r.parent], kids.get((r.doc_id, r.idx), [None])
            at = kin.index(r.idx)
            assert (r.prev_sibling, r.next_sibling, r.first_child, r.last_child) == (kin[at - 1] if at else None, kin[at + 1] if at + 1 < len(kin) else None, mine[0], mine[-1])
        live = {i for _, i, _ in rows if i % 14 == 0}
        got = {(r.doc_id, r.idx) for r in outline.remap_outline(o, spark.createDataFrame([(i, i) for i in live], "target long, new_target long")).collect()}
        assert got == {(d, i) for d, i, _ in rows if any(j in live for j in range(i, want[d, i][1], 2))}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_edits_without_outline_and_several_edits(spark):
    o = spark.createDataFrame([(d, i, min(i, 1), f"{d}/{i}", "t", i) for d in (1, 2, 3) for i in range(3)], COLS)
    e = spark.createDataFrame([(1, 1, "retitle", "+", " ", 9), (2, 1, "remove", "+", "x", 9), (2, 2, "remove", "+", "x", 9), (3, 2, "retarget", "+", None, 9), (9, None, "add", "+", "x", 9)], "doc_id long, at long, op string, new_id string, new_title string, new_target long")
    got = sorted(tuple(r) for r in outline.edit_outline(o, e).collect())
    assert got == [(d, i, min(i, 1), f"{d}/{i}", "t", 9 if (d, i) == (3, 2) else i) for d in (1, 2, 3) for i in range(3)]


@pytest.mark.parametrize("run", [outline.outline_parents, outline.branch_end, lambda o: outline.outline_diff(o, o, ["title"]), lambda o: outline.outline_counts(o.withColumn("closed", F.lit(True)))])
def test_an_outline_is_sorted_once_and_without_windows(spark, run):
    o = spark.createDataFrame([(1, 0, 0, "i", "t", 0)], COLS)
    plan = run(o)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join" not in plan and plan.count("Sort ") == 1
