"""Exact duplicates and the n-gram join against brute force, with nulls, empties, ties and repeated rows."""

import hashlib
import random

import numpy as np
import pytest

from docspark.llm import exact_dedup, ngram_join

SCHEMA = "doc_id long, text string, kept string, row long"


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "Zeta", "eta", "theta"]) + str(rng.randrange(40)) for _ in range(n))


def corpus(seed=3):
    rng = random.Random(seed)
    texts = [None, "", "  \n ", "one two", "One TWO", "one two three", "é è ê ç", "É è ê ç"]
    for _ in range(25):
        base = words(rng, rng.choice([3, 4, 8, 30, 60, 200])).split()
        texts.append(" ".join(base))
        for _ in range(rng.randrange(6)):
            t = base[:]
            for _ in range(rng.randrange(1, 6)):
                t[rng.randrange(len(t))] = "x" + str(rng.randrange(1000))
            texts.append(" ".join(t))
    texts += texts[10:20] + [texts[12]] * 5
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(i, texts[k], "clash", 1) for i, k in enumerate(order)]


def brute_components(rows, n, num, den):
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if den * common >= num * (len(sets[a]) + len(sets[b]) - common):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("n,threshold", [(4, (85, 100)), (5, (80, 100))])
def test_near_duplicates_equal_brute_force(spark, n, threshold):
    rows = corpus()
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), words=n, threshold=threshold).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, n, *threshold)
    assert len(got) == len(rows)


def test_near_duplicates_edges(spark):
    none = ngram_join.near_duplicates(spark.createDataFrame([], SCHEMA))
    assert none.columns == ["doc_id", "n_shingles", "component_id"] and none.count() == 0
    got = ngram_join.near_duplicates(spark.createDataFrame([(None, "a b c d e f", "", 0), (7, "a b c d e f", "", 0), (7, "a b c d e f", "", 0)], SCHEMA), words=4).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in got) == [(0, 3, 0), (7, 3, 7), (7, 3, 7)]


def test_ids_with_several_texts_have_the_links_of_all(spark):
    rng = random.Random(4)
    texts = [t for _, t, *_ in corpus() if t and len(t.split()) > 6]
    a, b = texts[0], texts[-1] + " other words entirely"
    rows = [(1, a), (1, b), (2, a), (3, b)] + [(rng.randint(10, 45), rng.choice([*texts, None, ""])) for _ in range(90)] + [(60, t) for t in texts[:5]]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    parts = brute_components([(k, t) for k, (_, t) in enumerate(rows)], 4, 85, 100)
    for k, (_, c) in parts.items():
        x, y = find(rows[k][0]), find(rows[c][0])
        parent[max(x, y)] = min(x, y)
    got = ngram_join.near_duplicates(spark.createDataFrame([(i, t, "", 0) for i, t in rows], SCHEMA).repartition(3), words=4, threshold=(85, 100)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted((i, parts[k][0], find(i)) for k, (i, _) in enumerate(rows))
    assert {r.component_id for r in got if r.doc_id in (1, 2, 3)} == {1}


def test_signatures_never_lose_a_pair():
    rng, tried = np.random.default_rng(1), 0
    for num in (85, 80):
        for size in (1, 3, 5, 7, 9, 12, 40, 150, 700, 3000):
            for _ in range(40):
                base = rng.integers(1, 2**63, size, dtype=np.int64).astype(np.uint64)
                gone = int(rng.integers(0, (100 - num) * size // 100 + 1))
                new = int(rng.integers(0, (100 - num) * size // 100 + 1))
                other = np.concatenate([base[gone:], rng.integers(1, 2**63, new, dtype=np.int64).astype(np.uint64)])
                a, b = np.unique(base), np.unique(other)
                common = len(np.intersect1d(a, b))
                if 100 * common < num * (len(a) + len(b) - common):
                    continue
                tried += 1
                sig, own = ngram_join.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), num, 100)
                assert set(sig[own == 0]) & set(sig[own == 1])
    assert tried > 300


def test_keep_first_keeps_columns(spark):
    rows = corpus(5)
    want = {i for i, (_, c) in brute_components(rows, 5, 80, 100).items() if c == i}
    got = ngram_join.keep_first(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["doc_id", "text", "kept", "row"]
    assert {r.doc_id for r in got.collect()} == want


def test_golomb_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 5, 1000):
        for m in (1, 2, 3, 1000, 1 << 40):
            v = np.unique(rng.integers(0, max(1, n) * m * 2, n))
            assert (exact_dedup.golomb_decode(exact_dedup.golomb_encode(v, m), len(v), m) == v).all()


def test_exact_dedup_equals_brute_force(spark):
    rows = corpus() + [(500, None, "x", 0), (501, "", "x", 0), (None, "one two", "x", 0)]
    rows += rows[20:23]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = exact_dedup.exact_dedup(docs, per_owner=20).collect()
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(t or "", []).append(-1 if i is None else i)
    assert len(got) == len(rows)
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): g for t, g in groups.items()}
    for r in got:
        g = by_sha[r.text_sha256]
        assert (r.keep_id, r.group_size) == (max(g), len(g))
    left = exact_dedup.keep_one(docs)
    assert left.columns == docs.columns
    assert sorted((r.text or "") for r in left.collect()) == sorted(groups)


def test_exact_dedup_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.exact_dedup(empty).count() == 0 and exact_dedup.keep_one(empty).count() == 0


@pytest.mark.parametrize("n,threshold", [(4, (85, 100)), (5, (80, 100))])
def test_long_documents_that_share_passages(spark, n, threshold):
    """Sets on both sides of the wide sketches' bounds (512, and powers of two at 0.7 of the size), near copies of every grade among them."""
    rng = random.Random(8)
    passages = [words(rng, 60) for _ in range(3)]
    texts = []
    for size in (400, 520, 730, 740, 1460, 1470, 3000):
        base = words(rng, size).split()
        for changed in (0, 2, 4, 6, 8, 12):
            t = base[:]
            for _ in range(changed * size // 400):
                t[rng.randrange(len(t))] = "x" + str(rng.randrange(10**6))
            texts.append(" ".join([*t, *rng.sample(passages, 2)]))
        texts.append(" ".join([*base[: size * 9 // 10], *passages]))
    rng.shuffle(texts)
    rows = [(i, t, "", 0) for i, t in enumerate(texts)]
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(5), words=n, threshold=threshold).collect()
    expected = brute_components(rows, n, *threshold)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == expected
    assert 1 < len({c for _, c in expected.values()}) < len(rows)


def test_only_split_groups_are_looked_at_again(spark):
    """Of the stars only groups with an edge between components are taken on, whole, whichever way round the edge is."""
    stars = spark.createDataFrame([(1, 2, 1), (1, 3, 1), (2, 5, 4), (2, 4, 6), (3, 8, 7), (4, 9, 7), (4, 10, 7)], "key long, b long, a long")
    tried = stars.selectExpr("least(a, b) a", "greatest(a, b) b").distinct()
    comp = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (7, 7), (9, 7)], "v long, component long")
    got = sorted(map(tuple, ngram_join._split_groups(stars, tried, comp, 23).collect()))
    assert got == [(2, 4, 6), (2, 5, 4), (3, 8, 7), (4, 9, 7), (4, 10, 7)]
