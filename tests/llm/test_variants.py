"""Spelling variants against all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest

from docspark.llm import queries, variants


def apart_by_one(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_forms(counts):
    near = {w: [v for v in counts if apart_by_one(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 2 * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return out


def plain_counts(rows, every=97):
    found = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda c: c[0].lower(), run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def vocabulary(kind, rng):
    if kind == "anagrams":  # one vector holds most words
        words = {"".join(rng.sample("abcdefqr", 8)) for _ in range(500)}
    elif kind == "long":
        base = ["".join(rng.choice("abé") for _ in range(3000)) for _ in range(4)]
        words = {b[:i] + c + b[i + k :] for b in base for i in (0, 1500, 2998) for c in ("", "z", "b") for k in (0, 1)} | {"a" * n for n in (5, 6, 7, 3000)}
    else:
        words = {"".join(rng.choice("aeqß×ÿÉ") for _ in range(rng.randint(5, 8))) for _ in range(700)}
    return {w: rng.choice([3, 3, 4, 6, 7, 12, 25, 50, 200]) for w in words}


@pytest.mark.parametrize("kind,cells", [("few letters", 1 << 20), ("few letters", 200), ("anagrams", 300), ("anagrams", 1 << 20), ("long", 5000), ("long", 1 << 20)])
def test_equals_all_pairs(spark, kind, cells):
    counts = vocabulary(kind, random.Random(7))
    words = spark.createDataFrame([(w, n, "x") for w, n in counts.items()], "word string, n long, near string")
    got = variants.spelling_variants(words, cells=cells)
    rows = [tuple(r) for r in got.select(*COLUMNS).collect()]
    assert len(rows) == len(counts) and set(rows) == plain_forms(counts)


def test_trie_rules_pairs_out_before_letters_are_compared():
    import numpy as np

    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(8)) for _ in range(2000)]
    letters = variants._matrix(words, 8)
    vectors = variants._vectors(letters)
    order = np.lexsort(vectors.T[::-1])
    reached = {(int(a), int(order[b])) for q, w in variants._descend(vectors[order], vectors, 1, 1) for a, b in zip(q, w)}
    assert len(reached) < 0.25 * len(words) ** 2
    assert all((i, j) in reached for i in range(0, 2000, 7) for j in range(len(words)) if apart_by_one(words[i], words[j]))


@pytest.mark.parametrize("every", [97, 3, None])
def test_word_counts(spark, every):
    rng = random.Random(5)
    pick = lambda: rng.choice(["Straße", "ÉCOLE", "école", "letters", "LETTERS", "ab", "×÷×÷×", "don't", "x1abcde", "日本aaaaa", "naïve\0naïve", "Ωmega", "i̇stanbul"])
    rows = [(rng.choice([None, 1, 2, 3]), " ".join(pick() for _ in range(9))) for _ in range(60)] + [(4, None), (5, ""), (6, "w" * 50_000)] * 3
    got = variants.word_counts(spark.createDataFrame(rows, "id long, text string"), "id", typo_every=every).collect()
    assert {r.word: r.n for r in got} == plain_counts(rows, every) and len(got) == len({r.word for r in got})


def test_empty(spark):
    none = spark.createDataFrame([(1, None), (2, "a b"), (3, "lonely words")], "doc_id long, text string")
    got = variants.spelling_variants(variants.word_counts(none, typo_every=97))
    assert got.columns == COLUMNS and got.collect() == []
    one = spark.createDataFrame([("alone", 3)], "word string, n long")
    assert [tuple(r) for r in variants.spelling_variants(one).collect()] == [("alone", None, "alone", 3, 0, None)]


def test_query_equals_all_pairs(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {tuple(r) for r in queries.op13_spelling_variants(spark, sf).select(*COLUMNS).collect()}
    assert got and got == plain_forms(plain_counts(rows))
