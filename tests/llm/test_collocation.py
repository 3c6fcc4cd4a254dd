"""Phrase mining against a plain count in Python, and against SQL."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from docspark.llm import collocation, queries


def plain(rows, least, most, overlap, top):
    f, out = Counter(), []
    for text, lang in rows:
        low = re.sub("[A-Z]", lambda c: c[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = re.findall("[^ \t]+", piece)
            f.update((lang or "und", tuple(w[i : i + m])) for m in range(1, most + 1) for i in range(len(w) - m + 1))
    cands = {k: n for k, n in f.items() if len(k[1]) > 1 and n >= least}
    for lang in {k[0] for k in cands}:
        n = sum(v for k, v in f.items() if k[0] == lang and len(k[1]) == 1)
        found = []
        for (la, p), a in cands.items():
            if la != lang:
                continue
            holds = [v for (lb, q), v in cands.items() if lb == la and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * v >= overlap * a for v in holds):
                continue
            score, k = min((10**6 * a * a // (f[la, p[:k]] * f[la, p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[la, p[:k]], f[la, p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["red", "Fox", "fox", "é", "Éa", "x y", "\tb", "a\0b", "ab", ". c", "d,", "e\x0b", "🎉", "日本", "w z"]
    text = lambda: " ".join(rng.choice(words[: rng.randint(2, len(words))]) for _ in range(rng.randint(0, 30)))
    rows = [(text(), rng.choice(["en", "de", None, "und", "a\nb"])) for _ in range(n)]
    return rows + [(None, "en"), ("", None), ("  \t ", "de")] + [("the same old copy, again and again", "en")] * (n // 2) + [("go on " * 3000, "fr")]


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@pytest.mark.parametrize("least,most,shards,bits", [(10, 3, 4, 26), (3, 4, 2, 8), (2, 2, 1, 26), (12, 5, 8, 26)])
def test_equals_plain_counts(spark, least, most, shards, bits):
    rows = corpus(least, 150)
    docs = spark.createDataFrame([(*r, 7, "x") for r in rows], "text string, lang string, n int, phrase string").repartition(5)
    got = collocation.collocations(docs, least=least, most_words=most, shards=shards, most_bits=bits, top=40)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect())) == plain(rows, least, most, 50, 40)


def test_empty_and_hopeless_tables(spark):
    for rows in ([], [(None, None)], [("one two three", "en")]):
        assert collocation.collocations(spark.createDataFrame(rows, "text string, lang string")).collect() == []


@pytest.mark.parametrize("a,left,right", [(3_000_000_019, 3_000_000_021, 9_000_000_007), (10**15 + 37, 10**15 + 91, 10**15 + 37), (10**16 - 1, 10**16 - 1, 10**16 - 1), (10, 10, 10**12)])
def test_scores_beyond_64_bits_are_exact(spark, a, left, right):
    row = spark.createDataFrame([(a, left, right)], "a long, l long, r long").select(collocation.score("a", "l", "r").alias("s")).first()
    assert row.s == 10**6 * a * a // (left * right)


def test_keys_of_equal_words_agree_across_batches():
    one, two = collocation.Words([b"x  y\tz" + b"w" * 100, b"q"]), collocation.Words([b"q", b"x. Z x Y z" + b"W" * 100, b""])

    def keys(words):
        out = {}
        for m, at, ks in collocation._grams(words, 3, 5):
            for p, k in zip(at, ks):
                out[words.text(words.first[p], words.first[p + m - 1] + words.size[p + m - 1] - words.first[p])] = int(k)
        return out

    a, b = keys(one), keys(two)
    z = b"z" + b"w" * 100
    assert a[b"x y " + z] == b[b"x y " + z] and a[b"q"] == b[b"q"] and a[z] == b[z] and not any(z + b" q" in k for k in a) and b"x z" not in b
    assert len(set(b.values())) == len(b)
    assert not len(collocation.Words([b"", b" . "]).size) and not len(collocation.Words([]).size)


def test_spans_of_one_key_are_told_apart():
    words = collocation.Words([b"one two one three one two-and-twenty two-and-twenty onex"])
    got = list(words.counts(words.first, words.size, np.zeros(len(words.size), np.uint64)))
    assert sorted(got) == [(b"one", 3), (b"onex", 1), (b"three", 1), (b"two", 1), (b"two-and-twenty", 2)]


def test_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    got = sorted(tuple(r[c] for c in COLUMNS) for r in queries.op12_collocations(spark, sf).collect())
    sql = queries.ORACLE_SQL["op12_collocations"]
    want = duckdb.sql(f"WITH documents AS (SELECT * FROM '{sf}/documents.parquet') SELECT {', '.join(COLUMNS)} FROM ({sql})").fetchall()
    assert got and got == sorted(want)
