"""The corpus pipeline stage by stage against brute force, and the two classifiers against plain loops."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docspark.llm import language, quality
from test_dedup_join import brute_components

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row string, position double, id long"


def words(rng, n, bad):
    pool = [f"zx{k}q{k}" for k in range(40)] if bad else ["river", "garden", "morning", "letter", "window", "quiet", "market", "number", "travel", "bright"]
    return " ".join(str(rng.choice(pool)) + ("" if bad else str(int(rng.integers(30)))) for _ in range(n))


def corpus():
    rng = np.random.default_rng(4)
    texts = [(words(rng, int(rng.integers(20, 120)), k % 5 == 0), k % 5 != 0) for k in range(60)]
    texts.append((words(rng, 3000, False), True))
    for k in (1, 2, 3, 61 - 1):  # near copies
        w = texts[k][0].split()
        w[len(w) // 2] = "changed"
        texts.append((" ".join(w), True))
    texts += [texts[k] for k in (1, 1, 6, 7, 8)] + [(None, True), ("", True), ("  \n", True), ("one two", True)]
    sources = ["s1", "s2", "s3", None, "s5"]
    docs = [(i, t, "en", sources[i % 5], None if t is None else len(t), f"r{i}", 0.5, i % 3) for i, (t, _) in enumerate(texts)]
    docs += [docs[9], docs[9], (None, "no id " * 30, None, None, None, None, None, None)]
    labels = [(i, int(good), 0) for i, (_, good) in enumerate(texts) if i % 7] + [(3, None, None), (None, 1, 0), (4, 7, 0), (9, 0, 0)]
    return docs, labels


@pytest.fixture(scope="module")
def given(spark, tmp_path_factory):
    docs, labels = corpus()
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, COLUMNS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def stages(spark, given):
    """The rows before the first stage and after each one."""
    docs, out = spark.read.parquet(f"{given}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out.append(docs.collect())
        docs = corpus_pipeline.table(stage(spark, docs, given), name)
        if name != "packing":
            assert docs.columns == [c.split()[0] for c in COLUMNS.split(", ")]
    return [*out, docs.collect()]


def brute_quality(net, text):
    """The probability of one text: every filter at every place of every chunk."""
    raw = (text or "").encode()
    n = max(1, math.ceil((len(raw) - quality.WIDTH) / (quality.CHUNK - quality.WIDTH)))
    maxima = []
    for k in range(n):
        chunk = raw[k * (quality.CHUNK - quality.WIDTH) :][: quality.CHUNK].ljust(quality.CHUNK, b"\0")
        best = np.full(quality.FILTERS, -np.inf)
        for at in range(0, quality.CHUNK - quality.WIDTH + 1, quality.STEP):
            patch = np.concatenate([net["embed"][b] for b in chunk[at : at + quality.WIDTH]]).astype(float)
            best = np.maximum(best, patch @ net["filters"] + net["bias"])
        maxima.append(np.maximum(best, 0))
    v = np.concatenate([np.mean(maxima, 0), np.max(maxima, 0), np.min(maxima, 0)])
    z = float(np.tanh(v @ net["w1"] + net["b1"]) @ net["w2"] + net["b2"][0])
    return 1 / (1 + math.exp(-z))


def rows_by(rows):
    return sorted(map(repr, rows))


def test_quality_stage(spark, given, stages):
    before, after = stages[0], stages[1]
    net = quality.fit(spark.read.parquet(f"{given}/documents.parquet"), spark.read.parquet(f"{given}/labels.parquet"))
    score = {t: brute_quality(net, t) for t in {r.text for r in before}}
    assert all(abs(s - 0.3) > 1e-4 for s in score.values())
    assert rows_by(after) == rows_by(r for r in before if score[r.text] >= 0.3)
    got = quality.classify(spark.read.parquet(f"{given}/documents.parquet").select("doc_id", "text"), net).join(spark.read.parquet(f"{given}/documents.parquet").select("doc_id", "text"), "doc_id").collect()
    assert all(math.isclose(r.score, score[r.text], abs_tol=1e-4) and r.predicted == int(r.score >= 0.3) for r in got)
    assert len(before) > len(after) > 40


def test_exact_stage(stages):
    groups = {}
    for r in stages[1]:
        groups.setdefault(r.text or "", []).append(r)
    key = lambda r: -1 if r.doc_id is None else r.doc_id
    assert rows_by(stages[2]) == rows_by(max(g, key=key) for g in groups.values())


def test_near_copy_stage(stages):
    named = [r for r in stages[2] if r.doc_id is not None]
    component = brute_components([(r.doc_id, r.text) for r in named], 5, 80, 100)
    assert rows_by(stages[3]) == rows_by(r for r in stages[2] if r.doc_id is None or component[r.doc_id][1] == r.doc_id)
    assert len(stages[3]) < len(stages[2])


def test_mixing_stage(stages):
    size = lambda t: len((t or "").encode().split())
    before = {r.doc_id: r for r in stages[3]}
    per = Counter()
    for r in stages[3]:
        per[r.source] += size(r.text)
    names = sorted((s for s in per if s is not None)) + [None] * (None in per)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, left = {}, set(per)
    while True:
        rest = 1.5 * sum(per.values()) - sum(2 * per[s] for s in per if s not in left)
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = {s for s in left if share[s] > 2 * per[s]}
        if not over:
            break
        left -= over
    target = {s: share.get(s, 2 * per[s]) for s in per}
    taken, copies = Counter(), Counter()
    for r in stages[4]:
        was = before[r.doc_id]
        assert (was.text or "").startswith(r.text) and r.row == was.row and r.source == was.source
        assert r.n_chars == (was.n_chars if r.text == was.text else len(r.text))
        taken[r.source] += size(r.text)
        copies[r.doc_id] += 1
    assert max(copies.values()) <= 2
    assert all(abs(taken[s] - target[s]) <= 1 for s in per)


def test_packing_stage(stages):
    from docspark.llm.tokenizing import default_path
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(default_path())
    whole = Counter(tuple([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]) for r in stages[4])
    pieces, windows = {}, {}
    for r in stages[5]:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    for spans in windows.values():
        spans.sort()
        assert [o for o, _ in spans] == [0, *np.cumsum([n for _, n in spans])[:-1].tolist()] and sum(n for _, n in spans) <= 1024
    assert sum(len(ids) for p in pieces.values() for _, ids in p) == sum(n * len(t) for t, n in whole.items())
    starts = Counter(r.start for r in stages[5])
    assert starts[0] == sum(whole.values())
    for (_, n), p in pieces.items():
        copies = sum(s == 0 for s, _ in p)
        if copies == 1:
            assert tuple(x for _, ids in sorted(p) for x in ids) in whole and n == sum(len(ids) for _, ids in p)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_quality_bounds_rows_with_repeated_ids(spark):
    docs = spark.createDataFrame([(i % 4, f"text number {i} " * 30) for i in range(40)], "doc_id long, text string")
    seen = []
    plain, quality.fit_network = quality.fit_network, lambda docs, y: seen.append(len(docs))
    try:
        quality.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, quality int"), held=-1, sample=7)
    finally:
        quality.fit_network = plain
    assert seen == [7]


def test_language_scores_equal_plain_naive_bayes(spark):
    rng = np.random.default_rng(6)
    rows = [(i, "".join(rng.choice(list("abcdef é" if i % 3 else "abxyz ß"), int(rng.integers(1, 60)))), ["fr", "de", "it"][i % 3]) for i in range(90)]
    rows += [(200, "½ ²³ ①", "fr"), (201, "12 !", None), (202, None, "de"), (203, "ªª", None), (203, "ab", "fr"), (203, "ab", "fr"), (None, "abc", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")

    def buckets(t):
        t, out = t.lower(), []
        for n in (1, 2, 3):
            for k in range(len(t) - n + 1):
                h = n
                for c in t[k : k + n]:
                    h = ((h ^ ord(c)) * 0x9E3779B1) % 2**32
                    h ^= h >> 15
                out.append(h % language.BUCKETS)
        return out

    learns = [r for r in rows if r[1] is not None and r[2] is not None and not (r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 1)]
    langs = sorted({r[2] for r in learns})
    counts = {x: Counter(b for r in learns if r[2] == x for b in buckets(r[1])) for x in langs}
    log_p = lambda x, b: math.log((counts[x][b] + 0.5) / (sum(counts[x].values()) + 0.5 * language.BUCKETS))
    prior = {x: math.log(sum(r[2] == x for r in learns) / len(learns)) for x in langs}
    want = {}
    for i, t, _ in rows:
        if t is None or not any(c.isalpha() for c in t):
            want[i, t] = ("und", 0.0)
            continue
        b = buckets(t)
        whole = {x: sum(log_p(x, k) for k in b) for x in langs}
        best = max(langs, key=lambda x: whole[x] + prior[x])
        soft = {x: math.exp(whole[x] * min(1, 30 / len(b)) + prior[x]) for x in langs}
        want[i, t] = (best, soft[best] / sum(soft.values()))
    for group in (256, 2, 1):
        model = language.fit(docs, group=group)
        got = language.identify(docs.withColumn("keep", F.col("text")), model, group=group).join(docs.select("doc_id", "text").distinct(), "doc_id", "left").collect()
        for r in got:
            if r.doc_id not in (None, 203):
                lang, score = want[r.doc_id, r.text]
                assert r.lang_pred == lang and math.isclose(r.score, score, abs_tol=1e-4)
        assert sorted(r.lang_pred for r in language.identify(docs, model, group=group).where("doc_id = 200 or doc_id is null").collect())[-1] == "und"
