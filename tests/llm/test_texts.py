"""Token counts, packing, mixing and quality on small tables."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docspark.llm import mixing, packing, quality, tokenizing

SCHEMA = "doc_id long, text string, score string"
TEXTS = [
    None, "", " ", "Hello world's  test\n\n  end", "naïve café 123 ½ ²  x", "日本語 text 🙂🙂 ok", "a<|endoftext|>b <|endoftext|>", "x" * 5000, "\t\n" * 300 + "z",
    "it's we'll I'D don't " * 40, "\x1c\x1d\x85 y z", "ʼn ǅ ȡ word", "-- ** != 12345678901234567890 " * 30, " ̀ combining á",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizing.default_path())


def test_encode_equals_library(library):
    long = ["".join(t or "" for t in TEXTS) * 30, ("word " * 50 + "\n\n") * 200, " " * 3000, "ab" * 4000, "é" * 3000 + " " + "z" * 2000, "a<|endoftext|>" * 400]
    for chunk, overlap in ((1 << 15, 256), (400, 40), (97, 3)):
        enc = tokenizing.Encoder(tokenizing.default_path(), chunk=chunk, overlap=overlap, remember=50)
        for t in [*(t for t in TEXTS if t), *long]:
            got = np.frombuffer(b"".join(enc.encode(t)), "<u4").tolist()
            assert got == library.encode(t, add_special_tokens=False).ids, (chunk, t[:60])


def test_token_counts(spark, library):
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(TEXTS)] + [(None, "a b", "s")], SCHEMA)
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in tokenizing.token_counts(docs).collect()}
    for i, t in enumerate(TEXTS):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert got[i] == (len((t or "").encode()), n, n > 512)
    assert tokenizing.token_counts(docs.limit(0)).count() == 0


def test_pack_round_trip(spark, library):
    texts = TEXTS * 8
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], SCHEMA).repartition(3)
    rows = packing.pack(docs).withColumn("crc", F.crc32("ids")).collect()
    back, seqs = {}, {}
    for r in rows:
        assert len(r.ids) == 4 * r.length and r.crc == zlib.crc32(r.ids) and r.length > 0
        back.setdefault(r.doc_id, []).append((r.start, bytes(r.ids), r.doc_tokens))
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, t in enumerate(texts):
        want = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        pieces = sorted(back[i])
        assert b"".join(p[1] for p in pieces) == want and all(p[2] * 4 == len(want) for p in pieces)
    for parts in seqs.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        total = sum(n for _, n in parts)
        assert total <= 1024 and total & (total - 1) == 0
    assert packing.pack(docs.limit(0)).count() == 0


def brute_targets(sizes, share=1.5, most=2.0):
    """Give what is left by weight again and again, stopping sources at their limit."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, open_, left = {}, set(order), share * sum(sizes.values())
    while open_:
        rate = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if rate * weight[s] > most * sizes[s] + 1e-9}
        if not full:
            target |= {s: rate * weight[s] for s in open_}
            break
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_mix_meets_targets(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "w " * int(rng.integers(0, 60)), [None, "b", "a", "é", "Z", "hot", "hot", "hot"][int(rng.integers(8))]) for i in range(600)]
    rows += [(700, None, "a"), (701, "", None), (None, "x y", "b"), (800, "q q", "b"), (800, "q q", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = brute_targets(sizes)
    per = {}
    source_of = {r[0]: r[2] for r in rows}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        assert (r.position is not None) == (r.taken > 0) and (r.position is None or 0 <= r.position <= 1)
        s = source_of[r.doc_id]
        per[s] = per.get(s, 0) + r.taken
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6
    assert all(abs(per[s] - want[s]) <= 1 for s in want)
    assert sorted(map(str, mixing.mix(docs.repartition(5)).collect())) == sorted(map(str, got))
    order = mixing.training_order(docs)
    assert order.columns == docs.columns
    assert sum(len((r.text or "").split()) for r in order.collect()) == sum(r.taken for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mix_is_sorted_by_position(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 9), f"s{i % 4}", 1) for i in range(200)] + [(5, "w w", "s1", 1)] * 2, "doc_id long, text string, source string, size int").repartition(4)
    at = [r.position for r in mixing.mix(docs).collect()]
    known = [x for x in at if x is not None]
    assert known == sorted(known) and None not in at[: len(known)] and 0 < known[0] and known[-1] <= 1 and len(at) == 202


def test_training_order_follows_the_positions(spark):
    rows = [(i, " ".join(f"t{i}x{k}" for k in range(i % 9)) + " ", f"s{i % 4}", 1, 0.5) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, position double").repartition(4)
    by_id = {r[0]: r for r in rows}
    want = sorted((p, r.doc_id) for r in mixing.mix(docs).collect() for p in (r.position, r.position2) if p is not None)
    got = mixing.training_order(docs, length_col="size").collect()
    assert [r.doc_id for r in got] == [i for _, i in want]
    for r in got:
        was = by_id[r.doc_id]
        assert was[1].startswith(r.text) and r.position == 0.5 and r.size == (1 if r.text == was[1] else len(r.text))
    taken = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    for i in by_id:
        assert sum(len(r.text.split()) for r in got if r.doc_id == i) == taken[i]
    assert mixing.training_order(docs.limit(0)).count() == 0


def test_other_kinds_of_vocabulary(spark):
    import os

    import public_tokenizers

    folder = os.path.dirname(public_tokenizers.path("byte_bpe_50k.json"))
    models = sorted(f for f in os.listdir(folder) if f.endswith(".model"))
    assert models
    import sentencepiece

    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(TEXTS)] + [(3, "again", "s")] * 2, SCHEMA)
    for name in models:
        library = sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder, name))
        got = sorted((r.doc_id, r.n_tokens) for r in tokenizing.token_counts(docs, tokenizer=os.path.join(folder, name)).collect())
        assert got == sorted([(i, len(library.encode(t or ""))) for i, t in enumerate(TEXTS)] + [(3, len(library.encode("again")))] * 2)
    from tokenizers import Tokenizer

    word = os.path.join(folder, "word_bpe_49k.json")
    library = Tokenizer.from_file(word)
    got = sorted((r.doc_id, r.n_tokens) for r in tokenizing.token_counts(docs, tokenizer=word).where("doc_id <> 3").collect())
    assert got == [(i, len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(TEXTS) if i != 3]


def test_quality_learns(spark):
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 5))
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        rows.append((i, " ".join(word().upper() + "!!" if bad else word() + "." * (k % 7 == 0) for k in range(int(rng.integers(5, 300)))), "s"))
        labels.append((i, 0 if bad else 1))
    docs, lab = spark.createDataFrame([*rows, (1000, None, "s"), (1001, "", "s"), (None, "abc", "s")], SCHEMA), spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, quality int")
    net = quality.fit(docs, lab)
    got = {r.doc_id: r for r in quality.classify(docs, net).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (i in set(held)) for i in range(400))
    assert np.mean([got[i].predicted == (i % 4 != 0) for i in held]) > 0.95
    assert 0 <= got[1000].score == got[1001].score <= 1 and not got[None].held_out
    assert quality.keep_good(docs, net).columns == docs.columns
    assert quality.classify(docs.limit(0), net).count() == 0
    assert 0 <= quality.classify(docs, quality.fit(docs, lab.limit(0))).first().score <= 1
