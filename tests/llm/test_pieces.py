"""Piece encoding against the library."""

import hashlib
import random

import pytest

from docspark.llm import pieces, queries

PATH = pieces.default_path()


@pytest.fixture(scope="module")
def enc():
    return pieces.PieceEncoder(PATH, remember=500)


def texts():
    """Joined pieces, runs of blanks, rare and control characters, repeated letters; long ones among them."""
    rng = random.Random(11)
    from sentencepiece import SentencePieceProcessor

    lib = SentencePieceProcessor(model_file=PATH)
    some = [lib.id_to_piece(rng.randrange(lib.vocab_size())) for _ in range(400)]
    parts = [lambda: rng.choice(some), lambda: rng.choice(some).replace("▁", " "), lambda: " " * rng.randint(1, 40), lambda: chr(rng.randrange(0x300)), lambda: rng.choice("abcthe\n\0🎉")]
    yield from ["".join(rng.choice(parts)() for _ in range(rng.randint(0, 12))) for _ in range(1500)]
    yield from ["".join(rng.choice("aeinthso ") for _ in range(80)) for _ in range(500)]
    yield from ["", " ", "▁", "\0", "<s>a</s><unk><0x41>", "a" * 20_000, "ab" * 9_999, " " * 20_001, "x" + "=-" * 9_000, "\n" * 99, "日本語 " * 3000, "é   ﻿�"]


def test_ids_and_text_equal_the_library(enc):
    for t in texts():
        ids = enc.encode(t)
        assert ids.tolist() == enc.library.encode(t), t[:80]
        assert enc.decode(ids) == enc.library.decode(enc.library.encode(t))


def test_pieces_that_do_not_fit_are_given_back(enc):
    """Among the texts are some whose longest matches, taken one after the other, are not the encoding."""
    greedy = 0
    for t in texts():
        text = enc.library.normalize(t)[:200]
        at, taken = 0, []
        while at < len(text):
            taken.append(next(text[at : at + n] for n in range(min(16, len(text) - at), 0, -1) if n == 1 or text[at : at + n] in enc.numbers))
            at += len(taken[-1])
        greedy += taken != [enc.names[n] for n in enc.split(text)]
    assert greedy > 100


def test_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (2, "", "x"), (None, "a  b ", "x"), (3, "the\0end " * 30_000, None), (4, "Straße\ttwo", "y")]
    got = pieces.encode_decode(spark.createDataFrame(rows, "id long, text string, ids string"), "id").collect()
    from sentencepiece import SentencePieceProcessor

    lib = SentencePieceProcessor(model_file=PATH)
    want = [(i, lib.encode(t or ""), lib.decode(lib.encode(t or ""))) for i, t, _ in rows]
    assert sorted(map(str, got)) == sorted(map(str, [type(got[0])(id=i, ids=x, decoded=d) for i, x, d in want]))
    empty = pieces.encode_decode(spark.createDataFrame([], "ids long, text string"), "ids")
    assert empty.columns == ["ids", "ids_", "decoded"] and not empty.collect()


def test_other_models_are_refused(tmp_path):
    kind = bytes([0x12, 2, 0x18, 1])  # a trainer's message whose type is not the merge type
    (tmp_path / "m.model").write_bytes(kind)
    with pytest.raises((ValueError, OSError, RuntimeError)):
        pieces.PieceEncoder(str(tmp_path / "m.model"))


def test_query_digests(spark):
    from sentencepiece import SentencePieceProcessor

    lib, sf = SentencePieceProcessor(model_file=PATH), "/root/testdata/sf0.001"
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {(d, len(i), sha(",".join(map(str, i))), sha(lib.decode(i))) for d, i in ((r.doc_id, lib.encode(r.text or "")) for r in docs)}
    assert {tuple(r) for r in queries.op11_piece_encoding(spark, sf).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()} == want
