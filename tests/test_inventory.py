import hashlib

from docspark.sources import corpus


def test_inventory_reads_mounted_files_in_blocks(spark, tmp_path):
    (tmp_path / "deep er").mkdir()
    for name, body in (("a", b"\xef\xbb\xbfx\n" * 5000), ("deep er/b%20", b"\xef\xbb\xbfx\n" * 5000), ("c.gz", b"plain")):
        (tmp_path / name).write_bytes(body)
    got = corpus.binary_inventory(spark, str(tmp_path), block=7)
    assert sorted((r.length, r.magic, r.copies) for r in got.collect()) == [(5, "706C61696E", 1), (25000, "EFBBBF780AEFBBBF", 2)]
    assert {r.sha256 for r in got.collect()} == {hashlib.sha256(b).hexdigest() for b in (b"\xef\xbb\xbfx\n" * 5000, b"plain")}
