import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import blake3 as b


def test_against_another_implementation(spark):
    other = spark._jvm.org.apache.commons.codec.digest.Blake3
    for n in (0, 1, 63, 64, 65, 127, 1023, 1024, 1025, 2048, 2049, 3073, 5000, 8193, 31744):
        m = bytes(i % 251 for i in range(n))
        assert b.digest(m) == bytes(x & 255 for x in other.hash(m)), n
    key = bytes(range(32))
    keyed = other.initKeyedHash(key).update(b"abc").doFinalize(32)
    assert b.digest(b"abc", key) == bytes(x & 255 for x in keyed)


def test_many_equal_one():
    messages = [bytes([i % 256]) * (i * 37 % 3000) for i in range(200)]
    assert [x.tobytes() for x in b.hash_many(messages)] == [b.digest(m) for m in messages]
    assert b.digest(b"").hex().startswith("af1349b9f5f9a1a6")


@pytest.mark.parametrize("kernel", [b.minhash_many, b.minhash_fast])
def test_minhash(kernel):
    words = [f"w{i}" for i in range(200)]
    near = words[:95] + ["x", "y"] + words[97:]
    found = kernel([words, near, [], ["a", "b"], ["a", "b"]])
    assert (found[2] == np.uint64(0xFFFFFFFFFFFFFFFF)).all()
    assert (found[3] == found[4]).all()
    assert abs((found[0] == found[1]).mean() - 190 / 202) < 0.1


def test_minhash_is_the_least_keyed_hash():
    words = "the quick brown fox jumps over".split()
    shingles = b.word_shingles(words)
    wanted = [min(int.from_bytes(b.digest(s.encode(), key)[:8], "little") for s in shingles) for key in b.minhash_keys()[:4]]
    assert b.minhash_many([words])[0][:4].tolist() == wanted


def test_simhash():
    assert b.simhash_many([[], ["a"]])[0] == 0
    key = b.digest(b.LABEL + b"-simhash-v1")
    assert b.simhash_many([["a"]])[0] == int.from_bytes(b.digest(b"a", key)[:8], "little")


def test_columns(spark):
    df = spark.createDataFrame([(1, "abc", "extra"), (2, None, None), (3, "", "")], "k int, t string, minhash_note string")
    rows = {r.k: r for r in b.with_digest(df, "t").collect()}
    assert bytes(rows[1].document_id) == b.digest(b"abc") and rows[2].document_id is None and bytes(rows[3].document_id) == b.digest(b"")
    sketched = {r.k: r for r in b.with_sketches(df, "t", simhash=True).collect()}
    assert set(sketched[2].minhash) == {-1} and sketched[2].simhash == 0 and sketched[1].minhash_note == "extra"
    assert b.with_sketches(df.where("false"), "t").count() == 0
    assert df.select(F.col("k")).count() == 3


def test_sketches_of_the_jvm_equal_numpy(spark):
    """Of one block, several, one chunk and trees of them, blanks of any number, other scripts: and no Python worker takes part."""
    sizes = (1, 11, 12, 13, 63, 64, 65, 127, 128, 200, 204, 205, 1023, 1024, 1025, 2048, 2049, 3073, 5000, 8193)
    texts = [None, "", "  ", "a", "a  b", "  a b c d e  f ", " ".join(["a b c d e"] * 9), " ".join(f"w{i % 40}" for i in range(90))]
    texts += ["q" * n for n in sizes] + [" ".join("é日😀z"[(n + k) % 4] * (n // 3 + k) for k in range(7)) for n in sizes]
    found = b.with_sketches(spark.createDataFrame(list(enumerate(texts)), "k int, t string"), "t", simhash=True)
    lists = [[w for w in (t or "").split(" ") if w] for t in texts]
    minhash, simhash = b.minhash_many(lists).view(np.int64), b.simhash_many(lists).view(np.int64)
    assert {r.k: (r.minhash, r.simhash) for r in found.collect()} == {k: (minhash[k].tolist(), simhash[k]) for k in range(len(texts))}
    assert "MapInArrow" not in found._jdf.queryExecution().toString()


def test_fingerprints(spark):
    text = "The quick brown fox jumps over the lazy dog. Pack my box with five dozen liquor jugs."
    rows = b.fingerprints(spark.createDataFrame([(1, text), (2, None), (3, "")], "k int, t string"), "t").collect()
    found = {r.k: r.fingerprint for r in rows}
    normal = text.lower()
    assert found[1].blake3 == b.digest(normal.encode()).hex() and found[1].byte_len == 85 and found[1].nfc_char_count == 85
    assert found[1].simhash == b.simhash_many([normal.split()]).view(np.int64)[0] and len(found[1].minhash) == 128
    assert found[2] is None and found[3].byte_len == 0
