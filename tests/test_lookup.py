import bisect
import random
import re

from pyspark.sql import functions as F

from corpusloom.functions.blake3 import with_sketches
from corpusloom.operators import lookup as lk


def key(n):
    return n.to_bytes(32, "big")


def test_adjacent(spark):
    random.seed(1)
    leaves, queries = sorted(random.sample(range(1000), 60)), random.sample(range(1000), 80) + [-0 or 1000]
    frame = lambda xs: spark.createDataFrame([(key(x),) for x in xs] + [(None,)], "document_id binary")
    found = {int.from_bytes(bytes(r.document_id), "big"): r for r in lk.adjacent_leaves(frame(leaves), frame(queries + queries), ranges=7).collect()}
    assert set(found) == set(queries)
    for q, r in found.items():
        i = bisect.bisect_left(leaves, q)
        before, after = leaves[i - 1] if i else None, next((x for x in leaves[i:] if x > q), None)
        assert (r.before and int.from_bytes(bytes(r.before), "big")) == before and (r.after and int.from_bytes(bytes(r.after), "big")) == after
        assert r.outcome == ("found" if q in leaves else "before_first" if before is None else "after_last" if after is None else "interior")
    assert {r.outcome for r in lk.adjacent_leaves(frame([]), frame(queries)).collect()} == {"empty"}
    assert lk.adjacent_leaves(frame(leaves), frame([])).count() == 0


def test_exact_and_removal(spark):
    m = spark.createDataFrame([(key(1), key(9), True), (key(2), key(8), False), (key(2), key(8), False)], "document_id binary, sha256 binary, included boolean")
    targets = spark.createDataFrame([("a", key(1), key(0)), ("b", key(5), key(9)), ("c", key(2), key(0)), ("d", key(7), key(7))], "target string, document_id binary, sha256 binary")
    assert {tuple(r) for r in lk.exact_matches(m, targets).collect()} == {("a", "blake3", 1), ("b", "sha256", 1), ("c", "blake3", 2), ("d", None, 0)}
    after = m.where(F.col("document_id") == F.lit(key(2)))
    asked = spark.createDataFrame([(key(1),), (key(2),), (key(3),), (None,)], "document_id binary")
    assert {int.from_bytes(bytes(r.document_id), "big"): r.outcome for r in lk.removal_evidence(m, after, asked).collect()} == {1: "removed", 2: "still_present", 3: "never_present"}
    assert [r.outcome for r in lk.removal_evidence(m, after.where("false"), asked.where(F.col("document_id") == F.lit(key(2)))).collect()] == ["not_included_before"]


def test_chain(spark):
    q = spark.createDataFrame([("m", "s", key(1)), ("m", "s", key(2)), ("n", "t", key(1))], "model string, subject string, document_id binary")
    bindings = spark.createDataFrame([("s", "att", "root"), ("t", "att", "other")], "subject string, attestation string, root string")
    corpora = spark.createDataFrame([("c", "att", "root")], "corpus string, attestation string, root string")
    members = spark.createDataFrame([("c", key(1)), ("c", key(1))], "corpus string, document_id binary")
    found = {(r.model, bytes(r.document_id)[-1]): r.member for r in lk.chain_walk(q, bindings, corpora, members).collect()}
    assert found == {("m", 1): True, ("m", 2): False, ("n", 1): False}


def test_near_bits_equal_brute_force(spark):
    random.seed(2)
    base = [random.getrandbits(64) for _ in range(30)]
    values = base + [b ^ sum(1 << i for i in random.sample(range(64), k % 9)) for k, b in enumerate(base)]
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame(list(enumerate(signed)), "id long, bits long")
    found = {tuple(r) for r in lk.near_bits(df, df.where("id < 30").withColumnRenamed("id", "q"), "id", "q").collect()}
    assert found == {(q, i, (values[q] ^ values[i]).bit_count()) for q in range(30) for i in range(60) if (values[q] ^ values[i]).bit_count() <= 6}
    best = {r.q: (r.id, r.distance) for r in lk.best_bits(spark.createDataFrame([(1, 5, 3), (1, 4, 3), (1, 9, 6)], "q long, id long, distance int"), "id", "q").collect()}
    assert best == {1: (4, 3)}


def test_index_equals_exhaustive_search(spark):
    words = [f"w{i}" for i in range(400)]
    texts = [(i, " ".join(words[i * 7 : i * 7 + 120])) for i in range(20)] + [(100 + i, " ".join(words[i * 7 : i * 7 + 119] + ["x"])) for i in range(20)]
    df = with_sketches(spark.createDataFrame(texts, "id long, t string"), "t", "fast").select("id", "minhash")
    found = {r.q: r.id for r in lk.best_minhash(df.where("id < 100"), df.where("id >= 100").withColumnRenamed("id", "q"), "id", "q").collect()}
    assert found == {100 + i: i for i in range(20)}
    stats = lk.bucket_statistics(lk.index_buckets(df, "id")).collect()
    assert len(stats) == 32 and all(r.rows == 40 for r in stats)


def test_own_row_is_no_match(spark):
    """A query that stands in the searched set finds the best other row: a copy, else a near one, else none."""
    words = [f"w{i}" for i in range(900)]
    near = lambda i: " ".join(words[i : i + 199] + ["x"])
    texts = [(1, " ".join(words[:200])), (2, near(0)), (3, " ".join(words[300:500])), (4, near(300)), (5, " ".join(words[300:500])), (6, " ".join(words[600:800]))]
    df = with_sketches(spark.createDataFrame(texts, "id long, t string"), "t", "fast").select("id", "minhash")
    found = {r.q: (r.id, r.ppm) for r in lk.best_minhash(df, df.withColumnRenamed("id", "q"), "id", "q", own=False).collect()}
    signatures = {r.id: r.minhash for r in df.collect()}
    same = lambda a, b: sum(x == y for x, y in zip(signatures[a], signatures[b], strict=True)) * 1_000_000 // 128
    best = {a: max((same(a, b), -b) for b in signatures if b != a) for a in signatures}
    assert found == {a: (-b, ppm) for a, (ppm, b) in best.items() if ppm >= lk.MINHASH_PPM}
    assert found[3] == (5, 1_000_000) and found[1][0] == 2 and 6 not in found


def test_signatures_are_not_broadcast(spark):
    """Copies, near and other rows are found as by brute force, and no join sends signatures to the driver, however small they seem."""
    random.seed(3)
    words = [f"w{i}" for i in range(3000)]
    base = [words[i * 100 : i * 100 + 120] for i in range(20)]
    texts = [b if k == 0 else b[:119] + [f"x{k}"] if k < 3 else b for b in base for k in range(5)] + [[]] * 3
    df = with_sketches(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "id long, t string"), "t", "fast").select("id", "minhash")
    signatures = {r.id: r.minhash for r in df.collect()}
    queries = df.where("id % 3 = 0").withColumnRenamed("id", "q")
    for own in (False, True):
        answer = lk.best_minhash(df, queries, "id", "q", own=own)
        found = {r.q: (r.id, r.ppm) for r in answer.collect()}
        same = lambda a, b: sum(x == y for x, y in zip(signatures[a], signatures[b], strict=True)) * 1_000_000 // 128
        best = {a: max((same(a, b), -b) for b in signatures if own or b != a) for a in signatures if a % 3 == 0}
        assert found == {a: (-b, ppm) for a, (ppm, b) in best.items() if ppm >= lk.MINHASH_PPM}
        plan = answer._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        sent = [x for x in plan.split("\n\n") if ") BroadcastExchange" in x]
        assert not [x for x in sent if re.search(r"\b(minhash|x|y)#", x)]


def test_full_bitmap_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr("corpusloom.operators.run_filter.MOST_BITS", 64)
    test_own_row_is_no_match(spark)
    test_index_equals_exhaustive_search(spark)


def test_iscc(spark):
    a, b = bytes(range(20)), bytes([0, 3, *range(2, 20)])
    df = spark.createDataFrame([(a, b)], "a binary, b binary")
    row = df.select(lk.iscc_distance(F.col("a"), F.col("b"), 20).alias("d"), lk.iscc_bands(F.col("a"), 20).alias("x"), lk.iscc_bands(F.col("b"), 20).alias("y")).first()
    assert row.d == 1 and sum(p == q for p, q in zip(row.x, row.y, strict=True)) == 4
    assert len(df.select(lk.perceptual_bands(F.lit(1).cast("long"), F.lit(2).cast("long")).alias("x")).first().x) == 16


def test_prove(spark):
    words = [f"w{i}" for i in range(200)]
    sigs = with_sketches(spark.createDataFrame([(key(10), " ".join(words)), (key(20), " ".join(reversed(words)))], "document_id binary, t string"), "t", "fast").select("document_id", "minhash")
    manifest = spark.createDataFrame([(key(10), key(110)), (key(20), key(120)), (key(30), key(130)), (key(30), key(130))], "document_id binary, sha256 binary")
    near = with_sketches(spark.createDataFrame([("near", key(15), key(0), " ".join(words[:199]))], "target string, document_id binary, sha256 binary, t string"), "t", "fast").drop("t")
    rest = spark.createDataFrame([("a", key(10), key(0)), ("b", key(1), key(120)), ("c", key(30), key(0)), ("d", key(25), key(0)), ("e", key(99), key(0))], "target string, document_id binary, sha256 binary").withColumn("minhash", F.lit(None).cast("array<bigint>"))
    found = {r.target: (r.outcome, r.matched_by, r.confidence) for r in lk.prove(manifest, near.unionByName(rest), sigs).collect()}
    assert found == {"a": ("included", "blake3", 1.0), "b": ("included", "sha256", 1.0), "c": ("ambiguous", "blake3", None), "d": ("interior", None, None), "e": ("after_last", None, None), "near": ("included", "minhash", 0.8)}


def test_prove_codes_and_images(spark):
    """Targets within the thresholds are found by code body and by either image hash, those beyond by neither."""
    flip = lambda body, n: bytes(x ^ (1 << 3 if i % 7 == 0 and i // 7 < n else 0) for i, x in enumerate(body))
    body, h = bytes(range(100, 132)), 0x0123456789ABCDEF
    schema = "target string, document_id binary, sha256 binary, body binary, phash long, blockhash long"
    asked = [("c4", flip(body, 4), None, None), ("c5", flip(body, 5), None, None), ("p6", None, h ^ 0b111111, ~h), ("b6", None, ~h, h ^ (0b111111 << 20)), ("p7", None, h ^ 0b1111111, ~h), ("both", body, h, h), ("none", None, None, None)]
    targets = spark.createDataFrame([(n, key(50 + i), key(0), *x) for i, (n, *x) in enumerate(asked)], schema)
    manifest = spark.createDataFrame([(key(10), key(110)), (key(90), key(120))], "document_id binary, sha256 binary")
    codes, images = spark.createDataFrame([(body,), (body[:8],)], "body binary"), spark.createDataFrame([(h, h)], "phash long, blockhash long")
    found = {r.target: (r.outcome, r.matched_by, r.confidence) for r in lk.prove(manifest, targets, codes=codes, images=images).collect()}
    code, image, miss = ("included", "iscc", 0.95), ("included", "perceptual", 0.85), ("interior", None, None)
    assert found == {"c4": code, "c5": miss, "p6": image, "b6": image, "p7": miss, "both": code, "none": miss}


def test_stored_index(spark, tmp_path):
    from corpusloom.sources.readers import read_index, write_index

    df = with_sketches(spark.createDataFrame([(1, "a b c d e f"), (2, "g h i j k l")], "id long, t string"), "t", "fast").select("id", "minhash")
    write_index(df, lk.index_buckets(df, "id"), str(tmp_path / "i"), "root", bands=32)
    stored, buckets = read_index(spark, str(tmp_path / "i"), "root")
    found = lk.best_minhash(stored, df.withColumnRenamed("id", "q"), "id", "q", index=buckets).collect()
    assert {(r.q, r.id, r.ppm) for r in found} == {(1, 1, 1_000_000), (2, 2, 1_000_000)}
    assert read_index(spark, str(tmp_path / "i"), "other") is None and read_index(spark, str(tmp_path / "none"), "root") is None
