"""Membership: exact and adjacent leaves, removal evidence, binding chains, and similarity indexes over bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions.text import hamming
from corpusloom.operators.dedup import band_hashes, bands, jaccard_ppm
from corpusloom.operators.run_filter import bitmap, passing
from corpusloom.session import cut

MINHASH_BANDS, MINHASH_ROWS, MINHASH_PPM = 32, 4, 850_000
PERCEPTUAL_THRESHOLD, ISCC_THRESHOLD, ISCC_BANDS = 6, 4, 5
CONFIDENCE = {"blake3": 1.0, "sha256": 1.0, "iscc": 0.95, "perceptual": 0.85, "minhash": 0.80}


# --- exact ---------------------------------------------------------------------------------------------------------


def exact_matches(manifest: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, matched_by, matches): for targets (target, document_id, sha256) the number of rows found by document_id,
    and by sha256 only where document_id finds none; more than one row is ambiguous, none is a miss with a null matched_by.
    """
    per = [manifest.groupBy(c).agg(F.count("*").alias(f"by_{c}")) for c in ("document_id", "sha256")]
    found = targets.join(per[0], "document_id", "left").join(per[1], "sha256", "left").na.fill(0, ["by_document_id", "by_sha256"])
    by = F.when(F.col("by_document_id") > 0, "blake3").when(F.col("by_sha256") > 0, "sha256")
    return found.select("target", by.alias("matched_by"), F.when(F.col("by_document_id") > 0, F.col("by_document_id")).otherwise(F.col("by_sha256")).alias("matches"))


def adjacent_leaves(leaves: DataFrame, queries: DataFrame, key: str = "document_id", ranges: int | None = None) -> DataFrame:
    """(key, outcome, before, after) of every distinct query key: found, interior, before_first, after_last or empty.

    Leaves and queries are range-partitioned together and looked up by one pass in each range; the greatest leaf below and
    the least leaf above a range come from one row per range, so nothing is ordered on a single task.
    """
    spark = leaves.sparkSession
    both = leaves.select(F.col(key).alias("k"), F.lit(True).alias("leaf")).where("k is not null").distinct()
    both = both.unionByName(queries.select(F.col(key).alias("k"), F.lit(False).alias("leaf")).where("k is not null").distinct())
    per = both.groupBy("k").agg(F.max("leaf").alias("leaf"), F.max(~F.col("leaf")).alias("query"))
    parts = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(per.repartitionByRange(parts, "k").withColumn("part", F.spark_partition_id()))
    leaf = F.when(F.col("leaf"), F.col("k"))
    edges = ranged.groupBy("part").agg(F.max(leaf).alias("top"), F.min(leaf).alias("bottom"))
    order = Window.orderBy("part")  # one row per range
    edges = edges.select("part", F.max("top").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("below"), F.min("bottom").over(order.rowsBetween(1, Window.unboundedFollowing)).alias("above"))
    inside = Window.partitionBy("part").orderBy("k")
    near = ranged.withColumn("lo", F.last(leaf, True).over(inside.rowsBetween(Window.unboundedPreceding, -1))).withColumn("hi", F.first(leaf, True).over(inside.rowsBetween(1, Window.unboundedFollowing)))
    near = near.where("query").join(F.broadcast(edges), "part").select("k", "leaf", F.coalesce("lo", "below").alias("before"), F.coalesce("hi", "above").alias("after"))
    lo, hi = F.col("before").isNull(), F.col("after").isNull()
    outcome = F.when(F.col("leaf"), "found").when(lo & hi, "empty").when(lo, "before_first").when(hi, "after_last").otherwise("interior")
    return near.select(F.col("k").alias(key), outcome.alias("outcome"), "before", "after")


def removal_evidence(before: DataFrame, after: DataFrame, targets: DataFrame, key: str = "document_id") -> DataFrame:
    """(key, outcome): removed (included before, absent after), still_present, not_included_before or never_present."""
    was = before.groupBy(key).agg(F.max("included").alias("was_included"))
    now = after.select(key).distinct().withColumn("is_now", F.lit(True))
    rows = targets.select(key).where(F.col(key).isNotNull()).distinct().join(was, key, "left").join(now, key, "left")
    outcome = F.when(F.col("is_now"), "still_present").when(F.col("was_included"), "removed").when(F.col("was_included").isNotNull(), "not_included_before").otherwise("never_present")
    return rows.select(key, outcome.alias("outcome"))


def chain_walk(questions: DataFrame, bindings: DataFrame, corpora: DataFrame, members: DataFrame) -> DataFrame:
    """(model, document_id, member): whether any corpus bound to a model holds the document asked for.

    questions (model, subject, document_id), bindings (subject, attestation, root), corpora (corpus, attestation, root),
    members (corpus, document_id).  A binding counts only where attestation and root both agree.
    """
    asked = questions.select("model", "subject", "document_id").distinct()
    bound = bindings.join(corpora, ["attestation", "root"]).select("subject", "corpus").distinct()
    held = asked.join(bound, "subject").join(members.select("corpus", "document_id").distinct(), ["corpus", "document_id"])
    found = held.select("model", "document_id").distinct().withColumn("member", F.lit(True))
    out = asked.select("model", "document_id").distinct().join(found, ["model", "document_id"], "left")
    return out.withColumn("member", F.coalesce("member", F.lit(False)))


def with_content(rows: DataFrame, content: DataFrame, key: str = "document_id") -> DataFrame:
    """rows with the content stored under their digest; a digest without content is an error when it is read."""
    joined = rows.join(content.select(key, "content"), key, "left")
    return joined.withColumn("content", F.when(F.col("content").isNull(), F.raise_error(F.lit("no content is stored under a digest")).cast("binary")).otherwise(F.col("content")))


# --- similarity ----------------------------------------------------------------------------------------------------


def hamming_bands(value: Column, first: int = 0) -> Column:
    """Eight (band, bucket) of a 64-bit value: two values within seven bits agree in one of them."""
    return F.array(*(F.struct(F.lit(first + b).alias("band"), F.shiftrightunsigned(value, 8 * b).bitwiseAND(F.lit(255).cast("long")).alias("bucket")) for b in range(8)))


def perceptual_bands(phash: Column, blockhash: Column) -> Column:
    return F.concat(hamming_bands(phash), hamming_bands(blockhash, 8))


def iscc_bands(body: Column, size: int, count: int = ISCC_BANDS) -> Column:
    """(band, bucket) of contiguous byte ranges of a code body: bodies within count - 1 bits agree in one of them."""
    cuts = [b * size // count for b in range(count + 1)]
    return F.array(*(F.struct(F.lit(b).alias("band"), F.xxhash64(F.substring(body, a + 1, z - a)).alias("bucket")) for b, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False))))


def iscc_distance(a: Column, b: Column, size: int) -> Column:
    """Differing bits of two code bodies."""
    pairs = [F.bit_count(F.conv(F.hex(F.substring(a, i, 4)), 16, 10).cast("long").bitwiseXOR(F.conv(F.hex(F.substring(b, i, 4)), 16, 10).cast("long"))) for i in range(1, size + 1, 4)]
    return sum(pairs[1:], pairs[0])


def index_buckets(signatures: DataFrame, key: str, count: int = MINHASH_BANDS, rows: int = MINHASH_ROWS) -> DataFrame:
    """(band, bucket, key): the similarity index of every signature, one row per band; buckets are never gathered."""
    return bands(signatures, key, count, rows)


def bucket_statistics(buckets: DataFrame) -> DataFrame:
    """(band, buckets, rows, largest): what an index holds, per band."""
    per = buckets.groupBy("band", "bucket").agg(F.count("*").alias("n"))
    return per.groupBy("band").agg(F.count("*").alias("buckets"), F.sum("n").alias("rows"), F.max("n").alias("largest"))


def best_minhash(signatures: DataFrame, queries: DataFrame, key: str, query: str, least_ppm: int = MINHASH_PPM, index: DataFrame | None = None, own: bool = True) -> DataFrame:
    """(query, key, ppm): of every query signature the most similar row at or above least_ppm, of equal ones the least key.

    Equal signatures (by 128 bits of hash) are looked up once and found by their least key.  Candidates agree in at least one
    band of the index, which holds at least the least key of every signature and without which it is built here.
    A bitmap of the queries' bands goes to all executors; of the searched rows, which are read once, only those with a band
    that it lets pass are kept or shuffled.  No join broadcasts signatures, as Spark takes an array for one value when it
    estimates their size.
    own=False: queries are rows of the searched set, and none finds its own row; other rows of its signature count.
    """
    twin = ["_one", "_two"]
    hashed = lambda df, k, *more: df.where("minhash is not null").select(k, "minhash", *(F.xxhash64(F.lit(n), "minhash").alias(n) for n in twin), *more)
    of_query = {"_one": "_q1", "_two": "_q2"}
    asked = cut(hashed(queries, query))
    buckets = cut(asked.select(*twin, F.posexplode(band_hashes(MINHASH_BANDS, MINHASH_ROWS)).alias("band", "bucket")).distinct())
    rows = cut(passing(hashed(signatures, key, band_hashes(MINHASH_BANDS, MINHASH_ROWS).alias("hits")), "hits", bitmap(buckets, "bucket")))
    known = cut(rows.groupBy(*twin).agg(F.min(key).alias(key)))
    firsts = rows.join(known, [*twin, key], "left_semi")
    heads = asked.groupBy(*twin).agg(F.min(query).alias(query))
    x = asked.join(heads, [*twin, query], "left_semi").select(*twin, F.col("minhash").alias("x")).withColumnsRenamed(of_query)
    y = firsts.select(*twin, F.col(key).alias("_key"), F.col("minhash").alias("y"))
    if index is None:
        pairs = buckets.withColumnsRenamed(of_query).join(firsts.select(*twin, F.explode("hits").alias("bucket")), "bucket").select("_q1", "_q2", *twin).distinct()
        pairs = pairs.join(y.hint("merge"), twin)
    else:
        pairs = buckets.withColumnsRenamed(of_query).join(index, ["band", "bucket"]).select("_q1", "_q2", F.col(key).alias("_key")).distinct()
        pairs = pairs.join(y.hint("merge"), "_key")
    if not own:
        pairs = pairs.where("_q1 <> _one or _q2 <> _two")  # equal signatures are added below
    scored = pairs.join(x.hint("merge"), ["_q1", "_q2"]).select("_q1", "_q2", "_key", jaccard_ppm(F.col("x"), F.col("y")).alias("ppm")).where(F.col("ppm") >= least_ppm)
    best = scored.groupBy(F.col("_q1").alias("_one"), F.col("_q2").alias("_two")).agg(F.min(F.struct((-F.col("ppm")).alias("d"), F.col("_key").alias("k"))).alias("b"))
    members = asked.select(query, *twin)
    if not own:
        least = known.join(heads, twin, "left_semi").select(*twin, F.col(key).alias("_first"))
        next_ = rows.select(*twin, key).join(least, twin).where(F.col(key) > F.col("_first")).groupBy(*twin).agg(F.min(key).alias("_next"))
        copy = F.when(F.col(query) == F.col("_first"), F.col("_next")).otherwise(F.col("_first"))
        found = members.join(best, twin, "left").join(least, twin, "left").join(next_, twin, "left").withColumn("_copy", copy)
        found = found.select(query, F.coalesce("_copy", "b.k").alias(key), F.when(F.col("_copy").isNotNull(), -F.lit(1_000_000).cast(scored.schema["ppm"].dataType)).otherwise(F.col("b.d")).alias("d"))
        return found.where(F.col("d").isNotNull()).select(query, key, (-F.col("d")).alias("ppm"))
    return members.join(best, twin).select(query, F.col("b.k").alias(key), (-F.col("b.d")).alias("ppm"))


def near_bits(values: DataFrame, queries: DataFrame, key: str, query: str, bits: str = "bits", most: int = PERCEPTUAL_THRESHOLD) -> DataFrame:
    """(query, key, distance): all pairs within `most` (at most 7) bits, found through the eight bands and checked exactly."""
    if most > 7:
        raise ValueError("eight bands find all pairs of up to seven differing bits")
    a = queries.select(F.col(query).alias("_query"), F.col(bits).alias("x"), F.explode(hamming_bands(F.col(bits))).alias("s")).select("_query", "x", "s.*")
    b = values.select(F.col(key).alias("_key"), F.col(bits).alias("y"), F.explode(hamming_bands(F.col(bits))).alias("s")).select("_key", "y", "s.*")
    pairs = a.join(b, ["band", "bucket"]).where(hamming(F.col("x"), F.col("y")) <= most)
    return pairs.select(F.col("_query").alias(query), F.col("_key").alias(key), hamming(F.col("x"), F.col("y")).alias("distance")).distinct()


def best_bits(pairs: DataFrame, key: str, query: str) -> DataFrame:
    """The nearest row of every query, of equally near ones the least key."""
    best = pairs.groupBy(query).agg(F.min(F.struct("distance", key)).alias("b"))
    return best.select(query, F.col(f"b.{key}").alias(key), F.col("b.distance").alias("distance"))


# --- the whole cascade ---------------------------------------------------------------------------------------------


def near_codes(codes: DataFrame, asked: DataFrame, size: int, most: int = ISCC_THRESHOLD) -> DataFrame:
    """(target) of asked (target, body) with a code body among codes (body) within `most` (at most 4) bits; other sizes never match."""
    if most >= ISCC_BANDS:
        raise ValueError("bands find all pairs of fewer differing bits than there are bands")
    sized = F.octet_length("body") == size
    x = asked.where(sized).select("target", F.col("body").alias("x"), F.explode(iscc_bands(F.col("body"), size)).alias("s")).select("target", "x", "s.*")
    y = codes.where(sized).select("body").distinct().select(F.col("body").alias("y"), F.explode(iscc_bands(F.col("body"), size)).alias("s")).select("y", "s.*")
    return x.join(y, ["band", "bucket"]).where(iscc_distance(F.col("x"), F.col("y"), size) <= most).select("target").distinct()


def near_images(images: DataFrame, asked: DataFrame, most: int = PERCEPTUAL_THRESHOLD) -> DataFrame:
    """(target) of asked (target, phash, blockhash) with an image (phash, blockhash) within `most` (at most 7) bits by either hash."""
    if most > 7:
        raise ValueError("eight bands find all pairs of up to seven differing bits")
    banded = lambda df, *k: df.select(*k, "phash", "blockhash", F.explode(perceptual_bands(F.col("phash"), F.col("blockhash"))).alias("s")).select(*k, "phash", "blockhash", "s.*")
    y = banded(images.select("phash", "blockhash").distinct()).withColumnsRenamed({"phash": "p", "blockhash": "b"})
    nearest = F.least(hamming(F.col("phash"), F.col("p")), hamming(F.col("blockhash"), F.col("b")))
    return banded(asked, "target").join(y, ["band", "bucket"]).where(nearest <= most).select("target").distinct()


def prove(manifest: DataFrame, targets: DataFrame, signatures: DataFrame | None = None, index: DataFrame | None = None, codes: DataFrame | None = None, images: DataFrame | None = None, code_size: int = 32) -> DataFrame:
    """(target, outcome, matched_by, confidence, before, after) of targets (target, document_id, sha256[, body][, phash,
    blockhash][, minhash]).

    outcome: included by the first stage that finds the target (document_id, sha256, ISCC over codes (body), image hashes
    over images (phash, blockhash), MinHash over signatures (document_id, minhash)), ambiguous where a digest is held by
    several rows, else the adjacency case with the neighbours.
    """
    exact = exact_matches(manifest, targets.select("target", "document_id", "sha256"))
    found = exact.select("target", F.when(F.col("matches") > 1, "ambiguous").when(F.col("matches") == 1, "included").alias("o"), F.col("matched_by").alias("m"))
    stages = []
    if codes is not None:
        stages.append(("iscc", lambda asked: near_codes(codes, asked.where("body is not null"), code_size)))
    if images is not None:
        stages.append(("perceptual", lambda asked: near_images(images, asked)))
    if signatures is not None:
        stages.append(("minhash", lambda asked: best_minhash(signatures, asked.where("minhash is not null").select("target", "minhash"), "document_id", "target", index=index)))
    for stage, find in stages:
        similar = find(targets.join(found.where("o is null").select("target"), "target", "left_semi")).select("target", F.lit(stage).alias("s"))
        found = found.join(similar, "target", "left").select("target", F.coalesce("o", F.when(F.col("s").isNotNull(), "included")).alias("o"), F.coalesce("m", "s").alias("m"))
    near = adjacent_leaves(manifest, targets)
    rows = targets.select("target", "document_id").join(found, "target").join(near, "document_id", "left")
    missed = F.col("o").isNull()
    confidence = F.coalesce(*(F.when(F.col("m") == k, F.lit(v)) for k, v in CONFIDENCE.items()))
    return rows.select("target", F.coalesce("o", "outcome").alias("outcome"), F.col("m").alias("matched_by"), F.when(F.col("o") == "included", confidence).alias("confidence"), F.when(missed, F.col("before")).alias("before"), F.when(missed, F.col("after")).alias("after"))
