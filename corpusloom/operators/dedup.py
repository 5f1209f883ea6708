"""Near-duplicate clusters of texts by MinHash bands and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.blake3 import LABEL, with_sketches
from corpusloom.functions.text import normalize_text, share
from corpusloom.operators.components import connected_components
from corpusloom.session import cut

BANDS, ROWS, THRESHOLD, MOST_EXAMPLES = 16, 8, 0.8, 50


def jaccard_estimate(a, b, size: int = 128):
    """Share of equal components; 0 for two signatures of nothing."""
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e))
    return F.when((F.array_min(a) == -1) & (F.array_max(a) == -1) & (F.array_min(b) == -1) & (F.array_max(b) == -1), F.lit(0.0)).otherwise(equal / F.lit(float(size)))


def jaccard_ppm(a, b, size: int = 128):
    """Equal components in parts per million, rounded down."""
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e))
    return F.floor(equal * 1_000_000 / size).cast("long")


def band_hashes(count: int = BANDS, rows: int = ROWS):
    """Array of a 64-bit hash of each band's number and values."""
    return F.array(*(F.xxhash64(F.lit(b), F.slice("minhash", b * rows + 1, rows)) for b in range(count)))


def bands(signatures: DataFrame, key: str, count: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(band, bucket, key): a 64-bit hash of the band's values; the values themselves are compared afterwards."""
    return signatures.select(key, F.posexplode(band_hashes(count, rows)).alias("band", "bucket"))


def signatures(docs: DataFrame, key: str, text: str, kernel: str = "blake3", label: bytes = LABEL) -> DataFrame:
    """(key, minhash) of every row; texts are sketched where they are read and never shuffled."""
    normal = docs.select(F.col(key).alias("key"), normalize_text(F.coalesce(F.col(text), F.lit(""))).alias("normal"))
    return cut(with_sketches(normal, "normal", kernel, label).select("key", "minhash"))


def dedup_links(sketched: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """((key, rep), (a, b)): the representative of every row, and verified links between representatives.

    Rows with one signature are one representative, the two of a band's bucket are compared whatever the bucket's size:
    in a bucket every member is compared with the least one and with its next ones, and members that are not linked to the
    least one are compared with all.
    """
    reps = sketched.groupBy("minhash").agg(F.min("key").alias("rep"))
    members = sketched.join(reps, "minhash").select("key", "rep")
    sets = cut(reps.select("rep", "minhash"))
    buckets = cut(bands(sets, "rep"))
    least = buckets.groupBy("band", "bucket").agg(F.min("rep").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    inside = buckets.join(least, ["band", "bucket"]).where("rep <> a")

    def verified(pairs: DataFrame) -> DataFrame:
        left, right = sets.select(F.col("rep").alias("a"), F.col("minhash").alias("x")), sets.select(F.col("rep").alias("b"), F.col("minhash").alias("y"))
        return pairs.select("a", "b").distinct().join(left, "a").join(right, "b").where(jaccard_estimate(F.col("x"), F.col("y")) >= threshold).select("a", "b")

    star = cut(verified(inside.select("a", F.col("rep").alias("b"))))
    # one of two members that both miss the bucket's least one may still be linked to any other member
    rest = inside.join(star.withColumnRenamed("b", "rep"), ["a", "rep"], "left_anti").select("band", "bucket", F.col("rep").alias("b"))
    others = rest.join(buckets, ["band", "bucket"]).where("rep <> b").select(F.least("rep", "b").alias("a"), F.greatest("rep", "b").alias("b"))
    return members, star.unionByName(verified(others)).distinct()


def dedup(docs: DataFrame, key: str, text: str, threshold: float = THRESHOLD, kernel: str = "blake3", label: bytes = LABEL) -> DataFrame:
    """(key, cluster_id, size) of every row in a cluster of two or more; cluster_id is the least key.

    Links hold where at least threshold of the signature is equal (unrounded).  Rows with equal signatures always belong
    together, so all texts without words are one cluster; a null text counts as empty.  A threshold outside [0, 1] is an
    error; an empty table gives no rows.
    """
    if not 0 <= threshold <= 1:
        raise ValueError("threshold must be between 0 and 1")
    members, links = dedup_links(signatures(docs, key, text, kernel, label), threshold)
    labels = connected_components(links, "a", "b").withColumnRenamed("vertex", "rep")
    rows = members.join(labels, "rep", "left").select("key", F.coalesce("component", "rep").alias("component"))
    sizes = rows.groupBy("component").agg(F.count("*").alias("size"), F.min("key").alias("cluster_id")).where("size > 1")
    return rows.join(sizes, "component").select(F.col("key").alias(key), "cluster_id", "size")


def dedup_summary(docs: DataFrame, clustered: DataFrame) -> DataFrame:
    """(documents, near_duplicate_documents, near_duplicate_rate, clusters, largest_cluster)."""
    per = clustered.groupBy("cluster_id").agg(F.first("size").alias("size"))
    found = per.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("near"), F.count("*").alias("clusters"), F.coalesce(F.max("size"), F.lit(0)).alias("largest"))
    zero = F.lit(0).cast("long")
    sides = docs.agg(F.count("*").alias("documents")).select("documents", zero.alias("near"), zero.alias("clusters"), zero.alias("largest"))
    one = sides.unionByName(found.select(zero.alias("documents"), "near", "clusters", F.col("largest").cast("long").alias("largest"))).agg(*(F.sum(c).alias(c) for c in ("documents", "near", "clusters", "largest")))
    return one.select("documents", F.col("near").alias("near_duplicate_documents"), share(F.col("near"), F.col("documents")).alias("near_duplicate_rate"), "clusters", F.col("largest").alias("largest_cluster"))


def size_histogram(clustered: DataFrame) -> DataFrame:
    return clustered.groupBy("cluster_id").agg(F.first("size").alias("size")).groupBy("size").agg(F.count("*").alias("clusters"))


def largest_clusters(clustered: DataFrame, key: str, most: int = MOST_EXAMPLES) -> DataFrame:
    """(cluster_id, size, rank): the first clusters by size, then by first key, a top-k report."""
    per = clustered.groupBy("cluster_id").agg(F.first("size").alias("size")).orderBy(F.desc("size"), "cluster_id").limit(most)
    return per.join(clustered.select("cluster_id", key), "cluster_id")


def exact_groups(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(text_sha256, copies, first_key) of every text as stored that occurs twice or more; null texts are left out."""
    rows = docs.where(F.col(text).isNotNull()).select(F.sha2(text, 256).alias("text_sha256"), F.col(key).alias("k"))
    return rows.groupBy("text_sha256").agg(F.count("*").alias("copies"), F.min("k").alias("first_key")).where("copies > 1")
