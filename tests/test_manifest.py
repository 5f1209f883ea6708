import pytest
from pyspark.sql import functions as F

from corpusloom.operators import manifest as m

SCHEMA = "document_id binary, occurrence_index int, modality byte, source_type byte, source_dataset_id string, license_spdx string, language string, size_bytes long, included boolean"


def row(k, occurrence, modality, source_type, dataset, licence, language, size, included=True):
    return (bytes([k]) * 32, occurrence, modality, source_type, dataset, licence, language, size, included)


@pytest.fixture(scope="module")
def composed(spark):
    return spark.createDataFrame(
        [
            row(1, 0, 0, 0, None, "CC-BY-4.0", "en", 100), row(2, 0, 0, 0, None, None, "en", 200), row(3, 0, 1, 1, None, "CC0-1.0", None, 300),
            row(4, 0, 0, None, None, None, "fr", 150), row(5, 0, 4, 2, None, "MIT", "de", 500, False),
        ],
        SCHEMA,
    )


@pytest.fixture(scope="module")
def versions(spark):
    same = [row(1, 0, 0, 0, "web", "CC-BY-4.0", "en", 120), row(2, 0, 0, 0, "web", "CC-BY-4.0", "en", 80), row(3, 0, 0, 1, "books", "MIT", "en", 200), row(4, 0, 1, 0, "web", None, None, 300)]
    old = spark.createDataFrame([*same, row(2, 1, 0, 0, "web", "CC-BY-4.0", "en", 80), row(5, 0, 0, 0, "web", None, "fr", 25)], SCHEMA)
    return old, spark.createDataFrame([*same, row(6, 0, 0, 1, "books", "MIT", "en", 150)], SCHEMA)


def test_composition(composed):
    found = {(r.dimension, r.label): tuple(r)[2:] for r in m.composition(composed).collect()}
    assert found["license_spdx", "unspecified"] == (2, 350, 0.5, 0.466667)
    assert found["modality", "image"] == (1, 300, 0.25, 0.4)
    assert found["source_type", "crawl"] == (2, 300, 0.5, 0.4)
    cover = {r.dimension: tuple(r)[1:] for r in m.coverage(composed).collect()}
    assert cover["license_spdx"] == (2, 0.5, 0.533333) and cover["modality"] == (4, 1.0, 1.0)
    assert tuple(m.totals(composed).first()) == (5, 4, 1, 1250, 750)
    assert tuple(m.totals(composed.where("false")).first()) == (0, 0, 0, 0, 0)


def test_unknown_code_is_an_error(spark):
    with pytest.raises(Exception, match="unknown code"):
        m.inspect(spark.createDataFrame([row(1, 0, 9, 0, None, None, None, 1)], SCHEMA)).collect()


def test_versions(versions):
    old, new = versions
    assert tuple(m.version_summary(old).first()) == (6, 5, 1, 805)
    assert tuple(m.version_summary(new).first()) == (5, 5, 0, 850)
    assert tuple(m.diff_counts(old, new).first()) == (1, 1, 4, 1)
    shifted = m.multiset_diff(old, new).where("status = 'shifted'").collect()
    assert [(bytes(r.document_id)[0], r.old_count, r.new_count) for r in shifted] == [(2, 2, 1)]
    shift = {(r.dimension, r.label): (r.old_share, r.new_share) for r in m.composition_shift(old, new).collect()}
    assert shift["language", "fr"] == (0.166667, 0.0) and shift["language", "(unspecified)"] == (0.166667, 0.2) and shift["source_dataset_id", "books"] == (0.166667, 0.4)
    assert tuple(m.diff_counts(old.where("false"), new.where("false")).first()) == (0, 0, 0, 0)


def test_ranks_and_shards(spark):
    df = spark.createDataFrame([(i, f"text {i % 7}") for i in range(100)], "n int, text string")
    sealed = m.seal(df, F.encode("text", "UTF-8"), ["n"]).collect()
    assert [r.input_ordinal for r in sorted(sealed, key=lambda r: r.n)] == list(range(100))
    assert {(r.text, r.occurrence_index) for r in sealed} == {(f"text {i % 7}", i // 7) for i in range(100)}
    sealed = spark.createDataFrame(sealed)
    assert m.occurrence_violations(sealed).count() == 0
    assert m.occurrence_violations(sealed.withColumn("occurrence_index", F.lit(0))).count() == 93
    sharded = sealed.withColumn("shard", m.shard_of(F.col("sha256"), 3))
    wanted = {r.n: int.from_bytes(bytes(r.sha256)[:8], "little") % 3 for r in sharded.collect()}
    assert {r.n: r.shard for r in sharded.collect()} == wanted
    merged = m.merge_shards(sharded)
    assert sorted(r.occurrence_index for r in merged.where("text = 'text 0'").collect()) == list(range(15))
    assert sorted(r.input_ordinal for r in merged.collect()) == list(range(100))
    assert sum(r.rows for r in m.shard_plan(sealed, "sha256", 3).collect()) == 100


def test_unsorted_shards(spark):
    df = spark.createDataFrame([(0, 0, b"a"), (0, 1, b"b"), (1, 0, b"b"), (1, 1, b"a")], "shard int, position int, document_id binary")
    assert [tuple(r) for r in m.unsorted_shards(df).collect()] == [(1, 1)]


def test_one_document_holds_most_rows(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 5 > 0, F.lit(b"hot")).otherwise(F.encode(F.col("id").cast("string"), "UTF-8")).alias("document_id"), (F.lit(5000) - F.col("id")).alias("input_ordinal"), F.lit(9).alias("occurrence_index"))
    found = m.occurrence_indices(df).collect()
    hot = sorted((r.input_ordinal, r.occurrence_index) for r in found if bytes(r.document_id) == b"hot")
    assert [r for _, r in hot] == list(range(4000)) and {r.occurrence_index for r in found if bytes(r.document_id) != b"hot"} == {0}
    assert m.occurrence_indices(df.where("false")).count() == 0
