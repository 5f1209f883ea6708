import pytest
from pyspark.sql import functions as F

from corpusloom.llm import mixture as mx


def docs(spark, sizes):
    rows = [(f"{s}{i}", s, 10 + i % 7) for s, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "doc_id string, source string, n_tokens long").withColumn("copies", F.lit("clash"))


def mix(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def shares(used):
    rows = used.groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("t")).collect()
    total = sum(r.t for r in rows)
    return {r.source: r.t / total for r in rows}, total


def test_shares_are_reached(spark):
    target = mix(spark, [("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.15, 4), ("absent", 0.05, 2)])
    used = mx.mix_to_targets(docs(spark, {"a": 900, "b": 250, "c": 150, "other": 50}), target)
    found, _ = shares(used)
    for source, share in (("a", 0.5), ("b", 0.3), ("c", 0.15)):
        assert abs(found[source] - share / 0.95) < 0.001
    assert "other" not in found
    assert {r.source: r.m for r in used.groupBy("source").agg(F.max("copies").alias("m")).collect()}["a"] == 1
    spread = used.groupBy("source").agg((F.max("copies") - F.min("copies")).alias("d")).collect()
    assert all(r.d <= 1 for r in spread)  # whole copies are certain, one more is drawn
    report = {r.source: tuple(r)[1:] for r in mx.mixture_shares(used, target).collect()}
    assert report["absent"] == (0.05, 0.0, 0, 0) and abs(report["a"][1] - 0.5 / 0.95) < 0.001
    assert sorted(map(tuple, used.collect())) == sorted(map(tuple, mx.mix_to_targets(docs(spark, {"c": 150, "b": 250, "a": 900}), target).collect()))


def test_caps_and_given_total(spark):
    target = mix(spark, [("a", 0.5, 1), ("b", 0.5, 2)])
    found, total = shares(mx.mix_to_targets(docs(spark, {"a": 100, "b": 1000}), target, total=10_000))
    assert abs(total - 10_000) < 20 and abs(found["a"] * total - sum(10 + i % 7 for i in range(100))) < 1


def test_radix_steps(spark, monkeypatch):
    monkeypatch.setattr(mx, "SMALL_BUCKET", 0)
    found, _ = shares(mx.mix_to_targets(docs(spark, {"a": 500, "b": 500}), mix(spark, [("a", 0.8, 1), ("b", 0.2, 1)])))
    assert abs(found["a"] - 0.8) < 0.005


def test_unequal_inclusion(spark):
    df = spark.range(4000).select(F.col("id").cast("string").alias("doc_id"), F.lit("a").alias("source"), F.lit(10).alias("n_tokens"), F.when(F.col("id") % 2 == 0, 3.0).otherwise(1.0).alias("weight"))
    used = mx.mix_to_targets(df, mix(spark, [("a", 1.0, 1)]), total=16_000)
    even = used.where("cast(doc_id as int) % 2 = 0").count()
    assert used.count() == 1600 and abs(even / 1600 - 0.75) < 0.04
    capped = mx.mix_to_targets(df, mix(spark, [("a", 1.0, 1)]), total=36_000)
    assert abs(capped.count() - 3600) <= 1 and capped.where("cast(doc_id as int) % 2 = 0").count() == 2000


def test_edges(spark):
    target = mix(spark, [("a", 1.0, 2), (None, 0.5, 1), ("b", None, 1), ("c", 0.2, None)])
    rows = [("x", "a", 5), ("x", "a", 5), (None, "a", 5), ("y", None, 5), ("z", "a", 0), ("v", "a", None), ("w", "b", 5)]
    df = spark.createDataFrame(rows, "doc_id string, source string, n_tokens long")
    assert [tuple(r) for r in mx.mix_to_targets(df, target).collect()] == [("x", "a", 5, 2)]
    assert mx.mix_to_targets(df.where("false"), target).count() == 0
    assert mx.mix_to_targets(df, target.where("false")).count() == 0
    with pytest.raises(ValueError):
        mx.mix_to_targets(df, mix(spark, [("a", 1.0, 2), ("a", 0.5, 2)]))
