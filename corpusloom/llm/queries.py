"""Queries of the problems on texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.alike import alike_classes, alike_pairs
from corpusloom.llm.language import fit_word_model, is_mixed, label_language, text_languages
from corpusloom.llm.leak import leaked_items
from corpusloom.llm.mixture import mix_to_targets, mixture_shares
from corpusloom.llm.neardup import near_duplicate_groups
from corpusloom.llm.quality import text_quality
from corpusloom.llm.tokenize import token_counts, token_ids
from corpusloom.operators.pairs import pairs_within
from corpusloom.session import cut, spread, table

TEXTS = (("leaf", "passage_id", "snippet"), ("fineweb_row", "id", "text"))


def _texts(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", *more, "text"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [alike_pairs(table(spark, sf_dir, name), key, text).select(F.lit(name).alias("src"), "key_a", "key_b") for name, key, text in TEXTS]
    return reduce(DataFrame.unionByName, parts)


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, key, class_id, n_links): each row of a class of look-alike texts, with the number of rows stored otherwise."""
    parts = [alike_classes(table(spark, sf_dir, name), key, text).select(F.lit(name).alias("src"), "key", "class_id", "n_links") for name, key, text in TEXTS]
    return reduce(DataFrame.unionByName, parts)


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(leaf_row, class_id, n_links) of every leaf that has a near-equal one."""
    return near_duplicate_groups(table(spark, sf_dir, "leaf"), "leaf_row", "snippet", 0.7).withColumnRenamed("row", "leaf_row")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = cut(near_duplicate_groups(table(spark, sf_dir, "leaf"), "leaf_row", "snippet", 0.7).select("row", "class_id").distinct())
    return pairs_within(groups, "class_id", "row").select("row_a", "row_b").distinct()


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids(_texts(spark, sf_dir), "doc_id", "text")


def _languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, language, segments) of every delivered row of fineweb_row with a key; re-delivered equal rows once."""
    rows = spread(table(spark, sf_dir, "fineweb_row").select("id", "language", "text"))
    model = fit_word_model(rows, "text", table(spark, sf_dir, "common_word"))
    rows = rows.where("id is not null").select(F.struct("id", "language").alias("k"), "text").select(F.to_json("k").alias("k"), "text")
    found = text_languages(rows, "k", "text", model)
    return found.select(F.from_json("key", "id string, language string").alias("k"), "segments").select("k.id", "k.language", "segments")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cut(_languages(spark, sf_dir))
    best = F.element_at("segments", 1)["lang"]
    rows = found.where(best.isNotNull()).select("id", label_language(F.col("language")).alias("label"), best.alias("lang"), "segments")
    other = ~F.col("label").eqNullSafe(F.col("lang"))
    whole = rows.where(other).select(F.lit("fineweb_row").alias("src"), F.col("id").alias("rec_key"), F.lit(0).alias("seg_no"), "lang")
    lines = rows.where(is_mixed(F.col("segments"))).select("id", F.explode("segments").alias("s")).where("s.seg_no > 0 and s.lang is not null")
    lines = lines.select(F.lit("fineweb_row").alias("src"), F.col("id").alias("rec_key"), F.col("s.seg_no").alias("seg_no"), F.col("s.lang").alias("lang"))
    entries = table(spark, sf_dir, "manifest_entry").where("snapshot_no = 4 and document_id is not null and occurrence_index is not null")
    entries = entries.groupBy("document_id", "occurrence_index").agg(F.max(F.struct("delivered_at", "source_url", "language", "source_dataset_id")).alias("e"))
    entries = entries.select("e.source_url", label_language(F.col("e.language")).alias("label")).where("source_url is not null").distinct()
    manifest = entries.join(rows.select(F.col("id").alias("source_url"), "lang").distinct(), "source_url").where(other)
    manifest = manifest.select(F.lit("manifest_entry").alias("src"), F.col("source_url").alias("rec_key"), F.lit(0).alias("seg_no"), "lang")
    return whole.unionByName(lines).unionByName(manifest).distinct()


def p4_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, seg_no, lang, confidence): every row of fineweb_row as a whole, and every line of a mixed text."""
    found = _languages(spark, sf_dir)
    kept = F.when(is_mixed(F.col("segments")), F.col("segments")).otherwise(F.slice("segments", 1, 1))
    return found.select("id", F.explode(kept).alias("s")).select("id", "s.seg_no", "s.lang", "s.confidence").distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_leaks(spark, sf_dir).select("benchmark", "item_id", "doc_id").distinct()


def p5_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(benchmark, item_id, doc_id, words_in_row, share_of_runs): every leak with what it gives away."""
    return leaked_items(_texts(spark, sf_dir), table(spark, sf_dir, "bench_item")).withColumn("share_of_runs", F.round("share_of_runs", 6)).drop("run_distance")


def p5_unreported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaks that the earlier scan in hit did not report, whatever spelling it gave the document's number."""
    known = table(spark, sf_dir, "hit").select("benchmark", "item_id", F.regexp_extract("doc_id", "([0-9]+)$", 1).cast("long").alias("doc_id")).distinct()
    return p5_found(spark, sf_dir).join(known, ["benchmark", "item_id", "doc_id"], "left_anti")


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts(_texts(spark, sf_dir, "source"), "text")
    return mix_to_targets(counted, table(spark, sf_dir, "mix_target"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, copies): the mixture, one row per document used."""
    return _mixed(spark, sf_dir)


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture_shares(_mixed(spark, sf_dir), table(spark, sf_dir, "mix_target"))


def p8_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_quality(_texts(spark, sf_dir), table(spark, sf_dir, "common_word"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_statistics(spark, sf_dir).where("kind <> 'prose'").select("doc_id", "kind")


QUERIES = {"p1_found": p1_found, "p1_classes": p1_classes, "p2_found": p2_found, "p2_groups": p2_groups, "p4_found": p4_found, "p4_languages": p4_languages, "p5_found": p5_found, "p5_leaks": p5_leaks, "p5_unreported": p5_unreported, "p6_ids": p6_ids, "p7_mix": p7_mix, "p7_shares": p7_shares, "p8_found": p8_found, "p8_statistics": p8_statistics}
