"""Manifest algebra: sealing, occurrence ranks, shards, merging, composition, versions, differences and coverage.

A manifest is a bag of documents keyed by (document_id, occurrence_index).  Everything is a DataFrame in and out; ranks are
windows over a document's own rows, totals are grouped sums, and no step orders the whole table on one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions.text import MODALITIES, SOURCE_TYPES, enum_label, ppm, share
from corpusloom.session import cut

DIMENSIONS = ("modality", "source_type", "license_spdx", "language")
VERSION_DIMENSIONS = (*DIMENSIONS, "source_dataset_id")
MOST_EXAMPLES = 16


# --- sealing -------------------------------------------------------------------------------------------------------


def ranks(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """0-based rank of every row within its group, in the order of the given columns, with no group or table on one task.

    Rows are range-partitioned by group and order and ranked within their partition.  Only the first group of a partition
    can have begun in an earlier one; what it has there is summed from one row per partition.  Order should be unique.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(parts, *group, *order).withColumn("_ranks_part", F.spark_partition_id()))
    of_group = F.struct(*group) if group else F.struct(F.lit(0).alias("all"))
    ranked = ranged.withColumn("_ranks_group", of_group)
    edges = ranked.groupBy("_ranks_part").agg(F.min("_ranks_group").alias("_ranks_first"), F.max("_ranks_group").alias("_ranks_last"))
    tails = ranked.join(F.broadcast(edges), "_ranks_part").groupBy("_ranks_part").agg(F.count_if(F.col("_ranks_group") == F.col("_ranks_last")).alias("_ranks_n"))
    ends = edges.join(F.broadcast(tails), "_ranks_part")  # one row per partition
    earlier = ends.select(F.col("_ranks_part").alias("_ranks_from"), F.col("_ranks_last").alias("_ranks_first"), "_ranks_n")
    offsets = edges.select("_ranks_part", "_ranks_first").join(F.broadcast(earlier), "_ranks_first").where("_ranks_from < _ranks_part").groupBy("_ranks_part").agg(F.sum("_ranks_n").alias("_ranks_before"))
    offsets = edges.select("_ranks_part", "_ranks_first").join(F.broadcast(offsets), "_ranks_part", "left")
    inside = Window.partitionBy("_ranks_part", "_ranks_group").orderBy(*order)
    ranked = ranked.withColumn("_ranks_rank", F.row_number().over(inside) - 1).join(F.broadcast(offsets), "_ranks_part")
    before = F.when(F.col("_ranks_group") == F.col("_ranks_first"), F.coalesce("_ranks_before", F.lit(0))).otherwise(0)
    return ranked.withColumn(name, (F.col("_ranks_rank") + before).cast("long")).drop("_ranks_part", "_ranks_group", "_ranks_first", "_ranks_rank", "_ranks_before")


def input_ordinals(df: DataFrame, order: Sequence[str], name: str = "input_ordinal") -> DataFrame:
    """0-based position in the order of the given columns."""
    return ranks(df, [], order, name)


def occurrence_indices(df: DataFrame, document: str = "document_id", ordinal: str = "input_ordinal", name: str = "occurrence_index") -> DataFrame:
    """Rank of every row within its document, by input order, from 0; one document may hold any share of the rows."""
    ranked = ranks(df.drop(name), [document], [ordinal], name)
    return ranked.withColumn(name, F.col(name).cast("int"))


def occurrence_violations(df: DataFrame) -> DataFrame:
    """Rows whose stored occurrence_index is not the rank that input order gives."""
    return occurrence_indices(df, name="_rank").where("not (_rank <=> occurrence_index)").drop("_rank")


def canonical(df: DataFrame) -> DataFrame:
    """The order in which a manifest is written: document, bytewise, then occurrence."""
    return df.orderBy("document_id", "occurrence_index")


def seal(df: DataFrame, content: Column, order: Sequence[str]) -> DataFrame:
    """df with sha256, size_bytes, input_ordinal and occurrence_index, keyed by the digest of the content as document_id."""
    sealed = df.withColumn("sha256", F.unhex(F.sha2(content, 256))).withColumn("size_bytes", F.octet_length(content).cast("long"))
    if "document_id" not in df.columns:
        sealed = sealed.withColumn("document_id", F.col("sha256"))
    return occurrence_indices(input_ordinals(sealed, order))


# --- shards --------------------------------------------------------------------------------------------------------


def shard_of(key: Column, shards: int) -> Column:
    """Shard by the first eight bytes, little-endian and unsigned, of a digest column."""
    value = reduce(lambda total, i: total + F.conv(F.hex(F.substring(key, i + 1, 1)), 16, 10).cast("decimal(20,0)") * F.lit(256**i).cast("decimal(20,0)"), range(8), F.lit(0).cast("decimal(20,0)"))
    return F.pmod(value, F.lit(shards).cast("decimal(20,0)")).cast("int")


def shard_plan(df: DataFrame, key: str, shards: int) -> DataFrame:
    """(shard, rows): rows of every shard that has any, named shard-0000 and so on."""
    return df.groupBy(shard_of(F.col(key), shards).alias("shard")).agg(F.count("*").alias("rows")).withColumn("name", F.format_string("shard-%04d", F.col("shard")))


def merge_shards(df: DataFrame, shard: str = "shard") -> DataFrame:
    """One manifest of sealed shards: input order is the shards' order, then their canonical order; ranks are made anew."""
    return occurrence_indices(input_ordinals(df.drop("input_ordinal"), [shard, "document_id", "occurrence_index"]))


def unsorted_shards(df: DataFrame, shard: str = "shard", position: str = "position") -> DataFrame:
    """Shards whose rows, by position, are not in the order of their documents: (shard, breaks)."""
    before = F.lag("document_id").over(Window.partitionBy(shard).orderBy(position))
    return df.withColumn("_before", before).where("_before > document_id").groupBy(shard).agg(F.count("*").alias("breaks"))


# --- composition ---------------------------------------------------------------------------------------------------


def _labelled(df: DataFrame, name: str) -> Column:
    """Text label of a dimension; enum codes become their labels."""
    codes = {"modality": MODALITIES, "source_type": SOURCE_TYPES}.get(name)
    if codes and df.schema[name].dataType.simpleString() != "string":
        return enum_label(F.col(name), codes)
    return F.col(name)


def _long(df: DataFrame, dimensions: Sequence[str], missing: str) -> DataFrame:
    """One row per row and dimension: a grouped sum over it combines before the shuffle to labels times partitions."""
    cells = [F.struct(F.lit(d).alias("dimension"), F.coalesce(_labelled(df, d), F.lit(missing)).alias("label")) for d in dimensions]
    return df.select("size_bytes", F.explode(F.array(*cells)).alias("cell")).select("size_bytes", "cell.*")


def composition(df: DataFrame, dimensions: Sequence[str] = DIMENSIONS, missing: str = "unspecified") -> DataFrame:
    """(dimension, label, documents, bytes, documents_share, bytes_share) over the included rows."""
    sums = _long(df.where("included"), dimensions, missing).groupBy("dimension", "label").agg(F.count("*").alias("documents"), F.sum("size_bytes").cast("long").alias("bytes"))
    total = Window.partitionBy("dimension")  # labels of one dimension
    return sums.select("dimension", "label", "documents", "bytes", share(F.col("documents"), F.sum("documents").over(total)).alias("documents_share"), share(F.col("bytes"), F.sum("bytes").over(total)).alias("bytes_share"))


def coverage(df: DataFrame, dimensions: Sequence[str] = DIMENSIONS) -> DataFrame:
    """(dimension, specified_documents, by_documents, by_bytes): how much of the included rows is labelled."""
    rows = df.where("included")
    sums = [F.count("*").alias("n"), F.sum("size_bytes").alias("b")]
    sums += [x for d in dimensions for x in (F.count(d).alias(f"n_{d}"), F.sum(F.when(F.col(d).isNotNull(), F.col("size_bytes"))).alias(f"b_{d}"))]
    one = rows.agg(*sums)
    cells = [F.struct(F.lit(d).alias("dimension"), F.col(f"n_{d}").alias("specified_documents"), share(F.col(f"n_{d}"), F.col("n")).alias("by_documents"), share(F.coalesce(F.col(f"b_{d}"), F.lit(0)), F.col("b")).alias("by_bytes")) for d in dimensions]
    return one.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def totals(df: DataFrame) -> DataFrame:
    """(documents, included, excluded, total_bytes, included_bytes) of one manifest; zeros for an empty one."""
    inside = F.when(F.col("included"), F.col("size_bytes")).otherwise(0)
    return df.agg(
        F.count("*").alias("documents"), F.count_if("included").alias("included"), F.count_if(~F.coalesce(F.col("included"), F.lit(False))).alias("excluded"),
        F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("long").alias("total_bytes"), F.coalesce(F.sum(inside), F.lit(0)).cast("long").alias("included_bytes"),
    )


def inspect(df: DataFrame) -> DataFrame:
    """(modality, documents, bytes): what one look at a manifest shows, over all rows."""
    return df.groupBy(_labelled(df, "modality").alias("modality")).agg(F.count("*").alias("documents"), F.sum("size_bytes").cast("long").alias("bytes"))


# --- versions ------------------------------------------------------------------------------------------------------


def version_summary(df: DataFrame) -> DataFrame:
    """(documents, distinct_documents, exact_duplicates, total_bytes); excluded rows count."""
    per = df.groupBy("document_id").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("b"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("documents"), F.count("*").alias("distinct_documents"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("exact_duplicates"), F.coalesce(F.sum("b"), F.lit(0)).cast("long").alias("total_bytes"))


def version_histogram(df: DataFrame, dimensions: Sequence[str] = VERSION_DIMENSIONS) -> DataFrame:
    return _long(df, dimensions, "(unspecified)").groupBy("dimension", "label").agg(F.count("*").alias("documents"))


def composition_shift(old: DataFrame, new: DataFrame, dimensions: Sequence[str] = VERSION_DIMENSIONS) -> DataFrame:
    """(dimension, label, old_share, new_share) over the labels of either version."""
    both = version_histogram(old, dimensions).select("dimension", "label", F.col("documents").alias("o"), F.lit(0).cast("long").alias("n"))
    both = both.unionByName(version_histogram(new, dimensions).select("dimension", "label", F.lit(0).cast("long").alias("o"), F.col("documents").alias("n")))
    sums = both.groupBy("dimension", "label").agg(F.sum("o").alias("o"), F.sum("n").alias("n"))
    total = Window.partitionBy("dimension")
    return sums.select("dimension", "label", share(F.col("o"), F.sum("o").over(total)).alias("old_share"), share(F.col("n"), F.sum("n").over(total)).alias("new_share"))


def multiset_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(document_id, old_count, new_count, status): added, removed, unchanged or shifted copies of every document.

    Both sides are counted in one grouped sum of signed sides, so a document that holds a third of all rows combines
    before the only shuffle and no join is skewed by it.
    """
    sides = old.select("document_id", F.lit(1).alias("o"), F.lit(0).alias("n")).unionByName(new.select("document_id", F.lit(0).alias("o"), F.lit(1).alias("n")))
    counts = sides.groupBy("document_id").agg(F.sum("o").alias("old_count"), F.sum("n").alias("new_count"))
    status = F.when(F.col("old_count") == 0, "added").when(F.col("new_count") == 0, "removed").when(F.col("old_count") == F.col("new_count"), "unchanged").otherwise("shifted")
    return counts.withColumn("status", status)


def diff_counts(old: DataFrame, new: DataFrame) -> DataFrame:
    """(added, removed, unchanged, shifted) in distinct documents; a shifted document, in both with another number of
    copies, is unchanged too."""
    d = multiset_diff(old, new)
    kinds = {"added": ["added"], "removed": ["removed"], "unchanged": ["unchanged", "shifted"], "shifted": ["shifted"]}
    return d.agg(*(F.count_if(F.col("status").isin(v)).alias(k) for k, v in kinds.items()))


def diff_examples(old: DataFrame, new: DataFrame, most: int = MOST_EXAMPLES) -> DataFrame:
    """(status, document_id, old_count, new_count): the first documents by id of every kind of change, a top-k report."""
    d = multiset_diff(old, new)
    parts = [d.where(F.col("status") == s).orderBy("document_id").limit(most) for s in ("added", "removed", "shifted")]
    return reduce(DataFrame.unionByName, parts)


# --- signals and licences ------------------------------------------------------------------------------------------


def signal_coverage(df: DataFrame) -> DataFrame:
    """(signal, coverage_ppm): parts per million of all rows that carry each signal; null for an empty manifest."""
    s = F.col("signals")
    present = {
        "robots_txt": s["robots_disallow"] | s["robots_user_agent"].isNotNull(), "ai_txt": s["ai_txt_disallow"],
        "tdm_rep": (s["tdmrep_reservation"] != 0) | s["tdmrep_policy_url"].isNotNull(), "aipref": s["aipref_usage_pref"].isNotNull(), "iptc_plus": s["iptc_plus_dmi"].isNotNull(),
        "c2pa": s["c2pa_training_mining"].isNotNull(), "rsl": s["rsl_permits"].isNotNull(), "liccium": s["liccium_tdmai_iscc"].isNotNull() | s["liccium_tdmai_allow"].isNotNull(),
        "cloudflare": s["cloudflare_ai_train"].isNotNull(),
    }
    one = df.agg(F.count("*").alias("rows"), *(F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in present.items()))
    cells = [F.struct(F.lit(k).alias("signal"), ppm(F.col(k), F.col("rows")).alias("coverage_ppm")) for k in present]
    return one.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def license_inventory(df: DataFrame) -> DataFrame:
    """(license_spdx, bytes, rows) of every licence that is named."""
    return df.where("license_spdx is not null").groupBy("license_spdx").agg(F.sum("size_bytes").cast("long").alias("bytes"), F.count("*").alias("rows"))
