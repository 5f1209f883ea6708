"""Contamination of documents by benchmark items: shared runs of 13 words, containment of 5-word runs, near matches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.blake3 import LABEL, with_sketches
from corpusloom.functions.runs import first_of_each, in_slices, run_hashes, run_starts, word_hashes
from corpusloom.functions.text import EXACT_WORDS, RUN_WORDS, normal_form, normalize_text, round6, share, snippet, word_points, word_runs, words
from corpusloom.operators.dedup import jaccard_estimate
from corpusloom.operators.run_filter import bitmap, may_hold
from corpusloom.session import counted, cut

CONTAINED, NEAR, MOST_HITS = 0.9, 0.8, 10


def _normal(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, normalize_text(F.coalesce("text", F.lit(""))).alias("normal"))


def _runs(df: DataFrame, key: str, within: np.ndarray | None = None) -> DataFrame:
    """(key, n, run, also): both 64-bit hashes of the distinct runs of 13 and of 5 words of (key, text), of those only that
    the bits of `within` let pass."""
    kind = df.schema[key].dataType.simpleString()
    shared = None if within is None else df.sparkSession.sparkContext.broadcast(within)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            owner, hashes = word_hashes([t or "" for t in batch.column(1).to_pylist()], normal_form, word_points())
            for n in (EXACT_WORDS, RUN_WORDS):
                at = run_starts(owner, n)
                found = run_hashes(hashes, at, n)
                if shared is not None:
                    passes = may_hold(shared.value, found)
                    at, found = at[passes], found[passes]
                some = first_of_each(owner[at], found)
                at, found = at[some], found[some]
                columns = [batch.column(0).take(pa.array(owner[at])), pa.array(np.full(len(at), n, np.int32)), pa.array(found.view(np.int64)), pa.array(run_hashes(hashes, at, n, True).view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "n", "run", "also"])

    return df.select(key, "text").mapInArrow(run, f"`{key}` {kind}, n int, run long, also long")


def shared_runs(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(benchmark, item_id, doc_id, shared_exact, shared_part): distinct runs of 13 and of 5 words that a document and an
    item share, by an inverted index of the items.

    Runs are compared by 128 bits of hash.  A bitmap of the items' runs, of bounded size, goes to all executors, and of the
    documents only the runs that it lets pass, hence mostly shared ones, are ever shuffled.
    """
    numbered = F.to_json(F.struct("benchmark", "item_id"))
    index = cut(_runs(items.select(numbered.alias("item"), F.coalesce("text", F.lit("")).alias("text")).distinct(), "item").distinct())
    found = _runs(docs.select("doc_id", "text"), "doc_id", bitmap(index)).join(counted(index), ["n", "run", "also"])
    pairs = found.groupBy("item", "doc_id").agg(F.count_if(F.col("n") == EXACT_WORDS).alias("shared_exact"), F.count_if(F.col("n") == RUN_WORDS).alias("shared_part"))
    return pairs.select(F.from_json("item", "benchmark string, item_id string").alias("item"), "doc_id", "shared_exact", "shared_part").select("item.*", "doc_id", "shared_exact", "shared_part")


def contamination(docs: DataFrame, items: DataFrame, near: float | None = NEAR, kernel: str = "blake3", label: bytes = LABEL) -> DataFrame:
    """Hits (benchmark, item_id, item_snippet, doc_id, shared_exact_shingles, jaccard_estimate, containment, exact, near,
    contained) of documents (doc_id, text) and items (benchmark, item_id, text).

    exact: a shared run of 13 words; contained: at least 0.9 of the item's distinct 5-word runs; near: estimated Jaccard
    similarity of at least `near`, which is looked at only where a 5-word run is shared (near=None skips it: 0 and false).
    Flags use unrounded values.  Null texts count as empty, items of under five words are never flagged.
    """
    texts = items
    items = cut(_normal(items, "benchmark", "item_id").distinct())
    keys = ["benchmark", "item_id", "doc_id"]
    facts = items.select("benchmark", "item_id", "normal", words(F.col("normal")).alias("w"))
    facts = facts.select("benchmark", "item_id", snippet(F.col("normal")).alias("item_snippet"), F.size(word_runs(F.col("w"), RUN_WORDS)).alias("item_runs"))
    pairs = shared_runs(docs, texts).join(facts, ["benchmark", "item_id"])
    pairs = pairs.withColumn("c", F.when(F.col("item_runs") > 0, F.col("shared_part") / F.col("item_runs")).otherwise(0.0))
    if near is None:
        pairs = pairs.withColumn("j", F.lit(0.0))
    else:
        pairs = cut(pairs)
        wanted = pairs.where("shared_part > 0")
        of = lambda df, *k: with_sketches(df.select(*k, "normal"), "normal", kernel, label).select(*k, "minhash")
        asked = docs.select("doc_id", "text").join(counted(wanted.select("doc_id").distinct()), "doc_id", "left_semi")  # before any text is normalised
        x = of(_normal(asked, "doc_id"), "doc_id").withColumnRenamed("minhash", "x")
        y = of(items, "benchmark", "item_id").withColumnRenamed("minhash", "y")
        j = wanted.select(*keys).join(x, "doc_id").join(y, ["benchmark", "item_id"]).select(*keys, jaccard_estimate(F.col("x"), F.col("y")).alias("j"))
        pairs = pairs.join(j, keys, "left").withColumn("j", F.coalesce("j", F.lit(0.0)))
    flags = [(F.col("shared_exact") > 0).alias("exact"), (F.col("j") >= (2.0 if near is None else near)).alias("near"), (F.col("c") >= CONTAINED).alias("contained")]
    hits = pairs.select(*keys, "item_snippet", F.col("shared_exact").alias("shared_exact_shingles"), round6(F.col("j")).alias("jaccard_estimate"), round6(F.col("c")).alias("containment"), *flags)
    return hits.where("exact or near or contained")


def contamination_rates(items: DataFrame, hits: DataFrame) -> DataFrame:
    """Per benchmark (items_total, flagged by exact, near, contained and any, contamination_rate); clean ones are listed."""
    total = items.select("benchmark", "item_id").distinct().groupBy("benchmark").agg(F.count("*").alias("items_total"))
    counts = hits.groupBy("benchmark", "item_id").agg(*(F.max(c).alias(c) for c in ("exact", "near", "contained")))
    flagged = counts.groupBy("benchmark").agg(*(F.count_if(c).alias(f"flagged_{c}") for c in ("exact", "near", "contained")), F.count("*").alias("flagged_any"))
    out = total.join(flagged, "benchmark", "left").na.fill(0)
    return out.withColumn("contamination_rate", share(F.col("flagged_any"), F.col("items_total")))


def corpus_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """(documents, words) after normalisation."""
    return docs.select(F.size(words(normalize_text(F.coalesce(F.col(text), F.lit(""))))).alias("n")).agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("words"))


def top_hits(hits: DataFrame, most: int = MOST_HITS) -> DataFrame:
    """The first hits by containment, similarity and document, a top-k report."""
    return hits.orderBy(F.desc("containment"), F.desc("jaccard_estimate"), "doc_id", "benchmark", "item_id").limit(most)
