"""Problem 1: texts that look the same but are stored with different characters."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.runs import in_slices
from corpusloom.llm.visible import skeleton
from corpusloom.operators.pairs import pairs_within
from corpusloom.session import cut


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_slices(batches):
        keys, forms, stored = [], [], []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            form = skeleton(text)
            if form and not form.isspace():
                keys.append(key)
                forms.append(hashlib.blake2b(form.encode("utf-8", "surrogatepass"), digest_size=16).digest())
                stored.append(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(forms, pa.binary()), pa.array(stored, pa.binary())], names=["key", "form", "stored"])


def visible_digests(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, form, stored): 128-bit digests of each text's visible form and of the text as stored; only digests are shuffled.

    Null keys, null texts and texts without a visible character give no row; re-delivered equal rows give one.
    """
    rows = df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).where("key is not null and text is not null")
    return rows.mapInArrow(_digests, "key string, form binary, stored binary").distinct()


def alike_members(df: DataFrame, key: str, text: str) -> DataFrame:
    """Members of every class of texts that look alike but are stored in two or more ways: (key, form, stored).

    Classes are kept as digests with their members, so a class that holds a third of all rows costs a row per member; the
    test for two spellings is a min/max that combines before the shuffle.  The texts are read once.
    """
    digests = cut(visible_digests(df, key, text))
    mixed = digests.groupBy("form").agg(F.min("stored").alias("lo"), F.max("stored").alias("hi")).where("lo <> hi").select("form")
    return digests.join(mixed, "form", "left_semi").select("key", "form", "stored")


def alike_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """Every pair of keys, key_a < key_b bytewise, with the same visible form but different stored text."""
    pairs = pairs_within(cut(alike_members(df, key, text)), "form", "key", ("stored",))
    return pairs.where("stored_a <> stored_b").select("key_a", "key_b").distinct()


def alike_classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, class_id, n_links): of each row of a class of look-alikes the class's least key and the number of rows that look
    like it but are stored otherwise; a key with several texts counts once for each of them."""
    members = cut(alike_members(df, key, text))
    classes = members.groupBy("form").agg(F.min("key").alias("class_id"), F.count("*").alias("rows"))
    same = members.groupBy("form", "stored").agg(F.count("*").alias("same"))
    out = members.join(same, ["form", "stored"]).join(classes, "form")
    return out.select("key", "class_id", (F.col("rows") - F.col("same")).alias("n_links"))


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_slices(batches):
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if t is None else skeleton(t) for t in batch.column(1).to_pylist()], pa.string())], names=["key", "visible"])


def visible_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, visible): every text in its one consistent form; null stays null, empty stays empty."""
    return df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).mapInArrow(_forms, "key string, visible string")
