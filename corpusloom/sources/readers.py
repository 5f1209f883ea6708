"""Sources and sinks: line-delimited JSON, Parquet text, manifests, corpus descriptions, stored content."""

from __future__ import annotations

import hashlib
import json
import os
import tomllib
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corpusloom.schemas import MANIFEST


def _stem() -> Column:
    return F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), "\\.[^.]*$", "")


def read_documents(spark: SparkSession, path: str, text: str = "text") -> DataFrame:
    """(id, text) of a .jsonl, .json or .parquet file or folder; another suffix is an error."""
    suffix = Path(path.rstrip("/")).suffix
    if suffix in (".jsonl", ".json"):
        return read_jsonl(spark, path, text)
    if suffix == ".parquet":
        return read_parquet_texts(spark, path, text)
    raise ValueError(f"unknown kind of corpus file: {path}")


def read_jsonl(spark: SparkSession, path: str, text: str = "text") -> DataFrame:
    """One object per line; the id is the string or number under id, else <stem>/<line>, lines counted from 0 with blank
    ones; a malformed line, or one whose text is missing or no string, is an error.

    A line's number is found without reading files as a whole: lines of a file are ranked within partitions of it.
    """
    lines = spark.read.text(path).select("value", _stem().alias("stem"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    blocks = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = blocks.select("file", "block", "first", before.alias("before"))
    numbered = lines.join(offsets, ["file", "block"]).withColumn("line", F.col("at") - F.col("first") + F.col("before"))
    rows = numbered.where(F.trim("value") != "")
    parsed = F.try_parse_json("value")
    kind = lambda name: F.schema_of_variant(F.try_variant_get(parsed, f"$.{name}", "variant"))
    wrong = F.concat(F.lit("no text in line "), F.col("line").cast("string"), F.lit(" of "), F.col("file"))
    body = F.when(parsed.isNotNull() & (kind(text) == "STRING"), F.try_variant_get(parsed, f"$.{text}", "string")).otherwise(F.raise_error(wrong))
    own = F.when(kind("id") == "OBJECT", None).otherwise(F.try_variant_get(parsed, "$.id", "string"))
    return rows.select(F.coalesce(own, F.concat("stem", F.lit("/"), F.col("line").cast("string"))).alias("id"), body.alias("text"))


def read_parquet_texts(spark: SparkSession, path: str, text: str = "text") -> DataFrame:
    """The id is <stem>/<row>; a null text is empty; a column that holds no text is an error."""
    df = spark.read.parquet(path)
    if not isinstance(df.schema[text].dataType, T.StringType):
        raise TypeError(f"column {text} of {path} holds no text")
    return df.select(F.concat(_stem(), F.lit("/"), F.col("_metadata.row_index").cast("string")).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest in the fixed schema; columns are matched by name, so one in other order or width is read as well, and a
    missing column is an error."""
    df = spark.read.parquet(path)
    if missing := [f.name for f in MANIFEST if f.name not in df.columns]:
        raise ValueError(f"no manifest: {path} lacks {', '.join(missing)}")
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in MANIFEST))


def write_manifest(df: DataFrame, path: str, mode: str = "error") -> None:
    """Sorted within files whose ranges of documents don't overlap, so that lookups by document prune files."""
    ranged = df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in MANIFEST)).repartitionByRange("document_id", "occurrence_index")
    ranged.sortWithinPartitions("document_id", "occurrence_index").write.mode(mode).option("compression", "zstd").parquet(path)


def manifest_row_count(spark: SparkSession, path: str) -> int:
    return spark.read.parquet(path).count()


def manifest_metadata(path: str) -> dict[str, str]:
    """Key/value metadata of a local manifest's footer."""
    import pyarrow.parquet as pq

    files = [path] if os.path.isfile(path) else sorted(str(p) for p in Path(path).glob("*.parquet"))
    found = pq.read_metadata(files[0]).metadata or {}
    return {k.decode(): v.decode("utf-8", "replace") for k, v in found.items()}


ENTRY = T.StructType(
    [
        T.StructField("source_url", T.StringType()), T.StructField("modality", T.StringType()), T.StructField("mime_type", T.StringType()), T.StructField("source_type", T.StringType()),
        T.StructField("source_dataset_id", T.StringType()), T.StructField("registered_domain", T.StringType()), T.StructField("license_spdx", T.StringType()), T.StructField("language", T.StringType()),
        T.StructField("fetched_at", T.LongType()), T.StructField("included", T.BooleanType()), T.StructField("exclusion_reason", T.StringType()), T.StructField("path", T.StringType()), T.StructField("input_ordinal", T.LongType()),
    ]
)


def read_corpus_toml(spark: SparkSession, path: str, epoch: int | None = None) -> DataFrame:
    """Entries of a corpus description with the local path of each.

    included is true by default, fetched_at the given epoch, else the description's, else 0; relative paths start at the
    description; a remote source is an error.
    """
    with open(path, "rb") as file:
        described = tomllib.load(file)
    default = epoch if epoch is not None else described.get("corpus", {}).get("source_date_epoch", 0)
    rows = []
    for i, entry in enumerate(described.get("entry", [])):
        url = entry["source_url"]
        if url.startswith(("http://", "https://")):
            raise ValueError(f"remote sources are not read: {url}")
        local = url.removeprefix("file://")
        local = local if os.path.isabs(local) else os.path.join(os.path.dirname(os.path.abspath(path)), local)
        known = {f.name: entry.get(f.name) for f in ENTRY}
        rows.append(tuple((known | {"included": entry.get("included", True), "fetched_at": entry.get("fetched_at", default), "path": local, "input_ordinal": i}).values()))
    return spark.createDataFrame(rows, ENTRY)


def with_file_content(spark: SparkSession, entries: DataFrame, folder: str) -> DataFrame:
    """Entries with the bytes of their files under the folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "content")
    return entries.join(files, "path")


def store_content(df: DataFrame, path: str, key: str = "document_id") -> None:
    """Content by digest: one copy of each, partitioned by the digest's first byte; storing again adds only what is new."""
    spark = df.sparkSession
    new = df.select(key, "content").dropDuplicates([key]).withColumn("prefix", F.lower(F.hex(F.substring(key, 1, 1))))
    if os.path.exists(path):
        new = new.join(spark.read.parquet(path).select(key), key, "left_anti")
    new.write.mode("append").partitionBy("prefix").parquet(path)


def manifest_source(spec: str) -> dict[str, str | None]:
    """Parts of a manifest source: a local path, http(s)://…, or hf://owner/name[@revision]."""
    if spec.startswith("hf://"):
        repo, _, revision = spec.removeprefix("hf://").partition("@")
        return {"kind": "hf", "location": repo, "revision": revision or "main"}
    if spec.startswith(("http://", "https://")):
        return {"kind": "url", "location": spec, "revision": None}
    return {"kind": "local", "location": spec.removeprefix("file://"), "revision": None}


def cache_key(spec: str) -> str:
    """Name under which a remote manifest is kept: the digest of its parts."""
    return hashlib.sha256(json.dumps(manifest_source(spec), sort_keys=True, separators=(",", ":")).encode()).hexdigest()


# --- rows of common datasets as documents --------------------------------------------------------------------------


def entries_of_rows(df: DataFrame, text: Column, uri: Column, dataset: str, language: Column | None = None) -> DataFrame:
    """(source_url, source_dataset_id, language, content, size_bytes) of the rows of a dataset; a null text is empty."""
    content = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    return df.select(uri.alias("source_url"), F.lit(dataset).alias("source_dataset_id"), (F.lit(None).cast("string") if language is None else language).alias("language"), content.alias("content"), F.octet_length(content).cast("long").alias("size_bytes"))


def read_text_tree(spark: SparkSession, folder: str) -> DataFrame:
    """(split, name, content) of <split>/*.txt under a folder; splits are the first folders."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(folder)
    parts = F.split("path", "/")
    return files.select(F.element_at(parts, -2).alias("split"), F.element_at(parts, -1).alias("name"), "content")


# --- similarity index and reports ----------------------------------------------------------------------------------


def write_index(signatures: DataFrame, buckets: DataFrame, path: str, root: str, **parameters: int) -> None:
    """Signatures and buckets of an index with the root of the manifest it was built for."""
    signatures.write.mode("overwrite").parquet(f"{path}/signatures")
    buckets.write.mode("overwrite").parquet(f"{path}/buckets")
    row = [(root, json.dumps(parameters, sort_keys=True))]
    signatures.sparkSession.createDataFrame(row, "root string, parameters string").coalesce(1).write.mode("overwrite").parquet(f"{path}/binding")


def read_index(spark: SparkSession, path: str, root: str) -> tuple[DataFrame, DataFrame] | None:
    """(signatures, buckets), or None where there is no index or it was built for another manifest."""
    try:
        bound = spark.read.parquet(f"{path}/binding").first()
        if bound is None or bound.root != root:
            return None
        return spark.read.parquet(f"{path}/signatures"), spark.read.parquet(f"{path}/buckets")
    except Exception:  # missing or damaged: the caller searches without it
        return None


def write_report(report: dict, markdown: str, folder: str) -> None:
    """report.json, keys sorted, and report.md of a small report."""
    from corpusloom.functions.evidence import deterministic_json

    Path(folder).mkdir(parents=True, exist_ok=True)
    Path(folder, "report.json").write_text(deterministic_json(report), encoding="utf-8")
    Path(folder, "report.md").write_text(markdown, encoding="utf-8")
