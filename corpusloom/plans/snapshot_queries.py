"""Queries of problem 3 over manifest_entry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.snapshots import snapshot_changes
from corpusloom.session import table

KEYS, IGNORE = ("document_id", "occurrence_index"), ("fetched_at", "input_ordinal")
FIELDS = "sha256 size_bytes modality mime_type source_url source_type source_dataset_id registered_domain license_spdx language included exclusion_reason chunk_refs".split()
SIGNALS = "robots_disallow robots_user_agent ai_txt_disallow tdmrep_reservation tdmrep_policy_url aipref_usage_pref iptc_plus_dmi c2pa_training_mining rsl_permits liccium_tdmai_iscc liccium_tdmai_allow cloudflare_ai_train".split()


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = snapshot_changes(table(spark, sf_dir, "manifest_entry"), KEYS, "snapshot_no", "delivered_at", IGNORE)
    return changes.select(F.col("snapshot").cast("int").alias("snapshot_no"), F.lower(F.hex("document_id")).alias("document_id"), F.col("occurrence_index").cast("int").alias("occurrence_index"), "change", "fields")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir).drop("fields")


def p3_changed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each field changed between consecutive snapshots."""
    fields = _changes(spark, sf_dir).where("change = 'changed'").select("snapshot_no", F.explode("fields").alias("field"))
    return fields.groupBy("snapshot_no", "field").agg(F.count("*").alias("n"))


QUERIES = {"p3_found": p3_found, "p3_changed_fields": p3_changed_fields}

_COLUMNS = [*((f, f) for f in FIELDS), *((f"signals.{s}", f"signals_{s}") for s in SIGNALS)]
_LATEST = f"""
latest AS (
  SELECT snapshot_no, document_id, occurrence_index, {", ".join(f"{a} AS {b}" for a, b in _COLUMNS)}
  FROM manifest_entry WHERE snapshot_no IS NOT NULL AND document_id IS NOT NULL AND occurrence_index IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY snapshot_no, document_id, occurrence_index ORDER BY delivered_at DESC) = 1),
both_sides AS (
  SELECT coalesce(n.snapshot_no, o.snapshot_no + 1) AS snapshot_no, coalesce(n.document_id, o.document_id) AS document_id,
    coalesce(n.occurrence_index, o.occurrence_index) AS occurrence_index, o.snapshot_no AS was, n.snapshot_no AS is_now,
    {", ".join(f"o.{b} IS DISTINCT FROM n.{b} AS {b}" for _, b in _COLUMNS)}
  FROM latest n FULL OUTER JOIN latest o
    ON n.snapshot_no = o.snapshot_no + 1 AND n.document_id = o.document_id AND n.occurrence_index = o.occurrence_index)
"""
_IN_RANGE = "snapshot_no BETWEEN (SELECT min(snapshot_no) + 1 FROM manifest_entry) AND (SELECT max(snapshot_no) FROM manifest_entry)"
_UNNESTED = ", ".join(f"CASE WHEN {b} THEN '{a}' END" for a, b in _COLUMNS)

ORACLES = {
    "p3_found": f"""
WITH {_LATEST}
SELECT snapshot_no, lower(hex(document_id)) AS document_id, occurrence_index,
  CASE WHEN was IS NULL THEN 'added' WHEN is_now IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM both_sides WHERE {_IN_RANGE} AND (was IS NULL OR is_now IS NULL OR {" OR ".join(b for _, b in _COLUMNS)})""",
    "p3_changed_fields": f"""
WITH {_LATEST}, fields AS (
  SELECT snapshot_no, unnest([{_UNNESTED}]) AS field FROM both_sides WHERE {_IN_RANGE} AND was IS NOT NULL AND is_now IS NOT NULL)
SELECT snapshot_no, field, count(*) AS n FROM fields WHERE field IS NOT NULL GROUP BY ALL""",
}
