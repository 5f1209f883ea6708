"""Fixed schemas."""

from __future__ import annotations

from pyspark.sql import types as T

SIGNALS = T.StructType(
    [
        T.StructField("robots_disallow", T.BooleanType()), T.StructField("robots_user_agent", T.StringType()), T.StructField("ai_txt_disallow", T.BooleanType()),
        T.StructField("tdmrep_reservation", T.ByteType()), T.StructField("tdmrep_policy_url", T.StringType()), T.StructField("aipref_usage_pref", T.StringType()),
        T.StructField("iptc_plus_dmi", T.StringType()), T.StructField("c2pa_training_mining", T.StringType()), T.StructField("rsl_permits", T.StringType()),
        T.StructField("liccium_tdmai_iscc", T.StringType()), T.StructField("liccium_tdmai_allow", T.BooleanType()), T.StructField("cloudflare_ai_train", T.StringType()),
    ]
)

MANIFEST = T.StructType(
    [
        T.StructField("document_id", T.BinaryType()), T.StructField("sha256", T.BinaryType()), T.StructField("size_bytes", T.LongType()), T.StructField("modality", T.ByteType()),
        T.StructField("mime_type", T.StringType()), T.StructField("source_url", T.StringType()), T.StructField("source_type", T.ByteType()), T.StructField("source_dataset_id", T.StringType()),
        T.StructField("registered_domain", T.StringType()), T.StructField("license_spdx", T.StringType()), T.StructField("language", T.StringType()), T.StructField("fetched_at", T.LongType()),
        T.StructField("signals", SIGNALS), T.StructField("included", T.BooleanType()), T.StructField("exclusion_reason", T.StringType()), T.StructField("chunk_refs", T.ArrayType(T.BinaryType())),
        T.StructField("input_ordinal", T.LongType()), T.StructField("occurrence_index", T.IntegerType()),
    ]
)

DOCUMENT = T.StructType([T.StructField("id", T.StringType()), T.StructField("text", T.StringType())])
