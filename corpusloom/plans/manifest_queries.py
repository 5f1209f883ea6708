"""Queries of manifest algebra, membership and signals over manifest_entry, documents and embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import signals as s
from corpusloom.functions import text as t
from corpusloom.functions.blake3 import with_sketches
from corpusloom.operators import lookup as lk
from corpusloom.operators import manifest as m
from corpusloom.operators import merkle as mk
from corpusloom.operators.dedup import signatures
from corpusloom.session import spread, table

OLD, NEW = 3, 4


def _version(spark: SparkSession, sf_dir: str, number: int) -> DataFrame:
    """One snapshot with each key's latest delivery."""
    rows = table(spark, sf_dir, "manifest_entry").where(F.col("snapshot_no") == number)
    kept = [c for c in rows.columns if c not in ("document_id", "occurrence_index", "delivered_at", "snapshot_no")]
    latest = rows.where("document_id is not null and occurrence_index is not null").groupBy("document_id", "occurrence_index").agg(F.max(F.struct("delivered_at", F.struct(*kept).alias("r"))).alias("d"))
    return latest.select("document_id", "occurrence_index", "d.r.*")


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return _version(spark, sf_dir, OLD), _version(spark, sf_dir, NEW)


def _hex(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: t.hex_of(F.col(n)) for n in names})


def seal_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")
    sealed = m.seal(docs, F.encode("text", "UTF-8"), ["doc_id"])
    return _hex(sealed.select("doc_id", "document_id", "size_bytes", "input_ordinal", "occurrence_index"), "document_id")


def occurrence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hex(m.occurrence_violations(_version(spark, sf_dir, NEW)).select("document_id", "occurrence_index", "input_ordinal"), "document_id")


def compose_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.composition(_version(spark, sf_dir, NEW))


def compose_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.coverage(_version(spark, sf_dir, NEW))


def manifest_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.totals(_version(spark, sf_dir, NEW))


def inspect_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.inspect(_version(spark, sf_dir, NEW))


def version_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.version_summary(_version(spark, sf_dir, NEW))


def version_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.version_histogram(_version(spark, sf_dir, NEW))


def diff_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hex(m.multiset_diff(*_both(spark, sf_dir)), "document_id")


def diff_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.diff_counts(*_both(spark, sf_dir))


def diff_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hex(m.diff_examples(*_both(spark, sf_dir)), "document_id")


def composition_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.composition_shift(*_both(spark, sf_dir))


def added_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _both(spark, sf_dir)
    return _hex(new.select("document_id").distinct().join(old.select("document_id"), "document_id", "left_anti"), "document_id")


def common_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _both(spark, sf_dir)
    return _hex(new.select("document_id").intersect(old.select("document_id")), "document_id")


def signal_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.signal_coverage(_version(spark, sf_dir, NEW))


def license_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.license_inventory(_version(spark, sf_dir, NEW))


def _sharded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _version(spark, sf_dir, NEW).withColumn("shard", m.shard_of(F.col("sha256"), 4))


def shard_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.shard_plan(_version(spark, sf_dir, NEW), "sha256", 4)


def merge_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hex(m.merge_shards(_sharded(spark, sf_dir).select("shard", "document_id", "occurrence_index", "size_bytes")), "document_id")


def _leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _version(spark, sf_dir, NEW).select("document_id", "occurrence_index")
    return m.input_ordinals(rows, ["document_id", "occurrence_index"], "position")


def merkle_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mk.merkle_root(_leaves(spark, sf_dir), "position", "document_id")


def audit_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves = _leaves(spark, sf_dir)
    return mk.audit_paths(mk.tree_levels(leaves, "position", "document_id"), leaves.where("position % 100 = 0"))


def membership_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _both(spark, sf_dir)
    targets = old.select(t.hex_of(F.col("document_id")).alias("target"), "document_id", "sha256").groupBy("target").agg(F.min("document_id").alias("document_id"), F.min("sha256").alias("sha256"))
    return lk.exact_matches(new, targets)


def adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _both(spark, sf_dir)
    return _hex(lk.adjacent_leaves(new, old), "document_id", "before", "after")


def prove_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cascade by digests for every document of the older version against the newer one, as its SQL has it."""
    old, new = _both(spark, sf_dir)
    targets = old.groupBy("document_id").agg(F.min("sha256").alias("sha256")).select(t.hex_of(F.col("document_id")).alias("target"), "document_id", "sha256")
    return _hex(lk.prove(new, targets), "before", "after")


def _text_signatures(spark: SparkSession, sf_dir: str, version: DataFrame) -> DataFrame:
    """(document_id, minhash) of the entries whose source_url has a text in fineweb_row."""
    texts = table(spark, sf_dir, "fineweb_row").where("id is not null and text is not null").groupBy(F.col("id").alias("source_url")).agg(F.min("text").alias("text"))
    held = version.select("document_id", "source_url").join(texts, "source_url").groupBy("document_id").agg(F.min("text").alias("text"))
    return signatures(held, "document_id", "text", "fast").select(F.col("key").alias("document_id"), "minhash")


def prove_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cascade of prove_targets with MinHash over the texts that exist; there are no code bodies and image hashes to ask for."""
    old, new = _both(spark, sf_dir)
    targets = old.groupBy("document_id").agg(F.min("sha256").alias("sha256")).join(_text_signatures(spark, sf_dir, old), "document_id", "left")
    targets = targets.select(t.hex_of(F.col("document_id")).alias("target"), "document_id", "sha256", "minhash")
    return _hex(lk.prove(new, targets, _text_signatures(spark, sf_dir, new)), "before", "after")


def removal_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _both(spark, sf_dir)
    return _hex(lk.removal_evidence(old, new, table(spark, sf_dir, "manifest_entry")), "document_id")


def chain_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every dataset is a corpus, every modality a model bound to the datasets that hold it; asked for is every document."""
    old, new = _both(spark, sf_dir)
    corpora = new.where("source_dataset_id is not null").select(F.col("source_dataset_id").alias("corpus")).distinct().select("corpus", F.sha2("corpus", 256).alias("attestation"), F.md5("corpus").alias("root"))
    bindings = new.where("source_dataset_id is not null").select(F.col("modality").cast("string").alias("subject"), F.sha2("source_dataset_id", 256).alias("attestation"), F.md5("source_dataset_id").alias("root")).distinct()
    questions = old.select(F.concat(F.lit("model-"), F.col("modality").cast("string")).alias("model"), F.col("modality").cast("string").alias("subject"), "document_id")
    return _hex(lk.chain_walk(questions, bindings, corpora, new.select(F.col("source_dataset_id").alias("corpus"), "document_id")), "document_id")


def mime_modality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _version(spark, sf_dir, NEW).where("mime_type is not null")
    return rows.groupBy("mime_type", t.modality_of_mime(F.col("mime_type")).alias("kind")).agg(F.count("*").alias("rows"))


def extension_modality(spark: SparkSession, sf_dir: str) -> DataFrame:
    extension = F.regexp_extract("source_url", "\\.([A-Za-z0-9]{1,5})$", 1)
    rows = _version(spark, sf_dir, NEW).where("source_url is not null").select(F.lower(extension).alias("extension"))
    return rows.groupBy("extension", t.modality_of_extension(F.col("extension")).alias("kind")).agg(F.count("*").alias("rows"))


def size_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").groupBy("registered_domain").agg(F.coalesce(F.sum("n_chars"), F.lit(0)).alias("chars"))
    return rows.select("registered_domain", "chars", t.size_category(F.col("chars")).alias("category"))


def _bits(vector: Column) -> Column:
    """Signs of the first 64 dimensions as one long."""
    return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(F.get(vector, i) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def hamming_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows within six bits of the rows whose id is divisible by 100."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", _bits(F.col("embedding")).alias("bits"))
    return lk.near_bits(rows, rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "bits"), "vec_id", "query_id")


def _signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signatures(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text", "fast").select(F.col("key").alias("doc_id"), "minhash")


def index_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lk.bucket_statistics(lk.index_buckets(_signatures(spark, sf_dir), "doc_id"))


def fuzzy_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best match of every document whose id is divisible by 100 among all other documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sketched = lambda df: with_sketches(spread(df).select("doc_id", t.normalize_text(F.coalesce("text", F.lit(""))).alias("normal")), "normal", "fast").select("doc_id", "minhash")
    asked = sketched(docs.where("doc_id % 100 = 0")).withColumnRenamed("doc_id", "query_id")
    return lk.best_minhash(sketched(docs), asked, "doc_id", "query_id", own=False)


ROBOTS = "User-agent: GPTBot\nDisallow: /\nAllow: /del\n\nUser-agent: *\nDisallow: /ith\nDisallow: /var\nAllow: /vark\n"
AI_TXT = "User-Agent: *\nDisallow-AI-Training: /ze\nAllow-AI-Training: /zero\nDisallow-AI-Training: image/*\n"
TDM = '[{"location": "/kan", "tdm-reservation": 1}, {"location": "/kano", "tdm-reservation": 0}]'


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("url is not null").select("doc_id", F.regexp_replace("url", "^[a-z]+://[^/]*", "").alias("path"))


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of one policy of each kind for the path of every document; the policies are parsed once."""
    agents = ("GPTBot", "CCBot")
    policy = spark.range(1).select(*(f(F.lit(x)).alias(n) for n, f, x in (("robots", s.robots_rules, ROBOTS), ("ai", s.ai_txt_rules, AI_TXT), ("tdm", s.tdm_rules, TDM)))).first()
    literal = lambda rules, kind: F.from_json(F.lit(t_json(rules)), kind)
    kind = "array<struct<agent:string,allow:boolean,pattern:string>>"
    robots, ai, tdm = literal(policy.robots, kind), literal(policy.ai, kind), literal(policy.tdm, s.TDM_RULES)
    rows = _paths(spark, sf_dir).withColumn("agent", F.explode(F.array(*map(F.lit, agents))))
    nothing = F.lit(None).cast("int")
    return rows.select("doc_id", "agent", s.robots_verdict(robots, F.col("agent"), F.col("path")).alias("robots_txt"), s.ai_txt_verdict(ai, F.col("agent"), F.col("path")).alias("ai_txt"), s.tdm_verdict(nothing, nothing, tdm, F.col("path")).alias("tdm_rep"))


def t_json(rows: list) -> str:
    import json

    return json.dumps([r.asDict() for r in rows])


def signal_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(spark, sf_dir)


def ruleset_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = F.array(*(F.struct(F.lit(n).alias("source"), F.col(n).alias("verdict")) for n in ("robots_txt", "ai_txt", "tdm_rep")))
    rows = _verdicts(spark, sf_dir).withColumn("ruleset", F.explode(F.array(*map(F.lit, ("strict", "audit", "permissive")))))
    decided = rows.select("doc_id", "agent", "ruleset", s.decide(reports, F.col("ruleset")).alias("d")).select("doc_id", "agent", "ruleset", "d.*")
    return decided.withColumn("included", s.is_included(F.col("decision")))


def consent_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules in the corpus's own consent files: (doc_id, robots_rules, ai_rules, knows_all)."""
    files = table(spark, sf_dir, "documents").where("source = 'consent_file' and text is not null")
    parsed = files.select("doc_id", s.robots_rules(F.col("text")).alias("robots"), s.ai_txt_rules(F.col("text")).alias("ai"))
    count = lambda c: F.size(F.filter(c, lambda r: r["pattern"].isNotNull()))
    return parsed.select("doc_id", count(F.col("robots")).alias("robots_rules"), count(F.col("ai")).alias("ai_rules"), s.knows_agent(F.col("robots"), F.lit("*")).alias("knows_all"))


QUERIES = {
    f.__name__: f
    for f in (
        seal_manifest, occurrence_audit, compose_manifest, compose_coverage, manifest_totals, inspect_manifest, version_summary, version_histogram, diff_status, diff_counts, diff_examples, composition_shift,
        added_ids, common_ids, signal_coverage, license_inventory, shard_plan, merge_ranked, merkle_root, audit_paths, membership_exact, adjacency, prove_targets, prove_texts, removal_evidence, chain_walk, mime_modality,
        extension_modality, size_categories, hamming_neighbours, index_statistics, fuzzy_lookup, signal_verdicts, ruleset_decisions, consent_files,
    )
}


def _v(name: str, number: int) -> str:
    return f"{name} AS (SELECT * FROM manifest_entry WHERE snapshot_no = {number} AND document_id IS NOT NULL AND occurrence_index IS NOT NULL QUALIFY row_number() OVER (PARTITION BY document_id, occurrence_index ORDER BY delivered_at DESC) = 1)"


_NEW, _BOTH = f"WITH {_v('new', NEW)}", f"WITH {_v('old', OLD)}, {_v('new', NEW)}"
_MODALITY = "CASE modality " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(t.MODALITIES)) + " END"
_SOURCE = "CASE source_type " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(t.SOURCE_TYPES)) + " END"
_LABELS = {"modality": _MODALITY, "source_type": _SOURCE, "license_spdx": "license_spdx", "language": "language", "source_dataset_id": "source_dataset_id"}


def _cells(source: str, names: tuple[str, ...], missing: str, where: str = "") -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS dimension, coalesce({_LABELS[n]}, '{missing}') AS label, size_bytes FROM {source} {where}" for n in names)


_DIFF = """counts AS (SELECT document_id, sum(o)::BIGINT AS old_count, sum(n)::BIGINT AS new_count FROM (SELECT document_id, 1 AS o, 0 AS n FROM old UNION ALL SELECT document_id, 0, 1 FROM new) GROUP BY 1),
diff AS (SELECT *, CASE WHEN old_count = 0 THEN 'added' WHEN new_count = 0 THEN 'removed' WHEN old_count = new_count THEN 'unchanged' ELSE 'shifted' END AS status FROM counts)"""
_PRESENT = {
    "robots_txt": "signals.robots_disallow OR signals.robots_user_agent IS NOT NULL", "ai_txt": "signals.ai_txt_disallow", "tdm_rep": "signals.tdmrep_reservation <> 0 OR signals.tdmrep_policy_url IS NOT NULL",
    "aipref": "signals.aipref_usage_pref IS NOT NULL", "iptc_plus": "signals.iptc_plus_dmi IS NOT NULL", "c2pa": "signals.c2pa_training_mining IS NOT NULL", "rsl": "signals.rsl_permits IS NOT NULL",
    "liccium": "signals.liccium_tdmai_iscc IS NOT NULL OR signals.liccium_tdmai_allow IS NOT NULL", "cloudflare": "signals.cloudflare_ai_train IS NOT NULL",
}
_LITTLE_ENDIAN = " || ".join(f"substr(h, {2 * i + 1}, 2)" for i in range(7, -1, -1))
_SHARD = f"(CAST('0x' || {_LITTLE_ENDIAN} AS UBIGINT) % 4)::INT"
_VERDICTS = """paths AS (SELECT doc_id, agent, regexp_replace(url, '^[a-z]+://[^/]*', '') AS path FROM documents, (VALUES ('GPTBot'), ('CCBot')) a(agent) WHERE url IS NOT NULL),
verdicts AS (SELECT doc_id, agent,
  CASE WHEN agent = 'GPTBot' THEN CASE WHEN path LIKE '/del%' THEN 'allowed' WHEN path LIKE '/%' THEN 'disallowed' ELSE 'allowed' END
    ELSE CASE WHEN path LIKE '/vark%' THEN 'allowed' WHEN path LIKE '/ith%' OR path LIKE '/var%' THEN 'disallowed' ELSE 'allowed' END END AS robots_txt,
  CASE WHEN path LIKE '/zero%' THEN 'allowed' WHEN path LIKE '/ze%' THEN 'disallowed' ELSE 'allowed' END AS ai_txt,
  CASE WHEN path LIKE '/kano%' THEN 'allowed' WHEN path LIKE '/kan%' THEN 'disallowed' ELSE 'unknown' END AS tdm_rep FROM paths)"""
_FIRST_NO = "CASE WHEN robots_txt = 'disallowed' THEN 'robots_txt' WHEN ai_txt = 'disallowed' THEN 'ai_txt' WHEN tdm_rep = 'disallowed' THEN 'tdm_rep' END"
_SIGN_BITS = "list_transform(range(1, 65), lambda i: CASE WHEN embedding[i] > 0 THEN 1 ELSE 0 END)"

ORACLES = {
    "seal_manifest": """
SELECT doc_id, sha256(text) AS document_id, strlen(text)::BIGINT AS size_bytes, (row_number() OVER (ORDER BY doc_id) - 1)::BIGINT AS input_ordinal,
  (row_number() OVER (PARTITION BY text ORDER BY doc_id) - 1)::INT AS occurrence_index FROM documents WHERE text IS NOT NULL""",
    "occurrence_audit": f"""{_NEW}
SELECT lower(hex(document_id)) AS document_id, occurrence_index, input_ordinal FROM new
QUALIFY occurrence_index IS DISTINCT FROM row_number() OVER (PARTITION BY document_id ORDER BY input_ordinal) - 1""",
    "compose_manifest": f"""{_NEW}, cells AS ({_cells("new", m.DIMENSIONS, "unspecified", "WHERE included")}),
sums AS (SELECT dimension, label, count(*) AS documents, sum(size_bytes)::BIGINT AS bytes FROM cells GROUP BY ALL)
SELECT *, round(documents / sum(documents) OVER (PARTITION BY dimension), 6) AS documents_share, round(bytes / sum(bytes) OVER (PARTITION BY dimension), 6) AS bytes_share FROM sums""",
    "compose_coverage": f"{_NEW} "
    + " UNION ALL ".join(f"SELECT '{n}' AS dimension, count({n}) AS specified_documents, round(count({n}) / count(*), 6) AS by_documents, round(coalesce(sum(size_bytes) FILTER ({n} IS NOT NULL), 0) / sum(size_bytes), 6) AS by_bytes FROM new WHERE included" for n in m.DIMENSIONS),
    "manifest_totals": f"{_NEW} SELECT count(*) AS documents, count_if(included)::BIGINT AS included, count_if(NOT coalesce(included, false))::BIGINT AS excluded, sum(size_bytes)::BIGINT AS total_bytes, coalesce(sum(size_bytes) FILTER (included), 0)::BIGINT AS included_bytes FROM new",
    "inspect_manifest": f"{_NEW} SELECT {_MODALITY} AS modality, count(*) AS documents, sum(size_bytes)::BIGINT AS bytes FROM new GROUP BY 1",
    "version_summary": f"{_NEW} SELECT count(*) AS documents, count(DISTINCT document_id) AS distinct_documents, count(*) - count(DISTINCT document_id) AS exact_duplicates, sum(size_bytes)::BIGINT AS total_bytes FROM new",
    "version_histogram": f"{_NEW}, cells AS ({_cells('new', m.VERSION_DIMENSIONS, '(unspecified)')}) SELECT dimension, label, count(*) AS documents FROM cells GROUP BY ALL",
    "diff_status": f"{_BOTH}, {_DIFF} SELECT lower(hex(document_id)) AS document_id, old_count, new_count, status FROM diff",
    "diff_counts": f"{_BOTH}, {_DIFF} SELECT count_if(status = 'added')::BIGINT AS added, count_if(status = 'removed')::BIGINT AS removed, count_if(status IN ('unchanged', 'shifted'))::BIGINT AS unchanged, count_if(status = 'shifted')::BIGINT AS shifted FROM diff",
    "diff_examples": f"{_BOTH}, {_DIFF} SELECT lower(hex(document_id)) AS document_id, old_count, new_count, status FROM diff WHERE status <> 'unchanged' QUALIFY row_number() OVER (PARTITION BY status ORDER BY document_id) <= 16",
    "composition_shift": f"""{_BOTH}, o AS ({_cells("old", m.VERSION_DIMENSIONS, "(unspecified)")}), n AS ({_cells("new", m.VERSION_DIMENSIONS, "(unspecified)")}),
sums AS (SELECT dimension, label, sum(a) AS a, sum(b) AS b FROM (SELECT dimension, label, 1 AS a, 0 AS b FROM o UNION ALL SELECT dimension, label, 0, 1 FROM n) GROUP BY ALL)
SELECT dimension, label, round(a / sum(a) OVER (PARTITION BY dimension), 6) AS old_share, round(b / sum(b) OVER (PARTITION BY dimension), 6) AS new_share FROM sums""",
    "added_ids": f"{_BOTH} SELECT DISTINCT lower(hex(document_id)) AS document_id FROM new WHERE document_id NOT IN (SELECT document_id FROM old)",
    "common_ids": f"{_BOTH} SELECT lower(hex(document_id)) AS document_id FROM (SELECT document_id FROM new INTERSECT SELECT document_id FROM old)",
    "signal_coverage": f"{_NEW} " + " UNION ALL ".join(f"SELECT '{k}' AS signal, (count_if(coalesce({c}, false)) * 1000000 // count(*))::BIGINT AS coverage_ppm FROM new" for k, c in _PRESENT.items()),
    "license_inventory": f"{_NEW} SELECT license_spdx, sum(size_bytes)::BIGINT AS bytes, count(*) AS rows FROM new WHERE license_spdx IS NOT NULL GROUP BY 1",
    "shard_plan": f"{_NEW}, h AS (SELECT lower(hex(sha256)) AS h FROM new) SELECT {_SHARD} AS shard, count(*) AS rows, printf('shard-%04d', {_SHARD}) AS name FROM h GROUP BY ALL",
    "merge_ranked": f"""{_NEW}, h AS (SELECT *, lower(hex(sha256)) AS h FROM new), s AS (SELECT *, {_SHARD} AS shard FROM h),
r AS (SELECT shard, document_id, size_bytes, row_number() OVER (ORDER BY shard, document_id, occurrence_index) - 1 AS input_ordinal FROM s)
SELECT shard, lower(hex(document_id)) AS document_id, size_bytes, input_ordinal::BIGINT AS input_ordinal, (row_number() OVER (PARTITION BY document_id ORDER BY input_ordinal) - 1)::INT AS occurrence_index FROM r""",
    "membership_exact": f"""{_BOTH}, t AS (SELECT document_id, min(sha256) AS sha256 FROM old GROUP BY 1),
a AS (SELECT document_id, count(*) AS n FROM new GROUP BY 1), b AS (SELECT sha256, count(*) AS n FROM new GROUP BY 1)
SELECT lower(hex(t.document_id)) AS target, CASE WHEN a.n > 0 THEN 'blake3' WHEN b.n > 0 THEN 'sha256' END AS matched_by, coalesce(a.n, b.n, 0)::BIGINT AS matches
FROM t LEFT JOIN a USING (document_id) LEFT JOIN b ON b.sha256 = t.sha256""",
    "prove_targets": f"""{_BOTH}, t AS (SELECT document_id, min(sha256) AS sha256 FROM old GROUP BY 1),
a AS (SELECT document_id, count(*) AS n FROM new GROUP BY 1), b AS (SELECT sha256, count(*) AS n FROM new GROUP BY 1),
x AS (SELECT t.document_id, CASE WHEN a.n > 0 THEN 'blake3' WHEN b.n > 0 THEN 'sha256' END AS matched_by, coalesce(a.n, b.n, 0) AS n,
  (SELECT max(document_id) FROM new WHERE new.document_id < t.document_id) AS lo, (SELECT min(document_id) FROM new WHERE new.document_id > t.document_id) AS hi
  FROM t LEFT JOIN a USING (document_id) LEFT JOIN b ON b.sha256 = t.sha256)
SELECT lower(hex(document_id)) AS target, CASE WHEN n > 1 THEN 'ambiguous' WHEN n = 1 THEN 'included' WHEN lo IS NULL AND hi IS NULL THEN 'empty' WHEN lo IS NULL THEN 'before_first' WHEN hi IS NULL THEN 'after_last' ELSE 'interior' END AS outcome,
  matched_by, CASE WHEN n = 1 THEN 1.0::DOUBLE END AS confidence, CASE WHEN n = 0 THEN lower(hex(lo)) END AS before, CASE WHEN n = 0 THEN lower(hex(hi)) END AS after FROM x""",
    "adjacency": f"""{_BOTH}, q AS (SELECT DISTINCT document_id FROM old), l AS (SELECT DISTINCT document_id, document_id AS leaf FROM new),
m AS (SELECT document_id, leaf, q.document_id IS NOT NULL AS asked FROM q FULL JOIN l USING (document_id)),
w AS (SELECT *, max(leaf) OVER (ORDER BY document_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lo, min(leaf) OVER (ORDER BY document_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS hi,
  document_id IN (SELECT document_id FROM q) AS wanted FROM m)
SELECT lower(hex(document_id)) AS document_id, CASE WHEN leaf IS NOT NULL THEN 'found' WHEN lo IS NULL AND hi IS NULL THEN 'empty' WHEN lo IS NULL THEN 'before_first' WHEN hi IS NULL THEN 'after_last' ELSE 'interior' END AS outcome,
  lower(hex(lo)) AS before, lower(hex(hi)) AS after FROM w WHERE wanted""",
    "removal_evidence": f"""{_BOTH}, q AS (SELECT DISTINCT document_id FROM manifest_entry WHERE document_id IS NOT NULL), b AS (SELECT document_id, bool_or(included) AS i FROM old GROUP BY 1)
SELECT lower(hex(document_id)) AS document_id, CASE WHEN document_id IN (SELECT document_id FROM new) THEN 'still_present' WHEN i THEN 'removed' WHEN i IS NOT NULL THEN 'not_included_before' ELSE 'never_present' END AS outcome
FROM q LEFT JOIN b USING (document_id)""",
    "chain_walk": f"""{_BOTH}, q AS (SELECT DISTINCT modality, document_id FROM old), bound AS (SELECT DISTINCT modality, source_dataset_id FROM new WHERE source_dataset_id IS NOT NULL),
held AS (SELECT DISTINCT q.modality, q.document_id FROM q JOIN new n USING (document_id) JOIN bound b ON b.modality = q.modality AND b.source_dataset_id = n.source_dataset_id)
SELECT 'model-' || q.modality AS model, lower(hex(q.document_id)) AS document_id, h.document_id IS NOT NULL AS member FROM q LEFT JOIN held h ON h.modality = q.modality AND h.document_id = q.document_id""",
    "mime_modality": f"""{_NEW}, b AS (SELECT mime_type, trim(lower(split_part(mime_type, ';', 1))) AS x FROM new WHERE mime_type IS NOT NULL)
SELECT mime_type, CASE WHEN x IN ('application/json', 'application/xml', 'application/yaml') THEN 'text' WHEN x = 'application/pdf' THEN 'pdf'
  WHEN x LIKE 'text/%' THEN 'text' WHEN x LIKE 'image/%' THEN 'image' WHEN x LIKE 'audio/%' THEN 'audio' WHEN x LIKE 'video/%' THEN 'video' ELSE 'other' END AS kind, count(*) AS rows FROM b GROUP BY ALL""",
    "extension_modality": f"""{_NEW}, e AS (SELECT lower(regexp_extract(source_url, '\\.([A-Za-z0-9]{{1,5}})$', 1)) AS extension FROM new WHERE source_url IS NOT NULL)
SELECT extension, CASE {" ".join(f"WHEN list_contains(string_split('{x}', ' '), extension) THEN '{k}'" for k, x in t.EXTENSIONS.items())} ELSE 'other' END AS kind, count(*) AS rows FROM e GROUP BY ALL""",
    "size_categories": f"SELECT registered_domain, c AS chars, CASE {' '.join(f'WHEN c < {n} THEN {chr(39)}{x}{chr(39)}' for n, x in t.SIZES)} ELSE 'n>10B' END AS category FROM (SELECT registered_domain, coalesce(sum(n_chars), 0)::BIGINT AS c FROM documents GROUP BY 1)",
    "hamming_neighbours": f"""WITH v AS (SELECT vec_id, {_SIGN_BITS} AS s FROM embeddings)
SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(range(1, 65), lambda i: CASE WHEN q.s[i] <> v.s[i] THEN 1 ELSE 0 END))::INT AS distance
FROM v q JOIN v ON list_sum(list_transform(range(1, 65), lambda i: CASE WHEN q.s[i] <> v.s[i] THEN 1 ELSE 0 END)) <= 6 WHERE q.vec_id % 100 = 0""",
    "signal_verdicts": f"WITH {_VERDICTS} SELECT * FROM verdicts",
    "ruleset_decisions": f"""WITH {_VERDICTS}, f AS (SELECT *, {_FIRST_NO} AS no, 'allowed' IN (robots_txt, ai_txt, tdm_rep) AS yes FROM verdicts, (VALUES ('strict'), ('audit'), ('permissive')) r(ruleset)),
d AS (SELECT *, CASE WHEN no IS NOT NULL THEN CASE ruleset WHEN 'strict' THEN 'exclude' ELSE 'flag' END WHEN yes THEN 'include' ELSE CASE ruleset WHEN 'strict' THEN 'exclude' WHEN 'audit' THEN 'flag' ELSE 'include' END END AS decision FROM f)
SELECT doc_id, agent, ruleset, decision, CASE WHEN no IS NOT NULL THEN no || ' signal: Disallowed' WHEN NOT yes AND ruleset <> 'permissive' THEN 'no signal expressed a preference (all Unknown)' END AS reason, decision <> 'exclude' AS included FROM d""",
}
