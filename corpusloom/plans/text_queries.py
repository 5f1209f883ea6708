"""Queries of the text kernel, duplicates and contamination over documents, bench_item and leaf."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as t
from corpusloom.functions.blake3 import with_digest, with_sketches
from corpusloom.operators import contamination as c
from corpusloom.operators import dedup as d
from corpusloom.operators.passages import passages
from corpusloom.session import cut, spread, table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", t.normalize_text(F.coalesce("text", F.lit(""))).alias("normal"))


def corpus_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.corpus_words(_docs(spark, sf_dir))


def normalized_text_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _normal(spark, sf_dir).select("doc_id", F.sha2("normal", 256).alias("normal_sha256"))


def shingle_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _normal(spark, sf_dir).select("doc_id", t.words(F.col("normal")).alias("w"))
    return rows.select("doc_id", F.size("w").alias("n_words"), F.size(t.shingles(F.col("w"))).alias("n_shingles"), F.size(t.word_runs(F.col("w"), 13)).alias("n_runs"))


def exact_dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.exact_groups(_docs(spark, sf_dir), "doc_id", "text")


def _hits(spark: SparkSession, sf_dir: str, near: float | None, kernel: str = "fast") -> DataFrame:
    return c.contamination(_docs(spark, sf_dir), table(spark, sf_dir, "bench_item").select("benchmark", "item_id", "text"), near, kernel)


def contamination_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir, None).drop("jaccard_estimate", "near")


def contamination_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = c.contamination_rates(table(spark, sf_dir, "bench_item"), _hits(spark, sf_dir, None))
    return rates.drop("flagged_near")


def contamination_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir, c.NEAR)


def contamination_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.top_hits(_hits(spark, sf_dir, None)).select("benchmark", "item_id", "doc_id", "containment")


def contamination_rates_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates by all three signals; contamination_rates has the two that its SQL can express."""
    return c.contamination_rates(table(spark, sf_dir, "bench_item"), contamination_full(spark, sf_dir))


def contamination_top_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hits of all three signals by containment, similarity and document."""
    return c.top_hits(contamination_full(spark, sf_dir))


def minhash_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_sketches(_normal(spark, sf_dir), "normal", "blake3", simhash=True).select("doc_id", "minhash", "simhash")


def document_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_digest(_docs(spark, sf_dir), "text").select("doc_id", F.lower(F.hex("document_id")).alias("document_id"))


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.dedup(_docs(spark, sf_dir), "doc_id", "text", kernel="fast")


def dedup_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clusters(spark, sf_dir)


def dedup_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.dedup_summary(_docs(spark, sf_dir), _clusters(spark, sf_dir))


def dedup_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.size_histogram(_clusters(spark, sf_dir))


def dedup_largest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.largest_clusters(cut(_clusters(spark, sf_dir)), "doc_id")


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "bench_item").select("benchmark", "item_id", t.snippet(t.normalize_text(F.col("text"))).alias("item_snippet"))


def heading_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _docs(spark, sf_dir).select(F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy(t.heading_kind(F.col("line")).alias("kind")).agg(F.count("*").alias("lines"))


def article_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(_docs(spark, sf_dir).where("text is not null"), "doc_id", "text")


def rendered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "leaf").select("leaf_row", F.md5(t.render_row(F.col("title"), F.col("snippet"), F.col("url"))).alias("rendered_md5"))
    return rows.distinct()


def secret_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.find_secrets(_docs(spark, sf_dir), "doc_id", "text")


QUERIES = {
    f.__name__: f
    for f in (
        corpus_words, normalized_text_hash, shingle_counts, exact_dup_groups, contamination_hits, contamination_rates, contamination_full, contamination_top, contamination_rates_full, contamination_top_full, minhash_signatures, document_digests,
        dedup_clusters, dedup_summary, dedup_histogram, dedup_largest, snippets, heading_kinds, article_passages, rendered_rows, secret_findings,
    )
}

_SPACE = "[\\t\\n\\x0B\\f\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+"


def _norm(column: str) -> str:
    return f"trim(regexp_replace(lower(nfc_normalize({column})), '{_SPACE}', ' ', 'g'), ' ')"


_WORDS = f"""
docs AS (SELECT doc_id, list_filter(string_split({_norm("coalesce(text, '')")}, ' '), lambda w: w <> '') AS w FROM documents),
items AS (SELECT DISTINCT benchmark, item_id, {_norm("coalesce(text, '')")} AS normal FROM bench_item),
item_words AS (SELECT *, list_filter(string_split(normal, ' '), lambda x: x <> '') AS w FROM items)"""


def _runs(source: str, keys: str, n: int) -> str:
    return f"SELECT DISTINCT {keys}, array_to_string(w[i : i + {n - 1}], ' ') AS run FROM (SELECT {keys}, w, unnest(range(1, len(w) - {n - 2})) AS i FROM {source} WHERE len(w) >= {n})"


_HITS = f"""{_WORDS},
d13 AS ({_runs("docs", "doc_id", 13)}), d5 AS ({_runs("docs", "doc_id", 5)}),
i13 AS ({_runs("item_words", "benchmark, item_id", 13)}), i5 AS ({_runs("item_words", "benchmark, item_id", 5)}),
e AS (SELECT benchmark, item_id, doc_id, count(*) AS n FROM d13 JOIN i13 USING (run) GROUP BY ALL),
p AS (SELECT benchmark, item_id, doc_id, count(*) AS n FROM d5 JOIN i5 USING (run) GROUP BY ALL),
sizes AS (SELECT benchmark, item_id, count(*) AS runs FROM i5 GROUP BY ALL),
pairs AS (SELECT benchmark, item_id, doc_id, coalesce(e.n, 0) AS x, coalesce(p.n, 0) / runs AS c
  FROM e FULL JOIN p USING (benchmark, item_id, doc_id) JOIN sizes USING (benchmark, item_id)),
hits AS (SELECT benchmark, item_id, doc_id, CASE WHEN length(normal) > 120 THEN left(normal, 120) || '…' ELSE normal END AS item_snippet,
  x::BIGINT AS shared_exact_shingles, round(c, 6) AS containment, x > 0 AS exact, c >= 0.9 AS contained
  FROM pairs JOIN items USING (benchmark, item_id) WHERE x > 0 OR c >= 0.9)"""
_TRIMMED = "nullif(trim({}, ' '), '')"

_AROUND = _SPACE.removesuffix("+")
# Token by token: quotes count up to each one, and a space goes between two tokens unless one of them takes none there.
_PASSAGES = f"""
WITH lines AS (SELECT doc_id, n, regexp_replace(regexp_replace(line, '^{_AROUND}+', ''), '{_AROUND}+$', '') AS b FROM (
  SELECT doc_id, unnest(string_split_regex(text, '\\r?\\n')) AS line, generate_subscripts(string_split_regex(text, '\\r?\\n'), 1) AS n FROM documents WHERE text IS NOT NULL)),
inner_part AS (SELECT *, trim(CASE WHEN length(b) > 2 THEN substr(b, 2, length(b) - 2) ELSE '' END, ' ') AS i FROM lines WHERE b <> ''),
kinds AS (SELECT *, CASE WHEN NOT (b LIKE '=%' AND b LIKE '%=' AND i <> '') THEN 'body' WHEN (i LIKE '=%' AND i LIKE '%=') OR i LIKE '%;%' THEN 'section' ELSE 'title' END AS kind FROM inner_part),
kept AS (SELECT *, sum((kind = 'title')::INT) OVER (PARTITION BY doc_id ORDER BY n) AS article,
  replace(replace(replace(replace(replace(CASE WHEN kind = 'title' THEN trim(regexp_replace(b, '^=+|=+$', '', 'g'), ' ') ELSE b END, ' @-@ ', '-'), ' @,@ ', ','), ' @.@ ', '.'), ' -- ', '—'), ' / ', '/') AS raw FROM kinds WHERE kind <> 'section'),
tokens AS (SELECT doc_id, n, unnest(list_filter(string_split_regex(raw, '{_AROUND}+'), lambda x: x <> '')) AS x, generate_subscripts(list_filter(string_split_regex(raw, '{_AROUND}+'), lambda x: x <> ''), 1) AS i FROM kept),
sides AS (SELECT *, lag(x) OVER w AS before, lead(x) OVER w AS after, count_if(x = '"') OVER w % 2 = 1 AS opens FROM tokens WINDOW w AS (PARTITION BY doc_id, n ORDER BY i)),
hugs AS (SELECT *, x = ':' AND regexp_matches(before, '[0-9]$') AND regexp_matches(after, '^[0-9]') AS clock FROM sides),
marks AS (SELECT doc_id, n, i, CASE WHEN x IN ('``', '''''') THEN '"' ELSE x END AS x,
  CASE WHEN x = '"' THEN NOT opens ELSE x IN (',', '.', ';', ':', '!', '?', '%', ')', ']', '}}', '’', 'n''t', 'n’t') OR (length(x) > 1 AND x[1] IN ('''', '’')) END AS tight_left,
  CASE WHEN x = '"' THEN opens ELSE x IN ('``', '(', '[', '{{', '‘', '$', '£', '€', '¥') OR coalesce(clock, false) END AS tight_right FROM hugs),
glued AS (SELECT *, i = 1 OR tight_left OR coalesce(lag(tight_right) OVER (PARTITION BY doc_id, n ORDER BY i), false) AS glue FROM marks),
clean AS (SELECT doc_id, n, string_agg(CASE WHEN glue THEN x ELSE ' ' || x END, '' ORDER BY i) AS passage FROM glued GROUP BY ALL),
titles AS (SELECT doc_id, article, replace(passage, ' ', '_') AS base, row_number() OVER (PARTITION BY doc_id, replace(passage, ' ', '_') ORDER BY article) AS again FROM kept JOIN clean USING (doc_id, n) WHERE kind = 'title'),
body AS (SELECT doc_id, article, n, passage FROM kept JOIN clean USING (doc_id, n) WHERE kind = 'body' AND len(list_filter(string_split_regex(passage, '{_AROUND}+'), lambda x: x <> '')) >= 5)
SELECT doc_id, 'wikipedia://' || coalesce(base || CASE WHEN again > 1 THEN '-' || again ELSE '' END, '_unknown') || '#p' || row_number() OVER (PARTITION BY doc_id, article ORDER BY n) AS source_uri, passage
FROM body LEFT JOIN titles USING (doc_id, article)"""

ORACLES = {
    "corpus_words": f"WITH {_WORDS} SELECT count(*) AS documents, sum(len(w))::BIGINT AS words FROM docs",
    "normalized_text_hash": f"""SELECT doc_id, sha256({_norm("coalesce(text, '')")}) AS normal_sha256 FROM documents""",
    "shingle_counts": f"""WITH {_WORDS}
SELECT doc_id, len(w)::INT AS n_words, CASE WHEN len(w) >= 5 THEN len(w) - 4 WHEN len(w) > 0 THEN 1 ELSE 0 END::INT AS n_shingles,
  CASE WHEN len(w) >= 13 THEN len(list_distinct(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i : i + 12], ' ')))) ELSE 0 END::INT AS n_runs FROM docs""",
    "exact_dup_groups": "SELECT sha256(text) AS text_sha256, count(*) AS copies, min(doc_id) AS first_key FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1",
    "contamination_hits": f"WITH {_HITS} SELECT * FROM hits",
    "contamination_rates": f"""WITH {_HITS},
f AS (SELECT benchmark, item_id, bool_or(exact) AS exact, bool_or(contained) AS contained FROM hits GROUP BY ALL)
SELECT t.benchmark, t.items_total, coalesce(g.e, 0)::BIGINT AS flagged_exact, coalesce(g.c, 0)::BIGINT AS flagged_contained, coalesce(g.n, 0)::BIGINT AS flagged_any, round(coalesce(g.n, 0) / t.items_total, 6) AS contamination_rate
FROM (SELECT benchmark, count(DISTINCT item_id) AS items_total FROM bench_item GROUP BY 1) t
LEFT JOIN (SELECT benchmark, count_if(exact) AS e, count_if(contained) AS c, count(*) AS n FROM f GROUP BY 1) g USING (benchmark)""",
    "contamination_top": f"WITH {_HITS} SELECT benchmark, item_id, doc_id, containment FROM hits ORDER BY containment DESC, doc_id, benchmark, item_id LIMIT 10",
    "snippets": f"SELECT benchmark, item_id, CASE WHEN length(n) > 120 THEN left(n, 120) || '…' ELSE n END AS item_snippet FROM (SELECT *, {_norm('text')} AS n FROM bench_item)",
    "heading_kinds": """
WITH lines AS (SELECT trim(unnest(string_split(text, chr(10))), ' ') AS b FROM documents),
inner_part AS (SELECT *, trim(CASE WHEN length(b) > 2 THEN substr(b, 2, length(b) - 2) ELSE '' END, ' ') AS i FROM lines)
SELECT CASE WHEN NOT (b LIKE '=%' AND b LIKE '%=' AND i <> '') THEN 'body' WHEN (i LIKE '=%' AND i LIKE '%=') OR i LIKE '%;%' THEN 'section' ELSE 'title' END AS kind, count(*) AS lines
FROM inner_part WHERE b IS NOT NULL GROUP BY 1""",
    "article_passages": _PASSAGES,
    "rendered_rows": f"SELECT DISTINCT leaf_row, md5(concat_ws(chr(10) || chr(10), {_TRIMMED.format('title')}, {_TRIMMED.format('snippet')}, {_TRIMMED.format('url')}) || chr(10)) AS rendered_md5 FROM leaf",
    "secret_findings": "\nUNION ALL ".join(
        f"SELECT doc_id, line_no::INT AS line_no, '{name}' AS pattern, regexp_extract(line, '{p}') AS found FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents) WHERE regexp_matches(line, '{p}')"
        for name, p in t.SECRETS.items()
    ),
}
