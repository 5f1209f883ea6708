"""SQL of the queries that SQL can express: the visible form as a translation, groups by a recursive union."""

from __future__ import annotations

from corpusloom.llm.visible import ALL, LATIN_ONLY, SHORT, replacements

SPELLED_OUT = ("ﬁ", "ﬂ", "…")


def _visible(column: str, scope: str = ALL) -> str:
    """Characters without a counterpart in the second list are removed."""
    translated = [(a, b) for a, b in replacements(scope).items() if (ord(a) < 0x3100 or ord(a) >= 0xF900) and ord(a) < 0x10000 and len(b) <= 1 and a != "'"]
    kept, gone = [x for x in translated if x[1]], [x for x in translated if not x[1]]
    quoted = lambda chars: "'" + "".join(chars).replace("'", "''") + "'"
    text = f"replace(replace({column}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    for ch in SPELLED_OUT:
        text = f"replace({text}, '{ch}', '{replacements(scope)[ch]}')"
    return f"nfc_normalize(translate(nfc_normalize({text}), {quoted([a for a, _ in kept + gone])}, {quoted([b for _, b in kept])}))"


def _words(column: str) -> str:
    return f"regexp_extract_all(lower({_visible(column, LATIN_ONLY)}), '[\\p{{L}}\\p{{N}}]+')"


def _runs(source: str, keys: str, n: int) -> str:
    return f"SELECT DISTINCT {keys}, array_to_string(w[i : i + {n - 1}], ' ') AS run FROM (SELECT {keys}, w, unnest(range(1, len(w) - {n - 2})) AS i FROM {source} WHERE len(w) >= {n})"


def _forms(name: str, key: str, text: str) -> str:
    return f"SELECT DISTINCT '{name}' AS src, {key} AS k, {text} AS t, {_visible(text)} AS v FROM {name} WHERE {key} IS NOT NULL AND {text} IS NOT NULL"


_LEAKS = f"""d AS (SELECT doc_id, {_words("text")} AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT DISTINCT benchmark, item_id, {_words("text")} AS w FROM bench_item WHERE text IS NOT NULL),
d13 AS ({_runs("d", "doc_id", 13)}), d5 AS ({_runs("d", "doc_id", 5)}), b13 AS ({_runs("b", "benchmark, item_id", 13)}), b5 AS ({_runs("b", "benchmark, item_id", 5)}),
n AS (SELECT benchmark, item_id, count(*) AS n FROM b5 GROUP BY ALL), s AS (SELECT benchmark, item_id, doc_id, count(*) AS shared FROM b5 JOIN d5 USING (run) GROUP BY ALL),
leaks AS (SELECT DISTINCT benchmark, item_id, doc_id FROM b13 JOIN d13 USING (run) UNION SELECT benchmark, item_id, doc_id FROM s JOIN n USING (benchmark, item_id) WHERE 2 * shared >= n)"""

ORACLES = {
    "p1_found": f"""
WITH f AS ({_forms("leaf", "passage_id", "snippet")} UNION ALL {_forms("fineweb_row", "id", "text")})
SELECT DISTINCT a.src, a.k AS key_a, b.k AS key_b FROM f a JOIN f b ON a.src = b.src AND a.v = b.v AND a.k < b.k AND a.t <> b.t WHERE trim(a.v) <> ''""",
    "p1_classes": f"""
WITH f AS ({_forms("leaf", "passage_id", "snippet")} UNION ALL {_forms("fineweb_row", "id", "text")}),
c AS (SELECT src, v, min(k) AS class_id, count(*) AS n FROM f WHERE trim(v) <> '' GROUP BY ALL HAVING count(DISTINCT t) > 1),
s AS (SELECT src, v, t, count(*) AS same FROM f GROUP BY ALL)
SELECT src, f.k AS key, class_id, n - same AS n_links FROM f JOIN c USING (src, v) JOIN s USING (src, v, t)""",
    "p2_found": f"""
WITH RECURSIVE l AS (SELECT DISTINCT leaf_row, {_words("snippet")} AS w FROM leaf WHERE leaf_row IS NOT NULL AND snippet IS NOT NULL),
r AS ({_runs("l", "leaf_row", 5)}), n AS (SELECT leaf_row, count(*) AS n FROM r GROUP BY 1),
s AS (SELECT a.leaf_row AS a, b.leaf_row AS b, count(*) AS shared FROM r a JOIN r b USING (run) WHERE a.leaf_row <> b.leaf_row GROUP BY ALL),
e AS (SELECT a, b FROM s JOIN n x ON x.leaf_row = a JOIN n y ON y.leaf_row = b WHERE shared >= 0.7 * (x.n + y.n - shared)),
g AS (SELECT a, b FROM e UNION SELECT g.a, e.b FROM g JOIN e ON g.b = e.a)
SELECT DISTINCT a AS row_a, b AS row_b FROM g WHERE a < b""",
    "p2_groups": f"""
WITH RECURSIVE l AS (SELECT DISTINCT leaf_row, {_words("snippet")} AS w FROM leaf WHERE leaf_row IS NOT NULL AND snippet IS NOT NULL),
r AS ({_runs("l", "leaf_row", 5)}), m AS (SELECT leaf_row, md5(string_agg(run, '|' ORDER BY run)) AS k FROM r GROUP BY 1),
t AS (SELECT DISTINCT k, run FROM m JOIN r USING (leaf_row)), n AS (SELECT k, count(*) AS n FROM t GROUP BY 1),
s AS (SELECT a.k AS a, b.k AS b, count(*) AS shared FROM t a JOIN t b USING (run) WHERE a.k <> b.k GROUP BY ALL),
e AS (SELECT a, b FROM s JOIN n x ON x.k = a JOIN n y ON y.k = b WHERE shared >= 0.7 * (x.n + y.n - shared)),
g AS (SELECT k AS a, k AS b FROM n UNION SELECT g.a, e.b FROM g JOIN e ON g.b = e.a),
c AS (SELECT a AS k, min(leaf_row) AS class_id FROM g JOIN m ON m.k = g.b GROUP BY 1), d AS (SELECT a AS k, count(*) AS n_links FROM e GROUP BY 1)
SELECT leaf_row, class_id, coalesce(n_links, 0)::BIGINT AS n_links FROM m JOIN c USING (k) LEFT JOIN d USING (k)
QUALIFY count(*) OVER (PARTITION BY class_id) > 1""",
    "p5_found": f"WITH {_LEAKS} SELECT benchmark, item_id, doc_id FROM leaks",
    "p5_unreported": f"""WITH {_LEAKS} SELECT l.* FROM leaks l LEFT JOIN hit h ON h.benchmark = l.benchmark AND h.item_id = l.item_id AND TRY_CAST(regexp_extract(h.doc_id, '([0-9]+)$', 1) AS BIGINT) = l.doc_id
WHERE h.benchmark IS NULL""",
    "p5_leaks": f"""WITH {_LEAKS},
dp AS (SELECT doc_id, p, array_to_string(w[p : p + 4], ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS p FROM d WHERE len(w) >= 5)),
bp AS (SELECT benchmark, item_id, i, array_to_string(w[i : i + 4], ' ') AS run FROM (SELECT benchmark, item_id, w, unnest(range(1, len(w) - 3)) AS i FROM b WHERE len(w) >= 5)),
hits AS (SELECT benchmark, item_id, doc_id, p, p - i AS diagonal FROM leaks JOIN bp USING (benchmark, item_id) JOIN dp USING (doc_id, run)),
rows_of AS (SELECT benchmark, item_id, doc_id, diagonal, p - row_number() OVER (PARTITION BY benchmark, item_id, doc_id, diagonal ORDER BY p) AS island FROM hits),
longest AS (SELECT benchmark, item_id, doc_id, max(m) + 4 AS words_in_row FROM (SELECT benchmark, item_id, doc_id, count(*) AS m FROM rows_of GROUP BY benchmark, item_id, doc_id, diagonal, island) GROUP BY ALL)
SELECT benchmark, item_id, doc_id, words_in_row::INT AS words_in_row, round(shared / n, 6) AS share_of_runs FROM longest JOIN s USING (benchmark, item_id, doc_id) JOIN n USING (benchmark, item_id)""",
}
