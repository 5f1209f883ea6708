import itertools
import random

import pytest

from corpusloom.operators import contamination as c
from corpusloom.operators import dedup as d
from corpusloom.operators import pairs
from corpusloom.operators.components import connected_components

NEAR = [f"w{i}" for i in range(120)]
DOCS = [
    ("near-a", " ".join(NEAR)), ("near-b", " ".join(NEAR[:58] + ["x", "y", "z"] + NEAR[61:])), ("exact-a", " ".join(f"w{i}" for i in range(500, 540))),
    ("exact-b", " ".join(f"w{i}" for i in range(500, 540))), ("unique-a", " ".join(f"w{i}" for i in range(1000, 1030))), ("unique-b", " ".join(f"w{i}" for i in range(2000, 2030))),
]


@pytest.mark.parametrize("kernel", ["blake3", "fast"])
def test_dedup(spark, kernel):
    docs = spark.createDataFrame(DOCS, "id string, text string")
    found = d.dedup(docs, "id", "text", kernel=kernel)
    assert {tuple(r) for r in found.collect()} == {("near-a", "near-a", 2), ("near-b", "near-a", 2), ("exact-a", "exact-a", 2), ("exact-b", "exact-a", 2)}
    assert tuple(d.dedup_summary(docs, found).first()) == (6, 4, 0.666667, 2, 2)
    assert [tuple(r) for r in d.size_histogram(found).collect()] == [(2, 2)]


def test_dedup_edges(spark):
    schema = "id string, text string, size int, cluster_id int"
    docs = spark.createDataFrame([("a", None, 1, 1), ("b", "", 2, 2), ("c", "  ", 3, 3), ("d", "one two", 4, 4)], schema)
    assert {r.id for r in d.dedup(docs, "id", "text", kernel="fast").collect()} == {"a", "b", "c"}
    assert d.dedup(docs.where("false"), "id", "text", kernel="fast").count() == 0
    assert tuple(d.dedup_summary(docs.where("false"), d.dedup(docs.where("false"), "id", "text", kernel="fast")).first()) == (0, 0, 0.0, 0, 0)
    with pytest.raises(ValueError):
        d.dedup(docs, "id", "text", threshold=1.5)


Q1 = "natalia sold clips to 48 of her friends in april and then she sold half as many clips in may how many clips did natalia sell altogether in april and may"
A1 = "which property of a mineral can be determined simply by looking at a fresh unweathered sample under ordinary daylight conditions"
FILL = " ".join(f"filler{i}" for i in range(400))


def test_contamination(spark):
    items = spark.createDataFrame([("gsm8k", "q1", Q1), ("gsm8k", "q2", "a robe takes two bolts of blue fiber and half that much white fiber how many bolts in total does it take to make the robe"), ("arc", "a1", A1), ("arc", "tiny", "one two")], "benchmark string, item_id string, text string")
    docs = spark.createDataFrame([("verbatim", Q1.upper()), ("embedded", f"{FILL} {Q1} {FILL}"), ("clean", "the weather in lisbon was mild"), ("arc-hit", A1), ("null", None)], "doc_id string, text string")
    hits = c.contamination(docs, items, kernel="blake3")
    found = {(r.benchmark, r.item_id, r.doc_id): (r.exact, r.near, r.contained, r.shared_exact_shingles, r.containment) for r in hits.collect()}
    assert found == {("arc", "a1", "arc-hit"): (True, True, True, 8, 1.0), ("gsm8k", "q1", "embedded"): (True, False, True, 19, 1.0), ("gsm8k", "q1", "verbatim"): (True, True, True, 19, 1.0)}
    rates = {r.benchmark: (r.items_total, r.flagged_any, r.contamination_rate) for r in c.contamination_rates(items, hits).collect()}
    assert rates == {"arc": (2, 1, 0.5), "gsm8k": (2, 1, 0.5)}
    assert c.contamination(docs.where("false"), items, None).count() == 0 and c.contamination(docs, items.where("false"), None).count() == 0
    assert tuple(c.corpus_words(docs.where("doc_id = 'clean' or doc_id = 'null'")).first()) == (2, 6)


def test_connected_components(spark):
    random.seed(4)
    edges = [(random.randrange(200), random.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)] + [(500, 500), (None, 3), (300, 301)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    found = {r.vertex: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_same_rows_for_any_partitioning(spark):
    docs = spark.createDataFrame(DOCS * 2, "id string, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    for n in ("1", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.append(sorted(map(tuple, d.dedup(docs, "id", "text", kernel="fast").collect())))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert all(a == b for a, b in itertools.pairwise(seen))


def test_full_rates_and_top(spark, tmp_path):
    """An item flagged by the near signal alone counts; equal containments are ordered by similarity, not by document."""
    from corpusloom.plans.text_queries import QUERIES

    first, second = [f"a{i}" for i in range(14)], [f"b{i}" for i in range(20)]
    docs = [(1, " ".join(second + [f"c{i}" for i in range(60)])), (2, " ".join(second)), (3, " ".join(first[:12]))]
    docs += [(4, "quite another text than any of the items")]
    items = [("x", "near", " ".join(first)), ("x", "whole", " ".join(second)), ("y", "clean", "six words that nobody ever wrote")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "benchmark string, item_id string, text string").write.parquet(str(tmp_path / "bench_item.parquet"))
    runs = lambda x: {tuple(x.split()[i : i + 5]) for i in range(len(x.split()) - 4)}
    jaccard = {(i, d): len(runs(x) & runs(y)) / len(runs(x) | runs(y)) for _, i, x in items for d, y in docs}
    assert jaccard["near", 3] == 0.8 and jaccard["whole", 2] == 1
    rates = {r.benchmark: r for r in QUERIES["contamination_rates_full"](spark, str(tmp_path)).collect()}
    hits = {(r.item_id, r.doc_id): r for r in QUERIES["contamination_full"](spark, str(tmp_path)).collect()}
    near = {k for k, r in hits.items() if r.near}
    assert near == {("near", 3), ("whole", 2)} and not (hits["near", 3].exact or hits["near", 3].contained)
    x, y = rates["x"], rates["y"]
    assert (x.items_total, x.flagged_exact, x.flagged_near, x.flagged_contained, x.flagged_any, x.contamination_rate) == (2, 1, 2, 1, 2, 1.0)
    assert (y.items_total, y.flagged_any, y.contamination_rate) == (1, 0, 0.0)
    top = [(r.item_id, r.doc_id) for r in QUERIES["contamination_top_full"](spark, str(tmp_path)).collect()]
    assert top == [("whole", 2), ("whole", 1), ("near", 3)]


def test_pairs_within(spark):
    rows = [("hot", i) for i in range(90)] + [("two", 1), ("two", 2), ("one", 7)]
    members = spark.createDataFrame(rows, "g string, k long").withColumn("x", pairs.F.col("k") % 3)
    wanted = {(g, a, b, a % 3, b % 3) for g, a in rows for h, b in rows if g == h and a < b}
    for size in (1000, 20):
        found = [tuple(r) for r in pairs.pairs_within(members, "g", "k", ("x",), size).select("g", "k_a", "k_b", "x_a", "x_b").collect()]
        assert len(found) == len(wanted) and set(found) == wanted
    assert pairs.pairs_within(members.where("false"), "g", "k").count() == 0
