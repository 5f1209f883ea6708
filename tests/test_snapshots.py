import datetime
import random

from pyspark.sql import functions as F

from corpusloom.operators.snapshots import snapshot_changes

SCHEMA = "snap int, at timestamp, k binary, n int, a string, s struct<x:boolean,y:string>, tags array<binary>, moving long, field string, value string"
T0 = datetime.datetime(2025, 1, 1)


def row(snap, minute, k, n, a, x=None, y=None, tags=None, moving=0):
    return (snap, T0 + datetime.timedelta(minutes=minute), k, n, a, (x, y), tags, moving, "clash", "clash")


def changes(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return {(r.snapshot, bytes(r.k), r.n): (r.change, list(r.fields)) for r in snapshot_changes(df, ("k", "n"), "snap", "at", ("moving",)).collect()}


def test_changes(spark):
    rows = [
        row(1, 0, b"a", 0, "x", moving=1), row(2, 0, b"a", 0, "x", moving=2), row(3, 0, b"a", 0, None, True),  # unchanged, then two fields
        row(1, 0, b"b", 0, "x"), row(3, 0, b"b", 0, "x"),  # removed, added
        row(1, 0, b"c", 0, "old"), row(1, 9, b"c", 0, "new"), row(2, 5, b"c", 0, "new"), row(2, 5, b"c", 0, "new"),  # the latest delivery counts
        row(2, 0, b"d", 1, "x"), row(2, 0, None, 1, "x"), row(2, 0, b"d", None, "x"),
        row(1, 0, b"e", 0, "x", tags=[b"1"]), row(2, 0, b"e", 0, "x", tags=None), row(3, 0, b"e", 0, "x", tags=[]),
    ]
    found = changes(spark, rows)
    assert found == {
        (3, b"a", 0): ("changed", ["a", "s.x"]), (2, b"b", 0): ("removed", []), (3, b"b", 0): ("added", []), (3, b"c", 0): ("removed", []), (2, b"d", 1): ("added", []), (3, b"d", 1): ("removed", []),
        (2, b"e", 0): ("changed", ["tags"]), (3, b"e", 0): ("changed", ["tags"]),
    }


def test_edges(spark):
    assert changes(spark, []) == {}
    assert changes(spark, [row(4, 0, b"a", 0, "x")]) == {}
    found = changes(spark, [row(1, 0, b"a", 0, "x"), row(4, 0, b"a", 0, "y" * 200_000)])  # 2 and 3 were never delivered
    assert found == {(4, b"a", 0): ("changed", ["a"])}


def test_maps(spark):
    rows = [(1, T0, 1, {"a": 1}), (2, T0, 1, {"a": 2}), (1, T0, 2, None), (2, T0, 2, None)]
    df = spark.createDataFrame(rows, "snap int, at timestamp, k int, m map<string,int>")
    assert [(r.k, r.change, list(r.fields)) for r in snapshot_changes(df, ("k",), "snap", "at").collect()] == [(1, "changed", ["m"])]


def test_against_brute_force_and_many_snapshots(spark):
    random.seed(3)
    rows, held = [], {}
    for snap in range(1, 12):
        for k in range(20):
            for _ in range(random.choice([0, 1, 1, 2])):
                minute, a = random.randrange(1000), random.choice(["p", "q", None])
                if held.get((snap, k), (-1,))[0] == minute:
                    continue
                rows.append(row(snap, minute, bytes([k]), 0, a))
                held[snap, k] = max(held.get((snap, k), (-1, None)), (minute, a), key=lambda x: x[0])
    wanted = {}
    for snap in range(2, 12):
        for k in range(20):
            old, new = held.get((snap - 1, k)), held.get((snap, k))
            if (old is None) != (new is None):
                wanted[snap, bytes([k]), 0] = ("added" if old is None else "removed", [])
            elif old and old[1] != new[1]:
                wanted[snap, bytes([k]), 0] = ("changed", ["a"])
    assert changes(spark, rows) == wanted


def test_one_key_holds_a_third(spark):
    hot = spark.range(3000).select(F.lit(1).alias("snap"), F.timestamp_seconds("id").alias("at"), F.lit(b"h").alias("k"), F.lit(0).alias("n"), F.col("id").cast("string").alias("a"))
    rest = spark.range(6000).select((F.col("id") % 2 + 1).cast("int").alias("snap"), F.timestamp_seconds("id").alias("at"), F.encode((F.col("id") % 3000).cast("string"), "UTF-8").alias("k"), F.lit(0).alias("n"), F.lit("x").alias("a"))
    last = spark.createDataFrame([(2, T0, b"h", 0, "2999")], "snap int, at timestamp, k binary, n int, a string")
    found = snapshot_changes(hot.unionByName(rest).unionByName(last), ("k", "n"), "snap", "at").groupBy("change").count().collect()
    assert {r.change: r["count"] for r in found} == {"added": 1500, "removed": 1500}
