"""Pairs of the members of classes, where they are wanted one by one and a class may hold any share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import counted, cut

#: Members of a block, on average: a class is cut into as many as it takes, and each two of them are paired on their own.
BLOCK_MEMBERS = 1000


def pairs_within(members: DataFrame, group: str, key: str, keep: tuple[str, ...] = (), block_members: int = BLOCK_MEMBERS) -> DataFrame:
    """(group, <key>_a, <key>_b, and of `keep` both <name>_a and <name>_b): every two members of a group, key_a < key_b.

    members should be distinct and cheap to read again (checkpointed).  Small groups are joined on the group; a large one
    is cut into blocks by a hash of the key, and every two blocks meet in a task of their own.
    """
    sizes = members.groupBy(group).agg(F.count("*").alias("_n")).where(F.col("_n") > block_members)
    large = counted(cut(sizes.select(group, F.ceil(F.col("_n") / block_members).cast("int").alias("_blocks"))))
    salted = members.join(large, group, "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    salted = salted.withColumn("_own", F.pmod(F.xxhash64(key), F.col("_blocks")).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    named = lambda end: [F.col(c).alias(f"{c}_{end}") for c in (key, *keep)]
    a = salted.select(group, F.col("_own").alias("_i"), F.col("_other").alias("_j"), *named("a"))
    b = salted.select(group, F.col("_other").alias("_i"), F.col("_own").alias("_j"), *named("b"))
    return a.join(b, [group, "_i", "_j"]).where(F.col(f"{key}_a") < F.col(f"{key}_b")).drop("_i", "_j")
