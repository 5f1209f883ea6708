"""Merkle roots and audit paths over ordered 32-byte leaves (RFC 6962 hashing, a lone right node moves up unchanged).

Aligned blocks of 2^BLOCK_LEVELS leaves are exact subtrees, so each is folded to one node in its own group; the nodes of
the blocks, a small fraction of the leaves, are folded the same way until one block is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.blake3 import hash_many
from corpusloom.session import cut

BLOCK_LEVELS = 12
Hash = Callable[[Sequence[bytes]], list[bytes]]


def _blake3(messages: Sequence[bytes]) -> list[bytes]:
    return [d.tobytes() for d in hash_many(messages)]


def _sha256(messages: Sequence[bytes]) -> list[bytes]:
    return [hashlib.sha256(m).digest() for m in messages]


HASHES: dict[str, Hash] = {"blake3": _blake3, "sha256": _sha256}


def leaf_hashes(leaves: Sequence[bytes], name: str = "blake3") -> list[bytes]:
    return HASHES[name]([b"\0" + x for x in leaves])


def fold(nodes: list[bytes], name: str = "blake3") -> list[list[bytes]]:
    """All levels from the given nodes up to one node."""
    levels = [nodes]
    while len(nodes) > 1:
        parents = HASHES[name]([b"\1" + a + b for a, b in zip(nodes[::2], nodes[1::2], strict=False)])
        nodes = parents + nodes[2 * len(parents) :]
        levels.append(nodes)
    return levels


def root_of(leaves: Sequence[bytes], name: str = "blake3") -> bytes:
    """Root of leaves held in memory; of none, the hash of nothing."""
    return fold(leaf_hashes(leaves, name), name)[-1][0] if leaves else HASHES[name]([b""])[0]


def path_of(leaves: Sequence[bytes], index: int, name: str = "blake3") -> list[bytes]:
    """Siblings from the deepest level up; a level on which the node moved up unchanged gives none."""
    path = []
    for level in fold(leaf_hashes(leaves, name), name)[:-1]:
        if (sibling := index ^ 1) < len(level):
            path.append(level[sibling])
        index >>= 1
    return path


def verify_path(leaf: bytes, index: int, size: int, path: Sequence[bytes], root: bytes, name: str = "blake3") -> bool:
    """Whether the path leads from the leaf at index, of size leaves, to the root, with no sibling missing or left over."""
    if not 0 <= index < size:
        return False
    node, rest = leaf_hashes([leaf], name)[0], list(path)
    while size > 1:
        if index ^ 1 < size:
            if not rest:
                return False
            sibling = rest.pop(0)
            node = HASHES[name]([b"\1" + (sibling + node if index & 1 else node + sibling)])[0]
        index, size = index >> 1, (size + 1) >> 1
    return not rest and node == root


def _fold_block(name: str, level: int, block_levels: int, first: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("position")
        start, hashes = int(pdf["position"].iloc[0]), list(map(bytes, pdf["hash"]))
        levels = fold(leaf_hashes(hashes, name) if first else hashes, name)
        rows = [(level + k, (start >> k) + i, h) for k, nodes in enumerate(levels) for i, h in enumerate(nodes) if first or k]
        # a block of one node still stands at every level that the full blocks reach
        rows += [(level + k, start >> k, levels[-1][0]) for k in range(len(levels), block_levels + 1)]
        return pd.DataFrame(rows, columns=["level", "position", "hash"])

    return run


def tree_levels(leaves: DataFrame, position: str, leaf: str, name: str = "blake3", block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """(level, position, hash): every node of the tree over the leaves, whose positions run from 0 without gaps.

    An empty input gives no rows.  Each pass folds all aligned blocks at once; the number of passes is the tree's height
    divided by block_levels.
    """
    size = leaves.count()
    level, parts = 0, []
    nodes = leaves.select(F.col(position).cast("long").alias("position"), F.col(leaf).alias("hash"))
    first = True
    while size:

        run = _fold_block(name, level, block_levels, first)
        blocks = nodes.withColumn("block", F.shiftright("position", block_levels))
        done = cut(blocks.groupBy("block").applyInPandas(run, "level int, position long, hash binary"))
        top = max(1, int(np.ceil(np.log2(size)))) if size > 1 else 0
        height = min(block_levels, top)
        parts.append(done.where(F.col("level") <= level + height))
        level, size, first = level + height, -(-size >> block_levels) if size > 1 << block_levels else 1, False
        if height < block_levels or size == 1:
            break
        nodes = done.where(F.col("level") == level).select("position", "hash")
    if not parts:
        return leaves.sparkSession.createDataFrame([], "level int, position long, hash binary")
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def merkle_root(leaves: DataFrame, position: str, leaf: str, name: str = "blake3", block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """One row (leaf_count, root) with the root in hex."""
    levels = tree_levels(leaves, position, leaf, name, block_levels)
    empty = HASHES[name]([b""])[0].hex()
    top = levels.agg(F.max(F.struct("level", "hash")).alias("top"), F.count_if(F.col("level") == 0).alias("leaf_count"))
    return top.select(F.col("leaf_count"), F.coalesce(F.lower(F.hex(F.col("top.hash"))), F.lit(empty)).alias("root"))


def audit_paths(levels: DataFrame, targets: DataFrame) -> DataFrame:
    """(position, path array<string>): siblings, deepest first, of many leaves in one pass over the stored levels."""
    height = levels.agg(F.max("level")).first()[0] or 0
    steps = targets.select("position").distinct().withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(max(0, height - 1)))))
    steps = steps.withColumn("sibling", F.expr("shiftright(position, level) ^ 1"))
    nodes = levels.select("level", F.col("position").alias("sibling"), "hash")
    found = steps.join(nodes, ["level", "sibling"]).groupBy("position").agg(F.sort_array(F.collect_list(F.struct("level", F.lower(F.hex("hash")).alias("hash")))).alias("p"))
    paths = found.select("position", F.transform("p", lambda x: x["hash"]).alias("path"))
    return targets.select("position").distinct().join(paths, "position", "left").withColumn("path", F.coalesce("path", F.array().cast("array<string>")))
