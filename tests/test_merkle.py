import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.functions.blake3 import digest
from corpusloom.operators import merkle as mk


def split_root(leaves):
    """Recursive definition: the left subtree holds the largest power of two below the number of leaves."""
    if not leaves:
        return hashlib.sha256(b"").digest()
    if len(leaves) == 1:
        return hashlib.sha256(b"\0" + leaves[0]).digest()
    k = 1 << (len(leaves) - 1).bit_length() - 1
    return hashlib.sha256(b"\1" + split_root(leaves[:k]) + split_root(leaves[k:])).digest()


@given(st.integers(1, 40), st.data())
@settings(max_examples=60, deadline=None)
def test_paths_round_trip(size, data):
    leaves = [bytes([i]) * 32 for i in range(size)]
    index = data.draw(st.integers(0, size - 1))
    root, path = mk.root_of(leaves, "sha256"), mk.path_of(leaves, index, "sha256")
    assert root == split_root(leaves)
    assert mk.verify_path(leaves[index], index, size, path, root, "sha256")
    assert not mk.verify_path(b"x" * 32, index, size, path, root, "sha256")
    assert not mk.verify_path(leaves[index], index, size, [*path, root], root, "sha256")


def test_empty():
    assert mk.root_of([]) == digest(b"")
    assert not mk.verify_path(b"", 0, 0, [], mk.root_of([]))


@pytest.mark.parametrize("size", [0, 1, 2, 3, 7, 8, 9, 16, 17, 33, 100])
def test_distributed_root_and_paths(spark, size):
    leaves = [bytes([i % 256, i // 256]) * 16 for i in range(size)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(leaves)], "position long, leaf binary")
    root = mk.merkle_root(df, "position", "leaf", "sha256", block_levels=3).first()
    assert (root.leaf_count, root.root) == (size, split_root(leaves).hex())
    if size:
        paths = {r.position: r.path for r in mk.audit_paths(mk.tree_levels(df, "position", "leaf", "sha256", block_levels=3), df).collect()}
        assert paths == {i: [x.hex() for x in mk.path_of(leaves, i, "sha256")] for i in range(size)}
