"""Words, and runs of words, of a batch of texts as arrays of 64-bit hashes, without a Python object per word."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Code points that are hashed at once, so that a batch, or one long text, never needs memory in proportion to its size.
PIECE = 1 << 20
SEPARATOR = "\0"
_PLACES = np.random.default_rng(13).integers(1, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def in_slices(batches: Iterator[pa.RecordBatch], column: int = 1, most: int = 4 * PIECE) -> Iterator[pa.RecordBatch]:
    """The batches in slices that hold `most` bytes of a text column each, or one longer text."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, first = np.cumsum(sizes), 0
        while first < len(sizes):
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + most, "right")))
            yield batch.slice(first, last - first)
            first = last


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.cache
def _powers(n: int) -> np.ndarray:
    powers = np.full(n, _BASE)
    powers[0] = np.uint64(1)
    return np.cumprod(powers)


def _word_hashes(cp: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first character, hash) of every run of characters that are inside a word."""
    edge = np.diff(inside.astype(np.int8), prepend=0)
    starts = np.flatnonzero(edge == 1)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    at = np.flatnonzero(inside)
    sizes = np.append(np.flatnonzero(edge == -1), len(cp))[: len(starts)] - starts
    place = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    values = (cp[at].astype(np.uint64) + np.uint64(1)) * _powers(1 << int(sizes.max()).bit_length())[place]
    return starts, mix(np.add.reduceat(values, np.cumsum(sizes) - sizes))


def _pieces(cp: np.ndarray, inside: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of about PIECE characters that cut no word."""
    out, first = [], 0
    while first < len(cp):
        last = min(first + PIECE, len(cp))
        if last < len(cp) and inside[last - 1]:
            outside = np.flatnonzero(~inside[last:])
            last = last + int(outside[0]) if len(outside) else len(cp)
        out.append((first, last))
        first = last
    return out


def word_hashes(texts: Sequence[str], change: Callable[[str], str], kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every word of the changed texts, in order.

    kinds tells which code points are in words (the separator never is).  Equal words have equal hashes.
    """
    owners, hashes = [], []
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last]) <= PIECE):
            size += len(texts[last]) + 1
            last += 1
        joined = SEPARATOR.join([changed.replace(SEPARATOR, "\1") if SEPARATOR in (changed := change(t)) else changed for t in texts[first:last]])
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = kinds[cp]
        inside[cp == 0] = False
        ends = np.flatnonzero(cp == 0)
        for a, z in _pieces(cp, inside):
            at, found = _word_hashes(cp[a:z], inside[a:z])
            owners.append(first + np.searchsorted(ends, at + a))
            hashes.append(found)
        first = last
    return np.concatenate(owners or [np.zeros(0, np.int64)]), np.concatenate(hashes or [np.zeros(0, np.uint64)])


def run_starts(owner: np.ndarray, n: int) -> np.ndarray:
    """The words that open a run of n words within one text."""
    return np.flatnonzero(owner[: len(owner) - n + 1] == owner[n - 1 :]) if len(owner) >= n else np.zeros(0, np.int64)


def run_hashes(hashes: np.ndarray, at: np.ndarray, n: int, second: bool = False) -> np.ndarray:
    """Hashes of the runs of n words that open at the given words; second: other ones, to tell apart what shares a hash."""
    total = np.full(len(at), np.uint64(n))
    for k in range(n):
        total += hashes[at + k] * _PLACES[k + 32 * second]
    return mix(total)


def runs_of(owner: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of every run of n words that lies within one text."""
    at = run_starts(owner, n)
    return at, run_hashes(hashes, at, n)


def first_of_each(owner: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Places of the distinct (owner, value), in their order."""
    order = np.lexsort((values, owner))
    a, b = owner[order], values[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order[new]
