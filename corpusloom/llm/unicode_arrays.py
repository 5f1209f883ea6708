"""Code points of Arrow string batches as NumPy arrays, without a Python object per character."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def utf8(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; nulls are empty."""
    strings = strings.cast(pa.large_string())
    offsets = np.frombuffer(strings.buffers()[1], np.int64, len(strings) + 1, strings.offset * 8)
    data = strings.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """(code points, byte position of each); the positions are None when every character is one byte."""
    if not (data & 0x80).any():
        return data, None
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at]
    points = lead.astype(np.uint32)
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    for low, high, mask, length in ((0xC0, 0xE0, 0x1F, 2), (0xE0, 0xF0, 0x0F, 3), (0xF0, 0x100, 0x07, 4)):
        where = np.flatnonzero((lead >= low) & (lead < high))
        if len(where):
            value = (lead[where] & mask).astype(np.uint32)
            for k in range(1, length):
                value = (value << 6) | (padded[at[where] + k] & 0x3F)
            points[where] = value
    return points, at


def slices(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Row ranges of about `most` bytes, so that one batch never needs memory in proportion to its whole size."""
    cuts, first = [], 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        cuts.append((first, last))
        first = last
    return cuts
