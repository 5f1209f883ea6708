"""Perceptual fingerprints of images over pixel arrays."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIDE, LOW = 32, 8


def grey(pixels: np.ndarray) -> np.ndarray:
    """Luminance of an RGB image [rows, columns, 3], or the image itself if it has one channel."""
    return pixels.astype(np.float64) if pixels.ndim == 2 else pixels[..., :3].astype(np.float64) @ np.array([0.299, 0.587, 0.114])


def shrink(image: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Mean of the area under every cell of a grid, cells cutting pixels in proportion."""

    def weights(n: int, cells: int) -> np.ndarray:
        edges = np.linspace(0, n, cells + 1)
        low, high = np.arange(n), np.arange(1, n + 1)
        cover = np.clip(np.minimum(edges[1:, None], high) - np.maximum(edges[:-1, None], low), 0, None)
        return cover / cover.sum(axis=1, keepdims=True)

    return weights(image.shape[0], rows) @ image @ weights(image.shape[1], columns).T


@functools.cache
def _cosines() -> np.ndarray:
    k, x = np.arange(LOW)[:, None], np.arange(SIDE)[None, :]
    return np.cos(np.pi * (2 * x + 1) * k / (2 * SIDE))


def _bits(cells: np.ndarray, pivot: float) -> int:
    return int("".join("1" if v > pivot else "0" for v in cells.ravel()), 2)


def phash(pixels: np.ndarray) -> int:
    """64 bits: which of the 8 x 8 lowest cosine terms of the 32 x 32 luminance lie above their median."""
    terms = _cosines() @ shrink(grey(pixels), SIDE, SIDE) @ _cosines().T
    return _bits(terms, float(np.median(terms)))


def blockhash(pixels: np.ndarray) -> int:
    """64 bits: which of 8 x 8 blocks are brighter than the median of their band of 16 blocks."""
    blocks = shrink(grey(pixels), LOW, LOW).reshape(4, 16)
    return int("".join("1" if v > m else "0" for row, m in zip(blocks, np.median(blocks, axis=1), strict=True) for v in row), 2)


@F.pandas_udf(T.StructType([T.StructField("phash", T.LongType()), T.StructField("blockhash", T.LongType())]))
def _hashes(images: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in images:
        rows = []
        for height, width, channels, data in zip(frame["height"], frame["width"], frame["nChannels"], frame["data"], strict=True):
            pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels)
            pixels = pixels[..., 0] if channels == 1 else pixels[..., 2::-1]
            rows.append([int(np.uint64(f(pixels)).astype(np.int64)) for f in (phash, blockhash)])
        yield pd.DataFrame(rows, columns=["phash", "blockhash"])


def image_hashes(image: Column) -> Column:
    """struct(phash, blockhash) of a column of Spark's image source (blue, green, red order)."""
    return _hashes(F.struct(image["height"].alias("height"), image["width"].alias("width"), image["nChannels"].alias("nChannels"), image["data"].alias("data")))
