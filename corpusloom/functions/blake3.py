"""BLAKE3 over many messages at once, from its public specification, and the sketches keyed with it.

A message of up to one block, the common case of a word shingle, is one compression; longer ones chain their blocks, and
messages of over one chunk form the tree.  All messages of a batch go through each compression round together.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.jvm import sketch_function

# Fixed values of the BLAKE3 specification.
IV = np.array([0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19], np.uint32)
PERMUTATION = [2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8]
CHUNK_START, CHUNK_END, PARENT, ROOT, KEYED_HASH = 1, 2, 4, 8, 16
BLOCK, CHUNK = 64, 1024
COLUMNS_AND_DIAGONALS = [(0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14)]
LANES = 4096
#: Prefix of the labels from which sketch keys are derived; a deployment that must reproduce another one's sketches passes its own.
LABEL = b"corpusloom"


def _compress(cv: np.ndarray, block: np.ndarray, counter: np.ndarray | int, length: np.ndarray | int, flags: np.ndarray | int) -> np.ndarray:
    """Chaining values [8, n] of blocks [16, n] (words first, so that every step is a contiguous sweep)."""
    n = block.shape[1]
    counter = np.asarray(counter, np.uint64)
    v = np.empty((16, n), np.uint32)
    v[:8] = cv if cv.ndim == 2 else cv[:, None]
    v[8:12] = IV[:4, None]
    v[12], v[13] = (counter & np.uint64(0xFFFFFFFF)).astype(np.uint32), (counter >> np.uint64(32)).astype(np.uint32)
    v[14], v[15] = length, flags
    rows, m = list(v), list(block)
    spare = np.empty(n, np.uint32)

    def mix(x: np.ndarray, y: np.ndarray, right: int) -> None:
        """x = (x ^ y) rotated to the right, in place."""
        x ^= y
        np.left_shift(x, np.uint32(32 - right), out=spare)
        x >>= np.uint32(right)
        x |= spare

    for turn in range(7):
        for k, (i, j, p, q) in enumerate(COLUMNS_AND_DIAGONALS):
            a, b, c, d = rows[i], rows[j], rows[p], rows[q]
            for word, far, near in ((m[2 * k], 16, 12), (m[2 * k + 1], 8, 7)):
                a += b
                a += word
                mix(d, a, far)
                c += d
                mix(b, c, near)
        if turn < 6:
            m = [m[x] for x in PERMUTATION]
    return v[:8] ^ v[8:]


def _block_words(blocks: Sequence[bytes]) -> np.ndarray:
    """Words [16, n] of blocks, padded with zeros."""
    raw = np.frombuffer(b"".join(m.ljust(BLOCK, b"\0") for m in blocks), "<u4")
    return np.ascontiguousarray(raw.reshape(len(blocks), 16).T)


class Chunks:
    """Messages of at most one chunk each, laid out once and hashed under any number of keys.

    They are ordered by their number of blocks, so that every step takes the next block of all messages that have one.
    """

    def __init__(self, messages: Sequence[bytes], counters: np.ndarray | None = None, root: bool = True) -> None:
        self.size, self.end = len(messages), CHUNK_END | ROOT * root
        sizes = np.array([len(m) for m in messages], np.int64)
        count = np.maximum(1, -(-sizes // BLOCK))
        order = np.argsort(-count, kind="stable")
        self.parts = []
        for at in range(0, len(order), LANES):
            part = order[at : at + LANES]
            live = [int((count[part] > b).sum()) for b in range(int(count[part[0]]))]
            words = [_block_words([messages[i][b * BLOCK : (b + 1) * BLOCK] for i in part[:n]]) for b, n in enumerate(live)]
            last = (sizes[part] - BLOCK * (count[part] - 1)).astype(np.uint32)
            self.parts.append((part, words, count[part], last, None if counters is None else counters[part]))

    def values(self, key: np.ndarray, base: int) -> np.ndarray:
        """Chaining value [8, n] of every message."""
        out = np.zeros((8, self.size), np.uint32)
        for part, steps, count, last, counters in self.parts:
            cv = np.repeat(key[:, None], len(part), 1)
            for b, words in enumerate(steps):
                n = words.shape[1]
                ends = count[:n] == b + 1
                flags = np.where(ends, base | CHUNK_START * (b == 0) | self.end, base | CHUNK_START * (b == 0)).astype(np.uint32)
                cv[:, :n] = _compress(cv[:, :n], words, 0 if counters is None else counters[:n], np.where(ends, last[:n], np.uint32(BLOCK)), flags)
            out[:, part] = cv
        return out


def _key(key: bytes | None) -> tuple[np.ndarray, int]:
    return (IV, 0) if key is None else (np.frombuffer(key, "<u4").astype(np.uint32), KEYED_HASH)


class Messages:
    """Messages of any length, laid out once and hashed under any number of keys."""

    def __init__(self, messages: Sequence[bytes]) -> None:
        self.size = len(messages)
        self.small = [i for i, m in enumerate(messages) if len(m) <= CHUNK]
        self.long = [i for i, m in enumerate(messages) if len(m) > CHUNK]
        self.short = Chunks([messages[i] for i in self.small])
        pieces = [[messages[i][a : a + CHUNK] for a in range(0, len(messages[i]), CHUNK)] for i in self.long]
        self.bounds = np.cumsum([0, *map(len, pieces)])
        self.pieces = Chunks([c for p in pieces for c in p], np.array([k for p in pieces for k in range(len(p))], np.uint64), root=False)

    def values(self, key: bytes | None = None) -> np.ndarray:
        """First eight words [8, n] of every digest."""
        words, base = _key(key)
        out = np.zeros((8, self.size), np.uint32)
        if self.small:
            out[:, self.small] = self.short.values(words, base)
        if not self.long:
            return out
        level = self.pieces.values(words, base)
        sizes, owner = np.diff(self.bounds), np.array(self.long)
        while len(sizes):  # one level of all trees at once; an odd node moves up as it is
            within = np.arange(level.shape[1]) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            last = np.repeat(sizes, sizes) - 1
            left = np.flatnonzero((within % 2 == 0) & (within < last))
            flags = np.where(last[left] == 1, base | PARENT | ROOT, base | PARENT).astype(np.uint32)
            level[:, left] = _compress(words, np.concatenate([level[:, left], level[:, left + 1]]), 0, BLOCK, flags)
            level, sizes = level[:, within % 2 == 0], (sizes + 1) // 2
            done = np.repeat(sizes == 1, sizes)
            out[:, owner[sizes == 1]] = level[:, done]
            level, owner, sizes = np.ascontiguousarray(level[:, ~done]), owner[sizes > 1], sizes[sizes > 1]
        return out


def hash_many(messages: Sequence[bytes], key: bytes | None = None) -> np.ndarray:
    """Digests, uint8 [n, 32]."""
    found = Messages(messages).values(key).T
    return np.ascontiguousarray(found.astype("<u4")).view(np.uint8).reshape(len(messages), 32)


def digest(message: bytes, key: bytes | None = None) -> bytes:
    return hash_many([message], key)[0].tobytes()


def first_u64(digests: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(digests[:, :8]).view("<u8").ravel().astype(np.uint64)


@functools.cache
def minhash_keys(label: bytes = LABEL, size: int = 128) -> list[bytes]:
    return [digest(label + b"-minhash-v1-perm-" + i.to_bytes(8, "little")) for i in range(size)]


@functools.cache
def sketch_keys(label: bytes = LABEL) -> bytes:
    """Keys of the 128 permutations, then that of SimHash."""
    return b"".join([*minhash_keys(label), digest(label + b"-simhash-v1")])


def word_shingles(w: list[str], n: int = 5) -> list[str]:
    if len(w) < n:
        return [" ".join(w)] if w else []
    return [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)]


def minhash_many(texts: Sequence[list[str]], label: bytes = LABEL, size: int = 128) -> np.ndarray:
    """Signatures uint64 [n, size] of word lists; no words give the greatest value everywhere."""
    sets = [sorted(set(word_shingles(w))) for w in texts]
    distinct = sorted({s for x in sets for s in x})
    number = {s: i for i, s in enumerate(distinct)}
    encoded = [s.encode() for s in distinct]
    laid_out = Messages(encoded)
    out = np.full((len(texts), size), np.uint64(0xFFFFFFFFFFFFFFFF))
    filled = [i for i, x in enumerate(sets) if x]
    if not filled:
        return out
    members = np.concatenate([[number[s] for s in sets[i]] for i in filled])
    bounds = np.concatenate([[0], np.cumsum([len(sets[i]) for i in filled])])[:-1]
    for k, key in enumerate(minhash_keys(label, size)):
        low = laid_out.values(key)
        values = low[0].astype(np.uint64) | (low[1].astype(np.uint64) << np.uint64(32))
        out[filled, k] = np.minimum.reduceat(values[members], bounds)
    return out


_MIX = np.random.default_rng(128).integers(1, 1 << 63, (2, 1024), np.uint64)


def minhash_fast(texts: Sequence[list[str]], size: int = 128) -> np.ndarray:
    """Signatures of the same estimator from one hash per shingle and universal permutations: about a hundredth of the work."""
    import xxhash

    a, b = _MIX[0, :size] * np.uint64(2) + np.uint64(1), _MIX[1, :size]
    out = np.full((len(texts), size), np.uint64(0xFFFFFFFFFFFFFFFF))
    for i, w in enumerate(texts):
        if w:
            x = np.fromiter((xxhash.xxh64_intdigest(s) for s in set(word_shingles(w))), np.uint64)
            for at in range(0, len(x), 4096):
                v = x[at : at + 4096, None] * a + b
                np.minimum(out[i], (v ^ (v >> np.uint64(31))).min(axis=0), out=out[i])
    return out


def simhash_many(texts: Sequence[list[str]], label: bytes = LABEL) -> np.ndarray:
    """64-bit SimHash of word lists: every shingle, repeats included, votes on every bit; a tie is 0, no words give 0."""
    lists = [word_shingles(w) for w in texts]
    distinct = sorted({s for x in lists for s in x})
    out = np.zeros(len(texts), np.uint64)
    if not distinct:
        return out
    number = {s: i for i, s in enumerate(distinct)}
    hashes = first_u64(hash_many([s.encode() for s in distinct], digest(label + b"-simhash-v1")))
    place = np.arange(64, dtype=np.uint64)
    for i, x in enumerate(lists):
        if x:
            h = hashes[[number[s] for s in x]]
            ones = ((h[:, None] >> place) & np.uint64(1)).sum(axis=0, dtype=np.int64)
            out[i] = ((2 * ones > len(x)).astype(np.uint64) << place).sum(dtype=np.uint64)
    return out


def with_digest(df: DataFrame, source: str, name: str = "document_id") -> DataFrame:
    """df with the 32-byte BLAKE3 digest of a text (its UTF-8 bytes) or binary column; null stays null."""
    kind = df.schema[source].dataType.simpleString()

    @F.arrow_udf("binary")
    def udf(values: pa.Array) -> pa.Array:
        found = [None if v is None else v.encode() if kind == "string" else bytes(v) for v in values.to_pylist()]
        known = [i for i, v in enumerate(found) if v is not None]
        out: list[bytes | None] = [None] * len(found)
        if known:
            for i, d in zip(known, hash_many([found[i] for i in known]), strict=True):
                out[i] = d.tobytes()
        return pa.array(out, pa.binary())

    return df.withColumn(name, udf(F.col(source)))


def with_sketches(df: DataFrame, normal: str, kernel: str = "blake3", label: bytes = LABEL, simhash: bool = False) -> DataFrame:
    """df with minhash array<bigint> (and simhash bigint) of a normalised text column; null counts as empty.

    kernel: blake3 keys every permutation; fast permutes one hash per shingle.  Values are the signed longs of the same bits.
    blake3 runs in the JVM (Sketch.java), on Spark Connect in NumPy.
    """
    function = sketch_function(df.sparkSession) if kernel == "blake3" else None
    if function is not None:  # the same values, without leaving the JVM
        text = F.coalesce(F.col(normal), F.lit("")).cast("binary")
        found = df.withColumn("_sketch", F.call_function(function, text, F.lit(sketch_keys(label))))
        return found.withColumns({"minhash": F.slice("_sketch", 1, 128)} | ({"simhash": F.element_at("_sketch", 129)} if simhash else {})).drop("_sketch")
    fields = "minhash array<bigint>" + (", simhash bigint" if simhash else "")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", " + fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 256):
                batch = whole.slice(first, 256)
                lists = [[w for w in (t or "").split(" ") if w] for t in batch.column(normal).to_pylist()]
                found = minhash_many(lists, label) if kernel == "blake3" else minhash_fast(lists)
                columns = [*batch.columns, pa.FixedSizeListArray.from_arrays(pa.array(found.view(np.int64).ravel()), found.shape[1]).cast(pa.list_(pa.int64()))]
                if simhash:
                    columns.append(pa.array(simhash_many(lists, label).view(np.int64)))
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "minhash", *["simhash"] * simhash])

    return df.mapInArrow(run, schema)


def fingerprints(df: DataFrame, text: str, kernel: str = "blake3", label: bytes = LABEL) -> DataFrame:
    """df with a column `fingerprint`: digests, NFC characters, MinHash and SimHash of the normalised text and the length of
    the original in bytes; null for a null text."""
    from corpusloom.functions.text import nfc, normalize_text

    base = df.withColumn("_nfc", nfc(F.col(text))).withColumn("_normal", normalize_text(F.col("_nfc"), compose=False))
    found = with_digest(with_sketches(base, "_normal", kernel, label, simhash=True), "_normal", "_blake3")
    bundle = F.struct(F.lower(F.hex("_blake3")).alias("blake3"), F.sha2("_normal", 256).alias("sha256"), F.octet_length(text).alias("byte_len"), F.length("_nfc").alias("nfc_char_count"), F.col("minhash"), F.col("simhash"))
    return found.withColumn("fingerprint", F.when(F.col(text).isNotNull(), bundle)).drop("_nfc", "_normal", "_blake3", "minhash", "simhash")
