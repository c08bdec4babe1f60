"""Words of a text as 64-bit hashes, and windows of words, in whole-array steps.

A word is a run of bytes other than 0x20 and 0x09 to 0x0D of the UTF-8 text. Its
hash is a polynomial over its bytes modulo 2**64, mixed, so it depends on nothing
but the word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = 1 << 18
_MASK = (1 << 64) - 1


#: Bytes of one Arrow batch of texts: what Python workers hold at a time, besides arrays made of them.
BATCH = "4m"


def in_batches(docs: DataFrame) -> DataFrame:
    """`docs`, whose session from now on hands rows to Python in batches of at most BATCH, or of one row."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    return docs


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, _STEP + 1), _powers(pow(_BASE, -1, 1 << 64), _STEP + 1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(column: pa.Array) -> Iterator[np.ndarray]:
    """The bytes of each value of an Arrow string column, without copying; null is empty."""
    column = column.cast(pa.string()) if not pa.types.is_string(column.type) else column
    _, ends, data = column.buffers()
    at = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    raw = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    for a, z in zip(at[:-1], at[1:], strict=True):
        yield raw[a:z]


def bounds(data: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the words in a text's bytes: the runs of bytes that `space` doesn't mark."""
    word = np.empty(len(data) + 2, bool)
    word[0] = word[-1] = False
    np.logical_not(space[data], out=word[1:-1])
    edge = np.flatnonzero(word[1:] != word[:-1])
    return edge[::2], edge[1::2]


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    first, last = starts[0], ends[-1]
    sums = np.zeros(last - first + 1, np.uint64)
    np.cumsum((data[first:last].astype(np.uint64) + np.uint64(1)) * _UP[: last - first], out=sums[1:])
    return (sums[ends - first] - sums[starts - first]) * _DOWN[starts - first]


def _one(data: np.ndarray) -> int:
    total = 0
    for k in range(0, len(data), _STEP):
        part = data[k : k + _STEP]
        total += pow(_BASE, k, 1 << 64) * int(_hashes(part, np.array([0]), np.array([len(part)]))[0])
    return total & _MASK


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One hash a word; long texts are taken in steps, so memory beyond the text's is bounded."""
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        j = int(np.searchsorted(ends, starts[i] + _STEP, side="right"))
        if j > i:
            out[i:j] = _hashes(data, starts[i:j], ends[i:j])
            i = j
        else:
            out[i] = _one(data[starts[i] : ends[i]])
            i += 1
    return mix(out + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_WEIGHT = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def windows(words: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """One hash for each run of k words; none if there are fewer. k: at most 256."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.full(n, seed, np.uint64)
    for i in range(k):
        total += words[i : i + n] * _WEIGHT[i]
    return mix(total)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Distinct k-word shingles, ascending; the whole sequence as one if there are fewer words."""
    if not len(words):
        return np.empty(0, np.uint64)
    if len(words) < k:
        return windows(words, len(words), seed=len(words) + 1)
    return np.unique(windows(words, k))
