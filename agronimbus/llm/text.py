"""Words and their hashes, and batches in parts, shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Words of a shingle.
SHINGLE_WORDS = 5
#: Rows of a batch whose texts a worker holds as Python objects at a time.
TEXTS_AT_ONCE = 256
#: Odd multipliers that tell the places in a shingle apart.
_PLACES = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F],
    dtype=np.uint64,
)


def in_parts(
    change: Callable[[pa.RecordBatch], pa.RecordBatch], rows: int = TEXTS_AT_ONCE
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``change`` for mapInArrow, given a few rows of a batch at a time, in order.

    What it makes of the texts of a part is gone before the next part comes, so that a
    worker holds the batch that Spark sends and little else.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, rows):
                yield change(b.slice(i, rows))

    return run


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; bytes split at just these."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def hashes(found: list[bytes]) -> np.ndarray:
    """64-bit hash of each word."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), dtype=np.uint64, count=len(found))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over all bits (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles; a shorter text is one, no word none."""
    found = words(text)
    if not found:
        return np.empty(0, dtype=np.uint64)
    if len(found) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), seed=len(found))], dtype=np.uint64)
    h, n = hashes(found), len(found) - size + 1
    total = np.zeros(n, dtype=np.uint64)
    for j in range(size):
        total += mixed(h[j : j + n] + _PLACES[j % 5 : j % 5 + 1] * np.uint64(j + 1))
    return np.unique(mixed(total))
