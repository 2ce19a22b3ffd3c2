"""Words and word shingles of many texts at once, as numpy arrays of hashes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
# Bytes that separate words: white space, or all ASCII but digits and letters.
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False
SHINGLE = 5
CHUNK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = []
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93], np.uint64)


def small_batches(spark) -> None:
    """Let Python tasks get texts a few MB at a time; for the rest of the session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, CHUNK_BYTES + (CHUNK_BYTES >> 2))
        inverse = pow(_BASE, -1, 1 << 64)
        _POWERS[:] = [
            np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, base, np.uint64), dtype=np.uint64)])
            for base in (_BASE, inverse)
        ]
    return _POWERS[0], _POWERS[1]


def chunks(texts: Sequence[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """Lower-cased texts in groups of about a MB, each with the place of its first text."""
    first, group, size = 0, [], 0
    for i, text in enumerate(texts):
        data = (text or "").encode().translate(LOWER)
        group.append(data)
        size += len(data) + 1
        if size >= CHUNK_BYTES:
            yield first, group
            first, group, size = i + 1, [], 0
    if group:
        yield first, group


def prefix_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """H and the inverse powers: (H[j] - H[i]) * inverse[i] is the hash of data[i:j]."""
    powers, inverse = _powers(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=sums[1:])
    return sums, inverse


def words(group: Sequence[bytes], separators: np.ndarray = SPACES):
    """Hash, start and end byte of every word, and per text where its words begin.

    The bytes are counted over the texts joined by one space.
    """
    data = np.frombuffer(b" ".join(group) + b" ", np.uint8)
    gaps = separators[data]
    edges = np.flatnonzero(np.diff(np.concatenate([[True], gaps])))
    starts, ends = edges[0::2], edges[1::2]
    sums, inverse = prefix_hashes(data)
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts])
    text_starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in group])])
    return hashes, starts, ends, np.searchsorted(starts, text_starts)


def heads(group: Sequence[bytes], starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Hash of the first ``size`` bytes of every word."""
    data = np.frombuffer(b" ".join(group) + b" ", np.uint8)
    sums, inverse = prefix_hashes(data)
    return mix((sums[np.minimum(starts + size, ends)] - sums[starts]) * inverse[starts])


def shingles(hashes: np.ndarray, bounds: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words, and per text where its shingles begin.

    A text of fewer words has its whole sequence as the only one.
    """
    n = len(hashes)
    counts = np.diff(bounds)
    total = np.zeros(max(0, n - size + 1), np.uint64)
    for j in range(size):
        total += hashes[j : n - size + 1 + j] * _MIX[j % len(_MIX)] if n >= size else np.uint64(0)
    total = mix(total)
    made = np.where(counts >= size, counts - size + 1, (counts > 0).astype(counts.dtype))
    out_bounds = np.concatenate([[0], np.cumsum(made)])
    # Place of each shingle's first word.
    at = np.arange(out_bounds[-1]) + np.repeat(bounds[:-1] - out_bounds[:-1], made)
    short = np.flatnonzero((counts > 0) & (counts < size))
    out = np.zeros(out_bounds[-1], np.uint64)
    long = np.ones(out_bounds[-1], bool)
    long[out_bounds[short]] = False
    out[long] = total[at[long]]
    for i in short:
        own = hashes[bounds[i] : bounds[i + 1]] * _MIX[: counts[i]]
        value = own.sum(dtype=np.uint64, keepdims=True) + np.array([counts[i]], np.uint64)
        out[out_bounds[i]] = mix(mix(value))[0]
    return out, out_bounds
