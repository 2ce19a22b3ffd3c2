"""Windows of texts that are found again wherever their bytes occur."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

from docflow.llm import words


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of ``width`` values, by doubling."""
    out, done = values, 1
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[: len(out) - step], out[step:])
        done += step
    return out


def groups(texts: Sequence[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """Texts as bytes, unchanged, in groups of about a MB."""
    first, group, size = 0, [], 0
    for i, text in enumerate(texts):
        data = (text or "").encode()
        group.append(data)
        size += len(data)
        if size >= words.CHUNK_BYTES:
            yield first, group
            first, group, size = i + 1, [], 0
    if group:
        yield first, group


def windows(group: Sequence[bytes], length: int, anchor: int):
    """Strings of ``length`` bytes by the anchor they hold.

    The anchor of a string is the ``anchor``-byte piece of it with the least
    hash, the first of equals, so equal strings have equal anchors at the same
    place. Neighbouring strings of one anchor are a window. Gives per window:
    number of its text, first start, number of starts, hash of the anchor, and
    hash of all its bytes and its place.
    """
    data = np.frombuffer(b"".join(group), np.uint8)
    sizes = np.array([len(t) for t in group], np.int64)
    ends = np.cumsum(sizes)
    sums, inverse = words.prefix_hashes(data)
    n = len(data) - length + 1
    empty = np.zeros(0, np.int64)
    if n < 1:
        return empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    pieces = words.mix((sums[anchor:] - sums[:-anchor]) * inverse[: len(sums) - anchor])
    width = length - anchor + 1
    # Place of the first least piece: hash in the high bits, place in the low ones.
    bits = np.uint64(max(1, int(len(data)).bit_length()))
    mask = (np.uint64(1) << bits) - np.uint64(1)
    order = (pieces & ~mask) | np.arange(len(pieces), dtype=np.uint64)
    place = (sliding_minimum(order, width) & mask).astype(np.int64)
    starts = np.arange(n)
    text = np.repeat(np.arange(len(group)), sizes)[:n]
    whole = starts + length <= ends[text]
    # A window ends where the anchor or the text changes.
    new = np.ones(n, bool)
    new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1]) | ~whole[:-1]
    new &= whole
    first = np.flatnonzero(new)
    group_of = np.cumsum(new) - 1
    counts = np.bincount(group_of[whole], minlength=len(first))
    last = first + counts - 1 + length
    bytes_hash = (sums[last] - sums[first]) * inverse[first]
    context = words.mix(bytes_hash ^ words.mix((counts * 64 + place[first] - first).astype(np.uint64)))
    own = text[first]
    return own, first - (ends - sizes)[own], counts, pieces[place[first]], context
