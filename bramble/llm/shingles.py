"""Sets of hashed word shingles of whole texts, computed with numpy over the bytes of an Arrow slice."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from bramble.llm.common import worker_cache
from bramble.llm.token_files import mix

#: Powers that a worker keeps; longer tables, for longer slices, are made anew each time.
POWERS = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64."""
    kept = worker_cache("shingles")
    if "powers" not in kept or n >= POWERS:
        made = [np.multiply.accumulate(np.asarray([1] + [b] * max(POWERS - 1, n), dtype=np.uint64)) for b in (_BASE, _INVERSE)]
        if n >= POWERS:
            return made[0], made[1]
        kept["powers"] = made
    return kept["powers"][0], kept["powers"][1]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words of each text). A-Z is lower-cased; words are runs of bytes other than white space."""
    blob = pc.fill_null(texts.cast(pa.large_string()), "").cast(pa.large_binary())
    offsets = np.frombuffer(blob.buffers()[1], dtype=np.int64)[blob.offset : blob.offset + len(blob) + 1]
    raw = np.frombuffer(blob.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if blob.buffers()[2] is not None else np.zeros(0, dtype=np.uint8)
    offsets = offsets - offsets[0]
    low = raw + ((raw >= 65) & (raw <= 90)).astype(np.uint8) * np.uint8(32)
    word = ~((low == 32) | ((low >= 9) & (low <= 13)))
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    inner = offsets[:-1][offsets[:-1] < len(low)]
    begins[inner] |= word[inner]
    starts = np.flatnonzero(begins)
    ends_mask = word.copy()
    ends_mask[:-1] &= ~word[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    ends_mask[last] |= word[last]
    ends = np.flatnonzero(ends_mask) + 1
    up, down = _tables(len(low))
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[: len(low)], dtype=np.uint64)])
        hashes = mix((sums[ends] - sums[starts]) * down[starts] ^ (ends - starts).astype(np.uint64) * np.uint64(_BASE), 3)
    return hashes, np.diff(np.searchsorted(starts, offsets))


def low_hashes(hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The least hash of each text's pairs of neighbouring words (of its word, if it has one; 0 without words)."""
    pairs = hashes.copy()
    with np.errstate(over="ignore"):
        pairs[:-1] = mix(hashes[:-1] * np.uint64(_BASE) + hashes[1:], 5)
    ends = np.cumsum(n)
    inside = np.ones(len(pairs), dtype=bool)
    inside[(ends - 1)[n > 1]] = False  # the pair of a text's last word reaches into the next text
    pairs[~inside] = np.uint64(2**64 - 1)
    out = np.zeros(len(n), dtype=np.uint64)
    if len(pairs):
        out[n > 0] = np.minimum.reduceat(pairs, (ends - n)[n > 0])
    return out


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct hashes (uint64) of the k-word shingles of each text. A text of fewer words has one, of all its words;
    a text without words has none."""
    hashes, n = word_hashes(texts)
    with np.errstate(over="ignore"):
        grams = hashes
        for i in range(1, k):
            grams = mix(grams[: len(hashes) - i] * np.uint64(_BASE) + hashes[i:], 5) if len(hashes) > i else grams[:0]
        out, at = [], 0
        for words in n.tolist():
            if words >= k:
                out.append(np.unique(grams[at : at + words - k + 1]))
            elif words:
                one = np.uint64(words)
                for h in hashes[at : at + words]:
                    one = mix(np.asarray([one * np.uint64(_BASE) + h]), 11)[0]
                out.append(np.asarray([one]))
            else:
                out.append(np.zeros(0, dtype=np.uint64))
            at += words
    return out
