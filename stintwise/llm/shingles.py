"""Word shingles of texts as 64-bit hashes, worked out for a whole batch of texts at a time."""

from collections.abc import Iterable

import numpy as np
import xxhash

WORDS = 5
MEMO = 200_000

_ODD = np.array(
    [xxhash.xxh64_intdigest(b"place", seed=k) | 1 for k in range(WORDS)], dtype=np.uint64
)


class WordHashes(dict):
    """Word to 64-bit hash. Emptied when full, which only costs time."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` with A-Z lowered; bytes methods touch ASCII only."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_sets(
    texts: Iterable[str | None], memo: WordHashes
) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ends): the sorted distinct shingle hashes of every text, one after another, and
    where each text's run ends. Texts of fewer than five words have one shingle, the whole
    sequence; texts without words none."""
    parts: list[int] = []
    lengths = []
    for text in texts:
        words = words_of(text)
        lengths.append(len(words))
        parts.extend(map(memo.__getitem__, words))
    n = np.array(lengths, dtype=np.int64)
    w = np.array(parts + [0] * WORDS, dtype=np.uint64)
    owner = np.repeat(np.arange(len(n)), n)
    left = np.repeat(np.cumsum(n), n) - np.arange(len(owner))  # words up to the text's end
    size = n[owner]
    first = (left >= WORDS) | ((left == size) & (size < WORDS))
    index = np.flatnonzero(first)
    held = np.minimum(size[index], WORDS)
    h = held.astype(np.uint64)
    for k in range(WORDS):
        h += w[index + k] * _ODD[k] * (k < held).astype(np.uint64)
    h = mix(h)
    own = owner[index]
    stops = np.cumsum(np.bincount(own, minlength=len(n)))
    at = 0
    for stop in stops.tolist():
        h[at:stop].sort()
        at = stop
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
    return h[keep], np.cumsum(np.bincount(own[keep], minlength=len(n)))


def min_hashes(h: np.ndarray, ends: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """`k` symbols of 16 bits for every text: the low bits of the least value under each of `k`
    keyed scrambles of its shingles. Texts without shingles get zeros."""
    sizes = np.diff(ends, prepend=0)
    full = np.flatnonzero(sizes)
    out = np.zeros((len(ends), k), dtype=np.uint16)
    if not len(full):
        return out
    starts = (ends - sizes)[full]
    keys = mix(np.arange(1, 2 * k + 1, dtype=np.uint64) + np.uint64(seed << 32))
    for i in range(k):
        v = (h ^ keys[2 * i]) * (keys[2 * i + 1] | np.uint64(1))
        v ^= v >> np.uint64(32)
        v *= np.uint64(0xD6E8FEB86659FD93)
        least = np.minimum.reduceat(v, starts)
        out[full, i] = (least ^ (least >> np.uint64(29))).astype(np.uint16)
    return out
