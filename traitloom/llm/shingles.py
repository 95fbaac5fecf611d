"""Word shingles of texts as sorted 64-bit hashes, computed for many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Words in a shingle.
WIDTH = 5

_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_PLACE = _RNG.integers(1, 1 << 63, WIDTH, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads all bits of each number."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, up to n."""
    if len(_POWERS.get("up", ())) <= n:
        size = max(1 << 16, 1 << (n + 1).bit_length())
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word (words hold no blank and are not empty)."""
    if not words:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(b" ".join(words) + b" ", np.uint8)
    up, down = powers(len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[:len(data)], dtype=np.uint64)])
    stop = np.flatnonzero(data == 32)
    start = np.concatenate([[0], stop[:-1] + 1])
    return mix((sums[stop] - sums[start]) * down[start])


def shingle_sets(texts: list[str], lower: bool = True) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text.

    Words are cut at ASCII white space, A-Z in lower case.  A text of fewer
    words than a shingle has gives one hash of them all, one without words none.
    """
    split = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]
    counts = np.array([len(w) for w in split])
    hashes = word_hashes([w for words in split for w in words])
    del split
    if len(hashes) >= WIDTH:
        joined = hashes[:len(hashes) - WIDTH + 1] * _PLACE[0]
        for j in range(1, WIDTH):
            joined = joined + hashes[j:len(hashes) - WIDTH + 1 + j] * _PLACE[j]
        joined = mix(joined)
    at = 0
    for n in counts:
        if n >= WIDTH:
            yield np.unique(joined[at:at + n - WIDTH + 1])
        elif n:
            yield mix((hashes[at:at + n] * _PLACE[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n))
        else:
            yield np.zeros(0, np.uint64)
        at += n
