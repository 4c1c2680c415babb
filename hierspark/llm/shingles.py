"""Word shingles of many texts at once, as 64-bit hashes."""

from __future__ import annotations

import numpy as np

BYTES = np.random.default_rng(20).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTES[ord("A") : ord("Z") + 1] = BYTES[ord("a") : ord("z") + 1]
BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
P, A, B, C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * A
    x = (x ^ (x >> np.uint64(27))) * B
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs of anything but blank, tab to carriage return; A-Z as a-z), and where each text's begin."""
    encoded = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(encoded) + b" ", dtype=np.uint8)
    ends = np.cumsum([len(e) + 1 for e in encoded])
    blank = BLANK[data]
    starts = np.flatnonzero(~blank & np.append(True, blank[:-1]))
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    spans = np.diff(np.append(starts, len(data)))
    local = np.arange(starts[0], len(data)) - np.repeat(starts, spans)
    values = np.where(blank, np.uint64(0), BYTES[data])[starts[0] :]
    powers = np.append(np.uint64(1), np.full(int(spans.max()) - 1, P, dtype=np.uint64)).cumprod(dtype=np.uint64)
    sums = np.add.reduceat(values * powers[local], starts - starts[0])
    return mix(sums), np.append(0, np.searchsorted(starts, ends)).astype(np.int64)


def shingle_sets(texts: list[str], width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the runs of ``width`` words of each text.

    A text of fewer words is one shingle as a whole; without words the set is empty.
    """
    words, begins = word_hashes(texts)
    if len(words) >= width:
        rolled = np.zeros(len(words) - width + 1, dtype=np.uint64)
        for k in range(width):
            rolled = mix(rolled * P + words[k : k + len(rolled)] + np.uint64(k + 1))
    else:
        rolled = np.zeros(0, np.uint64)
    sets = []
    for begin, end in zip(begins[:-1].tolist(), begins[1:].tolist()):
        n = end - begin
        if n >= width:
            sets.append(np.unique(rolled[begin : end - width + 1]))
        elif n:
            whole = np.zeros(1, dtype=np.uint64)
            for w in words[begin:end]:
                whole = mix(whole * P + w + C)
            sets.append(whole)
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def set_keys(found: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a set, as signed numbers."""
    first, second = mix(found + C).sum(dtype=np.uint64), mix(found ^ P).sum(dtype=np.uint64)
    return tuple(np.array([first, second], dtype=np.uint64).view(np.int64).tolist())


def parity_bits(found: np.ndarray, longs: int) -> np.ndarray:
    """Bit i says whether the number of elements with hash i is odd: two sets differ in no fewer elements than bits."""
    odd = np.bincount((mix(found) & np.uint64(64 * longs - 1)).astype(np.int64), minlength=64 * longs) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)
