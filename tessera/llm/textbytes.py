"""Words, lines and strings of many texts at once, as hashes of their UTF-8 bytes in numpy.

Texts lie in one buffer, each followed by a line end, which no word or line crosses.
"""

from __future__ import annotations

import hashlib

import numpy as np

#: White space of words: space and the control characters from tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_SALT = 0x9E3779B97F4A7C15

#: Longer spans are hashed by blake2b, one by one; others eight bytes at a time, all spans together.
LONG = 256

#: By the bytes that are left of a span: the bits of an 8-byte number that belong to it.
_INSIDE = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads every bit over all."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def words_at(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as a little-endian number, zeros after the end; a view of one padded copy."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each span of bytes and its length: every 8 bytes go through a permutation that isn't linear in any ring, so no pattern of bytes cancels out."""
    size = end - start
    out = mixed(size.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(_SALT))
    words = words_at(data)
    live = np.flatnonzero((size > 0) & (size <= LONG))
    at, left = start[live], size[live]
    while len(live):
        h = out[live] * np.uint64(0x9FB21C651E98DF25)
        h ^= words[at] & _INSIDE[np.minimum(left, 8)]
        out[live] = mixed(h)
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for k in np.flatnonzero(size > LONG).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[start[k] : end[k]].tobytes(), digest_size=8).digest(), "little")
    return out


class Texts:
    """Texts of a batch: `data`, their bytes, and `start` and `end` of each. lower: with A-Z as a-z."""

    def __init__(self, texts: list[str], lower: bool = False):
        encoded = [t.encode("utf-8", "surrogatepass") for t in texts]
        self.n = len(encoded)
        self.data = np.frombuffer(b"\n".join([*encoded, b""]), np.uint8)
        if lower:
            self.data = LOWER[self.data]
        sizes = np.array([len(x) for x in encoded], np.int64)
        self.end = np.cumsum(sizes + 1) - 1
        self.start = self.end - sizes

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of all words, and how many each text has."""
        inside = ~SPACE[self.data]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edge = np.concatenate([[0], edge])
        start, end = edge[::2], edge[1::2]
        at = np.searchsorted(start, np.append(self.start, len(self.data)))
        return start, end, np.diff(at)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of all lines (an empty text has one), and the text of each."""
        end = np.flatnonzero(self.data == 0x0A)
        start = np.concatenate([[0], end[:-1] + 1])
        return start, end, np.searchsorted(self.end, end)


def owners(counts: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(counts)), counts)


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sum of each text's values."""
    total = np.concatenate([[0], np.cumsum(values)])
    end = np.cumsum(counts)
    return total[end] - total[end - counts]


def windows(hashes: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each run of `size` hashes within a text, and how many each text has; it has as its index that of its first hash."""
    n = np.maximum(counts - (size - 1), 0)
    first = np.repeat(np.cumsum(counts) - counts, n) + (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n))
    h = hashes[first]
    for k in range(1, size):
        h = mixed(h) + hashes[first + k]
    return mixed(h), n


def repeated(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs twice or more."""
    s = np.sort(keys)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    out = np.zeros(len(keys), bool)
    if len(twice):
        seen = np.zeros(1 << 20, bool)
        seen[twice >> np.uint64(44)] = True
        maybe = np.flatnonzero(seen[keys >> np.uint64(44)])
        at = np.minimum(np.searchsorted(twice, keys[maybe]), len(twice) - 1)
        out[maybe] = twice[at] == keys[maybe]
    return out


def owned(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Hashes that differ from text to text."""
    salt = mixed(np.arange(1, len(counts) + 1, dtype=np.uint64) * np.uint64(_SALT))
    return mixed(hashes ^ np.repeat(salt, counts))
