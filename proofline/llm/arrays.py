"""Words and windows of a batch of texts as numpy arrays: no Python object is made for a word."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE, _WORD = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95  # odd, so that each has an inverse modulo 2**64
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**0..n-1 and their inverses, modulo 2**64."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = 1 << max(16, n - 1).bit_length()
        both = []
        for b in (base, pow(base, -1, 2**64)):
            row = np.full(size, b, np.uint64)
            row[0] = 1
            both.append(np.multiply.accumulate(row))
        _powers[base] = (both[0], both[1])
    up, down = _powers[base]
    return up[:n], down[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers whose bits all hang on all bits of x."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of some texts in a row: bytes, and for each word its place, its hash and its text; first[d] is d's first word."""

    buffer: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def fits(self, n: int) -> np.ndarray:
        """Whether the n words from each word on are of one text."""
        return np.arange(len(self.hash)) + n <= np.repeat(self.first[1:], np.diff(self.first))

    def joined(self, spans: list[tuple[int, int]]) -> bytes:
        """The words of the spans (begin, end), joined by one space."""
        return b" ".join(w for b, e in spans if e > b for w in self.buffer[self.start[b] : self.end[e - 1]].tobytes().split())


def split(texts: list[bytes], lower: bool = False) -> Words:
    """The maximal runs without ASCII blanks; with lower, A-Z count as a-z."""
    offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
    buffer = np.frombuffer(b"\n".join([*texts, b""]) or b"\n", np.uint8)
    if lower:
        buffer = _LOWER[buffer]
    blank = np.concatenate([[True], _BLANK[buffer]])
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    start, end = edge[0::2], edge[1::2]
    up, down = powers(_BYTE, len(buffer) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64)])
    hashed = mixed((sums[end] - sums[start]) * down[start])
    return Words(buffer, start, end, hashed, np.searchsorted(start, offsets).astype(np.int64))


def windows(hashed: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words from each word on; the last n - 1 have none of worth."""
    up, down = powers(_WORD, len(hashed) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashed * up[:-1], dtype=np.uint64)])
    upto = np.minimum(np.arange(len(hashed)) + n, len(hashed))
    return mixed((sums[upto] - sums[:-1]) * down[:-1])


def sliding(x: np.ndarray, n: int, least: bool) -> np.ndarray:
    """Least or largest of x[i : i + n], shorter at the end."""
    f, done, out = (np.minimum if least else np.maximum), 1, x.copy()
    while done < n:
        step = min(done, n - done)
        out[:-step] = f(out[:-step], out[step:]) if step < len(out) else out[:-step]
        done += step
    return out


def distinct(x: np.ndarray) -> np.ndarray:
    """The different values of x, sorted."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edge[0::2], edge[1::2]


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Flags of the places 0..n-1 in any of the spans."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, ends, -1)
    return np.cumsum(change[:-1]) > 0


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Equal ranges of the hashes; rises with the key."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's keys begin in sorted keys, and the end."""
    return np.searchsorted(bucket_of(keys, buckets), np.arange(buckets + 1, dtype=np.uint64))
