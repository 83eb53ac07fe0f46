"""Words and n-grams of many texts at once, as 64-bit hashes in numpy arrays."""

from __future__ import annotations

import numpy as np

_rng = np.random.Generator(np.random.PCG64(7))
_byte = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_base = np.uint64(0x9E3779B97F4A7C15)
_inverse = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_coef = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: Bytes between words: the contract's white space, and all but letters, digits and non-ASCII.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
MARKS = np.ones(256, bool)
MARKS[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int):
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, b in enumerate((_base, _inverse)):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            _powers[k] = np.cumprod(x)
    return _powers[0][:n], _powers[1]


class Words:
    """The words of texts (bytes): hash, start and end in data, and first[d] .. first[d+1] of text d."""

    def __init__(self, texts: list[bytes], separators: np.ndarray = SPACE, lower: bool = False):
        joined = b"\n".join(texts)
        self.bytes = joined.translate(LOWER) if lower else joined
        data = np.frombuffer(self.bytes, np.uint8)
        edge = np.diff(np.concatenate([[True], separators[data], [True]]).astype(np.int8))
        self.start, self.end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        up, down = _power(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_byte[data] * up[: len(data)], out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.start]) * down[self.start]) if len(self.start) else np.empty(0, np.uint64)
        self.offset = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
        self.first = np.searchsorted(self.start, self.offset)

    def __len__(self) -> int:
        return len(self.start)

    def doc(self) -> np.ndarray:
        """The number of each word's text."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def grams(self, n: int) -> np.ndarray:
        """A hash of the n words from each word on; those that run past their text count too."""
        out = np.zeros(max(0, len(self) - n + 1), np.uint64)
        for k in range(n):
            out += self.hash[k : k + len(out)] * _coef[k]
        return mix(out)

    def room(self, n: int) -> np.ndarray:
        """Whether n words from each place of grams(n) on are of one text."""
        ends = np.repeat(self.first[1:], np.diff(self.first))
        return (np.arange(len(self)) + n <= ends)[: max(0, len(self) - n + 1)]


def batches(column, most: int = 1 << 18):
    """(first row, texts) of an Arrow binary column in parts of about `most` bytes."""
    texts, size, at = [], 0, 0
    for k in range(0, len(column), 64):
        for t in column.slice(k, 64).to_pylist():
            texts.append(t or b"")
            size += len(texts[-1])
            if size >= most:
                yield at, texts
                at, texts, size = at + len(texts), [], 0
    if texts:
        yield at, texts
