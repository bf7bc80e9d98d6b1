"""Words of many texts at once as 64-bit hashes, in numpy: no Python object for each word."""

from __future__ import annotations

import hashlib

import numpy as np

#: Words are runs of anything but these: space, tab, line feed, vertical tab, form feed, carriage return.
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Words longer than this are hashed one by one.
_LONG = 4_096
#: Seed and odd factor of each kind of hash.
_KINDS = ((np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)), (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)))
#: The lowest 0 to 8 bytes of a number.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def eights(data: bytes) -> np.ndarray:
    """The 8 bytes from each place on, as a number; zeros follow the end. A view, not a copy for each place."""
    return np.ndarray(len(data) + 1, "<u8", data + bytes(8), strides=(1,))


class Words:
    """The words of a list of texts: hashes, begin and end (bytes in `data`), and for each text its first word's index."""

    def __init__(self, texts: list[bytes]):
        self.joined = b" ".join([b"", *texts, b""])
        self.data = np.frombuffer(self.joined, np.uint8)
        space = _IS_SPACE[self.data]
        border = np.flatnonzero(space[1:] != space[:-1]) + 1
        self.begin, self.end = border[::2], border[1::2]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.text_begin = np.cumsum(np.concatenate([[1], sizes[:-1] + 1])) if texts else np.zeros(0, np.int64)
        self.text_end = self.text_begin + sizes
        self.first = np.searchsorted(self.begin, np.concatenate([self.text_begin, [len(self.data)]]))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, kind: int = 0) -> np.ndarray:
        """Words are mixed in 8 bytes at a time, after their size; the two kinds have nothing to do with each other."""
        seed, odd = _KINDS[kind]
        size, pieces = self.end - self.begin, eights(self.joined)
        out = mix((size.astype(np.uint64) + seed) * odd + (pieces[self.begin] & _LOW[np.minimum(size, 8)]))
        for i in np.flatnonzero(size > _LONG).tolist():
            out[i] = int.from_bytes(hashlib.blake2b(self.joined[self.begin[i] : self.end[i]], digest_size=8, person=str(kind).encode()).digest(), "little")
        more, done = np.flatnonzero((size > 8) & (size <= _LONG)), 8
        while len(more):
            out[more] = mix(out[more] * odd + (pieces[self.begin[more] + done] & _LOW[np.minimum(size[more] - done, 8)]))
            done += 8
            more = more[size[more] > done]
        return out


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values, sorted; by sorting, which for hashes is faster than numpy's hash table."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of `size` of the hashes."""
    n = max(0, len(hashes) - size + 1)
    code = np.zeros(n, np.uint64)
    for k in range(size):
        code = mix(code + hashes[k : k + n])
    return code


def runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """As windows(), with as many steps as size has binary digits: runs of 1, 2, 4 ... are joined."""
    power, width, code, held = hashes, 1, None, 0
    while True:
        if size & width:
            code = power if code is None else _joined(code, power[held:])
            held += width
        if held == size:
            return mix(code + np.uint64(size))
        power, width = _joined(power, power[width:]), 2 * width


def _joined(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    n = min(len(first), len(second))
    return mix(first[:n] * _KINDS[0][1] + second[:n])


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values between the borders `first`, which rise."""
    sums = np.concatenate([[0], np.cumsum(values)])
    return sums[first[1:]] - sums[first[:-1]]


def portions(texts: list[bytes], size: int = 500_000):
    """(begin, end) of runs of texts of about `size` bytes, so that numpy's arrays stay small; a longer text is alone."""
    begin = held = 0
    for i, text in enumerate(texts):
        if held and held + len(text) > size:
            yield begin, i
            begin, held = i, 0
        held += len(text) + 1
    if begin < len(texts):
        yield begin, len(texts)
