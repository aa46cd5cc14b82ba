"""Vectorised hashing of bytes, words and word shingles with numpy.

Sums are taken modulo 2**64. A prefix array ``P`` of a text gives the hash of any of
its substrings in two subtractions and a product, so windows of every length come
from one pass.
"""

from __future__ import annotations

import hashlib

import numpy as np

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every input bit moves every output bit."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


class Roller:
    """Polynomial hashes of substrings; ``fold`` gives A-Z the values of a-z."""

    def __init__(self, seed: int, fold: bool = False):
        rng = np.random.default_rng(seed)
        self.values = rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
        if fold:
            self.values[65:91] = self.values[97:123]
        base = int(rng.integers(2**40, 2**62)) * 8 + 5
        self.base, self.inverse = base % 2**64, pow(base, -1, 2**64)
        self._up, self._down = np.ones(1, _U), np.ones(1, _U)

    def _powers(self, n: int) -> None:
        if len(self._up) < n:
            n = max(n, 2 * len(self._up))
            for name, b in (("_up", self.base), ("_down", self.inverse)):
                p = np.full(n, b, _U)
                p[0] = 1
                setattr(self, name, np.cumprod(p, dtype=_U))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self._powers(len(data) + 1)
        out = np.zeros(len(data) + 1, _U)
        np.cumsum(self.values[data] * self._up[: len(data)], out=out[1:])
        return out

    def span(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Unmixed hashes of ``[start, end)``."""
        return (prefix[end] - prefix[start]) * self._down[start]

    def windows(self, prefix: np.ndarray, length: int) -> np.ndarray:
        """Mixed hashes of all substrings of a length."""
        n = len(prefix) - length
        return mix((prefix[length:] - prefix[:n]) * self._down[:n]) if n > 0 else np.empty(0, _U)


_WHITE = np.zeros(256, bool)
_WHITE[[32, *range(9, 14)]] = True
#: Texts are hashed in blocks of about this many bytes, cut at white space.
BLOCK = 1 << 22
#: Words of more bytes are hashed one by one.
LONG_WORD = 256
_LOW = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)
_WORD = _U(0x8CB92BA72F3D8DD7)


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words: runs of bytes other than blank and 09-0D."""
    edge = np.diff(np.concatenate(([True], _WHITE[data], [True])).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def span_hashes(raw: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each span of bytes. Eight bytes at a time are mixed into the state, which is
    not linear in them, so no two families of words collide whatever the seed."""
    padded = np.frombuffer(raw + bytes(8), np.uint8)
    eights = np.ndarray(len(raw) + 1, np.dtype("<u8"), padded, strides=(1,))
    size = end - start
    out = mix(size.astype(_U) * _WORD + _U(1))
    rows = np.flatnonzero((size > 0) & (size <= LONG_WORD))
    at, left, state = start[rows], size[rows], out[rows]
    while len(rows):
        state = mix((state ^ (eights[at] & _LOW[np.minimum(left, 8)])) * _WORD + _U(1))
        out[rows] = state
        more = left > 8
        rows, at, left, state = rows[more], at[more] + 8, left[more] - 8, state[more]
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(raw[start[i] : end[i]], digest_size=8).digest(), "little")
    return out


def _hash_words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of bytes whose A-Z are lower-cased already."""
    start, end = word_spans(np.frombuffer(raw, np.uint8))
    return start, span_hashes(raw, start, end)


def word_hashes(text: bytes) -> np.ndarray:
    """A hash of each word, A-Z taken as a-z."""
    text = text.lower()  # of bytes: A-Z only
    if len(text) <= BLOCK:
        return _hash_words(text)[1]
    data, out, at = np.frombuffer(text, np.uint8), [], 0
    while at < len(text):
        stop = min(at + BLOCK, len(text))
        while stop < len(text):
            white = np.flatnonzero(_WHITE[data[stop : stop + BLOCK]])
            if len(white):
                stop += int(white[0])
                break
            stop = min(stop + BLOCK, len(text))
        out.append(_hash_words(text[at:stop])[1])
        at = stop
    return np.concatenate(out)


_COEFFICIENTS = np.random.default_rng(20_021).integers(1, 2**63, 64, dtype=np.uint64) * _U(2) + _U(1)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of ``size`` words; of fewer words, one for them all; of none, none."""
    n = len(words)
    if n == 0:
        return words
    width = min(size, n)
    out = np.full(n - width + 1, width, _U) * _U(0x9E3779B97F4A7C15)
    for i in range(width):
        out += words[i : n - width + 1 + i] * _COEFFICIENTS[i]
    return mix(out)


def shingle_set(text: bytes, size: int = 5) -> np.ndarray:
    """The distinct shingles of a text, sorted."""
    return np.unique(shingle_hashes(word_hashes(text), size))


#: Short texts are hashed together, this many bytes at a time.
TOGETHER = 1 << 18


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def shingle_sets(texts: list[bytes], size: int = 5) -> list[np.ndarray]:
    """The distinct shingles of each text, sorted."""
    out: list[np.ndarray] = []
    i = 0
    while i < len(texts):
        j, total = i + 1, len(texts[i])
        while j < len(texts) and total + len(texts[j]) < TOGETHER:
            total += len(texts[j])
            j += 1
        if j == i + 1:
            out.append(shingle_set(texts[i], size))
        else:
            part = texts[i:j]
            start, words = _hash_words(b"\n".join(part).lower())
            first = np.searchsorted(start, np.concatenate(([0], np.cumsum([len(t) + 1 for t in part]))))
            whole = shingle_hashes(words, size) if len(words) >= size else words[:0]
            for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
                out.append(_distinct(whole[a : b - size + 1]) if b - a >= size else shingle_hashes(words[a:b], size))
        i = j
    return out


def bitmap(features: np.ndarray, each: int = 8, most: int = 20) -> bytes:
    """A bit for the trailing part of each feature, at least ``each`` bits a feature up to ``2**most``."""
    k = min(max(6, int(each * len(features) - 1).bit_length() if len(features) else 6), most)
    bits = np.zeros(1 << k, bool)
    bits[(features & _U((1 << k) - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Rows of bitmaps, as 64-bit words, brought to the size of smaller ones."""
    return np.bitwise_or.reduce(bits.reshape(len(bits), -1, words), axis=1)
