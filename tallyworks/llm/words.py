"""Words of a text and 64-bit hashes of words and word runs, vectorised over the bytes of the text.

A word is a run of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased. The hash of a word is a
polynomial over its bytes modulo 2^64, read off from prefix sums, then mixed. Two different words or
runs share a hash with probability about 2^-64, which the operators accept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

BLOCK = 1 << 16  # bytes hashed at once, so that the temporary arrays stay in the cache
LONG_WORD = 1 << 12  # longer words are hashed by blake2b

_space = bytes(int(i == 0x20 or 0x09 <= i <= 0x0D) for i in range(256))
_lower = bytes(i + 32 if 0x41 <= i <= 0x5A else i for i in range(256))
_BASE = 0x9E3779B97F4A7C15
_POWER = np.cumprod(np.full(BLOCK, _BASE, np.uint64))
_INVERSE = np.cumprod(np.full(BLOCK, pow(_BASE, -1, 2**64), np.uint64))
_JOIN = 0xD6E8FEB86659FD93  # odd; base of the polynomial over word hashes


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    out = values ^ (values >> np.uint64(30))
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(27)
    out *= np.uint64(0x94D049BB133111EB)
    out ^= out >> np.uint64(31)
    return out


def _blocks(data: bytes) -> Iterator[bytes]:
    """Pieces of at most BLOCK bytes that end at white space; a word longer than that is a piece of its own."""
    start, size = 0, len(data)
    while size - start > BLOCK:
        space = np.flatnonzero(np.frombuffer(data[start : start + BLOCK].translate(_space), np.int8))
        end = start + BLOCK
        if len(space):
            end = start + int(space[-1]) + 1
        else:
            while end < size and not len(space):
                space = np.flatnonzero(np.frombuffer(data[end : end + BLOCK].translate(_space), np.int8))
                end = end + int(space[0]) if len(space) else min(end + BLOCK, size)
        yield data[start:end]
        start = end
    if start < size:
        yield data[start:]


def bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which the words of a text begin and end."""
    space = np.ones(len(data) + 2, np.int8)
    space[1:-1] = np.frombuffer(data.translate(_space), np.int8)
    edges = np.flatnonzero(space[1:] != space[:-1])
    return edges[0::2], edges[1::2]


def word_hashes(data: bytes) -> np.ndarray:
    """One hash per word of the text, in order."""
    return word_hashes_and_tails(data)[0]


def word_hashes_and_tails(data: bytes, tails: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The same, and if asked for the last two bytes of every word as one number (one byte: the byte)."""
    found, last = [], []
    for piece in _blocks(data):
        starts, ends = bounds(piece)
        if not len(starts):
            continue
        piece = piece.translate(_lower)
        if tails:
            codes = np.frombuffer(piece, np.uint8).astype(np.uint32)
            before = np.where(ends - starts > 1, codes[ends - 2], 0)
            last.append(codes[ends - 1] + 256 * before)
        if len(piece) > BLOCK:
            found.append(np.array([_long_hash(piece)], np.uint64))
            continue
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(np.multiply(np.frombuffer(piece, np.uint8), _POWER[: len(piece)]), out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * _INVERSE[starts])
        if len(piece) > LONG_WORD:
            for i in np.flatnonzero(ends - starts > LONG_WORD):
                hashes[i] = _long_hash(piece[starts[i] : ends[i]])
        found.append(hashes)
    if len(found) == 1:
        return found[0], last[0] if tails else None
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    return np.concatenate(found), np.concatenate(last) if tails else None


def _long_hash(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word.strip(b" \t\n\v\f\r").lower(), digest_size=8).digest(), "little")


def rolling(words: np.ndarray, length: int) -> np.ndarray:
    """Unmixed hash of every run of ``length`` words, by doubling; nothing if there are fewer words."""
    if len(words) < length:
        return words[:0]
    if length == 1:
        return words
    half = length // 2
    left, rest = rolling(words, half), length - half
    right = left if rest == half else rolling(words, rest)
    n = len(words) - length + 1
    return left[:n] * np.uint64(pow(_JOIN, rest, 2**64)) + right[half : half + n]


def run_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of ``length`` words; the whole text if it has fewer words, nothing if none."""
    n = len(words)
    if 0 < n < length:
        return mix(rolling(words, n) + np.full(1, (_BASE * n) % 2**64, np.uint64))
    return mix(rolling(words, length))


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values (by sorting: np.unique hashes 64-bit integers, which is slower here)."""
    values = np.sort(values)
    if len(values) < 2:
        return values
    keep = np.empty(len(values), bool)
    keep[0] = True
    np.not_equal(values[1:], values[:-1], out=keep[1:])
    return values[keep]


def text_bytes(value: bytes | None) -> bytes:
    """Null texts are empty."""
    return value or b""
