"""Hashes of words and of word shingles for whole batches of texts, in array operations.

Words are runs of ASCII letters and digits and of all non-ASCII characters, after lower-casing A-Z, so that changes of
punctuation and case do not count.
"""

from __future__ import annotations

import numpy as np

#: Words in a shingle.
WIDTH = 5
#: Bytes that are hashed at once.
CHUNK = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_SEPARATE = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, CHUNK + 1024)
        inverse = pow(_BASE, -1, 1 << 64)
        _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, _U), np.full(size - 1, b, _U)])) for b in (_BASE, inverse)]
    return _POWERS[0], _POWERS[1]


def _words_of(chunk: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start places of the words of a separated chunk."""
    letters = np.frombuffer(chunk, np.uint8)
    inside = np.empty(len(letters) + 2, bool)
    inside[0] = inside[-1] = False
    np.not_equal(letters, 0x20, out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    up, down = _powers(len(letters) + 1)
    sums = np.zeros(len(letters) + 1, _U)
    np.cumsum(letters.astype(_U) * up[:len(letters)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts]), starts


def separated(text: bytes) -> bytes:
    """The text in lower case with a space for every other character that belongs to no word."""
    return text.translate(_SEPARATE)


def word_places(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one text after the other; the bytes where they start if the texts are joined by one
    byte each; and the ``len(texts) + 1`` places among the words where texts begin."""
    joined = separated(b" ".join(texts))
    bounds = np.cumsum([0, *[len(t) + 1 for t in texts]])
    hashes, places, at = [], [], 0
    while at < len(joined):
        end = min(len(joined), at + CHUNK)
        if end < len(joined):
            space = joined.rfind(b" ", at, end)
            space = joined.find(b" ", end) if space < at else space
            end = len(joined) if space < 0 else space + 1
        found, starts = _words_of(joined[at:end])
        hashes.append(found)
        places.append(starts + at)
        at = end
    if not hashes:
        return np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    starts = np.concatenate(places)
    return np.concatenate(hashes), starts, np.searchsorted(starts, bounds).astype(np.int64)


def hash_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts and the places where texts begin."""
    words, _, offsets = word_places(texts)
    return words, offsets


_FACTORS = [0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F,
            0xEB44ACCAB455D165, 0x9C06FAF4D023E3AB, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9]


def grams(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words, across texts too."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, _U)
    total = words[:n] * _U(_FACTORS[0])
    for k in range(1, width):
        total += words[k:k + n] * _U(_FACTORS[k])
    return mix(total)


def text_shingles(texts: list[bytes], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts and the places where texts begin. A text of fewer words than ``width`` has one
    shingle of all its words; a text without words has none."""
    words, offsets = hash_words(texts)
    lengths = np.diff(offsets)
    counts = np.where(lengths >= width, lengths - width + 1, np.minimum(lengths, 1))
    begins = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(begins[-1], _U)
    every = grams(words, width)
    owner = np.repeat(np.arange(len(texts)), counts)
    place = np.arange(begins[-1]) - begins[owner] + offsets[owner]
    long = (lengths >= width)[owner]
    out[long] = every[place[long]]
    for t in np.flatnonzero((lengths > 0) & (lengths < width)):
        part = words[offsets[t]:offsets[t + 1]]
        out[begins[t]] = mix(np.add.reduce(part * np.array(_FACTORS[:len(part)], _U), keepdims=True) + _U(len(part)))[0]
    return out, begins


def shingle_sets(texts: list[bytes], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text in ascending order, how often each occurs, and the places where texts begin."""
    shingles, begins = text_shingles(texts, width)
    for a, b in zip(begins[:-1].tolist(), begins[1:].tolist()):
        shingles[a:b].sort()
    first = np.ones(len(shingles), bool)
    first[1:] = shingles[1:] != shingles[:-1]
    first[begins[:-1][begins[:-1] < len(shingles)]] = True
    places = np.flatnonzero(first)
    times = np.diff(np.append(places, len(shingles)))
    return shingles[places], times, np.searchsorted(places, begins).astype(np.int64)
