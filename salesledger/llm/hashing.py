"""Words and shingles of many texts as arrays of 64-bit hashes, without a Python step per word.

A word is ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased. Every byte value has a random 64-bit weight, a word's
hash is the polynomial of the weights of its bytes, taken from one running sum over the buffer, and mixed. Two words
share a hash with a chance of about 2**-60.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CHUNK = 1 << 18
"""Bytes hashed at once; longer texts are cut at white space."""

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_rng = np.random.default_rng(20240229)
_WEIGHTS = _rng.integers(1, 1 << 63, 256, dtype=_U) | _U(1)
_STEPS = _rng.integers(1, 1 << 63, 64, dtype=_U) | _U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = []


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all others."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _scale(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, n at least."""
    if not _powers or len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            row = np.full(max(n, CHUNK + 4096), base, _U)
            row[0] = 1
            _powers[k : k + 1] = [np.multiply.accumulate(row)]
    return _powers[0], _powers[1]


def _hash_buffer(buffer: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word in the buffer."""
    raw = np.frombuffer(buffer, np.uint8)
    blank = np.ones(len(raw) + 2, bool)
    blank[1:-1] = _SPACE[raw]
    turn = np.flatnonzero(blank[1:] != blank[:-1])
    starts, ends = turn[::2], turn[1::2]
    up, down = _scale(len(raw) + 1)
    total = np.zeros(len(raw) + 1, _U)
    np.cumsum(_WEIGHTS[raw] * up[: len(raw)], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts]), starts


def _parts(text: bytes) -> Iterator[bytes]:
    """The text cut at white space into parts of about CHUNK bytes."""
    at = 0
    while len(text) - at > CHUNK:
        end = at + CHUNK
        while end < len(text) and not _SPACE[text[end]]:
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def word_hashes(texts: list[str | None]) -> Iterator[np.ndarray]:
    """Hashes of the words of each text, in order; an empty array for a missing text."""
    waiting: list[bytes] = []
    size = 0
    for text in texts:
        raw = (text or "").encode("utf-8", "surrogatepass").lower()
        if len(raw) > CHUNK:
            yield from _together(waiting)
            waiting, size = [], 0
            yield np.concatenate([_hash_buffer(part)[0] for part in _parts(raw)])
            continue
        if size + len(raw) > CHUNK:
            yield from _together(waiting)
            waiting, size = [], 0
        waiting.append(raw)
        size += len(raw) + 1
    yield from _together(waiting)


def _together(raws: list[bytes]) -> Iterator[np.ndarray]:
    if raws:
        hashes, starts = _hash_buffer(b" ".join(raws))
        bounds = np.cumsum([len(raw) + 1 for raw in raws])
        yield from np.split(hashes, np.searchsorted(starts, bounds[:-1]))


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k words, by its first word; empty if there are fewer words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    total = np.zeros(n, _U)
    for i in range(k):
        total += words[i : i + n] * _STEPS[i % 64] * _U(2 * (i // 64) + 1)
    return mixed(total)


def stretches(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the words of each stretch, of any length, from one running sum over the text."""
    up, down = _scale(len(words) + 1)
    total = np.zeros(len(words) + 1, _U)
    np.cumsum(words * up[: len(words)], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts])


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct k-word shingles; a shorter text is one shingle, a text without words has none."""
    if 0 < len(words) < k:
        short = np.concatenate([words, np.full(k - len(words), len(words), _U)])
        return windows(short, k)
    return np.unique(windows(words, k))
