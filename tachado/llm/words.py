"""Words of texts as 64-bit hashes, vectorised inside a task."""

from __future__ import annotations

import re

import numpy as np
import xxhash

#: Words whose hashes a task keeps; others are hashed each time.
KEPT = 250_000
P = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


class WordHashes(dict):
    """Hash of each word, kept for the words seen first."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < KEPT:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def split(text: str | None) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text: bytes are split at these characters and no others."""
    return (text or "").encode().split()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes that end words, as a pattern and as a table, and a number for each byte.
BLANK, BLANKS = re.compile(rb"[\x20\x09-\x0D]"), np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * P[2])
#: Bytes that are hashed at once.
CHUNK = 1 << 18


def _hashed(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of ``raw``, and where the word begins: a sum of its bytes' numbers, each times that of its place."""
    letters = np.frombuffer(raw, np.uint8)
    at = np.flatnonzero(~BLANKS[letters])
    first = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    if not len(first):
        return np.zeros(0, np.uint64), at
    sizes = np.diff(first, append=len(at))
    place = mixed((np.arange(sizes.max(), dtype=np.uint64) + np.uint64(1)) * P[3]) | np.uint64(1)
    within = np.arange(len(at)) - np.repeat(first, sizes)
    return mixed(np.add.reduceat(BYTES[letters[at]] * place[within], first)), at[first]


def lowered(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, A-Z lower-cased, one text after the other, and how many words each has."""
    out, counts, group, size = [], np.zeros(len(texts), np.int64), [], 0

    def flush() -> None:
        if group:
            hashes, begin = _hashed(b" ".join(x for _, x in group))
            out.append(hashes)
            ends = np.cumsum([len(x) + 1 for _, x in group])
            np.add.at(counts, [i for i, _ in group], np.diff(np.searchsorted(begin, ends), prepend=0))
            group.clear()

    for i, text in enumerate(texts):
        raw, at = (text or "").encode().lower(), 0  # bytes: A-Z only
        while at < len(raw):  # a long text goes in parts that end where a word does
            end = len(raw)
            if end - at > CHUNK:
                end = found.start() if (found := BLANK.search(raw, at + CHUNK)) else end
            group.append((i, raw[at:end]))
            size, at = size + end - at, end
            if size >= CHUNK:
                flush()
                size = 0
    flush()
    return np.concatenate(out) if out else np.zeros(0, np.uint64), counts


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values, sorted; for many small arrays."""
    x = np.sort(x)
    new = x[1:] != x[:-1]
    return x if new.all() else x[np.append(True, new)]


def windows(hashes: np.ndarray, size: int, base: np.uint64 = P[0]) -> np.ndarray:
    """A hash of each run of ``size`` words: a polynomial of their hashes modulo 2**64, scrambled."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, power, width = np.zeros(n, np.uint64), 0, hashes, 1
    factor, left = int(base), size
    while left:  # runs of 1, 2, 4, ... words; those whose length is in the binary form of size are laid side by side
        if left & 1:
            out = out * np.uint64(factor) + power[done:done + n]
            done += width
        left >>= 1
        if left:
            power = power[:len(power) - width] * np.uint64(factor) + power[width:]
            factor, width = factor * factor % (1 << 64), width * 2
    return mixed(out ^ np.uint64(size))
