"""Words of a text, and hashes of runs of consecutive words.

A word is a maximal run of Unicode letters and digits of the lower-cased text.
"""

from __future__ import annotations

import re

import numpy as np

WORD = re.compile(r"[^\W_]+")

#: Odd multipliers by which the hashes of the words of a run are mixed.  Fixed values.
_MIX = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93],
    dtype=np.uint64,
)
_SHIFT = np.uint64(29)


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


#: Characters of texts that are hashed at a time.
BLOCK_CHARS = 4_000_000
_BASE = 0x9FB21C651E98DF25  # odd
_TABLES: list[np.ndarray] = []
#: From here on no code point is a letter or digit.
LAST_POINT = 0x33480


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Which code points belong to words, and a random number for each of them."""
    if not _TABLES:
        points = np.arange(LAST_POINT + 1, dtype=np.uint64)
        _TABLES.append(np.array([chr(k).isalnum() for k in range(LAST_POINT)] + [False]))
        mixed = (points + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        _TABLES.append((mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB))
    return _TABLES[0], _TABLES[1]


def _powers(count: int) -> np.ndarray:
    out = np.full(max(1, count), _BASE, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _hash_block(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and how many words each text has."""
    # a line feed between texts ends a word and changes nothing in how they are lower-cased
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer("\n".join(lowered).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    is_word, number = _tables()
    codes = np.minimum(codes, LAST_POINT)
    inside = is_word[codes]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    ends = np.cumsum(np.array([len(t) + 1 for t in lowered]))
    counts = np.diff(np.searchsorted(first, ends), prepend=0)
    if not len(first):
        return np.empty(0, dtype=np.uint64), counts
    length = end - first
    at = np.flatnonzero(inside)
    starts = np.cumsum(length) - length
    place = np.arange(len(at)) - np.repeat(starts, length)
    hashed = np.add.reduceat(number[codes[at]] * _powers(int(length.max()))[place], starts)
    hashed ^= hashed >> np.uint64(32)
    return hashed * np.uint64(0xD6E8FEB86659FD93), counts


def _blocks(texts: list[str | None]) -> list[list[str]]:
    """The texts, in blocks of about BLOCK_CHARS."""
    out: list[list[str]] = [[]]
    held = 0
    for text in texts:
        if out[-1] and held + len(text or "") > BLOCK_CHARS:
            out.append([])
            held = 0
        out[-1].append(text or "")
        held += len(text or "")
    return [block for block in out if block]


def flat_hashes(texts: list[str | None]) -> list[tuple[list[str], np.ndarray, np.ndarray]]:
    """By blocks of texts: the texts, a 64-bit hash of each word of all of them, and their numbers of words."""
    return [(block, *_hash_block(block)) for block in _blocks(texts)]


def word_hashes(texts: list[str | None]) -> list[np.ndarray]:
    """A 64-bit hash of each word of each text, in order; worked off in blocks."""
    return [h for _, hashed, counts in flat_hashes(texts) for h in _cut(hashed, counts)]


def _cut(hashed: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    return np.split(hashed, np.cumsum(counts)[:-1])


def run_hashes(hashed: np.ndarray, length: int) -> np.ndarray:
    """A hash for each run of ``length`` consecutive words, in order."""
    count = len(hashed) - length + 1
    if count <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(count, dtype=np.uint64)
    for k in range(length):
        out = (out ^ hashed[k : k + count]) * _MIX[k % len(_MIX)]
        out ^= out >> _SHIFT
    return out


def run_sets(texts: list[str | None], length: int) -> list[np.ndarray]:
    """Sorted distinct run hashes of each text."""
    hashed = word_hashes(texts)
    if not hashed:
        return []
    counts = np.array([len(h) for h in hashed])
    # runs over the joined words; those that cross into the next text are cut off
    runs = run_hashes(np.concatenate(hashed), length)
    begins = np.cumsum(counts) - counts
    out = []
    for begin, count in zip(begins.tolist(), np.maximum(counts - length + 1, 0).tolist()):
        own = np.sort(runs[begin : begin + count])
        out.append(own[np.append(True, own[1:] != own[:-1])] if count else own)
    return out
