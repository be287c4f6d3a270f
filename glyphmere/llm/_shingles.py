"""Hashed words and word shingles of many texts at once."""

from __future__ import annotations

import numpy as np
import xxhash

_ODD = np.uint64(0x9E3779B97F4A7C15)
_ALSO = np.uint64(0xD6E8FEB86659FD93)
SHINGLE = 5


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * _ALSO
    h = (h ^ h >> np.uint64(29)) * _ODD
    return h ^ h >> np.uint64(32)


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (ASCII letters lower-cased), one text after the other, and each text's number of words."""
    number: dict[bytes, int] = {}
    ids, lengths = [], np.zeros(len(texts), np.int64)
    for k, t in enumerate(texts):
        words = t.lower().split()
        lengths[k] = len(words)
        ids.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)))
    table = np.fromiter(map(xxhash.xxh3_64_intdigest, number), np.uint64, len(number))
    return (table[np.concatenate(ids)] if ids else np.zeros(0, np.uint64)), lengths


def shingles(words: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """Hash of the ``n`` words from each place on; the last n - 1 places wrap and mean nothing."""
    out = np.zeros(len(words), np.uint64)
    for k in range(n):
        out = (out ^ np.roll(words, -k)) * _ODD
        out ^= out >> np.uint64(31)
    return out


def shingle_sets(texts: list[bytes], n: int = SHINGLE) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, sorted. A text of fewer words has one shingle, of all its words; one without words none."""
    words, lengths = hashed_words(texts)
    every = shingles(words, n)
    out, at = [], 0
    for count in lengths:
        count = int(count)
        if count >= n:
            out.append(np.unique(every[at : at + count - n + 1]))
        elif count:
            h = np.array([count], np.uint64)
            for k in range(at, at + count):
                h = mixed(h ^ words[k : k + 1])
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
        at += count
    return out


def set_key(members: np.ndarray) -> int:
    """A signed 64-bit key of a set of hashes."""
    total = np.add.reduce(mixed(members), dtype=np.uint64, keepdims=True) ^ np.array([len(members)], np.uint64) * _ODD
    return int(mixed(total).view(np.int64)[0])
