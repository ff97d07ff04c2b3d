"""Whole texts as arrays of letters and word ends, for character n-grams in tasks."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np

CHUNK = 1 << 19  # characters handled at once in a task


@cache
def _letter_table() -> np.ndarray:
    return np.fromiter((unicodedata.category(chr(i))[0] == "L" for i in range(0x110000)), bool, 0x110000)


def chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``CHUNK`` characters."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points in lower case with one space around every word, and each one's text.

    Anything that is not a letter separates words.
    """
    low = [t.lower() + "\n" for t in texts]
    points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = _letter_table()[points]
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    text_of = np.repeat(np.arange(len(low), dtype=np.int32), [len(t) for t in low])[keep]
    body = np.where(is_letter, points, np.uint32(32))[keep]
    return np.concatenate([np.array([32], np.uint32), body]), np.concatenate([np.array([-1], np.int32), text_of])


def gram_buckets(points: np.ndarray, starts: np.ndarray, width: int, bits: int) -> np.ndarray:
    """Hash buckets of the n-grams of ``width`` points that begin at ``starts``."""
    h = np.full(len(starts), width, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            h = (h ^ points[starts + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return (h >> np.uint64(64 - bits)).astype(np.int64)
