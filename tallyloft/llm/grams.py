"""Character n-grams of words for whole batches of texts, as hashed buckets in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from tallyloft.llm.common import code_points

CHUNK = 1 << 20  # characters handled at a time; a longer text is a chunk of its own


def letter_table() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def chunks(texts: list[str | None], most: int = CHUNK) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about ``most`` characters together, each with the place of its first."""
    at, part, size = 0, [], 0
    for i, t in enumerate(texts):
        t = t or ""
        if part and size + len(t) > most:
            yield at, part
            at, part, size = i, [], 0
        part.append(t)
        size += len(t) + 1
    if part:
        yield at, part


def stream(texts: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters of all texts in a row, 0 for all else, a 0 before and after each text; and where each text starts."""
    low = [t.lower() for t in texts]
    codes = code_points("\n" + "\n".join(low) + "\n")
    codes = np.where(letters[codes], codes, 0).astype(np.uint32)
    sizes = np.fromiter(map(len, low), np.int64, len(low)) + 1
    return codes, np.concatenate(([0], np.cumsum(sizes)[:-1]))


def buckets(codes: np.ndarray, n: int, bits: int) -> np.ndarray:
    """For each place the hashed n-gram that starts there; n - 1 places shorter than ``codes``."""
    h = codes[: len(codes) - n + 1].copy()
    for k in range(1, n):
        h *= np.uint32(0x01000193)
        h += codes[k : len(codes) - n + 1 + k]
    h += np.uint32(n * 0x3C6EF372 & 0xFFFFFFFF)
    h *= np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    return h >> np.uint32(32 - bits)


def inside(is_letter: np.ndarray, n: int) -> np.ndarray:
    """Whether the n-gram at each place lies in one word, with at most a word end at either side."""
    size = len(is_letter) - n + 1
    if n == 1:
        return is_letter
    if n == 2:
        return is_letter[:size] | is_letter[1:]
    ok = is_letter[1 : 1 + size].copy()
    for k in range(2, n - 1):
        ok &= is_letter[k : k + size]
    return ok
