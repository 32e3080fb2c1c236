"""Vectorised text kernels on code-point arrays.

Texts of one Arrow batch are laid end to end in one array of code points and every step
is a whole-array numpy operation; batches are cut so that one array holds at most
``BLOCK`` code points (a single longer text forms its own block).
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

BLOCK = 1 << 20
#: Odd multipliers of the polynomial hashes (fixed values).
CHAR_STEP = 0x9E3779B97F4A7C15
WORD_STEP = 0xD6E8FEB86659FD93
MASK = (1 << 64) - 1


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values (xor-shift and multiply)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@lru_cache(1)
def point_values() -> np.ndarray:
    """One 64-bit value for each code point."""
    return scramble(np.arange(1, sys.maxunicode + 2, dtype=np.uint64) * np.uint64(CHAR_STEP))


@lru_cache(1)
def word_points() -> np.ndarray:
    """True where a code point is a letter or a digit (Unicode categories L* and N*)."""
    return np.fromiter((unicodedata.category(chr(c))[0] in "LN" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


@lru_cache(2)
def powers(step: int, n: int) -> np.ndarray:
    """step**0 .. step**(n-1) modulo 2**64."""
    out = np.full(n, step, dtype=np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def blocks(texts: list[str], limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges [i, j) of texts whose lengths sum to at most ``limit`` (or one longer text)."""
    i, held = 0, 0
    for j, t in enumerate(texts):
        if j > i and held + len(t) > limit:
            yield i, j
            i, held = j, 0
        held += len(t)
    if i < len(texts):
        yield i, len(texts)


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, by doubling."""
    if len(a) < width:
        return a[:0]
    have, out = 1, a
    while have * 2 <= width:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    if rest := width - have:
        out = np.minimum(out[: len(out) - rest], out[rest:])
    return out


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hash of every run of k code points, joined from runs of doubling length."""
    if len(codes) < k:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        run, length = point_values()[codes], 1
        done, have, rest = None, 0, k
        while rest:
            if rest & 1:
                if done is None:
                    done, have = run, length
                else:
                    n = len(run) - have
                    done = done[:n] * np.uint64(pow(CHAR_STEP, length, 1 << 64)) + run[have : have + n]
                    have += length
            rest >>= 1
            if rest:
                run = run[: len(run) - length] * np.uint64(pow(CHAR_STEP, length, 1 << 64)) + run[length:]
                length *= 2
        return scramble(done)


_BROKEN = re.compile(r"(?<=[^\W_])[-‐][^\S\n]*\r?\n\s*(?=[^\W_])")
_UNSEEN = ("­", "​", "﻿", "⁠")


def readable(text: str) -> str:
    """Lower case, without unseen characters, words broken by a hyphen at a line end joined."""
    for ch in _UNSEEN:
        if ch in text:
            text = text.replace(ch, "")
    if "\n" in text:
        text = _BROKEN.sub("", text)
    return text.lower()


class Words:
    """The words of several texts: 64-bit value, owning text and place in the code points."""

    def __init__(self, texts: list[str]):
        parts = [readable(t) for t in texts]
        self.text = "\x00".join(parts)
        codes = points(self.text)
        inside = word_points()[codes]
        edge = np.diff(np.concatenate(([False], inside, [False])).view(np.int8))
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        lengths = np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))
        self.owner = np.searchsorted(np.cumsum(lengths), self.start, side="right")
        size = max(BLOCK * 2, 1 << int(len(codes) + 1).bit_length()) if len(codes) > BLOCK * 2 - 2 else BLOCK * 2
        with np.errstate(over="ignore"):
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(point_values()[codes] * powers(CHAR_STEP, size)[: len(codes)], dtype=np.uint64)))
            back = powers(pow(CHAR_STEP, -1, 1 << 64), size)
            self.value = scramble((total[self.end] - total[self.start]) * back[self.start])

    def word(self, i: int) -> str:
        return self.text[self.start[i] : self.end[i]]


def shingles(values: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n word values (runs over a text's end are masked by the caller)."""
    if len(values) < n:
        return np.empty(0, np.uint64)
    m = len(values) - n + 1
    with np.errstate(over="ignore"):
        out = np.zeros(m, np.uint64)
        for j in range(n):
            out = out * np.uint64(WORD_STEP) + values[j : j + m]
        return scramble(out)
