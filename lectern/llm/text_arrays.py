"""Whole batches of texts as arrays: bytes, words and 64-bit word hashes without a loop over words."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np

ODD = 0x9E3779B97F4A7C15
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """ODD**i and its inverse modulo 2**64, i < n; the table doubles as needed."""
    global _powers, _inverse
    while len(_powers) < n:
        k = len(_powers)
        _powers = np.concatenate((_powers, _powers * np.uint64(pow(ODD, k, 1 << 64))))
        _inverse = np.concatenate((_inverse, _inverse * np.uint64(pow(ODD, -k, 1 << 64))))
    return _powers, _inverse


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


@dataclass
class Block:
    """Texts joined by line ends. begin and end are words' places in raw, of their text's number."""

    raw: np.ndarray
    text_end: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    of: np.ndarray

    @property
    def texts(self) -> int:
        return len(self.text_end)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """The running sums of values over raw, one longer."""
        return np.concatenate((np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)))

    def hashes(self, lower: np.ndarray) -> np.ndarray:
        """A hash of each word's bytes: a polynomial in ODD, moved to the word's start."""
        p, inverse = powers(len(lower) + 1)
        s = self.sums((lower.astype(np.uint64) + np.uint64(1)) * p[: len(lower)])
        return mixed((s[self.end] - s[self.begin]) * inverse[self.begin])


def lowered(raw: np.ndarray) -> np.ndarray:
    """A-Z to a-z, on bytes."""
    return np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)


def blocks(texts: Sequence[str | None], word_byte: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, Block]]:
    """(number of the first text, Block) for runs of whole texts of about ``most`` bytes; word_byte says which
    of the 256 bytes belong to words."""
    at = 0
    while at < len(texts):
        parts, size, first = [], 0, at
        while at < len(texts) and (not parts or size < most):
            parts.append((texts[at] or "").encode("utf-8", "surrogatepass"))
            size += len(parts[-1]) + 1
            at += 1
        raw = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
        inside = word_byte[raw]
        inside[ends] = False
        edge = np.diff(np.concatenate((np.zeros(1, np.int8), inside.view(np.int8), np.zeros(1, np.int8))))
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        yield first, Block(raw, ends, begin, end, np.searchsorted(ends, begin))


NO_SPACE = np.ones(256, bool)
NO_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: Digits, letters and every byte of a character outside ASCII.
LETTERS = np.zeros(256, bool)
LETTERS[48:58] = LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True
