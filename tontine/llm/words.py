"""Hashes of the words of whole Arrow text columns, computed on the column's buffer."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tontine.llm.arrowtools import LOWER_ASCII, mix64

BASE = 0xC2B2AE3D27D4EB4F
LOWER = np.frombuffer(LOWER_ASCII, np.uint8)
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Bytes hashed at a time; some 40 times as much memory is in use meanwhile.
PIECE = 1 << 20
#: White space, controls and ASCII punctuation.
PUNCTUATION = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])


class WordHashes:
    """Words are what lies between separators: white space, with ``punctuation`` also ASCII punctuation and controls.

    A word's hash is a polynomial over its bytes (A-Z in lower case) modulo 2^64, taken from running sums over the
    column's buffer and mixed; nothing is computed word by word in Python.
    """

    def __init__(self, punctuation: bool = False) -> None:
        self.separators = PUNCTUATION if punctuation else SPACE
        self.powers = self.inverses = np.empty(0, np.uint64)

    def _grow(self, n: int) -> None:
        """Powers of an odd base and of its inverse, for positions up to ``n``."""
        if len(self.powers) < n:
            with np.errstate(over="ignore"):
                base = np.full(n, np.uint64(BASE), np.uint64)
                inverse = np.full(n, np.uint64(pow(BASE, -1, 1 << 64)), np.uint64)
                base[0] = inverse[0] = 1
                self.powers, self.inverses = np.multiply.accumulate(base), np.multiply.accumulate(inverse)

    def of(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words of the column in order, and the number of words before each row (one more entry)."""
        body = column.cast(pa.large_binary())
        if body.null_count:
            body = body.fill_null(b"")
        if not len(body):
            return np.empty(0, np.uint64), np.zeros(1, np.int64)
        offsets = np.frombuffer(body.buffers()[1], np.int64)[body.offset : body.offset + len(body) + 1]
        data = body.buffers()[2]
        first, last = int(offsets[0]), int(offsets[-1])
        text = np.frombuffer(data, np.uint8)[first:last] if data is not None else np.empty(0, np.uint8)
        bounds = offsets - first
        hashes, starts, first = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0
        while first < len(text):
            last = min(len(text), first + PIECE)
            while last < len(text) and not self.separators[text[last]]:  # pieces end at separators
                last += 1
            found, begins = self._piece(text[first:last], bounds[:-1] - first)
            hashes.append(found)
            starts.append(begins + first)
            first = last
        hashes, starts = np.concatenate(hashes), np.concatenate(starts)
        return hashes, np.searchsorted(starts, bounds)

    def _piece(self, text: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and first bytes of the words of a stretch of text; ``rows``: where rows begin, from its start."""
        text = LOWER[text]
        inside = ~self.separators[text]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        rows = rows[(rows >= 0) & (rows < len(text))]
        begins[rows] = inside[rows]
        ends = np.ones(len(text), bool)
        ends[:-1] = ~inside[1:] | begins[1:]
        starts, stops = np.flatnonzero(begins), np.flatnonzero(ends & inside)
        if not len(starts):
            return np.empty(0, np.uint64), starts
        self._grow(len(text))
        with np.errstate(over="ignore"):
            sums = np.cumsum((text.astype(np.uint64) + np.uint64(1)) * self.powers[: len(text)])
            before = np.where(starts > 0, sums[starts - 1], np.uint64(0))
            return mix64((sums[stops] - before) * self.inverses[starts]), starts
