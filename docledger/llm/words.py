"""Words and n-grams of whole Arrow columns at once, as numpy arrays.

A text column is one byte buffer with offsets. Words are cut by a byte table (all
bytes of non-ASCII characters count alike) and hashed with a polynomial whose prefix
sums give every word's value in a few vector operations. Batches are worked through
in pieces, so memory follows the longest text, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once.
PIECE = 1 << 20
#: Rows that are copied at once.
ROWS = 256
_SMALL = 1 << 18


def _table(is_word) -> np.ndarray:
    return np.array([is_word(b) for b in range(256)])


#: Words `[^\\x20\\x09-\\x0D]+`.
BETWEEN_SPACES = _table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of text whose A-Z are lower-cased.
LETTERS_DIGITS = _table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_random = np.random.default_rng(20240607)
_VALUES = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_POWERS = np.cumprod(np.r_[np.uint64(1), np.full(_SMALL, _BASE, np.uint64)], dtype=np.uint64)
_INVERSES = np.cumprod(
    np.r_[np.uint64(1), np.full(_SMALL, pow(_BASE, -1, 2**64), np.uint64)], dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finalizer of a common generator)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def pieces(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, lower-cased bytes, offsets) of runs of rows; nulls are empty."""
    for at in range(0, len(column), ROWS):
        for row, data, offsets in _pieces(column.slice(at, ROWS)):
            yield at + row, data, offsets


def _pieces(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    column = pc.fill_null(column, "").cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int64)[
        column.offset: column.offset + len(column) + 1]
    data = column.buffers()[2]
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + PIECE, side="right")) - 1
        end = min(max(end, row + 1), len(column))
        lo, hi = int(offsets[row]), int(offsets[end])
        text = data[lo:hi].to_pybytes().translate(_LOWER) if hi > lo else b""
        yield row, np.frombuffer(text, np.uint8), offsets[row: end + 1] - lo
        row = end


def ranges(texts: list[str | None], chars: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of rows that together have so many characters, or of one row."""
    at = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text or "") > chars:
            yield at, i
            at, size = i, 0
        size += len(text or "")
    if at < len(texts):
        yield at, len(texts)


def lines_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of all lines of all rows, and of each row's first line among them.

    Lines end before a line feed; a row has one more line than line feeds.
    """
    breaks = np.flatnonzero(data == 10) + 1
    # A line feed belongs to its row, so one at a row's end opens its last, empty line.
    owner = np.searchsorted(offsets, breaks - 1, side="right") - 1
    starts = np.empty(len(breaks) + len(offsets) - 1, np.int64)
    firsts = np.arange(len(offsets) - 1) + np.searchsorted(owner, np.arange(len(offsets) - 1))
    is_first = np.zeros(len(starts), bool)
    is_first[firsts] = True
    starts[is_first] = offsets[:-1]
    starts[~is_first] = breaks
    return np.append(starts, offsets[-1]), np.append(firsts, len(starts))


def word_spans(
    data: np.ndarray, offsets: np.ndarray, table: np.ndarray,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): words of row i are first[i] to first[i + 1]."""
    inside = table[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    opens[edges] = inside[edges]
    closes[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        lo = starts[at]
        to = max(int(np.searchsorted(ends, lo + _SMALL, side="right")), at + 1)
        size = int(ends[to - 1] - lo)
        powers, inverses = _POWERS, _INVERSES
        if size > _SMALL:  # one word longer than the tables
            powers = np.cumprod(np.r_[np.uint64(1), np.full(size, _BASE, np.uint64)],
                                dtype=np.uint64)
            inverses = powers  # only the first is used: the word starts the piece
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(_VALUES[data[lo: lo + size]] * powers[:size], out=sums[1:])
        a, b = starts[at:to] - lo, ends[at:to] - lo
        out[at:to] = (sums[b] - sums[a]) * inverses[a]
        at = to
    return mixed(out)


def grams(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first) of all n-grams; a row of fewer words, but not none, is one gram."""
    n = np.diff(first)
    many = np.maximum(n - width + 1, np.minimum(n, 1))
    begins = np.concatenate([[0], np.cumsum(many)])
    rows = np.repeat(np.arange(len(n)), many)
    at = np.arange(begins[-1]) - begins[rows] + first[rows]
    out = np.full(len(at), width, np.uint64)
    whole = n[rows] >= width
    left = at if whole.all() else at[whole]
    gram = np.full(len(left), width, np.uint64)
    for j in range(width):
        gram = gram * np.uint64(_BASE) + hashes[left + j]
    out[whole] = gram
    for i in np.flatnonzero(~whole):
        short = int(n[rows[i]])
        value = short
        for h in hashes[at[i]: at[i] + short].tolist():
            value = (value * _BASE + h) % 2**64
        out[i] = value
    return mixed(out), begins


def distinct(values: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct values of each row."""
    return [np.unique(values[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
