"""The vectorised word cutter against regular expressions."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from docledger.llm import words

ALPHABET = ["a", "B", "é", "ß", " ", "\n", "\t", "-", "7", "日本", "\r\n", "  ", "x" * 40, "\x00", "\x7f"]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile("[^\\x20\\x09-\\x0D]+")
CODES = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")


def texts(seed: int) -> list[str | None]:
    r = random.Random(seed)
    rows = ["".join(r.choices(ALPHABET, k=r.randint(0, 30))) for _ in range(60)]
    return [None, "", *rows, "y" * 300_000 + " z", "", None]


@pytest.mark.parametrize("seed", range(5))
@pytest.mark.parametrize("table, pattern", [
    (words.BETWEEN_SPACES, SPACED), (words.LETTERS_DIGITS, CODES)])
def test_words_equal_those_of_the_pattern(monkeypatch, seed, table, pattern):
    monkeypatch.setattr(words, "PIECE", 500)
    rows = texts(seed)
    hashed: dict[int, str] = {}
    for row, data, offsets in words.pieces(pa.array(rows)):
        starts, ends, first = words.word_spans(data, offsets, table)
        codes = words.word_hashes(data, starts, ends)
        for i in range(len(offsets) - 1):
            own = [data[s:e].tobytes().decode() for s, e in zip(
                starts[first[i]:first[i + 1]], ends[first[i]:first[i + 1]])]
            assert own == pattern.findall((rows[row + i] or "").translate(LOWER))
            for word, code in zip(own, codes[first[i]:first[i + 1]].tolist()):
                assert hashed.setdefault(code, word) == word
    assert len(set(hashed.values())) == len(hashed)


@pytest.mark.parametrize("seed", range(5))
def test_lines_equal_a_split(monkeypatch, seed):
    monkeypatch.setattr(words, "PIECE", 300)
    rows = texts(seed) + ["\n", "\n\n", "a\n", "\na"]
    for row, data, offsets in words.pieces(pa.array(rows)):
        lines, firsts = words.lines_of(data, offsets)
        for i in range(len(offsets) - 1):
            own = [data[lines[k]:lines[k + 1]].tobytes().decode().removesuffix("\n")
                   for k in range(firsts[i], firsts[i + 1])]
            assert own == (rows[row + i] or "").translate(LOWER).split("\n")


def test_grams_of_short_rows_are_one_whole():
    hashes, first = np.arange(1, 8, dtype=np.uint64), np.array([0, 2, 2, 7])
    gram, begin = words.grams(hashes, first, 3)
    assert begin.tolist() == [0, 1, 1, 4]
    again, _ = words.grams(hashes[2:], np.array([0, 5]), 3)
    assert gram[1:].tolist() == again.tolist()
    assert len(set(gram.tolist())) == 4
