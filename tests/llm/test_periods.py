"""Runs against a search of every period."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from docledger.llm import periods


def brute_runs(words):
    out = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, q, n) for (s, n), q in out.items())


def brute(doc_id, text):
    words = [w for w in (text or "").translate({c: " " for c in range(9, 14)}).split(" ") if w]
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        a = (h // 10) % n
        p = 1 + (n - a) // (3 + (h // 10) % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    gone = {i for s, q, n in runs for i in range(s + q, s + n)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    best = min(runs, key=lambda r: (-r[2] / r[1], r[0], r[1]), default=(None, None, None))
    return (doc_id, len(runs), best[0], best[2], best[1], best[0] if best[0] is None
            else 1000 * best[2] // best[1], sha("".join(f"{s},{n},{q}\n" for s, q, n in runs)),
            sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def text_of(rng, size):
    out = []
    while len(out) < size:
        if rng.random() < 0.4:
            out += [rng.choice("abcdefgh") for _ in range(rng.randint(1, 12))]
        else:
            unit = [rng.choice("ab" if rng.random() < 0.5 else "abcdefghijklm")
                    for _ in range(rng.randint(1, rng.choice([3, 9, 40])))]
            out += (unit * 9)[: rng.randint(1, 8 * len(unit))]
    return rng.choice([" ", "\n", "\t "]).join(out[:size])


@pytest.mark.parametrize("long", [0, 50, periods.LONG])
def test_equals_every_period(spark, long):
    rng = random.Random(long)
    rows = [(i, text_of(rng, rng.randint(0, 300))) for i in range(120)]
    rows += [(None, "a " * 40), (7, "a b " * 30), (7, "a b " * 30), (8, None), (9, ""), (10, " \n "),
             (11, "a b c d e f"), (12, "x" * 5000), (13, "a\xa0b a\xa0b a\xa0b a\xa0b a\xa0b a\xa0b")]
    frame = spark.createDataFrame([(i, t, 1, "row") for i, t in rows],
                                  "doc_id long, text string, row int, words string")
    got = periods.runs(periods.with_planted_periods(frame), long).collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(str(brute(i, t)) for i, t in rows)


@pytest.mark.parametrize("base", [1, 2, 4])
def test_pieces_of_many_tiles_stitch_to_whole_runs(spark, monkeypatch, base):
    monkeypatch.setattr(periods, "BASE", base)
    rng = random.Random(base)
    texts = [text_of(rng, 600).split() for _ in range(6)] + [["a"] * 500]
    pieces = []
    for row, words in enumerate(texts):
        numbers = {w: i for i, w in enumerate(words)}
        codes = np.array([numbers[w] for w in words])
        cut = periods.tiles(len(words))
        assert len(cut) > 10
        pieces += [(row, q, a + start, b + start) for low, high, start, stop in cut
                   for q, a, b in periods.solved(codes[start:stop], low, high).tolist()]
    frame = spark.createDataFrame(pieces, "row long, period long, begin long, stop long")
    got = {}
    for r in periods.stitched(frame).collect():
        got.setdefault(r["row"], []).append((r["start"], r["period"], r["length"]))
    assert [sorted(got.get(i, [])) for i in range(len(texts))] == [brute_runs(t) for t in texts]


def test_no_rows(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert periods.runs(periods.with_planted_periods(frame)).collect() == []
