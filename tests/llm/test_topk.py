"""Top-k against all inner products."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from docledger.llm import topk


def near(x):
    """The nearest long."""
    return min(max(x, -2**63), 2**63 - 1)


def brute(rows, k, every):
    kept = [(i, [near(math.floor(256 * x)) for x in v]) for i, v in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, (i, v) in enumerate(kept):
        if i is None or i % every:
            continue
        scores = [(-near(sum(a * b for a, b in zip(v, w))), j is None, j or 0)
                  for n, (j, w) in enumerate(kept) if n != q]
        out += [(i, r + 1, None if null else j, -s)
                for r, (s, null, j) in enumerate(sorted(scores)[:k])]
    return sorted(map(str, out))


def run(spark, rows, k=5, every=5):
    frame = spark.createDataFrame(
        [(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, mark string")
    got = topk.best(frame, k, every)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(str(tuple(r)) for r in got.collect())


@pytest.mark.parametrize("shard", [4, 16, 8192])
def test_equals_all_pairs(spark, monkeypatch, shard):
    monkeypatch.setattr(topk, "SHARD_ROWS", shard)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 3)
    rng = random.Random(shard)
    rows = [(i, [rng.choice([0.0, 0.0, rng.gauss(0, 1)]) for _ in range(9)]) for i in range(40)]
    rows += [(i, rows[0][1]) for i in range(40, 50)]  # ties
    assert run(spark, rows) == brute(rows, 5, 5)


def test_odd_rows(spark):
    rows = [(5, [0.5, 1.0]), (5, [0.5, 1.0]), (5, [0.25, -1.0]), (None, [1.0, 1.0]), (6, None),
            (7, [None, 1.0]), (8, [math.nan, 1.0]), (9, [math.inf, 1.0]), (10, []), (11, [0.0, 0.0]),
            (12, [1.0]), (15, [1e30, -1e30]), (16, [3e15, 1.0, 2.0]), (-20, [-0.001, 0.001])]
    assert run(spark, rows) == brute(rows, 5, 5)
    assert run(spark, []) == [] and run(spark, rows[:1]) == [] and run(spark, [(1, [1.0]), (2, [2.0])]) == []


def test_terms_that_are_never_read_cannot_matter():
    rng = np.random.default_rng(4)
    terms = np.floor(rng.standard_normal((700, 24)) * rng.gamma(1, 60, 24))
    terms[rng.random(terms.shape) < 0.4] = 0
    index = topk.Index(terms)
    for query in terms[:20]:
        scores = terms @ query
        for threshold in np.sort(scores)[[-1, -5, -200]]:
            rows, found = index.search(query, threshold)
            assert rows.tolist() == np.flatnonzero(scores >= threshold).tolist()
            assert (found == scores[rows]).all()
