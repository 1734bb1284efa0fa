"""Links between vectors against all pairs."""

from __future__ import annotations

import math

import numpy as np
import pytest

from docledger.llm import embeddings

SCHEMA = "vec_id long, embedding array<float>, label int, node int"


def test_links_and_groups_against_all_pairs(spark):
    random = np.random.default_rng(4)
    rows = []
    for _ in range(60):
        base = random.standard_normal(24)
        for _ in range(6):
            rows.append(base + random.standard_normal(24) * random.choice([0.0, 0.1, 0.2, 0.3]))
    rows = [x.astype(np.float32) for x in rows] + [rows[0].astype(np.float32)] * 30
    data = [(i * 7 % 1009, x.tolist(), 1, 2) for i, x in enumerate(rows)]
    unit = np.array(rows, float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    got = {x["vec_id"]: x for x in embeddings.linked(
        spark.createDataFrame(data, SCHEMA).repartition(3)).collect()}
    links = near.sum(1) - 1
    found = sum(got[d[0]]["n_links"] for d in data)
    assert all(got[d[0]]["n_links"] <= n for d, n in zip(data, links))
    assert found >= 0.95 * links.sum()
    whole = [i for i, d in enumerate(data) if got[d[0]]["n_links"] == links[i]]
    for i in whole:
        for j in np.flatnonzero(near[i]):
            assert got[data[i][0]]["component_id"] == got[data[j][0]]["component_id"]
    for x in got.values():
        assert x["component_id"] <= x["vec_id"] and x["kept"] == (x["component_id"] == x["vec_id"])


@pytest.mark.parametrize("crowd, block", [(1, 3), (4, 7), (8, 512)])
def test_crowds_in_blocks_count_as_pairs_do(spark, monkeypatch, crowd, block):
    random = np.random.default_rng(7)
    base = random.standard_normal((3, 16))
    rows = [b + random.standard_normal(16) * w for b in base for w in (0.01, 0.15, 0.3) for _ in range(12)]
    data = [(i * 5 % 211, x.tolist(), 0, 0) for i, x in enumerate([*rows, rows[0], rows[0], *(2 * r for r in rows[:3])])]
    frame = spark.createDataFrame(data, SCHEMA)
    monkeypatch.setattr(embeddings, "CROWD", 10**9)
    want = sorted(map(tuple, embeddings.linked(frame).collect()))
    monkeypatch.setattr(embeddings, "CROWD", crowd)
    monkeypatch.setattr(embeddings, "BLOCK", block)
    assert sorted(map(tuple, embeddings.linked(frame).collect())) == want
    assert max(x[1] for x in want) > 20


def test_odd_vectors_link_with_nothing(spark):
    data = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [1.0, math.nan]),
            (6, [math.inf, 1.0]), (None, [1.0, 1.0]), (7, [1.0, 1.0]), (7, [1.0, 1.0]),
            (8, [2.0, 2.0]), (9, [1.0, 1.0, 0.0])]
    frame = spark.createDataFrame([(i, v, 0, 0) for i, v in data], SCHEMA)
    got = sorted(map(str, ((x["vec_id"], x["n_links"], x["component_id"], x["kept"])
                           for x in embeddings.linked(frame).collect())))
    assert got == sorted(map(str, [
        (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True),
        (6, 0, 6, True), (None, 0, None, False), (7, 2, 7, True), (7, 2, 7, True),
        (8, 2, 7, False), (9, 0, 9, True)]))
    assert embeddings.linked(frame.where("false")).collect() == []


@pytest.mark.parametrize("vectors", [1, 1000, 10**6, 10**9])
def test_tables_reach_the_recall(vectors):
    k, tables = embeddings.tables_for(vectors)
    near = embeddings._same_cell(math.sqrt(0.1)) ** k
    assert 1 - (1 - near) ** tables >= embeddings.RECALL


def test_components_whose_squares_overflow(spark):
    data = [(1, [1e200, 1e200]), (2, [2e200, 2e200]), (3, [1e200, -1e200]), (4, [1e308, 1.0]),
            (5, [1.0, 0.0]), (6, [1e-300, 1e-300])]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = {x["vec_id"]: (x["n_links"], x["component_id"]) for x in embeddings.linked(frame).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (0, 3), 4: (1, 4), 5: (1, 4), 6: (2, 1)}
