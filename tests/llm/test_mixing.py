"""Targets, bounds and repeatability of the mix."""

from __future__ import annotations

import random

from docledger.llm import mixing

SCHEMA = "doc_id long, source string, text string, rate double, target string"


def rows(seed: int = 1):
    r = random.Random(seed)
    out = []
    for i in range(3000):
        source = r.choice(["b", "b", "b", "B", "ä", "", None, "z"])
        out.append((i, source, "w " * r.randint(0, 60), 0.5, "x"))
    return [*out, (9000, "long", "w " * 20_000, 1.0, "x"), (9001, "none", None, 1.0, "x"),
            (1, "b", "same id again", 1.0, "x"), (None, "b", "no id", 1.0, "x")]


def test_sources_come_near_their_targets(spark):
    frame = spark.createDataFrame(rows(), SCHEMA)
    got = [x.asDict() for x in mixing.mixed(frame).collect()]
    assert len(got) == len(rows())
    order = sorted({x["source"] for x in got if x["source"] is not None}) + [None]
    size = {s: sum(x["size"] for x in got if x["source"] == s) for s in order}
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    capped: set = set()
    while True:
        level = (sum(size.values()) - sum(3 * size[s] for s in capped)) / sum(
            weight[s] for s in order if s not in capped)
        more = {s for s in order if s not in capped and 3 * size[s] <= weight[s] * level}
        if not more:
            break
        capped |= more
    for s in order:
        own = [x for x in got if x["source"] == s]
        target = 3 * size[s] if s in capped else weight[s] * level
        assert all(abs(x["target"] - target) < 1e-6 * max(1, target) for x in own)
        assert all(0 <= x["copies"] <= 3 and x["taken"] == x["copies"] * x["size"] for x in own)
        assert all(x["source_size"] == size[s] for x in own)
        if size[s]:
            taken = sum(x["taken"] for x in own)
            assert abs(taken - target) <= max(x["size"] for x in own)
    again = [x.asDict() for x in mixing.mixed(frame.repartition(7)).collect()]
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_no_rows_and_no_words(spark):
    assert mixing.mixed(spark.createDataFrame([], SCHEMA)).collect() == []
    got = mixing.mixed(spark.createDataFrame([(1, "a", None, 0.0, "")], SCHEMA)).first()
    assert (got["size"], got["target"], got["taken"]) == (0, 0.0, 0)


def test_rows_without_an_id_spread_over_the_parts(spark):
    rows = [(None, f"word {'w ' * (i % 7)}{i}", "a") for i in range(60)] + [(None, None, "a"), (None, "", "a")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert mixing.sized(frame).select("salt").distinct().count() == 61
    assert mixing.mixed(frame).count() == 62
