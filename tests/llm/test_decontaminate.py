"""Windows of items in documents against looking everywhere."""

from __future__ import annotations

import random
import re

from docledger.llm import decontaminate

CODES = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")


def words(text: str | None) -> list[str]:
    return CODES.findall((text or "").lower())


def expected(text: str | None, items: list[tuple]) -> tuple:
    w, hit, ids = words(text), set(), set()
    for item_id, item in items:
        own = words(item)
        long = min(10, len(own))
        for at in range(len(own) - long + 1 if own and item_id is not None else 0):
            for i in range(len(w) - long + 1):
                if w[i:i + long] == own[at:at + long]:
                    hit.update(range(i, i + long))
                    ids.add(str(item_id))
    return len(w), len(hit), sorted(ids)


def test_hits_equal_those_found_everywhere(spark):
    r = random.Random(5)
    common = ["the", "of", "and", "to", "Ä-b", "42"]
    fresh = [f"q{i}" for i in range(300)]
    items = [(i, " ".join(r.choices(common + fresh, k=r.choice([12, 25, 40])))) for i in range(12)]
    items += [(50, "the of"), (51, "Q7"), (52, "to " * 30), (53, ""), (54, None), (None, "and the"),
              (1, items[1][1]), (60, " ".join(items[2][1].split()[3:18]))]
    docs: list[tuple] = [(0, None), (1, ""), (2, "the"), (3, items[3][1]), (3, items[3][1])]
    for i in range(60):
        body = r.choices(common + fresh, k=r.randint(0, 80))
        if i % 2:
            source = (r.choice(items)[1] or "").split()
            a = r.randint(0, max(0, len(source) - 5))
            body[len(body) // 2: len(body) // 2] = [x.upper() + "," for x in source[a:a + r.randint(5, 20)]]
        docs.append((10 + i, " ".join(body)))
    docs += [(200, "to " * 100_000), (3, "another text of a known id"), (None, "the of")]
    got = decontaminate.contamination(
        spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, key string, start int"),
        spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(str, ((x[0], x[1], x[2], x[3]) for x in got.collect()))) == sorted(
        str((d[0], *expected(d[1], items))) if d[0] != 200 else
        str((200, 100_000, 100_000, ["52"])) for d in docs)


def test_without_documents_or_items(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert list(map(tuple, decontaminate.contamination(docs, items).collect())) == [(1, 3, 0, [])]
    assert decontaminate.contamination(docs.where("false"), items).collect() == []
