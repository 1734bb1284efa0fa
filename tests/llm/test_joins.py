"""Set joins against comparing everything with everything."""

from __future__ import annotations

import random
import re

import pytest

from docledger.llm import line_dedup, ngram_join, setjoin

SPACED = re.compile("[^\\x20\\x09-\\x0D]+")
SCHEMA = "doc_id long, text string, token long, a long, salt int"


def shingles(text: str | None, width: int) -> frozenset:
    w = SPACED.findall((text or "").lower())
    if len(w) < width:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i:i + width]) for i in range(len(w) - width + 1))


def varied(r: random.Random, base: list[str], edits: int) -> list[str]:
    out = list(base)
    for _ in range(edits):
        out[r.randrange(len(out))] = f"w{r.randrange(10**6)}"
    return out


def corpus(seed: int) -> list[tuple]:
    """Groups of copies around bases with few and many edits, common parts, odd rows."""
    r = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(400)]
    rows: list[str | None] = [None, "", "   \n", "one", "one", "two words", "Two  WORDS"]
    common = " ".join(r.choices(vocabulary, k=30))
    for size in (1, 2, 3, 25, 60):
        base = r.choices(vocabulary, k=r.randint(40, 120))
        for i in range(size):
            rows.append(" ".join(varied(r, base, r.choice([0, 0, 1, 1, 2, 3, 6, 12]) if i else 0)))
    rows += [" ".join(r.choices(vocabulary, k=20)) + " " + common for _ in range(30)]
    r.shuffle(rows)
    return [(i * 7 % 1009, text, i, 1, 2) for i, text in enumerate(rows)]


def roots(rows: list[tuple], width: int, num: int, den: int) -> list[tuple]:
    sets = [shingles(x[1], width) for x in rows]
    parent = list(range(len(rows)))

    def find(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and common * den >= num * (len(sets[i]) + len(sets[j]) - common):
                parent[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, x in enumerate(rows):
        least[find(i)] = min(least.get(find(i), 10**9), x[0])
    return sorted((x[0], len(sets[i]), least[find(i)]) for i, x in enumerate(rows))


@pytest.mark.parametrize("seed, width, num, den", [(1, 3, 9, 10), (2, 5, 4, 5), (3, 1, 1, 2)])
def test_groups_equal_those_of_all_pairs(spark, monkeypatch, seed, width, num, den):
    monkeypatch.setattr(setjoin, "HUB_ITEMS", 16)
    rows = corpus(seed)
    got = ngram_join.grouped(
        spark.createDataFrame(rows, SCHEMA).repartition(3), width, num, den)
    assert sorted(map(tuple, got.collect())) == roots(rows, width, num, den)


def test_groups_of_repeated_rows_null_ids_and_no_rows(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(5, text), (5, text), (3, text), (None, text), (9, "other"), (9, None), (None, None)]
    got = ngram_join.grouped(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [
        (5, 38, 3), (5, 38, 3), (3, 38, 3), (None, 38, 3), (9, 1, 9), (9, 0, 9), (None, 0, None)]))
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.grouped(empty).collect() == []
    assert line_dedup.deduplicated(empty).collect() == []


@pytest.mark.parametrize("seed", [1, 2])
def test_lines_equal_those_of_all_pairs(spark, monkeypatch, seed):
    monkeypatch.setattr(setjoin, "HUB_ITEMS", 16)
    r = random.Random(seed)
    lines = [x[1] or "" for x in corpus(seed)]
    lines += ["short line", "Short  line", "a b c d", "a b c d e", "e", " "] * 3
    rows = []
    for i in range(60):
        text = "\n".join(r.choices(lines, k=r.randint(0, 9)))
        rows.append((i * 11 % 61, text if i else None, i, 1, 2))
    rows.append((100, "a " * 200_000 + "\nkept line", 0, 1, 2))
    places = sorted(
        (doc_id, k, shingles(line, 5))
        for doc_id, text, *_ in rows for k, line in enumerate((text or "").split("\n")))
    gone: dict[int, list[int]] = {}
    for i, (doc_id, k, s) in enumerate(places):
        for _, _, t in places[:i]:
            common = len(s & t)
            if common and 5 * common >= 4 * (len(s) + len(t) - common):
                gone.setdefault(doc_id, []).append(k)
                break
    want = {
        doc_id: (None if text is None else "\n".join(
            x for k, x in enumerate(text.split("\n")) if k not in gone.get(doc_id, [])),
            gone.get(doc_id, []))
        for doc_id, text, *_ in rows}
    frame = line_dedup.deduplicated(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert frame.columns == ["doc_id", "text", "token", "a", "salt", "removed_lines"]
    assert {x["doc_id"]: (x["text"], x["removed_lines"]) for x in frame.collect()} == want


def test_short_lines_match_lines_of_the_same_words(spark):
    rows = [(1, "short line\n\nall other words here stay"), (2, "Short  line\none two three four"),
            (3, "\none two three four\nshort line"), (4, "one two three")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: x["text"] for x in line_dedup.deduplicated(frame).collect()}
    assert got == {1: rows[0][1], 2: "one two three four", 3: "", 4: "one two three"}


def test_columns_named_like_those_of_the_joins(spark):
    names = ["version", "line", "removed_id", "removed_version", "a", "b", "first", "gone", "key", "u"]
    schema = "doc_id long, text string, " + ", ".join(f"{n} string" for n in names)
    rows = [(1, "the same old words here", *names), (2, "the same old words here", *names)]
    frame = spark.createDataFrame(rows, schema)
    got = line_dedup.deduplicated(frame)
    assert got.columns == [*frame.columns, "removed_lines"]
    assert sorted((x["text"], x["version"], x["removed_lines"]) for x in got.collect()) == [
        ("", "version", [0]), ("the same old words here", "version", [])]
    again = line_dedup.deduplicated(got)
    assert again.columns == got.columns and again.count() == 2
    assert [x["component_id"] for x in ngram_join.grouped(frame).collect()] == [1, 1]
