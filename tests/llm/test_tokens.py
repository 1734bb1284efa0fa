"""Alignments against whole texts encoded by the two libraries."""

from __future__ import annotations

import hashlib
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from docledger.llm import queries, tokens

A, B = queries.VOCABULARY_A, queries.VOCABULARY_B
pytestmark = pytest.mark.skipif(not Path(A).exists(), reason="no vocabularies")


@pytest.fixture(scope="module")
def coders():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=B)


def groups(coders, text):
    """Groups of (ids of A, ids of B), none where the bytes differ."""
    if not text:
        return []
    work, out = tokens.aligner(A, B), []
    a, b = coders[0].encode(" " + text, add_special_tokens=False).ids, coders[1].encode(text)
    raw = (" " + text).encode()
    if not all(b"".join(y.bytes[i] for i in x) == raw for x, y in ((a, work.a), (b, work.b))):
        return []
    ends = []
    for ids, y in ((a, work.a), (b, work.b)):
        at = np.cumsum([len(y.bytes[i]) for i in ids]).tolist()
        ends.append(at)
    low = 0
    for high in sorted(set(ends[0]) & set(ends[1])):
        out.append(tuple([i for i, e in zip(ids, at) if low < e <= high]
                         for ids, at in zip((a, b), ends)))
        low = high
    return out


def named(found):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in found)


def brute(coders, rows):
    each = [(i, groups(coders, t)) for i, t in rows]
    count = Counter((a[-1], b[-1]) for _, g in each for a, b in g)
    best = Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    out = []
    for i, g in each:
        links = [(a[-1], b[-1]) for a, b in g]
        sha = hashlib.sha256(named(g).encode()).hexdigest() if g else ""
        out.append((i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(g),
                    sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), sha))
    return sorted(map(str, out))


ODD = ["", " ", "  ", "\n", "\t", "\r", "\r\n", "\xa0", "　", "\x1c", "\x85", "a", "the", "The", "é",
       "ß", "!", ");", "'s", "'", "1", "23", "▁", "<s>", "</s>", "<unk>", "<|endoftext|>", "<0x0A>",
       "日本", "😀", "x"]


def test_segments_do_not_change_tokens(coders):
    rng = random.Random(2)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(1, 12))) for _ in range(6000)]
    texts = [t for t in texts if t]
    work = tokens.aligner(A, B)
    assert work.parts
    for text, codes in zip(texts, work.codes([work.segments(t) for t in texts])):
        good = work.counts(np.array(codes))[:, 3].all()
        assert (";".join(work.joined[c] for c in codes) if good else "") == named(groups(coders, text))


@pytest.mark.parametrize("heavy", [2.0, tokens.HEAVY, 0.01])
def test_documents(spark, coders, monkeypatch, heavy):
    monkeypatch.setattr(tokens, "HEAVY", heavy)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(
        "/root/testdata/sf0.001/documents.parquet").where("length(text) < 900").collect()]
    rng = random.Random(5)
    rows += [(i, "".join(rng.choice(ODD) for _ in range(20))) for i in range(900, 960)]
    rows += [(None, "no id"), (None, None), (5, "twice"), (5, "twice"), (6, ""), (7, "y" * 30_000)]
    frame = spark.createDataFrame([(i, t, 1, 2) for i, t in rows],
                                  "doc_id long, text string, row int, link int")
    got = tokens.aligned(frame, A, B)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
                           "groups_sha256"]
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(coders, rows)


def test_only_irregular_pairs_leave_the_vector(coders):
    work = tokens.aligner(A, B)
    counts = tokens._Counts(work)
    text = "the cat and an unusual Zwölfzylinder of the cat"
    codes = np.array(work.codes([work.segments(text)])[0])
    counts.add(work.links(codes), np.ones(int(work.counts(codes)[:, 2].sum()), np.int64))
    regular = [(a, b) for a, b in groups(coders, text)
               if len(a) == len(b) == 1 and work.a.bytes[a[0]] == work.b.bytes[b[0]]]
    assert counts.vector.sum() == len(regular) > 4
    assert counts.held == len(groups(coders, text)) - len(regular)


def test_no_rows(spark):
    for rows in ([], [(1, None)]):
        frame = spark.createDataFrame(rows, "doc_id long, text string")
        assert [tuple(r) for r in tokens.aligned(frame, A, B).collect()] == [
            (i, 0, 0, 0, 0, 0, 0, "") for i, _ in rows]
