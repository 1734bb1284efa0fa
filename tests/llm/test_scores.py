"""Toxicity and language: held-out accuracy on the given tables, and odd rows."""

from __future__ import annotations

import math
import random
from pathlib import Path

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from docledger.llm import language, toxicity

SF_DIR = "/root/testdata/sf0.1"


@pytest.mark.skipif(not Path(SF_DIR).is_dir(), reason="no test tables")
def test_toxicity_of_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    rows = toxicity.judged(docs, labels).join(labels, "doc_id").join(
        docs.select("doc_id", "lang"), "doc_id").where("held_out").groupBy(
        (F.col("lang") == "en").alias("en"), "toxic", "predicted").count().collect()
    count = {(x["en"], x["toxic"], x["predicted"]): x["count"] for x in rows}
    # With 300 toxic rows to learn from, many words of the rarer languages stay unseen.
    assert count[True, 1, 1] >= 0.85 * (count[True, 1, 1] + count.get((True, 1, 0), 0))
    both = count[True, 1, 1] + count[False, 1, 1]
    assert both >= 0.65 * sum(n for (_, toxic, _), n in count.items() if toxic)
    false = count.get((True, 0, 1), 0) + count.get((False, 0, 1), 0)
    assert false <= 0.01 * sum(count.values())


def test_toxicity_learns_only_from_labels_it_is_given(spark):
    r = random.Random(1)
    plain = [f"p{i}" for i in range(50)]
    docs, labels = [], []
    for i in range(400):
        words = r.choices(plain, k=30)
        bad = i % 4 == 0
        if bad:
            words[5:7] = ["Dreadful!", "villain"]
        docs.append((i, " ".join(words), "x", 0.5))
        labels.append((i, int(bad) if i % 10 else None))
    docs += [(1000, None, "x", 0.5), (1001, "", "x", 0.5), (None, "dreadful villain", "x", 0.5),
             (3, "dreadful villain", "x", 0.5), (1002, "dreadful villain " * 50_000, "x", 0.5)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, toxic string, score double")
    marks = spark.createDataFrame(labels + labels[:50], "doc_id long, toxic int")
    got = toxicity.judged(frame, marks)
    assert got.count() == len(docs)
    assert all(0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.7) for x in got.collect())
    told = {x["doc_id"]: x["predicted"] for x in got.where("doc_id <> 3 OR doc_id IS NULL").collect()}
    assert [told[k] for k in (1000, 1001, None, 1002)] == [0, 0, 1, 1]
    assert all(told[i] == (i % 4 == 0) for i in range(400) if i != 3)
    model = toxicity.learned(frame, marks.where("false"))
    assert model.count() == 0
    assert {x["score"] for x in toxicity.scored(frame, model).collect()} == {0.5}
    kept = toxicity.below_threshold(frame, toxicity.learned(frame, marks))
    assert kept.schema == frame.schema and kept.where("text LIKE '%villain%'").count() == 0
    assert toxicity.judged(frame.where("false"), marks).collect() == []


def test_toxicity_equals_a_plain_ftrl_of_the_same_rows(spark):
    r = random.Random(3)
    texts = [" ".join(r.choices([f"w{i}" for i in range(12)] + ["vile"] * 2, k=r.randint(0, 8)))
             for _ in range(90)]
    rows = [(i, t, int("vile" in t) if i % 7 else i % 2) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = {x["doc_id"]: x["score"] for x in toxicity.scored(
        docs, toxicity.learned(docs, docs.select("doc_id", "toxic"))).collect()}
    places = {x["doc_id"]: x["h"] for x in docs.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}

    def features(text):
        w = text.split()
        return {*w, *zip(w, w[1:]), *((a, None, c) for a, c in zip(w, w[2:]))}

    sets = {i: features(t) for i, t, _ in rows}
    seen = {}
    for s in sets.values():
        for f in s:
            seen[f] = seen.get(f, 0) + 1
    toxic = sum(y for *_, y in rows)
    l1 = min(max(toxicity.L1_LEAST, toxicity.L1_SHARE * toxic), toxicity.L1_MOST)
    least = min(toxicity.FIT_LEAST, 1 + toxic // 100)
    z, n = {}, {}

    def weight(f):
        v, s = z.get(f, 0.0), math.sqrt(n.get(f, 0.0))
        if f == "":
            return -v / ((toxicity.BETA + s) / toxicity.ALPHA)
        return 0.0 if abs(v) <= l1 else -(v - math.copysign(l1, v)) / (
            (toxicity.BETA + s) / toxicity.ALPHA + toxicity.L2)

    order = sorted(rows, key=lambda x: (places[x[0]], x[2]))
    for epoch in range(toxicity.EPOCHS):
        for k in np.random.default_rng(epoch).permutation(len(order)):
            i, _, y = order[k]
            own = ["", *(f for f in sets[i] if seen[f] >= least)]
            w = {f: weight(f) for f in own}
            slope = (1 / (1 + math.exp(-sum(w.values()))) - y) * (toxicity.TOXIC_WEIGHT if y else 1)
            for f in own:
                a = n.get(f, 0.0)
                z[f] = z.get(f, 0.0) + slope - (math.sqrt(a + slope**2) - math.sqrt(a)) / toxicity.ALPHA * w[f]
                n[f] = a + slope**2
    for i, _, _ in rows:
        want = 1 / (1 + math.exp(-weight("") - sum(weight(f) for f in sets[i] if f in n)))
        assert got[i] == pytest.approx(want, abs=2e-3)
    assert max(got.values()) > 0.9 and min(got.values()) < 0.1


def test_toxicity_reads_the_documents_in_many_tasks(spark):
    docs = spark.range(40).selectExpr("id AS doc_id", "'some words' AS text", "id % 2 AS toxic").repartition(8)
    plan = toxicity.learned(docs, docs)._jdf.queryExecution().executedPlan().toString()
    assert "Coalesce" not in plan and plan.index("SinglePartition") < plan.rindex("MapInArrow")


@pytest.mark.skipif(not Path(SF_DIR).is_dir(), reason="no test tables")
def test_language_of_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    right = language.identified(docs).join(docs.select("doc_id", "lang"), "doc_id").where(
        "held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right >= 0.97


def test_language_is_the_smallest_size_of_all(spark):
    """Every text against every dictionary of more than 200 languages, one by one."""
    r = random.Random(8)
    names = [f"l{i:03}" for i in range(260)]
    words = {n: ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(12)] for n in names}
    rows = [(k * 1000 + i, " ".join(r.choices(words[n], k=30)), n) for i, n in enumerate(names) for k in (0, 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = {x["lang"]: bytes(x["dictionary"]) for x in language.learned(docs).collect()}
    assert sorted(known) == names
    assert all(len(x) <= language.ALL_BYTES // len(names) for x in known.values())
    tests = [(i, " ".join(r.choices(words[n], k=k)), n) for i, (n, k) in enumerate(
        (n, k) for n in r.sample(names, 12) for k in (3, 300))]
    got = language.predicted(
        spark.createDataFrame(tests, docs.schema), language.learned(docs)).collect()
    for (i, text, n), found in zip(tests, sorted(got, key=lambda x: x["doc_id"])):
        raw = b" " + text.encode() + b" "
        short = len(raw) <= language.SHORT
        how = zstandard.ZstdCompressionParameters.from_level(
            language.SHORT_LEVEL if short else language.LEVEL,
            min_match=3 if short else language.SHORTEST_MATCH, write_checksum=False,
            write_content_size=False, write_dict_id=False)
        sizes = {}
        for name, content in known.items():
            packer = zstandard.ZstdCompressor(compression_params=how, dict_data=zstandard.ZstdCompressionDict(
                content, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
            sizes[name] = sum(len(packer.compress(raw[at: at + language.BLOCK]))
                              for at in range(0, len(raw), language.BLOCK))
        assert (found["doc_id"], found["lang_pred"]) == (i, min(sizes, key=lambda x: (sizes[x], x)))
        assert found["lang_pred"] == n or short


def test_language_dictionaries_are_bounded_by_long_texts_too(spark):
    docs = spark.createDataFrame(
        [(1, "lang " * 200_000, "a"), (2, "andere Worte", "b")], "doc_id long, text string, lang string")
    sizes = {x["lang"]: len(x["dictionary"]) for x in language.learned(docs).collect()}
    assert sizes == {"a": language.DICTIONARY_BYTES, "b": 14}


def test_language_of_odd_rows(spark):
    docs = [(i, f"the house and the garden of the king number {i}", "en", 0.0) for i in range(60)]
    docs += [(100 + i, f"das Haus und der Garten von dem König Nummer {i}", "de", 0.0) for i in range(60)]
    odd = [(None, "the garden and the house"), (500, None), (501, ""), (502, "12 34 !!"),
           (503, "der Garten und das Haus " * 20_000), (504, "日本"), (500, "das Haus und der Garten von dem König")]
    frame = spark.createDataFrame(
        docs + [(i, t, None, 0.0) for i, t in odd], "doc_id long, text string, lang string, score double")
    got = [(x["doc_id"], x["lang_pred"], x["score"]) for x in language.identified(frame).collect()]
    assert len(got) == len(docs) + len(odd)
    assert all(0 <= score <= 1 for _, _, score in got)
    told = [(i, lang) for i, lang, _ in got]
    for row in [(None, "en"), (500, "und"), (501, "und"), (502, "und"), (503, "de"), (500, "de")]:
        assert row in told
    assert dict(told)[504] in ("en", "de")
    assert sum(lang == "en" for i, lang in told if i is not None and i < 100) >= 58
    unlabelled = frame.withColumn("lang", F.lit(None).cast("string"))
    assert {x["lang_pred"] for x in language.identified(unlabelled).collect()} == {"und"}
    assert language.identified(frame.where("false")).collect() == []
