"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Per-coordinate learning rates let rare words learn fast, the L1 term keeps the
weights of everything uninformative at exactly zero. What remains is a few thousand
(coordinate, weight) pairs, which travel to the scoring tasks by value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docledger.llm import words

#: Coordinates of the hashed feature space; coordinate 0 is the intercept.
BITS = 24
#: Most labelled rows of each class the model is fitted on, chosen by a hash of the id.
FIT_TOXIC, FIT_CLEAN = 3000, 6000
ALPHA, BETA, L2, EPOCHS = 2.0, 1.0, 0.2, 10
#: The L1 term in proportion to the toxic rows of the sample, as their gradients add up.
L1_SHARE, L1_LEAST, L1_MOST = 0.02, 4.0, 30.0
#: Coordinates in fewer rows of a full sample say nothing about other rows; a smaller
#: sample lowers the number in proportion.
FIT_LEAST = 8
#: What a toxic row counts beside a clean one.
TOXIC_WEIGHT = 3.0
THRESHOLD = 0.7


def _coordinates(column: pa.Array) -> Iterator[np.ndarray]:
    """Coordinates of the words, adjacent pairs and pairs with one word between."""
    shift = np.uint64(64 - BITS)
    for _, data, offsets in words.pieces(column):
        starts, ends, first = words.word_spans(data, offsets, words.LETTERS_DIGITS)
        h = words.word_hashes(data, starts, ends)
        kinds = [h]
        for gap, seed in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
            kinds.append(words.mixed(h[:-gap] * np.uint64(seed) + h[gap:])
                         if len(h) > gap else h[:0])
        kinds = [np.maximum(k >> shift, np.uint64(1)).astype(np.int32) for k in kinds]
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            yield np.concatenate([
                k[a: max(a, b - gap)] for gap, k in enumerate(kinds)])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [np.unique(x) for x in _coordinates(batch.column("text"))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("place"), batch.column("toxic"),
             pa.array(rows, pa.list_(pa.int32()))], ["place", "toxic", "at"])


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass over all rows per epoch, in an order fixed by `place`."""
    rows = []
    z, n = np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, np.float32)
    for batch in batches:
        flat = batch.column("at")
        for place, toxic, at in zip(
                batch.column("place").to_pylist(), batch.column("toxic").to_pylist(), flat):
            at = at.values.to_numpy()
            n[at] += 1
            rows.append((place, toxic, at))
    positive = sum(r[1] for r in rows)
    l1 = min(max(L1_LEAST, L1_SHARE * positive), L1_MOST)
    least = min(FIT_LEAST, 1 + positive // 100)
    rows = [(place, toxic, np.append(np.int32(0), at[n[at] >= least]))
            for place, toxic, at in sorted(rows, key=lambda r: r[:2])]
    n[:] = 0

    def weights(at: np.ndarray) -> np.ndarray:
        v, s = z[at], np.sqrt(n[at])
        w = -(v - np.sign(v) * l1) / ((BETA + s) / ALPHA + L2)
        w[np.abs(v) <= l1] = 0
        if len(at) and at[0] == 0:
            w[0] = -v[0] / ((BETA + s[0]) / ALPHA)
        return w

    for epoch in range(EPOCHS):
        for i in np.random.default_rng(epoch).permutation(len(rows)):
            _, toxic, at = rows[i]
            w = weights(at)
            slope = (_probability(w.sum()) - toxic) * (TOXIC_WEIGHT if toxic else 1.0)
            rate = (np.sqrt(n[at] + slope * slope) - np.sqrt(n[at])) / ALPHA
            z[at] += slope - rate * w
            n[at] += slope * slope
    every = np.flatnonzero(n).astype(np.int32)
    w = weights(every)
    kept = w != 0
    yield pa.RecordBatch.from_arrays(
        [pa.array(every[kept]), pa.array(w[kept].astype(np.float64))], ["at", "weight"])


def _probability(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -35, 35))))


def learned(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """at int, weight double: the model, fitted on a bounded sample of labelled rows.

    Uses `text` of documents and `toxic` of labels, never another column but the
    doc_id that joins them. At most FIT_TOXIC and FIT_CLEAN rows are used, those
    with the smallest hashes of their ids; their texts are read whole. Labels that
    are null or belong to no document are ignored; without any label the model is
    empty.
    """
    marked = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select(
        F.col("doc_id").alias("label_id"), F.col("toxic").cast("int").alias("toxic"),
        F.xxhash64("doc_id").alias("place")).distinct()
    sample = marked.where("toxic = 1").orderBy("place").limit(FIT_TOXIC).unionByName(
        marked.where("toxic = 0").orderBy("place").limit(FIT_CLEAN))
    texts = documents.select("doc_id", "text").join(
        F.broadcast(sample), F.col("doc_id") == F.col("label_id")).select("place", "toxic", "text")
    rows = texts.mapInArrow(_features, "place long, toxic int, at array<int>")
    # One task fits; the shuffle before it keeps reading and hashing spread over all.
    return rows.repartition(1).mapInArrow(_fit, "at int, weight double")


def _shared_model(documents: DataFrame, model: DataFrame):
    pairs = model.orderBy("at").collect()  # sparse by L1; 2^BITS rows at the very most
    return documents.sparkSession.sparkContext.broadcast((
        np.array([p["at"] for p in pairs], np.int32), np.array([p["weight"] for p in pairs])))


def _scores(column: pa.Array, at: np.ndarray, weight: np.ndarray, known: np.ndarray) -> np.ndarray:
    base = float(weight[0]) if len(at) and at[0] == 0 else 0.0
    out = []
    for x in _coordinates(column):
        hits = np.unique(x[known[x]])
        out.append(_probability(base + weight[np.searchsorted(at, hits)].sum()))
    return np.array(out)


def _known(at: np.ndarray) -> np.ndarray:
    known = np.zeros(1 << BITS, bool)
    known[at] = True
    return known


def scored(documents: DataFrame, model: DataFrame) -> DataFrame:
    """doc_id, score: the probability that each row's whole text is toxic.

    One row per input row, ids repeated or null included. A null text is scored as
    an empty one, which has the intercept only. Of other columns nothing is read.
    """
    shared = _shared_model(documents, model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known(shared.value[0])
        for batch in batches:
            scores = _scores(batch.column("text"), *shared.value, known)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return documents.select("doc_id", "text").mapInArrow(score, "doc_id long, score double")


def below_threshold(documents: DataFrame, model: DataFrame) -> DataFrame:
    """The rows, with all their columns, whose score is below THRESHOLD."""
    shared = _shared_model(documents, model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known(shared.value[0])
        for batch in batches:
            for at in range(0, len(batch), words.ROWS):  # few texts are copied at a time
                part = batch.slice(at, words.ROWS)
                yield part.filter(pa.array(
                    _scores(part.column("text"), *shared.value, known) < THRESHOLD))

    return documents.mapInArrow(keep, documents.schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row is kept from the fit: a third of all ids, and every null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3, F.lit(1)) == 1


def judged(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: all documents by a model of the other rows."""
    model = learned(documents, labels.where(~held_out()))
    return scored(documents, model).select(
        "doc_id", held_out().alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
