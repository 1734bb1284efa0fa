"""Embedding near-dedup: Euclidean p-stable hashing, then exact cosine checks.

Normalised vectors of cosine c lie sqrt(2 - 2c) apart, and a Gaussian projection of
their difference is Gaussian with that width. Projections are cut into cells of width
CELL; `k` cells form a bucket key, and several tables of keys give a pair several
chances. `k` follows from the number of vectors, so that unrelated ones rarely share a
bucket, and the number of tables from the chance that a pair at the threshold does.

Buckets of few vectors give pairs, checked one by one. A bucket of many, as copies with
small changes make it, is cut into blocks, and two blocks at a time are compared by one
product of matrices: only sums per vector and a spanning forest come out, never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docledger.llm.components import components
from docledger.llm.words import mixed
from docledger.sources.workspace import persisted

COSINE = 0.95
CELL = 1.5
#: Chance to meet in a table at least once, for a pair exactly at the threshold.
RECALL = 0.98
SEED = 71
#: A bucket with more different vectors than CROWD is compared in blocks of BLOCK.
CROWD, BLOCK = 64, 512
_NODE = "struct<first_id: long, code: long>"


def _same_cell(distance: float) -> float:
    """Chance that two points at this distance share a cell of one projection."""
    r = CELL / distance
    below = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * below - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def tables_for(vectors: int, cosine: float = COSINE) -> tuple[int, int]:
    """(projections per key, tables) for so many vectors."""
    far = _same_cell(math.sqrt(2))
    near = _same_cell(math.sqrt(2 - 2 * cosine))
    k = max(4, math.ceil(math.log(max(vectors, 2) * 10) / -math.log(far)))
    return k, math.ceil(math.log(1 - RECALL) / math.log(1 - near ** k))


def _numbers(vector: pa.ListScalar) -> np.ndarray:
    """The components, scaled by a power of two so that no product overflows."""
    x = vector.values.to_numpy(zero_copy_only=False)
    return np.ldexp(x, -int(np.frexp(np.abs(x).max())[1]))


def _keys(k: int, tables: int):
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            out = []
            for vector in batch.column("vector"):
                x = _numbers(vector)
                if len(x) not in planes:
                    random = np.random.default_rng([SEED, len(x)])
                    planes[len(x)] = (random.standard_normal((k * tables, len(x))),
                                      random.uniform(0, CELL, k * tables))
                plane, shift = planes[len(x)]
                cells = np.floor((plane @ (x / np.linalg.norm(x)) + shift) / CELL)
                cells = cells.astype(np.int64).view(np.uint64).reshape(tables, k)
                key = np.arange(tables, dtype=np.uint64) + np.uint64(len(x) << 32)
                for j in range(k):
                    key = mixed(key ^ cells[:, j])
                out.append(key.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.array(out, pa.list_(pa.int64()))], ["node", "keys"])
    return keys


def _cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cosines = []
        for x, y in zip(batch.column("x"), batch.column("y")):
            x, y = _numbers(x), _numbers(y)
            cosines.append(float(x @ y / (np.linalg.norm(x) * np.linalg.norm(y)))
                           if len(x) == len(y) else -1.0)
        yield pa.RecordBatch.from_arrays(
            [batch.column("u"), batch.column("v"), pa.array(cosines, pa.float64())],
            ["u", "v", "cosine"])


def _nodes(column: pa.Array) -> np.ndarray:
    """Rows of (first_id, code)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.stack([x.to_numpy(zero_copy_only=False) for x in column.flatten()], 1)


def _shared(crowds: list[np.ndarray], key: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For left and right rows, whether they also meet in a crowd of a smaller key."""
    sizes = [len(c) for c in crowds]
    keys = np.concatenate(crowds)
    rows = np.repeat(np.arange(len(crowds)), sizes)
    rows, keys = rows[keys < key], keys[keys < key]
    names, at, often = np.unique(keys, return_inverse=True, return_counts=True)
    several = np.cumsum(often > 1) - 1
    kept = often[at] > 1
    member = np.zeros((len(crowds), int((often > 1).sum())), np.float32)
    member[rows[kept], several[at[kept]]] = 1
    return member[left] @ member[right].T > 0


def _forest(near: np.ndarray, left: np.ndarray, right: np.ndarray, size: int) -> np.ndarray:
    """For each row the least row that links reach."""
    label = np.arange(size)
    while True:
        before = label.copy()
        for a, b, links in ((left, right, near), (right, left, near.T)):
            reach = np.where(links, label[b][None, :], size).min(1, initial=size)
            label[a] = np.minimum(label[a], reach)
        if (label == before).all():
            return label


def _compared(cosine: float):
    """Two blocks of a crowd: links of each vector there, and edges that connect them."""
    def compare(group: pa.Table) -> pa.Table:
        key = group.column("key")[0].as_py()
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        nodes = _nodes(group.column("node"))
        order = np.lexsort([nodes[:, 1], nodes[:, 0]])
        group, nodes = group.take(pa.array(order)), nodes[order]
        vectors = [_numbers(x) for x in group.column("vector")]
        copies, chunk = (group.column(c).to_numpy() for c in ("copies", "chunk"))
        crowds = [np.array(x, np.int64) for x in group.column("crowds").to_pylist()]
        lengths = np.array([len(x) for x in vectors])
        others, label = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
        for n in np.unique(lengths):  # a key holds one length, but for colliding hashes
            left = np.flatnonzero((lengths == n) & (chunk == i))
            right = np.flatnonzero((lengths == n) & (chunk == j))
            if not len(left) or not len(right):
                continue
            unit = [np.array([vectors[k] for k in rows]) for rows in (left, right)]
            unit = [x / np.linalg.norm(x, axis=1, keepdims=True) for x in unit]
            near = unit[0] @ unit[1].T >= cosine
            if i == j:
                np.fill_diagonal(near, False)
            label = np.minimum(label, _forest(near, left, right, len(nodes)))
            own = near & ~_shared(crowds, key, left, right)
            others[left] += own @ copies[right]
            if i != j:
                others[right] += own.T @ copies[left]
        told = np.flatnonzero((others > 0) | (label < np.arange(len(nodes))))
        to = nodes[label[told]]
        node = group.column("node").combine_chunks().take(pa.array(told))
        return pa.table({
            "node": node, "root": pa.StructArray.from_arrays(
                [pa.array(to[:, 0]), pa.array(to[:, 1])], ["first_id", "code"]),
            "others": pa.array(others[told])})
    return compare


def linked(embeddings: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per input row.

    Equal vectors form one class, so copies never become pairs; pairs of different
    vectors are those that share a bucket, each checked once in double precision.
    Vectors that are null, empty, zero or hold null or non-finite components link
    with nothing, and so do rows with a null vec_id, whose component_id is null. Rows
    that repeat a vec_id count each as a vector. Labels are not read.
    """
    numbers = F.transform("embedding", lambda x: x.cast("double"))
    rows = embeddings.select("vec_id", numbers.alias("vector"))
    sound = F.col("vec_id").isNotNull() & F.coalesce(
        F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x)
                 & (F.abs(x) < F.lit(float("inf"))))
        & F.exists("vector", lambda x: x != 0), F.lit(False))
    rows = rows.select(
        "vec_id", F.when(sound, F.col("vector")).alias("vector"))
    classes = persisted(rows.where("vector IS NOT NULL").groupBy("vector").agg(
        F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies"),
    ).select(F.struct("first_id", F.xxhash64("vector").alias("code")).alias("node"),
             "vector", "copies"), "vectors")
    k, tables = tables_for(classes.count(), cosine)
    keyed = persisted(classes.select("node", "vector").mapInArrow(
        _keys(k, tables), f"node {_NODE}, keys array<long>").select(
            "node", F.explode("keys").alias("key")), "keys")
    crowds = persisted(keyed.groupBy(F.col("key").alias("crowd")).agg(
        F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"), F.count(F.lit(1)).alias("size")).where(
        F.col("size") > CROWD).select("crowd", "blocks"), "crowds")
    crowded = persisted(keyed.join(crowds, F.col("key") == F.col("crowd")).select(
        "node", "key", "blocks"), "crowded")
    own = crowded.groupBy(F.col("node").alias("of")).agg(F.collect_list("key").alias("crowds"))
    vectors = persisted(classes.join(own, F.col("node") == F.col("of"), "left").select(
        "node", "vector", "copies", F.coalesce("crowds", F.array().cast("array<long>")).alias("crowds")),
        "crowd-vectors")

    few = keyed.join(crowds, F.col("key") == F.col("crowd"), "left_anti")
    left = few.select(F.col("node").alias("u"), "key")
    right = few.select(F.col("node").alias("v"), F.col("key").alias("right_key"))
    pairs = left.join(right, (F.col("key") == F.col("right_key")) & (F.col("u") < F.col("v")))
    checked = pairs.select("u", "v").distinct().join(
        vectors.select(F.col("node").alias("u"), F.col("vector").alias("x"), F.col("crowds").alias("cx")), "u"
    ).join(vectors.select(F.col("node").alias("v"), F.col("vector").alias("y"), F.col("crowds").alias("cy")), "v")
    # A pair that meets in a crowd is counted there.
    links = persisted(checked.where(~F.arrays_overlap("cx", "cy")).select("u", "v", "x", "y").mapInArrow(
        _cosines, f"u {_NODE}, v {_NODE}, cosine double").where(F.col("cosine") >= cosine), "links")

    chunk = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    placed = crowded.withColumn("chunk", chunk).withColumn(
        "other", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int")))).select(
        "node", "key", "chunk", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))
    blocks = placed.join(vectors.withColumnRenamed("node", "of"), F.col("node") == F.col("of")).select(
        "node", "key", "chunk", "i", "j", "vector", "copies", "crowds")
    met = persisted(blocks.groupBy("key", "i", "j").applyInArrow(
        _compared(cosine), f"node {_NODE}, root {_NODE}, others long"), "met")

    both = links.select("u", "v").unionByName(
        links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    partners = both.join(
        classes.select(F.col("node").alias("v"), "copies"), "v",
    ).select(F.col("u").alias("node"), F.col("copies").alias("others")).unionByName(
        met.select("node", "others")).groupBy("node").agg(F.sum("others").alias("others"))
    links = links.select("u", "v").unionByName(
        met.select(F.col("node").alias("u"), F.col("root").alias("v")).distinct())
    roots = components(links)
    named = classes.join(partners, "node", "left").join(roots, "node", "left").select(
        F.col("vector").alias("class_vector"),
        (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
        F.coalesce(F.col("root.first_id"), F.col("node.first_id")).alias("component_id"))
    return rows.where("vector IS NOT NULL").join(
        named, F.col("vector") == F.col("class_vector"),
    ).select("vec_id", "n_links", "component_id").unionByName(
        rows.where("vector IS NULL").select(
            "vec_id", F.lit(0).cast("long").alias("n_links"),
            F.col("vec_id").alias("component_id")),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
