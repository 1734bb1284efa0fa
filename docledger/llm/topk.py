"""Exact top-k by inner product with MaxScore over shards of an inverted index.

Vectors become integers; each component is a term. Rows are dealt into shards, queries
into blocks, and every block meets every shard in one task. Within a shard a term has
its postings: rows with that component and its value, and the largest and smallest
value give a bound of what the term can add to a score. A query's terms with the least
bounds that together cannot reach its threshold are non-essential: only rows in the
postings of essential terms are collected, and the other terms are looked up for rows
while what is left to add keeps them competitive. The shards' lists are merged at last.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from docledger.sources.workspace import persisted

SCALE = 256
SHARD_ROWS = 8192
BLOCK_QUERIES = 1024
#: Rows of a shard that are scored first, for a threshold that its own rows reach.
FIRST_ROWS = 256
#: Terms looked up between two rounds of dropping rows that are no longer competitive.
STEP = 4
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def quantized(embeddings: DataFrame) -> DataFrame:
    """vec_id, terms array<long>, copies: the different rows that take part.

    Vectors that are null or hold a null or non-finite component take no part.
    """
    numbers = F.transform("embedding", lambda x: x.cast("double"))
    sound = F.coalesce(F.forall("numbers", lambda x: x.isNotNull() & ~F.isnan(x)
                                & (F.abs(x) < F.lit(float("inf")))), F.lit(False))
    rows = embeddings.select("vec_id", numbers.alias("numbers")).where(sound)
    terms = F.transform("numbers", lambda x: F.floor(x * F.lit(float(SCALE))).cast("long"))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), terms.alias("terms")).groupBy(
        "vec_id", "terms").agg(F.count(F.lit(1)).alias("copies"))


def best(embeddings: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """query_id, rank, vec_id, score: for each query row its k best other rows.

    Queries are the rows whose vec_id is divisible by `every`; candidates are all rows
    but the query's own, also rows equal to it. Ties go to the smaller vec_id, null ids
    last. Rows that repeat an id are rows of their own, and so are queries. Components
    one vector lacks count as 0; a number beyond a long is its nearest long. Without
    queries or other rows the result is empty. Other columns are not read.
    """
    rows = persisted(quantized(embeddings), "terms")
    mark = F.xxhash64("vec_id", "terms")
    rows = rows.withColumn("mark", mark)
    shards = -(-rows.count() // SHARD_ROWS) or 1
    asked = rows.where(F.col("vec_id") % every == 0)
    blocks = -(-asked.count() // BLOCK_QUERIES) or 1
    place = lambda n: F.pmod("mark", F.lit(n)).cast("int")
    # The mark's high bits, so that a block's queries are not those of one shard.
    block = F.pmod(F.shiftrightunsigned("mark", 20), F.lit(blocks)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select("mark", "vec_id", "terms", "copies", block.alias("block"), each(shards).alias("shard"))
    right = rows.select("mark", "vec_id", "terms", "copies", each(blocks).alias("block"),
                        place(shards).alias("shard"))
    met = left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard")).applyInArrow(
        lambda q, r: _met(q, r, k), "query_mark long, query_id long, copies int, vec_id long, score long")
    order = W.partitionBy("query_mark", "query_id").orderBy(
        F.desc("score"), F.asc_nulls_last("vec_id"))
    merged = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    # Equal query rows have one list each.
    return merged.select("query_id", "rank", "vec_id", "score", F.explode(
        F.sequence(F.lit(1), "copies")).alias("copy")).drop("copy")


def _matrix(table: pa.Table, width: int, kind: type) -> np.ndarray:
    """Rows of terms, 0 where a vector is shorter."""
    column = table.column("terms").combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width), kind)
    values = column.flatten().to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    within = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[rows, within] = values.astype(object) if kind is object else values
    return out


class Index:
    """Postings of one shard: a column for terms most rows have, else rows and values."""

    def __init__(self, terms: np.ndarray) -> None:
        self.columns = np.ascontiguousarray(terms.T)
        self.highest = terms.max(0) if len(terms) else np.zeros(terms.shape[1], terms.dtype)
        self.lowest = terms.min(0) if len(terms) else np.zeros(terms.shape[1], terms.dtype)
        self.rows = [None if 4 * len(r) > len(terms) else r
                     for r in (np.flatnonzero(c) for c in self.columns)]
        self.first = terms[:FIRST_ROWS]

    def collect(self, query: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """Each row's sum over the postings of `terms`."""
        whole = [t for t in terms.tolist() if self.rows[t] is None]
        sums = query[whole] @ self.columns[whole]
        for t in terms.tolist():
            if self.rows[t] is not None:
                sums[self.rows[t]] += query[t] * self.columns[t, self.rows[t]]
        return sums

    def search(self, query: np.ndarray, threshold) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of all rows whose score is the threshold or more."""
        bounds = np.maximum(np.maximum(query * self.highest, query * self.lowest), 0)
        order = np.argsort(-bounds, kind="stable")
        # left[i]: the most that terms i and later in this order can add.
        left = np.concatenate([np.cumsum(bounds[order][::-1])[::-1], np.zeros(1, bounds.dtype)])
        essential = int(np.argmax(left < threshold)) if left[-1] < threshold else len(order)
        sums = self.collect(query, order[:essential])
        rows = np.flatnonzero(sums + left[essential] >= threshold)
        sums = sums[rows]
        for at in range(essential, len(order), STEP):
            terms = order[at: at + STEP]
            sums = sums + query[terms] @ self.columns[np.ix_(terms, rows)]
            alive = sums + left[min(at + STEP, len(order))] >= threshold
            rows, sums = rows[alive], sums[alive]
        return rows, sums


def _met(queries: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """The k best rows of one shard for each query of one block."""
    out: list[tuple] = []
    if len(queries) and len(rows):
        asked, terms = _matrices(queries, rows)
        index = Index(terms)
        marks, copies = (rows.column(c).to_numpy() for c in ("mark", "copies"))
        null = rows.column("vec_id").is_null().to_numpy()
        ids = rows.column("vec_id").fill_null(0).to_numpy()
        own = [queries.column(c).to_numpy() for c in ("mark", "vec_id", "copies")]
        firsts = asked @ index.first.T
        for q in range(len(asked)):
            # Of the rows equal to the query one is its own.
            many = copies - ((marks == own[0][q]) & (ids == own[1][q]) & ~null)
            seen = firsts[q][many[:FIRST_ROWS] > 0]
            threshold = np.sort(seen)[-k] if len(seen) >= k else -_far(asked[q], index)
            found, scores = index.search(asked[q], threshold)
            order = np.lexsort([ids[found], null[found], _falling(scores)])
            taken = 0
            for f in order.tolist():
                for _ in range(min(int(many[found[f]]), k - taken)):
                    taken += 1
                    out.append((*(int(x[q]) for x in own),
                                None if null[found[f]] else int(ids[found[f]]),
                                min(max(int(scores[f]), _LEAST), _MOST)))
                if taken == k:
                    break
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
    return pa.table([pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)],
                    names=["query_mark", "query_id", "copies", "vec_id", "score"])


def _matrices(queries: pa.Table, rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Doubles where they hold every partial sum exactly, else Python's integers."""
    both = (queries, rows)
    width = max(pc.max(pc.list_value_length(t.column("terms"))).as_py() for t in both)
    asked, terms = (_matrix(t, width, np.float64) for t in both)
    if (np.abs(asked).max(0) * np.abs(terms).max(0)).sum() < 1 << 52:
        return asked, terms
    return tuple(_matrix(t, width, object) for t in both)


def _falling(scores: np.ndarray) -> np.ndarray:
    """Ranks of the scores, the highest first, equal ones alike."""
    return -np.unique(scores, return_inverse=True)[1]


def _far(query: np.ndarray, index: Index):
    """A number below minus which no score lies."""
    return np.maximum(np.abs(query * index.highest), np.abs(query * index.lowest)).sum() + 1
