"""Runs of words that repeat with a period, found in tiles of every octave of periods.

A run of period q is a stretch of words equal to those q further, at least 3 q long in
these equalities. Octave k holds the periods 2^k to 2^(k+1) - 1. A document is cut into
tiles, with an overlap that no part of a run can slip through: the lower octaves share
tiles, each higher octave has tiles of its own, in proportion to its periods. A tile is
solved alone: from boundaries every 2^k words, Z-values (how many words from there on
equal those q further, and how many before) give for each period of the octave how far
the equalities reach. The pieces so found meet by document and period and are stitched
where they touch.

Tiles of documents up to LONG words are solved in the task that reads the document;
those of longer ones are rows of their own and dealt over all tasks. Both ways give the
same pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from docledger.llm import words
from docledger.sources.workspace import persisted

#: Octaves below this one share their tiles.
BASE = 10
#: A run has at least LEAST words and FOLD periods.
LEAST, FOLD = 6, 4
#: Words of a document whose tiles are still solved where it is read.
LONG = 1 << 16


def with_planted_periods(documents: DataFrame) -> DataFrame:
    """doc_id, text, fold: where fold is not null, words from fold % n on repeat.

    With h the crc32 of the decimal doc_id, fold is floor(h / 10) where h % 10 is 0. A
    null doc_id has none.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    return documents.select("doc_id", "text", F.when(
        h % 10 == 0, F.floor(h / 10)).cast("long").alias("fold"))


def planted(n: int, fold: int | None) -> np.ndarray:
    """For each of n words the number of the original word that stands there."""
    at = np.arange(n)
    if fold is None or not n:
        return at
    a = fold % n
    p = 1 + (n - a) // (3 + fold % 8)
    return np.where(at < a, at, a + (at - a) % p)


def tiles(n: int) -> list[tuple[int, int, int, int]]:
    """(low, high, start, stop) of all tiles of n words: words start to stop - 1 for the
    octaves low to high - 1.

    With 2^k the least period of the highest octave, neighbours share the equalities of
    3 * 2^k words, of all periods of the tile. So of a stretch of that many equalities
    every tile it reaches into has either 3 * 2^k or a part that the tile before has.
    """
    out = []
    top = max(n // FOLD, 1).bit_length()  # the octaves of periods up to n / 4
    bounds = [(0, min(BASE, top)), *((k, k + 1) for k in range(BASE, top))]
    for low, high in bounds if n >= LEAST else []:
        unit = 1 << (high - 1) if high > BASE else 1 << (BASE - 1)
        own, more = 8 * unit, 3 * unit + 2 * unit
        for start in range(0, n, own):
            stop = min(n, start + own + more)
            # The last words alone cannot begin a piece that the tile before lacks.
            if start == 0 or n - start > more:
                out.append((low, high, start, stop))
    return out


def z_values(levels: list[np.ndarray], left: np.ndarray, right: np.ndarray,
             back: bool) -> np.ndarray:
    """How many words from left and right on are equal; backwards: before left and right.

    levels[k][i] numbers the 2^k words from i on, equal words having equal numbers.
    """
    n = len(levels[0])
    left, right, reach = left.copy(), right.copy(), np.zeros(len(left), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        size, names = 1 << k, levels[k]
        while True:
            a, b = (left - size, right - size) if back else (left, right)
            inside = (a >= 0) & (b + size <= n)
            same = np.zeros(len(left), bool)
            same[inside] = names[a[inside]] == names[b[inside]]
            if not same.any():
                break
            step = np.where(same, size, 0)
            reach += step
            left, right = (left - step, right - step) if back else (left + step, right + step)
            if k < len(levels) - 1:
                break  # once a level below the highest, which may repeat
    return reach


def _named(values: np.ndarray) -> np.ndarray:
    """Numbers from 0 on, equal ones for equal values."""
    return np.unique(values, return_inverse=True)[1].astype(np.int64)


def solved(codes: np.ndarray, low: int, high: int) -> np.ndarray:
    """Rows (period, begin, stop): stretches of 3 * 2^k or more equalities, each whole.

    codes are numbers of words; periods are those of octaves low to high - 1. An
    equality of period q at i says that words i and i + q are the same.
    """
    n = len(codes)
    out = [np.zeros((0, 3), np.int64)]
    levels = [_named(codes)]
    for k in range(high):
        size = 1 << k
        if n < FOLD * size:
            break
        if k:
            names, half = levels[-1], size >> 1
            levels.append(_named(names[:-half] * n + names[half:]))
        names = levels[k]
        if int(names.max()) + 1 == len(names):
            break  # no 2^k words occur twice, so no longer ones do
        if k < low:
            continue
        # A stretch of 3 * 2^k equalities holds the 2^k of them after some boundary.
        edges = np.arange(0, len(names) - size, size)
        others = edges[:, None] + np.arange(size, 2 * size)
        inside = others < len(names)
        hit = (names[np.where(inside, others, 0)] == names[edges][:, None]) & inside
        q, at = np.nonzero(hit.T)
        if not len(q):
            continue
        edge, q = edges[at], q + size
        first = np.r_[True, (np.diff(q) != 0) | (np.diff(edge) != size)]
        last = np.r_[first[1:], True]
        begin, end, q = edge[first], edge[last] + size, q[first]
        begin = begin - z_values(levels, begin, begin + q, True)
        stop = end + z_values(levels, end, end + q, False)
        long = stop - begin >= 3 * size
        out.append(np.stack([q, begin, stop], 1)[long])
    return np.concatenate(out)


_ROWS = ("row long, doc_id {kind}, n long, words binary, plain_sha256 string, "
         "pieces array<struct<period: long, begin: long, stop: long>>, "
         "low int, high int, start long, codes array<int>")
_NAMES = ["row", "doc_id", "n", "words", "plain_sha256", "pieces", "low", "high", "start", "codes"]
_PIECES = pa.list_(pa.struct(
    [("period", pa.int64()), ("begin", pa.int64()), ("stop", pa.int64())]))


def _coded(text: str | None, fold: int | None) -> tuple[list[bytes], np.ndarray]:
    """The words, after planting, and their numbers."""
    found = (text or "").encode().split()  # at 0x20 and 0x09 to 0x0D
    numbers: dict[bytes, int] = {}
    codes = np.array([numbers.setdefault(w, len(numbers)) for w in found], np.int64)
    if fold is not None and found:
        at = planted(len(found), fold)
        codes = codes[at]
        found = [found[i] for i in at.tolist()]
    return found, codes


def cut(documents: DataFrame, long: int) -> DataFrame:
    """A row per document, with its pieces if it has up to `long` words, and rows of tiles.

    Words travel only with documents in which a piece was found or may be.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            texts = batch.column("text").to_pylist()
            folds = batch.column("fold").to_pylist()
            ids = batch.column("doc_id")
            for lo, hi in words.ranges(texts):
                n, kept, plain, pieces, own = [], [], [], [], []
                for i in range(lo, hi):
                    found, codes = _coded(texts[i], folds[i])
                    joined = b" ".join(found)
                    n.append(len(found))
                    plain.append(hashlib.sha256(joined).hexdigest())
                    if len(found) > long:
                        pieces.append([])
                        own += [(row + i - lo, *t[:3], codes[t[2]: t[3]])
                                for t in tiles(len(found))]
                    else:
                        pieces.append([
                            {"period": q, "begin": a + start, "stop": b + start}
                            for low, high, start, stop in tiles(len(found))
                            for q, a, b in solved(codes[start:stop], low, high).tolist()])
                    kept.append(joined if pieces[-1] or len(found) > long else None)
                size = hi - lo
                yield pa.RecordBatch.from_arrays([
                    pa.array(range(row, row + size), pa.int64()), ids.slice(lo, size),
                    pa.array(n, pa.int64()), pa.array(kept, pa.binary()),
                    pa.array(plain, pa.string()), pa.array(pieces, _PIECES),
                    pa.nulls(size, pa.int32()), pa.nulls(size, pa.int32()),
                    pa.nulls(size, pa.int64()), pa.nulls(size, pa.list_(pa.int32()))], _NAMES)
                for r, low, high, start, codes in own:
                    yield pa.RecordBatch.from_arrays([
                        pa.array([r], pa.int64()), pa.nulls(1, ids.type), pa.nulls(1, pa.int64()),
                        pa.nulls(1, pa.binary()), pa.nulls(1, pa.string()), pa.nulls(1, _PIECES),
                        pa.array([low], pa.int32()), pa.array([high], pa.int32()),
                        pa.array([start], pa.int64()),
                        pa.array([codes.astype(np.int32)], pa.list_(pa.int32()))], _NAMES)
                row += size

    return documents.select("doc_id", "text", "fold").mapInArrow(rows, _ROWS.format(kind=kind))


def _solved_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for tile in range(len(batch)):
            row, low, high, start = (
                batch.column(c)[tile].as_py() for c in ("row", "low", "high", "start"))
            codes = batch.column("codes")[tile].values.to_numpy(zero_copy_only=False)
            found = solved(codes, low, high)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(found), row), pa.int64()), pa.array(found[:, 0]),
                pa.array(found[:, 1] + start), pa.array(found[:, 2] + start)],
                ["row", "period", "begin", "stop"])


def stitched(pieces: DataFrame) -> DataFrame:
    """row, start, length, period: the runs made of the pieces that touch.

    A stretch that has several periods keeps the smallest.
    """
    by = W.partitionBy("row", "period").orderBy("begin", "stop")
    reached = F.max("stop").over(by.rowsBetween(W.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("begin") <= F.col("reached"), 0).otherwise(1)).over(
        by.rowsBetween(W.unboundedPreceding, W.currentRow))
    whole = pieces.withColumn("reached", reached).withColumn("island", island).groupBy(
        "row", "period", "island").agg(F.min("begin").alias("start"), F.max("stop").alias("stop"))
    runs = whole.select("row", "start", (F.col("stop") - F.col("start") + F.col("period")).alias(
        "length"), "period").where(
        F.col("length") >= F.greatest(F.lit(LEAST), FOLD * F.col("period")))
    return runs.groupBy("row", "start", "length").agg(F.min("period").alias("period"))


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        columns = (batch.column(c) for c in ("plain_sha256", "words", "runs"))
        for plain, text, runs in zip(*columns):
            runs = sorted((r["start"], r["period"], r["length"]) for r in runs.as_py() or [])
            if not runs:
                out.append((0, None, None, None, None, hashlib.sha256().hexdigest(), plain.as_py()))
                continue
            found = text.as_py().split(b" ")
            drop = np.zeros(len(found) + 1, np.int64)
            best = runs[0]
            for start, period, length in runs:
                drop[start + period] += 1
                drop[start + length] -= 1
                if length * best[1] > best[2] * period:
                    best = start, period, length
            gone = np.cumsum(drop)
            lines = "".join(f"{s},{n},{q}\n" for s, q, n in runs)
            out.append((
                len(runs), best[0], best[2], best[1], 1000 * best[2] // best[1],
                hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(
                    [w for w, x in zip(found, gone.tolist()) if not x])).hexdigest()))
        kinds = [pa.int64()] * 5 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"),
             *[pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)]],
            ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256",
             "collapsed_sha256"])


def runs(documents: DataFrame, long: int = LONG) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256.

    One row per row of `documents` (doc_id, text, fold; other columns are not read). A
    null text, one without words or without runs has no runs: n_runs 0, four nulls, the
    hash of nothing and that of all words. Ids may be null or repeat. Of runs with the
    greatest length / period, compared as fractions, the first is shown, then the one of
    the smallest period. An empty table gives an empty result.
    """
    rows = persisted(cut(documents, long), "cut-words")
    docs, parts = rows.where("n IS NOT NULL"), rows.where("n IS NULL")
    dealt = parts.select("row", "low", "high", "start", "codes").repartition("row", "low", "start")
    pieces = docs.select("row", F.explode("pieces").alias("x")).select("row", "x.*").unionByName(
        dealt.mapInArrow(_solved_tiles, "row long, period long, begin long, stop long"))
    found = stitched(pieces).groupBy(F.col("row").alias("run_row")).agg(
        F.collect_list(F.struct("start", "length", "period")).alias("runs"))
    kind = documents.schema["doc_id"].dataType.simpleString()
    return docs.select("row", "doc_id", "plain_sha256", "words").join(
        found, F.col("row") == F.col("run_row"), "left").select(
        "doc_id", "plain_sha256", "words", "runs").mapInArrow(
        _digested, f"doc_id {kind}, n_runs long, start long, length long, period long, "
        "exponent_milli long, runs_sha256 string, collapsed_sha256 string")
