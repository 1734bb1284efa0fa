"""Benchmark decontamination: which words of which documents repeat an item's window.

A window is `size` consecutive words of an item, or the whole item if it is shorter.
It occurs in a document only if all its shingles do, one after another, so

* documents are reduced to their runs of shingles that some item has (told by a
  bitmap of fixed size), long enough to hold a window; texts are not shuffled;
* of a window's shingles only the rarest one, counted over all documents, is joined:
  for containment of the whole window a prefix of one token is enough;
* the shingle's place in window and run bounds where the window would start, and the
  words there are compared in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docledger.llm import words
from docledger.sources.workspace import persisted

WINDOW = 10
SHINGLE = 3
#: Bits of the bitmap of item shingles; a fuller one only lets more runs through.
BITS = 24
_WORD_BYTES = words.LETTERS_DIGITS


def _rows(column: pa.Array) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray, int, int]]:
    """(bytes, starts, ends, hashes, first, last word) of every row."""
    for _, data, offsets in words.pieces(column):
        starts, ends, first = words.word_spans(data, offsets, _WORD_BYTES)
        hashes = words.word_hashes(data, starts, ends)
        text = data.tobytes()
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            yield text, starts, ends, hashes, a, b


def _codes(hashes: np.ndarray, width: int) -> np.ndarray:
    """The bits of all shingles of `width` words; none if there are fewer words."""
    if len(hashes) < width:
        return np.empty(0, np.int64)
    gram, _ = words.grams(hashes, np.array([0, len(hashes)]), width)
    return (gram >> np.uint64(64 - BITS)).astype(np.int64)


def windows(benchmark: DataFrame, size: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """item_id, n_words, text, shingles (in order), bits: one row per window.

    Items with a null id or text, or without words, have none.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for item, (text, starts, ends, hashes, a, b) in zip(
                    batch.column("item_id").to_pylist(), _rows(batch.column("text"))):
                own = [text[s:e].decode("utf-8", "replace")
                       for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist())]
                long = min(size, len(own))
                width = min(shingle, long)
                for at in range(len(own) - long + 1 if own else 0):
                    window = own[at: at + long]
                    out.append({
                        "item_id": item, "n_words": long, "text": " ".join(window),
                        "shingles": [" ".join(window[i: i + width])
                                     for i in range(long - width + 1)],
                        "bits": _codes(hashes[a + at: a + at + long], width).tolist()})
            yield pa.RecordBatch.from_pylist(out, pa.schema([
                ("item_id", pa.int64()), ("n_words", pa.int32()), ("text", pa.string()),
                ("shingles", pa.list_(pa.string())), ("bits", pa.list_(pa.int64()))]))

    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(
        F.col("item_id").cast("long").alias("item_id"), "text")
    return items.mapInArrow(
        cut, "item_id long, n_words int, text string, shingles array<string>, bits array<long>")


def _bitmap(item_windows: DataFrame) -> np.ndarray:
    rows = item_windows.select(F.explode("bits").alias("bit")).groupBy(
        (F.col("bit") / 32768).cast("int").alias("block")).agg(
        F.bitmap_construct_agg(F.col("bit") % 32768).alias("bits")).collect()
    out = np.zeros(((1 << BITS) // 32768, 4096), np.uint8)
    for row in rows:  # 2^BITS / 32768 rows at most
        out[row["block"]] = np.frombuffer(bytes(row["bits"]), np.uint8)
    return np.unpackbits(out.reshape(-1), bitorder="little").astype(bool)


def row_key() -> Column:
    """Rows that repeat a doc_id, or have none, are told apart by their texts."""
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
                       F.xxhash64("text"), F.coalesce(F.length("text"), F.lit(-1)))


def _runs(documents: DataFrame, known: np.ndarray, sizes: list[int], shingle: int) -> DataFrame:
    """doc_id, key, n_words, runs array<struct<start, width, text>> of every row."""
    widths = {}
    for long in sizes:
        width = min(shingle, long)
        widths[width] = min(widths.get(width, long), long)
    shared = documents.sparkSession.sparkContext.broadcast(np.packbits(known))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            counts, runs = [], []
            for text, starts, ends, hashes, a, b in _rows(batch.column("text")):
                counts.append(b - a)
                own = []
                for width, least in widths.items():
                    hit = known[_codes(hashes[a:b], width)]
                    if not hit.any():
                        continue
                    turns = np.flatnonzero(np.diff(np.concatenate([[0], hit, [0]])))
                    for s, e in zip(turns[::2].tolist(), turns[1::2].tolist()):
                        if e - s >= least - width + 1:
                            to = e + width - 1
                            own.append({"start": s, "width": width, "text": b" ".join(
                                text[x:y] for x, y in zip(starts[a + s: a + to].tolist(),
                                                          ends[a + s: a + to].tolist())
                            ).decode("utf-8", "replace")})
                runs.append(own)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("key"), pa.array(counts, pa.int64()),
                pa.array(runs, pa.list_(pa.struct([
                    ("start", pa.int32()), ("width", pa.int32()), ("text", pa.string())]))),
            ], ["doc_id", "key", "n_words", "runs"])

    return persisted(documents.select("doc_id", row_key().alias("key"), "text").mapInArrow(
        find, "doc_id long, key string, n_words long, "
              "runs array<struct<start: int, width: int, text: string>>"), "runs")


def occurrences(found: DataFrame, item_windows: DataFrame, size: int) -> DataFrame:
    """key, item_id, start, n_words: every place of every window.

    A shingle travels with the words around it that a window of `size` could cover,
    never with its whole run.
    """
    runs = found.select("key", F.explode("runs").alias("run")).select(
        "key", "run.start", "run.width", F.split("run.text", " ").alias("words"))
    left = lambda i: F.least(i, F.lit(size) - F.col("width"))
    shingles = runs.select("key", "start", F.explode(F.transform(
        F.sequence(F.lit(0), F.size("words") - F.col("width")),
        lambda i: F.struct(
            i.alias("pos"), left(i).alias("left"),
            F.array_join(F.slice("words", i + 1, F.col("width")), " ").alias("shingle"),
            F.slice("words", i - left(i) + 1, left(i) + size).alias("around")),
    )).alias("s")).select("key", "start", "s.*")
    counts = shingles.groupBy("shingle").count()
    each = item_windows.select("item_id", "n_words", "text", F.posexplode("shingles").alias(
        "place", "shingle"))
    # The inner join is right: a window with a shingle that no run has cannot occur.
    rarest = each.join(counts, "shingle").groupBy("item_id", "n_words", "text").agg(
        F.min_by(F.struct("place", "shingle"), F.struct("count", "shingle", "place")).alias("p"),
    ).select("item_id", F.col("n_words").alias("long"), F.col("text").alias("window"),
             "p.place", "p.shingle")
    begin = F.col("left") - F.col("place")
    met = shingles.join(rarest, "shingle").where(
        (begin >= 0) & (begin + F.col("long") <= F.size("around"))
    ).where(F.array_join(F.slice("around", begin + 1, F.col("long")), " ") == F.col("window"))
    return met.select(
        "key", "item_id", (F.col("start") + F.col("pos") - F.col("place")).alias("start"),
        F.col("long").alias("n_words"))


def contamination(
    documents: DataFrame, benchmark: DataFrame, size: int = WINDOW, shingle: int = SHINGLE,
) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted ids as strings) for every row.

    n_hit counts the words inside any occurrence of any window. Words are runs of
    ASCII letters, digits and non-ASCII characters after lower-casing A-Z; a null
    text has none. Rows that repeat a doc_id each have a result by their own text,
    repeated items count once. Other columns are ignored.
    """
    return keyed_contamination(documents, benchmark, size, shingle).drop("key")


def keyed_contamination(
    documents: DataFrame, benchmark: DataFrame, size: int = WINDOW, shingle: int = SHINGLE,
) -> DataFrame:
    """The columns of `contamination` and the row_key of each row."""
    item_windows = persisted(windows(benchmark, size, shingle), "windows")
    sizes = [r["n_words"] for r in item_windows.select("n_words").distinct().collect()]
    found = _runs(documents, _bitmap(item_windows), sizes, shingle)
    met = persisted(occurrences(found, item_windows, size), "met")
    upto = W.partitionBy("key").orderBy("start", "n_words")
    before = F.max(F.col("start") + F.col("n_words")).over(
        upto.rowsBetween(W.unboundedPreceding, -1))
    spans = met.select("key", "start", "n_words").distinct().withColumn("before", before)
    fresh = F.col("start") + F.col("n_words") - F.greatest(
        F.col("start"), F.coalesce("before", F.lit(0)))
    hits = spans.groupBy("key").agg(F.sum(F.greatest(fresh, F.lit(0))).cast("long").alias("n_hit"))
    items = met.groupBy("key").agg(
        F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    return found.select("doc_id", "key", "n_words").join(
        hits.join(items, "key"), "key", "left",
    ).select("key", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
             F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def digest(rows: DataFrame) -> DataFrame:
    """The digest columns of `contamination` rows."""
    return rows.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))
