"""Exact similarity self-join of many token sets, rarest tokens first.

An item (a document, or a line of one) is a set of 64-bit shingle hashes. Items with
equal sets form a class, known by two 64-bit sums over its tokens. Classes meet on
their prefixes: of n tokens in order of rarity, two sets of Jaccard t or more share
one of the first n - ceil(t * n) + 1. Then length, positional and suffix filters
prune, and each pair that is left is verified once on the whole sets.

* Rarity comes from counts of all items' tokens in bins, about two bins a token as far
  as MOST_BITS allows. What travels is a bit per bin, whether it was met twice, and a
  coarse table of the highest counts. Any order that all items share gives whole
  results; the counts make it a good one. A token met once is first in order and is
  not sent on, as it can meet nothing: texts like no other send nothing at all.
* Tokenising is cheap and texts are large, so texts are read again rather than
  shuffled: prefixes, and later the sets of classes that have a candidate, are
  emitted by passes over the documents. What a pass needs to know travels as a
  bitmap or sketch of fixed size.
* In a block of classes sharing a prefix token, candidates are first the pairs with
  one hub, the class with the fewest rarer tokens before that one: copies of a text
  are nearest to what they were copied from. `rest_pairs` then finds all other pairs
  which the caller still has to know.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from docledger.llm import words
from docledger.sources.workspace import persisted

#: Bins are 2^LEAST_BITS to 2^MOST_BITS; past that, more prefixes travel than meet.
LEAST_BITS, MOST_BITS, COARSE_BITS = 22, 31, 20
BLOCKS = 64
#: Tokens that a task gathers before it sends their bins on.
GATHERED = 1 << 20
#: Bits of the bitmap of classes whose sets are wanted; more only add false alarms.
WANTED_BITS = 26
#: Rows of texts that go to Python at once.
BATCH_ROWS = 512
#: Classes that a task remembers to have sent; more only mean that some are sent again.
REMEMBERED = 1 << 18
#: A token met more often is dealt to several hubs, one for so many items each.
HUB_ITEMS = 8192
_MOST_SETS = 1 << 16


@dataclass(frozen=True)
class Join:
    """What is compared: `width`-word shingles, Jaccard of `num` / `den` or more."""

    width: int
    num: int
    den: int
    lines: bool = False

    def needed(self, n):
        """ceil(t * n), of numbers or arrays."""
        return -(-n * self.num // self.den)

    def meets(self, n):
        """Whether a set of n tokens can be similar to one that is not equal to it."""
        overlap = -(-2 * n * self.num // (self.num + self.den))
        return (self.needed(n) < n) | (n * self.den // self.num > n) | (overlap < n)


@dataclass
class Sets:
    """Items of a run of rows: row and line of each, tokens[first[i]:first[i+1]]."""

    row: np.ndarray
    line: np.ndarray
    tokens: np.ndarray
    first: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.first)

    def item(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.row)), self.sizes)


def _sets(column: pa.Array, join: Join) -> Iterator[Sets]:
    """The distinct tokens of all items, in order of their values."""
    for row, data, offsets in words.pieces(column):
        rows = np.arange(row, row + len(offsets) - 1)
        line = np.zeros(len(rows), np.int64)
        if join.lines:
            offsets, firsts = words.lines_of(data, offsets)
            counts = np.diff(firsts)
            line = np.arange(len(offsets) - 1) - np.repeat(firsts[:-1], counts)
            rows = np.repeat(rows, counts)
        starts, ends, first = words.word_spans(data, offsets, words.BETWEEN_SPACES)
        some = np.diff(first) >= (1 if join.lines else 0)
        hashes = words.word_hashes(data, starts, ends)
        tokens, begin = words.grams(hashes, first, join.width)
        chosen = np.flatnonzero(some)
        for at in range(0, len(chosen), _MOST_SETS):
            own = chosen[at: at + _MOST_SETS]
            sizes = (begin[own + 1] - begin[own])
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            where = np.arange(bounds[-1]) + np.repeat(begin[own] - bounds[:-1], sizes)
            item = np.repeat(np.arange(len(own), dtype=np.uint64), sizes)
            values = tokens[where]
            values = values[np.argsort((item << np.uint64(48)) | (values >> np.uint64(16)))]
            kept = np.ones(len(values), bool)
            kept[1:] = (values[1:] != values[:-1]) | (item[1:] != item[:-1])
            left = np.bincount(item[kept].astype(np.int64), minlength=len(own))
            yield Sets(rows[own], line[own], values[kept],
                       np.concatenate([[0], np.cumsum(left)]))


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums modulo 2^64 per item; an item without tokens has 0."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(values, dtype=np.uint64)])
    return (total[first[1:]] - total[first[:-1]]).view(np.int64)


def _digests(sets: Sets) -> tuple[np.ndarray, np.ndarray]:
    return (_sums(words.mixed(sets.tokens), sets.first),
            _sums(words.mixed(sets.tokens ^ np.uint64(0xA5A5F00DD00F5A5A)), sets.first))


def _unseen(a: np.ndarray, b: np.ndarray, seen: set) -> np.ndarray:
    """Which items are the first of their class in this task, as far as it remembers."""
    if len(seen) > REMEMBERED:
        seen.clear()
    fresh = np.zeros(len(a), bool)
    for i, key in enumerate((a * 3 ^ b).tolist()):
        if key not in seen:
            seen.add(key)
            fresh[i] = True
    return fresh


def _read_through(df: DataFrame, label: str) -> DataFrame:
    """Write what a pass over the texts makes, with few texts in memory at a time.

    The batch size is a setting of the session, which has its own value back afterwards.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = conf.get(name)
    conf.set(name, min(int(own), BATCH_ROWS) if int(own) > 0 else BATCH_ROWS)
    try:
        return persisted(df, label)
    finally:
        conf.set(name, own)


def _packed(rows: np.ndarray) -> pa.Array:
    return pa.array(rows.astype(np.int64))


def bits_for(documents: DataFrame) -> int:
    """Bits of a bin's number: two bins for each six characters of text."""
    chars = documents.agg(F.sum(F.length("text"))).first()[0] or 0
    return min(max(LEAST_BITS, (chars // 3).bit_length()), MOST_BITS)


def version() -> Column:
    """Tells rows that share a doc_id, null included, apart by their texts."""
    return F.xxhash64("text")


def described(documents: DataFrame, join: Join, bits: int) -> tuple[DataFrame, DataFrame]:
    """(items, bins), from one pass over the texts, written once.

    items: doc_id, version, line, n, a, b for every item, empty ones included. bins: the bins
    of the tokens of all sets that can meet others, as compressed gaps per task and
    block; a class counts once a task.
    """

    def gaps(tokens: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
        at = np.sort(np.concatenate(tokens) >> np.uint64(64 - bits)) if tokens else []
        edges = np.searchsorted(at, np.arange(BLOCKS + 1, dtype=np.uint64)
                                << np.uint64(bits - BLOCKS.bit_length() + 1))
        for i in range(BLOCKS):
            own = at[edges[i]: edges[i + 1]]
            if len(own):
                own = own - (np.uint64(i) << np.uint64(bits - BLOCKS.bit_length() + 1))
                yield i, zlib.compress(np.diff(
                    own.astype(np.uint32), prepend=np.uint32(0)).tobytes(), 1)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "version", "line", "n", "a", "b", "block", "gaps"]
        tokens: list[np.ndarray] = []
        seen: set = set()

        def sent() -> pa.RecordBatch:
            rows = list(gaps(tokens))
            none = pa.nulls(len(rows), pa.int64())
            tokens.clear()
            return pa.RecordBatch.from_arrays([
                none, none, none, none, none, none, pa.array([x[0] for x in rows], pa.int32()),
                pa.array([x[1] for x in rows], pa.binary())], names)

        for batch in batches:
            ids, versions = batch.column("doc_id"), batch.column("version")
            for sets in _sets(batch.column("text"), join):
                a, b = _digests(sets)
                fresh = _unseen(a, b, seen) & join.meets(sets.sizes)
                tokens.append(sets.tokens[np.repeat(fresh, sets.sizes)])
                none = pa.nulls(len(a), pa.int32()), pa.nulls(len(a), pa.binary())
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(sets.row)), versions.take(pa.array(sets.row)),
                    _packed(sets.line), _packed(sets.sizes),
                    pa.array(a), pa.array(b), *none], names)
                if sum(map(len, tokens)) > GATHERED:
                    yield sent()
        yield sent()

    written = _read_through(documents.select("doc_id", "text", version().alias("version")).mapInArrow(
        describe, "doc_id long, version long, line long, n long, a long, b long, block int, gaps binary"),
        "items")
    return (written.where("block IS NULL").select("doc_id", "version", "line", "n", "a", "b"),
            written.where("block IS NOT NULL").select("block", "gaps"))


@dataclass(frozen=True)
class Rarity:
    """Bits of the bins met twice or more; half binary logarithms of high counts."""

    bits: int
    twice: np.ndarray
    coarse: np.ndarray

    def steps(self, tokens: np.ndarray) -> np.ndarray:
        """0 for tokens met once, else a step that grows with the count."""
        at = (tokens >> np.uint64(64 - self.bits)).astype(np.int64)
        met = (self.twice[at >> 3] >> (at & 7).astype(np.uint8)) & 1
        return met * self.coarse[at >> (self.bits - COARSE_BITS)]


def rarity(bins: DataFrame, bits: int) -> Rarity:
    """Counts the bins; 2^bits / 8 + 2^COARSE_BITS bytes reach the driver."""
    each, fold = (1 << bits) // BLOCKS, 1 << (bits - COARSE_BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, gaps in zip(batch.column("block").to_pylist(),
                                   batch.column("gaps").to_pylist()):
                own = counts.setdefault(block, np.zeros(each, np.uint32))
                np.add.at(own, np.cumsum(np.frombuffer(zlib.decompress(gaps), np.uint32),
                                         dtype=np.int64), np.uint32(1))
        twice = [np.packbits(v > 1, bitorder="little").tobytes() for v in counts.values()]
        high = [np.ceil(2 * np.log2(v.reshape(-1, fold).max(1) + 1.0)).astype(np.uint8).tobytes()
                for v in counts.values()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.int32()), pa.array(twice, pa.binary()),
             pa.array(high, pa.binary())], ["block", "twice", "high"])

    counted = bins.repartition(BLOCKS, "block").mapInArrow(
        count, "block int, twice binary, high binary")
    twice = np.zeros((BLOCKS, each // 8), np.uint8)
    coarse = np.zeros((BLOCKS, each // fold), np.uint8)
    for row in counted.toLocalIterator():  # BLOCKS rows
        twice[row["block"]] = np.frombuffer(bytes(row["twice"]), np.uint8)
        coarse[row["block"]] = np.frombuffer(bytes(row["high"]), np.uint8)
    return Rarity(bits, twice.reshape(-1), coarse.reshape(-1))


def prefixes(documents: DataFrame, join: Join, order: Rarity) -> DataFrame:
    """token, salt (null if not dealt), doc_id, a, b, n, pos, tail: every class's prefix,
    without the tokens that were met once.

    `tail` has the set's token counts in eight hash classes, a byte each. A task
    emits a class once; the same class may come from several tasks.
    """
    shared = documents.sparkSession.sparkContext.broadcast(order)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity, seen = shared.value, set()
        for batch in batches:
            ids = batch.column("doc_id")
            for sets in _sets(batch.column("text"), join):
                a, b = _digests(sets)
                sizes, item = sets.sizes, sets.item()
                kinds = (sets.tokens & np.uint64(7)).astype(np.int64)
                each = np.bincount(item * 8 + kinds, minlength=8 * len(sizes)).reshape(-1, 8)
                tail = np.minimum(each, 127).astype(np.int8).view(np.int64)[:, 0]
                step = rarity.steps(sets.tokens)
                order = np.argsort(item * 256 + step, kind="stable")
                token, step = sets.tokens[order], step[order].astype(np.float64)
                place = np.arange(len(item)) - sets.first[item]
                fresh = _unseen(a, b, seen) & join.meets(sizes)
                own = fresh[item] & (step > 0) & (place < (sizes - join.needed(sizes) + 1)[item])
                item, token = item[own], token[own]
                hubs = np.ceil(2.0 ** (step[own] / 2) / HUB_ITEMS).astype(np.int64)
                salt = ((a[item] & 0x7FFFFFFF) % hubs).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    pa.array(token.view(np.int64)),
                    pa.array(salt, mask=hubs == 1),
                    ids.take(pa.array(sets.row[item])), pa.array(a[item]), pa.array(b[item]),
                    pa.array(sizes[item].astype(np.int32)),
                    pa.array(place[own].astype(np.int32)), pa.array(tail[item]),
                ], ["token", "salt", "doc_id", "a", "b", "n", "pos", "tail"])

    return documents.select("doc_id", "text").mapInArrow(
        emit, "token long, salt int, doc_id long, a long, b long, n int, pos int, tail long")


_MEMBER = ("a", "b", "n", "pos", "tail")


def blocks(prefix_rows: DataFrame, join: Join) -> DataFrame:
    """Prefix rows of tokens that several classes share, with the block's hub; written.

    Sets of very different sizes cannot match, so each band of sizes has its own hub.
    `few` marks blocks of two rows in one band: their only pair is that of the hub.
    """
    block = W.partitionBy("token", "salt")
    band = F.floor(F.log("n") / F.lit(math.log(join.den / join.num)))
    near = W.partitionBy("token", "salt", "band")
    key, dealt = F.struct("a", "b"), F.col("salt").isNotNull()
    hub = F.min(F.struct("pos", "doc_id", *[F.col(c).alias(f"hub_{c}") for c in _MEMBER]))
    return _read_through(
        prefix_rows.withColumn("band", band)
        .withColumn("rows", F.count(F.lit(1)).over(block))
        .withColumn("several", F.min(key).over(block) != F.max(key).over(block))
        .where(dealt | F.col("several"))
        .withColumn("hub", hub.over(near))
        .withColumn("few", ~dealt & (F.col("rows") == 2) & (F.count(F.lit(1)).over(near) == 2))
        .select("token", *_MEMBER, "few", F.struct(*[
            F.col(f"hub.hub_{c}").alias(c) for c in _MEMBER]).alias("hub")), "blocks")


def members(block_rows: DataFrame) -> DataFrame:
    """token, a, b, n, pos, tail, shared, before of blocks with pairs without a hub.

    `shared` counts the tokens of a class's prefix that other prefixes have too,
    `before` those of them that precede this one: no other token before this one can
    be common to two classes that meet here.
    """
    rows = block_rows.select("token", *_MEMBER, "few").distinct()
    own = W.partitionBy("a", "b")
    return rows.withColumns({
        "shared": F.count(F.lit(1)).over(own),
        "before": F.row_number().over(own.orderBy("pos")) - 1,
    }).where("NOT few").drop("few")


def _possible(
    join: Join, x: Callable[[str], Column], y: Callable[[str], Column], before: str = "pos",
) -> Column:
    """Length, positional and suffix filters for x and y meeting at a token."""
    overlap = _overlap(join, x("n"), y("n"))
    length = (F.least(x("n"), y("n")) * join.den >= F.greatest(x("n"), y("n")) * join.num)
    rest = F.least(x("n") - x("pos"), y("n") - y("pos"))
    positional = F.least(x(before), y(before)) + rest >= overlap
    # What a hash class has more in one set than in the other is not shared.
    byte = lambda v, i: F.shiftright(v, 8 * i).bitwiseAND(F.lit(255))
    apart = sum((F.abs(byte(x("tail"), i) - byte(y("tail"), i)) for i in range(8)), F.lit(0))
    return length & positional & (x("n") + y("n") - apart >= 2 * overlap)


def _overlap(join: Join, n: Column, m: Column) -> Column:
    """Fewest common tokens of sets of n and m tokens that are similar enough."""
    return F.ceil((n + m).cast("long") * join.num / (join.num + join.den) - F.lit(1e-9))


def hub_pairs(block_rows: DataFrame, join: Join) -> DataFrame:
    """u, v (structs of a, b; u < v): candidates of every member with its hub."""
    own, hub = F.struct("a", "b"), F.struct("hub.a", "hub.b")
    return block_rows.where(own != hub).where(
        _possible(join, F.col, lambda c: F.col(f"hub.{c}"))
    ).select(F.least(own, hub).alias("u"), F.greatest(own, hub).alias("v")).distinct()


def rest_pairs(left: DataFrame, right: DataFrame, join: Join, wanted: Column) -> DataFrame:
    """u, v: candidates between block rows `left` and `right` (aliases x and y).

    Beyond the filters at one token, a pair must share so many prefix tokens that
    what follows the prefixes can make up for the others.
    """
    own, other = F.struct("x.a", "x.b"), F.struct("y.a", "y.b")
    after = F.greatest(*[
        F.ceil(F.col(f"{s}.n").cast("long") * join.num / join.den - F.lit(1e-9)) - 1 for s in "xy"])
    lacking = _overlap(join, F.col("x.n"), F.col("y.n")) - after
    met = left.alias("x").join(
        right.alias("y"),
        (F.col("x.token") == F.col("y.token")) & (own != other) & wanted
        & (F.least("x.shared", "y.shared") >= lacking)
        & _possible(join, lambda c: F.col(f"x.{c}"), lambda c: F.col(f"y.{c}"), "before"),
    )
    return met.groupBy(F.least(own, other).alias("u"), F.greatest(own, other).alias("v")).agg(
        F.count_distinct("x.token").alias("common"), F.first(lacking).alias("lacking"),
    ).where("common >= lacking").select("u", "v")


def _bitmap(rows: DataFrame, column: str) -> bytes:
    """Bits of the 64-bit hashes in `column`, at most 2^WANTED_BITS of them."""
    bit = F.shiftrightunsigned(column, 64 - WANTED_BITS)
    rows = rows.groupBy((bit / 32768).cast("int").alias("block")).agg(
        F.bitmap_construct_agg(bit % 32768).alias("bits")).collect()
    out = np.zeros((1 << WANTED_BITS) // 8, np.uint8)
    for row in rows:  # 2^WANTED_BITS / 32768 rows
        out[row["block"] * 4096: row["block"] * 4096 + 4096] = np.frombuffer(
            bytes(row["bits"]), np.uint8)
    return zlib.compress(out.tobytes(), 1)


def _marked(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    bit = (values.view(np.uint64) >> np.uint64(64 - WANTED_BITS)).astype(np.int64)
    return ((bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).astype(bool)


def classes_of(pairs: DataFrame) -> DataFrame:
    """a, b of the classes in u, v."""
    return pairs.select("u.*").unionByName(pairs.select("v.*")).distinct()


def wanted_sets(documents: DataFrame, join: Join, homes: DataFrame) -> DataFrame:
    """a, b, tokens: the sets of the classes in `homes`, read from the texts again.

    `homes` names for each class the version of one document that has it; only those
    documents, and what shares their bits, are taken apart.
    """
    shared = documents.sparkSession.sparkContext.broadcast(
        (_bitmap(homes, "a"), _bitmap(homes, "version")))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, texts = (np.frombuffer(zlib.decompress(x), np.uint8) for x in shared.value)
        seen: set = set()
        for batch in batches:
            read = _marked(texts, batch.column("version").to_numpy())
            column = batch.column("text").filter(pa.array(read))
            for sets in _sets(column, join):
                a, b = _digests(sets)
                own = np.flatnonzero(_marked(classes, a) & (sets.sizes > 0))
                own = own[_unseen(a[own], b[own], seen)]
                signed = sets.tokens.view(np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array(a[own]), pa.array(b[own]),
                    pa.array([signed[sets.first[i]: sets.first[i + 1]] for i in own],
                             pa.list_(pa.int64()))], ["a", "b", "tokens"])

    emitted = documents.select("text", version().alias("version")).mapInArrow(
        emit, "a long, b long, tokens array<long>")
    return emitted.join(homes, ["a", "b"], "left_semi").dropDuplicates(["a", "b"])


def verified(documents: DataFrame, join: Join, pairs: DataFrame, homes: DataFrame) -> DataFrame:
    """u, v of those pairs whose whole sets are similar enough; written.

    `homes` is a written table of a, b and the version of a document that has such a set,
    for the classes of the pairs.
    """
    sets = _read_through(wanted_sets(documents, join, homes), "sets")
    keyed = sets.select(F.struct("a", "b").alias("key"), "tokens")
    both = pairs.join(keyed.select(F.col("key").alias("u"), F.col("tokens").alias("x")), "u").join(
        keyed.select(F.col("key").alias("v"), F.col("tokens").alias("y")), "v")
    common = F.size(F.array_intersect("x", "y")).cast("long")
    union = F.size("x") + F.size("y") - F.col("common")
    return persisted(
        both.select("u", "v", common.alias("common"), "x", "y").where(
            F.col("common") * join.den >= union * join.num).select("u", "v"), "links")
