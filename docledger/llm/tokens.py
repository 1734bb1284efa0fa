"""Cross-tokenizer alignment: which tokens of B stand where tokens of A stand.

Texts are encoded by both tokenizers and cut into groups where tokens of both end. In
almost all one-to-one groups the two tokens have the same bytes, so an array from ids
of A to ids of B with the same bytes settles them: they are counted in one vector as
long as the vocabulary of A. The pairs of all other groups are counted by a shuffle.

Both tokenizers are checked, when loaded, for never joining what a space parts; then
text is encoded in segments, and the alignments of segments are kept for a while.
Otherwise each text is one segment.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docledger.llm import words
from docledger.sources.workspace import persisted

#: Characters of segments whose alignments a worker keeps.
KEPT_CHARS = 1 << 23
#: A pair with this share of all irregular links, or more, is known to every task.
HEAVY = 1 / 65_536
#: Pre-tokens of byte-level tokenizers: a fixed pattern of the public file format.
WORDS = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
# White space as both file formats see it, without the separators U+001C to U+001F. A
# segment ends before white space that starts with a space or a line feed.
_WORD, _BLANKS, _OTHER = r"[\S\x1c-\x1f]+", r"[^\S\x1c-\x1f]*", r"[^\S\x1c-\x1f \n]"
_SEGMENT = re.compile(
    rf"{_BLANKS}{_WORD}(?:{_OTHER}{_BLANKS}{_WORD})*(?:{_OTHER}{_BLANKS}\Z)?"
    r"|[^\S\x1c-\x1f]+").findall
_BLANK = re.compile(r"[^\S\x1c-\x1f]").match
_EMPTY = np.zeros(0, np.int64)


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _ByteLevel:
    """Ids and bytes of a byte-level BPE kept in a `tokenizers` JSON file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        known = _byte_of_char()
        special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        vocabulary = spec["model"]["vocab"] | special
        self.bytes: list[bytes] = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes[i] = (token.encode() if token in special
                             else bytes(known[c] for c in token))
        before = spec.get("pre_tokenizer") or {}
        self.parts = (spec.get("normalizer") is None and before.get("type") == "ByteLevel"
                      and before.get("use_regex", True) and not before.get("add_prefix_space"))
        ranked = self.parts and self._ranked(spec["model"], vocabulary)
        self._encode = self._by_rank(vocabulary, special) if ranked else self._by_file(path)

    def _ranked(self, model: dict, vocabulary: dict[str, int]) -> bool:
        """Whether ids grow with the order of merges, so that ids can serve as ranks."""
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        made = [vocabulary["".join(x)] for x in pairs]
        single = [i for i, x in enumerate(self.bytes) if len(x) == 1]
        order = [*single, *made]
        return (len(single) == 256 and order == list(range(len(order)))
                and len(vocabulary) - len(order) <= 1
                and not model.get("ignore_merges") and not model.get("dropout"))

    def _by_rank(self, vocabulary: dict[str, int], special: dict[str, int]):
        import tiktoken

        ranks = {self.bytes[i]: i for t, i in vocabulary.items() if t not in special}
        coder = tiktoken.Encoding("a", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [coder.encode_ordinary(t) for t in texts]

    def _by_file(self, path: str):
        from tokenizers import Tokenizer

        coder = Tokenizer.from_file(path)
        coder.encode_special_tokens = True
        return lambda texts: [
            coder.encode(t, add_special_tokens=False).ids for t in texts]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._encode(texts)


class _Pieces:
    """Ids and bytes of a sentencepiece model; it puts a space before each text itself."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self._model.get_piece_size())
        texts = [self._model.id_to_piece(i) for i in ids]
        plain = [not (self._model.is_byte(i) or self._model.is_control(i)
                      or self._model.is_unknown(i) or self._model.is_unused(i)) for i in ids]
        self.byte = [self._model.is_byte(i) for i in ids]
        self.bytes = [
            bytes([int(t[3:-1], 16)]) if self.byte[i]
            else t.replace("▁", " ").encode() if plain[i] else b"" for i, t in zip(ids, texts)]
        self.space = self._model.piece_to_id("▁")
        gaps = [[c == "▁" for c in t] for t, ok in zip(texts, plain) if ok]
        self.parts = (
            texts[self.space] == "▁" and self._model.encode("a", out_type=str)[0][0] == "▁"
            and not any(c in " \n" for t, ok in zip(texts, plain) if ok for c in t)
            and not any(b and not a for g in gaps for a, b in zip(g, g[1:])))

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._model.encode(texts, num_threads=1)


class Aligner:
    """Alignments of segments, kept in arrays; `codes` gives each text as segment numbers.

    Of segment s: counts[s] are its tokens of A and B, its groups and whether its bytes
    came back, joined[s] its groups as text, and links[starts[s]: starts[s + 1]] the
    pairs of its groups as a * size of B + b.
    """

    def __init__(self, a: _ByteLevel, b: _Pieces) -> None:
        self.a, self.b = a, b
        self.size = len(b.bytes)
        self.lengths = [np.array([len(x) for x in y.bytes], np.int64) for y in (a, b)]
        by_bytes = {x: i for i, x in enumerate(b.bytes) if x and b.byte[i]}
        by_bytes |= {x: i for i, x in enumerate(b.bytes) if x and not b.byte[i]}
        #: For each id of A the id of B with the same bytes, or -1.
        self.identity = np.array([by_bytes.get(x, -1) for x in a.bytes], np.int64)
        self._names = np.array([f"{i}{mark}" for i in range(max(len(a.bytes), self.size))
                                for mark in ",|;"], object)
        self.parts = a.parts and b.parts
        self.clear()

    def clear(self) -> None:
        self._number: dict[str, int] = {}
        self._chars = 0
        self._counts = np.zeros((1 << 12, 4), np.int64)
        self._starts = np.zeros((1 << 12) + 1, np.int64)
        self._links = np.zeros(1 << 14, np.int64)
        self.joined: list[str] = []

    @property
    def full(self) -> bool:
        return self._chars > KEPT_CHARS

    def segments(self, text: str) -> list[str]:
        """Segments of space + text. A single space before a word is left off."""
        text = " " + text
        if not self.parts:
            return [text]
        count = text.count(" ") + text.count("\n")
        words = text.split()
        if len(words) == count == len(text) - sum(map(len, words)):
            return text.replace("\n", " \n").split(" ")[1:]
        return [x[1:] if x[0] == " " and len(x) > 1 and not _BLANK(x[1]) else x
                for x in _SEGMENT(text)]

    def codes(self, texts: list[list[str]]) -> list[list[int]]:
        number = self._number
        new = {x for text in texts for x in text if x not in number}
        if new:
            self._add(sorted(new))
        return [list(map(number.__getitem__, text)) for text in texts]

    def _add(self, keys: list[str]) -> None:
        whole = [k if _BLANK(k) else " " + k for k in keys]
        a = self.a.encode(whole)
        # B adds a space itself: one in front is left off, before other white space
        # the piece that it adds is taken off again.
        b = self.b.encode([w[1:] if w[0] == " " else w for w in whole])
        for i, w in enumerate(whole):
            if w[0] != " ":
                b[i] = b[i][1:] if b[i][:1] == [self.b.space] else []
            elif not b[i] and len(w) == 1:
                b[i] = [self.b.space]
        ab, bb = self.a.bytes, self.b.bytes
        counts = np.zeros((len(keys), 4), np.int64)
        for i, (w, x, y) in enumerate(zip(whole, a, b)):
            counts[i, 3] = b"".join([ab[t] for t in x]) == w.encode() == b"".join(
                [bb[t] for t in y])
        good = np.flatnonzero(counts[:, 3])
        texts = [""] * len(keys)
        links = _EMPTY
        if len(good):
            counts[good, :3], links, named = self._aligned(
                [a[i] for i in good], [b[i] for i in good])
            at = 0
            for i, n in zip(good.tolist(), (counts[good, 0] + counts[good, 1]).tolist()):
                texts[i] = "".join(named[at: at + n])[:-1]
                at += n
        self._append(counts, links)
        base = len(self.joined)
        for i, k in enumerate(keys):
            self._number[k] = base + i
            self._chars += len(k) + 16
        self.joined += texts

    def _append(self, counts: np.ndarray, links: np.ndarray) -> None:
        n, new = len(self.joined), len(counts)
        used = int(self._starts[n])
        while n + new > len(self._counts):
            self._counts = np.concatenate([self._counts, np.zeros_like(self._counts)])
        if len(self._starts) < len(self._counts) + 1:
            grown = np.zeros(len(self._counts) + 1, np.int64)
            grown[: n + 1] = self._starts[: n + 1]
            self._starts = grown
        while used + len(links) > len(self._links):
            self._links = np.concatenate([self._links, np.zeros_like(self._links)])
        self._counts[n: n + new] = counts
        self._starts[n + 1: n + new + 1] = used + np.cumsum(counts[:, 2])
        self._links[used: used + len(links)] = links

    def _aligned(self, a: list[list[int]], b: list[list[int]]):
        """Of segments with equal bytes: counts of tokens and groups, links, names in order."""
        many_a, many_b = (np.array([len(x) for x in y]) for y in (a, b))
        x, y = (np.fromiter(chain.from_iterable(z), np.int64) for z in (a, b))
        end_x, end_y = np.cumsum(self.lengths[0][x]), np.cumsum(self.lengths[1][y])
        both = np.intersect1d(end_x, end_y, assume_unique=True)
        group_x, group_y = np.searchsorted(both, end_x), np.searchsorted(both, end_y)
        last_x, last_y = both[group_x] == end_x, both[group_y] == end_y
        links = x[last_x] * self.size + y[last_y]
        closes = np.cumsum(many_a)
        segment = np.searchsorted(closes, np.flatnonzero(last_x), side="right")
        groups = np.bincount(segment, minlength=len(a))
        order = np.argsort(np.concatenate([group_x * 2, group_y * 2 + 1]), kind="stable")
        marks = np.concatenate([x * 3 + last_x, y * 3 + last_y * 2])
        return np.stack([many_a, many_b, groups], 1), links, self._names[marks[order]].tolist()

    def counts(self, codes: np.ndarray) -> np.ndarray:
        return self._counts[codes]

    def links(self, codes: np.ndarray) -> np.ndarray:
        """The links of the segments, in order."""
        many = self._counts[codes, 2]
        begins = np.cumsum(many) - many
        at = np.arange(int(many.sum())) + np.repeat(self._starts[codes] - begins, many)
        return self._links[at]


@lru_cache(maxsize=1)
def aligner(a_path: str, b_path: str) -> Aligner:
    """One per worker, so that later tasks find segments of earlier ones."""
    return Aligner(_ByteLevel(a_path), _Pieces(b_path))


class _Counts:
    """Links of one task: a vector by ids of A for identical tokens, a table for the rest."""

    #: Distinct irregular pairs that are held before they are written.
    MOST = 1 << 19

    def __init__(self, a: Aligner) -> None:
        self.a, self.vector = a, np.zeros(len(a.identity), np.int64)
        self.pairs, self.times = [_EMPTY], [_EMPTY]
        self.held = 0

    def add(self, links: np.ndarray, times: np.ndarray) -> None:
        left, right = np.divmod(links, self.a.size)
        same = self.a.identity[left] == right
        np.add.at(self.vector, left[same], times[same])
        self.pairs.append(links[~same])
        self.times.append(times[~same])
        self.held += int((~same).sum())

    def full(self) -> bool:
        if self.held > 4 * self.MOST:
            self._shrink()
        return self.held > self.MOST

    def _shrink(self) -> None:
        pairs, at = np.unique(np.concatenate(self.pairs), return_inverse=True)
        times = np.zeros(len(pairs), np.int64)
        np.add.at(times, at, np.concatenate(self.times))
        self.pairs, self.times, self.held = [pairs], [times], len(pairs)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        """(links, times) of all so far, which starts anew."""
        self._shrink()
        left = np.flatnonzero(self.vector)
        out = (np.concatenate([left * self.a.size + self.a.identity[left], self.pairs[0]]),
               np.concatenate([self.vector[left], self.times[0]]))
        self.vector[:] = 0
        self.pairs, self.times, self.held = [_EMPTY], [_EMPTY], 0
        return out


def _link_type(work: Aligner) -> tuple[str, pa.DataType]:
    small = len(work.identity) * work.size < 1 << 31
    return ("int", pa.int32()) if small else ("long", pa.int64())


def coded(documents: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row per document with its distinct links, and rows with the counts of each task.

    A link is a number, a * size of B + b. Rows that are no documents hold counted links
    of many documents: `links` and how often each occurred.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    link = _link_type(aligner(a_path, b_path))[0]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = aligner(a_path, b_path)
        counts = _Counts(work)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for lo, hi in words.ranges(texts):
                ids = batch.column("doc_id").slice(lo, hi - lo)
                yield _coded_piece(work, counts, texts[lo:hi], ids, row)
                row += hi - lo
                if counts.full():
                    yield _counted(work, counts, ids.type)
            id_type = batch.schema.field("doc_id").type
        if row & ((1 << 33) - 1):
            yield _counted(work, counts, id_type)

    return documents.select("doc_id", "text").mapInArrow(
        code, f"row long, doc_id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, "
        f"links array<{link}>, times array<int>, is_doc boolean")


def _coded_piece(work: Aligner, counts: _Counts, texts: list[str | None], ids: pa.Array,
                 row: int) -> pa.RecordBatch:
    if work.full:
        work.clear()
    codes = work.codes([work.segments(t) if t else [] for t in texts])
    many, shas, links, times, sizes = [], [], [], [], []
    for c in codes:
        at = np.array(c, np.int64)
        n_a, n_b, n_groups, good = work.counts(at).sum(0).tolist()
        if not c or good < len(c):
            many.append((0, 0, 0))
            shas.append("")
            sizes.append(0)
            continue
        many.append((n_a, n_b, n_groups))
        shas.append(hashlib.sha256(";".join([work.joined[i] for i in c]).encode()).hexdigest())
        found, often = np.unique(work.links(at), return_counts=True)
        links.append(found)
        times.append(often)
        sizes.append(len(found))
    all_links, all_times = (np.concatenate([_EMPTY, *x]) for x in (links, times))
    counts.add(all_links, all_times)
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    n = len(texts)
    return pa.RecordBatch.from_arrays([
        pa.array(np.arange(row, row + n)), ids,
        *[pa.array([m[k] for m in many], pa.int64()) for k in range(3)],
        pa.array(shas, pa.string()),
        pa.ListArray.from_arrays(offsets, pa.array(all_links, _link_type(work)[1])),
        pa.ListArray.from_arrays(offsets, pa.array(all_times.astype(np.int32))),
        pa.array([True] * n, pa.bool_())],
        ["row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links", "times", "is_doc"])


def _counted(work: Aligner, counts: _Counts, id_type: pa.DataType) -> pa.RecordBatch:
    links, times = counts.take()
    cuts = list(range(0, len(links), 1 << 16)) + [len(links)]
    offsets, n = pa.array(cuts, pa.int32()), len(cuts) - 1
    # A task counts a link less than 2^31 times before it is written: it holds less text.
    return pa.RecordBatch.from_arrays([
        pa.nulls(n, pa.int64()), pa.nulls(n, id_type), *[pa.nulls(n, pa.int64())] * 3,
        pa.nulls(n, pa.string()),
        pa.ListArray.from_arrays(offsets, pa.array(links, _link_type(work)[1])),
        pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32))),
        pa.array([False] * n, pa.bool_())],
        ["row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links", "times", "is_doc"])


def pair_counts(coded_rows: DataFrame, size_b: int) -> DataFrame:
    """link, b, n and whether no other link of its B id has a higher n."""
    each = coded_rows.where("NOT is_doc").select(
        F.explode(F.arrays_zip("links", "times")).alias("x")).select("x.links", "x.times")
    pairs = each.groupBy(F.col("links").alias("link")).agg(
        F.sum(F.col("times").cast("long")).alias("n"))
    pairs = persisted(pairs.select("link", F.pmod("link", F.lit(size_b)).alias("b"), "n"), "pairs")
    highest = pairs.groupBy(F.col("b").alias("best_b")).agg(F.max("n").alias("highest"))
    # One row per id of B at most.
    return pairs.join(F.broadcast(highest), F.col("b") == F.col("best_b")).select(
        "link", "b", "n", (F.col("n") == F.col("highest")).alias("best"))


def aligned(documents: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: one row per row.

    `documents` has doc_id and text, other columns are not read; ids may be null or
    repeat. Texts that are null or empty, or whose tokens' bytes differ from space +
    text in A or B, have zeros and an empty groups_sha256. Special tokens' strings are
    plain text. An empty table gives an empty result. Memory follows the longest text.
    """
    spark = documents.sparkSession
    work = aligner(a_path, b_path)  # for its sizes and the identity map
    size_b, identity = work.size, work.identity
    rows = persisted(coded(documents, a_path, b_path), "coded")
    pairs = persisted(pair_counts(rows, size_b), "pair-counts")
    link_ddl, link_type = _link_type(work)
    same = spark.createDataFrame(
        [(i * size_b + b,) for i, b in enumerate(identity.tolist()) if b >= 0],
        f"same_link {link_ddl}")
    regular = pairs.join(F.broadcast(same), F.col("link") == F.col("same_link"), "left_semi")
    odd = pairs.join(F.broadcast(same), F.col("link") == F.col("same_link"), "left_anti")
    total = odd.agg(F.sum("n")).first()[0] or 0
    # At most one row per id of A, and 1 / HEAVY irregular pairs.
    known = regular.select("link", "n", "best").unionByName(
        odd.where(F.col("n") >= F.lit(total * HEAVY)).select("link", "n", "best")).toArrow()
    order = np.argsort(known.column("link").to_numpy())
    shared = spark.sparkContext.broadcast(tuple(
        known.column(c).to_numpy(zero_copy_only=False)[order] for c in ("link", "n", "best")))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links, n, best = shared.value
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                yield _summed(part, links, n, best, link_type)

    summed = rows.where("is_doc").select(
        "row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links", "times").mapInArrow(
        sums, f"row long, doc_id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, "
        f"n_best long, count_sum long, rare array<{link_ddl}>, rare_times array<int>")
    docs = persisted(summed, "summed")
    rare = docs.select("row", F.explode(F.arrays_zip("rare", "rare_times")).alias("x")).select(
        "row", F.col("x.rare").alias("rare_link"), F.col("x.rare_times").alias("often"))
    met = rare.join(pairs.select("link", "n", "best"), F.col("rare_link") == F.col("link"))
    more = met.groupBy(F.col("row").alias("met_row")).agg(
        F.sum(F.when(F.col("best"), F.col("often")).otherwise(0)).alias("more_best"),
        F.sum(F.col("often") * F.col("n")).alias("more_sum"))
    return docs.join(more, F.col("row") == F.col("met_row"), "left").select(
        "doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"),
        (F.col("n_best") + F.coalesce("more_best", F.lit(0))).cast("long").alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).cast("long").alias("count_sum"),
        "groups_sha256")


def _summed(part: pa.RecordBatch, links: np.ndarray, n: np.ndarray, best: np.ndarray,
            link_type: pa.DataType) -> pa.RecordBatch:
    column = part.column("links")
    found = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    often = part.column("times").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.array([len(x) if x is not None else 0 for x in column], np.int64)
    owner = np.repeat(np.arange(len(part)), sizes)
    at = np.searchsorted(links, found)
    at[at == len(links)] = 0
    hit = links[at] == found if len(links) else np.zeros(len(found), bool)
    count_sum, n_best = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
    if len(links):
        np.add.at(count_sum, owner[hit], n[at[hit]] * often[hit])
        np.add.at(n_best, owner[hit], best[at[hit]] * often[hit])
    offsets = pa.array(np.concatenate(
        [[0], np.cumsum(np.bincount(owner[~hit], minlength=len(part)))]), pa.int32())
    return pa.RecordBatch.from_arrays([
        *[part.column(c) for c in ("row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256")],
        pa.array(n_best), pa.array(count_sum),
        pa.ListArray.from_arrays(offsets, pa.array(found[~hit], link_type)),
        pa.ListArray.from_arrays(offsets, pa.array(often[~hit].astype(np.int32)))],
        ["row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "n_best", "count_sum",
         "rare", "rare_times"])
