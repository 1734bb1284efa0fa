"""Language by compression: the language whose dictionary packs a text best is its own.

Per language, whole texts of a bounded sample are joined to a raw-content zstandard
dictionary. Every text is then compressed against each; the sizes are the evidence,
and the margin between the best two says how sure it is. Texts are reduced to
lower-case letters and single spaces first, and compressed in short blocks: over a
long block a text would explain itself whatever the dictionary.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docledger.sources.workspace import persisted

#: Most bytes of a language's dictionary, and of all together: with many languages each
#: has its share. Texts are added whole until it is full, the first one cut to it.
DICTIONARY_BYTES, ALL_BYTES = 1 << 17, 1 << 24
#: Most rows per language from which a dictionary is filled, by a hash of the id, and of
#: all together; each language has one at least.
FIT_ROWS, ALL_ROWS = 400, 80_000
#: Bytes that are compressed at once, all of a text's blocks counting.
BLOCK = 1024
LEVEL, SHORTEST_MATCH = 6, 4
#: Texts up to so many bytes are compressed at the level that also uses short matches.
SHORT, SHORT_LEVEL = 256, 19
#: A margin (share of the second-best size) below which a text is marked as rejected.
NARROW = 0.005
UNKNOWN = "und"
_LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_LETTER = regex.compile(r"\p{L}")


def learned(documents: DataFrame) -> DataFrame:
    """lang, rows, dictionary binary: fitted on a bounded sample of rows with text and lang.

    Every language is learned. Rows are thinned by a hash of the id in proportion to the
    language's row count before they are ranked, so no task sees all rows of a language.
    Empty or null texts and null languages teach nothing.
    """
    rows = documents.where("lang IS NOT NULL AND text IS NOT NULL AND text <> ''").select(
        "lang", "text", F.xxhash64("doc_id", "lang").alias("place"))
    counts = persisted(rows.groupBy(F.col("lang").alias("name")).agg(
        F.count(F.lit(1)).alias("rows")), "languages")
    languages = max(counts.count(), 1)
    most = max(1, min(FIT_ROWS, ALL_ROWS // languages))
    size = max(1, min(DICTIONARY_BYTES, ALL_BYTES // languages))
    kept = F.pmod("place", F.lit(1_000_000)) * F.col("rows") < 3 * most * 1_000_000
    rank = F.row_number().over(W.partitionBy("lang").orderBy("place", F.xxhash64("text")))
    sample = rows.join(counts, F.col("lang") == F.col("name")).where(kept).withColumn(
        "rank", rank).where(F.col("rank") <= most)
    return sample.select("lang", "rows", "rank", "text").groupBy("lang").applyInArrow(
        lambda group: _joined(group, size), "lang string, rows long, dictionary binary")


def _joined(group: pa.Table, most: int) -> pa.Table:
    parts, size = [], 0
    for row in group.sort_by([("rank", "ascending"), ("text", "ascending")]).to_pylist():
        text = _reduced(row["text"])
        if size + len(text) > most:
            if parts:
                continue
            text = text[:most]
        parts.append(text)
        size += len(text)
    return pa.table({
        "lang": group.column("lang").slice(0, 1).cast(pa.string()),
        "rows": group.column("rows").slice(0, 1),
        "dictionary": pa.array([b"".join(parts)], pa.binary()),
    })


def predicted(documents: DataFrame, dictionaries: DataFrame) -> DataFrame:
    """doc_id, lang_pred, score 0..1, rejected: one row per input row.

    A null text or one without a letter is `und` with score 0, as is every text if
    nothing was learned. Texts of up to SHORT bytes, reduced, are packed at a level that also
    finds short matches, as there is little else in them. Ties go to the more frequent
    language, then by name. `rejected` marks texts with a margin below NARROW; it leaves
    lang_pred as it is. Ids may be null or repeat; of other columns nothing is read.
    """
    pairs = [(r["lang"], bytes(r["dictionary"])) for r in
             dictionaries.orderBy(F.desc("rows"), "lang").collect()]
    # ALL_BYTES at most, and a byte for each language.
    shared = documents.sparkSession.sparkContext.broadcast(pairs)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        usual = [(lang, _packer(raw, LEVEL, SHORTEST_MATCH)) for lang, raw in shared.value]
        short = [(lang, _packer(raw, SHORT_LEVEL, 3)) for lang, raw in shared.value]
        for batch in batches:
            out = [_best(text, usual, short) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([o[0] for o in out], pa.string()),
                pa.array([o[1] for o in out], pa.float64()),
                pa.array([o[2] for o in out], pa.bool_()),
            ], ["doc_id", "lang_pred", "score", "rejected"])

    return documents.select("doc_id", "text").mapInArrow(
        predict, "doc_id long, lang_pred string, score double, rejected boolean")


def _reduced(text: str) -> bytes:
    return b" " + b" ".join(text.lower().encode().translate(_LETTERS).split()) + b" "


def _packer(raw: bytes, level: int, shortest: int) -> zstandard.ZstdCompressor:
    known = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    how = zstandard.ZstdCompressionParameters.from_level(
        level, min_match=shortest, write_checksum=False, write_content_size=False,
        write_dict_id=False)
    known.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=known, compression_params=how)


def _best(text: str | None, usual: list, short: list) -> tuple[str, float, bool]:
    if not usual or not text or not _LETTER.search(text):
        return UNKNOWN, 0.0, True
    raw = _reduced(text)
    blocks = [raw[at: at + BLOCK] for at in range(0, len(raw), BLOCK)]
    own = short if len(raw) <= SHORT else usual
    sizes = sorted((sum(len(packer.compress(x)) for x in blocks), place)
                   for place, (_, packer) in enumerate(own))
    margin = 1.0 if len(sizes) == 1 else (sizes[1][0] - sizes[0][0]) / sizes[1][0]
    return own[sizes[0][1]][0], margin, margin < NARROW


def held_out() -> Column:
    """Whether a row is kept from the fit: a quarter of all ids, and every null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4, F.lit(2)) == 2


def identified(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected by dictionaries of the other rows."""
    result = predicted(documents, learned(documents.where(~held_out())))
    return result.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
