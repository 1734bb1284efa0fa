"""Which rows of a large table may have one of many keys, without moving the table.

A join shuffles every row of the table to find the few whose key is asked for. Here the
keys set bits in 2^25 bins: a table of 4 MB at most, whatever the number of keys, which is
kept, so that the optimizer sees its size and broadcasts it. A row whose bit is not set
surely has none of the keys; only the others go on to the exact join. With very many keys
more rows go on, and the results stay the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docledger.sources.workspace import persisted

_BINS = 1 << 25
#: Longs of 64 bins in a row of the table.
_WORDS = 512


def _bin(key: str):
    return F.pmod(F.xxhash64(key), F.lit(_BINS))


def _bits(keys: DataFrame, key: str) -> DataFrame:
    """(_part, _words): the bins of the keys, as rows of 512 longs."""
    words = keys.where(F.col(key).isNotNull()).select(_bin(key).alias("bin")).selectExpr(
        "shiftright(bin, 6) AS word", "shiftleft(1L, CAST(bin & 63 AS INT)) AS bit").groupBy(
        "word").agg(F.bit_or("bit").alias("bits"))
    parts = words.groupBy(F.floor(F.col("word") / _WORDS).alias("_part")).agg(
        F.map_from_entries(F.collect_list(F.struct(
            (F.col("word") % _WORDS).cast("int").alias("at"), "bits"))).alias("found"))
    return parts.select("_part", F.expr(
        f"transform(sequence(0, {_WORDS - 1}), i -> coalesce(found[i], 0L))").alias("_words"))


def split_by_keys(df: DataFrame, key: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(others, near): rows of `df` that have none of the keys, and all the rest.

    `keys` has a column of the name `key`; it is read now. Among `near` are all rows with
    one of the keys and a few more. A row without a key is in one of the two.
    """
    kind = df.schema[key].dataType
    bits = persisted(_bits(keys.select(F.col(key).cast(kind).alias(key)), key), "key-bits")
    seen = df.withColumn("_bin", _bin(key)).withColumn(
        "_part", F.floor(F.col("_bin") / (64 * _WORDS))).join(bits, "_part", "left").withColumn(
        "_near", F.expr(f"coalesce(shiftright(_words[CAST(shiftright(_bin, 6) % {_WORDS} AS INT)], "
                        "CAST(_bin & 63 AS INT)) & 1L, 0L) = 1L"))
    return seen.where(~F.col("_near")).select(*df.columns), seen.where("_near").select(*df.columns)


def with_keys(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows of `df` with one of the keys, as a semi join gives them."""
    return split_by_keys(df, key, keys)[1].join(keys.select(key), key, "left_semi")
