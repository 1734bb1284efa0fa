"""From raw documents to a mix for training, in five stages.

Each stage takes all rows its predecessor kept and all but the last return the columns
of `documents`. run() writes the result of each stage and reads it for the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docledger.llm import decontaminate, line_dedup, mixing, ngram_join, toxicity
from docledger.llm.queries import table
from docledger.sources.workspace import persisted

#: Near-duplicates in the pipeline: shingles of five words, similarity 4/5 or more.
NEAR = {"width": 5, "num": 4, "den": 5}


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold, by a model of all labelled rows."""
    return toxicity.below_threshold(
        docs, toxicity.learned(docs, table(spark, sf_dir, "labels")))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less the lines that an earlier one has; n_chars follows."""
    text = line_dedup.without_repeats(docs)
    if "n_chars" in docs.columns:
        text = text.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return text


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document, by id and text, of every group of near-duplicates.

    Rows count one by one: rows that share an id, or have none, are told apart by
    their texts, and of rows equal in both one stays, the least by its columns.
    """
    others, copies = (persisted(x, "repeats") for x in ngram_join.repeats(docs, **NEAR))

    def same(frame: DataFrame, other: DataFrame) -> Column:
        return frame["doc_id"].eqNullSafe(other["doc_id"]) & (
            F.xxhash64(frame["text"]) == other["version"])

    kept = docs.join(others, same(docs, others), "left_anti")
    if copies.isEmpty():
        return kept
    rows = docs.join(copies, same(docs, copies), "left_semi").select(
        F.struct(*docs.columns).alias("row"))
    least = rows.groupBy("row.doc_id", F.xxhash64("row.text")).agg(F.min("row").alias("row"))
    return kept.join(copies, same(kept, copies), "left_anti").unionByName(least.select("row.*"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    hit = decontaminate.keyed_contamination(docs, table(spark, sf_dir, "benchmark")).where(
        "n_hit > 0").select("key").distinct()
    return docs.join(hit, decontaminate.row_key() == hit["key"], "left_anti")


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document how many copies the mix takes; 0 leaves it out."""
    return mixing.mixed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("line dedup", without_repeated_lines),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("mixing", mixed_sources),
]

#: The toxicity model is fitted step by step, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = persisted(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
