"""Line dedup: a line goes if an earlier line of any document is nearly the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docledger.llm import setjoin
from docledger.sources.workspace import persisted

#: Tokens are five-word shingles; similar means a Jaccard similarity of 4/5 or more.
JOIN = setjoin.Join(width=5, num=4, den=5, lines=True)


def removed_lines(documents: DataFrame) -> DataFrame:
    """doc_id, version, line: the lines (from 0) that have a match earlier in that order.

    A match counts whether or not it is removed itself. Lines of one to four words are
    one short shingle and match lines of the same words; lines without words always
    stay. Rows with the same doc_id are documents of
    their own, told apart by their texts; rows equal in both are one document. A null
    doc_id comes before all others.
    """
    bits = setjoin.bits_for(documents)
    items, bins = setjoin.described(documents, JOIN, bits)
    order = setjoin.rarity(bins, bits)
    classes = persisted(items.groupBy("a", "b").agg(
        F.min(F.struct("doc_id", "version", "line")).alias("first"), F.count(F.lit(1)).alias("copies")),
        "classes")
    rows = setjoin.blocks(setjoin.prefixes(documents, JOIN, order), JOIN)
    tried = persisted(setjoin.hub_pairs(rows, JOIN), "pairs")
    gone = _matched_later(documents, tried, classes)

    more = persisted(
        _unsettled(rows, classes, gone).join(tried, ["u", "v"], "left_anti"), "pairs")
    if not more.isEmpty():
        gone = gone.unionByName(_matched_later(documents, more, classes)).distinct()
    settled = classes.join(gone.withColumn("gone", F.lit(True)), ["a", "b"], "left").where(
        "gone OR copies > 1").select("a", "b", "first", F.coalesce("gone", F.lit(False)).alias("gone"))
    return items.join(settled, ["a", "b"]).where(
        F.col("gone") | ~F.struct("doc_id", "version", "line").eqNullSafe(F.col("first"))
    ).select("doc_id", "version", "line")


def _matched_later(documents: DataFrame, pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b of the class of each similar pair whose first line comes later."""
    own = persisted(classes.join(setjoin.classes_of(pairs), ["a", "b"], "left_semi").select(
        "a", "b", "first", F.col("first.version").alias("version")), "homes")
    links = setjoin.verified(documents, JOIN, pairs, own)
    first = own.select(F.struct("a", "b").alias("key"), "first")
    both = links.join(first.select(F.col("key").alias("u"), F.col("first").alias("fu")), "u").join(
        first.select(F.col("key").alias("v"), F.col("first").alias("fv")), "v")
    later = F.when(F.col("fu") < F.col("fv"), F.col("v")).otherwise(F.col("u"))
    return persisted(both.select(later.alias("k")).select("k.a", "k.b").distinct(), "gone")


def _unsettled(rows: DataFrame, classes: DataFrame, gone: DataFrame) -> DataFrame:
    """Candidates of the classes that no hub has removed with all earlier ones."""
    members = setjoin.members(rows)
    dated = persisted(
        members.join(classes.select("a", "b", "first"), ["a", "b"])
        .join(gone.withColumn("gone", F.lit(True)), ["a", "b"], "left"), "dated")
    left = dated.where("gone IS NULL")
    return setjoin.rest_pairs(left, dated, JOIN, F.col("y.first") < F.col("x.first"))


def deduplicated(documents: DataFrame) -> DataFrame:
    """The documents with matched lines taken out of `text`, and removed_lines.

    All columns and rows stay; `removed_lines` (array<long>, sorted, empty if none)
    is added, in place of one that is there. A document may be left with an empty
    text; a null text stays null.
    """
    joined, text, gone = _with_removed(documents)
    return joined.select(*[
        text.alias("text") if c == "text" else documents[c]
        for c in documents.columns if c != "removed_lines"], gone.alias("removed_lines"))


def without_repeats(documents: DataFrame) -> DataFrame:
    """The same documents and columns, with matched lines taken out of `text`."""
    joined, text, _ = _with_removed(documents)
    return joined.select(*[
        text.alias("text") if c == "text" else documents[c] for c in documents.columns])


def _with_removed(documents: DataFrame) -> tuple[DataFrame, Column, Column]:
    """(documents with the lines to remove, the text without them, those lines)."""
    lists = removed_lines(documents).groupBy("doc_id", "version").agg(
        F.sort_array(F.collect_set("line")).alias("lines"))
    joined = documents.join(
        lists, documents["doc_id"].eqNullSafe(lists["doc_id"])
        & (F.xxhash64(documents["text"]) == lists["version"]), "left")
    gone = F.coalesce(lists["lines"], F.array().cast("array<long>"))
    kept = F.array_join(F.filter(
        F.split(documents["text"], "\n"), lambda _, i: ~F.array_contains(gone, i.cast("long"))), "\n")
    return joined, F.when(F.size(gone) > 0, kept).otherwise(documents["text"]), gone
