"""N-gram Jaccard join: groups of documents linked by near-equal sets of word n-grams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docledger.llm import setjoin
from docledger.llm.components import components
from docledger.sources.workspace import persisted


def grouped(documents: DataFrame, width: int = 3, num: int = 9, den: int = 10) -> DataFrame:
    """doc_id, n_shingles, component_id for every row.

    Sets are distinct `width`-word shingles of the lower-cased (A-Z) text; fewer
    words are one shingle. Two documents link when their Jaccard similarity is
    num/den or more; component_id is the smallest doc_id that links reach. Null
    texts and texts without words have an empty set, link with nothing and keep
    their own doc_id. Equal sets are one class, so groups of copies never become
    pairs. Rows that repeat a doc_id each count by their own text; a null doc_id is
    never the smallest unless its whole group has none. Other columns are ignored.

    Every pair of classes in a component does not have to be found, only enough to
    connect it. The first round tests each member of a block with the block's hub;
    the second tests, exactly, all pairs that still lie in different components,
    leaving out a block's largest component against itself.
    """
    return _labelled(*_linked(documents, width, num, den))


def repeats(
    documents: DataFrame, width: int = 3, num: int = 9, den: int = 10,
) -> tuple[DataFrame, DataFrame]:
    """(others, copies), each doc_id, version: rows by id and setjoin.version.

    others: rows of a group that are not its first by (doc_id, version), a null id
    after all others. copies: first rows that occur several times, equal in both.
    """
    items, found = _linked(documents, width, num, den)
    items = items.where("n > 0")
    roots = persisted(items.select("doc_id", "version", "a", "b").join(
        found, F.struct("a", "b") == F.col("node"), "left",
    ).select("doc_id", "version", F.coalesce("root", F.struct("a", "b")).alias("root")), "rooted")
    place = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "version")
    firsts = roots.groupBy("root").agg(F.min(place).alias("first"))
    placed = roots.join(firsts, "root").withColumn("other", ~place.eqNullSafe(F.col("first")))
    counted = placed.groupBy("doc_id", "version", "other").count()
    return (counted.where("other").select("doc_id", "version"),
            counted.where("NOT other AND count > 1").select("doc_id", "version"))


def _linked(documents: DataFrame, width: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(items, components of their classes)."""
    join = setjoin.Join(width, num, den)
    bits = setjoin.bits_for(documents)
    items, bins = setjoin.described(documents, join, bits)
    order = setjoin.rarity(bins, bits)
    rows = setjoin.blocks(setjoin.prefixes(documents, join, order), join)
    tried = persisted(setjoin.hub_pairs(rows, join), "pairs")
    links = setjoin.verified(documents, join, tried, _homes(items, tried))
    found = persisted(components(links), "components")

    more = persisted(
        _between(rows, found, join).join(tried, ["u", "v"], "left_anti"), "pairs")
    if not more.isEmpty():
        extra = setjoin.verified(documents, join, more, _homes(items, more))
        found = components(
            found.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(extra))
    return items, persisted(found, "components")


def _homes(items: DataFrame, pairs: DataFrame) -> DataFrame:
    own = items.join(setjoin.classes_of(pairs), ["a", "b"], "left_semi")
    return persisted(own.groupBy("a", "b").agg(F.min("version").alias("version")), "homes")


def _between(rows: DataFrame, found: DataFrame, join: setjoin.Join) -> DataFrame:
    """Candidates between different components of a block, as far as filters allow."""
    members = setjoin.members(rows)
    labelled = members.join(
        found, F.struct("a", "b") == F.col("node"), "left",
    ).select(members["*"], F.coalesce("root", F.struct("a", "b")).alias("label"))
    labelled = persisted(labelled, "labelled")
    parts = labelled.groupBy("token", "label").count()
    mixed = parts.groupBy("token").agg(
        F.max_by("label", F.struct("count", "label")).alias("major"), F.count(F.lit(1)).alias("k"),
    ).where("k > 1").select("token", "major")
    right = labelled.join(mixed, "token")
    left = right.where("label <> major")
    wanted = (F.col("x.label") != F.col("y.label")) & (
        (F.col("y.label") == F.col("y.major")) | (F.struct("x.a", "x.b") < F.struct("y.a", "y.b")))
    return setjoin.rest_pairs(left, right, join, wanted)


def _labelled(items: DataFrame, found: DataFrame) -> DataFrame:
    classes = items.where("n > 0").groupBy("a", "b").agg(F.min("doc_id").alias("first_id"))
    rooted = classes.join(
        found, F.struct("a", "b") == F.col("node"), "left",
    ).select("a", "b", "first_id", F.coalesce("root", F.struct("a", "b")).alias("root"))
    roots = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(roots, "root").select("a", "b", "component_id")
    return items.where("n > 0").join(named, ["a", "b"]).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id",
    ).unionByName(items.where("n = 0").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
