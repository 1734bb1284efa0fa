"""How often to take each document so that sources reach their share of the words.

Entropy balancing: among all document rates, the ones nearest to taking every
document once (in relative entropy, weighted by words) whose words per source meet
the targets. The dual is convex with one multiplier per source, its solution is the
tilt exp(multiplier) of every document of the source, and Newton's iteration solves
it on the table of source totals: one row per source, spread over the cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docledger.sources.workspace import persisted

WORD = "[^\\x20\\x09-\\x0D]+"
#: No document is taken more often than this.
MOST_COPIES = 3
#: Rows of a source that are rounded together; error per part is half a document.
PART_ROWS = 4096
#: Newton steps; each is monotone once past the first, the last ones change nothing.
STEPS = 60


def sized(documents: DataFrame) -> DataFrame:
    """doc_id, source, size, salt: words of each row, a null text has none, and a hash.

    The salt is that of the id, without one of the text, so that rows without id spread.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    salt = F.md5(F.coalesce(F.col("doc_id").cast("string"), "text", F.lit("")))
    return documents.select("doc_id", "source", size.alias("size"), salt.alias("salt"))


def source_totals(sizes: DataFrame) -> DataFrame:
    """source, source_size, n_docs, place: rank by code points from 0, null last.

    The rank is a count per range of sources plus a rank inside the range, so no
    task sees all sources.
    """
    totals = sizes.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    order = F.col("source").asc_nulls_last()
    ranged = persisted(
        totals.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "sources")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = ranged.groupBy("part").count().select(
        "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(W.partitionBy("part").orderBy(order)) - 1
    return ranged.withColumn("inside", inside).join(F.broadcast(starts), "part").select(
        "source", "source_size", "n_docs", (F.col("start") + F.col("inside")).alias("place"))


def with_targets(totals: DataFrame, cycle: int = 3, most: int = MOST_COPIES) -> DataFrame:
    """Adds target: shares of all words by weight 1..cycle, capped, excess reshared.

    The level `x` with sum(min(cap, weight * x)) = all words is found by fixing the
    capped sources and resharing until no other is above its cap. Each round is one
    distributed sum, of which the driver sees two numbers; sources only ever join
    the capped ones, so it ends.
    """
    weight = (F.col("place") % cycle + 1).cast("long")
    rows = persisted(totals.withColumn("weight", weight), "targets")
    cap = F.col("source_size") * most
    everything = rows.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        full = cap <= F.col("weight") * F.lit(level)
        held, free, count = rows.agg(
            F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight"))),
            F.sum(full.cast("long"))).first()
        count = count or 0
        if count == capped or not free:
            break
        capped, level = count, (everything - (held or 0)) / free
    target = F.when(full, cap.cast("double")).otherwise(F.col("weight") * F.lit(level))
    return rows.withColumn("target", target)


def with_rates(targets: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """Adds rate: the copies per document, exp of the multiplier that Newton finds.

    Per source the dual's slope is size * exp(m) - target and its curvature
    size * exp(m): sources share no document, so the Hessian is diagonal and each
    step runs on all source rows at once. Rates are rounded to nine decimals, which
    makes reruns agree whatever the last bits are.
    """
    goal = F.try_divide("target", "source_size")  # null for a source without words
    multiplier = F.aggregate(
        F.sequence(F.lit(1), F.lit(STEPS)), F.lit(0.0),
        # A long first step to the right would only be walked back one by one.
        lambda m, _: m - F.greatest(F.lit(-2.0), F.lit(1.0) - goal * F.exp(-m)),
    )
    rate = F.when(goal > 0, F.least(F.exp(multiplier), F.lit(float(most)))).otherwise(F.lit(0.0))
    return targets.withColumn("rate", F.round(rate, 9))


def mixed(documents: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies, taken.

    One row per input row; rows that repeat a doc_id count each for itself. Rates
    become copies by running totals: within a part of a source, largest documents
    first, document k takes round(k * rate) - round((k-1) * rate) copies, from a
    start fixed by the part. So the words of a part miss its share by about half
    its largest document, and no task holds a whole source. A null text has size 0;
    empty documents are taken at the same rate and add nothing. Sources without any
    word have target and rate 0. Without rows the result is empty. Null sources form
    one source, the last.
    """
    sizes = persisted(sized(documents), "sizes")
    rates = with_rates(with_targets(source_totals(sizes)))
    keyed = sizes.alias("d").join(
        rates.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))
    ).select(
        "d.doc_id", "d.source", "d.size", "s.source_size", "s.target", "s.rate", "s.n_docs", "d.salt")
    parts = F.ceil(F.col("n_docs") / PART_ROWS)
    part = F.conv(F.substring("salt", 1, 8), 16, 10).cast("long") % parts
    start = F.col("part") * F.lit(0.6180339887) % 1
    in_part = W.partitionBy("source", "part").orderBy(F.desc("size"), "salt", "doc_id")
    place = F.row_number().over(in_part)
    upto = F.floor(F.col("place") * F.col("rate") + F.col("start"))
    before = F.floor((F.col("place") - 1) * F.col("rate") + F.col("start"))
    return (
        keyed.withColumn("part", part).withColumn("place", place).withColumn("start", start)
        .withColumn("copies", (upto - before).cast("long"))
        .select("doc_id", "source", "size", "source_size", "target", "rate", "copies",
                (F.col("copies") * F.col("size")).alias("taken"))
    )
