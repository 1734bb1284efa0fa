"""Numbering and carrying values within groups, also when a group is huge.

A window over `partitionBy(key)` puts each key into one task, which is right
for almost every key and ruinous for one that holds a large share of all rows.
`split_groups` therefore counts the rows of every key, the NULL key included.
Ordinary keys keep the plain window. The rows of heavy keys are range partitioned
on (key, order), so one key spans many tasks; each range is scanned by itself and
short per-range summaries, one row per key and range, link the ranges together.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docledger.sources.workspace import persisted, shared_folder

HEAVY_ROWS = 1_000_000


def heavy_keys(df: DataFrame, key: str, min_rows: int = HEAVY_ROWS) -> DataFrame:
    """Keys with at least `min_rows` rows; counted map-side, kept as a table."""
    return df.groupBy(F.col(key).alias("_heavy")).count().where(
        F.col("count") >= min_rows).select("_heavy")


@dataclass(frozen=True)
class GroupScan:
    """A frame prepared for ordered scans within `key`."""

    df: DataFrame
    key: str
    order: tuple[Column, ...]
    ranged: bool

    def with_df(self, df: DataFrame) -> GroupScan:
        return GroupScan(df, self.key, self.order, self.ranged)

    def _within(self):
        keys = [self.key, "_range"] if self.ranged else [self.key]
        return Window.partitionBy(*keys).orderBy(*self.order)

    def _join_summary(self, df: DataFrame, summary: DataFrame) -> DataFrame:
        summary = summary.withColumnsRenamed({self.key: "_key", "_range": "_at"})
        same = F.col(self.key).eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_at"))
        return df.join(summary, same, "left").drop("_key", "_at")

    def _before_ranges(self):
        return (
            Window.partitionBy(self.key)
            .orderBy("_range")
            .rowsBetween(Window.unboundedPreceding, -1)
        )

    def number(self, name: str) -> GroupScan:
        """Add a 0-based position within the key."""
        df = self.df.withColumn(name, F.row_number().over(self._within()) - 1)
        if self.ranged:
            sizes = self.df.groupBy(self.key, "_range").agg(F.count("*").alias("_n"))
            sizes = sizes.select(
                self.key, "_range", F.sum("_n").over(self._before_ranges()).alias("_skip")
            )
            df = self._join_summary(df, sizes)
            df = df.withColumn(name, F.col(name) + F.coalesce("_skip", F.lit(0))).drop("_skip")
        return self.with_df(df.withColumn(name, F.col(name).cast("bigint")))

    def carry(self, columns: dict[str, Column], before: bool = False) -> GroupScan:
        """Carry the latest non-null value of each column forward in order.

        With `before`, a row sees only the rows ahead of it.
        """
        sources = {f"_src_{name}": col for name, col in columns.items()}
        base = self.df.withColumns(sources)
        frame = self._within().rowsBetween(
            Window.unboundedPreceding, -1 if before else Window.currentRow
        )
        df = base.withColumns({
            name: F.last(f"_src_{name}", ignorenulls=True).over(frame) for name in columns
        })
        if self.ranged:
            ends = base.groupBy(self.key, "_range").agg(*[
                F.max(
                    F.when(F.col(src).isNotNull(), F.struct(*self._plain_order(), F.col(src)))
                ).getField(src).alias(src)
                for src in sources
            ])
            ends = ends.select(
                self.key,
                "_range",
                *[
                    F.last(f"_src_{n}", ignorenulls=True)
                    .over(self._before_ranges())
                    .alias(f"_prev_{n}")
                    for n in columns
                ],
            )
            df = self._join_summary(df, ends)
            df = df.withColumns({n: F.coalesce(F.col(n), F.col(f"_prev_{n}")) for n in columns})
            df = df.drop(*[f"_prev_{n}" for n in columns])
        return self.with_df(df.drop(*sources))

    def _plain_order(self) -> list[Column]:
        # `carry` is used with ascending, non-null order columns only.
        return [c.alias(f"_o{i}") for i, c in enumerate(self.order)]


def split_groups(
    df: DataFrame, key: str, order: list[Column], min_rows: int = HEAVY_ROWS,
    probe: DataFrame | None = None,
) -> list[GroupScan]:
    """Prepare `df` for ordered scans within `key`.

    `probe` is a cheaper frame with the same key column to look for heavy keys
    in, when `df` is the product of joins; it has all rows of `df`'s keys at least.
    `order` must be total within a key.
    """
    plain = [GroupScan(df, key, tuple(order), False)]
    # Fewer rows than make a heavy key: mostly known from the files' footers.
    if probe is not None and probe.count() < min_rows:
        return plain
    found = heavy_keys(probe if probe is not None else df, key, min_rows)
    if found.isEmpty():
        return plain
    heavy = persisted(found, "heavy-keys")
    is_heavy = F.col(key).eqNullSafe(F.col("_heavy"))
    # The ranges must not move between uses, so they are pinned in the shared
    # checkpoint folder.
    shared_folder(df.sparkSession)
    ranged = (
        df.join(heavy, is_heavy, "left_semi")
        .repartitionByRange(F.col(key), *order)
        .withColumn("_range", F.spark_partition_id())
        .checkpoint()
    )
    return [
        GroupScan(df.join(heavy, is_heavy, "left_anti"), key, tuple(order), False),
        GroupScan(ranged, key, tuple(order), True),
    ]


def merge_groups(scans: list[GroupScan]) -> DataFrame:
    out = None
    for scan in scans:
        df = scan.df.drop("_range") if scan.ranged else scan.df
        out = df if out is None else out.unionByName(df)
    return out


def number_in_group(
    df: DataFrame, key: str, order: list[Column], name: str, min_rows: int = HEAVY_ROWS,
    probe: DataFrame | None = None,
) -> DataFrame:
    """Add a 0-based position within `key`, in `order`."""
    scans = split_groups(df, key, order, min_rows, probe)
    return merge_groups([scan.number(name) for scan in scans])
