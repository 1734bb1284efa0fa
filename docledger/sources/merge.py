"""Changes to stored tables that touch only the tenants they name.

A table is laid out by organization_id. A merge reads and rewrites the folders of the
tenants its rows belong to; all others keep their files. Rows that surely stay are copied
as they lie, without a shuffle; only the others and the new ones are compared and laid out,
until a table has so many small files that a merge lays out all rows again. The new folders are written
aside, completely, and a marker says so; then they take the places of the old ones. What
a crash leaves behind is either without the marker, and is dropped, or with it, and is
finished by the next merge or by `finish_merges`: a tenant has its old rows or its new
ones, and none are lost in between.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docledger.functions.keybits import split_by_keys
from docledger.sources.workspace import persisted

TENANT = "organization_id"
#: Up to so many tenants are named to the scan; more are found by a join.
NAMED_TENANTS = 1_000
#: A table with more files, for each tenant and for its size together, is laid out again.
TENANT_FILES, FILE_BYTES = 8, 32 << 20
_READY = "_ready"


class _Folders:
    """The file system of a path, by its own names."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._system = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self._system.exists(self._path(path))

    def names(self, path: str) -> list[str]:
        if not self.exists(path):
            return []
        return sorted(x.getPath().getName() for x in self._system.listStatus(self._path(path)))

    def scattered(self, path: str) -> bool:
        """Whether a table has many more files than its tenants and size call for."""
        held = self._system.getContentSummary(self._path(path))
        return held.getFileCount() > (
            TENANT_FILES * held.getDirectoryCount() + held.getLength() // FILE_BYTES)

    def make(self, path: str) -> None:
        self._system.mkdirs(self._path(path))

    def mark(self, path: str) -> None:
        self._system.create(self._path(path)).close()

    def move(self, path: str, to: str) -> None:
        if not self._system.rename(self._path(path), self._path(to)):
            raise OSError(f"cannot move {path} to {to}")

    def drop(self, path: str) -> None:
        self._system.delete(self._path(path), True)


def write_by_tenant(df: DataFrame, root: str, name: str) -> None:
    """Store a new table; `df` has organization_id besides the table's columns."""
    _laid_out(df).parquet(f"{root.rstrip('/')}/{name}")


def read_by_tenant(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """Scan such a table; `schema` is its whole schema, organization_id included."""
    return spark.read.schema(schema).parquet(f"{root.rstrip('/')}/{name}")


def merge_rows(
    root: str, name: str, schema: str, key: str, removed: DataFrame, added: DataFrame,
) -> None:
    """Take the rows with the keys of `removed` out of a table and put `added` in.

    `schema` is the table's whole schema, `removed` has organization_id and `key`; columns
    that `added` lacks become null. A key in both is replaced. The same merge again
    changes nothing, so it can be repeated after a crash. `removed` and `added` must not
    be made from the table itself unless they are kept somewhere else, and a table has
    one writer at a time.
    """
    spark = added.sparkSession
    base, side = f"{root.rstrip('/')}/{name}", f"{root.rstrip('/')}/_merges/{name}"
    finish_merges(spark, root, name)
    stored = read_by_tenant(spark, root, name, schema)
    touched = removed.select(TENANT).unionByName(added.select(TENANT)).distinct()
    current = _of_tenants(stored, touched)
    same, near = split_by_keys(current, key, removed)
    gone = removed.select(F.col(key).alias("_gone")).distinct()
    kept = near.join(gone, F.col(key) == F.col("_gone"), "left_anti")
    changed = kept.unionByName(added, allowMissingColumns=True).select(*stored.columns)

    folders, mark = _Folders(spark, base), uuid.uuid4().hex
    new = f"{side}/{mark}/new"
    if folders.scattered(base):
        _laid_out(same.unionByName(changed)).parquet(new)
    else:
        same.unionByName(_ranged(changed)).write.partitionBy(TENANT).parquet(new)
    # A tenant that is left without rows has an empty folder among the new ones.
    written = set(folders.names(new))
    for folder in sorted(_folder_names(spark, touched, folders, side, mark) - written):
        folders.make(f"{new}/{folder}")
    folders.mark(f"{side}/{mark}/{_READY}")
    _swap(folders, base, f"{side}/{mark}")
    spark.catalog.refreshByPath(base)


#: The review tables with their keys, statuses last: they say what counts.
REVIEW_TABLES = {
    "invoice_line_items": "invoice_id", "invoices": "invoice_id", "documents": "document_id"}


def apply_review(
    root: str, schemas: dict[str, str],
    changes: dict[str, tuple[DataFrame | None, DataFrame]],
) -> None:
    """Merge what a batch of commands changes; see `review.review_changes`.

    The changes are kept before the first table changes, as they are made from them. A
    crash in between is mended by applying the same outcomes again, which only needs the
    outcomes to be kept.
    """
    kept = {name: tuple(df if df is None else persisted(df, f"{name}-changes")
                        for df in changes[name]) for name in REVIEW_TABLES}
    for name, key in REVIEW_TABLES.items():
        removed, added = kept[name]
        merge_rows(root, name, schemas[name], key, added if removed is None else removed, added)


def finish_merges(spark: SparkSession, root: str, name: str) -> int:
    """Complete or drop what crashed merges left behind; how many were completed."""
    base, side = f"{root.rstrip('/')}/{name}", f"{root.rstrip('/')}/_merges/{name}"
    folders, done = _Folders(spark, base), 0
    for mark in folders.names(side):
        if folders.exists(f"{side}/{mark}/{_READY}"):
            _swap(folders, base, f"{side}/{mark}")
            done += 1
        else:
            folders.drop(f"{side}/{mark}")
    if done:
        spark.catalog.refreshByPath(base)
    return done


def _swap(folders: _Folders, base: str, side: str) -> None:
    """Put the new folders in the place of the old ones; can be repeated at any point."""
    folders.make(f"{side}/old")
    for name in [n for n in folders.names(f"{side}/new") if n.startswith(f"{TENANT}=")]:
        if folders.exists(f"{base}/{name}") and not folders.exists(f"{side}/old/{name}"):
            folders.move(f"{base}/{name}", f"{side}/old/{name}")
        folders.move(f"{side}/new/{name}", f"{base}/{name}")
    folders.drop(side)


def _ranged(df: DataFrame) -> DataFrame:
    # Ranges keep a tenant's rows together, and split a large tenant by its first column.
    first = next(c for c in df.columns if c != TENANT)
    return df.repartitionByRange(TENANT, first)


def _laid_out(df: DataFrame):
    return _ranged(df).write.partitionBy(TENANT)


def _of_tenants(stored: DataFrame, touched: DataFrame) -> DataFrame:
    """Rows of the tenants in `touched`; their folders are the only ones read if few."""
    few = [r[0] for r in touched.limit(NAMED_TENANTS + 1).collect()]
    if len(few) <= NAMED_TENANTS:
        named: Column = F.col(TENANT).isin([t for t in few if t is not None])
        return stored.where(named | F.col(TENANT).isNull() if None in few else named)
    tenants = touched.withColumnRenamed(TENANT, "_tenant")
    return stored.join(tenants, F.col(TENANT).eqNullSafe(F.col("_tenant")), "left_semi")


def _folder_names(
    spark: SparkSession, touched: DataFrame, folders: _Folders, side: str, mark: str,
) -> set[str]:
    """The names that the writer gives to the folders of these tenants."""
    path = f"{side}/{mark}/names"
    touched.withColumn("one", F.lit(1)).write.partitionBy(TENANT).parquet(path)
    return {n for n in folders.names(path) if n.startswith(f"{TENANT}=")}
