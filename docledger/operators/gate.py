"""Upload gate: one reason per refused file, accepted files become documents."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docledger import fixed
from docledger.functions.ids import derived_id
from docledger.functions.text import is_blank


def reject_reason(
    max_bytes: int = fixed.MAX_UPLOAD_BYTES,
    extensions: Iterable[str] = fixed.UPLOAD_EXTENSIONS,
) -> Column:
    """First failing rule for (filename, size_bytes, header); NULL if accepted.

    The declared content type is deliberately not consulted.
    """
    name = F.col("filename")
    unsafe = F.lit(False)
    for piece in ("/", "\\", "\0", ".."):
        unsafe = unsafe | name.contains(piece)
    lowered = F.lower(name)
    allowed = F.lit(False)
    for extension in extensions:
        allowed = allowed | lowered.endswith(extension)
    magic = F.lit(fixed.PDF_MAGIC)
    has_magic = F.coalesce(F.substring(F.col("header"), 1, 5) == magic, F.lit(False))
    return (
        F.when(is_blank(name), fixed.NAME_REQUIRED)
        .when(F.char_length(name) > fixed.MAX_FILENAME_LENGTH, fixed.NAME_TOO_LONG)
        .when(unsafe, fixed.NAME_UNSAFE)
        .when(~allowed, fixed.TYPE_UNSUPPORTED)
        .when(F.coalesce("size_bytes", F.lit(0)) <= 0, fixed.FILE_EMPTY)
        .when(F.col("size_bytes") > max_bytes, fixed.FILE_OVERSIZED)
        .when(~has_magic, fixed.CONTENT_INVALID)
    )


def gate(
    uploads: DataFrame,
    max_bytes: int = fixed.MAX_UPLOAD_BYTES,
    extensions: Iterable[str] = fixed.UPLOAD_EXTENSIONS,
) -> DataFrame:
    return uploads.withColumn("reject_reason", reject_reason(max_bytes, extensions))


def stored_uploads(uploads: DataFrame, headers: DataFrame) -> DataFrame:
    """Uploads with the length and first bytes of their stored file.

    `uploads` has storage_key, `headers` comes from `stored_headers`. An upload whose
    file is not there has no size, which the gate takes for an empty file.
    """
    known = headers.select(
        F.col("storage_key").alias("_key"), F.col("length").alias("size_bytes"), "header")
    return uploads.drop("size_bytes", "header").join(
        known, F.col("storage_key") == F.col("_key"), "left").drop("_key")


def error_class(reason: Column) -> Column:
    """Error class of a reject reason."""
    pairs = [F.lit(x) for pair in fixed.REASON_CLASSES.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), reason)


def reject_counts(gated: DataFrame) -> DataFrame:
    return (
        gated.where(F.col("reject_reason").isNotNull())
        .groupBy("reject_reason")
        .agg(F.count("*").alias("n_files"))
        .withColumn("error_class", error_class(F.col("reject_reason")))
    )


def accepted_documents(gated: DataFrame) -> DataFrame:
    """Accepted uploads as new document rows."""
    document_id = derived_id("document", "organization_id", "upload_id")
    file_id = derived_id("file", "organization_id", "upload_id")
    content_type = F.when(F.col("content_type") != "", F.col("content_type"))
    return gated.where(F.col("reject_reason").isNull()).select(
        document_id.alias("document_id"),
        "organization_id",
        F.col("user_id").alias("uploaded_by_user_id"),
        F.col("filename").alias("original_filename"),
        F.concat(F.col("organization_id").cast("string"), F.lit("/"), file_id, F.lit(".pdf"))
        .alias("storage_key"),
        F.coalesce(content_type, F.lit(fixed.DEFAULT_CONTENT_TYPE)).alias("content_type"),
        F.col("size_bytes").alias("file_size_bytes"),
        F.lit("UPLOADED").alias("status"),
        F.lit(None).cast("string").alias("extracted_text_storage_key"),
    )
