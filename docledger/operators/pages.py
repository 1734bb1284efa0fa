"""Page text: assembly, adequacy, routing, and the recognition fallback."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docledger import fixed
from docledger.functions.text import non_space_count
from docledger.operators.hooks import Recogniser, recognise_pages

PAGES_PER_PART = 1_000


def native_text() -> Column:
    """Native extraction tolerates a bad page: it counts as an empty one."""
    usable = F.when(F.coalesce(~F.col("page_error"), F.lit(True)), F.col("text"))
    return F.coalesce(usable, F.lit(""))


def _joined(items: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(items), lambda x: x["text"]), fixed.PAGE_SEPARATOR)


def page_measures(pages: DataFrame, text: Column | None = None) -> DataFrame:
    """Page count and non-space characters per document.

    Separators are white space, so the counts of the pages add up to the count
    of the joined text; nothing is assembled, and the sums combine map-side.
    """
    return pages.groupBy("document_id").agg(
        F.count("*").alias("page_count"),
        F.sum(non_space_count(native_text() if text is None else text)).alias("non_space_chars"),
    )


def assemble_pages(pages: DataFrame, text: Column | None = None) -> DataFrame:
    """One row per document with its pages joined in page order.

    The value is a single cell by definition and is as large as one document;
    uploads are limited by the gate. For layouts that must not depend on that,
    see `assemble_parts`.
    """
    text = native_text() if text is None else text
    return pages.groupBy("document_id").agg(
        _joined(F.collect_list(F.struct("page_no", text.alias("text")))).alias("combined_text"),
        F.count("*").alias("page_count"),
    )


def assemble_parts(
    pages: DataFrame, text: Column | None = None, pages_per_part: int = PAGES_PER_PART
) -> DataFrame:
    """The joined text in parts of at most `pages_per_part` page numbers.

    Parts joined in order with the page separator give the whole text. A
    document of any size spreads over many tasks.
    """
    text = native_text() if text is None else text
    part = F.floor(F.col("page_no") / pages_per_part).cast("int")
    return pages.groupBy("document_id", part.alias("part_no")).agg(
        _joined(F.collect_list(F.struct("page_no", text.alias("text")))).alias("part_text"),
        F.count("*").alias("page_count"),
    )


def assemble_strict(pages: DataFrame) -> DataFrame:
    """Strict joining: one bad page fails the document and yields no text."""
    failed = F.bool_or(F.coalesce("page_error", F.lit(False)))
    text = F.coalesce("text", F.lit(""))
    joined = _joined(F.collect_list(F.struct("page_no", text.alias("text"))))
    return (
        pages.groupBy("document_id")
        .agg(
            failed.alias("render_failed"),
            F.count("*").alias("page_count"),
            joined.alias("_text"),
        )
        .select(
            "document_id", "render_failed", "page_count",
            F.when(~F.col("render_failed"), F.col("_text")).alias("combined_text"),
        )
    )


def has_meaningful_text(count: Column, min_chars: int = fixed.MIN_TEXT_CHARS) -> Column:
    return count >= min_chars


def text_artifact_key() -> Column:
    return F.concat_ws(
        "/",
        F.col("organization_id").cast("string"),
        F.col("document_id").cast("string"),
        F.lit(fixed.TEXT_ARTIFACT_NAME),
    )


def _stage_columns(category: Column, message: Column, good_status: Column) -> dict[str, Column]:
    return {
        "verdict_status": F.when(category.isNotNull(), F.lit("FAILED")).otherwise(good_status),
        "job_status": F.when(category.isNotNull(), F.lit("FAILED")).otherwise(F.lit("SUCCESS")),
        "error_category": category,
        "error_message": message,
    }


def text_stage(
    documents: DataFrame, measures: DataFrame, min_chars: int = fixed.MIN_TEXT_CHARS
) -> DataFrame:
    """Outcome of native extraction per document.

    `documents` carries read_failed and open_failed flags; `measures` comes from
    `page_measures`. A document without pages has no text.
    """
    joined = documents.join(
        measures.select("document_id", "page_count", "non_space_chars"), "document_id", "left"
    ).withColumns({
        "page_count": F.coalesce("page_count", F.lit(0)).cast("bigint"),
        "non_space_chars": F.coalesce("non_space_chars", F.lit(0)).cast("bigint"),
    })
    message = F.when(F.col("read_failed"), fixed.READ_FAILED).when(
        F.col("open_failed"), fixed.OPEN_FAILED
    )
    category = F.when(message.isNotNull(), F.lit("PROCESSING_ERROR"))
    route = F.when(
        has_meaningful_text(F.col("non_space_chars"), min_chars), F.lit("TEXT_EXTRACTED")
    ).otherwise(F.lit("OCR_REQUIRED"))
    out = joined.withColumns(_stage_columns(category, message, route))
    return out.withColumns({
        "extracted_text_storage_key": F.when(
            F.col("verdict_status") == "TEXT_EXTRACTED", text_artifact_key()
        ),
        "stage": F.lit("TEXT_EXTRACTION"),
    })


def recognised_pages(images: DataFrame, factory: Callable[[], Recogniser]) -> DataFrame:
    """Run the recogniser on every page that could be rendered.

    Pages of a document with another, broken page are run as well: leaving them
    out would need a join that moves the bytes of all images, to save a few
    calls. `ocr_stage` fails such documents whatever the engine says.
    """
    rendered = images.where(~F.coalesce("page_error", F.lit(False)))
    return recognise_pages(rendered, factory)


def ocr_stage(
    documents: DataFrame, images: DataFrame, recognised: DataFrame,
    min_chars: int = fixed.MIN_TEXT_CHARS,
) -> DataFrame:
    """Outcome of the recognition fallback for documents at OCR_REQUIRED.

    Render failure comes before engine failure, which comes before too little
    text. The last is a processing error: the engine itself worked.
    """
    rendered = images.groupBy("document_id").agg(
        F.bool_or(F.coalesce("page_error", F.lit(False))).alias("_render_failed")
    )
    read = recognised.groupBy("document_id").agg(
        F.bool_or("engine_failed").alias("_engine_failed"),
        F.sum(non_space_count(F.coalesce("text", F.lit("")))).alias("_chars"),
        F.count("*").alias("_pages"),
    )
    joined = documents.join(rendered, "document_id", "left").join(read, "document_id", "left")
    broken = F.coalesce("_render_failed", F.lit(False))
    message = (
        F.when(broken, fixed.RENDER_FAILED)
        .when(F.coalesce("_engine_failed", F.lit(False)), fixed.ENGINE_FAILED)
        .when(~has_meaningful_text(F.coalesce("_chars", F.lit(0)), min_chars),
              fixed.NO_USABLE_TEXT)
    )
    category = F.when(message == fixed.ENGINE_FAILED, F.lit("OCR_ERROR")).when(
        message.isNotNull(), F.lit("PROCESSING_ERROR")
    )
    out = joined.withColumns({
        **_stage_columns(category, message, F.lit("TEXT_EXTRACTED")),
        "page_count": F.when(broken, 0).otherwise(F.coalesce("_pages", F.lit(0))).cast("bigint"),
        "non_space_chars": F.when(broken, 0).otherwise(F.coalesce("_chars", F.lit(0)))
        .cast("bigint"),
    }).drop("_render_failed", "_engine_failed", "_chars", "_pages")
    return out.withColumns({
        "extracted_text_storage_key": F.when(
            F.col("verdict_status") == "TEXT_EXTRACTED", text_artifact_key()
        ),
        "stage": F.lit("OCR"),
    })


OUTCOME = ("document_id", "stage", "verdict_status", "error_category", "error_message",
           "extracted_text_storage_key")


def text_outcomes(native: DataFrame, recognised: DataFrame | None = None) -> DataFrame:
    """The text stages' verdict, one row per document.

    `native` comes from `text_stage`, `recognised` from `ocr_stage` over the documents
    that it routed there. Without `recognised` the fallback is off: such documents stay
    at OCR_REQUIRED, which is no failure.
    """
    if recognised is None:
        return native.select(*OUTCOME)
    settled = native.where(F.col("verdict_status") != "OCR_REQUIRED").select(*OUTCOME)
    return settled.unionByName(recognised.select(*OUTCOME))
