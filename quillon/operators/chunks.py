"""Headings from fonts and from style, chunks between headings, and the removal of pages of contents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions import text as T
from quillon.operators.sections import so_far, whole, joined

INTRODUCTION = "Introduction"
#: Pages of contents: at most so many, within so many pages, among the first so many that have text.
TOC_PAGES, TOC_CANDIDATES = 5, 15


def infer_sections(paragraphs: DataFrame) -> DataFrame:
    """paragraphs (doc_id, seq, text) with section: the nearest heading-like text before them or their own."""
    heading = F.when(T.looks_like_heading("text"), F.col("text"))
    return paragraphs.withColumn("section", F.coalesce(F.last(heading, ignorenulls=True).over(so_far()), F.lit(INTRODUCTION)))


def detect_headings(blocks: DataFrame) -> DataFrame:
    """blocks (doc_id, seq, text, font_size, is_bold) with is_heading.

    Headings are larger than 1.1 times the document's median font, or bold and shorter than 120 characters. Without any positive
    font size nothing is a heading.
    """
    median = F.median(F.when(F.col("font_size") > 0, F.col("font_size"))).over(whole())
    large = F.col("font_size") > F.col("_median") * 1.1
    marked = blocks.withColumn("_median", median)
    return marked.withColumn(
        "is_heading", F.coalesce(F.col("_median").isNotNull() & (large | (F.col("is_bold") & (F.length("text") < 120))), F.lit(False))
    ).drop("_median")


def chunk_by_section(blocks: DataFrame, level=T.numbered_level) -> DataFrame:
    """doc_id, chunk_id, heading, content, pages, start_page, heading_level from blocks with is_heading.

    Each heading begins a chunk; text before the first one is a chunk without heading.
    """
    rows = blocks.withColumn("run", F.sum(F.col("is_heading").cast("int")).over(so_far()))
    body = F.when(~F.col("is_heading"), F.struct("seq", "text"))
    chunks = rows.groupBy("doc_id", "run").agg(
        F.coalesce(F.max(F.when(F.col("is_heading"), F.col("text"))), F.lit("")).alias("heading"),
        joined(F.collect_list(body), "\n").alias("content"),
        F.array_sort(F.collect_set("page")).alias("pages"),
        F.min_by("page", "seq").alias("start_page"),
    )
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("run")) - 1
    return chunks.select("doc_id", number.alias("chunk_id"), "heading", "content", "pages", "start_page", level("heading").alias("heading_level"))


def with_parent_heading(chunks: DataFrame) -> DataFrame:
    """chunks with parent_heading, which stays when a chunk is split."""
    return chunks.withColumn("parent_heading", F.col("heading"))


def toc_candidates(blocks: DataFrame) -> DataFrame:
    """doc_id, page, preview (500 characters) of the first pages that have text, for a decision about contents."""
    pages = blocks.groupBy("doc_id", "page").agg(F.substring(joined(F.collect_list(F.struct("seq", "text")), "\n"), 1, 500).alias("preview"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("page"))
    return pages.withColumn("rank", rank).filter(F.col("rank") <= TOC_CANDIDATES).drop("rank")


def plausible_toc(decided: DataFrame) -> DataFrame:
    """Of (doc_id, page) that were decided to be contents, those of documents where they are few and near each other."""
    ok = (F.size("pages") <= TOC_PAGES) & (F.array_max("pages") - F.array_min("pages") <= TOC_PAGES)
    return decided.groupBy("doc_id").agg(F.collect_set("page").alias("pages")).filter(ok).select("doc_id", F.explode("pages").alias("page"))


def drop_toc_blocks(blocks: DataFrame, decided: DataFrame) -> DataFrame:
    """blocks without those on pages of contents."""
    return blocks.join(plausible_toc(decided), ["doc_id", "page"], "left_anti")
