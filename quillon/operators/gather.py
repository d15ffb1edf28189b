"""Reassembly of whole sections from the chunk that was found.

chunks has doc_id, chunk_id, heading, content, pages, start_page; anchors has doc_id and anchor_id, one for each search. The
walks forward and backward are minima and maxima over the chunks of a document: the first chunk that stops, the last
one that breaks the run of the same heading. Each operator joins the anchors to the chunks of their documents once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from quillon.functions import text as T


def _all() -> WindowSpec:
    return Window.partitionBy("doc_id", "anchor_id")


def _around(chunks: DataFrame, anchors: DataFrame) -> DataFrame:
    """The headings of the chunks of each anchor's document, with the anchor's heading beside them (a_heading)."""
    heads = anchors.select("doc_id", "anchor_id").distinct().join(
        chunks.select("doc_id", F.col("chunk_id").alias("anchor_id"), F.col("heading").alias("a_heading")), ["doc_id", "anchor_id"]
    )
    rows = chunks.select("doc_id", "chunk_id", "heading").join(heads, "doc_id")
    return rows.withColumn("base", T.base_heading("heading")).withColumn("a_base", T.base_heading("a_heading")).withColumn("number", T.heading_number("heading")).withColumn("a_number", T.heading_number("a_heading"))


def _fetched(picked: DataFrame, chunks: DataFrame, *more: str) -> DataFrame:
    """The chunks that were picked, with anchor_id and more."""
    return picked.select("doc_id", "chunk_id", "anchor_id", *more).join(chunks, ["doc_id", "chunk_id"]).select("anchor_id", *more, *chunks.columns)


def _walk(rows: DataFrame, stops: Column, holds: Column) -> Column:
    """Whether a chunk lies between the last one before the anchor that does not hold and the first after it that stops."""
    here, at = F.col("chunk_id"), F.col("anchor_id")
    end = F.min(F.when((here > at) & stops, here)).over(_all())
    low = F.max(F.when((here < at) & ~holds, here)).over(_all())
    return (here > F.coalesce(low, F.lit(-1))) & (end.isNull() | (here < end))


def gather_full_section(chunks: DataFrame, anchors: DataFrame, version: int = 2) -> DataFrame:
    """The chunks of each anchor's section, with anchor_id.

    A numbered section goes on until another number that is not below its own; chunks without number belong to it. Before the
    anchor, chunks of the same heading belong to it (and, in version 1, those below its number). In version 2 a named
    section (a schedule, an annex) goes on until one of its kind with another identifier. Any other heading has just the chunks of
    the same heading, wherever they are.
    """
    rows = _around(chunks, anchors)
    kind, own_id = T.named_prefix("heading")
    a_kind, a_id = T.named_prefix("a_heading")
    same = F.col("base") == F.col("a_base")
    below = F.coalesce(T.is_child(F.col("a_number"), F.col("number")), F.lit(False))
    stops = F.col("number").isNotNull() & ~below
    if version == 2:
        stops = stops & ~same
    numbered = _walk(rows, stops, same | below if version == 1 else same)
    sibling = F.coalesce((kind == a_kind) & (own_id != a_id), F.lit(False))
    named = _walk(rows, sibling, same)
    mine = F.when(F.col("a_number").isNotNull(), numbered)
    if version == 2:
        mine = mine.when(a_kind.isNotNull(), named)
    return _fetched(rows.withColumn("_mine", mine.otherwise(same)).filter("_mine"), chunks)


def walk_from_anchor(chunks: DataFrame, anchors: DataFrame) -> DataFrame:
    """From the anchor on: until another top number, if the anchor is numbered, or a short heading without number and not in brackets that does not directly follow the anchor."""
    top = r"(?U)^(\d+)[\.\s]"
    rows = _around(chunks, anchors)
    heading, own = T.strip("heading"), T.group(T.strip("heading"), top, 1)
    a_top = T.group(T.strip("a_heading"), top, 1)
    plain = own.isNull() & (heading != "") & ~heading.startswith("(") & (F.length(heading) < 80) & (F.col("chunk_id") > F.col("anchor_id") + 1)
    stops = F.coalesce(own != a_top, F.lit(False)) | plain
    return _fetched(rows.withColumn("_mine", _walk(rows, stops, F.lit(False))).filter("_mine"), chunks)


def search_section(chunks: DataFrame, hits: DataFrame) -> DataFrame:
    """From the first chunk with the parent heading of each hit (doc_id, anchor_id) until another parent heading of the same or a higher level.

    chunks has parent_heading. Comes out with anchor_id and matched_heading.
    """
    heads = hits.select("doc_id", "anchor_id").distinct().join(
        chunks.select("doc_id", F.col("chunk_id").alias("anchor_id"), F.col("parent_heading").alias("matched_heading")),
        ["doc_id", "anchor_id"]
    )
    rows = chunks.select("doc_id", "chunk_id", "parent_heading").join(heads, "doc_id")
    same = F.col("parent_heading") == F.col("matched_heading")
    rows = rows.withColumn("_start", F.min(F.when(same, F.col("chunk_id"))).over(_all()))
    stops = ~same & (T.any_level("parent_heading") <= T.any_level("matched_heading")) & (F.col("chunk_id") > F.col("_start"))
    rows = rows.withColumn("_end", F.min(F.when(stops, F.col("chunk_id"))).over(_all()))
    picked = rows.filter((F.col("chunk_id") >= F.col("_start")) & (F.col("_end").isNull() | (F.col("chunk_id") < F.col("_end"))))
    return _fetched(picked, chunks, "matched_heading")


def _pages() -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list("pages")))).alias("pages")


def _in_order(text: Column, by: str, *order: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, text.alias("_t")))), lambda x: x["_t"]), by)


def merge_chunks(gathered: DataFrame) -> DataFrame:
    """doc_id, anchor_id, heading, content, pages, chunk_id: one row for each section; headings of parts are left out of the content."""
    shown = (F.col("heading") != "") & ~F.col("heading").contains("(part ")
    text = F.when(shown, F.concat(F.lit("\n"), "heading", F.lit("\n"), "content")).otherwise(F.col("content"))
    return gathered.groupBy("doc_id", "anchor_id").agg(
        F.min_by(T.base_heading("heading"), "chunk_id").alias("heading"), T.strip(_in_order(text, "\n", "chunk_id")).alias("content"), _pages(), F.min("chunk_id").alias("chunk_id"),
    )


def stitch_full_texts(gathered: DataFrame) -> DataFrame:
    """One row for each section; its chunks' full texts with empty lines between them."""
    return gathered.groupBy("doc_id", "anchor_id").agg(
        F.max(
            F.when(F.col("chunk_id") == F.col("anchor_id"), F.col("heading"))
        ).alias("heading"), _in_order(T.full_text("heading", "content"), "\n\n", "chunk_id").alias("content"), _pages(), F.col("anchor_id").alias("chunk_id"),
    )


def assemble_search(gathered: DataFrame) -> DataFrame:
    """One row for each search: contents in order of page, pages and chunk ids."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("start_page", "chunk_id"))), lambda x: x["chunk_id"])
    return gathered.groupBy("doc_id", "anchor_id", "matched_heading").agg(
        _in_order(F.col("content"), "\n\n", "start_page", "chunk_id").alias("content"), _pages(), ids.alias("chunk_ids")
    ).withColumnRenamed("matched_heading", "heading")
