"""Evidence for a statement from several terms: retrieval, boost and collation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.durable import ranked
from quillon.functions import text as T
from quillon.operators.vectors import heading_matches, top_k, with_heading_matches

TERM_HITS, THRESHOLD, MOST_CHUNKS = 5, 0.35, 25
HEAVY, LIGHT = "═" * 60, "─" * 60


def retrieve_for_terms(store: DataFrame, terms: DataFrame, k: int = TERM_HITS, key: str = "chunk_id") -> DataFrame:
    """query_id, key, score: the k nearest chunks of each term (query_id, term, vector), and chunks whose headings contain it."""
    near = top_k(store, terms, k, key)
    return with_heading_matches(near, heading_matches(store, terms, key=key), key)


def gather_relevant(hits: DataFrame, terms: DataFrame, threshold: float = THRESHOLD, key: str = "chunk_id", by: list[str] | None = None) -> DataFrame:
    """key, best, terms, score, rank: hits at or over the threshold; a chunk that n terms hit counts sqrt(n) times its best score."""
    within = by or []
    rows = hits.filter(F.col("score") >= threshold).join(F.broadcast(terms.select("query_id", "term", *within)), "query_id")
    merged = rows.groupBy(*within, key).agg(F.max("score").alias("best"), F.array_sort(F.collect_set("term")).alias("terms"))
    merged = merged.withColumn("score", F.col("best") * F.sqrt(F.size("terms")))
    if not within:
        return ranked(merged, "rank", F.desc("score"), F.col(key))
    return merged.withColumn("rank", F.row_number().over(Window.partitionBy(*within).orderBy(F.desc("score"), key)))


def collate(ranked: DataFrame, chunks: DataFrame, most: int = MOST_CHUNKS, key: str = "chunk_id", by: list[str] | None = None) -> DataFrame:
    """heading, pages, matched_terms, excerpt, first_page, ord of each section of the best chunks, by first page.

    Within a section, chunks are in order of page, and each text comes once.
    """
    within = by or []
    rows = ranked.filter(F.col("rank") <= most).join(chunks.select(key, "heading", "pages", T.full_text("heading", "content").alias("text")), key)
    rows = rows.withColumn(
        "section", T.base_heading(F.coalesce("heading", F.lit("(no heading)")))
    ).withColumn("first", F.coalesce(F.array_min("pages"), F.lit(9999)))
    once = F.row_number().over(Window.partitionBy(*within, "section", "text").orderBy("first", "rank"))
    rows = rows.withColumn("_n", once)
    excerpt = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_n") == 1, F.struct("first", "rank", "text")))), lambda x: x["text"]), "\n\n")
    out = rows.groupBy(*within, F.col("section").alias("heading")).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("pages")))).alias("pages"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("terms")))).alias("matched_terms"), excerpt.alias("excerpt"), F.min("first").alias("first_page"), F.min("rank").alias("_rank"),
    )
    # Without by there are at most as many sections as chunks that were let through.
    order = Window.partitionBy(*within).orderBy("first_page", "_rank") if within else Window.orderBy("first_page", "_rank")
    return out.withColumn("ord", F.row_number().over(order)).drop("_rank")


def render(collated: DataFrame, by: list[str] | None = None) -> DataFrame:
    """combined_context, sections of the collated evidence, as one text."""
    pages = F.concat(F.lit("["), F.array_join("pages", ", "), F.lit("]"))
    part = F.concat(
        F.lit(f"{HEAVY}\nSECTION : "), "heading", F.lit("\nPages   : "), pages, F.lit("\nTerms   : "), F.array_join("matched_terms", ", "),
        F.lit(f"\n{LIGHT}\n"), "excerpt"
    )
    rows = F.array_sort(F.collect_list(F.struct("ord", part.alias("part"), "heading")))
    return collated.groupBy(*(by or [])).agg(
        F.array_join(F.transform(rows, lambda x: x["part"]), "\n\n").alias("combined_context"),
        F.transform(rows, lambda x: x["heading"]).alias("sections")
    )
