"""End-to-end extraction: definitions, any named section, statements; and the section index. Chunks are embedded once, durably."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.durable import durable
from quillon.operators import chunks as C
from quillon.operators import collate, gather, split, vectors
from quillon.operators.decide import Decider

VERIFY_CHARS, CONTEXT_CHARS = 4000, 6000
#: How a query for a section is put, and the questions that find definitions, in several languages.
TEMPLATES = ("{}", "Section {}", "{} clause provisions")
DEFINITION_QUERIES = (
    "Definitions and Interpretation",
    "Definition of terms used in this agreement",
    "Interpretation clause",
    "Meanings of defined terms",
    "Définitions et interprétation",
    "定义与释义",
    "Begriffsbestimmungen und Auslegung",
)


def prepare_chunks(
    blocks: DataFrame, decider: Decider | None = None, size: int = split.CHUNK_TOKENS, overlap: int = split.TOKEN_OVERLAP,
    measure: Callable[[str], int] = len
) -> DataFrame:
    """Blocks with fonts to chunks: pages of contents go (if there is a decider), headings are found, long chunks are split."""
    if decider is not None:
        decided = decider.decide(C.toc_candidates(blocks), "toc", {"preview": F.col("preview")}, "d").filter("d.is_toc").select("doc_id", "page")
        blocks = C.drop_toc_blocks(blocks, decided)
    return split.split_oversized_chunks(C.with_parent_heading(C.chunk_by_section(C.detect_headings(blocks))), size, overlap, measure)


def query_rows(spark: SparkSession, texts: list[str], embed: Callable[[Column], Column]) -> DataFrame:
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "query_id int, term string")
    return rows.withColumn("vector", embed(F.col("term")))


def _keyed(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("chunk_key", F.concat_ws("#", F.col("doc_id").cast("string"), F.lpad(F.col("chunk_id").cast("string"), 9, "0")))


def extract_section(chunks: DataFrame, query: str, embed: Callable[[Column], Column], decider: Decider, top_k: int = 8, version: int = 2) -> DataFrame:
    """For each document, the section that a query names: heading, content, pages, chunk_id, verified, output.

    Candidates are the headings that the decider ranks, then those that retrieval ranks among the document's own chunks (top_k for each query). All are gathered and verified; the first
    that is verified counts, or else the last.
    """
    spark, store = chunks.sparkSession, durable(_keyed(vectors.build_chunk_store(chunks, embed)))
    heads = vectors.unique_headings(chunks)
    listed = heads.groupBy("doc_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", "base_heading"))), lambda x: x["base_heading"]).alias("headings"),
        F.array_sort(F.collect_list("chunk_id")).alias("ids")
    )
    named = decider.decide(
        listed, "heading_rank", {"query": F.lit(query), "headings": F.col("headings")}, "d"
    ).select("doc_id", "ids", F.posexplode(F.slice("d.headings", 1, 3)).alias("rank", "at"))
    named = named.select("doc_id", F.get("ids", F.col("at")).alias("chunk_id"), "rank").filter("chunk_id is not null")
    queries = query_rows(spark, [t.format(query) for t in TEMPLATES], embed)
    hits = vectors.with_heading_matches(
        vectors.top_k(store, queries, top_k, "chunk_key", by="doc_id").drop("doc_id"),
        vectors.heading_matches(store, queries, key="chunk_key"), "chunk_key"
    )
    best = hits.groupBy("chunk_key").agg(F.max("score").alias("score")).join(store.select("chunk_key", "doc_id", "chunk_id"), "chunk_key")
    semantic = best.withColumn(
        "rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "chunk_id"))
    ).select("doc_id", "chunk_id", "rank")
    order = vectors.candidate_list(named, semantic)
    gathered = gather.gather_full_section(chunks, order.select("doc_id", F.col("chunk_id").alias("anchor_id")), version)
    merged = gather.merge_chunks(gathered).join(order.select("doc_id", F.col("chunk_id").alias("anchor_id"), "rank"), ["doc_id", "anchor_id"])
    tried = decider.decide(merged, "verify", {"query": F.lit(query), "text": F.substring("content", 1, VERIFY_CHARS)}, "v")
    tried = tried.withColumn("verified", F.coalesce("v.verified", F.lit(False))).withColumn("output", F.when(F.col("verified"), F.col("v.output")))
    return vectors.first_verified(tried).select("doc_id", "heading", "content", "pages", "chunk_id", "verified", "output")


def extract_definitions(chunks: DataFrame, embed: Callable[[Column], Column], top_k: int = 10) -> DataFrame:
    """For each document, the definitions section by retrieval among its own chunks (top_k for each query), the best anchor among the hits, and the walk from it."""
    store = durable(_keyed(vectors.build_chunk_store(chunks, embed)))
    hits = vectors.top_k(store, query_rows(chunks.sparkSession, [*DEFINITION_QUERIES], embed), top_k, "chunk_key", by="doc_id")
    candidates = store.join(hits.select("chunk_key").distinct(), "chunk_key", "left_semi")
    anchors = vectors.pick_anchor(candidates.withColumn("position", F.struct("start_page", "chunk_id")), ["doc_id"], "position")
    return gather.stitch_full_texts(gather.walk_from_anchor(chunks, anchors.select("doc_id", F.col("chunk_id").alias("anchor_id"))))


def collate_statement(chunks: DataFrame, statement: str, embed: Callable[[Column], Column], decider: Decider) -> DataFrame:
    """One row: statement, terms, match_count, combined_context, sections, synthesis."""
    spark = chunks.sparkSession
    asked = decider.decide(spark.createDataFrame([(statement,)], "statement string"), "terms", {"statement": F.col("statement")}, "d")
    terms = asked.select(F.posexplode("d.terms").alias("query_id", "term")).withColumn("vector", embed(F.col("term")))
    store = durable(_keyed(vectors.build_chunk_store(chunks, embed)))
    ranked = collate.gather_relevant(collate.retrieve_for_terms(store, terms, key="chunk_key"), terms, key="chunk_key")
    one = collate.render(collate.collate(ranked, store, key="chunk_key"))
    counted = ranked.agg(F.count(F.lit(1)).alias("match_count")).crossJoin(one).crossJoin(asked.select("statement", F.col("d.terms").alias("terms")))
    out = decider.decide(counted, "synthesis", {"statement": F.col("statement"), "context": F.substring("combined_context", 1, CONTEXT_CHARS)}, "s")
    return out.select("statement", "terms", "match_count", "combined_context", "sections", F.col("s.output").alias("synthesis"))


class SectionIndex:
    """A document's chunks, embedded once and searched often; built over any number of documents."""

    def __init__(self, chunks: DataFrame, embed: Callable[[Column], Column]) -> None:
        self.embed, self.chunks = embed, chunks
        self.store = _keyed(vectors.build_chunk_store(chunks, embed)).persist()

    def search(self, query: str, top_k: int = 3, decider: Decider | None = None) -> DataFrame:
        """query, doc_id, heading, content, pages, chunk_ids (verified, output) of the section around each document's best hit; no row for a document without hits."""
        hits = vectors.top_k(self.store, query_rows(self.chunks.sparkSession, [query], self.embed), top_k, "chunk_key", by="doc_id").filter("rank = 1")
        anchors = self.store.join(hits.select("chunk_key"), "chunk_key", "left_semi").select("doc_id", F.col("chunk_id").alias("anchor_id"))
        found = gather.assemble_search(gather.search_section(self.chunks, anchors)).withColumn("query", F.lit(query))
        if decider is None:
            return found.withColumn("verified", F.lit(False)).withColumn("output", F.lit(None).cast("string"))
        told = decider.decide(found, "verify", {"query": F.lit(query), "text": F.substring("content", 1, VERIFY_CHARS)}, "v")
        verified = F.coalesce("v.verified", F.lit(False))
        return told.withColumn("verified", verified).withColumn("output", F.when(verified, F.col("v.output"))).drop("v")

    def close(self) -> None:
        self.store.unpersist()


def index_and_query(sections: DataFrame, queries: list[str], embed: Callable[[Column], Column], k: int = 5) -> DataFrame:
    """query_id, key, score, rank, text: long sections in pieces, the best piece of each section, the k best sections."""
    pieces = split.chunk_sections(sections)
    store = vectors.build_store(pieces, embed)
    hits = vectors.search(store, query_rows(sections.sparkSession, queries, embed), k)
    return hits.join(store.select("key", "text"), "key")

