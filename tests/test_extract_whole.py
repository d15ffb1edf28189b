from pyspark.sql import functions as F

from quillon.operators import vectors
from quillon.operators.decide import Rules
from quillon.plans import extract


def test_every_document_gets_its_sections(spark):
    """More documents than top_k for all queries together could reach; no heading is named by the query."""
    rows = [(d, i, f"{i + 1}. Part", f"text {d} {i}", [i + 1], i + 1) for d in range(30) for i in range(2)]
    chunks = spark.createDataFrame(rows, "doc_id long, chunk_id int, heading string, content string, pages array<int>, start_page int")
    embed = vectors.digest_embedder()
    assert sorted(r.doc_id for r in extract.extract_definitions(chunks, embed, 1).select("doc_id").collect()) == [*range(30)]
    found = extract.extract_section(chunks.withColumn("parent_heading", F.col("heading")), "zzz", embed, Rules(), 1)
    assert sorted(r.doc_id for r in found.select("doc_id").collect()) == [*range(30)]
