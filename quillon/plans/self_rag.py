"""Answers that check their own sources: retrieve, keep what is relevant, answer from each, take the best supported."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.operators.decide import Decider
from quillon.operators.vectors import top_k

TOP_K = 3


def best_response(responses: DataFrame, by: str = "query_id") -> DataFrame:
    """Of the responses (position, support, utility) to each query, the fully supported ones first, then by utility, the first on ties."""
    order = Window.partitionBy(by).orderBy((F.lower(F.trim("support")) != "fully supported").cast("int"), F.desc("utility"), "position")
    return responses.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def self_rag(queries: DataFrame, store: DataFrame, decider: Decider, k: int = TOP_K) -> DataFrame:
    """query_id, response. queries: query_id, query, vector; store: key, content, vector."""
    ask = decider.decide
    asked = ask(queries, "retrieve", {"query": F.col("query")}, "d0")
    wants = F.coalesce(F.lower(F.trim("d0.response")) == "yes", F.lit(False))
    plain = asked.filter(~wants).select("query_id", "query", F.lit("No retrieval necessary.").alias("context"))
    wanted = asked.filter(wants).select("query_id", "query", "vector")
    hits = top_k(store, wanted, k, key="key", query="query_id").join(
        store.select("key", F.col("content").alias("context")), "key"
    ).join(wanted.select("query_id", "query"), "query_id")
    judged = ask(hits, "relevance", {"query": F.col("query"), "context": F.col("context")}, "d1")
    relevant = judged.filter(F.lower(F.trim("d1.response")) == "relevant")
    without = wanted.join(relevant.select("query_id").distinct(), "query_id", "left_anti").select(
        "query_id", "query", F.lit("No relevant context found.").alias("context")
    )
    answered = ask(
        relevant.select("query_id", "query", "context", F.col("rank").alias("position")), "generate",
        {"query": F.col("query"), "context": F.col("context")}, "g"
    ).withColumn("response", F.col("g.response"))
    answered = ask(answered, "support", {"response": F.col("response"), "context": F.col("context")}, "s").withColumn("support", F.col("s.response"))
    answered = ask(answered, "utility", {"query": F.col("query"), "response": F.col("response")}, "u").withColumn("utility", F.col("u.response"))
    rest = ask(
        plain.unionByName(without), "generate", {"query": F.col("query"), "context": F.col("context")}, "g"
    ).select("query_id", F.col("g.response").alias("response"))
    return best_response(answered).select("query_id", "response").unionByName(rest)
