"""Page-by-page comparison of two documents, and single-prompt comparison.

Each step asks its question only of the items that are still open; an item that a step ends meets no further decision.
A failed decision (null) ends or degrades its own item, never the run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions import text as T
from quillon.operators.decide import Decider
from quillon.operators.sections import in_order, joined
from quillon.operators.vectors import top_k

NEIGHBOURS = 5
CONTEXT_LIMIT, CONTEXT_SHARE = 131_072, 0.85
LONG_LABEL, LABEL_PROMPT_CHARS = 50, 120


def retrieve_candidates(items: DataFrame, base: DataFrame, k: int = NEIGHBOURS, by: str | None = None) -> DataFrame:
    """item_no, (by,) candidates: array of (index, page, content, score), best first. base has key, page, content, vector; with by, items meet only their own by."""
    own = [by] if by else []
    hits = top_k(base, items.select("item_no", "vector", *own), k, key="key", query="item_no", by=by)
    rows = hits.join(base.select("key", "page", "content", *own), ["key", *own])
    one = F.struct((F.col("rank") - 1).alias("index"), "page", "content", "score")
    return rows.groupBy("item_no", *own).agg(F.array_sort(F.collect_list(one)).alias("candidates"))


def compare_pages(compare: DataFrame, base: DataFrame, decider: Decider, k: int = NEIGHBOURS, by: str | None = None) -> DataFrame:
    """One deviation item for each page of compare (item_no, page, content, vector) against base (key, page, content, vector).

    With by, a column of both, many pairs of documents are compared at once, each within itself; keys are unique within it. Every item is in one
    row from beginning to end; a step asks only about items that are open. Pages of the base document that no page is compared with
    are not reported (see omitted_pages).
    """
    ask, own = decider.decide, [by] if by else []
    true = lambda c: F.coalesce(c, F.lit(False))
    items = compare.select("item_no", *own, F.col("page").alias("compare_page"), F.col("content").alias("compare_paragraph"), "vector")
    items = ask(items, "clause_match", {"clause": F.col("compare_paragraph")}, "d1").withColumn("needs", true(F.col("d1.needs_lookup")))
    rows = items.join(retrieve_candidates(items.filter("needs"), base, k, by), ["item_no", *own], "left").drop("vector")
    rows = ask(rows, "best_match", {"compare_clause": F.col("compare_paragraph"), "candidates": F.col("candidates")}, "d3", F.col("candidates").isNotNull())
    index = F.col("d3.best_index")
    rows = rows.withColumn("sure", true((F.col("d3.confidence") != "Low") & (index >= 0) & (index < F.size("candidates"))))
    rows = rows.withColumn("b", F.when(F.col("sure"), F.get("candidates", index))).drop("candidates")
    rows = ask(rows, "targeted_context", {"base_text": F.col("b.content"), "compare_clause": F.col("compare_paragraph")}, "d35", F.col("sure"))
    snippet = T.strip(F.coalesce(F.col("d35.snippet"), F.lit("")))
    rows = rows.withColumn("snippet", F.when(snippet != "", snippet).otherwise(F.col("b.content")))
    both = {"base_clause": F.col("snippet"), "compare_clause": F.col("compare_paragraph")}
    rows = ask(rows, "deviation", both, "d4", F.col("sure"))
    rows = rows.withColumn("told", F.col("d4.has_deviation").isNotNull()).withColumn("differs", true(F.col("d4.has_deviation"))).withColumn("kind", F.col("d4.deviation_type"))
    rows = ask(rows, "section_label", both, "d5", F.col("told"))
    comment = both | {"deviation_type": F.col("kind")}
    rows = ask(rows, "comment", comment | {"correction_notes": F.lit("")}, "d6", F.col("differs"))
    rows = ask(rows, "grounding", {"comments": F.col("d6.comments")} | both, "d7", F.col("differs"))
    weak = true(~F.col("d7.grounded") & (F.coalesce("d7.issues", F.lit("")) != ""))
    rows = ask(rows, "comment", comment | {"correction_notes": F.col("d7.issues")}, "d6b", weak).withColumn("text", F.coalesce("d6b.comments", "d6.comments"))
    rows = ask(rows, "materiality", {"deviation_type": F.col("kind"), "comments": F.col("text")} | both, "d8", F.col("differs"))
    given = lambda c, otherwise: F.coalesce(c, F.lit(otherwise))
    return rows.select(
        *own,
        "item_no",
        F.when(F.col("told"), given("d5.section", "N/A")).otherwise("N/A").alias("section"),
        given("b.page", 0).cast("int").alias("base_page"),
        "compare_page",
        F.when(F.col("sure"), F.col("snippet")).otherwise("").alias("base_paragraph"),
        "compare_paragraph",
        F.col("differs").alias("deviation"),
        F.when(F.col("differs"), F.col("kind")).otherwise("none").alias("deviation_type"),
        F.when(F.col("differs"), given("d8.score", 0)).otherwise(0).alias("score"),
        F.when(F.col("differs"), given("d8.severity", "N/A")).otherwise("N/A").alias("severity"),
        F.when(F.col("differs"), F.col("text")).alias("comments"),
    )


def omitted_pages(base: DataFrame, items: DataFrame) -> DataFrame:
    """Pages of base that no item was matched with: what a comparison from the other side cannot see."""
    return base.join(items.filter("base_page <> 0").select(F.col("base_page").alias("page")).distinct(), "page", "left_anti")


def item_problems(items: DataFrame) -> DataFrame:
    """Items that break an invariant, with the reason."""
    problem = (
        F.when(F.col("deviation") & F.coalesce(T.strip("comments"), F.lit("")).isin(""), "a deviation has no comments")
        .when(~F.col("score").between(0, 5), "the score is out of range")
    )
    return items.withColumn("problem", problem).filter("problem is not null")


def normalised_items(items: DataFrame) -> DataFrame:
    """Items without deviation have no comments."""
    return items.withColumn("comments", F.when(F.col("deviation"), F.col("comments")))


def whole_prompt(paragraphs: DataFrame) -> DataFrame:
    """doc_id, prompt, tokens: a document as one prompt shows it, and its estimated size."""
    number = F.row_number().over(in_order()) - 1
    lines = paragraphs.withColumn("_i", number).withColumn("_line", T.paragraph_line(F.col("_i"), F.col("page"), F.col("section"), F.col("text")))
    text = joined(F.collect_list(F.struct("_i", F.col("_line").alias("text"))), "\n\n")
    return lines.groupBy("doc_id").agg(text.alias("prompt")).withColumn("tokens", T.estimated_tokens("prompt"))


def check_context(tokens: Column, limit: int = CONTEXT_LIMIT) -> Column:
    """null, or an error when a row's prompt goes over the share of the limit that is safe."""
    return F.assert_true(tokens <= int(limit * CONTEXT_SHARE), F.concat(F.lit("the prompt is too long: "), tokens.cast("string")))


def fix_section_labels(items: DataFrame, relabel: Callable[[Column], Column], by: list[str]) -> DataFrame:
    """If any label of a comparison (by) is longer than 50 characters, all of its labels are given anew by relabel, which gets their first 120 characters."""
    long = F.max(F.length("section")).over(Window.partitionBy(*by)) > LONG_LABEL
    return items.withColumn("_long", long).withColumn(
        "section",
        F.when(F.col("_long"), F.coalesce(relabel(F.substring("section", 1, LABEL_PROMPT_CHARS)), F.col("section"))).otherwise(F.col("section"))
    ).drop("_long")


def provider(base_url: str, asked: str = "auto") -> str:
    """Which kind of endpoint a URL is, unless one is asked for."""
    if asked != "auto":
        return asked
    return "ollama" if "localhost" in base_url or "127.0.0.1" in base_url else "openai"


def compare_whole(base: DataFrame, compared: DataFrame, decider: Decider, limit: int = CONTEXT_LIMIT) -> DataFrame:
    """Items from one decision over two whole documents (doc_id, seq, page, section, text); pairs are those of equal doc_id.

    A pair that goes over the share of the context that is safe has no items but the reason in problem, and so has a failed decision.
    """
    a, b = (
        whole_prompt(x).select("doc_id", F.col("prompt").alias(n), F.col("tokens").alias(f"{n}_tokens")) for x,
        n in ((base, "base"), (compared, "compare"))
    )
    pairs = a.join(b, "doc_id").withColumn("tokens", F.col("base_tokens") + F.col("compare_tokens"))
    fits = F.col("tokens") <= int(limit * CONTEXT_SHARE)
    asked = decider.decide(pairs.filter(fits), "whole_comparison", {"base": F.col("base"), "compare": F.col("compare")}, "d")
    failed = asked.filter("d.items is null").select("doc_id", F.lit("the decision failed").alias("problem"))
    long = pairs.filter(~fits).select("doc_id", F.format_string("the prompt has some %d tokens", "tokens").alias("problem"))
    told = asked.select("doc_id", F.posexplode("d.items").alias("item_no", "i")).select("doc_id", (F.col("item_no") + 1).alias("item_no"), "i.*")
    return normalised_items(told).unionByName(failed.unionByName(long), allowMissingColumns=True)
