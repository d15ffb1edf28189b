"""Markdown reports and counts from result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as T

# The titles, heads and labels of the reports, and how many characters of a text they show.
FULL_CHARS, PLAIN_CHARS = 250, 300
COMPARISON_TITLE, FULL_MARK = "# Document Comparison Report", " (Self-RAG)"
FORM_TITLE = "# Credit Proposal vs Facility Agreement"
FORM_HEAD = "| # | Field | Form Value | Legal Section | Result | Notes |\n|---|---|---|---|---|---|\n"
COUNTS_HEAD = "| Match | Deviation | Unmatched | Total |\n|---|---|---|---|\n"
NOTHING = "_No clauses examined._\n"


def _rows(order: str, row: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), row.alias("r")))), lambda x: x["r"]), "")


def _cells(*cells: Column) -> Column:
    """Cells of a table line; a null one is empty, so that the others keep their columns."""
    return F.concat_ws(" | ", *(F.coalesce(c.cast("string"), F.lit("")) for c in cells))


def _line(*cells: Column) -> Column:
    return F.concat(F.lit("| "), _cells(*cells), F.lit(" |\n"))


def deviation_rows(items: DataFrame, full: bool = True) -> DataFrame:
    """item_no and its table line: ten columns, or the eight without type and materiality; texts are cut at 250, or 300, characters."""
    cut = FULL_CHARS if full else PLAIN_CHARS
    score = F.when(
        F.coalesce("score", F.lit(0)) != 0, F.concat(F.col("score").cast("string"), F.lit("/5 ("), F.col("severity"), F.lit(")"))
    ).otherwise("—") if full else None
    more = ["deviation_type", score] if full else []
    line = _line(
        F.col("item_no").cast("string"), F.col("section"), T.page_label("base_page"), T.page_label("compare_page"), T.truncated("base_paragraph", cut), T.truncated("compare_paragraph", cut),
        F.when(F.col("deviation"), "Yes").otherwise("No"), *(F.col(m) if isinstance(m, str) else m for m in more), F.coalesce(F.nullif(F.col("comments"), F.lit("")), F.lit("—")),
    )
    return items.select("item_no", "deviation", line.alias("line"))


def _counted() -> list[Column]:
    return [F.count_if("deviation").alias("n"), F.count(F.lit(1)).alias("all")]


def _columns(base_doc: str, compare_doc: str, full: bool) -> list[str]:
    if full:
        return ["#", "Section", f"`{base_doc}` Page", f"`{compare_doc}` Page", "Base Clause", "Compare Clause", "Deviation", "Type", "Materiality", "Comments"]
    return [
        "#", "Section", f"Source PDF `{base_doc}` Page", f"Compared Doc `{compare_doc}` Page", "Base Document Paragraph",
        "Compared Document Paragraph", "Deviation", "Comments"
    ]


def _comparison_parts(base_doc: str, compare_doc: str, full: bool, tokens_used: int) -> tuple[Column, str]:
    """What comes before the table's lines, given the counts n and all, and after them."""
    names = _columns(base_doc, compare_doc, full)
    head = "| " + " | ".join(names) + " |\n|" + "---|" * len(names) + "\n"
    used = f"**Total tokens used:** {tokens_used:,}  \n" if tokens_used and not full else ""
    before = F.concat(
        F.lit(
            f"{COMPARISON_TITLE}{FULL_MARK if full else ''}\n\n**Base document:** `{base_doc}`  \n**Compared document:** `{compare_doc}`  \n**Material deviations found:** "
        ),
        F.col("n").cast("string"),
        F.lit(f"  \n{used}\n---\n\n## Deviation Table\n\n"),
        F.when(F.col("all") == 0, NOTHING).otherwise(head),
    )
    return before, "\n---\n"


def comparison_report(items: DataFrame, base_doc: str, compare_doc: str, full: bool = True, tokens_used: int = 0) -> DataFrame:
    """One row, markdown: the report on two documents, whose items fit into one row. full is the report with types and materiality."""
    before, after = _comparison_parts(base_doc, compare_doc, full, tokens_used)
    one = deviation_rows(items, full).agg(*_counted(), _rows("item_no", F.col("line")).alias("rows"))
    return one.select(F.concat(before, "rows", F.lit(after)).alias("markdown"))


def comparison_lines(items: DataFrame, base_doc: str, compare_doc: str, full: bool = True, tokens_used: int = 0) -> DataFrame:
    """The same report as ordered rows (part, item_no, text) of any number of items, to be written without a task that holds them all."""
    before, after = _comparison_parts(base_doc, compare_doc, full, tokens_used)
    counted = items.agg(*_counted())
    edge = lambda part, text: counted.select(F.lit(part).alias("part"), F.lit(0).cast("long").alias("item_no"), text.alias("text"))
    body = deviation_rows(items, full).select(F.lit(1).alias("part"), F.col("item_no").cast("long").alias("item_no"), F.col("line").alias("text"))
    return edge(0, before).unionByName(body).unionByName(edge(2, F.lit(after))).orderBy("part", "item_no")


def counts(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """matches, deviations, unmatched, total of tri-state results."""
    m = F.col("match")
    return results.groupBy(*(by or [])).agg(
        F.count_if(m).alias("matches"), F.count_if(~m).alias("deviations"), F.count_if(m.isNull()).alias("unmatched"),
        F.count(F.lit(1)).alias("total")
    )


def form_report(results: DataFrame, proposal: str, legal: str) -> DataFrame:
    """One row, markdown: results (seq, name, value, section_key, section_heading, match, reason) with counts."""
    section = F.when(F.col("section_key") == "—", "—").otherwise(F.concat_ws(" ", "section_key", "section_heading"))
    numbered = results.withColumn("_line", _cells(F.col("name"), F.col("value"), section, T.match_label("match"), F.col("reason")))
    rows = F.array_sort(F.collect_list(F.struct("seq", "_line")))
    lines = F.array_join(F.transform(rows, lambda x, i: F.concat(F.lit("| "), (i + 1).cast("string"), F.lit(" | "), x["_line"], F.lit(" |\n"))), "")
    m = F.col("match")
    out = numbered.agg(
        F.count_if(m).alias("a"), F.count_if(~m).alias("b"), F.count_if(m.isNull()).alias("c"), F.count(F.lit(1)).alias("n"),
        lines.alias("lines")
    )
    return out.select(F.concat(
        F.lit(f"{FORM_TITLE}\n\n**Proposal:** `{proposal}`  \n**Legal document:** `{legal}`  \n\n{COUNTS_HEAD}"),
        F.format_string("| %d | %d | %d | %d |\n\n---\n\n## Field-by-Field Results\n\n", "a", "b", "c", "n"), F.lit(FORM_HEAD), "lines", F.lit("\n---\n"),
    ).alias("markdown"))
