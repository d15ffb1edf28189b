"""Commands from a file to a result: python -m quillon COMMAND ...; each has a function of the same name, which other programs may call."""

from __future__ import annotations

import argparse
import importlib
import json
import sys
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import definitions as D
from quillon.operators import sections as S
from quillon.operators import split, vectors
from quillon.operators.chunks import infer_sections
from quillon.operators.decide import Decider, Rules
from quillon.plans import compare as compare_plan
from quillon.plans import extract, form_check, report
from quillon.sources import blocks as B
from quillon.sources import files

Embed = Callable[[Column], Column]


def read(spark: SparkSession, path: str) -> DataFrame:
    """Blocks (doc_id, seq, page, text) of .docx, .pdf or .parquet files."""
    if path.endswith(".docx"):
        return B.paged_paragraphs(files.read_docx(spark, path), 0)
    return spark.read.parquet(path) if path.endswith(".parquet") else B.extract_blocks(files.read_pdf(spark, path))


def sections(blocks: DataFrame, paged: bool = True) -> DataFrame:
    return files.keyed_json(S.parse_sections(blocks, paged=paged))


def schedules(blocks: DataFrame, paged: bool = True, stop_on_numbered_section: bool = False) -> DataFrame:
    return files.keyed_json(S.parse_schedules(blocks, stop_on_numbered_section=stop_on_numbered_section, paged=paged))


def definitions(blocks: DataFrame) -> DataFrame:
    return files.keyed_json(D.definitions(blocks), "term")


def chunks_of(blocks: DataFrame, decider: Decider, measure: Callable[[str], int] = len) -> DataFrame:
    """Chunks of blocks with fonts; blocks without any have no headings but inferred ones, which stand for them."""
    if {"font_size", "is_bold"} <= set(blocks.columns):
        return extract.prepare_chunks(blocks, decider, measure=measure)
    marked = infer_sections(blocks).withColumn("is_bold", F.col("section") == F.col("text")).withColumn("font_size", F.lit(1.0)).drop("section")
    return extract.prepare_chunks(marked, decider, measure=measure)


def extract_section(blocks: DataFrame, query: str, embed: Embed, decider: Decider, measure: Callable[[str], int] = len) -> DataFrame:
    return extract.extract_section(chunks_of(blocks, decider, measure), query, embed, decider)


def extract_definitions(blocks: DataFrame, embed: Embed, decider: Decider) -> DataFrame:
    return extract.extract_definitions(chunks_of(blocks, decider), embed)


def collate(blocks: DataFrame, statement: str, embed: Embed, decider: Decider) -> DataFrame:
    return extract.collate_statement(chunks_of(blocks, decider), statement, embed, decider)


def search(blocks: DataFrame, query: str, embed: Embed, decider: Decider) -> DataFrame:
    index = extract.SectionIndex(chunks_of(blocks, decider), embed)
    return index.search(query, decider=decider)


def index(blocks: DataFrame, queries: list[str], embed: Embed, k: int = 5) -> DataFrame:
    return extract.index_and_query(S.parse_sections(blocks).select("doc_id", "key", "ord", "text"), queries, embed, k)


def compare(base: DataFrame, other: DataFrame, embed: Embed, decider: Decider) -> DataFrame:
    """Deviation items of every page of other against base."""
    pages = lambda blocks: B.pages_as_documents(blocks).withColumnRenamed("page_content", "content").withColumn("vector", embed(F.col("content")))
    number = F.row_number().over(S.Window.partitionBy(F.lit(0)).orderBy("page")).cast("int")  # the pages of one document
    items = pages(other).withColumn("item_no", number).select("item_no", "page", "content", "vector")
    return compare_plan.compare_pages(items, pages(base).select(F.col("page").alias("key"), "page", "content", "vector"), decider)


def compare_whole(base: DataFrame, other: DataFrame, decider: Decider) -> DataFrame:
    one = lambda blocks: infer_sections(blocks.withColumn("doc_id", F.lit(0)))
    return compare_plan.compare_whole(one(base), one(other), decider)


def form(cells: DataFrame, blocks: DataFrame, embed: Embed, decider: Decider) -> DataFrame:
    """Results for the fields of a form's table cells against the sections of a document."""
    fields = B.extract_form_fields(cells).withColumn("vector", embed(F.concat_ws(" ", "name", "value")))
    found = S.parse_sections(blocks)
    return form_check.check_fields(fields, vectors.build_heading_store(found, embed), found.select("key", "text"), decider)


def _named(name: str):
    """module:attribute"""
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="quillon", description=__doc__)
    p.add_argument(
        "command",
        choices=["sections", "schedules", "definitions", "extract", "extract-definitions", "collate", "search", "index", "compare", "compare-whole", "form"]
    )
    p.add_argument("path", help="a .docx, .pdf or .parquet file of blocks; for form, .parquet table cells")
    p.add_argument("other", nargs="?", help="the document to compare with")
    p.add_argument("--query", action="append", default=[], help="what to look for, or the statement")
    p.add_argument(
        "--embed", default="quillon.operators.vectors:digest_embedder",
        help="module:function that gives an embedder; the default one has no meaning"
    )
    p.add_argument("--decider", default="quillon.operators.decide:Rules", help="module:function that gives a decider; the default one is a stand-in by rules")
    p.add_argument("--vocabulary", help="a tokenizers file that measures chunks; without it, characters do")
    p.add_argument("--report", action="store_true", help="Markdown instead of JSON lines, for compare and form")
    a = p.parse_args(argv)
    spark = spark or SparkSession.builder.appName("quillon").getOrCreate()
    embed, decider = _named(a.embed)(), Rules() if a.decider.endswith(":Rules") else _named(a.decider)()
    measure = split.token_measure(a.vocabulary) if a.vocabulary else len
    if a.command in ("extract", "collate", "search", "index") and not a.query or a.command in ("compare", "compare-whole", "form") and not a.other:
        p.error(f"{a.command} needs " + ("--query" if not a.query and not a.command.startswith(("compare", "form")) else "a second document"))
    blocks = None if a.command == "form" else read(spark, a.path)
    query = a.query[0] if a.query else ""
    found = {
        "sections": lambda: sections(blocks), "schedules": lambda: schedules(blocks), "definitions": lambda: definitions(blocks),
        "extract": lambda: extract_section(blocks, query, embed, decider, measure), "extract-definitions": lambda: extract_definitions(blocks, embed, decider),
        "collate": lambda: collate(blocks, query, embed, decider), "search": lambda: search(blocks, query, embed, decider), "index": lambda: index(blocks, a.query, embed),
        "compare": lambda: compare(blocks, read(spark, a.other), embed, decider), "compare-whole": lambda: compare_whole(blocks, read(spark, a.other), decider),
        "form": lambda: form(spark.read.parquet(a.path), read(spark, a.other), embed, decider),
    }[a.command]()
    if a.report and a.command == "compare":
        found = report.comparison_report(found, a.path, a.other)
    if a.report and a.command == "form":
        found = report.form_report(found, a.path, a.other)
    shown = found.columns[-1] if a.report or a.command in ("sections", "schedules", "definitions") else None
    for row in found.toLocalIterator():
        print(row[shown] if shown else json.dumps(row.asDict(recursive=True), ensure_ascii=False, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
