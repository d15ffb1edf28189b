"""Block, paragraph, page, form-field and section tables from what extractors give.

raw blocks: doc_id, page_index (from 0), block_no, kind (0 for text), text, and n_pages if blank pages are to count.
Pages are numbered from 1 in everything that comes out; page 0 means that there is none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions import text as T
from quillon.operators.sections import joined

SHORT = 30
FORM_PROMPT_CHARS = 6000


def extract_blocks(raw: DataFrame) -> DataFrame:
    """doc_id, seq, page, text (and n_pages): stripped text blocks in page order; images and empty blocks are dropped."""
    rows = raw.filter("kind = 0").withColumn("text", T.strip("text")).filter("text <> ''")
    seq = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_index", "block_no")) - 1
    more = ["n_pages"] if "n_pages" in raw.columns else []
    return rows.select("doc_id", seq.alias("seq"), (F.col("page_index") + 1).alias("page"), "text", *more)


def second_half(blocks: DataFrame) -> DataFrame:
    """Blocks on pages whose index is at least half the number of pages, rounded up; a document of one page has none."""
    pages = F.col("n_pages") if "n_pages" in blocks.columns else F.max("page").over(Window.partitionBy("doc_id"))
    return blocks.withColumn("_n", pages).filter(F.col("page") - 1 >= F.ceil(F.col("_n") / 2)).drop("_n")


def structured_blocks(spans: DataFrame) -> DataFrame:
    """Blocks with font_size (largest) and is_bold (any) from spans: doc_id, page_index, block_no, line_no, span_no, text, size, font, x0, y0, x1, y1."""
    lines = spans.groupBy("doc_id", "page_index", "block_no", "line_no").agg(
        joined(F.collect_list(F.struct("span_no", "text")), "").alias("text"), F.max("size").alias("size"), F.bool_or(F.lower("font").contains("bold")).alias("bold"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
    )
    blocks = lines.groupBy("doc_id", "page_index", "block_no").agg(
        T.strip(joined(F.collect_list(F.struct("line_no", "text")), "\n")).alias("text"), F.max("size").alias("font_size"), F.bool_or("bold").alias("is_bold"),
        F.struct(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")).alias("bbox"),
    ).filter("text <> ''")
    seq = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_index", "block_no")) - 1
    return blocks.select("doc_id", seq.alias("seq"), (F.col("page_index") + 1).alias("page"), "block_no", "text", "font_size", "is_bold", "bbox")


def zero_based(blocks: DataFrame) -> DataFrame:
    """The same table with pages from 0, for consumers that expect that."""
    return blocks.withColumn("page", F.col("page") - 1)


def load_paragraphs(raw: DataFrame) -> DataFrame:
    """Blocks on one line each, of more than 30 characters, in reading order (y0, x0 if there are any)."""
    order = ["page_index", *[c for c in ("y0", "x0") if c in raw.columns], "block_no"]
    rows = raw.filter("kind = 0").withColumn("text", T.strip(F.regexp_replace("text", "\n", " "))).filter(F.length("text") > SHORT)
    seq = F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)) - 1
    return rows.select("doc_id", seq.alias("seq"), (F.col("page_index") + 1).alias("page"), "text")


def paged_paragraphs(paragraphs: DataFrame, longer_than: int = SHORT) -> DataFrame:
    """Pages of paragraphs (doc_id, seq, text, breaks) by counting the page breaks up to and including each one's own."""
    so_far = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = paragraphs.withColumn("page", (F.sum("breaks").over(so_far) + 1).cast("int")).withColumn("text", T.strip("text"))
    return rows.filter((F.col("text") != "") & (F.length("text") > longer_than)).select("doc_id", "seq", "page", "text")


def latin_1(text: Column) -> Column:
    """Characters that Latin-1 lacks as question marks."""
    return F.regexp_replace(text, r"[^\x00-\xFF]", "?")


def pages_as_documents(blocks: DataFrame, doc_name: Column | None = None) -> DataFrame:
    """doc_id, page, page_content (and doc_name): the non-empty blocks of each page; pages without any are left out. Images stay."""
    rows = blocks.withColumn("text", T.strip("text")).filter("text <> ''")
    out = rows.groupBy("doc_id", "page").agg(joined(F.collect_list(F.struct("seq", "text")), "\n").alias("page_content"))
    return out if doc_name is None else out.withColumn("doc_name", doc_name)


def extract_form_fields(cells: DataFrame) -> DataFrame:
    """doc_id, seq, page, name, value from table cells (doc_id, page, table_no, row_no, col_no, text).

    Rows need two columns, the first two of which are not empty; labels of bands are no fields.
    """
    value = lambda k: F.coalesce(T.strip(F.max(F.when(F.col("col_no") == k, F.col("text")))), F.lit(""))
    rows = cells.groupBy("doc_id", "page", "table_no", "row_no").agg(value(0).alias("name"), value(1).alias("value"), F.max("col_no").alias("last"))
    rows = rows.filter((F.col("last") >= 1) & (F.col("name") != "") & (F.col("value") != "") & ~T.is_section_label("name"))
    seq = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "table_no", "row_no")) - 1
    return rows.select("doc_id", seq.alias("seq"), "page", "name", "value")


def form_fields_with_fallback(cells: DataFrame, blocks: DataFrame, decide: Callable[[Column], Column]) -> DataFrame:
    """Fields from tables; documents without any are asked for by decide, which maps a prompt text to an array of (name, value, page)."""
    found = extract_form_fields(cells)
    text = F.substring(joined(F.collect_list(F.struct("seq", "text")), "\n"), 1, FORM_PROMPT_CHARS)
    asked = blocks.join(found.select("doc_id").distinct(), "doc_id", "left_anti").groupBy("doc_id").agg(text.alias("prompt"))
    fields = asked.select("doc_id", F.posexplode(decide(F.col("prompt"))).alias("seq", "f")).select(
        "doc_id", "seq", F.coalesce("f.page", F.lit(1)).alias("page"), "f.name", "f.value"
    )
    return found.unionByName(fields)


def load_sections_json(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the file), key, ord, text, page_numbers from files with one JSON object each: key to text, or to text and page_numbers."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), "value")
    flat = F.from_json("value", "map<string,string>")
    keys = F.json_object_keys("value")
    rows = files.select("doc_id", F.posexplode(keys).alias("ord", "key"), flat.alias("m")).select("doc_id", "key", "ord", F.col("m")[F.col("key")].alias("v"))
    nested = F.from_json("v", "text string, page_numbers array<int>")
    paged = rows.withColumn("n", F.when(F.col("v").startswith("{"), nested))
    return paged.select(
        "doc_id", "key", "ord", F.coalesce("n.text", "v").alias("text"),
        F.coalesce("n.page_numbers", F.array().cast("array<int>")).alias("page_numbers")
    )
