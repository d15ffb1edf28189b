"""Files to tables, and tables to files. Bytes are read by Spark, so any store that Spark reads will do."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the XML namespace of word-processing documents.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
RAW_BLOCKS = "doc_id string, n_pages int, page_index int, block_no int, kind int, text string, x0 double, y0 double, x1 double, y1 double"


def docx_paragraphs(data: bytes) -> Iterator[tuple[int, str, int]]:
    """(seq, text, page breaks) of the body's paragraphs; rendered and hard page breaks both count."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{W}body")
    for seq, p in enumerate(body.iterfind(f"{W}p")):
        text, breaks = [], 0
        for x in p.iter():
            if x.tag == f"{W}t":
                text.append(x.text or "")
            elif x.tag == f"{W}tab":
                text.append("\t")
            elif x.tag == f"{W}lastRenderedPageBreak" or x.tag == f"{W}br" and x.get(f"{W}type") == "page":
                breaks += 1
            elif x.tag in (f"{W}br", f"{W}cr"):
                text.append("\n")
        yield seq, "".join(text), breaks


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the path), seq, text, breaks of the paragraphs of .docx files."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, data in zip(part["path"], part["content"], strict=True):
                yield pd.DataFrame([(name, *p) for p in docx_paragraphs(data)], columns=["doc_id", "seq", "text", "breaks"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path).select("path", "content")
    return files.mapInPandas(run, "doc_id string, seq int, text string, breaks int")


def read_pdf(spark: SparkSession, path: str, extract: Callable[[bytes], Iterable[tuple]] | None = None) -> DataFrame:
    """Raw blocks of .pdf files. extract maps a file's bytes to rows of RAW_BLOCKS without doc_id.

    Without extract pymupdf is used; there is none where this was tested, so that branch has not been run.
    """

    def with_pymupdf(data: bytes) -> Iterator[tuple]:
        import pymupdf

        with pymupdf.open(stream=data, filetype="pdf") as doc:
            for i, page in enumerate(doc):
                for b in page.get_text("blocks"):
                    yield len(doc), i, int(b[5]), int(b[6]), b[4], *map(float, b[:4])

    get = extract or with_pymupdf

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split(" ")[0] for f in RAW_BLOCKS.split(", ")]
        for part in parts:
            for name, data in zip(part["path"], part["content"], strict=True):
                yield pd.DataFrame([(name, *row) for row in get(data)], columns=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select("path", "content")
    return files.mapInPandas(run, RAW_BLOCKS)


SHAPES = "doc_id string, kind string, page int, no long, x0 double, y0 double, x1 double, y1 double, text string, font_size double, span_color int, color array<double>, fill array<double>"


def read_pdf_shapes(spark: SparkSession, path: str, extract: Callable[[bytes], Iterable[tuple]] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables drawings, words and chars of .pdf files, as the operators on struck-out text take them.

    extract maps a file's bytes to rows of SHAPES without doc_id, of the kinds drawing, word and char; without it pymupdf is used (there is
    none where this was tested, so that branch has not been run).
    """

    def with_pymupdf(data: bytes) -> Iterator[tuple]:
        import pymupdf

        with pymupdf.open(stream=data, filetype="pdf") as doc:
            for number, page in enumerate(doc, 1):
                for k, d in enumerate(page.get_drawings()):
                    yield "drawing", number, k, *map(float, d["rect"]), None, None, None, *(
                        list(map(float, d[c])) if d.get(c) else None for c in ("color", "fill")
                    )
                for k, w in enumerate(page.get_text("words")):
                    yield "word", number, k, *map(float, w[:4]), w[4], None, None, None, None
                spans = [s for b in page.get_text("rawdict")["blocks"] for line in b.get("lines", []) for s in line["spans"]]
                for k, (span, c) in enumerate((s, c) for s in spans for c in s["chars"]):
                    yield "char", number, k, *map(float, c["bbox"]), c["c"], float(span["size"]), int(span["color"]), None, None

    get, names = extract or with_pymupdf, [f.split(" ")[0] for f in SHAPES.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, data in zip(part["path"], part["content"], strict=True):
                yield pd.DataFrame([(name, *row) for row in get(data)], columns=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select("path", "content")
    shapes = files.mapInPandas(run, SHAPES)
    box = ["x0", "y0", "x1", "y1"]
    drawings = shapes.filter("kind = 'drawing'").select("doc_id", "page", F.col("no").alias("drawing_id"), *box, "color", "fill")
    words = shapes.filter("kind = 'word'").select("doc_id", "page", F.col("no").alias("seq"), *box, F.col("text").alias("word"))
    chars = shapes.filter("kind = 'char'").select("doc_id", "page", F.col("no").alias("seq"), *box, F.col("text").alias("c"), "font_size", "span_color")
    return drawings, words, chars


def keyed_json(keyed: DataFrame, key: str = "key") -> DataFrame:
    """doc_id, json: one object for each document, keys in order; values are texts, or objects with page_numbers if there are any."""
    value = F.to_json(F.struct("text", "page_numbers"), {"pretty": "true"}) if "page_numbers" in keyed.columns else F.regexp_extract(F.to_json(F.struct("text")), r'(?s)^\{"text":(.*)\}$', 1)
    name = F.regexp_extract(F.to_json(F.struct(F.col(key).alias("k"))), r'(?s)^\{"k":(.*)\}$', 1)
    entry = F.concat(F.lit("  "), name, F.lit(": "), F.regexp_replace(value, "\n", "\n  "))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("ord", entry.alias("e")))), lambda x: x["e"])
    return keyed.groupBy("doc_id").agg(F.concat(F.lit("{\n"), F.array_join(rows, ",\n"), F.lit("\n}")).alias("json"))


def write_texts(rows: DataFrame, column: str, path: str, mode: str = "overwrite") -> None:
    """One text for each row, as files under path."""
    rows.select(F.col(column).alias("value")).write.mode(mode).text(path)
