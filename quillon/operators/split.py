"""Splitting of long texts at the coarsest separator that does, with overlap.

The only operator here that runs in Python: how pieces fill up depends on all pieces before them. Each row is split by
itself, in Arrow batches, so there is no shuffle.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions import text as T

DEFAULT_SEPARATORS = ("\n\n", "\n", " ", "")
SENTENCE_SEPARATORS = ("\n\n", "\n", ". ", " ", "")
SECTION_CHARS, SECTION_OVERLAP = 21_000, 800
FONT_CHARS, FONT_OVERLAP = 27_500, 500
CHUNK_TOKENS, TOKEN_OVERLAP = 8192, 50


class Splitter:
    """Splits at the first separator that occurs, each staying before what follows it; pieces that are too long go on to the next one.

    Pieces are filled up to size (as measured); a piece begins with what the one before ends with, up to overlap.
    """

    def __init__(self, size: int, overlap: int, separators: tuple[str, ...] = DEFAULT_SEPARATORS, measure: Callable[[str], int] = len) -> None:
        if overlap > size:
            raise ValueError("the overlap exceeds the size")
        self.size, self.overlap, self.separators, self.measure = size, overlap, separators, measure

    def split(self, text: str) -> list[str]:
        return self._split(text, self.separators)

    def _split(self, text: str, separators: tuple[str, ...]) -> list[str]:
        at = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
        separator, finer = separators[at], separators[at + 1 :]
        if separator:
            first, *rest = text.split(separator)
            parts = [p for p in (first, *(separator + r for r in rest)) if p]
        else:
            parts = list(text)
        out, fitting = [], []
        for part in parts:
            if self.measure(part) < self.size:
                fitting.append(part)
                continue
            out += self._fill(fitting)
            fitting = []
            out += self._split(part, finer) if finer else [part]
        return out + self._fill(fitting)

    def _fill(self, parts: list[str]) -> list[str]:
        out, window, sizes = [], [], []
        for part in parts:
            n = self.measure(part)
            if window and sum(sizes) + n > self.size:
                out.append("".join(window).strip())
                while window and (sum(sizes) > self.overlap or sum(sizes) + n > self.size):
                    window.pop(0)
                    sizes.pop(0)
            window.append(part)
            sizes.append(n)
        if window:
            out.append("".join(window).strip())
        return [x for x in out if x]


def split_column(rows: DataFrame, column: str, splitter: Splitter, out: str = "pieces") -> DataFrame:
    """rows with an array of the pieces of a text column."""

    @F.pandas_udf("array<string>")
    def pieces(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(splitter.split)

    return rows.withColumn(out, pieces(F.col(column)))


def token_measure(file: str) -> Callable[[str], int]:
    """Counts tokens with a vocabulary file of the tokenizers library, which every executor must have at that path."""

    def count(text: str) -> int:
        return len(_vocabulary(file).encode(text, add_special_tokens=False).ids)

    return count


@functools.cache
def _vocabulary(file: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(file)


def chunk_sections(sections: DataFrame, size: int = SECTION_CHARS, overlap: int = SECTION_OVERLAP) -> DataFrame:
    """sections (doc_id, key, ord, text, ...) with long texts in pieces, under keys that count them; other columns go with each piece.

    A text that comes out in one piece keeps its key, and its whole row if the sections have pages.
    """
    long = F.length("text") > size
    cut = split_column(sections.filter(long), "text", Splitter(size, overlap))
    n = F.size("pieces")
    paged = "page_numbers" in sections.columns
    cut = cut.select(
        *[c for c in sections.columns if c not in ("key", "text")], "key", F.col("text").alias("_whole"), n.alias("_n"),
        F.posexplode("pieces").alias("_i", "_piece")
    )
    key = F.when(F.col("_n") == 1, F.col("key")).otherwise(F.format_string("%s [%d/%d]", "key", F.col("_i") + 1, "_n"))
    text = F.when((F.col("_n") == 1) & F.lit(paged), F.col("_whole")).otherwise(F.col("_piece"))
    cut = cut.withColumn("key", key).withColumn("text", text).withColumn("piece", F.col("_i")).select(*sections.columns, "piece")
    whole = sections.filter(~long | F.col("text").isNull()).withColumn("piece", F.lit(0))
    return whole.unionByName(cut)


def split_oversized_chunks(chunks: DataFrame, size: int = CHUNK_TOKENS, overlap: int = TOKEN_OVERLAP, measure: Callable[[str], int] = len) -> DataFrame:
    """chunks (doc_id, chunk_id, heading, content, ...) whose full text is longer than size, by content, into parts; ids are given anew.

    measure counts a text's tokens; with len it counts characters. Other columns go with each part.
    """

    @F.pandas_udf("int")
    def measured(texts: pd.Series) -> pd.Series:
        return texts.map(measure).astype("int32")

    total = F.length(T.full_text("heading", "content")) if measure is len else measured(T.full_text("heading", "content"))
    sized = chunks.withColumn("_long", total > size)
    whole = sized.filter("not _long").drop("_long").withColumn("_i", F.lit(0))
    cut = split_column(sized.filter("_long").drop("_long"), "content", Splitter(size, overlap, SENTENCE_SEPARATORS, measure))
    rest = [c for c in chunks.columns if c not in ("heading", "content")]
    cut = cut.select(*rest, "heading", F.posexplode("pieces").alias("_i", "content"))
    cut = cut.withColumn("heading", F.format_string("%s (part %d)", "heading", F.col("_i") + 1))
    both = whole.unionByName(cut)
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_id", "_i")) - 1
    return both.withColumn("_new", number).withColumn("chunk_id", F.col("_new")).select(*chunks.columns)


def split_by_font_size(chunks: DataFrame) -> DataFrame:
    """The variant that counts characters."""
    return split_oversized_chunks(chunks, FONT_CHARS, FONT_OVERLAP)
