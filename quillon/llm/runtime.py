"""What the corpus operators share: tables, durable intermediate results, Arrow plumbing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.durable import durable, remove, shared_folder

__all__ = ["NO_ID", "BATCH_ROWS", "table", "tune", "shared_folder", "durable", "remove", "unused", "texts_of", "as_large_text", "bytes_and_offsets", "slices"]

#: Stands for a null id where a key must not be null.
NO_ID = -(2**63)
#: Rows in an Arrow batch, so that long texts do not add up in a Python worker.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small; read when a plan runs, so set before planning."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def unused(docs: DataFrame, *names: str) -> list[str]:
    """The names, with underscores after those that docs has a column of."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def texts_of(docs: DataFrame, *more: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and text under fixed names, null text as empty; columns of other names are dropped."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *more)


def as_large_text(column: pa.Array) -> pa.LargeStringArray:
    """One contiguous text column without nulls and with 64-bit offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def bytes_and_offsets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts after one another, and where each begins (one more at the end)."""
    texts = as_large_text(column)
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(column: pa.Array, most_bytes: int) -> list[tuple[int, int]]:
    """Ranges of rows whose texts come to about most_bytes; a longer text has a range of its own."""
    _, at = bytes_and_offsets(column)
    out, begin = [], 0
    while begin < len(at) - 1:
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + most_bytes, "right")) - 1)
        out.append((begin, end))
        begin = end
    return out
