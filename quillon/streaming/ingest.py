"""Blocks as a stream: new files become sections as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

BLOCKS = "doc_id long, seq int, page int, text string"


def read_blocks(spark: SparkSession, path: str, schema: str = BLOCKS, files_per_trigger: int = 1000) -> DataFrame:
    """Blocks of the Parquet files that come to path; a document's blocks lie in one file."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def write_sections(blocks: DataFrame, operator: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Applies a batch operator (which orders blocks within documents) to each micro-batch and writes the result under path.

    Each batch has a folder of its own that is overwritten, so a batch that is run again after a failure leaves no second copy.
    """

    def batch(rows: DataFrame, number: int) -> None:
        operator(rows).write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = blocks.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if once else query).start()
