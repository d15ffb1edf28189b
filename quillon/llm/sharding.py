"""Sharding by longest-processing-time scheduling.

Rows with equal texts form a group that stays together. The largest group that is left goes to the least-loaded shard. This law
looks at sizes only, so groups of one size may change places: they are counted for each size, the driver schedules
sizes with their counts through a heap, and the groups of a size, numbered by the hashes of their texts, are dealt to
the shards by these counts. The driver gets a row for each different size; n different sizes take at least n * n / 2 bytes of text, so
100 TB have 14 million at most.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.llm.runtime import durable, texts_of

SHARDS = 16
#: Sizes up to which the table of their shards is broadcast (some 150 bytes each), and runs of numbers (some 50 bytes each).
BROADCAST_SIZES, BROADCAST_RUNS = 100_000, 300_000


def schedule(items: list[tuple[str, int]], shards: int) -> dict[str, int]:
    """Longest processing time first: the largest item that is left goes to the least-loaded shard.

    items are (name, size); ties are broken by name and by shard number, so the result is always the same.
    """
    heap = [(0, shard) for shard in range(shards)]
    out = {}
    for name, size in sorted(items, key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(heap)
        out[name] = shard
        heapq.heappush(heap, (load + size, shard))
    return out


def _filled(heap: list[tuple[int, int]], size: int, count: int) -> int:
    """The highest load up to which items of a size can be given to all shards without giving more than count."""
    low, high = min(heap)[0] - 1, min(heap)[0] + size * count
    while low < high:
        level = (low + high + 1) // 2
        given = sum((level - load) // size + 1 for load, _ in heap if load <= level)
        low, high = (level, high) if given <= count else (low, level - 1)
    return low


def schedule_sizes(sizes: Iterable[tuple[int, int]], shards: int) -> list[list[int]]:
    """For each (size, count), sizes falling: how many items of that size each shard gets from schedule().

    A shard is picked when its load is the least, so of many items of one size those picks that begin at or under a level are
    counted, not made one by one; the few that are left go through the heap.
    """
    heap, out = [(0, shard) for shard in range(shards)], []
    for size, count in sizes:
        given = [0] * shards
        if count > 2 * shards:
            level = _filled(heap, size, count)
            for k, (load, shard) in enumerate(heap):
                if load <= level:
                    given[shard] = (level - load) // size + 1
                    heap[k] = (load + given[shard] * size, shard)
            heapq.heapify(heap)
        for _ in range(count - sum(given)):
            load, shard = heapq.heappop(heap)
            given[shard] += 1
            heapq.heappush(heap, (load + size, shard))
        out.append(given)
    return out


def numbered(rows: DataFrame, by: str, number: str, *order: str) -> DataFrame:
    """rows with gapless numbers from 0 for each value of by (nulls first in order), without one task for a whole value. Durable."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The last key parts rows that are equal in all others, so a value of any size can be cut.
    keys = [by, *(F.col(c).asc_nulls_first() for c in order), "_tie"]
    ranged = durable(
        rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop("_tie").withColumn("_at", F.monotonically_increasing_id())
    )
    part = F.shiftright("_at", 33)
    runs = ranged.groupBy(by, part.alias("_part")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    # A row for each value and partition that it is in.
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = durable(runs.select(by, "_part", (before - F.col("_first")).alias("_shift")))
    runs = F.broadcast(runs) if runs.count() <= BROADCAST_RUNS else runs
    return ranged.withColumn("_part", part).join(runs, [by, "_part"]).withColumn(number, F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for each row of docs.

    size is the UTF-8 length plus 1, so that empty and null texts weigh 1. Rows of equal text share a shard, however many they are;
    slots count from 0 within each shard by doc_id (nulls first, repeated rows in any order). Other columns are ignored. An empty
    table gives no rows.
    """
    rows = durable(
        texts_of(docs).select(
            "doc_id", (F.octet_length("text").cast("long") + 1).alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
            F.unhex(F.sha2("text", 256)).alias("sha")
        )
    )
    groups = numbered(rows.groupBy("sha").agg(F.sum("size").alias("bytes")), "bytes", "place", "sha")
    counts = groups.groupBy("bytes").agg(F.max("place").alias("last")).orderBy(F.desc("bytes")).toArrow()
    sizes = [(size, last + 1) for size, last in zip(counts.column("bytes").to_pylist(), counts.column("last").to_pylist(), strict=True)]
    ends = np.cumsum(np.array(schedule_sizes(sizes, shards), np.int64).reshape(-1, shards), axis=1)
    table = pa.table({"bytes": pa.array([s for s, _ in sizes], pa.int64()), "ends": pa.array([*ends], pa.list_(pa.int64()))})
    table = rows.sparkSession.createDataFrame(table)
    table = F.broadcast(table) if len(sizes) <= BROADCAST_SIZES else table
    shard = F.size(F.filter("ends", lambda end: end <= F.col("place"))).alias("shard")
    # Durable, so that a hot group's rows can be split where they meet their group.
    placed = durable(groups.join(table, "bytes").select("sha", shard))
    return slots(rows.join(placed, "sha").select("doc_id", "size", "text_crc32", "shard"))


def slots(rows: DataFrame) -> DataFrame:
    """rows with slot: gapless numbers from 0 in each shard by doc_id."""
    return numbered(rows, "shard", "slot", "doc_id", "text_crc32")
