"""Token ids on disk: fixed-size blocks, transposed into byte or bit planes, each plane under zstandard.

Documents are dealt by ranges of doc_id and sorted. Each partition's ids form one stream; it is cut into segments of
whole documents, and a segment into blocks of BLOCK_IDS ids. A block's ids are transposed so that the first bytes (or
bits) of all ids come together, then the second ones, and so on. The segment's index has, for each block, its number of
ids and the length of each compressed plane. Segments are written by Spark's own writer, so the folder may be anywhere
that Spark can write, task retries leave no half-written files, and any segment can be decoded by itself.
"""

from __future__ import annotations

import functools
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.llm import pieces
from quillon.llm.runtime import shared_folder, slices, texts_of, tune

BLOCK_IDS = 16384
#: Some 200 KB a segment once packed, so a batch of them stays small.
SEGMENT_IDS = 1 << 17
END_ID = 2
SLICE_BYTES = 1 << 20
SEGMENT = "part int, segment int, part_start long, n_ids long, doc_ids array<long>, lengths array<long>, planes string, index binary, payload binary"


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The 4 byte planes or 32 bit planes of unsigned 32-bit ids, lowest first."""
    data = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [np.ascontiguousarray(data[:, k]).tobytes() for k in range(4)]
    bits = np.unpackbits(data, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    if kind == "byte":
        data = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
        data = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(data).view("<u4").reshape(-1)


def pack(ids: np.ndarray, kind: str = "byte", block: int = BLOCK_IDS, level: int = 3) -> tuple[bytes, bytes]:
    """(index, payload) of a segment. The index has a row of 32-bit numbers for each block: ids, then plane lengths."""
    squeeze, index, payload = zstandard.ZstdCompressor(level=level), [], []
    for at in range(0, len(ids), block):
        part = ids[at : at + block]
        planes = [squeeze.compress(p) for p in to_planes(part, kind)]
        index.append([len(part), *map(len, planes)])
        payload += planes
    return np.array(index, "<u4").tobytes(), b"".join(payload)


def unpack(index: bytes, payload: bytes, kind: str = "byte") -> np.ndarray:
    width, expand, at, out = 5 if kind == "byte" else 33, zstandard.ZstdDecompressor(), 0, []
    for n, *lengths in np.frombuffer(index, "<u4").reshape(-1, width).tolist():
        planes = []
        for length in lengths:
            planes.append(expand.decompress(payload[at : at + length]))
            at += length
        out.append(from_planes(planes, n, kind))
    return np.concatenate(out) if out else np.zeros(0, "<u4")


@functools.cache
def encoder(file: str) -> pieces.Encoder:
    """For tokenizers that drop white space and split words, digits and signs."""
    return pieces.Encoder(file, pieces.words)


def ids_of(texts: pa.Array, file: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """ids of all texts, each with end_id after it, and where those of each text begin (one more at the end). Null texts are empty."""
    codes, at = pieces.code_points(texts)
    cuts = pieces.with_cuts(codes, at)
    ids, begin = encoder(file)(codes, cuts)
    begin = begin[np.searchsorted(cuts, at, "right") - 1]
    return np.insert(ids, begin[1:], end_id).astype("<u4"), begin + np.arange(len(begin))


def write_ids(docs: DataFrame, file: str, path: str, end_id: int = END_ID, planes: str = "byte", partitions: int | None = None) -> None:
    """Encode every text with the tokenizer in file, append end_id, and write segments to path in ascending doc_id order.

    Null texts are empty ones; null ids come first; repeated rows are stored as often as they occur.
    """
    tune(docs.sparkSession)
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, segment, before = TaskContext.get().partitionId(), 0, 0
        ids, held, size = [], [], 0

        def row() -> pa.RecordBatch:
            stream = np.concatenate(held)
            index, payload = pack(stream, planes)
            values = [part, segment, before, len(stream), ids, [*map(len, held)], planes, index, payload]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string(), pa.binary(), pa.binary()]
            return pa.record_batch([pa.array([v], t) for v, t in zip(values, types, strict=True)], [f.split(" ")[0] for f in SEGMENT.split(", ")])

        for batch in batches:
            for a, b in slices(batch.column("text"), SLICE_BYTES):
                piece = batch.slice(a, b - a)
                stream, begin = ids_of(piece.column("text"), file, end_id)
                for doc_id, first, last in zip(piece.column("doc_id").to_pylist(), begin[:-1].tolist(), begin[1:].tolist(), strict=True):
                    ids.append(doc_id)
                    held.append(stream[first:last])
                    size += last - first
                    if size >= SEGMENT_IDS:
                        yield row()
                        segment, before, ids, held, size = segment + 1, before + size, [], [], 0
        if held:
            yield row()

    by_id = F.col("doc_id").asc_nulls_first()
    ranged = texts_of(docs).repartitionByRange(n, by_id).sortWithinPartitions(by_id)
    ranged.mapInArrow(run, SEGMENT).write.option("compression", "none").parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the files; ids is packed little-endian unsigned 32-bit."""
    tune(spark)
    segments = spark.read.parquet(path)
    totals = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # A row for each partition of the writer.
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(totals.select("part", before.alias("before")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in batch.to_pylist():
                data, ends = unpack(s["index"], s["payload"], s["planes"]).tobytes(), np.cumsum(s["lengths"], dtype=np.int64)
                first = ends - np.array(s["lengths"], np.int64)
                bits = [data[4 * a : 4 * b] for a, b in zip(first.tolist(), ends.tolist(), strict=True)]
                yield pa.record_batch(
                    [pa.array(s["doc_ids"], pa.int64()), pa.array(first + s["start"]), pa.array(s["lengths"], pa.int64()), pa.array(bits, pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids"]
                )

    with_start = segments.join(starts, "part").select(
        (F.col("part_start") + F.col("before")).alias("start"), "doc_ids", "lengths", "planes", "index", "payload"
    )
    return with_start.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def fresh_path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/token-ids-{uuid.uuid4().hex}"


def crc32_of(ids: bytes) -> int:
    return zlib.crc32(ids)
