"""Which sets share enough of their shingles with other documents, all taken together, to link with any.

Shingles are dealt out by ranges of their hashes, several ranges to a task, in the compact form of 4 bytes and a step of the
document. A chunk of documents makes a row for each range that it has shingles in: never more rows than shingles, and about
chunks times ranges of them as long as these are fewer.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from quillon.llm.bytescan import U, batches
from quillon.llm.shingles import Rule, sets_of

#: Documents and shingles that are counted together, shingles that one task compares at a time, and that it gets in all.
CHUNK_DOCS, CHUNK_SHINGLES, RANGE_SHINGLES, TASK_SHINGLES = 2048, 4_000_000, 1_000_000, 16_000_000
#: Several ranges for each task, so that tasks get about equal shares.
RANGES_PER_TASK = 8


def _binary(data: np.ndarray, at: np.ndarray) -> pa.Array:
    """Pieces of an array that begin at these places, as binary values."""
    ends = (np.append(at, len(data)) * data.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def _dealt(chunk: int, ranges: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """Rows of a chunk; columns are pairs of an array and where each row's part of it begins."""
    values = [_binary(data, at) for data, at in batched(columns, 2)]
    return pa.record_batch([pa.array(np.full(len(ranges), chunk, np.int64)), pa.array(ranges, pa.int32()), *values], ["chunk", "r", "steps", "tokens", "keys"])


def _steps(owner: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How much each number is above the one before it in its row, in bytes: 255 stands for 255 more to come. And where each number's bytes begin."""
    step = np.diff(owner, prepend=0)
    step[rows] = owner[rows]
    length = step // 255 + 1
    ends = np.cumsum(length)
    out = np.full(int(ends[-1]) if len(ends) else 0, 255, np.uint8)
    out[ends - 1] = step % 255
    return out, ends - length


def _owners(steps: bytes) -> np.ndarray:
    data = np.frombuffer(steps, np.uint8)
    return np.cumsum(data, dtype=np.int64)[data != 255]


def _chunks(docs: DataFrame, words: int, ranges: int) -> DataFrame:
    """The shingles of some documents at a time, dealt by hash ranges: the low 32 bits of each, and how far on its document is (see _steps).

    A row with the sets' names and sizes comes with each chunk, under a negative range.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def done() -> Iterator[pa.RecordBatch]:
            chunk = task << 32 | number
            keys = np.concatenate([np.stack([s.high, s.low, np.diff(s.at).astype(U)], 1) for s in held])
            tokens, n = np.concatenate([s.shingles for s in held]), keys[:, 2].astype(np.int64)
            which = ((tokens >> U(32)) % U(ranges)).astype(np.int64)
            order = np.argsort(which, kind="stable")
            which, owner = which[order], np.repeat(np.arange(len(n)), n)[order]
            # Only ranges that have shingles make rows, so there are never more rows than shingles.
            rows = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]])[: len(which)])
            steps, ends = _steps(owner, rows)
            low = (tokens[order] & U(0xFFFFFFFF)).astype(np.uint32)
            yield _dealt(chunk, which[rows], steps, ends[rows] if len(rows) else rows, low, rows, np.zeros(0, U), np.zeros(len(rows), np.int64))
            zero = np.zeros(1, np.int64)
            yield _dealt(chunk, np.array([-1 - chunk % ranges]), np.zeros(0, np.uint8), zero, np.zeros(0, np.uint32), zero, keys.reshape(-1), zero)

        docs_held = 0
        for batch in parts:
            for a, b in batches(batch.column("text")):
                s = sets_of(batch.column("text").slice(a, b - a), words)
                if held and (docs_held + b - a > CHUNK_DOCS or size + len(s.shingles) > CHUNK_SHINGLES):
                    yield from done()
                    number, held, size, docs_held = number + 1, [], 0, 0
                held.append(s)
                size, docs_held = size + len(s.shingles), docs_held + b - a
        if held:
            yield from done()

    return docs.mapInArrow(run, "chunk long, r int, steps binary, tokens binary, keys binary")


def promising(docs: DataFrame, rule: Rule, total: int) -> DataFrame:
    """high, low of the sets that share so many shingles with other documents, all taken together, that a link is possible at all.

    A set that links with any other shares num / den of its own shingles with it. Shingles are compared by parts of their
    hashes, which can only make sets seem to share more. total: shingles of all documents.
    """
    partitions = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_SHINGLES))
    ranges = max(RANGES_PER_TASK * partitions, -(-total // RANGE_SHINGLES))

    def shared(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def done() -> pa.RecordBatch:
            tokens = [np.frombuffer(h["tokens"], np.uint32) for h in held]
            ordered = np.sort(np.concatenate(tokens))
            twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
            docs, counts = [], []
            for h, t in zip(held, tokens, strict=True):
                found = twice[np.minimum(np.searchsorted(twice, t), len(twice) - 1)] == t if len(twice) else np.zeros(len(t), bool)
                own, n = np.unique(_owners(h["steps"])[found], return_counts=True)
                docs.append(own.astype(np.uint16).tobytes())
                counts.append(n.astype(np.uint32).tobytes())
            return back([h["chunk"] for h in held], [h["r"] for h in held], docs, counts, [b""] * len(held))

        for batch in parts:
            for h in batch.to_pylist():
                if held and h["r"] != now:
                    yield done()
                    held = []
                now = h["r"]
                if now >= 0:
                    held.append(h)
                else:
                    yield back([h["chunk"]], [now], [b""], [b""], [h["keys"]])
        if held:
            yield done()

    def back(*columns: list) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 3]
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["chunk", "r", "docs", "counts", "keys"])

    def judged(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, total_shared = None, None

        def done() -> pa.RecordBatch:
            good = (keys[:, 2] > 0) & (total_shared * U(rule.den) >= keys[:, 2] * U(rule.num))
            return pa.record_batch([pa.array(keys[good, k].view(np.int64)) for k in (0, 1)], ["high", "low"])

        for batch in parts:
            for h in batch.to_pylist():
                if h["r"] < 0:
                    if keys is not None:
                        yield done()
                    keys = np.frombuffer(h["keys"], U).reshape(-1, 3)
                    total_shared = np.zeros(len(keys), U)
                else:
                    total_shared[np.frombuffer(h["docs"], np.uint16)] += np.frombuffer(h["counts"], np.uint32)
        if keys is not None:
            yield done()

    dealt = _chunks(docs, rule.words, ranges).repartition(partitions, "r").sortWithinPartitions("r")
    found = dealt.mapInArrow(shared, "chunk long, r int, docs binary, counts binary, keys binary")
    return found.repartition(partitions, "chunk").sortWithinPartitions("chunk", "r").mapInArrow(judged, "high long, low long").distinct()
