"""Benchmark decontamination by a broadcast hash set of normalised test n-grams.

Texts are lower-cased (A-Z) and cut into words. Each benchmark item gives its windows of n consecutive words; an item of
fewer words, but not none, is one window. The hashes of all windows form sorted arrays that every executor gets; a
document's rolling hashes are tested against a bitmap of hash prefixes, then against the array, and each hit is verified
word by word. Hits mark word positions; documents or the marked spans can be removed.

At most about MAX_WINDOWS windows are with the driver, and broadcast, at a time. A benchmark of more windows is cut by hash into blocks, which take
turns: the hits of a block are written to the shared folder before the next block is fetched, and are brought together at the end.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.bytescan import ALPHANUMERIC, U, Words, batches, runs, scan
from quillon.llm.runtime import durable, texts_of, tune, unused

NGRAM = 10
#: Windows in a block: some 100 bytes each.
MAX_WINDOWS = 500_000
#: Documents with hits, of all blocks, up to which the table of hits is broadcast (some 300 bytes each).
BROADCAST_HITS = 100_000
BITMAP_BITS = 22


class Windows(NamedTuple):
    """Of one window length: hashes in order, and of window k the words (from words_at[k] on) and item ids (from items_at[k] on)."""

    n: int
    hashes: np.ndarray
    bitmap: np.ndarray
    words: bytes
    words_at: np.ndarray
    items: np.ndarray
    items_at: np.ndarray


def item_windows(items: DataFrame, n: int) -> DataFrame:
    """(n, hash, words, item_ids): the distinct windows of items (doc_id, text); words are joined by single spaces, null ids are not listed."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            w = scan(batch.column("text"), ALPHANUMERIC)
            rows = []
            for i, item in enumerate(batch.column("doc_id").to_pylist()):
                first, last = int(w.at[i]), int(w.at[i + 1])
                size = min(n, last - first)
                if size:
                    hashes = runs(w.hash[first:last], size).view(np.int64).tolist()
                    rows += [(size, h, b" ".join(map(w.text, range(first + k, first + k + size))), item) for k, h in enumerate(hashes)]
            columns = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.record_batch(
                [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.binary(), pa.int64()), strict=True)],
                ["n", "hash", "words", "item"]
            )

    rows = items.mapInArrow(run, "n int, hash long, words binary, item long")
    return rows.groupBy("n", "hash", "words").agg(F.sort_array(F.collect_set("item")).alias("item_ids"))


def _index(rows: pa.Table) -> list[Windows]:
    out = []
    lengths, hashes = rows.column("n").to_numpy(), rows.column("hash").to_numpy().view(U)
    for n in np.unique(lengths).tolist():
        own = np.flatnonzero(lengths == n)
        own = own[np.argsort(hashes[own], kind="stable")]
        words, ids = (rows.column(c).combine_chunks().take(pa.array(own)) for c in ("words", "item_ids"))
        bitmap = np.zeros(1 << BITMAP_BITS, bool)
        bitmap[hashes[own] >> U(64 - BITMAP_BITS)] = True
        sizes = [
            np.concatenate([[0], np.cumsum(x.to_numpy(zero_copy_only=False))]).astype(np.int64) for x in (pc.binary_length(words), pc.list_value_length(ids))
        ]
        out.append(Windows(n, hashes[own], bitmap, b"".join(words.to_pylist()), sizes[0], ids.flatten().to_numpy(), sizes[1]))
    return out


def _hits(w: Words, index: list[Windows]) -> dict[int, tuple[list[tuple[int, int]], set[int]]]:
    """For each text with hits: the runs of words (from its first word) that are windows, and the items they come from. A text without words has none."""
    out: dict[int, tuple[list, set]] = {}
    for x in index:
        hashes = runs(w.hash, x.n)
        near = np.flatnonzero(x.bitmap[hashes >> U(64 - BITMAP_BITS)])
        place = np.searchsorted(x.hashes, hashes[near])
        place[place == len(x.hashes)] = 0
        found = x.hashes[place] == hashes[near]
        near, place = near[found], place[found]
        doc = np.searchsorted(w.at, near, "right") - 1
        whole = near + x.n <= w.at[doc + 1]
        for k, p, d in zip(near[whole].tolist(), place[whole].tolist(), doc[whole].tolist(), strict=True):
            words = b" ".join(map(w.text, range(k, k + x.n)))
            while p < len(x.hashes) and x.hashes[p] == hashes[k]:
                if x.words[x.words_at[p] : x.words_at[p + 1]] == words:
                    spans, found_items = out.setdefault(d, ([], set()))
                    first = k - int(w.at[d])
                    spans.append((first, first + x.n))
                    found_items.update(x.items[x.items_at[p] : x.items_at[p + 1]].tolist())
                p += 1
    return out


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


NAMES = ("_n_words", "_spans", "_item_ids")
_SPAN = pa.list_(pa.struct([(k, pa.int32()) for k in ("first", "last", "begin", "end")]))
_KINDS = (pa.int64(), _SPAN, pa.list_(pa.int64()))
_SQL_KINDS = ("long", "array<struct<first:int,last:int,begin:int,end:int>>", "array<long>")


def _mark_block(docs: DataFrame, index: Broadcast | None, keep: list[str], names: Sequence[str], hit_only: bool = False) -> DataFrame:
    """keep with the hits of one block; without one, with what the columns of those names have already (null: nothing)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for a, b in batches(batch.column("text")):
                part = batch.slice(a, b - a)
                w = scan(part.column("text"), ALPHANUMERIC)
                if index is None:
                    known = zip(*(part.column(c).to_pylist() for c in names[1:]), strict=True)
                    hits = {i: ([(s["first"], s["last"]) for s in spans], set(items)) for i, (spans, items) in enumerate(known) if spans}
                else:
                    hits = _hits(w, index.value)
                spans, items = ([[] for _ in range(b - a)] for _ in range(2))
                for i, (found, found_items) in hits.items():
                    first, begin = int(w.at[i]), int(w.begin[i])
                    spans[i] = [
                        {"first": x, "last": y, "begin": int(w.start[first + x]) - begin, "end": int(w.end[first + y - 1]) - begin} for x,
                        y in _merged(found)
                    ]
                    items[i] = sorted(found_items)
                made = [pa.array(v, t) for v, t in zip((np.diff(w.at), spans, items), _KINDS, strict=True)]
                out = pa.record_batch([*(part.column(k) for k in keep), *made], [*keep, *names])
                yield out.take(pa.array(sorted(hits), pa.int64())) if hit_only else out

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema]
    return docs.mapInArrow(run, ", ".join([*kinds, *(f"`{k}` {t}" for k, t in zip(names, _SQL_KINDS, strict=True))]))


def mark(
    docs: DataFrame, items: DataFrame, n: int = NGRAM, keep: list[str] | None = None, max_windows: int = MAX_WINDOWS,
    names: Sequence[str] = NAMES
) -> DataFrame:
    """The columns keep (all) of docs, which has a text column, with the three columns names: number of words, spans, item ids.

    Spans count words (last is one past) and UTF-8 bytes of the text; overlapping and adjoining hits are one span.
    items has item_id and text. Null texts have no words; an item whose id is null marks words but is not listed.
    Repeated rows are scanned one by one. Without items nothing is hit. A column of docs with one of the names is an error.
    """
    spark, keep = docs.sparkSession, docs.columns if keep is None else keep
    if clash := {*map(str.lower, keep)} & {*map(str.lower, names)}:
        raise ValueError(f"docs has a column {sorted(clash)} already: choose other names")
    tune(spark)
    windows = durable(item_windows(texts_of(items, id_col="item_id"), n))
    count = windows.count()
    if count <= max_windows:
        return _mark_block(docs, spark.sparkContext.broadcast(_index(windows.toArrow())), keep, names)
    # A text may be a column of keep or not.
    (row,) = unused(docs, "row")
    numbered = durable(docs.select(*dict.fromkeys([*keep, "text"])).withColumn(row, F.monotonically_increasing_id()))
    blocks, hits = -(-count // max_windows) * 2, []
    for k in range(blocks):
        index = spark.sparkContext.broadcast(_index(windows.filter(F.pmod(F.xxhash64("words"), F.lit(blocks)) == k).toArrow()))
        hits.append(durable(_mark_block(numbered.select(row, "text"), index, [row], names, hit_only=True).drop(names[0])))
        # The hits are durable, so no task will need the block again.
        index.destroy()
    gathered = reduce(DataFrame.unionByName, hits).groupBy(row).agg(*(F.flatten(F.collect_list(c)).alias(c) for c in names[1:]))
    hit_rows = gathered.count()
    gathered = F.broadcast(gathered) if hit_rows <= BROADCAST_HITS else gathered
    return _mark_block(numbered.join(gathered, row, "left"), None, keep, names)


def find_hits(docs: DataFrame, items: DataFrame, n: int = NGRAM, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """doc_id, n_words, spans, item_ids for each row of docs (doc_id, text); see mark(). Other columns are ignored."""
    return mark(texts_of(docs), items, n, ["doc_id"], max_windows, ("n_words", "spans", "item_ids"))


def without_documents(docs: DataFrame, items: DataFrame, n: int = NGRAM, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """docs without the rows in which a window of an item occurs; all columns, whatever their names, and all other rows stay."""
    names = unused(docs, *NAMES)
    return mark(docs, items, n, None, max_windows, names).filter(F.size(names[1]) == 0).drop(*names)


def without_spans(docs: DataFrame, items: DataFrame, n: int = NGRAM, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """docs with every hit span cut out of the text, from its first word's first byte to its last word's last byte; all rows and columns stay."""
    names = unused(docs, *NAMES)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = part.column("text").to_pylist()
            for i, spans in enumerate(part.column(names[1]).to_pylist()):
                if spans:
                    data, at, out = texts[i].encode(), 0, []
                    for s in spans:
                        out.append(data[at : s["begin"]])
                        at = s["end"]
                    texts[i] = b"".join([*out, data[at:]]).decode()
            k = part.schema.get_field_index("text")
            yield part.set_column(k, "text", pa.array(texts, part.schema.field("text").type)).drop_columns(names)

    return mark(docs, items, n, None, max_windows, names).mapInArrow(run, docs.schema)
