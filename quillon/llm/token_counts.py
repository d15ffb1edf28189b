"""Token counts by heap-and-linked-list byte-pair merging.

A pre-token's symbols form a doubly linked list. A heap holds the adjacent pairs that have a merge; the pair of
lowest rank, leftmost among equals, is popped and merged again and again. The count is the number of initial
symbols minus the number of merges; no identifiers leave the operator.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import pieces, tokenizer_files
from quillon.llm.runtime import slices, texts_of, tune

LIMIT = 2048
SLICE_BYTES = 1 << 20
#: White space of the tokenizer's patterns, which is narrower than Python's.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def merges_of(symbols: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> int:
    """How many merges symbols undergo; ranks gives (rank, merged symbol) for a pair."""
    n = len(symbols)
    after, before = [*range(1, n), -1], [*range(-1, n - 1)]
    heap = [(*r, i) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1])))]
    heap = [(rank, i, merged) for rank, merged, i in heap]
    heapify(heap)
    done = 0
    while heap:
        rank, i, merged = heappop(heap)
        j = after[i]
        # An entry is stale when either side has been merged since.
        if symbols[i] < 0 or j < 0 or (r := ranks.get((symbols[i], symbols[j]))) is None or r[0] != rank:
            continue
        symbols[i], symbols[j] = merged, -1
        after[i] = k = after[j]
        done += 1
        if k >= 0:
            before[k] = i
            if r := ranks.get((merged, symbols[k])):
                heappush(heap, (r[0], i, r[1]))
        if (h := before[i]) >= 0 and (r := ranks.get((symbols[h], merged))):
            heappush(heap, (r[0], h, r[1]))
    return done


@functools.cache
def word_counter(file: str) -> tuple[Callable[[str], int], Callable[[str], int]]:
    """Two functions that count tokens as the tokenizer in file gives them: of a normalised pre-token, and of any string.

    For vocabularies that normalise (NFC, white space, lower case), split words, digits and signs, and mark word ends.
    """
    spec = tokenizer_files.definition(file)
    model = spec["model"]
    vocab, suffix = model["vocab"], model["end_of_word_suffix"]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    ranks = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
    inner = {b: vocab[c] for c, b in tokenizer_files.byte_of_char().items()}
    final = {b: vocab[c + suffix] for c, b in tokenizer_files.byte_of_char().items()}
    special = regex.compile("|".join(regex.escape(t["content"]) for t in sorted(spec["added_tokens"], key=lambda t: -len(t["content"]))))
    words = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")

    def one(word: str) -> int:
        data = word.encode()
        return len(data) - merges_of([*map(inner.__getitem__, data[:-1]), final[data[-1]]], ranks)

    def plain(text: str) -> int:
        if text.isascii():
            text = text.lower()
        else:  # character by character: no rule for the end of a word
            text = "".join(map(str.lower, unicodedata.normalize("NFC", text)))
        return sum(map(one, words.findall(text)))

    def count(text: str) -> int:
        if "<|" not in text:
            return plain(text)
        parts = special.split(text)
        return len(parts) - 1 + sum(map(plain, filter(None, parts)))

    return one, count


@functools.cache
def _memory(file: str) -> pieces.Memo:
    one, count = word_counter(file)

    def counts(p: pieces.Pieces, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        strange = p.strange[which].tolist()
        found = [count(s) if odd else one(s) for s, odd in zip(pieces.texts(p, which), strange, strict=True)]
        return np.array(found, np.int64), np.ones(len(which), np.int64)

    return pieces.Memo(counts, np.int64)


def count_batch(texts: pa.Array, file: str) -> np.ndarray:
    """Tokens of each text, null ones being empty. A pre-token that is known is not merged again."""
    codes, at = pieces.code_points(texts)
    cuts = pieces.with_cuts(codes, at)
    total = np.zeros(len(cuts), np.int64)
    for a, b in pieces.portions(cuts):
        p = pieces.words(codes[cuts[a] : cuts[b]], cuts[a : b + 1] - cuts[a], file)
        total[a + 1 : b + 1] = np.concatenate([[0], np.cumsum(_memory(file)(p)[0])])[p.at[1:]] + total[a]
    return np.diff(total[np.searchsorted(cuts, at, "right") - 1])


def token_counts(docs: DataFrame, file: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs; null and empty texts have 0 tokens.

    Rows are independent: repeated rows and null ids are counted like any others, other columns are ignored.
    """
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in slices(batch.column("text"), SLICE_BYTES):
                part = batch.slice(begin, end - begin)
                counts = pa.array(count_batch(part.column("text"), file), pa.int64())
                yield pa.record_batch([part.column("doc_id"), part.column("n_bytes"), counts], ["doc_id", "n_bytes", "n_tokens"])

    rows = texts_of(docs).withColumn("n_bytes", F.octet_length("text").cast("long"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
