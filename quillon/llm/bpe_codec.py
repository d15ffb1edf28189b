"""Byte-level BPE encoding by tree concatenation, and decoding.

A text longer than a leaf is halved until its parts are leaves. Leaves are encoded independently of each other, those
of a batch together and in parallel, wherever the cut falls: inside a word, a run of white space or a special string.
Neighbours are then joined up the tree. Around each join, the last k tokens of the left side and the first k of the
right side are decoded and encoded again as one text, and k doubles until the new tokens begin and end with the very
tokens that the two sides have there. From such a token on, both encodings run on alike, so the joined sequence
is the encoding of the whole text.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from itertools import chain, pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillon.llm import pieces, tokenizer_files
from quillon.llm.runtime import slices, texts_of, tune

LEAF_CHARS = 8192
WINDOW_TOKENS = 8
#: Tokens at either end of a window that must be those that the side has, and bytes between them and the join. The
#: bytes exceed the longest special string, contraction and character, so none of those reaches across them.
AGREE_TOKENS, MARGIN_BYTES = 2, 16
SLICE_BYTES = 1 << 20


class Lines(NamedTuple):
    """One string of bytes for each id."""

    data: np.ndarray
    begin: np.ndarray
    count: np.ndarray

    @classmethod
    def of(cls, strings: list[bytes]) -> Lines:
        count = np.array([*map(len, strings)], np.int64)
        return cls(np.frombuffer(b"".join(strings), np.uint8), np.cumsum(count) - count, count)

    def each(self, ids: np.ndarray, ends: np.ndarray) -> list[memoryview]:
        """The strings of ids up to each end, joined."""
        count = self.count[ids]
        data = memoryview(np.ascontiguousarray(pieces.gathered(self.data, self.begin[ids], count)))
        at = np.concatenate([[0], np.cumsum(count)])[ends].tolist()
        return [data[a:b] for a, b in pairwise([0, *at])]


class Codec:
    def __init__(self, file: str, leaf_chars: int = LEAF_CHARS) -> None:
        self.tokenizer, self.leaf = tokenizer_files.load(file), leaf_chars
        chars = tokenizer_files.byte_of_char()
        by_id = {i: t for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        special = set(tokenizer_files.special_strings(file))
        if MARGIN_BYTES <= max((len(s.encode()) for s in special), default=0):
            raise ValueError("a special string is longer than the margin around joins")
        self.bytes = [by_id[i].encode() if by_id.get(i, "") in special else bytes(map(chars.__getitem__, by_id.get(i, ""))) for i in range(max(by_id) + 1)]
        self.strings, self.decimals = Lines.of(self.bytes), Lines.of([b"%d," % i for i in range(len(self.bytes))])
        self.encode_leaves = pieces.Encoder(file, pieces.byte_level)

    def cuts(self, a: int, b: int) -> list[int]:
        """Where the leaves of a text from a to b begin."""
        if b - a <= self.leaf:
            return [a]
        half = a + (b - a) // 2
        return self.cuts(a, half) + self.cuts(half, b)

    def text_bytes(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        k = WINDOW_TOKENS
        begins_inside = lambda token: self.bytes[token][:1] >= b"\x80" and self.bytes[token][0] < 0xC0  # noqa: E731  inside a character
        while True:
            a, b = max(0, len(left) - k), min(len(right), k)
            while a and begins_inside(left[a]):
                a -= 1
            while b < len(right) and (begins_inside(right[b]) or (b and self.bytes[right[b - 1]][-1:].isspace())):
                b += 1
            own, other = left[a : a + AGREE_TOKENS], right[max(0, b - AGREE_TOKENS) : b]
            window = self.tokenizer.encode((self.text_bytes(left[a:]) + self.text_bytes(right[:b])).decode(), add_special_tokens=False)
            ids = np.array(window.ids, np.uint32)
            fits_left = a == 0 or (
                len(left) - a > AGREE_TOKENS and len(self.text_bytes(left[a + AGREE_TOKENS :])) >= MARGIN_BYTES and np.array_equal(ids[:AGREE_TOKENS], own)
            )
            fits_right = b == len(right) or (
                b > AGREE_TOKENS and len(self.text_bytes(right[: b - AGREE_TOKENS])) >= MARGIN_BYTES and np.array_equal(ids[-AGREE_TOKENS:], other)
            )
            if fits_left and fits_right:
                return np.concatenate([left[:a], ids, right[b:]])
            k *= 2

    def concatenate(self, parts: list[np.ndarray]) -> np.ndarray:
        while len(parts) > 1:
            joined = [self.join(parts[i], parts[i + 1]) for i in range(0, len(parts) - 1, 2)]
            parts = joined + parts[len(parts) - len(parts) % 2 :]
        return parts[0]

    def encode(self, texts: pa.Array | list[str | None]) -> list[np.ndarray]:
        """ids of each text; null texts are empty."""
        codes, at = pieces.code_points(pa.array(texts, pa.string()) if isinstance(texts, list) else texts)
        leaves = [self.cuts(a, b) for a, b in pairwise(at.tolist())]
        ids, begin = self.encode_leaves(codes, np.array([*chain.from_iterable(leaves), len(codes)]))
        sides, out, k = np.split(ids, begin[1:-1]), [], 0
        for own in leaves:
            out.append(self.concatenate(sides[k : k + len(own)]))
            k += len(own)
        return out

    def decode(self, ids: np.ndarray) -> str:
        return self.text_bytes(ids).decode("utf-8", "replace")

    def decode_all(self, lists: list[np.ndarray]) -> list[str]:
        ids, ends = np.concatenate([np.zeros(0, np.uint32), *lists]), np.cumsum([*map(len, lists)])
        return [str(data, "utf-8", "replace") for data in self.strings.each(ids, ends)]

    def decimal_lists(self, lists: list[np.ndarray]) -> list[memoryview]:
        """The ids of each list, joined by commas."""
        ids, ends = np.concatenate([np.zeros(0, np.uint32), *lists]), np.cumsum([*map(len, lists)])
        return [data[:-1] if len(data) else data for data in self.decimals.each(ids, ends)]


@functools.cache
def codec(file: str, leaf_chars: int = LEAF_CHARS) -> Codec:
    return Codec(file, leaf_chars)


def encode_documents(docs: DataFrame, file: str, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """docs with ids array<int>: the tokens of each text. Null texts count as empty and have no tokens.

    All columns and rows stay, repeated rows and null ids too; a column named ids is replaced.
    """
    tune(docs.sparkSession)
    keep = [c for c in docs.columns if c != "ids"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema), "ids array<int>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = codec(file, leaf_chars)
        for batch in batches:
            for a, b in slices(batch.column("text"), SLICE_BYTES):
                part = batch.slice(a, b - a)
                ids = encoder.encode(part.column("text"))
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(np.concatenate(ids).astype(np.int32)))
                yield pa.record_batch([*part.columns, lists], [*keep, "ids"])

    return docs.select(*keep).mapInArrow(run, schema)


def digests(docs: DataFrame, file: str, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of decimal ids joined by commas) and decoded_sha256 for each row of docs.

    Null and empty texts have 0 tokens and the digests of the empty string.
    """
    tune(docs.sparkSession)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = codec(file, leaf_chars)
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for batch in batches:
            for a, b in slices(batch.column("text"), SLICE_BYTES):
                part = batch.slice(a, b - a)
                ids = encoder.encode(part.column("text"))
                ids_sha = [*map(sha, encoder.decimal_lists(ids))]
                text_sha = [sha(text.encode()) for text in encoder.decode_all(ids)]
                n = [*map(len, ids)]
                yield pa.record_batch([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names)

    return texts_of(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
