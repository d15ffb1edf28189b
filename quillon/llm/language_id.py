"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram's vector binds its letters' vectors, each permuted (rotated) by
its place, by multiplying them; a text's vector bundles those of its n-grams by adding them up. A language's
prototype bundles the unit vectors of texts in it, and a text gets the language whose prototype has the largest cosine.
Prototypes are learned from about at most max_texts texts of each language, picked by a hash of their ids and texts; there may be MAX_LANGS
languages, so the prototypes stay small.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.bytescan import batches
from quillon.llm.runtime import durable, tune

DIMENSIONS = 1024
MAX_TEXTS = 4000
#: 4 KB each for the prototypes that every executor gets.
MAX_LANGS = 4000
SEED = 20240917
GRAM = 3
#: n-grams whose vectors are in memory at once.
COLUMNS = 8192
TRAIN_PARTITIONS = 32


@functools.cache
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


@functools.lru_cache(20_000)
def letter_vector(code: int) -> np.ndarray:
    """Random signs that depend on the character only; 0 stands for whatever parts words."""
    return (np.random.default_rng([SEED, code]).integers(0, 2, DIMENSIONS, np.int8) * 2 - 1).astype(np.int8)


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, characters) of all n-grams of lower-case letters and word ends; rows of characters are code points."""
    low = [t.lower() for t in texts]
    # Each text has a mark of its own before it and after it, so any letter is in an n-gram.
    codes = np.frombuffer("".join(f"\n{t}\n" for t in low).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(t) + 2 for t in low], np.int64)
    owner = np.repeat(np.arange(len(low)), lengths)
    opening = np.zeros(len(codes), bool)
    opening[(np.cumsum(lengths) - lengths)] = True
    letter = _is_letter()[codes]
    keep = letter | opening
    keep[1:] |= letter[:-1]
    codes, owner = np.where(letter, codes, 0)[keep].astype(np.int64), owner[keep]
    if len(codes) < GRAM:
        return np.zeros(0, np.int64), np.zeros((0, GRAM), np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(codes, GRAM)
    good = owner[: len(windows)] == owner[GRAM - 1 :]
    good &= ~((windows[:, :-1] == 0) & (windows[:, 1:] == 0)).any(1)
    return owner[: len(windows)][good], windows[good]


def vectors(texts: list[str]) -> np.ndarray:
    """The bundle of each text's n-gram vectors, as a row; zeros without letters."""
    owner, windows = _grams(texts)
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    if not len(owner):
        return out
    present = np.zeros(0x110000, bool)
    present[windows] = True
    alphabet = np.flatnonzero(present)
    place = np.cumsum(present) - 1
    key = np.zeros(len(windows), np.int64)
    for k in range(GRAM):
        key = key * len(alphabet) + place[windows[:, k]]
    if len(alphabet) ** GRAM <= 1 << 22:
        seen = np.zeros(len(alphabet) ** GRAM, bool)
        seen[key] = True
        distinct, column = np.flatnonzero(seen), (np.cumsum(seen) - 1)[key]
    else:
        distinct, column = np.unique(key, return_inverse=True)
    letters = np.stack([letter_vector(int(c)) for c in alphabet])
    turned = [np.roll(letters, GRAM - 1 - k, axis=1) for k in range(GRAM)]
    for first in range(0, len(distinct), COLUMNS):
        grams, bound = distinct[first : first + COLUMNS], None
        for k in range(GRAM):
            own = turned[k][grams // len(alphabet) ** (GRAM - 1 - k) % len(alphabet)]
            bound = own if bound is None else bound * own
        here = slice(None) if len(distinct) <= COLUMNS else (column >= first) & (column < first + COLUMNS)
        counts = np.bincount(owner[here] * len(grams) + column[here] - first, minlength=len(texts) * len(grams))
        out += counts.reshape(len(texts), len(grams)).astype(np.float32) @ bound.astype(np.float32)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text, modulo 5, is 0. Null ids are kept from it too."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, max_texts: int = MAX_TEXTS) -> dict[str, np.ndarray]:
    """A unit prototype for each lang of docs (doc_id, text, lang); nulls in any of them, and texts without letters, teach nothing.

    Repeated texts of a language teach once. Other columns are ignored; an empty table gives no prototype.
    """
    tune(docs.sparkSession)
    usable = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    shares = usable.groupBy("lang").agg((F.lit(max_texts) / F.count(F.lit(1))).alias("share"))
    shares = durable(shares)
    if (n := shares.count()) > MAX_LANGS:
        raise ValueError(f"{n} languages are more than {MAX_LANGS}")
    # Rows that share an id are told apart by their texts, and of repeated rows one teaches.
    drawn = F.pmod(F.xxhash64("doc_id", "text", F.lit(SEED)), F.lit(1_000_000)) < F.col("share") * 1_000_000
    picked = usable.join(F.broadcast(shares), "lang").filter(drawn).select("lang", "text").distinct()
    picked = durable(picked.repartition(TRAIN_PARTITIONS))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in parts:
            for a, b in batches(batch.column("text")):
                part = batch.slice(a, b - a)
                rows, langs = _unit(vectors(part.column("text").to_pylist())), np.array(part.column("lang").to_pylist(), object)
                for lang in set(langs):
                    total[lang] = total.get(lang, 0) + rows[langs == lang].sum(0, dtype=np.float64)
        yield pa.record_batch([pa.array([*total], pa.string()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["lang", "v"])

    def added(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One sum for each language; rows come sorted, so it is the same on every run."""
        total: dict[str, np.ndarray] = {}
        for batch in parts:
            for lang, v in zip(batch.column("lang").to_pylist(), batch.column("v").to_pylist(), strict=True):
                total[lang] = total.get(lang, 0) + np.frombuffer(v)
        yield pa.record_batch([pa.array([*total], pa.string()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["lang", "v"])

    partial = picked.mapInArrow(run, "lang string, v binary").repartition("lang").sortWithinPartitions("lang", "v")
    sums = {r.lang: np.frombuffer(r.v) for r in partial.mapInArrow(added, "lang string, v binary").collect()}
    return {k: _unit(v) for k, v in sorted(sums.items()) if np.abs(v).sum()}


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs (doc_id, text).

    score is the cosine with the chosen prototype, not under 0. Texts that are null or have no letter, or any text if there
    are no prototypes, get und and 0. Repeated rows are told one by one.
    """
    tune(docs.sparkSession)
    names = sorted(prototypes)
    shared = docs.sparkSession.sparkContext.broadcast(np.stack([prototypes[n] for n in names]).astype(np.float32) if names else None)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for a, b in batches(batch.column("text")):
                part = batch.slice(a, b - a)
                v, lang, score = vectors([t or "" for t in part.column("text").to_pylist()]), ["und"] * (b - a), np.zeros(b - a)
                if names:
                    cosine = _unit(v) @ shared.value.T
                    best, some = cosine.argmax(1), np.abs(v).sum(1) > 0
                    lang = [names[k] if s else "und" for k, s in zip(best.tolist(), some.tolist(), strict=True)]
                    score = np.where(some, np.clip(cosine.max(1), 0, 1), 0).astype(float)
                yield pa.record_batch([part.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    told = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
    return told.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
