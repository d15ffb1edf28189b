"""Quality by hierarchical empirical Bayes.

A linear classifier gives each document evidence of its own from features of its form. Sites add theirs: the documents
of a host, and of a path on it, have a rate of good ones, which is shrunk toward the rate of the level above (path to host, host
to all) the more, the fewer documents there are. How strongly is estimated from how much the groups differ beyond
chance. A document's own score is left out of its site's counts. All group figures come from grouped aggregation; the
classifier is fitted on about at most max_labelled labelled rows, which are picked by a hash of their ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.bytescan import NOT_SPACE, batches, byte_class, scan
from quillon.llm.labels import sample
from quillon.llm.linear import fit, predict
from quillon.llm.runtime import bytes_and_offsets, durable, tune

MAX_LABELLED = 8000
THRESHOLD = 0.5
#: Sites up to which their table is broadcast (some 100 bytes each).
BROADCAST_SITES = 100_000
STRENGTH = (1.0, 1e6)
_CLASSES = np.stack(
    [
        byte_class((65, 90)), byte_class((97, 122)), byte_class((48, 57)), byte_class((128, 255)), byte_class((32, 32)),
        byte_class((9, 13)), byte_class((33, 47), (58, 64), (91, 96), (123, 126))
    ]
)
FEATURES = len(_CLASSES) + 6


def features(column: pa.Array) -> np.ndarray:
    """A row for each text: shares of kinds of bytes, size, word lengths, how many words are new, and how many repeat the one before."""
    raw, offsets = bytes_and_offsets(column)
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    out = np.zeros((n, FEATURES))
    for k, kind in enumerate(_CLASSES):
        total = np.concatenate([[0], np.cumsum(kind[raw])])
        out[:, k] = (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(size, 1)
    w = scan(column, NOT_SPACE)
    words = np.diff(w.at).astype(float)
    same = np.zeros(len(w.hash) + 1)
    same[2:] = np.cumsum(w.hash[1:] == w.hash[:-1]) if len(w.hash) > 1 else same[2:]
    first, last = np.minimum(w.at[:-1] + 1, len(w.hash)), w.at[1:]
    repeated = np.where(last > first, same[last] - same[np.minimum(first, last)], 0)
    fresh = np.array([len(np.unique(w.hash[a:b])) for a, b in zip(w.at[:-1], w.at[1:], strict=True)], float)
    lengths = np.concatenate([[0], np.cumsum(w.end - w.start)])
    out[:, -6] = np.log1p(size)
    out[:, -5] = np.log1p(words)
    out[:, -4] = (lengths[w.at[1:]] - lengths[w.at[:-1]]) / np.maximum(words, 1)
    out[:, -3] = fresh / np.maximum(words, 1)
    out[:, -2] = repeated / np.maximum(words, 1)
    out[:, -1] = np.sqrt(out[:, len(_CLASSES) - 1])
    return out


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, weights) from labels (doc_id, quality) and docs (doc_id, text)."""
    tune(docs.sparkSession)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for a, b in batches(batch.column("text")):
                part = batch.slice(a, b - a)
                yield pa.record_batch(
                    [part.column("doc_id"), part.column("y"), pa.array([*features(part.column("text"))], pa.list_(pa.float64()))],
                    ["doc_id", "y", "x"]
                )

    known = sample(docs, labels, "quality", max_labelled).mapInArrow(run, "doc_id long, y int, x array<double>").orderBy("doc_id", "y").collect()
    x = np.array([r.x for r in known]) if known else np.zeros((0, FEATURES))
    mean, scale = (x.mean(0), x.std(0) + 1e-9) if known else (np.zeros(FEATURES), np.ones(FEATURES))
    return mean, scale, fit((x - mean) / scale, np.array([r.y for r in known], float))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, above: str) -> float:
    """How many documents the level above counts for: from the variance of the groups' rates beyond that of chance."""
    rate, prior = F.col("s") / F.col("n"), F.col(above)
    chance = F.sum(prior * (1 - prior))
    between = F.sum(F.col("n") * (rate - prior) * (rate - prior))
    total, excess, size = groups.agg(F.sum(F.col("n") * prior * (1 - prior)), between - chance, F.sum("n")).first()
    if not size or total <= 0 or excess <= 0:
        return STRENGTH[1]
    return float(np.clip(total / excess - 1, *STRENGTH))


def score(docs: DataFrame, labels: DataFrame, host: Column, path: Column, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, host, path, p_document, host_rate, path_rate, quality, kept for each row of docs.

    host and path are columns of docs; nulls count as an empty name. Null texts are empty ones. Without labels all documents
    get one rate. Repeated rows are counted as often as they occur. An empty table gives an empty result.
    """
    tune(docs.sparkSession)
    mean, scale, weights = train(docs, labels, max_labelled)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for a, b in batches(batch.column("text")):
                part = batch.slice(a, b - a)
                p = np.clip(predict((features(part.column("text")) - mean) / scale, weights), 1e-4, 1 - 1e-4)
                yield pa.record_batch([part.column("doc_id"), part.column("host"), part.column("path"), pa.array(p)], ["doc_id", "host", "path", "p_document"])

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path")
    )
    scored = durable(rows.mapInArrow(run, "doc_id long, host string, path string, p_document double"))
    total = lambda level: (F.sum("p_document") if level == "doc" else F.sum("s")).alias("s")
    paths = durable(scored.groupBy("host", "path").agg(total("doc"), F.count(F.lit(1)).alias("n")))
    hosts = paths.groupBy("host").agg(total("path"), F.sum("n").alias("n"))
    all_s, all_n = hosts.agg(F.sum("s"), F.sum("n")).first()
    overall = float(all_s / all_n) if all_n else 0.5
    k_host = _strength(hosts.withColumn("above", F.lit(overall)), "above")
    hosts = hosts.withColumn("host_rate", (F.col("s") + k_host * overall) / (F.col("n") + k_host))
    sites = durable(paths.join(hosts.select("host", "host_rate", F.col("s").alias("host_s"), F.col("n").alias("host_n")), "host"))
    k_path = _strength(sites, "host_rate")
    if sites.count() <= BROADCAST_SITES:
        sites = F.broadcast(sites)
    own = scored.join(sites, ["host", "path"])
    host_rate = (F.col("host_s") - F.col("p_document") + k_host * overall) / (F.col("host_n") - 1 + k_host)
    own = own.withColumn("host_rate", host_rate).withColumn(
        "path_rate", (F.col("s") - F.col("p_document") + k_path * F.col("host_rate")) / (F.col("n") - 1 + k_path)
    )
    inside = lambda c: F.least(F.greatest(c, F.lit(1e-4)), F.lit(1 - 1e-4))
    odds = _logit(F.col("p_document")) + _logit(inside(F.col("path_rate"))) - _logit(inside(F.lit(overall)))
    own = own.withColumn("quality", 1 / (1 + F.exp(-odds)))
    return own.select("doc_id", "host", "path", "p_document", "host_rate", "path_rate", "quality", (F.col("quality") >= THRESHOLD).alias("kept"))
