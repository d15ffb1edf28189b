"""Toxicity by a classifier chain.

Categories are predicted one after another by linear models, and each later model also gets the probabilities of the earlier
ones. The labels have two categories: junk (quality 0), told by the form of a text, and toxic, told by words and word
beginnings. In training, an earlier category's probability of a row comes from a model that was fitted without that row's
fold, so the later model learns from probabilities of the kind it will see.

Terms are picked within the training folds too: those whose ties to toxic texts are so unlikely that only so many of all terms
would pass by chance. Of a few such bounds the strictest is taken whose out-of-fold log loss is no worse than the least by
more than a standard error of the difference. Folds go by hashes of
texts, so that copies share one. Models are fitted on the driver on at most max_labelled rows; all else is done over all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.bytescan import ALPHANUMERIC, U, Words, batches, prefixes, scan
from quillon.llm.labels import sample
from quillon.llm.linear import fit, predict
from quillon.llm.quality import FEATURES, features
from quillon.llm.runtime import durable, texts_of, tune, unused

CATEGORIES = ("junk", "toxic")
MAX_LABELLED = 8000
MAX_TERMS = 256
FOLDS = 5
PREFIX_BYTES = 4


#: How many terms may pass by mere chance, at about most; the strictest first.
CHANCE = (0.01, 1.0, 30.0)
THRESHOLD = 0.5
_BITS = 20


class Model(NamedTuple):
    terms: np.ndarray  # sorted hashes
    center: np.ndarray  # of the features of form
    scale: np.ndarray
    weights: tuple[np.ndarray, np.ndarray]  # of each category


def _bitmap(terms: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << _BITS, bool)
    out[terms >> U(64 - _BITS)] = True
    return out


def _occurrences(w: Words, terms: np.ndarray, bitmap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, term) of each occurrence of a term."""
    owner = np.searchsorted(w.at, np.arange(len(w.hash)), "right") - 1
    texts, found_terms = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for hashes in (w.hash, prefixes(w, PREFIX_BYTES)) if len(terms) else ():
        near = np.flatnonzero(bitmap[hashes >> U(64 - _BITS)])
        place = np.minimum(np.searchsorted(terms, hashes[near]), len(terms) - 1)
        found = terms[place] == hashes[near]
        texts.append(owner[near[found]])
        found_terms.append(place[found])
    return np.concatenate(texts), np.concatenate(found_terms)


def _counts(texts: np.ndarray, terms: np.ndarray, n: int, k: int) -> np.ndarray:
    return np.bincount(texts * k + terms, minlength=n * k).reshape(n, k).astype(float) if k else np.zeros((n, 0))


def _tells(counts: np.ndarray, words: np.ndarray) -> np.ndarray:
    """A row for each text: log counts of terms, of all of them, of different ones, and terms for each 100 words."""
    hits = counts.sum(1)
    return np.hstack([np.log1p(counts), np.log1p(hits)[:, None], np.log1p((counts > 0).sum(1))[:, None], np.sqrt(100 * hits / np.maximum(words, 1))[:, None]])


def _picked(rows: DataFrame, sizes: dict[tuple[int, int], int], most: int) -> dict[tuple[int, int], np.ndarray]:
    """The terms that toxic texts have much more often than others, for each bound of CHANCE and each fold that is left out (-1: none)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for a, b in batches(batch.column("text")):
                part = batch.slice(a, b - a)
                w, y, fold = scan(part.column("text"), ALPHANUMERIC), part.column("y").to_pylist(), part.column("fold").to_pylist()
                starts = prefixes(w, PREFIX_BYTES)
                for i in range(b - a):
                    span = slice(w.at[i], w.at[i + 1])
                    own = np.unique(np.concatenate([w.hash[span], starts[span]]))
                    own = own[own != 0]
                    yield pa.record_batch(
                        [pa.array(own.view(np.int64)), pa.array(np.full(len(own), y[i], np.int32)), pa.array(np.full(len(own), fold[i], np.int32))],
                        ["term", "y", "fold"]
                    )

    left = [-1, *range(FOLDS)]
    used = lambda k: F.col("fold") != k
    sums = [c for k in left for c in (F.sum(F.when(used(k), F.col("y"))).alias(f"t{k + 1}"), F.count_if(used(k)).alias(f"n{k + 1}"))]
    counts = rows.mapInArrow(run, "term long, y int, fold int").groupBy("term").agg(*sums)
    counts = durable(counts.filter(F.col("n0") >= 2))
    tested, found = counts.count(), []
    for k in left:
        n1, n0 = (sum(n for (y, fold), n in sizes.items() if y == kind and fold != k) for kind in (1, 0))
        if not n1 or not n0:
            continue
        t, n, rate = F.col(f"t{k + 1}").cast("double"), F.col(f"n{k + 1}").cast("double"), n1 / (n1 + n0)
        times = lambda x, share: F.when(x > 0, x * F.log(x / share)).otherwise(0.0)
        # Minus the logarithm of how likely a term is that has no tie to toxicity (Chernoff's bound).
        unlikely = times(t, n * rate) + times(n - t, n * (1 - rate))
        tied = counts.filter(t > n * rate).select("term", unlikely.alias("z"))
        for number, chance in enumerate(CHANCE):
            best = tied.filter(F.col("z") >= float(np.log(tested / chance))).orderBy(F.desc("z"), "term").limit(most)
            found.append(best.select("term", F.lit(number).alias("bound"), F.lit(k).alias("left")))
    terms = reduce(DataFrame.unionByName, found).collect() if found else []
    return {(b, k): np.sort(np.array([r.term for r in terms if (r.bound, r.left) == (b, k)], np.int64).view(U)) for b in range(len(CHANCE)) for k in left}


def _out_of_fold(x: np.ndarray | dict[int, np.ndarray], y: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """Probabilities of each row from a model fitted without its fold; null labels teach nothing. x may differ from fold to fold."""
    out = np.zeros(len(y))
    for k in range(FOLDS):
        own = x[k] if isinstance(x, dict) else x
        taught = (fold != k) & ~np.isnan(y)
        if (fold == k).any():
            out[fold == k] = predict(own[fold == k], fit(own[taught], y[taught]))
    return out


def _strictest(losses: list[np.ndarray]) -> int:
    """The first of the settings that are no worse than the best one by more than a standard error of the difference; losses has one of each row."""
    best = min(range(len(losses)), key=lambda k: losses[k].sum())
    worse = [x - losses[best] for x in losses]
    return next(k for k, d in enumerate(worse) if k == best or d.sum() <= d.std() * len(d) ** 0.5)


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_terms: int = MAX_TERMS) -> Model:
    """A chain fitted on labelled rows: labels has doc_id, toxic and, if it likes, quality; docs has doc_id and text.

    Labels of one kind only tell nothing apart: then no text is more likely toxic than not.
    """
    tune(docs.sparkSession)
    folded = sample(docs, labels, "toxic", max_labelled, "quality").withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int"))
    rows = durable(folded)
    sizes = {(r.y, r.fold): r["count"] for r in rows.groupBy("y", "fold").count().collect()}
    terms = _picked(rows, sizes, max_terms)
    every = np.unique(np.concatenate([*terms.values()]))
    bitmap = _bitmap(every)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for a, b in batches(batch.column("text")):
                part = batch.slice(a, b - a)
                w, form = scan(part.column("text"), ALPHANUMERIC), features(part.column("text"))
                own, which = _occurrences(w, every, bitmap)
                seen = [np.bincount(which[own == i], minlength=0) for i in range(b - a)]
                lists = [[pa.array([f(s) for s in seen], pa.list_(pa.int32())) for f in (np.flatnonzero, lambda s: s[s > 0])]]
                yield pa.record_batch(
                    [
                        *(part.column(c) for c in ("doc_id", "y", "quality", "fold")), pa.array(np.diff(w.at)),
                        pa.array([*form], pa.list_(pa.float64())), *lists[0]
                    ],
                    names
                )

    names = ["doc_id", "y", "quality", "fold", "words", "form", "terms", "counts"]
    known = rows.mapInArrow(
        run, "doc_id long, y int, quality int, fold int, words long, form array<double>, terms array<int>, counts array<int>"
    ).toArrow().sort_by("doc_id")
    n = known.num_rows
    column = lambda c: known.column(c).to_numpy()
    fold, toxic, words, quality = column("fold"), column("y").astype(float), column("words"), column("quality").astype(float)
    form = np.array(known.column("form").to_pylist(), float).reshape(n, FEATURES)
    center, scale = (form.mean(0), form.std(0) + 1e-9) if n else (np.zeros(FEATURES), np.ones(FEATURES))
    form = (form - center) / scale
    junk = 1 - quality
    p_junk = _out_of_fold(form, junk, fold)[:, None]
    flat = [np.concatenate([np.zeros(0, np.int64), *known.column(c).to_numpy()]).astype(np.int64) for c in ("terms", "counts")]
    owner = np.repeat(np.repeat(np.arange(n), [*map(len, known.column("terms").to_pylist())]), flat[1]) if n else np.zeros(0, np.int64)
    each = np.repeat(flat[0], flat[1])

    def seen_by(own: np.ndarray) -> np.ndarray:
        """What the second model sees if these are the terms."""
        place = np.full(len(every), -1)
        place[np.searchsorted(every, own)] = np.arange(len(own))
        here = place[each] >= 0
        return np.hstack([_tells(_counts(owner[here], place[each][here], n, len(own)), words), p_junk])

    losses = []
    for number in range(len(CHANCE)):
        p = np.clip(_out_of_fold({k: seen_by(terms[number, k]) for k in range(FOLDS)}, toxic, fold), 1e-6, 1 - 1e-6)
        losses.append(-toxic * np.log(p) - (1 - toxic) * np.log(1 - p))
    own = terms[_strictest(losses), -1]
    taught = ~np.isnan(junk)
    last = fit(seen_by(own), toxic)
    if not 0 < toxic.sum() < n:
        last[-1] = min(last[-1], 0.0)
    return Model(own, center, scale, (fit(form[taught], junk[taught]), last))


def chain(column: pa.Array, model: Model, bitmap: np.ndarray) -> np.ndarray:
    """Probabilities of the categories, one column each; the second model sees that of the first. Null texts have no words."""
    w = scan(column, ALPHANUMERIC)
    p_junk = predict((features(column) - model.center) / model.scale, model.weights[0])[:, None]
    n = len(w.at) - 1
    tells = _tells(_counts(*_occurrences(w, model.terms, bitmap), n, len(model.terms)), np.diff(w.at))
    return np.hstack([p_junk, predict(np.hstack([tells, p_junk]), model.weights[1])[:, None]])


def score(docs: DataFrame, model: Model, keep: list[str], names: list[str]) -> DataFrame:
    """The columns keep of docs with the categories' probabilities under names. Null texts have no words."""
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model, _bitmap(model.terms)))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for a, b in batches(batch.column("text")):
                part = batch.slice(a, b - a)
                p = chain(part.column("text"), *shared.value)
                yield pa.record_batch([*(part.column(k) for k in keep), *(pa.array(p[:, k]) for k in range(len(names)))], [*keep, *names])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema]
    return docs.mapInArrow(run, ", ".join([*kinds, *(f"`{n}` double" for n in names)]))


def classify(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, p_junk, p_toxic, toxic, kept for each row of docs; other columns are ignored.

    Empty and null texts get what a text without any term gets; repeated rows are scored one by one. Without labels, or
    with labels of one kind only, no text is found toxic.
    """
    scored = score(texts_of(docs), train(docs, labels, max_labelled), ["doc_id"], [f"p_{c}" for c in CATEGORIES])
    return scored.withColumn("toxic", F.col("p_toxic") > THRESHOLD).withColumn("kept", ~F.col("toxic"))


def without_toxic(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """docs without the rows that the chain finds toxic; all columns, whatever their names, and all other rows stay."""
    names = unused(docs, *(f"p_{c}" for c in CATEGORIES))
    return score(docs, train(docs, labels, max_labelled), docs.columns, names).filter(F.col(names[-1]) <= THRESHOLD).drop(*names)
