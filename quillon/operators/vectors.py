"""Vector stores and cosine top-k retrieval, merging and ranking.

A store is a table with doc_id or key columns and vector (array of float or double). Vectors are compared as unit vectors
in blocks: few queries are broadcast, each batch of the store is scored by one matrix product and keeps its
own best k for each query, and only those few rows are shuffled for the final ranking. Many queries are dealt out in blocks that meet
blocks of the store, each pair of blocks in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.durable import durable
from quillon.functions import text as T

#: Numbers in query vectors that are broadcast (64 MB), and in either side of a block that a task gets (16 MB).
QUERY_NUMBERS, BLOCK_NUMBERS = 8_000_000, 2_000_000
#: Groups up to which the table of their blocks is broadcast (some 50 bytes each).
BROADCAST_GROUPS = 200_000
#: Scores that a task holds at a time: 16 MB.
SCORES = 2_000_000
#: Candidates that a decision sees, and how much of each.
SHOWN, SHOWN_CHARS = 8, 300


def embed_with(function: Callable[[list[str]], list[list[float]]]) -> Callable[[Column], Column]:
    """An embedder as a column function; function maps texts to vectors."""

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series(function(texts.fillna("").tolist()))

    return lambda text: embed(text)


def digest_embedder() -> Callable[[Column], Column]:
    """Unit vectors from the bytes of a text's MD5, in the JVM: reproducible stand-ins without any meaning."""

    # A value that lambdas use more than once is bound by one of its own, so that it is worked out once.
    once = lambda value, then: F.get(F.transform(F.array(value), then), F.lit(0))
    raw = lambda digest: F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.conv(F.substring(digest, i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 127.5 - 1)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    unit = lambda v: once(norm(v), lambda n: F.transform(v, lambda x: F.try_divide(x, n)))

    def embed(text: Column) -> Column:
        return once(F.md5(text.cast("binary")), lambda digest: once(raw(digest), unit))

    return embed


def build_store(sections: DataFrame, embed: Callable[[Column], Column], text: str = "text", source: str | None = None) -> DataFrame:
    """Rows with text that is not only white space, stripped, with vector (and source)."""
    rows = sections.withColumn(text, T.strip(text)).filter(F.col(text) != "")
    rows = rows if source is None else rows.withColumn("source", F.lit(source))
    return rows.withColumn("vector", embed(F.col(text)))


def build_chunk_store(chunks: DataFrame, embed: Callable[[Column], Column]) -> DataFrame:
    """Chunks as documents: page_content is heading and content, with its length."""
    rows = chunks.withColumn("page_content", T.full_text("heading", "content")).withColumn("content_length", F.length("content"))
    return rows.withColumn("vector", embed(F.col("page_content")))


def build_heading_store(sections: DataFrame, embed: Callable[[Column], Column]) -> DataFrame:
    """Sections found by their headings alone; the text stays beside them."""
    rows = sections.withColumn("heading", T.topic("key", "text"))
    return rows.withColumn("vector", embed(F.col("heading")))


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = [np.asarray(v, float) if v is not None else None for v in column.to_pylist()] if column.null_count else None
    if rows is None and len(column):
        lengths = np.diff(column.offsets.to_numpy())
        if (lengths == lengths[0]).all():
            x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)
            return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        rows = [np.asarray(v, float) for v in column.to_pylist()]
    width = max((len(r) for r in rows or [] if r is not None), default=0)
    x = np.stack([r if r is not None and len(r) == width else np.full(width, np.nan) for r in rows]) if rows else np.zeros((0, 0))
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _largest(score: np.ndarray, n: int) -> np.ndarray:
    """The places of the n largest numbers of each row, the first on ties."""
    if n > 2:
        return np.argsort(-score, axis=1, kind="stable")[:, :n]
    first = score.argmax(1)[:, None]
    if n == 1 or score.shape[1] == 1:
        return first
    rest = score.copy()
    np.put_along_axis(rest, first, -np.inf, 1)
    second = rest.argmax(1)[:, None]
    return np.hstack([first, np.where(second == first, (first + 1) % score.shape[1], second)])


def _scores(matrix: np.ndarray, own: np.ndarray, digits: int) -> np.ndarray:
    score = np.round(matrix @ own, digits)
    score[np.isnan(score)] = -np.inf
    return score + 0.0


def _best(
    ids: pa.Array, matrix: np.ndarray, own: np.ndarray, groups: np.ndarray | None, most: int, digits: int
) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(queries, places of rows, scores): for each query its best rows, at most so many (of each group); own rows are in order of key."""
    if not len(own) or not len(matrix) or own.shape[1] != matrix.shape[1]:
        return
    own, step = own.T, max(1, SCORES // own.shape[0])
    for begin in range(0, len(ids), step):
        score = _scores(matrix[begin : begin + step], own, digits)
        if groups is None:
            best = _largest(score, most)
            q, at = np.repeat(np.arange(len(score)), best.shape[1]), best.ravel()
        else:
            order = np.lexsort([np.broadcast_to(np.arange(score.shape[1]), score.shape), -score, np.broadcast_to(groups, score.shape)], axis=1)
            first = np.concatenate([[True], np.diff(groups[order[0]]) != 0])
            place = np.arange(len(groups)) - np.maximum.accumulate(np.where(first, np.arange(len(groups)), 0))
            best = order[:, place < most]
            q, at = np.repeat(np.arange(len(score)), best.shape[1]), best.ravel()
        found = score[q, at]
        real = found > -np.inf
        yield ids.take(pa.array(begin + q[real])), at[real], found[real]


def _order(keys: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.argsort(np.asarray(keys.to_pylist(), object if pa.types.is_string(keys.type) else None), kind="stable")


def top_k(
    store: DataFrame, queries: DataFrame, k: int, key: str = "key", query: str = "query_id", vector: str = "vector",
    without_self: bool = False, digits: int = 6, by: str | None = None
) -> DataFrame:
    """query, (by,) key, score, rank: the k rows of the store with the largest cosines for each query.

    queries has query and vector. With by, a column of the store, each query gets the k best rows of each by (each document, say); if queries
    has it too, only of its own one. Scores are rounded to so many digits; ties go to the least key. A store of fewer rows is
    returned whole. Null vectors, and those of another length, match nothing; a zero vector has cosine 0 with all; a null by matches nothing.

    Few queries are broadcast, at most QUERY_NUMBERS numbers. Of more queries, and of queries that have a by, blocks are laid together with
    blocks of the store by a shuffle.
    """
    paired = by is not None and by in queries.columns
    asked = queries.select(F.col(query).alias("_q"), F.col(vector).alias("vector"), *([F.col(by).alias("_by")] if paired else []))
    rows = store.select(F.col(key).alias("_key"), F.col(vector).alias("vector"), *([F.col(by).alias("_by")] if by else []))
    rows = rows.filter("_by is not null") if by else rows
    grouped = ["_by"] if by else []
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    schema = ", ".join([f"_q {kind(asked, '_q')}", f"_key {kind(rows, '_key')}", *(f"_by {kind(rows, '_by')}" for _ in grouped), "score double"])
    names, most = ["_q", "_key", *grouped, "score"], k + bool(without_self)
    few = None if paired else _few(asked)
    if few is None and by and not paired:
        raise ValueError("queries for every group must be few; give each a group of its own")
    if few is not None:
        shared = store.sparkSession.sparkContext.broadcast(few)

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, matrix = shared.value
            for part in parts:
                part = part.take(pa.array(_order(part.column("_key"))))
                groups = np.unique(np.array([str(x) for x in part.column("_by").to_pylist()]), return_inverse=True)[1] if by else None
                for q, at, score in _best(ids, matrix, _matrix(part.column("vector")), groups, most, digits):
                    yield pa.record_batch([q, *(part.column(c).take(pa.array(at)) for c in ("_key", *grouped)), pa.array(score)], names)

        found = rows.mapInArrow(run, schema)
    else:

        def meet(own: pa.Table, others: pa.Table) -> pa.Table:
            own = own.take(pa.array(_order(own.column("_key")))).combine_chunks()
            out = [pa.table([others.column("_q").slice(0, 0), *(own.column(c).slice(0, 0) for c in ("_key", *grouped)), pa.array([], pa.float64())], names)]
            for q, at, score in _best(
                others.column("_q").combine_chunks(), _matrix(others.column("vector")), _matrix(own.column("vector")), None, most, digits
            ):
                out.append(pa.table([q, *(own.column(c).take(pa.array(at)) for c in ("_key", *grouped)), pa.array(score)], names))
            return pa.concat_tables(out)

        left, right = _blocks(rows, asked)
        found = left.groupBy("_by", "_b", "_s").cogroup(right.groupBy("_by", "_b", "_s")).applyInArrow(meet, schema)
    found = found.filter(F.col("_q") != F.col("_key")) if without_self else found
    rank = F.row_number().over(Window.partitionBy("_q", *grouped).orderBy(F.desc("score"), "_key"))
    ranked = found.withColumn("rank", rank).filter(F.col("rank") <= k)
    return ranked.select(F.col("_q").alias(query), *(F.col(c).alias(by) for c in grouped), F.col("_key").alias(key), "score", "rank")


def _few(asked: DataFrame) -> tuple[pa.Array, np.ndarray] | None:
    """The queries and their matrix, if they have at most QUERY_NUMBERS numbers; otherwise nothing is fetched."""
    size = asked.agg(F.sum(F.size("vector")).alias("numbers"), F.count(F.lit(1)).alias("n")).first()
    if max(size.numbers or 0, size.n) > QUERY_NUMBERS:
        return None
    rows = asked.toArrow()
    return rows.column("_q").combine_chunks(), _matrix(rows.column("vector"))


def _blocks(rows: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with _b and _s, so that in each group every block of queries meets every block of rows once. A group of any size is cut."""
    rows, asked = (df if "_by" in df.columns else df.withColumn("_by", F.lit(0)) for df in (rows, asked))
    size = lambda df, name: df.groupBy("_by").agg(F.greatest(F.lit(1), F.ceil(F.sum(F.size("vector")) / BLOCK_NUMBERS)).cast("long").alias(name))
    # A row for each group.
    sides = durable(size(rows, "_of_rows").join(size(asked, "_of_asked"), "_by"))
    sides = F.broadcast(sides) if sides.count() <= BROADCAST_GROUPS else sides
    cut = lambda name, of, *c: F.pmod(F.xxhash64(*c), F.col(of)).alias(name)
    every = lambda name, of: F.explode(F.sequence(F.lit(0).cast("long"), F.col(of) - 1)).alias(name)
    left = rows.join(sides, "_by").select("_by", cut("_s", "_of_rows", "_key", "vector"), every("_b", "_of_asked"), "_key", "vector")
    right = asked.join(sides, "_by").select("_by", cut("_b", "_of_asked", "_q", "vector"), every("_s", "_of_rows"), "_q", "vector")
    return left, right


def deduplicate(hits: DataFrame, key: Column | str = "key", by: str | None = None) -> DataFrame:
    """The first hit of each base key in order of rank, ranked anew (for each by)."""
    within = [by] if by else []
    rows = hits.withColumn("_base", T.base_key(key))
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*within, "_base").orderBy("rank"))).filter("_n = 1")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*within).orderBy("rank"))).drop("_base", "_n") if within else rows.drop("_base", "_n")


def deduplicate_with_score(hits: DataFrame, key: Column | str = "key", by: str = "query_id") -> DataFrame:
    """The best hit of each base key, the first on ties, by score."""
    rows = hits.withColumn("_base", T.base_key(key))
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(by, "_base").orderBy(F.desc("score"), "rank"))).filter("_n = 1")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "rank"))).drop("_base", "_n")


def search(store: DataFrame, queries: DataFrame, k: int, key: str = "key") -> DataFrame:
    """Top k after dedup: four times as many are fetched first."""
    hits = deduplicate_with_score(top_k(store, queries, 4 * k, key), key)
    return hits.filter(F.col("rank") <= k)


def merge_queries(hits: DataFrame, key: str = "chunk_id", by: list[str] | None = None) -> DataFrame:
    """Hits of several queries for one question: the largest score of each row, ranked."""
    within = by or []
    best = hits.groupBy(*within, key).agg(F.max("score").alias("score"))
    order = Window.partitionBy(*within).orderBy(F.desc("score"), key) if within else Window.orderBy(F.desc("score"), key)
    return best.withColumn("rank", F.row_number().over(order))


def heading_matches(chunks: DataFrame, queries: DataFrame, text: str = "term", key: str = "chunk_id") -> DataFrame:
    """query_id, key, score 1: chunks of which the heading contains the query's text, in any case. Queries are few."""
    contains = F.lower("heading").contains(F.lower(F.col(text)))
    return chunks.join(F.broadcast(queries.select("query_id", text)), contains).select("query_id", key, F.lit(1.0).alias("score"))


def with_heading_matches(hits: DataFrame, matches: DataFrame, key: str = "chunk_id") -> DataFrame:
    """hits and the heading matches that are not among them; hits keep their scores."""
    return hits.select("query_id", key, "score").unionByName(matches.join(hits, ["query_id", key], "left_anti"))


def first_seen(hits: DataFrame, chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The different chunks that were hit, by their start page."""
    return chunks.join(hits.select(key).distinct(), key, "left_semi").orderBy("start_page", key)


def pick_anchor(candidates: DataFrame, by: list[str], position: str) -> DataFrame:
    """The candidate (heading, content_length) of the best anchor score for each by; the first on ties."""
    rows = candidates.withColumn("anchor_score", T.anchor_score("heading", "content_length"))
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("anchor_score"), position))).filter("_n = 1").drop("_n")


def pick_best(candidates: DataFrame, query: str, decider, most: int = SHOWN) -> DataFrame:
    """For each document the candidate (rank, heading, content) that a decision picks of the best few, shown by 300 characters on one line; the first if it fails or picks none."""
    shown = F.concat_ws(" ", "heading", F.regexp_replace(F.substring("content", 1, SHOWN_CHARS), "\n", " "))
    few = candidates.filter(F.col("rank") <= most).withColumn("_shown", shown)
    listed = few.groupBy("doc_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "_shown"))), lambda x: x["_shown"]).alias("_shown"),
        F.array_sort(F.collect_list("rank")).alias("_ranks")
    )
    told = decider.decide(listed, "pick_best", {"query": F.lit(query), "candidates": F.col("_shown")}, "d")
    picked = told.select("doc_id", F.coalesce(F.when(F.col("d.index") >= 0, F.get("_ranks", F.col("d.index"))), F.get("_ranks", F.lit(0))).alias("rank"))
    return few.drop("_shown").join(picked, ["doc_id", "rank"], "left_semi")


def unique_headings(chunks: DataFrame) -> DataFrame:
    """The first chunk of each base heading that is not empty."""
    rows = chunks.withColumn("base_heading", T.base_heading("heading")).filter("base_heading <> ''")
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id", "base_heading").orderBy("chunk_id"))).filter("_n = 1").drop("_n")


def candidate_list(ranked: DataFrame, semantic: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Chunks that a decision ranked, then those that were retrieved; each once, at its first place. Both have doc_id, key and rank."""
    both = ranked.select("doc_id", key, "rank", F.lit(0).alias("_side")).unionByName(semantic.select("doc_id", key, "rank", F.lit(1).alias("_side")))
    once = both.groupBy("doc_id", key).agg(F.min(F.struct("_side", "rank")).alias("_place"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy("_place", key))).drop("_place")


def first_verified(attempts: DataFrame) -> DataFrame:
    """Of the attempts (doc_id, rank, verified) of each document, the first that was verified, or else the last."""
    order = F.when(F.col("verified"), F.col("rank")).otherwise(1_000_000 - F.col("rank"))
    place = Window.partitionBy("doc_id").orderBy((~F.col("verified")).cast("int"), order)
    return attempts.withColumn("_n", F.row_number().over(place)).filter("_n = 1").drop("_n")
