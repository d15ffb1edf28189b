"""One query for each corpus operator, with production parameters over whole tables, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import bpe_codec, decontam, exact_dedup, language_id, ngram_join, quality, sharding, token_counts, token_store, tokenizer_files, toxicity
from quillon.llm.runtime import table

SQL: dict[str, str] = {}


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


SQL["op1_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language_id.identify(docs, language_id.train(docs.filter(~language_id.held_out(F.col("doc_id")))))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents has no URLs: its source stands for the host, and the part of a source in one language for a path on it."""
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, table(spark, sf_dir, "labels"), F.col("source"), F.concat_ws("/", "source", "lang"))


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.digests(table(spark, sf_dir, "documents"), tokenizer_files.path("byte_bpe_50k.json"))


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_store.fresh_path(spark)
    token_store.write_ids(table(spark, sf_dir, "documents"), tokenizer_files.path("word_bpe_49k.json"), path)

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums = [token_store.crc32_of(ids) for ids in b.column("ids").to_pylist()]
            yield pa.record_batch(
                [b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(sums, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"]
            )

    return token_store.read_ids(spark, path).mapInArrow(crc, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_groups(table(spark, sf_dir, "documents"), ngram_join.Rule(3, 90, 100))


SQL["op8_ngram_join"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + least(3, len(w)) - 1], ' ') AS shingle
      FROM d, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS u(k) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
met AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM met JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 90 * (p.n + q.n - c)),
degree AS (SELECT x, count(*) AS n_links FROM link GROUP BY x),
reach AS (SELECT x, y FROM link UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x),
least_of AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(r.y, d.doc_id)) AS component_id, coalesce(n_links, 0)::BIGINT AS n_links
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least_of r ON r.x = d.doc_id LEFT JOIN degree g ON g.x = d.doc_id
"""


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    ids = F.array_join(F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated")
    )


SQL["op9_decontamination"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[k:k + least(10, len(w)) - 1], ' ') AS win
       FROM b, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS u(k) WHERE len(w) > 0),
ns AS (SELECT DISTINCT n FROM bw),
hit AS (SELECT d.doc_id, u.k, ns.n, bw.item_id FROM d, ns, unnest(range(1, len(d.w) - ns.n + 2)) AS u(k), bw
        WHERE bw.n = ns.n AND bw.win = array_to_string(d.w[u.k:u.k + ns.n - 1], ' ')),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(k, k + n)) AS v(p) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS sha FROM hit GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_files.path("word_bpe_49k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
