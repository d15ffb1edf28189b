"""Top-k retrieval against brute force: by groups, with few and with many queries, ties, nulls and vectors of other lengths."""

import numpy as np
import pytest

from quillon.operators import vectors
from quillon.operators.decide import Rules
from quillon.plans import extract


def table(spark, n, seed):
    rng = np.random.default_rng(seed)
    at = rng.integers(-2, 3, (n, 3)).astype(float)
    rows = [(i, f"k{i:03}", ["a", "b", "c", None][i % 4] if i % 3 else "a", [float(x) for x in v]) for i, v in enumerate(at)]
    rows += [(900, "k900", "a", None), (901, "k901", "b", [1.0]), (902, "k902", "d", [0.0, 0.0, 0.0])]
    return rows, spark.createDataFrame(rows, "id long, key string, part string, vector array<double>")


def cosine(a, b):
    if a is None or b is None or len(a) != len(b):
        return None
    a, b = np.array(a), np.array(b)
    return round(float(a @ b / max(np.linalg.norm(a) * np.linalg.norm(b), 1e-300)), 6) + 0.0


def brute(rows, queries, k, by=None):
    """by: None, every (each query in each part) or own (only in the query's part)."""
    out = set()
    for q in queries:
        groups = {}
        for r in rows:
            if (c := cosine(r[3], q[3])) is not None and (by is None or r[2] is not None) and (by != "own" or r[2] == q[2]):
                groups.setdefault(r[2] if by else None, []).append((-c, r[1]))
        out |= {(q[0], g, key, -c + 0.0, n + 1) for g, found in groups.items() for n, (c, key) in enumerate(sorted(found)[:k])}
    return out


@pytest.mark.parametrize("few", [8_000_000, 1])
def test_top_k_is_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(vectors, "QUERY_NUMBERS", few)
    monkeypatch.setattr(vectors, "BLOCK_NUMBERS", 30)
    rows, df = table(spark, 60, 1)
    asked = [r for r in rows if r[3] is None or len(r[3]) == 3][:23]
    queries = spark.createDataFrame(asked, df.schema)
    plain = queries.select("id", "vector")
    got = {(r.id, None, r.key, r.score, r["rank"]) for r in vectors.top_k(df, plain, 4, query="id").collect()}
    assert got == brute(rows, asked, 4)
    own = {(r.id, r.part, r.key, r.score, r["rank"]) for r in vectors.top_k(df, queries, 2, query="id", by="part").collect()}
    assert own == brute(rows, asked, 2, "own")
    itself = vectors.top_k(df.drop("key").withColumnRenamed("id", "key"), plain, 3, query="id", without_self=True).collect()
    assert all(r.id != r.key for r in itself) and {r.id for r in itself} == {q[0] for q in asked if q[3]}
    if few > 1:
        every = {(r.id, r.part, r.key, r.score, r["rank"]) for r in vectors.top_k(df, plain, 2, query="id", by="part").collect()}
        assert every == brute(rows, asked, 2, "every")
    else:
        with pytest.raises(ValueError):
            vectors.top_k(df, plain, 2, query="id", by="part")
    for empty in (vectors.top_k(df.limit(0), plain, 2, query="id"), vectors.top_k(df, queries.limit(0), 2, query="id", by="part")):
        assert empty.count() == 0


def test_every_document_has_hits_of_its_own(spark):
    """200 documents, far more than the hits for one store would reach."""
    rows = [(d, i, f"{i + 1}. Part {d % 7}", f"text {d} {i}", [i + 1], i + 1) for d in range(200) for i in range(3)]
    chunks = spark.createDataFrame(rows, "doc_id long, chunk_id int, heading string, content string, pages array<int>, start_page int")
    embed = vectors.digest_embedder()
    assert sorted(r.doc_id for r in extract.extract_definitions(chunks, embed, 1).select("doc_id").collect()) == [*range(200)]
    nested = chunks.withColumn("parent_heading", chunks.heading)
    assert sorted(r.doc_id for r in extract.extract_section(nested, "zzz", embed, Rules(), 1).select("doc_id").collect()) == [*range(200)]
    index = extract.SectionIndex(nested, embed)
    found = index.search("zzz").collect()
    index.close()
    assert sorted(r.doc_id for r in found) == [*range(200)]
