"""Queries that do the whole job, against their SQL and for what a part of it would leave out."""


import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import vectors
from quillon.plans import queries

GATHERED = ["gather_section", "gather_section_v1", "walk_from_anchor", "search_section", "merged_sections"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents of 1 to 90 lines, so that some have a single chunk and some many; no named sections (annexes), which the SQL does not know."""
    path = tmp_path_factory.mktemp("whole")
    texts = [(i, "\n".join(f"{'Terms' if (i + k) % 5 == 0 else 'Words'} {'x' * ((i * 3 + k) % 11)} line {k}" for k in range(n))) for i, n in enumerate([1, 2, 3, 5, 12, 30, 90])]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return str(path)


def sql_rows(folder, name, *tables):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in tables:
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    return want.columns, sorted(want.fetchall())


@pytest.mark.parametrize("name", GATHERED)
def test_every_chunk_is_searched_from(spark, folder, name):
    found = queries.queries()[name](spark, folder)
    anchors = {(r.doc_id, r.anchor_id) for r in found.collect()}
    assert anchors == {(r.doc_id, r.chunk_id) for r in queries.font_headings_chunks(spark, folder).collect()}
    assert {d for d, _ in anchors} == {*range(7)}
    columns, want = sql_rows(folder, name, "documents")
    assert sorted(map(tuple, found.select(*map(F.col, columns)).collect())) == want


def test_every_row_is_a_field_and_a_section(spark, tmp_path):
    rng = np.random.default_rng(3)
    at = rng.normal(size=(130, 4))
    at[7], at[51] = at[3], at[3]  # ties go to the least key
    rows = [(i, [float(x) for x in v], i % 3) for i, v in enumerate(at)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label long").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = queries.form_route(spark, str(tmp_path)).collect()
    unit = at / np.linalg.norm(at, axis=1, keepdims=True)
    score = np.round(unit @ unit.T, 6)
    np.fill_diagonal(score, -2)
    near = score.argmax(1)
    told = lambda i: "Unmatched" if score[i, near[i]] < 0.45 else "Match" if i % 3 == near[i] % 3 else "Deviation"
    assert sorted((r.seq, r.section_key, r.result.split()[-1]) for r in found) == [(i, str(near[i]), told(i)) for i in range(130)]
    columns, want = sql_rows(str(tmp_path), "form_route", "embeddings")
    assert sorted(map(tuple, queries.form_route(spark, str(tmp_path)).select(*columns).collect())) == want


def test_largest_are_in_order_of_place_on_ties():
    rng = np.random.default_rng(4)
    for n in (1, 2, 3):
        for width in (1, 2, 5):
            score = rng.integers(0, 3, (50, width)).astype(float)
            got = vectors._largest(score, n)
            assert (got == np.argsort(-score, axis=1, kind="stable")[:, :n]).all()


def test_split_covers_every_text(spark, tmp_path):
    """Through the query, with its own parameters: pieces are in order, none is too long, neighbours overlap by no more than allowed, and nothing but white space is left out."""
    import hashlib
    import random

    from quillon.operators import split

    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 12)))
    texts = {i: "".join(word() + rng.choice([" ", " ", "\n", "\n\n"]) for _ in range(n)) for i, n in enumerate([0, 5, 2000, 9000, 20000])} | {5: "x" * 50_000, 6: "z" * 21_000, 7: None}
    spark.createDataFrame([*texts.items()], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.split_chunks(spark, str(tmp_path)).collect()
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").select("doc_id", F.col("doc_id").cast("string").alias("key"), F.lit(0).alias("ord"), "text")
    pieces = {}
    for r in split.chunk_sections(docs).collect():
        pieces.setdefault(r.doc_id, {})[r.piece] = (r.key, r.text)
    assert {(r.doc_id, r.piece, r.key, r.digest) for r in found} == {(d, i, k, t and hashlib.md5(t.encode()).hexdigest() if t else (hashlib.md5(b"").hexdigest() if t == "" else None)) for d, own in pieces.items() for i, (k, t) in own.items()}
    for d, text in texts.items():
        own = [pieces[d][i] for i in range(len(pieces[d]))]
        assert [k for k, _ in own] == ([str(d)] if len(own) == 1 else [f"{d} [{i + 1}/{len(own)}]" for i in range(len(own))])
        if not text:
            continue
        end = 0
        for _, piece in own:
            assert len(piece) <= split.SECTION_CHARS
            at = text.find(piece, max(0, end - split.SECTION_OVERLAP))
            assert at >= 0 and not text[end:at].strip()
            end = at + len(piece)
        assert not text[end:].strip()


def test_global_ranks(spark):
    from quillon.durable import ranked

    rows = spark.createDataFrame([(i % 7, i) for i in range(200)], "a int, b int")
    got = {(r.a, r.b): r.n for r in ranked(rows, "n", F.desc("a"), F.col("b")).collect()}
    assert got == {(i % 7, i): k + 1 for k, i in enumerate(sorted(range(200), key=lambda i: (-(i % 7), i)))}
    assert ranked(rows.limit(0), "n", F.col("a")).count() == 0
