"""The pipeline on a small corpus with planted cases, and the corpus queries' SQL."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm import queries as corpus
from quillon.llm import tokenizer_files

SF = "/root/testdata/sf0.001"


def passage(name, n):
    return " ".join(f"{name}{i}" for i in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    clean = [(i, passage(f"clean{i}x", 60), "en", "s", 0) for i in range(40)]
    toxic = [(100 + i, passage(f"tox{i}x", 30) + " skum idjit skum " + passage(f"tux{i}x", 20), "en", "s", 0) for i in range(20)]
    exact = [(200, "same text here of words", "en", "s", 0), (201, "same text here of words", "en", "s", 0)]
    near = [(300, passage("near", 80), "en", "s", 0), (301, passage("near", 80) + " tail", "en", "s", 0)]
    leak = [(400, passage("lead", 20) + " " + passage("bench", 15) + " " + passage("rear", 20), "en", "s", 0)]
    odd = [(500, "", "en", "s", 0), (501, None, "en", "s", 0), (None, "no id at all in this row", None, None, None)]
    spark.createDataFrame(clean + toxic + exact + near + leak + odd, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(100 + i, 1, 1) for i in range(15)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, passage("bench", 15))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_planted_cases(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    ids = [r.doc_id for r in rows]
    assert sorted(i for i in ids if i is not None) == [*range(40), 201, 300, *[i for i in (500, 501) if i in ids]]
    assert (500 in ids) != (501 in ids) and None in ids  # a null text counts as an empty one
    tokenizer = tokenizer_files.load(tokenizer_files.path("byte_bpe_50k.json"))
    for r in rows:
        assert r.ids == tokenizer.encode(r.text or "", add_special_tokens=False).ids


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns
        assert stage(spark, docs.limit(0), folder).count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_join", "decontamination", "bpe_codec"]


@pytest.mark.parametrize("name", sorted(corpus.oracle_sql()))
@pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")
def test_queries_are_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(corpus.oracle_sql()[name])
    got = corpus.queries()[name](spark, SF).select(*map(F.col, want.columns)).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
