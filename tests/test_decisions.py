"""Live decisions: each item is asked once a step, and an unsteady function neither loses nor doubles an item."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillon.operators.decide import SCHEMAS, Live, Rules
from quillon.plans import compare, form_check, self_rag


def unsteady(folder, seed):
    """Answers at random, writes down what it was asked, and fails now and then."""

    def answer(kind, rows):
        import os
        import uuid

        rng = random.Random(f"{seed}{uuid.uuid4()}")
        with open(f"{folder}/{kind}-{os.getpid()}-{uuid.uuid4().hex}", "w") as f:
            f.writelines(f"{sorted((k, str(v)) for k, v in r.items())}\n" for r in rows)
        choose = {
            "clause_match": lambda: {"needs_lookup": rng.random() < 0.8}, "best_match": lambda: {"best_index": rng.randint(-1, 5), "confidence": rng.choice(["High", "Low", "Medium"])},
            "targeted_context": lambda: {"snippet": rng.choice(["", "part"])}, "deviation": lambda: {"has_deviation": rng.random() < 0.7, "deviation_type": "addition"}, "section_label": lambda: {"section": "1"},
            "comment": lambda: {"comments": "c"}, "grounding": lambda: {"grounded": rng.random() < 0.5, "issues": rng.choice(["", "odd"])}, "materiality": lambda: {"score": rng.randint(0, 5), "severity": "Low"},
            "field_match": lambda: {"match": rng.random() < 0.5, "reason": "r"}, "retrieve": lambda: {"response": rng.choice(["Yes", "No"])}, "relevance": lambda: {"response": rng.choice(["Relevant", "Irrelevant"])},
            "generate": lambda: {"response": rng.choice("xyz")}, "support": lambda: {"response": rng.choice(["Fully supported", "No support"])}, "utility": lambda: {"response": rng.randint(1, 5)},
        }[kind]
        return [choose() if rng.random() < 0.9 else None for _ in rows]

    return answer


def asked(folder):
    """How often each kind was asked about each input."""
    return {kind: Counter(line for p in folder.glob(f"{kind}-*") for line in p.read_text().splitlines()) for kind in SCHEMAS}


@pytest.fixture
def tables(spark):
    rng = random.Random(2)
    vector = lambda: [rng.random(), rng.random()]
    items = spark.createDataFrame([(i, i % 9, f"clause number {i} of some words", vector(), i % 4) for i in range(120)], "item_no int, page int, content string, vector array<double>, pair int")
    base = spark.createDataFrame([(i, i, f"base {i} text", vector(), i % 5) for i in range(40)], "key long, page int, content string, vector array<double>, pair int")
    return items, base


@pytest.mark.parametrize("by", [None, "pair"])
def test_every_item_comes_once(spark, tmp_path, tables, by):
    items, base = tables
    found = compare.compare_pages(items, base, Live(unsteady(tmp_path, 1), 3), by=by)
    rows = found.collect()
    assert sorted(r.item_no for r in rows) == [*range(120)] and rows == found.collect()
    counts = asked(tmp_path)
    once = {"clause_match", "best_match", "targeted_context", "deviation", "section_label", "grounding", "materiality"}
    # Inputs of different items differ in the clause, so one that is asked twice would show.
    assert all(max(counts[kind].values(), default=1) == 1 for kind in once)
    assert len(counts["clause_match"]) == 120 and sum(counts["best_match"].values()) < 120
    assert sum(r.deviation for r in rows) == sum(counts["materiality"].values()) > 0
    assert compare.item_problems(found.filter("comments is not null")).count() == 0


def test_pairs_meet_only_themselves(spark, tables):
    items, base = tables
    text = {r.content: r.pair for r in base.collect()}
    for r in compare.compare_pages(items, base, Rules(), by="pair").collect():
        assert not r.base_paragraph or text[r.base_paragraph] == r.pair
    got = compare.retrieve_candidates(items, base, 3, "pair").collect()
    assert {(r.item_no, r.pair, len(r.candidates)) for r in got} == {(i, i % 4, 3) for i in range(120)}


def test_fields_are_asked_once(spark, tmp_path, tables):
    items, base = tables
    fields = items.select(F.col("item_no").alias("seq"), F.concat(F.lit("f"), "item_no").alias("name"), F.lit("v").alias("value"), "vector", "pair")
    store, texts = base.select("key", F.col("content").alias("heading"), "vector", "pair"), base.select("key", F.col("content").alias("text"), "pair")
    found = form_check.check_fields(fields, store, texts, Live(unsteady(tmp_path, 3)), 0.9, by="pair").collect()
    assert sorted(r.seq for r in found) == [*range(120)]
    assert sum(asked(tmp_path)["field_match"].values()) == sum(r.reason in ("r", "Comparison error") for r in found) < 120


def test_every_query_has_one_answer(spark, tmp_path, tables):
    items, base = tables
    queries = items.select(F.col("item_no").alias("query_id"), F.col("content").alias("query"), "vector")
    found = self_rag.self_rag(queries, base.drop("pair"), Live(unsteady(tmp_path, 4)))
    assert sorted(r.query_id for r in found.collect()) == [*range(120)]
    assert max(asked(tmp_path)["retrieve"].values()) == max(asked(tmp_path)["relevance"].values()) == 1


def test_rows_outside_where_are_not_asked(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"c{i}") for i in range(20)], "id int, clause string")
    for decider in (Live(unsteady(tmp_path, 5)), Rules()):
        told = decider.decide(rows, "clause_match", {"clause": F.col("clause")}, "d", F.col("id") < 5)
        assert told.columns == ["id", "clause", "d"] and all(r.d is None for r in told.collect() if r.id >= 5)
    assert sum(asked(tmp_path)["clause_match"].values()) == 5
