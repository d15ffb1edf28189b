"""Edges of the corpus operators: clashing column names, bounds on what is held at a time, and odd rows in every stage."""

import pytest

from quillon.llm import decontam

SPANS = ["_spans", "_n_words", "_item_ids", "spans", "n_words", "item_ids", "row", "first"]


def words(name, n):
    return " ".join(f"{name}{i}" for i in range(n))


@pytest.mark.parametrize("most", [1000, 2])
def test_decontamination_keeps_columns(spark, monkeypatch, most):
    """With one block and with several, all columns stay; never is there more than one live block of several."""
    made, live, peak = spark.sparkContext.broadcast, set(), []

    def counted(value):
        shared = made(value)
        live.add(shared)
        peak.append(len(live))
        destroy = shared.destroy
        shared.destroy = lambda *a: (live.discard(shared), destroy(*a))
        return shared

    monkeypatch.setattr(spark.sparkContext, "broadcast", counted)
    texts = [f"Intro {words('b', 9)} end", words("c", 30), None, "", f"x {words('b', 9)} y {words('d', 7)}!", f"x {words('b', 9)} y {words('d', 7)}!", words("d", 6)]
    docs = spark.createDataFrame([(i if i != 5 else 4, t, *range(len(SPANS))) for i, t in enumerate(texts)], "doc_id long, text string, " + ", ".join(f"`{c}` int" for c in SPANS))
    items = spark.createDataFrame([(1, words("b", 9)), (2, words("d", 7)), (None, words("c", 3)), (3, None), (4, "")], "item_id long, text string")
    left = decontam.without_documents(docs, items, 4, most)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [2, 3]
    cut = decontam.without_spans(docs, items, 4, most)
    rows = cut.collect()
    assert cut.columns == docs.columns and all(tuple(r)[2:] == (*range(len(SPANS)),) for r in rows)
    assert sorted((r.doc_id, r.text) for r in rows if r.text is not None and r.doc_id != 1) == [(0, "Intro  end"), (3, ""), (4, "x  y !"), (4, "x  y !"), (6, "")]
    found = {r.doc_id: r for r in decontam.find_hits(docs, items, 4, most).collect()}
    assert (found[4].item_ids, found[4].n_words, found[1].item_ids, found[2].n_words) == ([1, 2], 18, [], 0)
    assert [(s.first, s.last) for s in found[4].spans] == [(1, 10), (11, 18)]
    assert max(peak) <= 3 if most == 1000 else max(peak) == 1
    with pytest.raises(ValueError):
        decontam.mark(docs, items)
