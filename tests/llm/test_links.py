"""Numbers of links of the n-gram join against brute force."""

import random

import numpy as np
import pytest

from quillon.llm import components, exact_dedup, ngram_join, promising


def shingles(text, words):
    w = (text or "").lower().split()
    return {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()


@pytest.mark.parametrize("block", [ngram_join.BLOCK_SHINGLES, 150])
def test_links_are_counted(spark, block):
    """Groups of k similar texts have k (k - 1) links, not k - 1; copies count, also across tiles."""
    rng = random.Random(11)
    base = [" ".join(f"w{g}x{i}" for i in range(60)) for g in range(3)]
    texts = [f"{b} {' '.join(rng.choices('pqrs', k=rng.randint(0, 4)))}".strip() for b in base for _ in range(12)]
    texts += [texts[0], texts[0], texts[20], "alone in its own words", "", None]
    sets = [shingles(t, 3) for t in texts]
    linked = lambda a, b: bool(a) and bool(b) and 100 * len(a & b) >= 90 * len(a | b)
    want = [sum(linked(a, b) for j, b in enumerate(sets) if j != i) for i, a in enumerate(sets)]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.n_links for r in ngram_join.near_groups(docs, ngram_join.Rule(3, 90, 100), block).collect()}
    assert [got[i] for i in range(len(texts))] == want and max(want) > 5


@pytest.mark.parametrize("most, share", [(10**6, 1000), (0, 1000), (0, 2)])
def test_components_with_hot_nodes(spark, monkeypatch, most, share):
    """All nodes' least neighbours broadcast, none hot, and many hot."""
    monkeypatch.setattr(components, "BROADCAST_EDGES", most)
    monkeypatch.setattr(components, "SHARE", share)
    edges = [(0, i) for i in range(1, 40)] + [(i, i + 1) for i in range(100, 130)] + [(200, 201), (201, 200), (5, 5), (39, 300), (130, 250)]
    got = dict(components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    assert got == {x: root(x) for x in parent if x != 5 or root(x) != 5}


def test_one_row_of_each_component_stays(spark):
    """Null and repeated ids, one id with two texts, repeated rows, and columns with the names that the operators use inside."""
    near = lambda k: " ".join(f"n{i}" for i in range(80)) + f" tail{k}"
    rows = [(1, near(1)), (1, near(1)), (2, near(2)), (1, "quite another text of its own"), (1, ""), (None, near(3)), (None, "lone text without id"), (7, None), (7, None)]
    names = ["kept_id", "kept_key", "kept_sha", "staying", "copies", "component", "key", "cid", "rep", "_id", "_sha", "_gone", "n"]
    docs = spark.createDataFrame([(*r, *range(len(names))) for r in rows], "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    left = ngram_join.one_of_each(docs, ngram_join.Rule(5, 80, 100))
    assert left.columns == docs.columns and all(tuple(r)[2:] == (*range(len(names)),) for r in left.collect())
    want = [(1, near(1)), (1, "quite another text of its own"), (1, ""), (None, "lone text without id"), (7, None), (7, None)]
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=key) == sorted(want, key=key)
    nameless = spark.createDataFrame([(None, near(1)), (None, near(2)), (None, near(2))], "doc_id long, text string")
    assert ngram_join.one_of_each(nameless).count() == 1
    exact = exact_dedup.drop_copies(docs)
    assert exact.columns == docs.columns and exact.count() == 6


def test_steps_round_trip():
    rng = random.Random(5)
    for _ in range(100):
        rows = [sorted(rng.choices(range(rng.choice([3, 300, 2048])), k=rng.randint(1, 20))) for _ in range(rng.randint(1, 5))]
        begins = np.cumsum([0, *map(len, rows[:-1])])
        data, at = promising._steps(np.concatenate(rows), begins)
        ends = [*at[begins][1:], len(data)]
        assert [promising._owners(data[a:b].tobytes()).tolist() for a, b in zip(at[begins], ends)] == rows
