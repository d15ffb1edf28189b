"""The corpus queries themselves against brute force, on a small corpus of odd rows: nulls, repeated rows and texts, long texts, ties, clashing columns."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm import language_id, linear, ngram_join, quality, queries, sharding, tokenizer_files, toxicity
from quillon.llm.bytescan import ALPHANUMERIC, prefixes, scan
from quillon.llm.labels import sample
from quillon.llm.runtime import table

RUDE = ["scum", "idiot", "moron"]
EXTRA = ["keep_id", "kept", "copies", "sha", "h", "name", "p_toxic", "p_junk", "fold", "y", "host", "path", "s", "n", "row", "ids", "start", "bytes", "place", "shard", "slot", "high", "low", "cid", "key", "_spans", "_at", "_part", "rep", "size"]


def made(rng, lang):
    words = {"en": ["the", "and", "which", "thing"], "de": ["und", "nicht", "schön", "straße"]}[lang]
    return " ".join(rng.choice(words) + rng.choice(["", "", "s", "en"]) for _ in range(rng.randint(5, 40)))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path, rng = str(tmp_path_factory.mktemp("queries")), random.Random(21)
    rows = [(i, made(rng, lang := rng.choice(["en", "de"])), lang, f"site{i % 3}") for i in range(150)]
    rows += [(200 + i, f"{made(rng, 'en')} {rng.choice(RUDE)} {rng.choice(RUDE)}, {made(rng, 'en')}", "en", "site0") for i in range(60)]
    rows += [(300 + i, "### $$$ " * 9 + f"A{i} 1234", "en", "site9") for i in range(30)]
    rows += [(400, "", None, None), (401, None, "en", None), (None, "no id here", None, "site1"), (402, "x", "de", "rare"), (403, "12 !", "en", "rare"), (404, "日本語 <|endoftext|> 🙂", "en", "rare")]
    rows += [(500 + i, "same text " * 20, "en", "site0") for i in range(40)] + [(500, "same text " * 20, "en", "site0")] * 2
    rows += [(600, " ".join(f"w{i % 977}" for i in range(60_000)), "en", "site2"), (601, "long" * 20_000, "en", "site2"), (602, " ".join(f"w{i % 977}" for i in range(60_000)) + " tail", "en", "site2")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA)
    spark.createDataFrame([(*r, len(r[1] or ""), *EXTRA) for r in rows], schema).repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(0, 150, 2)] + [(200 + i, 1, 1) for i in range(0, 60, 2)] + [(300 + i, 0, 0) for i in range(0, 30, 2)] + [(0, 1, None), (None, 1, 1), (2, None, 0), (999, 1, 1), (500, 1, 0), (500, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11"), (None, "no id here"), (3, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.fixture(scope="module")
def rows(spark, folder):
    return [(r.doc_id, r.text, r.lang, r.source) for r in table(spark, folder, "documents").collect()]


def answers(spark, folder, name):
    return queries.queries()[name](spark, folder).collect()


def ordered(found):
    return sorted(found, key=lambda r: tuple((x is not None, x if x is not None else 0) for x in r))


def test_op1(spark, folder, rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[t or ""].append(i)
    got = answers(spark, folder, "op1_exact_dedup")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(i, max(x for x in groups[t or ""] if x is not None) if any(x is not None for x in groups[t or ""]) else None, len(groups[t or ""]), sha(t or "")) for i, t, *_ in rows]
    assert ordered((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == ordered(want)
    assert sum(r.kept for r in got) == len(groups) and all(r.doc_id == r.keep_id for r in got if r.kept)


def slow_chain(model, text, known):
    """The chain's probabilities from words, one by one."""
    w = scan(pa.array([text], pa.string()), ALPHANUMERIC)
    found = [int(h) for h in np.concatenate([w.hash, prefixes(w, toxicity.PREFIX_BYTES)]) if int(h) in known]
    counts = np.array([found.count(int(t)) for t in model.terms], float)
    form = (quality.features(pa.array([text], pa.string()))[0] - model.center) / model.scale
    junk = 1 / (1 + np.exp(-(form @ model.weights[0][:-1] + model.weights[0][-1])))
    x = [*np.log1p(counts), np.log1p(counts.sum()), np.log1p((counts > 0).sum()), (100 * counts.sum() / max(len(w.hash), 1)) ** 0.5, junk]
    return junk, 1 / (1 + np.exp(-(np.array(x) @ model.weights[1][:-1] + model.weights[1][-1])))


def test_op2(spark, folder, rows):
    """Each row has the chain's probabilities; texts with the words that labels tie to toxicity are found, labelled or not, and no others."""
    model = toxicity.train(table(spark, folder, "documents"), table(spark, folder, "labels"))
    known = {int(t) for t in model.terms}
    got = answers(spark, folder, "op2_toxicity")
    want = [(i, *(round(float(p), 6) for p in slow_chain(model, t, known))) for i, t, *_ in rows]
    assert np.allclose(np.array(sorted((r.doc_id or -1, r.p_junk, r.p_toxic) for r in got)), np.array(sorted((i or -1, a, b) for i, a, b in want)), atol=1e-5)
    assert {r.doc_id for r in got if r.toxic} == {200 + i for i in range(60)} and all(r.kept != r.toxic for r in got)


def test_terms_are_picked_without_the_fold(spark, folder):
    """The terms for a fold are those of a corpus without that fold's rows."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    folded = sample(docs, labels, "toxic", 1000, "quality").withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(toxicity.FOLDS)).cast("int")).cache()
    sizes = lambda df: {(r.y, r.fold): r["count"] for r in df.groupBy("y", "fold").count().collect()}
    all_terms = toxicity._picked(folded, sizes(folded), 50)
    for k in (0, 3):
        marked = folded.withColumn("text", F.when(F.col("fold") == k, "quite other words here").otherwise(F.col("text")))
        assert [all_terms[b, k].tolist() for b in range(3)] == [toxicity._picked(marked, sizes(marked), 50)[b, k].tolist() for b in range(3)]
    rows = sample(docs, labels, "toxic", 1000, "quality")
    assert rows.count() == rows.select("doc_id").distinct().count() == 121


def test_labels_of_one_kind_reject_nothing(spark, folder):
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    for kind in ("toxic = 1", "toxic = 0", "toxic is null"):
        assert toxicity.classify(docs, labels.filter(kind).drop("quality")).filter("toxic").count() == 0


def test_op3(spark, folder, rows):
    """Against prototypes and cosines made one text at a time."""
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 5 == 0
    unit = lambda v: v / max(np.linalg.norm(v), 1e-12)
    one = lambda t: unit(language_id.vectors([t])[0].astype(float))
    taught = {(t, lang) for i, t, lang, _ in rows if t is not None and lang and not held(i)}
    sums = defaultdict(lambda: np.zeros(language_id.DIMENSIONS))
    for t, lang in taught:
        sums[lang] += one(t)
    own = {k: unit(v) for k, v in sums.items()}
    want = []
    for i, t, *_ in rows:
        letters = t is not None and any(c.isalpha() for c in t)
        score, lang = max((float(one(t) @ v), k) for k, v in own.items()) if letters else (0.0, "und")
        want.append((i, held(i), lang, round(max(score, 0), 4)))
    got = ordered((r.doc_id, r.held_out, r.lang_pred, round(r.score, 4)) for r in answers(spark, folder, "op3_language_id"))
    for a, b in zip(got, ordered(want), strict=True):
        assert a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-3


def test_op4(spark, folder, rows):
    """Posteriors of hosts and paths from the documents' evidence, without the row's own, in plain Python."""
    got = answers(spark, folder, "op4_quality")
    site = lambda r: (r[3] or "", "/".join(x for x in (r[3], r[2]) if x is not None))
    assert ordered((r.doc_id, r.host, r.path) for r in got) == ordered((r[0], *site(r)) for r in rows)
    hosts, paths = defaultdict(list), defaultdict(list)
    for r in got:
        hosts[r.host].append(r.p_document)
        paths[r.host, r.path].append(r.p_document)
    overall = np.mean([r.p_document for r in got])

    def strength(groups, prior):
        total = sum(len(v) * prior[k] * (1 - prior[k]) for k, v in groups.items())
        excess = sum(len(v) * (np.mean(v) - prior[k]) ** 2 - prior[k] * (1 - prior[k]) for k, v in groups.items())
        return float(np.clip(total / excess - 1, *quality.STRENGTH)) if excess > 0 else quality.STRENGTH[1]

    k_host = strength(hosts, dict.fromkeys(hosts, overall))
    above = {k: (sum(v) + k_host * overall) / (len(v) + k_host) for k, v in hosts.items()}
    k_path = strength(paths, {k: above[k[0]] for k in paths})
    logit = lambda p: np.log(p / (1 - p))
    for r in got:
        host_rate = (sum(hosts[r.host]) - r.p_document + k_host * overall) / (len(hosts[r.host]) - 1 + k_host)
        own = paths[r.host, r.path]
        path_rate = (sum(own) - r.p_document + k_path * host_rate) / (len(own) - 1 + k_path)
        odds = logit(r.p_document) + logit(np.clip(path_rate, 1e-4, 1 - 1e-4)) - logit(np.clip(overall, 1e-4, 1 - 1e-4))
        assert np.allclose([r.host_rate, r.path_rate, r.quality], [host_rate, path_rate, 1 / (1 + np.exp(-odds))], atol=1e-9) and r.kept == (r.quality >= 0.5)
    mean, scale, weights = quality.train(table(spark, folder, "documents"), table(spark, folder, "labels"))
    p = {t: float(np.clip(linear.predict((quality.features(pa.array([t], pa.string())) - mean) / scale, weights)[0], 1e-4, 1 - 1e-4)) for _, t, *_ in rows}
    assert np.allclose(sorted(r.p_document for r in got), sorted(p[t] for _, t, *_ in rows), atol=1e-9)


def test_op5_op6_op10(spark, folder, rows):
    byte, word = (tokenizer_files.load(tokenizer_files.path(f"{n}.json")) for n in ("byte_bpe_50k", "word_bpe_49k"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    ids = {t: byte.encode(t or "", add_special_tokens=False).ids for _, t, *_ in rows}
    want = [(i, len(ids[t]), sha(",".join(map(str, ids[t]))), sha(byte.decode(ids[t], skip_special_tokens=False))) for i, t, *_ in rows]
    assert ordered(map(tuple, answers(spark, folder, "op5_bpe_codec"))) == ordered(want)
    counts = {t: len(word.encode(t or "", add_special_tokens=False).ids) for _, t, *_ in rows}
    want = [(i, len((t or "").encode()), counts[t], counts[t] > 2048) for i, t, *_ in rows]
    assert ordered(map(tuple, answers(spark, folder, "op10_token_counts"))) == ordered(want)
    got, at = sorted(answers(spark, folder, "op6_token_store"), key=lambda r: r.start), 0
    crc = {t: zlib.crc32(np.array([*word.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for _, t, *_ in rows}
    assert ordered((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == ordered((i, counts[t] + 1, crc[t]) for i, t, *_ in rows)
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda i: (i is not None, i or 0))


def test_op7(spark, folder, rows):
    got = answers(spark, folder, "op7_sharding")
    size = lambda t: len((t or "").encode()) + 1
    crc = lambda t: zlib.crc32((t or "").encode())
    assert ordered((r.doc_id, r.size, r.text_crc32, r.law, r.grown_shard) for r in got) == ordered((i, size(t), crc(t), "bytes", None) for i, t, *_ in rows)
    groups, loads, where = defaultdict(int), defaultdict(int), defaultdict(set)
    for _, t, *_ in rows:
        groups[crc(t)] += size(t)
    for r in got:
        loads[r.shard] += r.size
        where[r.text_crc32].add(r.shard)
    placed = sharding.schedule([*groups.items()], 16)
    assert all(len(s) == 1 for s in where.values())
    assert [loads[k] for k in range(16)] == [sum(n for g, n in groups.items() if placed[g] == k) for k in range(16)]
    for k in range(16):
        assert sorted(r.slot for r in got if r.shard == k) == [*range(sum(r.shard == k for r in got))]


def test_op8(spark, folder, rows):
    rule = ngram_join.Rule(3, 90, 100)
    sets = []
    for _, t, *_ in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set())
    linked = lambda a, b: bool(a and b) and rule.den * len(a & b) >= rule.num * len(a | b)
    near = [[j for j, b in enumerate(sets) if j != i and linked(a, b)] for i, a in enumerate(sets)]
    least = []
    for i in range(len(rows)):
        seen, open_ = {i}, [i]
        while open_:
            open_ += [j for j in near[open_.pop()] if j not in seen and not seen.add(j)]
        least.append(min((rows[j][0] for j in seen if rows[j][0] is not None), default=None))
    got = answers(spark, folder, "op8_ngram_join")
    assert ordered((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got) == ordered((r[0], len(s), c, len(x)) for r, s, c, x in zip(rows, sets, least, near))


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_empty_tables(spark, folder, tmp_path, name):
    for t in ("documents", "labels", "benchmark"):
        table(spark, folder, t).limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert queries.queries()[name](spark, str(tmp_path)).count() == 0


def test_stages_on_odd_rows(spark, folder):
    """Every stage keeps all columns whatever their names, copes with the odd rows, and gives nothing for nothing."""
    docs = table(spark, folder, "documents")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.columns == ([c for c in docs.columns if c != "ids"] + ["ids"] if name == "bpe_codec" else docs.columns)
        found = out.collect()
        assert all(r[c] == c for r in found for c in EXTRA if c != "ids"), name
        texts = {r.text for r in docs.collect()}
        kept = {r.text for r in found}
        lost = {
            "toxicity": {t for t in texts if t and any(w in t for w in RUDE)}, "exact_dedup": set(), "bpe_codec": set(),
            "ngram_join": None, "decontamination": {t for t in texts if t and ("w1 w2 w3 w4 w5" in t or t == "no id here")},
        }[name]
        if name == "exact_dedup":
            assert len(found) == len({t or "" for t in texts})
        elif lost is not None:
            assert texts - kept == lost
        assert stage(spark, docs.limit(0), folder).count() == 0
