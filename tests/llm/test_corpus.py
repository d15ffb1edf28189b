"""Corpus operators against brute force, round trips and edge cases: nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillon.llm import bpe_codec, components, decontam, exact_dedup, language_id, linear, ngram_join, quality, sharding, token_counts, token_store, tokenizer_files, toxicity
from quillon.llm.bytescan import NOT_SPACE, runs, scan

BYTE = tokenizer_files.path("byte_bpe_50k.json")
WORD = tokenizer_files.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
HARD = ["", None, " ", "a", "ΣΑΣ ΟΔΟΣ", "İstanbul", "it's we'll 've 'S", "x" * 3000, "a\tb\r\n\n c ", "<|endoftext|>", "a<|endoftext|>b", "é é ́x", "日本語の文 12345", "  lead", "tail  ", " \x85\x1c\x1fz", "🙂👍🏽 ok", "don't!!! stop,...", "K Å ﬁ", "a  b   c\n\n\nd"]


def docs(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", "s", 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


# Exact dedup


def brute_groups(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    return {(i, t or ""): (max((x for x in groups[t or ""] if x is not None), default=None), len(groups[t or ""])) for i, t in rows}


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_exact_dedup_is_brute_force(spark, block):
    rng = random.Random(1)
    texts = [rng.choice(["", None, "a", "ab", "abc", "abcd", "abab", "éé", "é" * 50, "x" * 9000, "ab" * 20]) for _ in range(60)]
    ids = [*range(56), 7, 7, None, None]
    want = brute_groups([*zip(ids, texts)])
    out = exact_dedup.exact_groups(docs(spark, texts, ids), block).collect()
    assert len(out) == 60
    sha = {hashlib.sha256(t.encode()).hexdigest(): t for _, t in want}
    kept = defaultdict(int)
    for r in out:
        t = sha[r.text_sha256]
        assert (r.keep_id, r.group_size) == want[r.doc_id, t]
        kept[t] += r.kept
    assert set(kept.values()) == {1}
    left = exact_dedup.drop_copies(docs(spark, texts, ids), block).collect()
    assert sorted(hashlib.sha256((r.text or "").encode()).hexdigest() for r in left) == sorted(sha)


def test_names_do_not_rest_on_hashes(spark):
    texts = [f"{a}{b}" for a in "abcd" for b in "abcd"] + ["aa", "dd"]
    weak = lambda block: F.octet_length(block).cast("long")
    out = exact_dedup.exact_groups(docs(spark, texts), 1, weak).collect()
    assert sorted(r.group_size for r in out) == [1] * 14 + [2] * 4


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup.exact_groups(docs(spark, [])).count() == 0
    assert exact_dedup.drop_copies(docs(spark, [])).count() == 0


# Sharding


def test_schedule_is_longest_first():
    assert sharding.schedule([("a", 7), ("b", 5), ("c", 4), ("d", 3)], 2) == {"a": 0, "b": 1, "c": 1, "d": 0}


def test_sizes_are_scheduled_as_items():
    """Counting picks of one size gives each shard as many items of each size as picking one by one."""
    rng = random.Random(9)
    for _ in range(200):
        shards, items = rng.randint(1, 7), []
        for size in rng.sample(range(1, 60), rng.randint(0, 6)):
            items += [(f"{size}-{k:04}", size) for k in range(rng.choice([1, 2, 5, 40, 300]))]
        placed = sharding.schedule(items, shards)
        sizes = sorted({s: sum(x == s for _, x in items) for _, s in items}.items(), reverse=True)
        for (size, _), given in zip(sizes, sharding.schedule_sizes(sizes, shards)):
            assert given == [sum(placed[n] == k for n, x in items if x == size) for k in range(shards)]


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_shards_are_those_of_the_schedule(spark, monkeypatch, broadcast):
    """Brute force over all groups, one of which holds a third of all rows, with null and repeated ids."""
    monkeypatch.setattr(sharding, "BROADCAST_SIZES", broadcast)
    monkeypatch.setattr(sharding, "BROADCAST_RUNS", broadcast)
    rng = random.Random(2)
    texts = [rng.choice(["same" * 9, "", None]) if rng.random() < 0.4 else "tü"[rng.randint(0, 1)] * rng.randint(1, 40) + str(i % 700) for i in range(900)] + ["x" * 70_000]
    ids = [None if i % 97 == 5 else 7 if i % 31 == 0 else i for i in range(len(texts))]
    out = sharding.assign(docs(spark, texts, ids).withColumn("shard", F.lit("x")).withColumn("place", F.lit(1)), 4).collect()
    size = lambda t: len((t or "").encode()) + 1
    want = sorted((i is not None, i or 0, size(t), zlib.crc32((t or "").encode())) for i, t in zip(ids, texts))
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.size, r.text_crc32) for r in out) == want
    groups = defaultdict(int)
    for t in texts:
        groups[t or ""] += size(t)
    placed = sharding.schedule([*groups.items()], 4)
    by_crc, loads, slot = {zlib.crc32(t.encode()): t for t in groups}, defaultdict(int), defaultdict(list)
    shard = defaultdict(set)
    for r in out:
        shard[by_crc[r.text_crc32]].add(r.shard)
        loads[r.shard] += r.size
        slot[r.shard].append((r.slot, r.doc_id))
    assert all(len(s) == 1 for s in shard.values())
    # Groups of one size may change places; nothing else may.
    for n in set(groups.values()):
        assert sorted(next(iter(shard[t])) for t in groups if groups[t] == n) == sorted(placed[t] for t in groups if groups[t] == n)
    assert loads == {k: sum(groups[t] for t in groups if placed[t] == k) for k in range(4)}
    for rows in slot.values():
        ordered = sorted(rows, key=lambda r: r[0])
        assert [s for s, _ in ordered] == [*range(len(rows))]
        assert [d for _, d in ordered] == sorted((d for _, d in rows), key=lambda d: (d is not None, d or 0))
    assert sharding.assign(docs(spark, [])).count() == 0
    assert sorted(r.slot for r in sharding.assign(docs(spark, ["a", "a"], [None, None])).collect()) == [0, 1]


# Tokens


def test_heap_merging_is_plain_merging():
    ranks = {(0, 1): (0, 4), (4, 2): (1, 5), (1, 2): (2, 6), (0, 0): (3, 7), (7, 7): (4, 8)}

    def plain(s):
        n = 0
        while pairs := [(ranks[p][0], i) for i, p in enumerate(zip(s, s[1:])) if p in ranks]:
            _, i = min(pairs)
            s[i : i + 2] = [ranks[s[i], s[i + 1]][1]]
            n += 1
        return n

    rng = random.Random(4)
    for _ in range(300):
        s = [rng.randint(0, 2) for _ in range(rng.randint(1, 14))]
        assert token_counts.merges_of(s[:], ranks) == plain(s[:])


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'\"abcdeSTЖéßΣσςİ0129²½,.!<|>endoftextstart日本🙂́̀\x85\x1c \xa0"), st.characters(exclude_categories=["Cs", "Cn", "Co"])), max_size=60))
def test_counts_and_words_are_the_librarys(text):
    for t in (text, text + "<|endoftext|>" + text):
        ids = tokenizer_files.load(WORD).encode(t, add_special_tokens=False).ids
        assert token_counts.count_batch(pa.array([t]), WORD).tolist() == [len(ids)]
        assert token_store.ids_of(pa.array([t]), WORD, 2)[0].tolist() == [*ids, 2]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'abcdestSTé0129,.!<|>endoftext日本🙂́\xa0"), st.characters(exclude_categories=["Cs"])), max_size=120), st.integers(1, 40))
def test_tree_concatenation_is_the_librarys(text, leaf):
    for t in (text, text + "<|endoftext|>" + text, text * 3):
        ids = tokenizer_files.load(BYTE).encode(t, add_special_tokens=False).ids
        own = bpe_codec.codec(BYTE, leaf).encode([t])[0]
        assert own.tolist() == ids and bpe_codec.codec(BYTE, leaf).decode(own) == t


@pytest.mark.parametrize("text", ["a" * 5000, "ab1" * 3000, " " * 4000, "\n" * 999 + "x", "日" * 3000, "é" * 2001, "''s" * 900, "<|endoftext|>" * 300, "=" * 777 + " " * 777 + "q"])
def test_long_unsplit_texts(text):
    ids = tokenizer_files.load(BYTE).encode(text, add_special_tokens=False).ids
    for leaf in (50, 333, 8192):
        assert bpe_codec.codec(BYTE, leaf).encode([text])[0].tolist() == ids


def test_token_queries_on_hard_texts(spark):
    byte, word = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)
    rows = docs(spark, HARD)
    for r in bpe_codec.digests(rows, BYTE, 16).collect():
        t = HARD[r.doc_id] or ""
        ids = byte.encode(t, add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(byte.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    for r in token_counts.token_counts(rows, WORD, 5).collect():
        t = HARD[r.doc_id] or ""
        n = len(word.encode(t, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 5)
    kept = bpe_codec.encode_documents(rows.withColumn("ids", F.lit(1)), BYTE).collect()
    assert [len(r.ids) for r in kept] == [len(byte.encode(t or "", add_special_tokens=False).ids) for t in HARD] and kept[1].text is None
    assert bpe_codec.digests(rows.limit(0), BYTE).count() == token_counts.token_counts(rows.limit(0), WORD).count() == 0


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_planes_round_trip(planes):
    for n in (0, 1, 7, 8, 1000):
        ids = np.random.default_rng(n).integers(0, 2**32, n, np.uint32)
        assert token_store.unpack(*token_store.pack(ids, planes, block=64), planes).tolist() == ids.tolist()


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_token_store(spark, tmp_path, planes):
    word = Tokenizer.from_file(WORD)
    ids = [5, 5, None, *range(100, 100 + len(HARD) - 3)]
    path = f"{tmp_path}/{planes}"
    token_store.write_ids(docs(spark, HARD, ids), WORD, path, planes=planes, partitions=3)
    rows = token_store.read_ids(spark, path).collect()
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at and r.n_tokens * 4 == len(r.ids)
        at += r.n_tokens
    assert [r.doc_id for r in sorted(rows, key=lambda r: r.start)] == [None, 5, 5, *range(100, 100 + len(HARD) - 3)]
    want = sorted(tuple([*word.encode(t or "", add_special_tokens=False).ids, 2]) for t in HARD)
    assert sorted(tuple(np.frombuffer(r.ids, "<u4").tolist()) for r in rows) == want
    token_store.write_ids(docs(spark, []), WORD, f"{path}-none")
    assert token_store.read_ids(spark, f"{path}-none").count() == 0


# Scanning and n-gram join


def brute_sets(texts, words):
    out = []
    for t in texts:
        w = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        out.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    return out


def brute_components(texts, ids, words, num, den):
    sets, label = brute_sets(texts, words), [*range(len(texts))]
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    least = {}
    for x, i in zip(label, ids):
        least[x] = min(least.get(x, i), i)
    return [(i, len(s), least[x]) for i, s, x in zip(ids, sets, label)]


def near_copies(seed, families, size=(5, 90), copies=6):
    rng, out = random.Random(seed), []
    common = [f"c{k}" for k in range(30)]
    for f in range(families):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(*size))]
        for _ in range(rng.randint(1, copies)):
            w = base[:]
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
                k = rng.randrange(len(w))
                w[k : k + rng.randint(0, 1)] = [f"n{rng.randint(0, 9)}"] if rng.random() < 0.7 else []
                w = w or ["z"]
            if rng.random() < 0.3:
                w += common
            out.append(" ".join(w).upper() if rng.random() < 0.2 else " ".join(w))
    return out


@pytest.mark.parametrize("words, num, den, block", [(3, 90, 100, 10**6), (5, 80, 100, 10**6), (1, 50, 100, 10**6), (3, 90, 100, 60), (5, 80, 100, 60)])
def test_ngram_join_is_brute_force(spark, words, num, den, block):
    texts = [*near_copies(words, 60), "", None, " \n", "one", "One", "one two", "a b c", "a  b\tc", "é é", "x " * 500, "x " * 501]
    rng = random.Random(5)
    ids = rng.sample(range(10_000), len(texts))
    got = ngram_join.near_groups(docs(spark, texts, ids), ngram_join.Rule(words, num, den), block).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute_components(texts, ids, words, num, den))


@pytest.mark.parametrize("num, den", [(90, 100), (80, 100), (50, 100)])
def test_linked_sets_share_a_part(num, den):
    """No link is lost: sets at the very threshold show a common part, with and without frequent shingles."""
    rule, rng = ngram_join.Rule(1, num, den), np.random.default_rng(num)
    starts, most = rule.tiles(700)
    for _ in range(400):
        a = int(rng.integers(1, 500))
        b = int(rng.integers(a, den * a // num + 1))
        o = int(rule.need(a + b))
        if o > a:
            continue
        pool = rng.integers(0, 2**64, a + b - o, np.uint64)
        sets = [np.unique(pool[:a]), np.unique(np.concatenate([pool[:o], pool[a:]]))]
        if [len(s) for s in sets] != [a, b]:
            continue
        flat, at = np.concatenate(sets), np.array([0, a, a + b])
        s = ngram_join.Sets(flat, at, np.zeros(2, np.uint64), np.zeros(2, np.uint64))
        if a == b == o:
            continue
        for frequent in (np.zeros(0, np.uint64), np.sort(rng.choice(pool, len(pool) // 2))):
            shown = [set(), set()]
            for tile in (-1, 0):
                owner, value = ngram_join.parts_of(s, np.full(2, tile), most, starts, frequent)
                for k in (0, 1):
                    shown[k].update(value[owner == k].tolist())
            assert shown[0] & shown[1], (a, b, o)


def test_ngram_join_edges(spark):
    rule = ngram_join.Rule(3, 90, 100)
    assert ngram_join.near_groups(docs(spark, []), rule).count() == 0
    got = ngram_join.near_groups(docs(spark, ["", None, "  "]), rule).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(0, 0, 0), (1, 0, 1), (2, 0, 2)]
    rows = docs(spark, ["a b c d", "A b c d", "a b c d", "q r s"], [None, 4, 4, None])
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in ngram_join.near_groups(rows, rule).collect()) == [(-1, -1), (-1, 4), (4, 4), (4, 4)]
    two = docs(spark, ["k " + " ".join(map(str, range(60))), "other text with this id", "j " + " ".join(map(str, range(60)))], [1, 1, 2])
    assert sorted((r.doc_id, r.component_id) for r in ngram_join.near_groups(two, rule).collect()) == [(1, 1), (1, 1), (2, 1)]


def test_one_of_each_keeps_clean_rows(spark):
    texts = [" ".join(f"w{i}" for i in range(40)), " ".join(f"w{i}" for i in range(41)), "quite another text of some words", "", None]
    left = ngram_join.one_of_each(docs(spark, texts).withColumn("component_id", F.lit("x")))
    assert sorted(r.doc_id for r in left.collect()) == [0, 2, 3, 4] and left.first().component_id == "x"


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(120)] + [(i, i + 1) for i in range(1000, 1060)]
    label = {x: x for e in edges for x in e}
    for a, b in edges:
        x, y = sorted((label[a], label[b]))
        label = {k: x if v == y else v for k, v in label.items()}
    want = {k: v for k, v in label.items() if any(a != b and k in (a, b) for a, b in edges)}
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == want and len(got) == len(want)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_scan_finds_the_words():
    texts = [t or "" for t in HARD] + ["", "ends", "", ""]
    w = scan(pa.array(texts), NOT_SPACE)
    for i, t in enumerate(texts):
        want = [x.lower() if x.isascii() else re.sub(rb"[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(rb"[^\x20\x09-\x0d]+", t.encode())]
        assert [w.text(k) for k in range(w.at[i], w.at[i + 1])] == want
    same = scan(pa.array(["ab cd ab", "xx ab", None]), NOT_SPACE)
    assert same.hash[0] == same.hash[2] == same.hash[4] != same.hash[1] and same.at.tolist() == [0, 3, 5, 5]
    assert len(runs(same.hash, 3)) == 3 and len(runs(same.hash[:2], 3)) == 0


# Decontamination


def brute_hits(texts, items, n):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - n + 1)) if w else ():
            windows[tuple(w[k : k + n])].add(i)
    out = []
    for t in texts:
        w, hit, found = words(t), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if (key := tuple(w[k : k + size])) in windows:
                    hit.update(range(k, k + size))
                    found |= windows[key]
        out.append((len(w), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("most", [10**6, 5])
def test_hits_are_brute_force(spark, most):
    rng = random.Random(7)
    items = [(i, " ".join(rng.choice("abcde") for _ in range(rng.randint(0, 9)))) for i in range(12)] + [(3, "Ünï-code ÉE"), (99, None)]
    texts = [" ".join(rng.choice("abcdeABC") + rng.choice(["", ",", "\n"]) for _ in range(rng.randint(0, 60))) for _ in range(80)] + ["", None, "ünï code ÉE!", "x" * 5000]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontam.find_hits(docs(spark, texts), bench, 4, most).collect()}
    for i, (n, hit, found) in enumerate(brute_hits(texts, items, 4)):
        assert (got[i].n_words, sum(s["last"] - s["first"] for s in got[i].spans), got[i].item_ids) == (n, hit, found)
    left = {r.doc_id for r in decontam.without_documents(docs(spark, texts).withColumn("spans", F.lit(1)), bench, 4, most).collect()}
    assert left == {i for i in got if not got[i].spans}
    cut = {r.doc_id: r.text for r in decontam.without_spans(docs(spark, texts), bench, 4, most).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        for s in reversed(got[i].spans):
            data = data[: s["begin"]] + data[s["end"] :]
        assert (cut[i] or "") == data.decode()


def test_no_items_and_no_documents(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.find_hits(docs(spark, ["a b"]), none).first().n_words == 2
    assert decontam.find_hits(docs(spark, []), none).count() == 0
    odd = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b")], "item_id long, text string")
    assert decontam.find_hits(docs(spark, ["x a b"]), odd).first().item_ids == [1]


# Classifiers


def labelled(spark, n=300):
    rng = random.Random(8)
    bad = ["idjit", "skum", "morron", "wurst"]
    rows, marks = [], []
    for i in range(n):
        w = [f"w{rng.randint(0, 300)}" for _ in range(rng.randint(8, 60))]
        toxic = rng.random() < 0.25
        for _ in range(rng.randint(2, 4) if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        junk = rng.random() < 0.3
        rows.append((i, " ".join(w).upper().replace(" ", "!! ") if junk else " ".join(w), "en", f"host{i % 5}", 0))
        marks.append((i, int(not junk), int(toxic)))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(spark):
    rows, marks = labelled(spark)
    seen = marks.filter("doc_id % 3 <> 0").unionByName(spark.createDataFrame([(None, 1, 1), (1, None, None)], marks.schema))
    told = {r.doc_id: r.toxic for r in toxicity.classify(rows, seen).collect()}
    truth = {r.doc_id: r.toxic for r in marks.collect()}
    assert sum(told[i] == bool(truth[i]) for i in truth if i % 3 == 0) >= 97
    assert {r.doc_id for r in toxicity.without_toxic(rows.withColumn("p_toxic", F.lit("x")), seen).collect()} == {i for i in told if not told[i]}


def test_toxicity_edges(spark):
    rows, marks = labelled(spark, 60)
    assert toxicity.classify(rows, marks.limit(0)).filter("toxic").count() == 0
    assert toxicity.classify(rows.limit(0), marks).count() == 0
    assert toxicity.classify(docs(spark, HARD), marks.filter("toxic = 0")).filter("kept").count() == len(HARD)


def test_quality_on_held_out_rows(spark):
    rows, marks = labelled(spark)
    out = {r.doc_id: r for r in quality.score(rows, marks.filter("doc_id % 3 <> 0"), F.col("source"), F.col("lang")).collect()}
    truth = {r.doc_id: r.quality for r in marks.collect()}
    assert sum(out[i].kept == bool(truth[i]) for i in truth if i % 3 == 0) >= 97 and len(out) == 300
    assert quality.score(rows.limit(0), marks, F.col("source"), F.col("lang")).count() == 0
    hard = quality.score(docs(spark, HARD, [None] * len(HARD)), marks.limit(0), F.lit(None).cast("string"), F.col("lang"))
    assert hard.count() == len(HARD) and hard.filter("quality is null or isnan(quality)").count() == 0


def test_sparse_sites_are_shrunk_more(spark):
    rows, marks = labelled(spark)
    skewed = rows.withColumn("source", F.when(F.upper("text") == F.col("text"), F.when(F.col("doc_id") == 5, "rare").otherwise("bad")).otherwise("good"))
    sites = {r.host: r.host_rate for r in quality.score(skewed, marks, F.col("source"), F.col("lang")).collect()}
    assert sites["bad"] < 0.2 < 0.8 < sites["good"]


def test_logistic_regression():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(500, 3))
    y = (x @ [2, -1, 0] + 0.5 + rng.logistic(size=500) > 0).astype(float)
    w = linear.fit(x, y)
    gradient = np.hstack([x, np.ones((500, 1))]).T @ (linear.predict(x, w) - y) + np.r_[w[:-1], 0]
    assert np.abs(gradient).max() < 1e-3 and w[0] > 1 and w[1] < 0
    assert linear.fit(np.zeros((0, 2)), np.zeros(0)).tolist() == [0, 0, 0]


def slow_vector(text):
    letters = re.sub(r"[^a-zéß]+", "\0", "\0" + text.lower() + "\0")
    total = np.zeros(language_id.DIMENSIONS)
    for k in range(len(letters) - 2):
        g = letters[k : k + 3]
        if "\0\0" not in g:
            v = np.ones(language_id.DIMENSIONS)
            for j, c in enumerate(g):
                v = v * np.roll(language_id.letter_vector(0 if c == "\0" else ord(c)), 2 - j)
            total += v
    return total


def test_bundles_are_brute_force(monkeypatch):
    texts = ["The cat, the hat", "", "  ", "é", "Straße und é", "a b", "a", "12 x", "3", "x."]
    want = np.stack([slow_vector(t) for t in texts])
    assert np.array_equal(language_id.vectors(texts), want) and [bool(v.any()) for v in want] == [any(c.isalpha() for c in t) for t in texts]
    monkeypatch.setattr(language_id, "COLUMNS", 3)
    assert np.array_equal(language_id.vectors(texts), want)


def test_prototypes_are_brute_force(spark):
    rows = [(1, "the cat", "en"), (2, "der hut", "de"), (2, "der hut", "de"), (3, "a hat, a", "en"), (4, "x", None), (None, "no id", "en"), (5, None, "de"), (6, "12", "es"), (2, "die katze", "de")]
    table = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, share string")
    unit = lambda v: v / np.linalg.norm(v)
    want = {"en": unit(unit(slow_vector("the cat")) + unit(slow_vector("a hat, a"))), "de": unit(unit(slow_vector("der hut")) + unit(slow_vector("die katze")))}
    made = language_id.train(table)
    assert made.keys() == want.keys() and all(np.allclose(made[k], want[k], atol=1e-6) for k in want)
    told = language_id.identify(table, made).collect()
    assert len(told) == len(rows)
    by_text = {t: max((float(unit(slow_vector(t)) @ want[k]), k) for k in want) for _, t, _ in rows if t and any(c.isalpha() for c in t)}
    got = {t: next(r for r in language_id.identify(table.filter(F.col("text") == t), made).collect()) for t in by_text}
    assert all(got[t].lang_pred == lang and abs(got[t].score - max(0, cosine)) < 1e-5 for t, (cosine, lang) in by_text.items())
    with pytest.raises(ValueError):
        few, language_id.MAX_LANGS = language_id.MAX_LANGS, 1
        try:
            language_id.train(table)
        finally:
            language_id.MAX_LANGS = few


def test_languages(spark):
    rng = random.Random(10)
    make = {"en": ["the", "and", "with", "thing", "which"], "de": ["und", "schön", "nicht", "über", "straße"], "es": ["que", "los", "ción", "niño", "para"]}
    rows = [(i, " ".join(rng.choice(make[lang]) for _ in range(30)), lang if i % 4 else None, "s", 0) for i, lang in enumerate([*make] * 60)]
    rows += [(1000, "", "en", "s", 0), (1001, None, "de", "s", 0), (1002, "123 !", "es", "s", 0), (None, "the and with", None, "s", 0)]
    table = spark.createDataFrame(rows, DOCS)
    out = language_id.identify(table, language_id.train(table.filter(~language_id.held_out(F.col("doc_id")))))
    for r in out.collect():
        want = {1000: "und", 1001: "und", 1002: "und", None: "en"}.get(r.doc_id) or ["en", "de", "es"][r.doc_id % 3]
        assert r.lang_pred == want and 0 <= r.score <= 1
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    assert language_id.identify(table.limit(2), {}).filter("lang_pred = 'und' and score = 0").count() == 2
    assert language_id.identify(table.limit(0), {}).count() == 0 and language_id.train(table.limit(0)) == {}
