import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import chunks as C
from quillon.operators import collate, gather, split, strikes, vectors
from quillon.operators.decide import SCHEMAS, Live, Recorded, Rules, _parts, input_hash
from quillon.plans import compare, extract, form_check, report, self_rag
from quillon.sources import blocks as B
from quillon.sources import files
from quillon.streaming import ingest


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize("text", ["Interest Rate", "GENERAL TERMS", "1. scope of", "one two", "Ends here.", "A b", "42", "Élan Vital", "x" * 3, "A " * 13])
def test_heading_style_is_pythons(spark, text):
    words = text.split()
    import re

    want = len(words) <= 12 and not text.endswith(".") and (text.istitle() or text.isupper() or bool(re.match(r"^\d+[\.\)]\s+\w", text)))
    assert one(spark, T.looks_like_heading("t"), t=text) == want


@pytest.mark.parametrize("text, level, other", [("1. A", 1, 1), ("1.1 A", 2, 2), ("1.1.1. A", 3, 3), ("Terms", 0, 1), ("1.", 0, 1), ("2024 Report", 1, 1)])
def test_levels(spark, text, level, other):
    assert (one(spark, T.numbered_level("t"), t=text), one(spark, T.any_level("t"), t=text)) == (level, other)


@pytest.mark.parametrize("text, label", [("SECTION A", True), ("Part 1", True), ("12345", True), ("LTV", False), ("LOAN: X", False), ("Loan", False)])
def test_section_labels(spark, text, label):
    assert one(spark, T.is_section_label("t"), t=text) == label


def test_small_functions(spark):
    assert one(spark, T.base_heading("t"), t="1. A (part 2) ") == "1. A"
    assert one(spark, T.base_key("t"), t="3.3 [1/3]") == "3.3"
    assert one(spark, T.truncated("t", 5), t=" ab\ncd ef") == "ab cd…"
    assert one(spark, T.topic(F.lit("3.1"), F.col("t")), t="3.1 Interest Rate\nx") == "Interest Rate"
    assert one(spark, T.topic(F.lit("preamble"), F.col("t")), t="x") == "Agreement Parties Preamble"
    assert one(spark, T.page_label("t"), t=0) == "—"
    assert one(spark, T.first_int("t"), t="take 12 or 3") == 12
    assert one(spark, T.int_list("t", 2), t="3, 1, 3, 2") == [3, 1]
    assert one(spark, T.page_list(F.col("t"), F.array(F.lit(2), F.lit(3))), t="2, 9,x,3") == [2, 3]
    assert one(spark, T.term_list("t"), t='so: ["A", "B"]') == ["A", "B"]
    assert one(spark, T.term_list("t"), t="A, B\nC") == ["A", "B", "C"]
    assert one(spark, T.first_line("t"), t="a b") == "a"
    assert one(spark, F.struct(*T.named_prefix("t")), t="Schedule 2 Rates (part 1)") == ("schedule", "2")


def chunk_rows(spark, *heads):
    return spark.createDataFrame([(0, i, h, f"c{i}", [i + 1], i + 1) for i, h in enumerate(heads)], "doc_id long, chunk_id int, heading string, content string, pages array<int>, start_page int")


def ids(df):
    return sorted(r.chunk_id for r in df.collect())


def at(spark, k):
    return spark.createDataFrame([(0, k)], "doc_id long, anchor_id int")


@pytest.mark.parametrize("heads, anchor, v2, v1", [
    (("1. A", "1.1 B", "note", "2. C"), 0, [0, 1, 2], [0, 1, 2]),
    (("1.1 B (part 1)", "1.1 B (part 2)", "1.2 C"), 1, [0, 1], [0, 1]),
    (("1. A", "1.1 B", "2. C"), 1, [1], [1]),
    (("1. A", "1.1 B", "1.2 C"), 0, [0, 1, 2], [0, 1, 2]),
    (("1.1 X", "1. A", "2. B"), 1, [1], [0, 1]),
    (("Schedule 1 A", "body", "Part 1 B", "Schedule 2 C"), 0, [0, 1, 2], [0]),
    (("Notes", "1. A", "Notes (part 2)"), 0, [0, 2], [0, 2]),
])
def test_gather(spark, heads, anchor, v2, v1):
    rows = chunk_rows(spark, *heads)
    assert ids(gather.gather_full_section(rows, at(spark, anchor))) == v2
    assert ids(gather.gather_full_section(rows, at(spark, anchor), version=1)) == v1


def test_merge_and_walk(spark):
    rows = chunk_rows(spark, "1. A (part 1)", "1. A (part 2)", "1.1 B", "x", "2. C")
    merged = gather.merge_chunks(gather.gather_full_section(rows, at(spark, 0))).first()
    assert merged.content == "c0\nc1\n\n1.1 B\nc2\n\nx\nc3" and merged.pages == [1, 2, 3, 4] and merged.heading == "1. A"
    assert ids(gather.walk_from_anchor(rows, at(spark, 0))) == [0, 1, 2]
    named = rows.withColumn("parent_heading", T.base_heading("heading"))
    assert ids(gather.search_section(named, at(spark, 1))) == [0, 1, 2]
    assert gather.assemble_search(gather.search_section(named, at(spark, 1))).first().chunk_ids == [0, 1, 2]


def test_font_chunks(spark):
    blocks = spark.createDataFrame([(0, 0, 1, "lead", 10.0, False), (0, 1, 1, "Head", 14.0, False), (0, 2, 2, "body", 10.0, False), (0, 3, 2, "Bold", 10.0, True), (1, 0, 1, "a", 0.0, True)], "doc_id long, seq int, page int, text string, font_size double, is_bold boolean")
    rows = C.chunk_by_section(C.detect_headings(blocks)).orderBy("doc_id", "chunk_id").collect()
    assert [(r.doc_id, r.heading, r.content, r.pages) for r in rows] == [(0, "", "lead", [1]), (0, "Head", "body", [1, 2]), (0, "Bold", "", [2]), (1, "", "a", [1])]


@pytest.mark.parametrize("pages, gone", [([1, 2], [1, 2]), ([1, 9], []), ([1, 2, 3, 4, 5, 6], []), ([], [])])
def test_contents_must_be_plausible(spark, pages, gone):
    blocks = spark.createDataFrame([(0, i, i, "t") for i in range(1, 11)], "doc_id long, seq int, page int, text string")
    left = C.drop_toc_blocks(blocks, spark.createDataFrame([(0, p) for p in pages], "doc_id long, page int"))
    assert sorted(r.page for r in left.collect()) == [i for i in range(1, 11) if i not in gone]


@pytest.mark.parametrize("text", ["word " * 5000, "a " * 6000, "b " * 8000, " ".join(map(str, range(500))), "x" * 30000, "p\n\nq" * 4000, ""])
@pytest.mark.parametrize("separators", [split.DEFAULT_SEPARATORS, split.SENTENCE_SEPARATORS])
def test_splitter(text, separators):
    pieces = split.Splitter(1000, 100, separators).split(text)
    assert all(0 < len(p) <= 1000 for p in pieces) and (bool(pieces) == bool(text.strip()))
    assert set("".join(text.split())) == set("".join("".join(pieces).split()))


def test_pieces_follow_and_overlap():
    words = [f"w{i}" for i in range(500)]
    pieces = [p.split() for p in split.Splitter(200, 50).split(" ".join(words))]
    seen = []
    for p in pieces:
        begin = words.index(p[0])
        assert p == words[begin : begin + len(p)] and begin <= len(seen)
        assert not seen or begin < len(seen)
        seen = words[: begin + len(p)]
    assert seen == words


def test_chunk_keys(spark):
    rows = spark.createDataFrame([(0, "1", 0, "short"), (0, "2", 1, "word " * 100)], "doc_id long, key string, ord int, text string")
    keys = [r.key for r in split.chunk_sections(rows, 200, 20).orderBy("ord", "piece").collect()]
    assert keys[0] == "1" and keys[1] == f"2 [1/{len(keys) - 1}]"


def test_oversized_chunks(spark):
    rows = chunk_rows(spark, "A", "B").withColumn("content", F.when(F.col("chunk_id") == 0, F.repeat(F.lit("One. "), 100)).otherwise("x"))
    out = split.split_oversized_chunks(rows, 120, 10).orderBy("chunk_id").collect()
    assert [r.chunk_id for r in out] == list(range(len(out))) and out[0].heading == "A (part 1)" and out[-1].heading == "B"


def store(spark, *vecs):
    return spark.createDataFrame([(i, v) for i, v in enumerate(vecs)], "key long, vector array<double>")


def queries(spark, *vecs):
    return spark.createDataFrame([(i, v) for i, v in enumerate(vecs)], "query_id long, vector array<double>")


def test_top_k(spark):
    rows = store(spark, [1.0, 0.0], [0.0, 1.0], [1.0, 1.0], [2.0, 0.0], [0.0, 0.0], None)
    got = [(r.key, r.score) for r in vectors.top_k(rows, queries(spark, [1.0, 0.0]), 3).orderBy("rank").collect()]
    assert got == [(0, 1.0), (3, 1.0), (2, 0.707107)]
    assert vectors.top_k(rows, queries(spark, [1.0, 0.0]), 99).count() == 5
    assert vectors.top_k(rows.limit(0), queries(spark, [1.0, 0.0]), 3).count() == 0
    assert vectors.top_k(rows, queries(spark), 3).count() == 0


def test_more_queries_than_a_block(spark, monkeypatch):
    rows = store(spark, *[[float(i), 1.0] for i in range(9)])
    want = vectors.top_k(rows, rows.withColumnRenamed("key", "query_id"), 2).collect()
    monkeypatch.setattr(vectors, "QUERY_NUMBERS", 6)
    assert sorted(vectors.top_k(rows, rows.withColumnRenamed("key", "query_id"), 2).collect()) == sorted(want)


def test_dedup_of_hits(spark):
    hits = spark.createDataFrame([(0, "3.3 [1/3]", .75, 2), (0, "3.3 [2/3]", .92, 1), (0, "3.3 [3/3]", .6, 3), (0, "4", .7, 4)], "query_id int, key string, score double, rank int")
    assert [r.key for r in vectors.deduplicate_with_score(hits).orderBy("rank").collect()] == ["3.3 [2/3]", "4"]
    assert sorted(r.key for r in vectors.deduplicate(hits).collect()) == ["3.3 [2/3]", "4"]


def test_heading_matches_do_not_lift(spark):
    chunks = spark.createDataFrame([(0, "Fees"), (1, "Other fees")], "chunk_id int, heading string")
    terms = spark.createDataFrame([(0, "FEES")], "query_id int, term string")
    hits = spark.createDataFrame([(0, 0, .4)], "query_id int, chunk_id int, score double")
    got = vectors.with_heading_matches(hits, vectors.heading_matches(chunks, terms)).collect()
    assert sorted((r.chunk_id, r.score) for r in got) == [(0, .4), (1, 1.0)]


def test_boost_and_collation(spark):
    terms = spark.createDataFrame([(0, "a"), (1, "b")], "query_id int, term string")
    hits = spark.createDataFrame([(0, 0, .5), (1, 0, .4), (0, 1, .6), (1, 2, .3)], "query_id int, chunk_id int, score double")
    ranked = collate.gather_relevant(hits, terms).orderBy("rank").collect()
    assert [(r.chunk_id, r.terms) for r in ranked] == [(0, ["a", "b"]), (1, ["a"])] and abs(ranked[0].score - .5 * 2 ** .5) < 1e-9
    text = collate.render(collate.collate(collate.gather_relevant(hits, terms), chunk_rows(spark, "X", "Y"))).first()
    assert text.sections == ["X", "Y"] and "Pages   : [1]" in text.combined_context


def test_candidates_and_verification(spark):
    tried = spark.createDataFrame([(0, 1, False), (0, 2, True), (0, 3, True), (1, 1, False), (1, 2, False)], "doc_id int, rank int, verified boolean")
    assert sorted((r.doc_id, r.rank) for r in vectors.first_verified(tried).collect()) == [(0, 2), (1, 2)]
    a = spark.createDataFrame([(0, 5, 1)], "doc_id int, chunk_id int, rank int")
    b = spark.createDataFrame([(0, 5, 2), (0, 4, 1)], "doc_id int, chunk_id int, rank int")
    assert [r.chunk_id for r in vectors.candidate_list(a, b).orderBy("rank").collect()] == [5, 4]


def test_strikes(spark):
    drawings = spark.createDataFrame([(0, 1, 0, 0.0, 4.0, 50.0, 5.0, [.9, .1, .1], None), (0, 1, 1, 0.0, 4.0, 50.0, 5.0, [.1, .1, .9], None), (0, 1, 2, 0.0, 40.0, 50.0, 41.0, None, [.9, .0, .0])], "doc_id int, page int, drawing_id int, x0 double, y0 double, x1 double, y1 double, color array<double>, fill array<double>")
    words = spark.createDataFrame([(0, 1, 5.0, 0.0, 20.0, 10.0, "w")], "doc_id int, page int, x0 double, y0 double, x1 double, y1 double, word string")
    lines = strikes.strike_lines(drawings, words)
    assert [r.drawing_id for r in lines.collect()] == [0]
    assert sorted(r.drawing_id for r in strikes.strike_lines(drawings, words, "any").collect()) == [0, 1]
    chars = spark.createDataFrame([(0, 1, 0, 5.0, 0.0, 10.0, 10.0, "a", 10.0, 0xFF0000), (0, 1, 1, 60.0, 0.0, 65.0, 10.0, "b", 10.0, 0), (0, 1, 2, 60.0, 30.0, 65.0, 40.0, "c", 10.0, 0)], "doc_id int, page int, seq int, x0 double, y0 double, x1 double, y1 double, c string, font_size double, span_color int")
    boxes = {r.kind: r for r in strikes.redactions(lines, chars).collect()}
    assert (boxes["text"].x0, boxes["text"].x1, boxes["text"].y0, boxes["text"].y1) == (5.0, 10.0, 4.5 - 8.5, 4.5 + 4.5)
    assert strikes.text_without_strikes(chars, lines).first().text == "b\nc"
    assert strikes.words_without_strikes(words, lines).count() == 0


def test_sources(spark):
    raw = spark.createDataFrame([(0, 0, 0, 0, " a "), (0, 0, 1, 1, "img"), (0, 1, 0, 0, " "), (0, 1, 1, 0, "b\nc " + "x" * 40)], "doc_id int, page_index int, block_no int, kind int, text string")
    assert [(r.seq, r.page, r.text[:3]) for r in B.extract_blocks(raw).orderBy("seq").collect()] == [(0, 1, "a"), (1, 2, "b\nc")]
    assert [r.text[:3] for r in B.load_paragraphs(raw).collect()] == ["b c"]
    cells = spark.createDataFrame([(0, 1, 0, 0, 0, "SECTION A"), (0, 1, 0, 0, 1, "x"), (0, 1, 0, 1, 0, "Rate"), (0, 1, 0, 1, 1, "5%"), (0, 1, 0, 2, 0, "Only")], "doc_id int, page int, table_no int, row_no int, col_no int, text string")
    assert [(r.name, r.value) for r in B.extract_form_fields(cells).collect()] == [("Rate", "5%")]
    paged = B.paged_paragraphs(spark.createDataFrame([(0, 0, "a" * 40, 0), (0, 1, "b" * 40, 1), (0, 2, "c", 1), (0, 3, "d" * 40, 0)], "doc_id int, seq int, text string, breaks int"))
    assert [r.page for r in paged.orderBy("seq").collect()] == [1, 2, 3]


def test_docx_and_json(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = '<w:p><w:r><w:t>One</w:t></w:r></w:p><w:p><w:r><w:br w:type="page"/><w:lastRenderedPageBreak/><w:t>Two</w:t></w:r></w:p>'
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    (tmp_path / "a.docx").write_bytes(buffer.getvalue())
    assert [(r.text, r.breaks) for r in files.read_docx(spark, str(tmp_path)).orderBy("seq").collect()] == [("One", 0), ("Two", 2)]
    (tmp_path / "s.json").write_text(json.dumps({"1": {"text": "a\n\"é", "page_numbers": [1, 2]}, "2": "plain"}))
    rows = B.load_sections_json(spark, f"{tmp_path}/s.json").orderBy("ord")
    assert [(r.key, r.text, r.page_numbers) for r in rows.collect()] == [("1", 'a\n"é', [1, 2]), ("2", "plain", [])]
    again = json.loads(files.keyed_json(rows).first().json)
    assert again["1"] == {"text": 'a\n"é', "page_numbers": [1, 2]} and list(again) == ["1", "2"]
    assert json.loads(files.keyed_json(rows.drop("page_numbers")).first().json) == {"1": 'a\n"é', "2": "plain"}
    got = files.read_pdf(spark, str(tmp_path / "s.json"), lambda data: [(1, 0, 0, 0, "t", 0.0, 0.0, 1.0, 1.0)])
    assert got.columns[0] == "doc_id"


def _struct(kind):
    return ", ".join(x.replace(" ", ":", 1) for x in _parts(SCHEMAS[kind]))


class Scripted(Rules):
    """Answers given beforehand; None is a failure."""

    def __init__(self, **answers):
        self.answers = answers

    def decide(self, rows, kind, inputs, out, where=None):
        if kind not in self.answers:
            return super().decide(rows, kind, inputs, out, where)
        answer = self.answers[kind]
        told = F.lit(None).cast(f"struct<{_struct(kind)}>") if answer is None else F.struct(*(F.lit(v).alias(k) for k, v in answer.items())).cast(f"struct<{_struct(kind)}>")
        return rows.withColumn(out, told if where is None else F.when(where, told))


def pages(spark):
    item = spark.createDataFrame([(1, 4, "new clause text of five words", [1.0, 0.0])], "item_no int, page int, content string, vector array<double>")
    base = spark.createDataFrame([(0, 2, "1. old clause text", [1.0, 0.1]), (1, 3, "other", [0.0, 1.0])], "key long, page int, content string, vector array<double>")
    return item, base


@pytest.mark.parametrize("answers, deviation, section, base", [
    ({"clause_match": {"needs_lookup": False}}, False, "N/A", ""),
    ({"clause_match": None}, False, "N/A", ""),
    ({"best_match": {"best_index": 0, "confidence": "Low"}}, False, "N/A", ""),
    ({"best_match": {"best_index": 7, "confidence": "High"}}, False, "N/A", ""),
    ({"deviation": None}, False, "N/A", "1. old clause text"),
    ({"deviation": {"has_deviation": False, "deviation_type": "none"}}, False, "1", "1. old clause text"),
    ({}, True, "1", "1. old clause text"),
    ({"targeted_context": {"snippet": " "}}, True, "1", "1. old clause text"),
    ({"section_label": None}, True, "N/A", "1. old clause text"),
    ({"grounding": {"grounded": False, "issues": "x"}}, True, "1", "1. old clause text"),
    ({"materiality": None}, True, "1", "1. old clause text"),
])
def test_comparison_branches(spark, answers, deviation, section, base):
    row = compare.compare_pages(*pages(spark), Scripted(**answers)).first()
    assert (row.deviation, row.section, row.base_paragraph) == (deviation, section, base)
    assert (row.comments is not None) == deviation
    if answers.get("materiality", 1) is None:
        assert (row.score, row.severity) == (0, "N/A")


def test_comparison_without_base(spark):
    item, base = pages(spark)
    out = compare.compare_pages(item, base.limit(0), Rules())
    assert out.count() == 1 and not out.first().deviation
    assert [r.page for r in compare.omitted_pages(base, compare.compare_pages(item, base, Rules())).collect()] == [3]
    assert compare.item_problems(compare.compare_pages(item, base, Rules())).count() == 0


def test_whole_comparison(spark):
    rows = "doc_id int, seq int, page int, section string, text string"
    base = spark.createDataFrame([(0, 0, 1, "A", "same"), (1, 0, 1, "A", "x" * 500)], rows)
    other = spark.createDataFrame([(0, 0, 1, "A", "same"), (0, 1, 2, "B", "new"), (1, 0, 1, "A", "y")], rows)
    got = {(r.doc_id, r.item_no): r for r in compare.compare_whole(base, other, Rules(), 120).collect()}
    assert got[0, 1].compare_paragraph == "new" and got[0, 1].section == "B" and got[0, 1].compare_page == 2
    assert "tokens" in got[1, None].problem and len(got) == 2
    assert compare.compare_whole(base, other, Scripted(whole_comparison=None)).filter("problem = 'the decision failed'").count() == 2


def test_pick_best(spark):
    rows = spark.createDataFrame([(0, 1, "A", "x"), (0, 2, "B", "fees"), (1, 1, "C", "x"), (1, 2, "D", "y")], "doc_id int, rank int, heading string, content string")
    assert sorted(r.heading for r in vectors.pick_best(rows, "Fees", Rules()).collect()) == ["B", "C"]


def test_reports(spark):
    items = compare.compare_pages(*pages(spark), Rules())
    text = report.comparison_report(items, "a.pdf", "b.docx").first().markdown
    assert "**Material deviations found:** 1" in text and "| 1 | 1 | p.2 | p.4 |" in text
    assert "1,234" in report.comparison_report(items, "a", "b", full=False, tokens_used=1234).first().markdown
    assert "_No clauses examined._" in report.comparison_report(items.limit(0), "a", "b").first().markdown


@pytest.mark.parametrize("score, want", [(0.45, True), (0.44, None)])
def test_form_threshold(spark, score, want):
    angle = [score, (1 - score * score) ** 0.5]
    fields = spark.createDataFrame([(0, "Rate", "5%", [1.0, 0.0])], "seq int, name string, value string, vector array<double>")
    heads = spark.createDataFrame([("1", "Interest", angle)], "key string, heading string, vector array<double>")
    texts = spark.createDataFrame([("1", "The rate is 5%.")], "key string, text string")
    row = form_check.check_fields(fields, heads, texts, Rules()).first()
    assert row.match == want and row.section_key == "1"
    none = form_check.check_fields(fields, heads.limit(0), texts, Rules()).first()
    assert none.match is None and none.section_key == "—"
    md = report.form_report(form_check.check_fields(fields, heads, texts, Rules()), "p.pdf", "l.pdf").first().markdown
    assert "| 1 | Rate | 5% | 1 Interest |" in md


def test_self_rag(spark):
    docs = spark.createDataFrame([(0, "alpha beta", [1.0, 0.0]), (1, "gamma", [0.0, 1.0])], "key long, content string, vector array<double>")
    asks = spark.createDataFrame([(0, "what is alpha", [1.0, 0.0]), (1, "zzzz", [1.0, 0.0])], "query_id long, query string, vector array<double>")
    got = {r.query_id: r.response for r in self_rag.self_rag(asks, docs, Rules()).collect()}
    assert got == {0: "alpha beta", 1: "No relevant context found."}


def test_recorded_and_live(spark):
    rows = spark.createDataFrame([("five words are enough here",), ("x",)], "clause string")
    known = rows.limit(1).select(F.lit("clause_match").alias("kind"), input_hash({"clause": F.col("clause")}).alias("input_hash"), F.lit('{"needs_lookup": true}').alias("payload"))
    told = Recorded(known).decide(rows, "clause_match", {"clause": F.col("clause")}, "d").collect()
    assert sorted(str(r.d and r.d.needs_lookup) for r in told) == ["None", "True"]
    live = Live(lambda kind, parts: [{"needs_lookup": len(p["clause"]) > 3} for p in parts])
    assert sorted(r.d.needs_lookup for r in live.decide(rows, "clause_match", {"clause": F.col("clause")}, "d").collect()) == [False, True]


def test_extraction_end_to_end(spark):
    lines = ["1. Definitions", "Words mean things.", "2. Interest Rate", "The interest rate is five.", "3. Fees", "No fees."]
    blocks = spark.createDataFrame([(0, i, i // 2 + 1, t, 14.0 if i % 2 == 0 else 10.0, False) for i, t in enumerate(lines)], "doc_id long, seq int, page int, text string, font_size double, is_bold boolean")
    chunks = extract.prepare_chunks(blocks, Rules())
    embed = vectors.digest_embedder()
    got = extract.extract_section(chunks, "Interest Rate", embed, Rules()).first()
    assert got.heading == "2. Interest Rate" and got.verified and got.pages == [2]
    index = extract.SectionIndex(chunks, embed)
    assert index.search("2. Interest Rate\nThe interest rate is five.").first().heading == "2. Interest Rate"
    index.close()
    assert extract.extract_definitions(chunks, embed).count() == 1
    done = extract.collate_statement(chunks, "The Interest Rate and Fees apply.", embed, Rules()).first()
    assert done.terms == ["The Interest Rate", "Fees"] and done.match_count > 0


def test_streaming(spark, tmp_path):
    from quillon.operators.sections import parse_sections

    spark.createDataFrame([(0, 0, 1, "1. A"), (0, 1, 1, "b")], ingest.BLOCKS).write.parquet(f"{tmp_path}/in")
    query = ingest.write_sections(ingest.read_blocks(spark, f"{tmp_path}/in"), parse_sections, f"{tmp_path}/out", f"{tmp_path}/state")
    query.awaitTermination()
    assert [r.key for r in spark.read.parquet(f"{tmp_path}/out").collect()] == ["1"]
