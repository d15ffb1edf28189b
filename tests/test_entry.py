"""Commands, readers with an extractor, token measures, reports with null cells, and the driver's entry."""

import io
import json
import subprocess
import sys
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillon import __main__ as commands
from quillon.operators import split, strikes
from quillon.plans import extract, report
from quillon.sources import files

ROOT = Path(__file__).resolve().parent.parent
LINES = ["Agreement", "1. Definitions", '"Rate" means the rate of interest that applies to a loan.', "2. Interest Rate", "The interest rate is five percent a year.", "Schedule 1 Fees", "No fees are due under this agreement."]


def docx(path, lines):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join(f"<w:p><w:r><w:t>{line}</w:t></w:r></w:p>" for line in lines)
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
    path.write_bytes(data.getvalue())
    return str(path)


@pytest.fixture
def paths(spark, tmp_path):
    other = [line.replace("five percent", "six per cent and more") for line in LINES]
    cells = [("form", 1, 0, r, c, t) for r, row in enumerate([("Interest Rate", "five percent"), ("SECTION A", "x"), ("Fees", "none")]) for c, t in enumerate(row)]
    spark.createDataFrame(cells, "doc_id string, page int, table_no int, row_no int, col_no int, text string").write.parquet(f"{tmp_path}/cells.parquet")
    return docx(tmp_path / "a.docx", LINES), docx(tmp_path / "b.docx", other), f"{tmp_path}/cells.parquet"


def run(spark, capsys, *argv):
    assert commands.main([*argv], spark) == 0
    return capsys.readouterr().out


def test_commands(spark, capsys, paths):
    a, b, cells = paths
    found = json.loads(run(spark, capsys, "sections", a))
    assert list(found) == ["preamble", "1", "2"] and "five percent" in json.dumps(found["2"])
    assert list(json.loads(run(spark, capsys, "schedules", a))) == ["Schedule 1"]
    assert list(json.loads(run(spark, capsys, "definitions", a))) == ["Rate"]
    one = json.loads(run(spark, capsys, "extract", a, "--query", "Interest Rate"))
    assert one["heading"] == "2. Interest Rate" and one["verified"]
    assert json.loads(run(spark, capsys, "extract-definitions", a))["content"]
    assert json.loads(run(spark, capsys, "search", a, "--query", "Interest Rate"))["chunk_ids"]
    assert json.loads(run(spark, capsys, "collate", a, "--query", "The Interest Rate"))["terms"] == ["The Interest Rate"]
    assert len(run(spark, capsys, "index", a, "--query", "fees", "--query", "rate").splitlines()) == 6
    assert [json.loads(x)["item_no"] for x in run(spark, capsys, "compare", a, b).splitlines()] == [1]
    assert "# Document Comparison Report" in run(spark, capsys, "compare", a, b, "--report")
    assert [json.loads(x)["compare_paragraph"] for x in run(spark, capsys, "compare-whole", a, b).splitlines()] == ["The interest rate is six per cent and more a year."]
    assert sorted(json.loads(x)["name"] for x in run(spark, capsys, "form", cells, a).splitlines()) == ["Fees", "Interest Rate"]
    assert "| # | Field |" in run(spark, capsys, "form", cells, a, "--report")
    for wrong in (["extract", a], ["compare", a], ["nothing", a]):
        with pytest.raises(SystemExit):
            commands.main(wrong, spark)


def test_shapes_come_from_an_extractor(spark, tmp_path):
    (tmp_path / "x.pdf").write_bytes(b"20 40")

    def extract_shapes(data):
        y = float(data.split()[0])
        yield "drawing", 1, 0, 0.0, y + 4, 60.0, y + 5, None, None, None, [0.9, 0.1, 0.1], None
        yield "word", 1, 0, 10.0, y, 40.0, y + 10, "struck", None, None, None, None
        yield "word", 1, 1, 10.0, y + 30, 40.0, y + 40, "left", None, None, None, None
        yield "char", 1, 0, 10.0, y, 14.0, y + 10, "s", 10.0, 0xFF0000, None, None
        yield "char", 1, 1, 10.0, y + 30, 14.0, y + 40, "l", 10.0, 0, None, None

    drawings, words, chars = files.read_pdf_shapes(spark, str(tmp_path), extract_shapes)
    lines = strikes.strike_lines(drawings, words)
    assert lines.count() == 1 and [r.word for r in strikes.words_without_strikes(words, lines).collect()] == ["left"]
    assert [r.text for r in strikes.text_without_strikes(chars, lines).collect()] == ["l"]
    assert sorted(r.kind for r in strikes.redactions(lines, chars).collect()) == ["line", "text"]


def test_chunks_are_measured_in_tokens(spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    measure = split.token_measure(tokenizers.path("byte_bpe_50k.json"))
    text = "words that a vocabulary knows " * 200
    chunks = spark.createDataFrame([(0, 0, "H", text, [1], 1), (0, 1, "I", "short", [2], 2)], "doc_id long, chunk_id int, heading string, content string, pages array<int>, start_page int")
    parts = split.split_oversized_chunks(chunks, 100, 10, measure).collect()
    assert len(parts) > 8 and all(measure(p.content) <= 100 for p in parts) and len(parts) < split.split_oversized_chunks(chunks, 100, 10).count()


def test_null_cells_keep_their_columns(spark):
    schema = "item_no long, section string, base_page int, compare_page int, base_paragraph string, compare_paragraph string, deviation boolean, deviation_type string, score int, severity string, comments string"
    items = spark.createDataFrame([(1, None, 1, None, None, "b", None, None, 3, None, None), (2, "S", 0, 2, "a", "b", True, "addition", 3, "Medium", "c")], schema)
    for full, columns in ((True, 10), (False, 8)):
        assert all(r.line.count(" | ") == columns - 1 for r in report.deviation_rows(items, full).collect())
        whole = report.comparison_report(items, "a", "b", full).first().markdown
        assert "".join(r.text for r in report.comparison_lines(items, "a", "b", full).collect()) == whole
    fields = spark.createDataFrame([(0, None, "v", "—", None, None, None), (1, "n", None, "k", "h", True, None)], "seq int, name string, value string, section_key string, section_heading string, match boolean, reason string")
    table = [x for x in report.form_report(fields, "p", "l").first().markdown.splitlines() if x.startswith(("| 1 |", "| 2 |"))]
    assert [x.count("|") for x in table[-2:]] == [7, 7]


def test_entry_without_corpus_operators(tmp_path):
    """The entry imports, and lists the other queries, where the corpus operators or their libraries are missing."""
    code = "import sys; sys.modules['{0}'] = None; import __spark_entry__ as e; print(len(e.queries()), any(q.startswith('op') for q in e.queries()), 'pipeline' in e.queries())"
    for missing in ("tokenizers", "quillon.llm", "public_tokenizers"):
        said = subprocess.run([sys.executable, "-c", code.format(missing)], cwd=ROOT, capture_output=True, text=True)
        n, corpus, pipeline = said.stdout.split()
        assert int(n) > 40 and (corpus, pipeline) == ("False", "False")


def slow_gather(heads, at):
    """The chunks of the section around one, by walking."""
    import re

    number = lambda h: (m := re.match(r"^(\d+(?:\.\d+)*)\s*\.?\s", h)) and m[1]
    own = number(heads[at])
    if not own:
        return [i for i, h in enumerate(heads) if h == heads[at]]
    low = high = at
    while low and heads[low - 1] == heads[at]:
        low -= 1
    while high + 1 < len(heads) and not ((n := number(heads[high + 1])) and n != own and not n.startswith(f"{own}.") and heads[high + 1] != heads[at]):
        high += 1
    return [*range(low, high + 1)]


def test_extract_section_is_brute_force(spark):
    """Candidates by name, then by retrieval in each document; the first that is verified, or else the last."""
    import hashlib

    import numpy as np

    from quillon.operators import vectors
    from quillon.operators.decide import Rules

    heads = {0: ["", "1. Fees", "1.1 Due fees", "Notes", "2. Law"], 1: ["1. Terms", "2. Other", "Notes", "Notes"], 2: [""]}
    rows = [(d, i, h, f"text {d} {i}" + (" about fees" if (d, i) in ((0, 2), (1, 3)) else ""), [i + 1], i + 1) for d, hs in heads.items() for i, h in enumerate(hs)]
    chunks = spark.createDataFrame(rows, "doc_id long, chunk_id int, heading string, content string, pages array<int>, start_page int")
    query, k = "fees", 2

    def embed(text):
        v = np.array([int(hashlib.md5(text.encode()).hexdigest()[i * 2 : i * 2 + 2], 16) / 127.5 - 1 for i in range(16)])
        return v / np.linalg.norm(v)

    got = {r.doc_id: r for r in extract.extract_section(chunks, query, vectors.digest_embedder(), Rules(), k).collect()}
    for d, hs in heads.items():
        content = {r[1]: r[3] for r in rows if r[0] == d}
        full = [f"{h}\n{content[i]}".strip() for i, h in enumerate(hs)]
        first = [i for i, h in enumerate(hs) if h and h not in hs[:i]]
        named = [i for i in first if query in hs[i].lower()][:3]
        best = {}
        for t in (t.format(query) for t in extract.TEMPLATES):
            score = [round(float(embed(x) @ embed(t)), 6) for x in full]
            hits = sorted(range(len(hs)), key=lambda i: (-score[i], i))[:k]
            for i in hits + [i for i, h in enumerate(hs) if t.lower() in h.lower() and i not in hits]:
                best[i] = max(best.get(i, -2), score[i] if i in hits else 1.0)
        order = named + [i for i in sorted(best, key=lambda i: (-best[i], i)) if i not in named]
        merged = []
        for at in order:
            members = slow_gather(hs, at)
            parts = [f"\n{hs[i]}\n{content[i]}" if hs[i] else content[i] for i in members]
            merged.append((hs[members[0]], "\n".join(parts).strip(), members[0]))
        want = next((m for m in merged if query in m[1].lower()), merged[-1])
        assert (got[d].heading, got[d].content, got[d].chunk_id, got[d].verified) == (*want, query in want[1].lower())
