import random
import re

import pytest

from quillon.operators import sections
from quillon.operators.definitions import definitions, find_definitions_section, parse_definitions
from quillon.sources.blocks import second_half

SCHEMA = "doc_id long, seq int, page int, text string"


def frame(spark, *docs):
    rows = [(d, i, p, t) for d, blocks in enumerate(docs) for i, (t, p) in enumerate(b if isinstance(b, tuple) else (b, 1) for b in blocks)]
    return spark.createDataFrame(rows, SCHEMA)


def found(df, value="text", doc=0, key="key"):
    return {r[key]: r[value] for r in sorted(df.collect(), key=lambda r: r.ord) if r.doc_id == doc}


def parse(spark, *blocks, **options):
    return found(sections.parse_sections(frame(spark, blocks), **options))


def test_deep_numbers_fold(spark):
    out = parse(spark, "1.1 Payment\nGeneral.", "1.1.1 Principal\nPrincipal text.")
    assert list(out) == ["1.1"] and "Principal text." in out["1.1"]


def test_bare_integers_are_no_headings(spark):
    out = parse(spark, "1. Introduction\nText.", "42", "More text.")
    assert list(out) == ["1"] and out["1"].endswith("42\nMore text.")


def test_preamble_and_order(spark):
    out = parse(spark, "Dated 1 May", "2. Two", "1. One")
    assert list(out) == ["preamble", "2", "1"]


def test_deep_number_first(spark):
    assert list(parse(spark, "3.2.1 Deep", "more")) == ["3.2"]


def test_repeated_key_is_appended(spark):
    assert parse(spark, "1. A", "2. B", "1. C")["1"] == "1. A\n1. C"


def test_heading_keys(spark):
    out = parse(spark, "1. DEFINITIONS", "1.1 Terms", "1.1 Others", "2.", headings_in_key=True)
    assert list(out) == ["1 DEFINITIONS", "1.1 Terms", "1.1 Others", "2"]


def test_pages(spark):
    rows = frame(spark, [("2. Two", 7), ("a", 7), ("b", 9), ("c", 8)])
    assert found(sections.parse_sections(rows, paged=True), "page_numbers") == {"2": [7, 8, 9]}


def test_empty_blocks(spark):
    assert parse(spark, "  ", "") == {}


def machine(blocks):
    """A state machine for sections, as a check of the windows."""
    out, key, held = {}, None, []

    def flush():
        text = "\n".join(held).strip()
        if key is not None and text:
            out[key] = out[key] + "\n" + text if key in out else text

    for block in blocks:
        m = re.match(r"(\d+(?:\.\d+)+\.?|\d+\.)", block.splitlines()[0].strip())
        number = m[1].rstrip(".") if m else None
        if number and number.count(".") < 2:
            flush()
            key, held = number, [block]
        else:
            if key is None:
                key = ".".join(number.split(".")[:2]) if number else "preamble"
            held.append(block)
    flush()
    return out


def test_against_a_state_machine(spark):
    rng = random.Random(3)
    pool = ["1. A", "1.1 B", "1.1.1 C", "2. D", "2.1. E", "text", "42", "more\n3. no", "10.2 x", "1.25x cover"]
    docs = [[rng.choice(pool) for _ in range(rng.randint(1, 12))] for _ in range(150)]
    rows = sections.parse_sections(frame(spark, *docs)).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r.ord):
        got.setdefault(r.doc_id, {})[r.key] = r.text
    for i, blocks in enumerate(docs):
        assert list(got[i].items()) == list(machine(blocks).items())


def schedules(spark, *blocks, **options):
    return found(sections.parse_schedules(frame(spark, blocks), **options))


@pytest.mark.parametrize("stop", ["SIGNED BY", "Executed as a deed", "IN WITNESS WHEREOF", "Signatories", "Authorised Signatory:", "Annexure A"])
def test_stops(spark, stop):
    assert schedules(spark, "Schedule 1\nBody", stop, "after") == {"Schedule 1": "Schedule 1\nBody"}


def test_stop_needs_a_schedule_and_a_line_start(spark):
    out = schedules(spark, "SIGNED early", "Schedule 1\nThis agreement, in witness whereof, is signed.", "tail")
    assert out["Schedule 1"].endswith("tail")


def test_numbered_stop_is_optional(spark):
    blocks = ("Schedule 9\nText", "1.1 Deep", "1. Execution", "x")
    assert schedules(spark, *blocks)["Schedule 9"].endswith("x")
    assert schedules(spark, *blocks, stop_on_numbered_section=True)["Schedule 9"] == "Schedule 9\nText\n1.1 Deep"


def test_double_flush_is_optional(spark):
    blocks = ("Schedule 1\nA", "signed")
    assert schedules(spark, *blocks, compat_double_flush=True)["Schedule 1"] == "Schedule 1\nA\nSchedule 1\nA"
    assert schedules(spark, "Schedule 1\nA", compat_double_flush=True)["Schedule 1"] == "Schedule 1\nA"


@pytest.mark.parametrize("pages, first", [(1, None), (2, 2), (3, 3), (4, 3), (5, 4), (6, 4), (10, 6)])
def test_second_half(spark, pages, first):
    rows = frame(spark, [(f"p{i}", i) for i in range(1, pages + 1)])
    got = sorted(r.page for r in second_half(rows).collect())
    assert got == (list(range(first, pages + 1)) if first else [])


def test_definitions_of_depth_2(spark):
    blocks = ["1. General", "1.1 Definitions", '"Bank" means a bank.', "1.2 Interpretation", '"Not" here']
    assert found(definitions(frame(spark, blocks)), key="term") == {"Bank": '"Bank" means a bank.'}
    assert [r.text for r in find_definitions_section(frame(spark, blocks)).collect()] == ['"Bank" means a bank.']


def test_definitions_of_depth_1_keep_depth_2(spark):
    blocks = ["1. Definitions", "1.1 Terms", '“Agent” means\n  an agent.', "and more", "2. Next"]
    assert found(definitions(frame(spark, blocks)), key="term") == {"Agent": "“Agent” means an agent. and more"}


def test_the_last_definition_counts(spark):
    rows = parse_definitions(frame(spark, ["lead", '"A b" one', '"Cd" two', '"A b" three']))
    assert found(rows, key="term") == {"A b": '"A b" three', "Cd": '"Cd" two'} and sorted(r.ord for r in rows.collect()) == [1, 2]


def test_show_keys_and_override(spark):
    rows = sections.parse_sections(frame(spark, [("1. A", 1), ("x", 2), ("2. B", 3)]), paged=True)
    assert sorted(r.line for r in sections.show_keys(rows).collect()) == ["1  (pages 1-2)", "2  (page 3)"]
    right = sections.parse_sections(frame(spark, [("2. New", 9), ("3. C", 9)]), paged=True)
    assert found(sections.merge_with_override(rows, right)) == {"1": "1. A\nx", "2": "2. New", "3": "3. C"}
