"""Column expressions over block, heading and chunk texts.

White space, digits and letters are Unicode's, as in Python: patterns carry (?U). Expressions stay in the JVM and within
one projection, so Catalyst can push filters on them down to the scan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns that tell headings, schedules, definitions and stops apart.
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"
SECTION = r"(?U)^(\d+(?:\.\d+)+\.?|\d+\.)\s*(.*)"
SCHEDULE = r"(?Ui)^schedule\s+(\d+)\b\s*(.*)"
STOP_EXECUTION = r"(?Ui)^(?:signed|executed|in\s+witness|signator|authoris|authoriz|annex)"
STOP_WITNESS = r"(?Ui)^in\s+witness\s+whereof"
DEFINITIONS_HEADING = r"(?Ui)definitions?\s+and\s+interpret|\bdefinitions?\s*$"
DEPTH_1 = r"(?U)^\d+\.\s"
DEPTH_2 = r"(?U)^\d+\.\d+"
DEFINED_TERM = '(?U)^["“‘«]([A-Z][^"“”‘’«»]+?)["”’»]'
NAMED_PREFIX = r"(?Ui)^(schedule|annex|appendix|exhibit|attachment|part)\s+(\w+)"
NUMBERED = r"(?U)^(\d+(?:\.\d+)*)\s*\.?\s"
PART_SUFFIX = r"(?U)\s*\(part \d+\)\s*$"
PIECE_SUFFIX = r"(?U)\s+\[\d+/\d+\]$"
PREAMBLE = "preamble"
PREAMBLE_HEADING = "Agreement Parties Preamble"

_SPACE = r"[\s\x1C-\x1F]"
_CASED = r"[\p{Lu}\p{Ll}\p{Lt}]"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(text: Column | str) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(F.regexp_replace(_c(text), rf"(?U)^{_SPACE}+", ""), rf"(?U){_SPACE}+$", "")


def first_line(text: Column | str) -> Column:
    """The first line of a text, stripped; any of Unicode's line ends counts."""
    return strip(F.get(F.split(_c(text), LINE_BREAK), F.lit(0)))


def collapse(text: Column | str) -> Column:
    """Runs of white space as single spaces."""
    return strip(F.regexp_replace(_c(text), rf"(?U){_SPACE}+", " "))


def group(text: Column, pattern: str, k: int) -> Column:
    """A group of the pattern's first match, null if there is no match or it is empty."""
    return F.nullif(F.regexp_extract(text, pattern, k), F.lit(""))


def section_number(line: Column | str) -> Column:
    """The number that a section heading begins with, without dots at its end; bare integers are none."""
    return F.rtrim(group(_c(line), SECTION, 1), F.lit("."))


def depth(number: Column | str) -> Column:
    return F.size(F.split(_c(number), r"\."))


def heading_key(number: Column, line: Column) -> Column:
    """number and the heading's words, or the number alone."""
    words = strip(F.regexp_replace(line, r"(?U)^\d+(?:\.\d+)*\.?\s*", ""))
    return F.when(words != "", F.concat_ws(" ", number, words)).otherwise(number)


def numbered_level(text: Column | str) -> Column:
    """Parts of the leading number, which white space must follow; 0 without one."""
    number = group(strip(text), NUMBERED, 1)
    return F.coalesce(depth(number), F.lit(0))


def any_level(heading: Column | str) -> Column:
    """Parts of the leading number; 1 without one."""
    h = strip(heading)
    digits = group(h, r"(?U)^([\d.]+)", 1)
    parts = F.filter(F.split(digits, r"\."), lambda p: p.rlike(r"(?U)^\d+$"))
    return F.when(h.rlike(r"(?U)^\d+"), F.size(parts)).otherwise(1)


def base_heading(heading: Column | str) -> Column:
    """A heading without the mark of a part."""
    return strip(F.regexp_replace(_c(heading), PART_SUFFIX, ""))


def base_key(key: Column | str) -> Column:
    """A key without the mark of a piece."""
    return F.regexp_replace(_c(key), PIECE_SUFFIX, "")


def heading_number(heading: Column | str) -> Column:
    """The leading number of a heading or of what it is a part of; null without one."""
    return group(base_heading(heading), NUMBERED, 1)


def named_prefix(heading: Column | str) -> tuple[Column, Column]:
    """Kind and identifier, in lower case, of headings such as those of schedules and annexes; nulls for others."""
    base = base_heading(heading)
    return F.lower(group(base, NAMED_PREFIX, 1)), F.lower(group(base, NAMED_PREFIX, 2))


def topic(key: Column | str, text: Column | str) -> Column:
    """The heading of a keyed section without its number."""
    line = F.when(_c(text) == "", _c(key)).otherwise(first_line(text))
    bare = strip(F.regexp_replace(line, r"(?U)^\d+(\.\d+)*\.?\s*", ""))
    return F.when(_c(key) == PREAMBLE, PREAMBLE_HEADING).when(bare != "", bare).otherwise(line)


def full_text(heading: Column | str, content: Column | str) -> Column:
    return strip(F.concat(_c(heading), F.lit("\n"), _c(content)))


def defined_term(line: Column | str) -> Column:
    """The quoted term that a line begins with; null without one."""
    return strip(group(_c(line), DEFINED_TERM, 1))


def estimated_tokens(text: Column | str) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(_c(text)) / 4).cast("int"))


def is_child(parent: Column, number: Column) -> Column:
    """Whether a section number is the parent's own or one below it."""
    return (number == parent) | number.startswith(F.concat(parent, F.lit(".")))


def is_title(text: Column | str) -> Column:
    """Words begin with capitals and go on in lower case, and there is a letter with case."""
    t = _c(text)
    return t.rlike(_CASED) & ~t.rlike(rf"(^|[^\p{{Lu}}\p{{Ll}}\p{{Lt}}])\p{{Ll}}") & ~t.rlike(rf"{_CASED}[\p{{Lu}}\p{{Lt}}]")


def is_upper(text: Column | str) -> Column:
    t = _c(text)
    return t.rlike(r"\p{Lu}") & ~t.rlike(r"[\p{Ll}\p{Lt}]")


def looks_like_heading(text: Column | str) -> Column:
    """At most 12 words, no full stop at the end, and title or upper case or a list number before a word."""
    t = _c(text)
    words = F.size(F.filter(F.split(t, rf"(?U){_SPACE}+"), lambda w: w != ""))
    return (words <= 12) & ~t.endswith(".") & (is_title(t) | is_upper(t) | t.rlike(r"(?U)^\d+[\.\)]\s+\w"))


def is_section_label(text: Column | str) -> Column:
    """Whether a form's cell is a band's label rather than a field's name."""
    t = strip(text)
    same = (F.length(t) > 4) & (t == F.upper(t)) & ~t.contains(":") & ~t.contains("/")
    return F.upper(t).startswith("SECTION ") | F.upper(t).startswith("PART ") | same


def truncated(text: Column | str, most: int) -> Column:
    """One line of at most most characters; what was cut off is marked."""
    t = strip(F.regexp_replace(_c(text), "\n", " "))
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.regexp_replace(F.substring(t, 1, most), rf"(?U){_SPACE}+$", ""), F.lit("…")))


def page_label(page: Column | str) -> Column:
    """p.N, or a dash where the page is absent (0 or null)."""
    return F.when(F.coalesce(_c(page), F.lit(0)) != 0, F.concat(F.lit("p."), _c(page).cast("string"))).otherwise("—")


def match_label(match: Column | str) -> Column:
    m = _c(match)
    return F.when(m, "Match").when(~m, "Deviation").otherwise("Unmatched")


def paragraph_line(index: Column, page: Column, section: Column, text: Column) -> Column:
    """A paragraph as prompts show it: its index, page and section before it."""
    return F.format_string("[%d] (p.%d | §%s) %s", index, page, section, text)


def anchor_score(heading: Column | str, length: Column | str) -> Column:
    """Numbered headings and long contents make good anchors, very short contents bad ones."""
    n = _c(length)
    return (F.when(strip(heading).rlike(r"(?U)^\d+"), 2.0).otherwise(0.0) + F.least(n / 500.0, F.lit(3.0)) - F.when(n < 100, 2.0).otherwise(0.0)).cast("double")


# What models answer with.


def first_int(answer: Column | str) -> Column:
    """The first integer of an answer; null without one."""
    return group(_c(answer), r"(\d{1,9})", 1).cast("int")


def int_list(answer: Column | str, most: int | None = None) -> Column:
    """The different integers of an answer in order, at most most."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(_c(answer), F.lit(r"(\d{1,9})"), F.lit(1)), lambda x: x.cast("int")))
    return found if most is None else F.slice(found, 1, most)


def page_list(answer: Column | str, shown: Column | str) -> Column:
    """The page numbers of a comma-separated answer, of those that were shown."""
    tokens = F.filter(F.split(F.regexp_replace(_c(answer), " ", ""), ","), lambda t: t.rlike(r"^[+-]?\d{1,9}$"))
    return F.array_sort(F.array_intersect(F.transform(tokens, lambda t: t.cast("int")), _c(shown)))


def term_list(answer: Column | str) -> Column:
    """The strings of a JSON array, or else the answer's parts between commas and line ends."""
    t = _c(answer)
    inner = F.regexp_extract(t, r"(?s)(\[.*\])", 1)
    parsed = F.from_json(F.nullif(inner, F.lit("")), "array<string>")
    parts = F.filter(F.transform(F.split(t, "[,\n]"), strip), lambda p: p != "")
    return F.coalesce(F.filter(F.transform(parsed, strip), lambda p: p != ""), parts)
