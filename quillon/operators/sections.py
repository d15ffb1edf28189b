"""Keyed sections and schedules from ordered blocks.

blocks has doc_id, seq, text and, for pages, page. Which key a block belongs to is a fill-forward over its document's
order, so each operator takes one shuffle, by doc_id: windows and both groupings need no other. Blocks without
text are ignored. Rows of a key come out with ord, the place of its first block; texts of a key that occurs again
are appended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from quillon.functions import text as T

MAX_DEPTH = 2


def in_order() -> WindowSpec:
    return Window.partitionBy("doc_id").orderBy("seq")


def so_far() -> WindowSpec:
    return in_order().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def whole() -> WindowSpec:
    return Window.partitionBy("doc_id")


def _lined(blocks: DataFrame) -> DataFrame:
    return blocks.filter(T.strip("text") != "").withColumn("line", T.first_line("text"))


def joined(parts: Column, by: str) -> Column:
    """Texts of structs whose first field is their order."""
    return F.array_join(F.transform(F.array_sort(parts), lambda x: x["text"]), by)


def _keyed(rows: DataFrame, paged: bool, double_last: Column | None = None) -> DataFrame:
    """rows have key and run; a run's text is stripped, runs of a key are put together in order."""
    page = [F.collect_set("page").alias("pages")] if paged else []
    runs = rows.groupBy("doc_id", "key", "run").agg(
        F.min("seq").alias("seq"), T.strip(joined(F.collect_list(F.struct("seq", "text")), "\n")).alias("text"), *page,
        *([F.max(double_last).alias("twice")] if double_last is not None else [])
    )
    runs = runs.filter("text <> ''")
    if double_last is not None:
        runs = runs.withColumn("text", F.when(F.col("twice"), F.concat_ws("\n", "text", "text")).otherwise(F.col("text")))
    pages = [F.array_sort(F.array_distinct(F.flatten(F.collect_list("pages")))).alias("page_numbers")] if paged else []
    return runs.groupBy("doc_id", "key").agg(F.min("seq").alias("ord"), joined(F.collect_list(F.struct("seq", "text")), "\n").alias("text"), *pages)


def parse_sections(blocks: DataFrame, headings_in_key: bool = False, paged: bool = False) -> DataFrame:
    """doc_id, key, ord, text (and page_numbers): sections of numbers up to depth 2.

    Deeper numbers are body text. Text before the first heading is the preamble; if a deep number comes first, its first two
    parts are the key. With headings_in_key, sections of the same number and other words stay apart.
    """
    rows = _lined(blocks).withColumn("number", T.section_number("line")).withColumn("depth", T.depth("number"))
    shallow = F.col("depth") <= MAX_DEPTH
    key = T.heading_key(F.col("number"), F.col("line")) if headings_in_key else F.col("number")
    first = F.row_number().over(in_order()) == 1
    parent = F.array_join(F.slice(F.split("number", r"\."), 1, MAX_DEPTH), ".")
    rows = rows.withColumn("start", F.when(shallow, key).when(first, F.coalesce(parent, F.lit(T.PREAMBLE))))
    rows = rows.withColumn("key", F.last("start", ignorenulls=True).over(so_far())).withColumn("run", F.count("start").over(so_far()))
    return _keyed(rows, paged)


def parse_schedules(
    blocks: DataFrame, stop_pattern: str | None = T.STOP_EXECUTION, stop_on_numbered_section: bool = False, paged: bool = False,
    compat_double_flush: bool = False
) -> DataFrame:
    """doc_id, key, ord, text (and page_numbers) of schedules, from their headings up to the first stop.

    A stop is a line that matches stop_pattern or, if asked for, a section number of depth 1, once a schedule has begun.
    compat_double_flush repeats the text of the last run where a stop ended the document.
    """
    rows = _lined(blocks).withColumn("schedule", T.group(F.col("line"), T.SCHEDULE, 1))
    number = T.section_number("line")
    stops = F.lit(False)
    if stop_pattern:
        stops = stops | F.col("line").rlike(stop_pattern)
    if stop_on_numbered_section:
        stops = stops | F.coalesce(T.depth(number) == 1, F.lit(False))
    started = F.count("schedule").over(in_order().rowsBetween(Window.unboundedPreceding, -1)) > 0
    rows = rows.withColumn("stop", stops & started).withColumn("end", F.min(F.when(F.col("stop"), F.col("seq"))).over(whole()))
    rows = rows.filter(F.col("end").isNull() | (F.col("seq") < F.col("end")))
    rows = rows.withColumn(
        "key", F.concat(F.lit("Schedule "), F.last("schedule", ignorenulls=True).over(so_far()))
    ).withColumn("run", F.count("schedule").over(so_far()))
    rows = rows.filter("run > 0")
    last = None
    if compat_double_flush:
        rows = rows.withColumn("last_run", F.max("run").over(whole()))
        last = F.col("end").isNotNull() & (F.col("run") == F.col("last_run"))
    return _keyed(rows, paged, last)


def parse_schedules_witness(blocks: DataFrame, paged: bool = False, compat_double_flush: bool = False) -> DataFrame:
    """Schedules that only the words of witness end."""
    return parse_schedules(blocks, T.STOP_WITNESS, paged=paged, compat_double_flush=compat_double_flush)


def second_half_schedules(blocks: DataFrame, paged: bool = True, compat_double_flush: bool = False) -> DataFrame:
    """Schedules in the second half of the pages; see sources.blocks.second_half."""
    from quillon.sources.blocks import second_half

    return parse_schedules_witness(second_half(blocks), paged, compat_double_flush)


def show_keys(keyed: DataFrame, always_range: bool = False) -> DataFrame:
    """One line for each key: the key and, if there are pages, the page or range of pages."""
    if "page_numbers" not in keyed.columns:
        return keyed.select("doc_id", "ord", F.col("key").alias("line"))
    low, high = F.array_min("page_numbers"), F.array_max("page_numbers")
    span = F.format_string("pages %d-%d", low, high)
    label = span if always_range else F.when(low == high, F.format_string("page %d", low)).otherwise(span)
    return keyed.select("doc_id", "ord", F.concat("key", F.lit("  ("), label, F.lit(")")).alias("line"))


def merge_with_override(left: DataFrame, right: DataFrame) -> DataFrame:
    """Keys of both; where a key is in both, the right side's row stays, at the left one's place."""
    both = left.withColumn("_side", F.lit(0)).unionByName(right.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in ("doc_id", "key", "_side", "ord")]
    chosen = both.groupBy("doc_id", "key").agg(F.max_by(F.struct(*rest), "_side").alias("v"), F.min_by(F.struct("_side", "ord"), "_side").alias("place"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("place")) - 1
    return chosen.withColumn("ord", place).select("doc_id", "key", "ord", "v.*")
