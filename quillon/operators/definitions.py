"""The definitions section of a document and its dictionary of terms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators.sections import in_order, so_far, whole, _lined, joined


def find_definitions_section(blocks: DataFrame) -> DataFrame:
    """The blocks after the first definitions heading up to the next section.

    A number of depth 1 ends it; if the heading itself has depth 2, a number of depth 2 or more does too. Further
    definitions headings do not.
    """
    rows = _lined(blocks).withColumn("heading", F.col("line").rlike(T.DEFINITIONS_HEADING))
    rows = rows.withColumn("start", F.min(F.when(F.col("heading"), F.col("seq"))).over(whole())).filter("seq >= start")
    rows = rows.withColumn("deep", F.first(F.col("line").rlike(T.DEPTH_2)).over(in_order()))
    ends = (F.col("line").rlike(T.DEPTH_1) | (F.col("deep") & F.col("line").rlike(T.DEPTH_2))) & ~F.col("heading")
    rows = rows.withColumn("end", F.min(F.when(ends & (F.col("seq") > F.col("start")), F.col("seq"))).over(whole()))
    inside = (F.col("seq") > F.col("start")) & (F.col("end").isNull() | (F.col("seq") < F.col("end")))
    return rows.filter(inside).select(*blocks.columns)


def parse_definitions(blocks: DataFrame) -> DataFrame:
    """doc_id, term, text, ord: blocks from each quoted term up to the next, on one line.

    Of several definitions of a term the last counts, at the first one's place. Blocks before the first term are dropped.
    """
    rows = _lined(blocks).withColumn("found", T.defined_term("line"))
    rows = rows.withColumn("term", F.last("found", ignorenulls=True).over(so_far())).withColumn("run", F.count("found").over(so_far())).filter("run > 0")
    rows = rows.withColumn("text", T.collapse("text"))
    runs = rows.groupBy("doc_id", "term", "run").agg(
        F.min("seq").alias("seq"), T.strip(joined(F.collect_list(F.struct("seq", "text")), " ")).alias("text")
    ).filter("text <> ''")
    return runs.groupBy("doc_id", "term").agg(F.max_by("text", "run").alias("text"), F.min("seq").alias("ord"))


def definitions(blocks: DataFrame) -> DataFrame:
    return parse_definitions(find_definitions_section(blocks))
