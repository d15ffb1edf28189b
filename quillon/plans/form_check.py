"""Form fields against the sections of an agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.decide import Decider
from quillon.operators.vectors import top_k

THRESHOLD, SECTION_CHARS = 0.45, 2000


def route(fields: DataFrame, store: DataFrame, without_self: bool = False, by: str | None = None) -> DataFrame:
    """fields (seq, name, value, vector) with section_key, section_heading and score of the nearest heading; nulls without any section.

    without_self: a section whose key is the field's seq is not looked at. by: fields look only at the sections of their own by (a pair of documents, say).
    """
    own = [by] if by else []
    hits = top_k(store, fields.select("seq", "vector", *own), 1, key="key", query="seq", without_self=without_self, by=by).select("seq", *own, "key", "score")
    heads = hits.join(store.select("key", "heading", *own), ["key", *own]).select(
        "seq", *own, F.col("key").alias("section_key"), F.col("heading").alias("section_heading"), "score"
    )
    return fields.join(heads, ["seq", *own], "left")


def check_fields(
    fields: DataFrame, store: DataFrame, sections: DataFrame, decider: Decider, threshold: float = THRESHOLD, without_self: bool = False,
    by: str | None = None
) -> DataFrame:
    """seq, (by,) name, value, section_key, section_heading, match, reason. match is null where no section is near enough or the decision failed."""
    own = [by] if by else []
    text = sections.select(F.col("key").alias("section_key"), *own, F.substring("text", 1, SECTION_CHARS).alias("section_text"))
    rows = route(fields, store, without_self, by).join(text, ["section_key", *own], "left").fillna("", ["section_text"])
    rows = rows.withColumn("near", F.coalesce(F.col("score") >= threshold, F.lit(False)))
    asked = decider.decide(
        rows, "field_match", {"field_name": F.col("name"), "field_value": F.col("value"), "section_text": F.col("section_text")}, "d",
        F.col("near")
    )
    far = F.format_string("No closely matching section found (best match: '%s', similarity=%.2f).", "section_heading", "score")
    reason = F.when(F.col("near"), F.coalesce("d.reason", F.lit("Comparison error"))).when(
        F.col("score").isNull(), "No sections found in the legal document."
    ).otherwise(far)
    key, heading = F.col("section_key").cast("string"), F.col("section_heading")
    shown = lambda c: F.when(F.col("near"), c).otherwise(F.coalesce(c, F.lit("—")))
    return asked.select(
        "seq", *own, "name", "value", shown(key).alias("section_key"), shown(heading).alias("section_heading"),
        F.col("d.match").alias("match"), reason.alias("reason")
    )
