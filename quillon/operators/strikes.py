"""Struck-out text: lines drawn through words, the characters under them, and the text that is left.

drawings: doc_id, page, drawing_id, x0, y0, x1, y1, color, fill (arrays). words: doc_id, page, x0, y0, x1, y1, word. chars: doc_id,
page, seq, x0, y0, x1, y1, c, font_size, span_color. All joins are equi-joins on the page with the geometry as a
residual condition, so a page's shapes meet on one executor and no others do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions import geometry as G

PAGE = ["doc_id", "page"]
#: How thin and how long a line is, how near a character's middle, and how far a redaction reaches, in font sizes.
MOST_HEIGHT, LEAST_RATIO, NEAR, ABOVE, BELOW = 3.0, 3, 0.6, 0.85, 0.45


def strike_lines(
    drawings: DataFrame, words: DataFrame, colour: str = "red", most_height: float = MOST_HEIGHT, padding: float = 0.0,
    near: float | None = None
) -> DataFrame:
    """The drawings that are thin, wide and of the colour (red, not_blue or any), and run through the middle of a word.

    A word counts if its box meets the line's and the line's middle lies between its top and bottom, widened by padding, or, if
    near is given, within near of the word's own middle.
    """
    rgb = G.rgb(F.coalesce("color", "fill"))
    wanted = {"red": G.is_red(*rgb), "not_blue": G.is_red(*rgb) & ~G.is_blue(*rgb), "any": F.lit(True)}[colour]
    height, width = F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0")
    lines = drawings.filter((height <= most_height) & (width > height * LEAST_RATIO) & wanted)
    a = lines.select(
        *PAGE, "drawing_id", *(F.col(k).alias(f"a_{k}") for k in ("x0", "y0", "x1", "y1"))
    ).withColumn("_mid", G.middle(F.col("a_y0"), F.col("a_y1"))).alias("a")
    b = words.select(F.col("doc_id").alias("b_doc"), F.col("page").alias("b_page"), *(F.col(k).alias(f"b_{k}") for k in ("x0", "y0", "x1", "y1")))
    inside = (F.col("b_y0") - padding < F.col("_mid")) & (F.col("_mid") < F.col("b_y1") + padding)
    if near is not None:
        inside = F.abs(F.col("_mid") - G.middle(F.col("b_y0"), F.col("b_y1"))) < near
    struck = a.join(b, (F.col("doc_id") == F.col("b_doc")) & (F.col("page") == F.col("b_page")) & G.intersects("a", "b") & inside, "left_semi")
    return struck.select(*PAGE, "drawing_id", *(F.col(f"a_{k}").alias(k) for k in ("x0", "y0", "x1", "y1")))


def redactions(lines: DataFrame, chars: DataFrame) -> DataFrame:
    """For each strike line, the box over the red characters under it, and the line itself: doc_id, page, drawing_id, kind, x0, y0, x1, y1."""
    red = chars.filter(G.is_red(*G.unpacked(F.col("span_color")))).select(
        *PAGE, F.col("x0").alias("cx0"), F.col("x1").alias("cx1"), G.middle(F.col("y0"), F.col("y1")).alias("cmid"), "font_size"
    )
    mid = G.middle(F.col("y0"), F.col("y1"))
    under = (F.col("cx0") < F.col("x1")) & (F.col("cx1") > F.col("x0")) & (F.abs(F.col("cmid") - mid) < F.col("font_size") * NEAR)
    met = lines.join(red, PAGE).filter(under)
    boxes = met.groupBy(*PAGE, "drawing_id").agg(F.min("cx0").alias("x0"), F.max("cx1").alias("x1"), F.avg("font_size").alias("size"), F.max(mid).alias("mid"))
    boxes = boxes.select(
        *PAGE, "drawing_id", F.lit("text").alias("kind"), "x0", (F.col("mid") - F.col("size") * ABOVE).alias("y0"), "x1",
        (F.col("mid") + F.col("size") * BELOW).alias("y1")
    )
    return boxes.unionByName(lines.select(*PAGE, "drawing_id", F.lit("line").alias("kind"), "x0", "y0", "x1", "y1"))


def text_without_strikes(chars: DataFrame, lines: DataFrame) -> DataFrame:
    """doc_id, page, text: the characters that no line strikes; a line end where the top moves by more than 2."""
    sides = lines.select(F.col("doc_id").alias("l_doc"), F.col("page").alias("l_page"), *(F.col(k).alias(f"l_{k}") for k in ("x0", "y0", "x1", "y1")))
    mid = G.middle(F.col("y0"), F.col("y1"))
    struck = (F.col("doc_id") == F.col("l_doc")) & (F.col("page") == F.col("l_page")) & (F.col("x0") < F.col("l_x1")) & (F.col("x1") > F.col("l_x0")) & (F.col("l_y0") - 2 < mid) & (mid < F.col("l_y1") + 2)
    left = chars.join(sides, struck, "left_anti").withColumn("_y", F.round("y0", 1))
    order = Window.partitionBy(*PAGE).orderBy("seq")
    broken = F.abs(F.col("_y") - F.lag("_y").over(order)) > 2
    left = left.withColumn("_c", F.concat(F.when(broken, "\n").otherwise(""), F.col("c")))
    return left.groupBy(*PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "_c"))), lambda x: x["_c"]), "").alias("text"))


def words_without_strikes(words: DataFrame, lines: DataFrame) -> DataFrame:
    """The words that no line meets."""
    a = lines.select(F.col("doc_id").alias("a_doc"), F.col("page").alias("a_page"), *(F.col(k).alias(f"a_{k}") for k in ("x0", "y0", "x1", "y1")))
    b = words.select("*", *(F.col(k).alias(f"b_{k}") for k in ("x0", "y0", "x1", "y1")))
    return b.join(a, (F.col("doc_id") == F.col("a_doc")) & (F.col("page") == F.col("a_page")) & G.intersects("a", "b"), "left_anti").select(*words.columns)
