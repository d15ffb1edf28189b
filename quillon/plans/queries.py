"""Queries over the driver's tables, one or more for each family of operators, and the same in SQL.

The tables hold prose without headings, so blocks are decorated: a rule of the line number puts numbers, schedules, terms,
fonts and page numbers in front of lines, alike here and in the SQL. That is scaffolding for tests and no part of any operator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import chunks as C
from quillon.operators import collate, gather, sections, split, strikes, vectors
from quillon.operators import definitions as D
from quillon.operators.decide import Rules
from quillon.plans import compare as compare_plan
from quillon.plans import extract as extract_plan
from quillon.plans import form_check as form_plan
from quillon.plans import report, self_rag
from quillon.sources import blocks as B
from quillon.sources import files as file_sources

SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("seq", "line"))
    return docs.withColumn("line", T.strip("line")).filter("line <> ''").withColumn("page", (F.floor(F.col("seq") / 8) + 1).cast("int"))


_LINES = """lines AS (SELECT * FROM (SELECT doc_id, i - 1 AS seq, trim(parts[i]) AS line, (i - 1) // 8 + 1 AS page
FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents), unnest(range(1, len(parts) + 1)) AS u(i)) WHERE line <> '')"""


def _n(by: int) -> Column:
    return F.floor(F.col("seq") / by).cast("int") + 1


def _numbered(rows: DataFrame) -> DataFrame:
    m = F.col("seq") % 12
    mark = F.when(m == 1, F.format_string("%d. ", _n(12))).when(m == 5, F.format_string("%d.1 ", _n(12))).when(m == 9, F.format_string("%d.1.1 ", _n(12))).otherwise("")
    return rows.select("doc_id", "seq", "page", F.concat(mark, "line").alias("text"))


_NUMBERED = f"""{_LINES}, blocks AS (SELECT doc_id, seq, page, CASE seq % 12 WHEN 1 THEN (seq // 12 + 1) || '. ' WHEN 5 THEN (seq // 12 + 1) || '.1 ' WHEN 9 THEN (seq // 12 + 1) || '.1.1 ' ELSE '' END || line AS text FROM lines)"""

_PAGES_SQL = "array_to_string(list_sort(list_distinct(list(page))), ',')"
_ORDERED = "PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


def _pages_text(df: DataFrame, column: str = "page_numbers") -> DataFrame:
    return df.withColumn(column, F.array_join(F.transform(column, lambda x: x.cast("string")), ","))


def sections_paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages_text(sections.parse_sections(_numbered(_lines(spark, sf_dir)), paged=True)).withColumn("ord", F.col("ord").cast("long"))


_NUMBER = r"rtrim(regexp_extract(text, '^(\d+(?:\.\d+)+\.?|\d+\.)\s*(.*)', 1), '.')"


def _sections_sql(key: str) -> str:
    return f"""WITH {_NUMBERED}, n AS (SELECT *, {_NUMBER} AS number FROM blocks),
k AS (SELECT *, CASE WHEN number <> '' AND len(string_split(number, '.')) <= 2 THEN {key}
  WHEN row_number() OVER (PARTITION BY doc_id ORDER BY seq) = 1 THEN CASE WHEN number <> '' THEN array_to_string(string_split(number, '.')[1:2], '.') ELSE 'preamble' END END AS start FROM n),
f AS (SELECT *, last_value(start IGNORE NULLS) OVER ({_ORDERED}) AS key FROM k)
SELECT doc_id, key, min(seq) AS ord, string_agg(text, chr(10) ORDER BY seq) AS text, {_PAGES_SQL} AS page_numbers FROM f GROUP BY doc_id, key"""


SQL["sections_paged"] = _sections_sql("number")


def sections_heading_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages_text(sections.parse_sections(_numbered(_lines(spark, sf_dir)), headings_in_key=True, paged=True)).withColumn("ord", F.col("ord").cast("long"))


SQL["sections_heading_keys"] = _sections_sql(r"CASE WHEN trim(regexp_replace(text, '^\d+(?:\.\d+)*\.?\s*', '')) <> '' THEN number || ' ' || trim(regexp_replace(text, '^\d+(?:\.\d+)*\.?\s*', '')) ELSE number END")


def _scheduled(rows: DataFrame) -> DataFrame:
    mark = F.when(F.col("seq") % 20 == 10, F.format_string("Schedule %d ", _n(20))).when(F.col("seq") % 33 == 32, F.format_string("%d. ", _n(33))).otherwise("")
    text = F.when(F.col("seq") == 70, F.lit("IN WITNESS WHEREOF")).otherwise(F.concat(mark, "line"))
    return rows.select("doc_id", "seq", "page", text.alias("text"))


_SCHEDULED = f"""{_LINES}, blocks AS (SELECT doc_id, seq, page, CASE WHEN seq = 70 THEN 'IN WITNESS WHEREOF' WHEN seq % 20 = 10 THEN 'Schedule ' || (seq // 20 + 1) || ' ' || line
  WHEN seq % 33 = 32 THEN (seq // 33 + 1) || '. ' || line ELSE line END AS text FROM lines)"""


def _schedules_sql(stop: str, rows: str = "blocks") -> str:
    return rf"""WITH {_SCHEDULED}, s AS (SELECT *, nullif(regexp_extract(text, '^(?i)schedule\s+(\d+)\b', 1), '') AS schedule FROM {rows}),
t AS (SELECT *, ({stop}) AND count(schedule) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 AS stop FROM s),
e AS (SELECT *, min(CASE WHEN stop THEN seq END) OVER (PARTITION BY doc_id) AS end_seq FROM t),
f AS (SELECT *, 'Schedule ' || last_value(schedule IGNORE NULLS) OVER ({_ORDERED}) AS key FROM e WHERE end_seq IS NULL OR seq < end_seq)
SELECT doc_id, key, min(seq) AS ord, string_agg(text, chr(10) ORDER BY seq) AS text, {_PAGES_SQL} AS page_numbers FROM f WHERE key IS NOT NULL GROUP BY doc_id, key"""


_EXECUTION_SQL = r"regexp_matches(text, '^(?i)(?:signed|executed|in\s+witness|signator|authoris|authoriz|annex)')"


def schedules_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages_text(sections.parse_schedules(_scheduled(_lines(spark, sf_dir)), paged=True)).withColumn("ord", F.col("ord").cast("long"))


SQL["schedules_stop"] = _schedules_sql(_EXECUTION_SQL)


def schedules_stop_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sections.parse_schedules(_scheduled(_lines(spark, sf_dir)), stop_on_numbered_section=True, paged=True)
    return _pages_text(found).withColumn("ord", F.col("ord").cast("long"))


SQL["schedules_stop_numbered"] = _schedules_sql(rf"{_EXECUTION_SQL} OR ({_NUMBER} <> '' AND len(string_split({_NUMBER}, '.')) = 1)")


def second_half_schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages_text(sections.second_half_schedules(_scheduled(_lines(spark, sf_dir)))).withColumn("ord", F.col("ord").cast("long"))


SQL["second_half_schedules"] = _schedules_sql(r"regexp_matches(text, '^(?i)in\s+witness\s+whereof')", "(SELECT *, max(page) OVER (PARTITION BY doc_id) AS n FROM blocks) WHERE page - 1 >= ceil(n / 2)")


def definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    term = F.concat(F.format_string('"Term %d" means ', (_n(5) - 1) % 6 + 1), "line")
    text = F.when(F.col("seq") == 1, F.lit("1.1 Definitions")).when(F.col("seq") == 40, F.lit("1.2 Interpretation")).when(F.col("seq") % 5 == 2, term).otherwise(F.col("line"))
    blocks = _lines(spark, sf_dir).select("doc_id", "seq", "page", text.alias("text"))
    return D.definitions(blocks).withColumn("ord", F.col("ord").cast("long"))


SQL["definitions"] = rf"""WITH {_LINES}, blocks AS (SELECT doc_id, seq, CASE WHEN seq = 1 THEN '1.1 Definitions' WHEN seq = 40 THEN '1.2 Interpretation'
  WHEN seq % 5 = 2 THEN '"Term ' || ((seq // 5) % 6 + 1) || '" means ' || line ELSE line END AS text FROM lines),
h AS (SELECT *, regexp_matches(text, '(?i)definitions?\s+and\s+interpret|\bdefinitions?\s*$') AS heading FROM blocks),
b AS (SELECT *, min(CASE WHEN heading THEN seq END) OVER (PARTITION BY doc_id) AS s0 FROM h),
d AS (SELECT *, first_value(regexp_matches(text, '^\d+\.\d+')) OVER (PARTITION BY doc_id ORDER BY seq) AS deep FROM b WHERE seq >= s0),
e AS (SELECT *, min(CASE WHEN seq > s0 AND NOT heading AND (regexp_matches(text, '^\d+\.\s') OR (deep AND regexp_matches(text, '^\d+\.\d+'))) THEN seq END) OVER (PARTITION BY doc_id) AS s1 FROM d),
t AS (SELECT doc_id, seq, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text, nullif(regexp_extract(text, '^["“‘«]([A-Z][^"“”‘’«»]+?)["”’»]', 1), '') AS found FROM e WHERE seq > s0 AND (s1 IS NULL OR seq < s1)),
f AS (SELECT *, last_value(found IGNORE NULLS) OVER ({_ORDERED}) AS term, count(found) OVER ({_ORDERED}) AS run FROM t),
r AS (SELECT doc_id, term, run, min(seq) AS seq, string_agg(text, ' ' ORDER BY seq) AS text FROM f WHERE run > 0 GROUP BY ALL)
SELECT doc_id, term, arg_max(text, run) AS text, min(seq) AS ord FROM r GROUP BY doc_id, term"""


def infer_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).select("doc_id", "seq", F.col("line").alias("text"))
    return C.infer_sections(rows).groupBy("doc_id", "section").agg(F.count(F.lit(1)).alias("paragraphs"), F.min("seq").cast("long").alias("first"))


SQL["infer_sections"] = rf"""WITH {_LINES}, h AS (SELECT doc_id, seq, line, CASE WHEN len(regexp_split_to_array(line, '\s+')) <= 12 AND NOT ends_with(line, '.') AND (
  (regexp_matches(line, '[\p{{Lu}}\p{{Ll}}\p{{Lt}}]') AND NOT regexp_matches(line, '(^|[^\p{{Lu}}\p{{Ll}}\p{{Lt}}])\p{{Ll}}') AND NOT regexp_matches(line, '[\p{{Lu}}\p{{Ll}}\p{{Lt}}][\p{{Lu}}\p{{Lt}}]'))
  OR (regexp_matches(line, '\p{{Lu}}') AND NOT regexp_matches(line, '[\p{{Ll}}\p{{Lt}}]')) OR regexp_matches(line, '^\d+[\.\)]\s+\w')) THEN line END AS heading FROM lines),
s AS (SELECT doc_id, seq, coalesce(last_value(heading IGNORE NULLS) OVER ({_ORDERED}), 'Introduction') AS section FROM h)
SELECT doc_id, section, count(*) AS paragraphs, min(seq) AS first FROM s GROUP BY doc_id, section"""


def _fonts(rows: DataFrame) -> DataFrame:
    return rows.select(
        "doc_id", "seq", "page", "text", F.when(F.length("text") % 7 == 0, 20.0).otherwise(12.0).alias("font_size"),
        (F.col("seq") % 9 == 4).alias("is_bold")
    )


_FONT_CHUNKS = f"""{_NUMBERED}, fonts AS (SELECT *, CASE WHEN length(text) % 7 = 0 THEN 20.0 ELSE 12.0 END AS font_size, seq % 9 = 4 AS is_bold FROM blocks),
marked AS (SELECT *, font_size > 1.1 * median(font_size) OVER (PARTITION BY doc_id) OR (is_bold AND length(text) < 120) AS is_heading FROM fonts),
runs AS (SELECT *, sum(is_heading::INT) OVER ({_ORDERED}) AS run FROM marked),
grouped AS (SELECT doc_id, run, coalesce(max(CASE WHEN is_heading THEN text END), '') AS heading, coalesce(string_agg(CASE WHEN NOT is_heading THEN text END, chr(10) ORDER BY seq), '') AS content,
  list_sort(list_distinct(list(page))) AS pages, arg_min(page, seq) AS start_page FROM runs GROUP BY doc_id, run),
chunks AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY run) - 1 AS chunk_id, * EXCLUDE (doc_id) FROM grouped)"""
_LEVEL_SQL = r"coalesce(len(string_split(nullif(regexp_extract(heading, '^(\d+(?:\.\d+)*)\s*\.?\s', 1), ''), '.')), 0)"


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.chunk_by_section(C.detect_headings(_fonts(_numbered(_lines(spark, sf_dir)))))


def font_headings_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pages_text(_chunks(spark, sf_dir), "pages")
    return rows.select(
        "doc_id", F.col("chunk_id").cast("long").alias("chunk_id"), "heading", "content", "pages",
        F.col("start_page").cast("long").alias("start_page"), F.col("heading_level").cast("long").alias("heading_level")
    )


SQL["font_headings_chunks"] = f"WITH {_FONT_CHUNKS} SELECT doc_id, chunk_id, heading, content, array_to_string(pages, ',') AS pages, start_page, {_LEVEL_SQL} AS heading_level FROM chunks"


def _anchored(sql: str) -> str:
    return rf"""WITH {_FONT_CHUNKS}, a AS (SELECT doc_id, chunk_id AS anchor_id, heading AS a_heading FROM chunks),
j AS (SELECT c.*, anchor_id, a_heading, trim(regexp_replace(heading, '\s*\(part \d+\)\s*$', '')) AS base, trim(regexp_replace(a_heading, '\s*\(part \d+\)\s*$', '')) AS a_base,
  nullif(regexp_extract(heading, '^(\d+(?:\.\d+)*)\s*\.?\s', 1), '') AS number, nullif(regexp_extract(a_heading, '^(\d+(?:\.\d+)*)\s*\.?\s', 1), '') AS a_number FROM chunks c JOIN a USING (doc_id)),
{sql}"""


def _anchors(chunks: DataFrame) -> DataFrame:
    """Every chunk of every document."""
    return chunks.select("doc_id", F.col("chunk_id").alias("anchor_id"))


def _gathered(rows: DataFrame) -> DataFrame:
    return rows.groupBy("doc_id", "anchor_id").agg(
        F.min("chunk_id").cast("long").alias("first_chunk"), F.max("chunk_id").cast("long").alias("last_chunk"),
        F.count(F.lit(1)).alias("chunks")
    ).withColumn("anchor_id", F.col("anchor_id").cast("long"))


def gather_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir)
    return _gathered(gather.gather_full_section(chunks, _anchors(chunks)))


_BELOW = "coalesce(number = a_number OR starts_with(number, a_number || '.'), false)"


def _gather_sql(stops: str, holds: str) -> str:
    return _anchored(f"""w AS (SELECT *, min(CASE WHEN chunk_id > anchor_id AND ({stops}) THEN chunk_id END) OVER x AS hi, max(CASE WHEN chunk_id < anchor_id AND NOT ({holds}) THEN chunk_id END) OVER x AS lo FROM j WINDOW x AS (PARTITION BY doc_id, anchor_id))
SELECT doc_id, anchor_id, min(chunk_id) AS first_chunk, max(chunk_id) AS last_chunk, count(*) AS chunks FROM w
WHERE CASE WHEN a_number IS NOT NULL THEN chunk_id > coalesce(lo, -1) AND (hi IS NULL OR chunk_id < hi) ELSE base = a_base END GROUP BY doc_id, anchor_id""")


SQL["gather_section"] = _gather_sql(f"number IS NOT NULL AND NOT {_BELOW} AND base <> a_base", "base = a_base")


def gather_section_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir)
    return _gathered(gather.gather_full_section(chunks, _anchors(chunks), version=1))


SQL["gather_section_v1"] = _gather_sql(f"number IS NOT NULL AND NOT {_BELOW}", f"base = a_base OR {_BELOW}")


def walk_from_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir)
    return _gathered(gather.walk_from_anchor(chunks, _anchors(chunks)))


SQL["walk_from_anchor"] = _anchored(r"""t AS (SELECT *, nullif(regexp_extract(trim(heading), '^(\d+)[\.\s]', 1), '') AS top, nullif(regexp_extract(trim(a_heading), '^(\d+)[\.\s]', 1), '') AS a_top FROM j),
w AS (SELECT *, min(CASE WHEN chunk_id > anchor_id AND (coalesce(top <> a_top, false) OR (top IS NULL AND heading <> '' AND heading NOT LIKE '(%' AND length(trim(heading)) < 80 AND chunk_id > anchor_id + 1)) THEN chunk_id END) OVER (PARTITION BY doc_id, anchor_id) AS hi FROM t)
SELECT doc_id, anchor_id, min(chunk_id) AS first_chunk, max(chunk_id) AS last_chunk, count(*) AS chunks FROM w WHERE chunk_id >= anchor_id AND (hi IS NULL OR chunk_id < hi) GROUP BY doc_id, anchor_id""")


def search_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = C.with_parent_heading(_chunks(spark, sf_dir))
    return _gathered(gather.search_section(chunks, _anchors(chunks)))


_ANY_LEVEL = r"CASE WHEN regexp_matches(trim({0}), '^\d+') THEN len(list_filter(string_split(regexp_extract(trim({0}), '^([\d.]+)', 1), '.'), lambda p: regexp_full_match(p, '\d+'))) ELSE 1 END"
SQL["search_section"] = _anchored(f"""s AS (SELECT *, min(CASE WHEN heading = a_heading THEN chunk_id END) OVER (PARTITION BY doc_id, anchor_id) AS s0 FROM j),
e AS (SELECT *, min(CASE WHEN heading <> a_heading AND chunk_id > s0 AND ({_ANY_LEVEL.format("heading")}) <= ({_ANY_LEVEL.format("a_heading")}) THEN chunk_id END) OVER (PARTITION BY doc_id, anchor_id) AS hi FROM s)
SELECT doc_id, anchor_id, min(chunk_id) AS first_chunk, max(chunk_id) AS last_chunk, count(*) AS chunks FROM e WHERE chunk_id >= s0 AND (hi IS NULL OR chunk_id < hi) GROUP BY doc_id, anchor_id""")


def merged_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir)
    merged = gather.merge_chunks(gather.gather_full_section(chunks, _anchors(chunks)))
    return _pages_text(merged, "pages").select(
        "doc_id", F.col("anchor_id").cast("long").alias("anchor_id"), "heading", "content", "pages",
        F.col("chunk_id").cast("long").alias("chunk_id")
    )


SQL["merged_sections"] = SQL["gather_section"].split("SELECT doc_id, anchor_id, min(chunk_id)")[0] + r"""SELECT doc_id, anchor_id, arg_min(base, chunk_id) AS heading,
trim(string_agg(CASE WHEN heading <> '' AND NOT contains(heading, '(part ') THEN chr(10) || heading || chr(10) || content ELSE content END, chr(10) ORDER BY chunk_id), ' ' || chr(10)) AS content,
array_to_string(list_sort(list_distinct(flatten(list(pages)))), ',') AS pages, min(chunk_id) AS chunk_id FROM w
WHERE CASE WHEN a_number IS NOT NULL THEN chunk_id > coalesce(lo, -1) AND (hi IS NULL OR chunk_id < hi) ELSE base = a_base END GROUP BY doc_id, anchor_id"""


def toc_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = _numbered(_lines(spark, sf_dir))
    decided = blocks.filter("(doc_id % 2 = 0 and page <= 3) or (doc_id % 3 = 0 and page in (1, 9))").select("doc_id", "page").distinct()
    return C.drop_toc_blocks(blocks, decided).groupBy("doc_id").agg(F.count(F.lit(1)).alias("blocks"), F.min("page").cast("long").alias("first_page"))


SQL["toc_filter"] = f"""WITH {_NUMBERED}, d AS (SELECT DISTINCT doc_id, page FROM blocks WHERE (doc_id % 2 = 0 AND page <= 3) OR (doc_id % 3 = 0 AND page IN (1, 9))),
ok AS (SELECT doc_id FROM d GROUP BY doc_id HAVING count(*) <= 5 AND max(page) - min(page) <= 5)
SELECT doc_id, count(*) AS blocks, min(page) AS first_page FROM blocks b WHERE NOT EXISTS (SELECT 1 FROM d JOIN ok USING (doc_id) WHERE d.doc_id = b.doc_id AND d.page = b.page) GROUP BY doc_id"""


def docx_page_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("seq"), "text", (F.col("role") == "user").cast("int").alias("breaks")
    )
    return B.paged_paragraphs(rows).groupBy("doc_id", F.col("page").cast("long").alias("page")).agg(
        F.count(F.lit(1)).alias("paragraphs"), F.sum(F.length("text")).alias("chars")
    )


SQL["docx_page_breaks"] = r"""WITH p AS (SELECT conv_id AS doc_id, turn AS seq, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text,
1 + sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS page FROM conversations)
SELECT doc_id, page::BIGINT AS page, count(*) AS paragraphs, sum(length(text))::BIGINT AS chars FROM p WHERE length(text) > 30 GROUP BY doc_id, page"""


def pages_as_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).select("doc_id", "seq", "page", F.col("line").alias("text"))
    return B.pages_as_documents(rows).withColumn("page", F.col("page").cast("long"))


SQL["pages_as_documents"] = f"WITH {_LINES} SELECT doc_id, page, string_agg(line, chr(10) ORDER BY seq) AS page_content FROM lines GROUP BY doc_id, page"


def form_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    name = F.when(k % 10 == 0, F.lit("SECTION A")).when(k % 10 == 1, F.lit("  ")).when(k % 10 == 2, F.lit("TERMS OF LOAN")).otherwise(F.concat(F.lit(" Field "), k.cast("string")))
    value = F.when(k % 7 != 0, F.col("o_orderstatus"))
    cells = o.select(
        (k % 100).alias("doc_id"), F.lit(1).alias("page"), F.lit(0).alias("table_no"), k.alias("row_no"),
        F.posexplode(F.array(name, value)).alias("col_no", "text")
    )
    return B.extract_form_fields(cells).select("doc_id", F.col("seq").cast("long").alias("seq"), "name", "value")


SQL["form_fields"] = """SELECT o_orderkey % 100 AS doc_id, row_number() OVER (PARTITION BY o_orderkey % 100 ORDER BY o_orderkey) - 1 AS seq, 'Field ' || o_orderkey AS name, o_orderstatus AS value
FROM orders WHERE o_orderkey % 10 > 2 AND o_orderkey % 7 <> 0 AND trim(o_orderstatus) <> ''"""


def heading_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _numbered(_lines(spark, sf_dir)).select("doc_id", "seq", T.first_line("text").alias("line"))
    return rows.select(
        "doc_id", F.col("seq").cast("long").alias("seq"), F.coalesce(T.section_number("line"), F.lit("")).alias("number"), T.numbered_level("line").cast("long").alias("level"), T.any_level("line").cast("long").alias("any_level"),
        T.topic(F.lit("k"), F.col("line")).alias("topic"), T.truncated("line", 40).alias("short"), T.estimated_tokens("line").cast("long").alias("tokens"), T.is_section_label("line").alias("label"),
    )


SQL["heading_functions"] = rf"""WITH {_NUMBERED}, h AS (SELECT doc_id, seq, text, text AS heading FROM blocks)
SELECT doc_id, seq, {_NUMBER} AS number, {_LEVEL_SQL} AS level, {_ANY_LEVEL.format("heading")} AS any_level,
CASE WHEN trim(regexp_replace(text, '^\d+(\.\d+)*\.?\s*', '')) <> '' THEN trim(regexp_replace(text, '^\d+(\.\d+)*\.?\s*', '')) ELSE text END AS topic,
CASE WHEN length(text) <= 40 THEN text ELSE rtrim(left(text, 40)) || '…' END AS short, greatest(1, length(text) // 4) AS tokens,
upper(text) LIKE 'SECTION %' OR upper(text) LIKE 'PART %' OR (length(text) > 4 AND text = upper(text) AND NOT contains(text, ':') AND NOT contains(text, '/')) AS label FROM h"""


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"), "label")


_COS = "round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6)"


def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _embeddings(spark, sf_dir)
    queries = store.filter("key % 100 = 0").select(F.col("key").alias("query_id"), "vector")
    return vectors.top_k(store, queries, 10).withColumn("rank", F.col("rank").cast("long"))


SQL["knn_topk"] = f"""SELECT * FROM (SELECT q.vec_id AS query_id, e.vec_id AS key, {_COS} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, e.vec_id) AS rank
FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0) WHERE rank <= 10"""


def knn_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _embeddings(spark, sf_dir)
    store = rows.withColumn("key", F.format_string("K%06d [%d/5]", F.floor(F.col("key") / 5), F.col("key") % 5 + 1))
    queries = rows.filter("key % 100 = 0").select(F.col("key").alias("query_id"), "vector")
    return vectors.search(store, queries, 5).withColumn("rank", F.col("rank").cast("long"))


SQL["knn_dedup"] = f"""WITH h AS (SELECT q.vec_id AS query_id, printf('K%06d [%d/5]', e.vec_id // 5, e.vec_id % 5 + 1) AS key, e.vec_id // 5 AS base, {_COS} AS score FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS r FROM h), d AS (SELECT *, row_number() OVER (PARTITION BY query_id, base ORDER BY score DESC, r) AS n FROM t WHERE r <= 20),
f AS (SELECT query_id, key, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, r) AS rank FROM d WHERE n = 1) SELECT * FROM f WHERE rank <= 5"""


def multi_query_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _embeddings(spark, sf_dir)
    queries = store.filter("key % 100 = 0").select(F.col("key").alias("query_id"), "vector")
    hits = vectors.top_k(store, queries, 5).withColumn("question", F.col("query_id") % 3)
    return vectors.merge_queries(hits, "key", ["question"]).withColumn("rank", F.col("rank").cast("long"))


SQL["multi_query_merge"] = f"""WITH h AS (SELECT q.vec_id AS query_id, e.vec_id AS key, {_COS} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, e.vec_id) AS r FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0),
m AS (SELECT query_id % 3 AS question, key, max(score) AS score FROM h WHERE r <= 5 GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, key) AS rank FROM m"""


def anchor_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir).withColumn("content_length", F.length("content"))
    best = vectors.pick_anchor(chunks, ["doc_id"], "chunk_id")
    return best.select("doc_id", F.col("chunk_id").cast("long").alias("chunk_id"), F.round("anchor_score", 6).alias("anchor_score"))


SQL["anchor_pick"] = rf"""WITH {_FONT_CHUNKS}, s AS (SELECT doc_id, chunk_id, CASE WHEN regexp_matches(trim(heading), '^\d+') THEN 2.0::DOUBLE ELSE 0 END + least(length(content) / 500::DOUBLE, 3) - CASE WHEN length(content) < 100 THEN 2.0 ELSE 0 END AS sc FROM chunks)
SELECT doc_id, chunk_id, round(sc, 6) AS anchor_score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sc DESC, chunk_id) AS n FROM s) WHERE n = 1"""


_VECTOR = "list_transform(range(1, 32, 2), lambda k: ('0x' || substr(md5({0}), k, 2))::INT / 127.5 - 1)"
_COS_V = "round(list_cosine_similarity(q.v::DOUBLE[], c.v::DOUBLE[]), 6)"


def _asked(texts: tuple[str, ...]) -> str:
    values = ", ".join(f"({i}, '{t}')" for i, t in enumerate(texts))
    full = "regexp_replace(heading || chr(10) || content, '^\\s+|\\s+$', '', 'g')"
    return f"""WITH {_FONT_CHUNKS}, q AS (SELECT query_id, term, {_VECTOR.format("term")} AS v FROM (VALUES {values}) AS t(query_id, term)),
c AS (SELECT *, {_VECTOR.format(full)} AS v FROM chunks),
hits AS (SELECT query_id, doc_id, chunk_id, {_COS_V} AS score, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY {_COS_V} DESC, chunk_id) AS rank FROM c, q)"""


def extract_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's definitions section by retrieval among its own chunks, with vectors that have no meaning."""
    found = extract_plan.extract_definitions(_chunks(spark, sf_dir), vectors.digest_embedder())
    return _pages_text(found, "pages").select("doc_id", F.col("anchor_id").cast("long").alias("anchor_id"), "heading", "content", "pages")


SQL["extract_definitions"] = _asked(extract_plan.DEFINITION_QUERIES) + r""",
s AS (SELECT doc_id, chunk_id AS anchor_id, heading AS a_heading, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN regexp_matches(trim(heading), '^\d+') THEN 2.0::DOUBLE ELSE 0 END + least(length(content) / 500::DOUBLE, 3) - CASE WHEN length(content) < 100 THEN 2.0 ELSE 0 END DESC, start_page, chunk_id) AS n
FROM chunks SEMI JOIN (SELECT * FROM hits WHERE rank <= 10) USING (doc_id, chunk_id)),
t AS (SELECT c.*, anchor_id, a_heading, nullif(regexp_extract(trim(heading), '^(\d+)[\.\s]', 1), '') AS top, nullif(regexp_extract(trim(a_heading), '^(\d+)[\.\s]', 1), '') AS a_top FROM chunks c JOIN (SELECT * FROM s WHERE n = 1) USING (doc_id)),
w AS (SELECT *, min(CASE WHEN chunk_id > anchor_id AND (coalesce(top <> a_top, false) OR (top IS NULL AND heading <> '' AND heading NOT LIKE '(%' AND length(trim(heading)) < 80 AND chunk_id > anchor_id + 1)) THEN chunk_id END) OVER (PARTITION BY doc_id) AS hi FROM t)
SELECT doc_id, anchor_id, any_value(a_heading) AS heading, string_agg(regexp_replace(heading || chr(10) || content, '^\s+|\s+$', '', 'g'), chr(10) || chr(10) ORDER BY chunk_id) AS content,
array_to_string(list_sort(list_distinct(flatten(list(pages)))), ',') AS pages FROM w WHERE chunk_id >= anchor_id AND (hi IS NULL OR chunk_id < hi) GROUP BY doc_id, anchor_id"""


def section_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document searched by itself."""
    index = extract_plan.SectionIndex(C.with_parent_heading(_chunks(spark, sf_dir)), vectors.digest_embedder())
    found = _pages_text(index.search("Interest Rate"), "pages")
    return found.select("doc_id", "heading", "content", "pages", F.array_join(F.transform("chunk_ids", lambda x: x.cast("string")), ",").alias("chunk_ids"))


SQL["section_index_search"] = _asked(("Interest Rate",)) + rf""",
a AS (SELECT doc_id, chunk_id AS anchor_id, heading AS a_heading FROM hits JOIN chunks USING (doc_id, chunk_id) WHERE rank = 1),
j AS (SELECT c.*, anchor_id, a_heading FROM chunks c JOIN a USING (doc_id)),
s AS (SELECT *, min(CASE WHEN heading = a_heading THEN chunk_id END) OVER (PARTITION BY doc_id) AS s0 FROM j),
e AS (SELECT *, min(CASE WHEN heading <> a_heading AND chunk_id > s0 AND ({_ANY_LEVEL.format("heading")}) <= ({_ANY_LEVEL.format("a_heading")}) THEN chunk_id END) OVER (PARTITION BY doc_id) AS hi FROM s)
SELECT doc_id, any_value(a_heading) AS heading, string_agg(content, chr(10) || chr(10) ORDER BY start_page, chunk_id) AS content, array_to_string(list_sort(list_distinct(flatten(list(pages)))), ',') AS pages,
string_agg(chunk_id::VARCHAR, ',' ORDER BY start_page, chunk_id) AS chunk_ids FROM e WHERE chunk_id >= s0 AND (hi IS NULL OR chunk_id < hi) GROUP BY doc_id"""


def extract_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The section that a query names, for each document. Its candidates, verification and choice are tested by brute force."""
    chunks = C.with_parent_heading(_chunks(spark, sf_dir))
    found = extract_plan.extract_section(chunks, "the", vectors.digest_embedder(), Rules())
    return _pages_text(found, "pages").select("doc_id", "heading", "content", "pages", F.col("chunk_id").cast("long").alias("chunk_id"), "verified", "output")


_TERMS = ("er", "the", "sch", "que", "ing")


def multi_term_collate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text", "source")
    terms = spark.createDataFrame([*enumerate(_TERMS)], "query_id int, term string")
    count = lambda t: (F.length("text") - F.length(F.replace("text", F.lit(t), F.lit("")))) / len(t)
    per_term = F.array(*(F.struct(F.lit(i).alias("query_id"), F.least(F.lit(1.0), F.round(count(t) / 50.0, 6)).alias("score")) for i, t in enumerate(_TERMS)))
    hits = docs.select("chunk_id", F.explode(per_term).alias("h")).select("h.query_id", "chunk_id", "h.score")
    ranked = collate.gather_relevant(hits, terms)
    return ranked.select("chunk_id", "best", F.array_join("terms", ",").alias("terms"), F.round("score", 6).alias("score"))


SQL["multi_term_collate"] = f"""WITH t AS (SELECT unnest({list(_TERMS)!r}) AS term), h AS (SELECT doc_id AS chunk_id, term, least(1.0, round(((length(text) - length(replace(text, term, ''))) / length(term)::DOUBLE) / 50.0, 6))::DOUBLE AS score FROM documents, t)
SELECT chunk_id, max(score) AS best, string_agg(term, ',' ORDER BY term) AS terms, round(max(score) * sqrt(count(*)), 6) AS score FROM h WHERE score >= 0.35 GROUP BY chunk_id"""


def collated_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir).withColumn("chunk_key", F.col("doc_id") * 1000 + F.col("chunk_id"))
    ranked = chunks.select(
        "doc_id", "chunk_key", (F.col("chunk_id") + 1).alias("rank"),
        F.array(F.concat(F.lit("t"), (F.col("chunk_id") % 3).cast("string"))).alias("terms")
    )
    found = collate.collate(ranked, chunks.drop("doc_id"), key="chunk_key", by=["doc_id"])
    return _pages_text(found, "pages").select(
        "doc_id", "heading", "pages", F.array_join("matched_terms", ",").alias("terms"), "excerpt", F.col("ord").cast("long").alias("ord")
    )


SQL["collated_sections"] = rf"""WITH {_FONT_CHUNKS}, r AS (SELECT doc_id, chunk_id, trim(regexp_replace(heading, '\s*\(part \d+\)\s*$', '')) AS section, pages, 't' || (chunk_id % 3) AS term,
trim(heading || chr(10) || content, ' ' || chr(10)) AS text, pages[1] AS first_page FROM chunks WHERE chunk_id < 25),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, section, text ORDER BY first_page, chunk_id) AS n FROM r),
g AS (SELECT doc_id, section AS heading, array_to_string(list_sort(list_distinct(flatten(list(pages)))), ',') AS pages, string_agg(DISTINCT term, ',' ORDER BY term) AS terms,
string_agg(CASE WHEN n = 1 THEN text END, chr(10) || chr(10) ORDER BY first_page, chunk_id) AS excerpt, min(first_page) AS fp, min(chunk_id) AS mc FROM o GROUP BY doc_id, section)
SELECT doc_id, heading, pages, terms, excerpt, row_number() OVER (PARTITION BY doc_id ORDER BY fp, mc) AS ord FROM g"""


def form_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row is a field and a section, but not its own."""
    rows = _embeddings(spark, sf_dir)
    heads = rows.withColumn("heading", F.concat(F.lit("Heading "), F.col("key").cast("string")))
    fields = rows.select(
        F.col("key").alias("seq"), F.concat(F.lit("f"), F.col("key").cast("string")).alias("name"),
        (F.col("label").cast("string")).alias("value"), "vector"
    )
    texts = rows.select("key", F.concat(F.lit("label "), F.col("label").cast("string")).alias("text"))
    out = form_plan.check_fields(fields, heads, texts, Rules(), without_self=True)
    return out.select("seq", "name", F.col("section_key").cast("string").alias("section_key"), T.match_label("match").alias("result"))


SQL["form_route"] = f"""WITH h AS (SELECT q.vec_id AS seq, 'f' || q.vec_id AS name, q.label AS value, e.vec_id AS section_key, e.label AS text_label, {_COS} AS score,
row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, e.vec_id) AS r FROM embeddings q, embeddings e WHERE q.vec_id <> e.vec_id)
SELECT seq, name, section_key::VARCHAR AS section_key, CASE WHEN score < 0.45 THEN 'Unmatched' WHEN contains('label ' || text_label, value::VARCHAR) THEN 'Match' ELSE 'Deviation' END AS result FROM h WHERE r = 1"""


def _pages_with_vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every row is a page: one in twenty of the compared document, the others of the base document; a row without text is an empty page."""
    texts = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.col("text").alias("content"))
    rows = _embeddings(spark, sf_dir).join(texts, "key", "left").withColumn("content", F.coalesce("content", F.lit(""))).withColumn("page", (F.col("key") % 50 + 1).cast("int")).withColumn("pair", F.col("label"))
    return rows.filter("key % 20 = 0").withColumnRenamed("key", "item_no"), rows.filter("key % 20 <> 0")


def _compared(out: DataFrame) -> DataFrame:
    return out.select(
        "item_no", "section", F.col("base_page").cast("long").alias("base_page"), F.col("compare_page").cast("long").alias("compare_page"),
        "base_paragraph", "deviation", "deviation_type", F.col("score").cast("long").alias("score"), "severity", "comments"
    )


def compare_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, base = _pages_with_vectors(spark, sf_dir)
    return _compared(compare_plan.compare_pages(items, base, Rules()))


def _compare_sql(pair: str) -> str:
    return rf"""WITH r AS (SELECT vec_id, embedding, label, coalesce(text, '') AS text, vec_id % 50 + 1 AS page FROM embeddings LEFT JOIN documents ON doc_id = vec_id),
h AS (SELECT q.vec_id AS item_no, q.page AS compare_page, q.text AS ct, e.page AS bp, e.text AS bt, {_COS} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, e.vec_id) AS r FROM r q, r e WHERE q.vec_id % 20 = 0 AND e.vec_id % 20 <> 0{pair}),
a AS (SELECT vec_id AS item_no, page AS compare_page, text AS ct, bp, bt, score FROM r LEFT JOIN (SELECT * FROM h WHERE r = 1) ON item_no = vec_id WHERE vec_id % 20 = 0),
c AS (SELECT *, regexp_replace(bt, '^\s+|\s+$', '', 'g') AS stripped, len(string_split_regex(regexp_replace(ct, '^\s+|\s+$', '', 'g'), '\s+')) >= 5 AS needs FROM a),
w AS (SELECT *, CASE WHEN stripped <> '' THEN stripped ELSE bt END AS st FROM c),
d AS (SELECT *, coalesce(needs AND score >= 0.5, false) AS sure, trim(regexp_replace(st, '\s+', ' ', 'g')) <> trim(regexp_replace(ct, '\s+', ' ', 'g')) AS differs FROM w),
f AS (SELECT *, sure AND differs AS dev, CASE WHEN length(ct) > length(st) THEN 'addition' WHEN length(ct) < length(st) THEN 'omission' ELSE 'modification' END AS kind,
  least(5, 1 + floor(abs(length(st) - length(ct)) / greatest(length(st), length(ct), 1)::DOUBLE * 5))::BIGINT AS sc,
  coalesce(nullif(rtrim(regexp_extract(st, '^(\d+(?:\.\d+)+\.?|\d+\.)\s*(.*)', 1), '.'), ''), 'N/A') AS sec FROM d)
SELECT item_no, CASE WHEN sure THEN sec ELSE 'N/A' END AS section, CASE WHEN sure THEN bp ELSE 0 END AS base_page, compare_page, CASE WHEN sure THEN st ELSE '' END AS base_paragraph, dev AS deviation,
CASE WHEN dev THEN kind ELSE 'none' END AS deviation_type, CASE WHEN dev THEN sc ELSE 0 END AS score, CASE WHEN NOT dev THEN 'N/A' WHEN sc >= 4 THEN 'High' WHEN sc >= 2 THEN 'Medium' ELSE 'Low' END AS severity,
CASE WHEN dev THEN kind || ': ' || length(st) || ' and ' || length(ct) || ' characters' END AS comments FROM f"""


SQL["compare_pages"] = _compare_sql("")


def compare_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many pairs of documents at once, one for each label; each is compared within itself."""
    items, base = _pages_with_vectors(spark, sf_dir)
    return _compared(compare_plan.compare_pages(items, base, Rules(), by="pair"))


SQL["compare_pairs"] = _compare_sql(" AND q.label = e.label")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    toxic = F.col("toxic") == 1
    return docs.join(labels, "doc_id").select(
        F.col("doc_id").alias("item_no"), F.col("source").alias("section"), (F.col("doc_id") % 5).alias("base_page"), (F.col("doc_id") % 3).alias("compare_page"), F.col("text").alias("base_paragraph"), F.col("lang").alias("compare_paragraph"),
        toxic.alias("deviation"), F.when(toxic, "addition").otherwise("none").alias("deviation_type"), F.when(toxic, F.col("quality") + 1).otherwise(0).alias("score"), F.lit("Low").alias("severity"), F.when(toxic, F.lit("seen")).alias("comments"),
    )


def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.deviation_rows(_items(spark, sf_dir)).select("item_no", "line")


SQL["report_rows"] = r"""WITH s AS (SELECT d.*, toxic, quality, regexp_replace(replace(text, chr(10), ' '), '^\s+|\s+$', '', 'g') AS t FROM documents d JOIN labels USING (doc_id))
SELECT doc_id AS item_no, '| ' || doc_id || ' | ' || source || ' | ' || CASE WHEN doc_id % 5 <> 0 THEN 'p.' || (doc_id % 5) ELSE '—' END || ' | ' || CASE WHEN doc_id % 3 <> 0 THEN 'p.' || (doc_id % 3) ELSE '—' END || ' | ' ||
CASE WHEN length(t) <= 250 THEN t ELSE rtrim(left(t, 250)) || '…' END || ' | ' || lang || ' | ' || CASE WHEN toxic = 1 THEN 'Yes | addition | ' || (quality + 1) || '/5 (Low) | seen' ELSE 'No | none | — | —' END || ' |' || chr(10) AS line FROM s"""


def deviation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _items(spark, sf_dir).withColumn("match", F.when(F.col("base_page") != 0, ~F.col("deviation")))
    return report.counts(rows, ["section"])


SQL["deviation_counts"] = """SELECT source AS section, count(*) FILTER (doc_id % 5 <> 0 AND toxic <> 1) AS matches, count(*) FILTER (doc_id % 5 <> 0 AND toxic = 1) AS deviations, count(*) FILTER (doc_id % 5 = 0) AS unmatched, count(*) AS total
FROM documents JOIN labels USING (doc_id) GROUP BY source"""


def _shapes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    li = _table(spark, sf_dir, "lineitem").select(
        F.floor(F.col("l_orderkey") / 40).alias("doc_id"), F.col("l_linenumber").cast("int").alias("page"), "l_orderkey", "l_partkey",
        "l_suppkey", F.col("l_quantity").cast("double").alias("q")
    )
    x0, y0 = F.col("q") * 8, (F.col("l_partkey") % 40).cast("double") * 3
    drawings = li.filter("l_suppkey % 3 = 0").select("doc_id", "page", F.col("l_orderkey").alias("drawing_id"), x0.alias("x0"), (y0 + 4).alias("y0"), (x0 + 60).alias("x1"), (y0 + 5).alias("y1"),
        F.when(F.col("l_partkey") % 4 == 0, F.array(F.lit(0.0), F.lit(0.0), F.lit(0.9))).otherwise(F.array(F.lit(0.9), F.lit(0.1), F.lit(0.1))).alias("color"), F.lit(None).cast("array<double>").alias("fill"))
    boxes = li.filter("l_suppkey % 3 <> 0").select("doc_id", "page", (F.col("l_orderkey") * 1_000_000 + F.col("l_partkey")).alias("seq"), x0.alias("x0"), y0.alias("y0"), (x0 + 30).alias("x1"), (y0 + 10).alias("y1"), F.lit("w").alias("word"),
        F.lit("c").alias("c"), F.lit(10.0).alias("font_size"), F.when(F.col("l_partkey") % 3 == 0, 0xFF0000).otherwise(0x0000FF).alias("span_color"))
    return drawings, boxes, boxes


_SHAPES = """li AS (SELECT l_orderkey // 40 AS doc_id, l_linenumber AS page, l_orderkey, l_partkey, l_suppkey, l_quantity::DOUBLE * 8 AS x0, (l_partkey % 40) * 3.0::DOUBLE AS y0 FROM lineitem),
d AS (SELECT doc_id, page, l_orderkey AS drawing_id, x0, y0 + 4 AS y0, x0 + 60 AS x1, y0 + 5 AS y1 FROM li WHERE l_suppkey % 3 = 0 AND l_partkey % 4 <> 0),
b AS (SELECT doc_id, page, l_orderkey * 1000000 + l_partkey AS seq, l_partkey, x0, y0, x0 + 30 AS x1, y0 + 10 AS y1 FROM li WHERE l_suppkey % 3 <> 0),
s AS (SELECT * FROM d WHERE EXISTS (SELECT 1 FROM b WHERE b.doc_id = d.doc_id AND b.page = d.page AND b.x0 < d.x1 AND d.x0 < b.x1 AND b.y0 < d.y1 AND d.y0 < b.y1 AND b.y0 < (d.y0 + d.y1) / 2 AND (d.y0 + d.y1) / 2 < b.y1))"""


def strike_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawings, words, _ = _shapes(spark, sf_dir)
    return strikes.strike_lines(drawings, words).withColumn("page", F.col("page").cast("long"))


SQL["strike_lines"] = f"WITH {_SHAPES} SELECT doc_id, page::BIGINT AS page, drawing_id, x0, y0, x1, y1 FROM s"


def strike_redactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawings, words, chars = _shapes(spark, sf_dir)
    return strikes.redactions(strikes.strike_lines(drawings, words), chars).withColumn("page", F.col("page").cast("long")).select(
        "doc_id", "page", "drawing_id", "kind", *(F.round(k, 6).alias(k) for k in ("x0", "y0", "x1", "y1"))
    )


SQL["strike_redactions"] = f"""WITH {_SHAPES}, m AS (SELECT s.doc_id, s.page, s.drawing_id, min(b.x0) AS x0, max(b.x1) AS x1, avg(10.0::DOUBLE) AS size, max((s.y0 + s.y1) / 2) AS mid FROM s JOIN b ON s.doc_id = b.doc_id AND s.page = b.page
AND b.l_partkey % 3 = 0 AND b.x0 < s.x1 AND b.x1 > s.x0 AND abs((b.y0 + b.y1) / 2 - (s.y0 + s.y1) / 2) < 6 GROUP BY ALL)
SELECT doc_id, page::BIGINT AS page, drawing_id, 'text' AS kind, round(x0, 6) AS x0, round(mid - size * 0.85, 6) AS y0, round(x1, 6) AS x1, round(mid + size * 0.45, 6) AS y1 FROM m
UNION ALL SELECT doc_id, page::BIGINT, drawing_id, 'line', round(x0, 6), round(y0, 6), round(x1, 6), round(y1, 6) FROM s"""


def text_without_strikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawings, words, chars = _shapes(spark, sf_dir)
    return strikes.text_without_strikes(chars, strikes.strike_lines(drawings, words)).withColumn("page", F.col("page").cast("long"))


SQL["text_without_strikes"] = f"""WITH {_SHAPES}, l AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.doc_id = b.doc_id AND s.page = b.page AND b.x0 < s.x1 AND b.x1 > s.x0 AND s.y0 - 2 < (b.y0 + b.y1) / 2 AND (b.y0 + b.y1) / 2 < s.y1 + 2)),
g AS (SELECT *, CASE WHEN abs(y0 - lag(y0) OVER (PARTITION BY doc_id, page ORDER BY seq)) > 2 THEN chr(10) ELSE '' END || 'c' AS c FROM l)
SELECT doc_id, page::BIGINT AS page, string_agg(c, '' ORDER BY seq) AS text FROM g GROUP BY doc_id, page"""


def self_rag_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "labels").select(
        (F.col("doc_id") % 50).alias("query_id"), F.col("doc_id").alias("position"),
        F.when(F.col("quality") == 1, "Fully supported").otherwise("No support").alias("support"),
        (F.col("doc_id") % 5 + 1).alias("utility")
    )
    return self_rag.best_response(rows)


SQL["self_rag_pick"] = """SELECT query_id, position, support, utility FROM (SELECT doc_id % 50 AS query_id, doc_id AS position, CASE WHEN quality = 1 THEN 'Fully supported' ELSE 'No support' END AS support, doc_id % 5 + 1 AS utility,
row_number() OVER (PARTITION BY doc_id % 50 ORDER BY quality DESC, doc_id % 5 DESC, doc_id) AS n FROM labels) WHERE n = 1"""


def override_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _numbered(_lines(spark, sf_dir))
    left, right = sections.parse_sections(rows), sections.parse_sections(rows.filter("seq >= 12"))
    return sections.merge_with_override(left, right).select("doc_id", "key", F.length("text").cast("long").alias("chars"))


SQL["override_merge"] = f"""WITH a AS ({_sections_sql("number")}), b AS ({_sections_sql("number").replace("FROM lines)", "FROM lines WHERE seq >= 12)")})
SELECT doc_id, key, length(coalesce(b.text, a.text)) AS chars FROM a FULL JOIN b USING (doc_id, key)"""


def split_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("key"), F.lit(0).alias("ord"), "text")
    return split.chunk_sections(docs).select("doc_id", "key", "piece", F.length("text").alias("chars"), F.md5("text").alias("digest"))


def named_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections under named headings (schedules, annexes), from every chunk."""
    rows = _lines(spark, sf_dir)
    mark = F.when(
        F.col("seq") % 9 == 4,
        F.concat(F.when(F.col("seq") % 2 == 0, "Schedule ").otherwise("Annex "), (F.floor(F.col("seq") / 27) + 1).cast("string"), F.lit(" "))
    ).otherwise("")
    blocks = rows.select(
        "doc_id", "seq", "page", F.concat(mark, F.substring("line", 1, 60)).alias("text"), F.lit(12.0).alias("font_size"),
        (F.col("seq") % 9 == 4).alias("is_bold")
    )
    chunks = C.chunk_by_section(C.detect_headings(blocks))
    return _gathered(gather.gather_full_section(chunks, _anchors(chunks)))


SQL["named_sections"] = rf"""WITH {_LINES}, marked AS (SELECT doc_id, seq, page, seq % 9 = 4 AS is_heading, CASE WHEN seq % 9 = 4 THEN CASE WHEN seq % 2 = 0 THEN 'Schedule ' ELSE 'Annex ' END || (seq // 27 + 1) || ' ' ELSE '' END || left(line, 60) AS text FROM lines),
runs AS (SELECT *, sum(is_heading::INT) OVER ({_ORDERED}) AS run FROM marked),
grouped AS (SELECT doc_id, run, coalesce(max(CASE WHEN is_heading THEN text END), '') AS heading FROM runs GROUP BY doc_id, run),
chunks AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY run) - 1 AS chunk_id, heading AS base, lower(nullif(regexp_extract(heading, '^(?i)(schedule|annex|appendix|exhibit|attachment|part)\s+(\w+)', 1), '')) AS kind,
  lower(nullif(regexp_extract(heading, '^(?i)(schedule|annex|appendix|exhibit|attachment|part)\s+(\w+)', 2), '')) AS own FROM grouped),
j AS (SELECT c.*, a.chunk_id AS anchor_id, a.base AS a_base, a.kind AS a_kind, a.own AS a_own FROM chunks c JOIN chunks a USING (doc_id)),
w AS (SELECT *, min(CASE WHEN chunk_id > anchor_id AND kind = a_kind AND own <> a_own THEN chunk_id END) OVER x AS hi, max(CASE WHEN chunk_id < anchor_id AND base <> a_base THEN chunk_id END) OVER x AS lo FROM j WINDOW x AS (PARTITION BY doc_id, anchor_id))
SELECT doc_id, anchor_id, min(chunk_id) AS first_chunk, max(chunk_id) AS last_chunk, count(*) AS chunks FROM w
WHERE CASE WHEN a_kind IS NOT NULL THEN chunk_id > coalesce(lo, -1) AND (hi IS NULL OR chunk_id < hi) ELSE base = a_base END GROUP BY doc_id, anchor_id"""


def heading_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval hits, and the headings that contain a term, which were not hit."""
    chunks = _chunks(spark, sf_dir).withColumn("chunk_key", F.col("doc_id") * 1000 + F.col("chunk_id"))
    terms = spark.createDataFrame([*enumerate(_TERMS)], "query_id int, term string")
    hits = chunks.filter("heading_level = 1").select((F.col("chunk_id") % 5).alias("query_id"), "chunk_key", F.lit(0.5).alias("score"))
    found = vectors.with_heading_matches(hits, vectors.heading_matches(chunks, terms, key="chunk_key"), "chunk_key")
    return found.select(F.col("query_id").cast("long").alias("query_id"), F.col("chunk_key").cast("long").alias("chunk_key"), "score")


SQL["heading_hits"] = f"""WITH {_FONT_CHUNKS}, t AS (SELECT i - 1 AS query_id, {list(_TERMS)!r}[i] AS term FROM range(1, {len(_TERMS) + 1}) AS r(i)),
h AS (SELECT chunk_id % 5 AS query_id, doc_id * 1000 + chunk_id AS chunk_key, 0.5::DOUBLE AS score FROM chunks WHERE {_LEVEL_SQL} = 1),
m AS (SELECT query_id, doc_id * 1000 + chunk_id AS chunk_key, 1.0::DOUBLE AS score FROM chunks, t WHERE contains(lower(heading), lower(term)))
SELECT * FROM h UNION ALL SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.query_id = m.query_id AND h.chunk_key = m.chunk_key)"""


def ranked_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first chunk of each heading, then what retrieval ranks, each once; and the first that is verified, or else the last."""
    chunks = _chunks(spark, sf_dir)
    named = vectors.unique_headings(chunks).filter("heading_level = 2").select("doc_id", "chunk_id", F.col("chunk_id").alias("rank"))
    semantic = chunks.select("doc_id", "chunk_id", (1000 - F.col("chunk_id")).alias("rank"))
    order = vectors.candidate_list(named, semantic)
    first = vectors.first_verified(order.withColumn("verified", F.col("chunk_id") % 4 == 2)).select("doc_id", F.col("chunk_id").alias("first"))
    return order.join(first, "doc_id").select("doc_id", *(F.col(c).cast("long").alias(c) for c in ("chunk_id", "rank", "first")))


SQL["ranked_candidates"] = rf"""WITH {_FONT_CHUNKS}, b AS (SELECT doc_id, chunk_id, {_LEVEL_SQL} AS level, trim(regexp_replace(heading, '\s*\(part \d+\)\s*$', '')) AS base FROM chunks),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, base ORDER BY chunk_id) AS n FROM b WHERE base <> '') WHERE n = 1 AND level = 2),
p AS (SELECT doc_id, chunk_id, min({{'side': side, 'rank': rank}}) AS place FROM (SELECT doc_id, chunk_id, 0 AS side, chunk_id AS rank FROM u UNION ALL SELECT doc_id, chunk_id, 1, 1000 - chunk_id FROM chunks) GROUP BY ALL),
o AS (SELECT doc_id, chunk_id, row_number() OVER (PARTITION BY doc_id ORDER BY place, chunk_id) AS rank FROM p),
f AS (SELECT doc_id, chunk_id AS first FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_id % 4 <> 2, CASE WHEN chunk_id % 4 = 2 THEN rank ELSE -rank END) AS n FROM o) WHERE n = 1)
SELECT doc_id, chunk_id, rank, first FROM o JOIN f USING (doc_id)"""


def first_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The different rows that any query hit, and the first hit of each base key in order of rank."""
    rows = _embeddings(spark, sf_dir)
    store = rows.withColumn("key", F.format_string("K%06d [%d/5]", F.floor(F.col("key") / 5), F.col("key") % 5 + 1))
    hits = vectors.top_k(store, rows.filter("key % 100 = 0").select(F.col("key").alias("query_id"), "vector"), 10)
    seen = vectors.first_seen(hits, store.withColumn("start_page", F.lit(1)), "key").select(
        F.lit(-1).cast("long").alias("query_id"), "key", F.lit(0).cast("long").alias("rank")
    )
    return seen.unionByName(vectors.deduplicate(hits, by="query_id").select("query_id", "key", F.col("rank").cast("long").alias("rank")))


SQL["first_hits"] = f"""WITH h AS (SELECT * FROM (SELECT q.vec_id AS query_id, printf('K%06d [%d/5]', e.vec_id // 5, e.vec_id % 5 + 1) AS key, e.vec_id // 5 AS base,
row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, printf('K%06d [%d/5]', e.vec_id // 5, e.vec_id % 5 + 1)) AS r FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0) WHERE r <= 10)
SELECT DISTINCT -1::BIGINT AS query_id, key, 0::BIGINT AS rank FROM h
UNION ALL SELECT query_id, key, row_number() OVER (PARTITION BY query_id ORDER BY r) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, base ORDER BY r) AS n FROM h) WHERE n = 1"""


def toc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a decision about contents is shown: the beginnings of the first pages."""
    rows = _lines(spark, sf_dir).select("doc_id", "seq", "page", F.col("line").alias("text"))
    return C.toc_candidates(rows).withColumn("page", F.col("page").cast("long"))


SQL["toc_pages"] = f"""WITH {_LINES}, p AS (SELECT doc_id, page, left(string_agg(line, chr(10) ORDER BY seq), 500) AS preview, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS n FROM lines GROUP BY doc_id, page)
SELECT doc_id, page, preview FROM p WHERE n <= 15"""


def strike_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of any colour near the middle of a word, and the words that no line meets."""
    drawings, words, _ = _shapes(spark, sf_dir)
    lines = strikes.strike_lines(drawings, words, "any", near=2.0)
    left = strikes.words_without_strikes(words, lines)
    shown = lambda df, kind, c: df.select("doc_id", F.col("page").cast("long").alias("page"), F.lit(kind).alias("kind"), F.col(c).cast("long").alias("id"))
    return shown(lines, "line", "drawing_id").unionByName(shown(left, "word", "seq"))


SQL["strike_options"] = """WITH li AS (SELECT l_orderkey // 40 AS doc_id, l_linenumber AS page, l_orderkey, l_partkey, l_suppkey, l_quantity::DOUBLE * 8 AS x0, (l_partkey % 40) * 3.0::DOUBLE AS y0 FROM lineitem),
d AS (SELECT doc_id, page, l_orderkey AS id, x0, y0 + 4 AS y0, x0 + 60 AS x1, y0 + 5 AS y1 FROM li WHERE l_suppkey % 3 = 0),
b AS (SELECT doc_id, page, l_orderkey * 1000000 + l_partkey AS id, x0, y0, x0 + 30 AS x1, y0 + 10 AS y1 FROM li WHERE l_suppkey % 3 <> 0),
s AS (SELECT * FROM d WHERE EXISTS (SELECT 1 FROM b WHERE b.doc_id = d.doc_id AND b.page = d.page AND b.x0 < d.x1 AND d.x0 < b.x1 AND b.y0 < d.y1 AND d.y0 < b.y1 AND abs((d.y0 + d.y1) / 2 - (b.y0 + b.y1) / 2) < 2))
SELECT doc_id, page::BIGINT AS page, 'line' AS kind, id FROM s
UNION ALL SELECT doc_id, page::BIGINT, 'word', id FROM b WHERE NOT EXISTS (SELECT 1 FROM s WHERE b.doc_id = s.doc_id AND b.page = s.page AND b.x0 < s.x1 AND s.x0 < b.x1 AND b.y0 < s.y1 AND s.y0 < b.y1)"""


def paragraphs_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw blocks as paragraphs in reading order, which runs against the block numbers here."""
    raw = _lines(spark, sf_dir).select(
        "doc_id", (F.col("page") - 1).alias("page_index"), F.col("seq").alias("block_no"),
        (F.col("seq") % 11 == 10).cast("int").alias("kind"), F.col("line").alias("text"), (-F.col("seq")).cast("double").alias("y0"),
        F.lit(0.0).alias("x0")
    )
    return B.load_paragraphs(raw).select("doc_id", F.col("seq").cast("long").alias("seq"), F.col("page").cast("long").alias("page"), "text")


SQL["paragraphs_in_order"] = f"WITH {_LINES} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page, seq DESC) - 1 AS seq, page, line AS text FROM lines WHERE seq % 11 <> 10 AND length(line) > 30"


def blocks_from_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks with fonts from spans: each word of a line is a span, three lines are a block."""
    spans = _lines(spark, sf_dir).select(
        "doc_id", (F.col("page") - 1).alias("page_index"), F.floor(F.col("seq") / 3).alias("block_no"), F.col("seq").alias("line_no"),
        F.posexplode(F.split("line", " ")).alias("span_no", "text")
    )
    spans = spans.withColumn("size", (10 + F.col("span_no") % 4).cast("double")).withColumn(
        "font", F.when(F.col("line_no") % 5 == 0, "Arial-BoldMT").otherwise("Arial")
    )
    boxed = spans.select("*", *(F.col("line_no").cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")))
    found = B.structured_blocks(boxed)
    return found.select(
        "doc_id", F.col("seq").cast("long").alias("seq"), F.col("page").cast("long").alias("page"), "text", "font_size", "is_bold",
        F.col("bbox.y0").alias("top"), F.col("bbox.y1").alias("bottom")
    )


SQL["blocks_from_spans"] = f"""WITH {_LINES}, b AS (SELECT doc_id, page, seq // 3 AS block_no, string_agg(replace(line, ' ', ''), chr(10) ORDER BY seq) AS text, max(10 + least(len(string_split(line, ' ')) - 1, 3))::DOUBLE AS font_size,
bool_or(seq % 5 = 0) AS is_bold, min(seq)::DOUBLE AS top, max(seq)::DOUBLE AS bottom FROM lines GROUP BY ALL)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page, block_no) - 1 AS seq, page, text, font_size, is_bold, top, bottom FROM b WHERE text <> ''"""


def fallback_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form fields from cells, and for documents without any from the answer to a prompt, here its first characters."""
    o = _table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    rows = o.select(
        (key % 100).alias("doc_id"), F.lit(1).alias("page"), F.lit(0).alias("table_no"), key.alias("row_no"),
        F.posexplode(F.array(F.concat(F.lit("Field "), key.cast("string")), F.col("o_orderstatus"))).alias("col_no", "text")
    )
    blocks = o.select((key % 100).alias("doc_id"), key.alias("seq"), "o_orderpriority").withColumnRenamed("o_orderpriority", "text")
    answer = lambda prompt: F.array(F.struct(F.lit("prompt").alias("name"), F.substring(prompt, 1, 20).alias("value"), F.lit(None).cast("int").alias("page")))
    found = B.form_fields_with_fallback(rows.filter("doc_id % 3 = 0"), blocks, answer)
    return found.select("doc_id", F.col("seq").cast("long").alias("seq"), F.col("page").cast("long").alias("page"), "name", "value")


SQL["fallback_fields"] = """SELECT o_orderkey % 100 AS doc_id, row_number() OVER (PARTITION BY o_orderkey % 100 ORDER BY o_orderkey) - 1 AS seq, 1::BIGINT AS page, 'Field ' || o_orderkey AS name, o_orderstatus AS value FROM orders WHERE o_orderkey % 100 % 3 = 0
UNION ALL SELECT o_orderkey % 100, 0, 1, 'prompt', left(string_agg(o_orderpriority, chr(10) ORDER BY o_orderkey), 20) FROM orders WHERE o_orderkey % 100 % 3 <> 0 GROUP BY o_orderkey % 100"""


def relabelled_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """If any label of a comparison is too long all of its labels are given anew; items that break an invariant are found."""
    items = _items(spark, sf_dir).withColumn("pair", F.col("item_no") % 40).withColumn(
        "section", F.substring("base_paragraph", 1, F.lit(10) + (F.col("item_no") % 44).cast("int"))
    )
    fixed = compare_plan.fix_section_labels(items, lambda t: F.concat(F.lit("new: "), t), ["pair"]).withColumn(
        "comments", F.when(F.col("item_no") % 3 != 0, F.col("comments"))
    )
    problems = compare_plan.item_problems(fixed).select("item_no", "problem")
    return fixed.join(problems, "item_no", "left").select("item_no", "section", "problem")


SQL["relabelled_items"] = """WITH i AS (SELECT doc_id AS item_no, doc_id % 40 AS pair, left(text, (10 + doc_id % 44)::INT) AS section, toxic = 1 AS dev FROM documents JOIN labels USING (doc_id)),
l AS (SELECT *, max(length(section)) OVER (PARTITION BY pair) > 50 AS long FROM i)
SELECT item_no, CASE WHEN long THEN 'new: ' || left(section, 120) ELSE section END AS section, CASE WHEN dev AND item_no % 3 = 0 THEN 'a deviation has no comments' END AS problem FROM l"""


def sections_as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections as one JSON object for each document, as it would be parsed again."""
    made = file_sources.keyed_json(sections.parse_sections(_numbered(_lines(spark, sf_dir))).select("doc_id", "key", "ord", "text"))
    entries = made.select("doc_id", F.explode(F.from_json("json", "map<string,string>")).alias("key", "text"))
    return entries.select("doc_id", "key", F.length("text").cast("long").alias("chars"))


SQL["sections_as_json"] = f"SELECT doc_id, key, length(text) AS chars FROM ({_sections_sql('number')})"


def whole_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against itself without its first line, in one prompt; too long prompts are reported."""
    rows = _lines(spark, sf_dir).select("doc_id", "seq", "page", F.lit("S").alias("section"), F.col("line").alias("text"))
    found = compare_plan.compare_whole(rows.filter("seq > 0"), rows, Rules(), 2000)
    return found.select(
        "doc_id", F.col("item_no").cast("long").alias("item_no"), F.col("compare_page").cast("long").alias("page"),
        F.col("compare_paragraph").alias("text"), F.col("problem").isNotNull().alias("too_long")
    )


SQL["whole_comparisons"] = f"""WITH {_LINES}, p AS (SELECT doc_id, seq, page, line, '(p.' || page || ' | §S) ' || line AS shown FROM lines),
c AS (SELECT doc_id, greatest(1, (sum(length('[' || (n - 1) || '] ' || shown)) + 2 * (count(*) - 1))::BIGINT // 4) AS tokens FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS n FROM p) GROUP BY doc_id),
b AS (SELECT doc_id, greatest(1, (sum(length('[' || (n - 1) || '] ' || shown)) + 2 * (count(*) - 1))::BIGINT // 4) AS tokens FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS n FROM p WHERE seq > 0) GROUP BY doc_id),
t AS (SELECT doc_id, b.tokens + c.tokens <= 1700 AS fits FROM b JOIN c USING (doc_id))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS item_no, page, line AS text, false AS too_long FROM p JOIN t USING (doc_id) WHERE fits AND NOT EXISTS (SELECT 1 FROM p q WHERE q.doc_id = p.doc_id AND q.seq > 0 AND q.line = p.line)
UNION ALL SELECT doc_id, NULL, NULL, NULL, true FROM t WHERE NOT fits"""


_NOT_QUERIES = {"queries", "oracle_sql"}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if callable(v) and getattr(v, "__module__", "") == __name__ and k[0] != "_" and k not in _NOT_QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
