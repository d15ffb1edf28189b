"""Exact dedup by deterministic block naming.

Texts are cut into fixed-size blocks of UTF-8 bytes. Distinct blocks are sorted and get integers as
names; then adjacent names are paired, the distinct pairs are sorted and named, and so on until each
document has one name. Two documents end with the same (level, name) exactly when their bytes are equal:
a name stands for one block or one pair of names, so nothing rests on a hash being free of collisions.

Block contents cross the network once, as distinct contents after a map-side combine. Documents refer to
their blocks by a 64-bit hash, and a name is looked up by that hash; hashes that turn out to stand for more
than one content are resolved by content.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.runtime import durable, texts_of, unused

BLOCK_BYTES = 4096
#: Rows to drop up to which their table is broadcast (some 120 bytes each).
BROADCAST_ROWS = 200_000
#: The second of a pair when a document has an odd number of names.
NONE = -(2**63)


def _blocks(data: Column, size: int) -> Column:
    """Blocks of a binary column; the empty text has one empty block."""
    last = F.greatest(F.lit(0), F.ceil(F.octet_length(data) / size).cast("int") - 1)
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(data, i * size + 1, F.lit(size)))


def _named(distinct: DataFrame, *by: str) -> DataFrame:
    """Integer names in sorted order within each partition; equal on every run of the same rows."""
    return distinct.sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id())


def _resolve_clashes(docs: DataFrame, occurrences: DataFrame, names: DataFrame, size: int, block_hash: Callable[[Column], Column]) -> DataFrame:
    """Names by content for the hashes that stand for several contents."""
    clashing = durable(names.groupBy("h").count().filter("count > 1").select("h"))
    if clashing.isEmpty():
        return occurrences.join(names, "h").select("rid", "pos", "name")
    cut = docs.select("doc_id", "sha", F.posexplode(_blocks(F.col("data"), size)).alias("pos", "block"))
    cut = cut.withColumn("h", block_hash(F.col("block"))).join(clashing, "h", "left_semi")
    by_content = _named(cut.select("block").distinct(), "block").select("block", (-1 - F.col("name")).alias("name"))
    placed = cut.join(by_content, "block").select(F.col("doc_id").alias("d"), F.col("sha").alias("s"), F.col("pos").alias("p"), "name").distinct()
    odd = occurrences.join(clashing, "h", "left_semi")
    odd = odd.join(placed, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("sha") == F.col("s")) & (F.col("pos") == F.col("p")))
    plain = occurrences.join(clashing, "h", "left_anti").join(names, "h")
    return plain.select("rid", "pos", "name").unionByName(odd.select("rid", "pos", "name"))


def _in_order(placed: DataFrame) -> DataFrame:
    row = F.array_sort(F.collect_list(F.struct("pos", "name")))
    return placed.groupBy("rid").agg(F.transform(row, lambda x: x["name"]).alias("names"))


def identify(docs: DataFrame, block_bytes: int = BLOCK_BYTES, block_hash: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(doc_id, sha, copies, level, name): one row for each distinct (doc_id, text), copies counting repeated rows.

    docs has doc_id and text; null text counts as empty, null ids are kept. level and name identify the text.
    """
    rows = texts_of(docs).select("doc_id", F.sha2("text", 256).alias("sha"), F.col("text").cast("binary").alias("data"))
    hashes = F.transform(_blocks(F.col("data"), block_bytes), lambda b: block_hash(b))
    base = rows.select("doc_id", "sha", hashes.alias("hashes")).groupBy("doc_id", "sha").agg(
        F.count(F.lit(1)).alias("copies"), F.any_value("hashes").alias("hashes")
    )
    base = durable(base.withColumn("rid", F.monotonically_increasing_id()))
    contents = rows.select(F.explode(_blocks(F.col("data"), block_bytes)).alias("block")).select(block_hash(F.col("block")).alias("h"), "block").distinct()
    names = durable(_named(contents, "h", "block").select("h", "name"))
    occurrences = base.select("rid", "doc_id", "sha", F.posexplode("hashes").alias("pos", "h"))
    level, longest = 0, base.agg(F.max(F.size("hashes"))).first()[0] or 1
    current = durable(_in_order(_resolve_clashes(rows, occurrences, names, block_bytes, block_hash)))
    ended = []
    for level in range(ceil(log2(longest)) + 1):
        ended.append(current.filter(F.size("names") == 1).select("rid", F.lit(level).alias("level"), F.col("names")[0].alias("name")))
        if level == ceil(log2(longest)):
            break
        pair = F.transform(
            F.sequence(F.lit(0), F.floor((F.size("names") - 1) / 2).cast("int")),
            lambda i: F.struct(F.get("names", 2 * i).alias("a"), F.coalesce(F.get("names", 2 * i + 1), F.lit(NONE)).alias("b")),
        )
        pairs = current.filter(F.size("names") > 1).select("rid", F.posexplode(pair).alias("pos", "pair")).select("rid", "pos", "pair.a", "pair.b")
        current = durable(_in_order(pairs.join(_named(pairs.select("a", "b").distinct(), "a", "b"), ["a", "b"]).select("rid", "pos", "name")))
    found = ended[0]
    for more in ended[1:]:
        found = found.unionByName(more)
    return base.join(found, "rid").select("doc_id", "sha", "copies", "level", "name")


def exact_groups(docs: DataFrame, block_bytes: int = BLOCK_BYTES, block_hash: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row for each input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest doc_id stays (null ids come last; a group of null ids keeps one row
    and has a null keep_id). Repeated rows with the same id and text are counted in group_size; one of them is kept.
    An empty table gives an empty result. Columns other than doc_id and text are ignored.
    """
    rows = durable(identify(docs, block_bytes, block_hash))
    # Durable, so that both sides of the join are plain exchanges and a hot group's rows can be split.
    groups = durable(rows.groupBy("level", "name").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size")))
    return (
        rows.join(groups, ["level", "name"])
        .select(
            "doc_id", "keep_id", "group_size", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
            F.col("sha").alias("text_sha256")
        )
        .select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256")
    )


def drop_copies(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without the rows whose text another row with a larger doc_id has; all columns stay, whatever their names.

    Null texts count as empty ones. Of repeated rows with the same id and text one stays; of texts that only rows with a null id
    have, one row.
    """
    the_id, the_sha, staying, copies = unused(docs, "kept_id", "kept_sha", "staying", "copies")
    found = durable(exact_groups(docs, block_bytes).select("doc_id", "kept", "text_sha256"))
    gone = found.groupBy(
        F.col("doc_id").alias(the_id), F.col("text_sha256").alias(the_sha)
    ).agg(F.bool_or("kept").alias(staying), F.count(F.lit(1)).alias(copies))
    return without_rows(
        docs, durable(gone.filter(~F.col(staying) | (F.col(copies) > 1))), F.sha2(F.coalesce(F.col("text"), F.lit("")), 256), the_id,
        the_sha, staying
    )


def without_rows(docs: DataFrame, gone: DataFrame, key: Column, the_id: str, the_key: str, staying: str) -> DataFrame:
    """docs without the rows that gone names by id (null-safe) and key; of those that gone marks as staying, one row stays.

    gone is durable, has each id and key once, and its columns have names that docs has not.
    """
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    here = F.col("doc_id").cast("long").eqNullSafe(F.col(the_id)) & (key == F.col(the_key))
    kept = docs.join(gone, here, "left_anti")
    repeated = gone.filter(F.col(staying))
    if repeated.isEmpty():
        return kept
    return kept.unionByName(docs.join(repeated, here, "left_semi").withColumn(the_key, key).dropDuplicates(["doc_id", the_key]).drop(the_key))
