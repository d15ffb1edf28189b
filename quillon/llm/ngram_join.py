"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact sorted-array intersection.

A document's set holds the hashes of its distinct word shingles. Equal sets are one class, so that copies are joined
once. A set takes part only if num / den of its shingles occur in other documents at all (see promising): passages that many
documents share do not bring documents together. Two sets of sizes a <= b with a Jaccard index of at least t have b <= a / t
and differ in at most D = (1 - t) / (1 + t) * (a + b) shingles. Sizes form bands of ratio t; a tile covers a band and the next
one, so every pair that can link shares a tile, in which D is bounded. In each of its two tiles a set deals its shingles into
D + 1 + q parts by hash. A linked pair agrees in at least q + 1 parts, so some part's content is the same on both sides; a set
that has at most q weak parts (almost no shingle but frequent ones) need not show those. Sets that show the same part in the
same tile are candidates, and form clusters. A large cluster's bands are cut into blocks by hash; pairs of blocks of one band or
of neighbouring ones are the tiles that are worked on, each by one task, whose size is bounded.

In a tile every pair of sets gets an upper bound of its overlap from the bit counts of two bitmaps (a bit in one bitmap and
not in the other stands for a shingle that is not shared); those that the bound lets through are intersected exactly. What is
emitted are the links of a spanning forest, fewer than there are sets, and each set's number of links, in which a linked set
counts as often as it has copies. A pair of sets shares one tile only. Where links are not counted, a pair whose sets are
already connected in the tile is left out, as it cannot change the components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.llm.bytescan import U, batches, mix
from quillon.llm.components import components
from quillon.llm.exact_dedup import without_rows
from quillon.llm.promising import promising
from quillon.llm.runtime import NO_ID, durable, texts_of, tune, unused
from quillon.llm.shingles import Rule, Sets, sets_of

#: Shingles in a block of a cluster, and sets; a larger set is a block of its own. The two bound what a task holds and how many pairs it compares.
BLOCK_SHINGLES, BLOCK_SETS = 1_000_000, 1000
#: A part with at most so many shingles that aren't frequent is weak.
WEAK = 1
#: A shingle is frequent if it is in so many of 1000 documents; at most so many are told apart, the most frequent first.
#: Which ones are frequent has no bearing on the result, only on the number of candidates.
FREQUENT_PER_MILLE, MOST_FREQUENT = 1, 200_000
#: Documents among which a task counts shingles.
COUNTED_DOCS, COUNTED_SHINGLES = 2048, 4_000_000
#: Members of clusters up to which the table that picks their documents is broadcast (some 60 bytes each).
BROADCAST_MEMBERS = 300_000
MOST_BITS = 1 << 16
#: Candidates that a task gathers before it leaves out what it knows to belong together.
HELD_PARTS = 1 << 18


def _describe(docs: DataFrame, words: int, more: tuple[str, ...]) -> DataFrame:
    """doc_id, more (long columns), n, high, low of each row; rows with n = -1 have frequent shingles of a task and their counts."""

    ids = ["doc_id", *more]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen: set[int] = set()

        def counted() -> list[dict]:
            least = max(4, -(-len(held) * FREQUENT_PER_MILLE * 2 // 1000))
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= least
            held.clear()
            seen.clear()
            return [{"s": s, "c": c} for s, c in zip(values[often].view(np.int64).tolist(), counts[often].tolist(), strict=True)]

        def rows(own: list[pa.Array], n: np.ndarray, high: np.ndarray, low: np.ndarray, frequent: list) -> pa.RecordBatch:
            kind = pa.list_(pa.struct([("s", pa.int64()), ("c", pa.int64())]))
            return pa.record_batch(
                [*own, pa.array(n, pa.int64()), pa.array(high.view(np.int64)), pa.array(low.view(np.int64)), pa.array(frequent, kind)],
                [*ids, "n", "high", "low", "frequent"]
            )

        nothing = lambda n: rows([pa.nulls(1, pa.int64())] * len(ids), np.array([-1]), np.zeros(1, U), np.zeros(1, U), [n])
        size = 0
        for batch in parts:
            for a, b in batches(batch.column("text")):
                part = batch.slice(a, b - a)
                s = sets_of(part.column("text"), words)
                yield rows([part.column(c) for c in ids], np.diff(s.at), s.high, s.low, [None] * (b - a))
                for i, h in enumerate(s.high.tolist()):
                    if h not in seen:
                        seen.add(h)
                        held.append(s.shingles[s.at[i] : s.at[i + 1]])
                        size += len(held[-1])
                if len(held) >= COUNTED_DOCS or size >= COUNTED_SHINGLES:
                    yield nothing(counted())
                    size = 0
        if held:
            yield nothing(counted())

    return docs.mapInArrow(run, ", ".join(f"{c} long" for c in [*ids, "n", "high", "low"]) + ", frequent array<struct<s:long,c:long>>")


def parts_of(s: Sets, tile: np.ndarray, most: np.ndarray, starts: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(set, hash) of every part that a set shows. tile: -1 or 0 for the tile that begins with the band before a set's, or with its own."""
    sizes = np.diff(s.at)
    band = np.searchsorted(starts, sizes, "right") - 1
    which = band + tile
    use = (sizes > 0) & (which >= 0)
    use &= most[np.maximum(which, 0)] > 0
    d = np.where(use, most[np.maximum(which, 0)], 0)
    spare = 1 + d // 8
    parts = np.where(use, d + 1 + spare, 0)
    base = np.concatenate([[0], np.cumsum(parts)])
    owner = np.repeat(np.arange(len(sizes)), np.where(use, sizes, 0))
    values = s.shingles[np.repeat(use, sizes)]
    place = base[owner] + (values % parts[owner].astype(U)).astype(np.int64)
    total = np.zeros(base[-1], U)
    np.add.at(total, place, mix(values + U(0x9FB21C651E98DF25)))
    rare = values if not len(frequent) else values[frequent[np.minimum(np.searchsorted(frequent, values), len(frequent) - 1)] != values]
    rare_place = place if not len(frequent) else place[frequent[np.minimum(np.searchsorted(frequent, values), len(frequent) - 1)] != values]
    weak = np.bincount(rare_place, minlength=int(base[-1])) <= WEAK if len(rare) or base[-1] else np.zeros(0, bool)
    part_owner = np.repeat(np.arange(len(sizes)), parts)
    n_weak = np.bincount(part_owner[weak], minlength=len(sizes))
    show = ~weak | (n_weak > spare)[part_owner]
    number = np.arange(base[-1]) - base[part_owner]
    tag = mix((which[part_owner].astype(U) << U(32)) + number.astype(U))
    return part_owner[show], mix(total + tag)[show]


def _together(part: np.ndarray, high: np.ndarray) -> pa.RecordBatch:
    """Of the sets that show the same part the least one, with the part; and each of the others with the least one, under a key of its own.

    So a part that very many sets show comes from a task once.
    """
    order = np.lexsort([high, part])
    part, high = part[order], high[order]
    new = np.concatenate([[True], part[1:] != part[:-1]])[: len(part)]
    heads = np.flatnonzero(new)
    least = high[np.repeat(heads, np.diff(np.append(heads, len(part))))]
    other = np.flatnonzero(~new & (least != high))
    keys = mix(least[other].view(U) ^ mix(high[other].view(U))).view(np.int64)
    a = pa.concat_arrays([pa.nulls(len(heads), pa.int64()), pa.array(least[other])])
    return pa.record_batch([pa.array(np.concatenate([part[heads], keys])), a, pa.array(np.concatenate([high[heads], high[other]]))], ["part", "a", "high"])


def candidates(docs: DataFrame, rule: Rule, largest: int, frequent: np.ndarray) -> DataFrame:
    """a, b: pairs of sets (by their first sum) that link all sets which show a common part, directly or by way of others."""
    starts, most = rule.tiles(largest)
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        done = lambda: _together(*(np.concatenate(x) for x in zip(*held, strict=True)))
        for batch in parts:
            for a, b in batches(batch.column("text")):
                s = sets_of(batch.column("text").slice(a, b - a), rule.words)
                fresh = []
                for i, h in enumerate(s.high.tolist()):
                    if h not in seen:
                        fresh.append(i)
                        seen.add(h)
                if len(seen) > 500_000:
                    seen.clear()
                pick = np.zeros(b - a, bool)
                pick[fresh] = True
                for tile in (-1, 0):
                    owner, value = parts_of(s, np.full(b - a, tile), most, starts, shared.value)
                    mine = pick[owner]
                    held.append((value[mine].view(np.int64), s.high[owner[mine]].view(np.int64)))
                    size += len(held[-1][0])
                if size > HELD_PARTS:
                    yield done()
                    held, size = [], 0
        if held:
            yield done()

    shown = docs.mapInArrow(run, "part long, a long, high long")
    # A row for each part and task.
    least = F.min("high").over(Window.partitionBy("part"))
    pairs = shown.select(F.coalesce("a", least).alias("a"), F.col("high").alias("b"))
    return pairs.filter("a <> b")


def links_in_tile(
    ids: np.ndarray, side: np.ndarray, sets: list[np.ndarray], rule: Rule, copies: np.ndarray | None = None
) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links of a spanning forest of a tile's sets, which come in order of size, and each set's links to others, weighted by their copies (zeros without copies).

    Sets are compared across two sides, or all with each other if all have one.
    """
    sizes = np.array([len(x) for x in sets], np.int64)
    bits = 1 << min(MOST_BITS.bit_length() - 1, max(7, int(2 * sizes.max()).bit_length()))
    flat, at = np.concatenate(sets), np.concatenate([[0], np.cumsum(sizes)])
    grid = np.zeros((len(sets), bits), bool)
    grid[np.repeat(np.arange(len(sets)), sizes), (flat & U(bits - 1)).astype(np.int64)] = True
    bitmaps = np.packbits(grid, axis=1).view(U)
    del grid
    codes = np.unique(flat, return_inverse=True)[1]
    mark, degree = np.zeros(len(flat), bool), np.zeros(len(sets), np.int64)
    label, across, out = np.arange(len(sets)), side.min() != side.max(), []
    for i in range(len(sets) - 1):
        end = int(np.searchsorted(sizes, rule.den * sizes[i] // rule.num, "right"))
        js = np.arange(i + 1, end)
        if copies is None:
            js = js[label[js] != label[i]]
        if across:
            js = js[side[js] != side[i]]
        if not len(js):
            continue
        need, mine, theirs = rule.need(sizes[i] + sizes[js]), bitmaps[i], bitmaps[js]
        bound = np.minimum(
            sizes[i] - np.bitwise_count(mine & ~theirs).sum(1, dtype=np.int64),
            sizes[js] - np.bitwise_count(theirs & ~mine).sum(1, dtype=np.int64)
        )
        js, need = js[bound >= need], need[bound >= need]
        mark[codes[at[i] : at[i + 1]]] = True
        for step in range(0, len(js), 256):
            some, least = js[step : step + 256], need[step : step + 256]
            if copies is None:
                fresh = label[some] != label[i]
                some, least = some[fresh], least[fresh]
            if not len(some):
                continue
            begins = np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
            other = np.concatenate([codes[at[j] : at[j + 1]] for j in some])
            linked = some[np.add.reduceat(mark[other].astype(np.int64), begins) >= least]
            if copies is not None:
                degree[i] += copies[linked].sum()
                degree[linked] += copies[i]
            for j in linked[label[linked] != label[i]].tolist():
                if label[j] != label[i]:
                    out.append((int(ids[i]), int(ids[j])))
                    label[label == label[j]] = label[i]
        mark[codes[at[i] : at[i + 1]]] = False
    return out, degree


def _tile_rows(docs: DataFrame, words: int) -> DataFrame:
    """docs has text, cid, copies, high, low, tiles: a row with the set for each tile, if the row's set is the one that is meant."""
    names = ["cluster", "i", "j", "block", "n", "cid", "copies", "shingles"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for a, b in batches(batch.column("text")):
                part = batch.slice(a, b - a)
                s = sets_of(part.column("text"), words)
                rows = []
                for k, r in enumerate(part.drop_columns("text").to_pylist()):
                    if (int(s.high[k]), int(s.low[k])) == (r["high"] % 2**64, r["low"] % 2**64):
                        data = s.shingles[s.at[k] : s.at[k + 1]].tobytes()
                        rows += [(t["cluster"], t["i"], t["j"], r["block"], len(data) // 8, r["cid"], r["copies"], data) for t in r["tiles"]]
                columns = list(zip(*rows, strict=True)) or [[]] * 8
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 7 + [pa.binary()], strict=True)], names)

    return docs.mapInArrow(run, "cluster long, i long, j long, block long, n long, cid long, copies long, shingles binary")


def _links(rows: DataFrame, rule: Rule, count: bool) -> DataFrame:
    """a, b of links; if they are counted, also a and its number of links in a tile (n), without b. rows come sorted by tile and then by size."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held = None, []

        def done() -> pa.RecordBatch:
            kept = {r[1]: r for r in held}  # repeated rows of one document count once
            ids, side = np.array([*kept]), np.array([r[0] for r in kept.values()])
            copies = np.array([r[3] for r in kept.values()]) if count else None
            found, degree = links_in_tile(
                ids, side, [np.frombuffer(r[2], U) for r in kept.values()], rule, copies
            ) if len(kept) > 1 else ([], np.zeros(1, np.int64))
            rows = [(a, b, None) for a, b in found] + [(int(ids[k]), None, int(degree[k])) for k in np.flatnonzero(degree)]
            return pa.record_batch([pa.array([x[k] for x in rows], pa.int64()) for k in range(3)], ["a", "b", "n"])

        for batch in parts:
            columns = [batch.column(k).to_pylist() for k in ("cluster", "i", "j", "block", "cid", "shingles", "copies")]
            for *now, block, cid, data, copies in zip(*columns, strict=True):
                if now != tile:
                    if held:
                        yield done()
                    tile, held = now, []
                held.append((block, cid, data, copies))
        if held:
            yield done()

    return rows.mapInArrow(run, "a long, b long, n long")


def _blocked(members: DataFrame, rule: Rule, largest: int, block_shingles: int) -> DataFrame:
    """members with block and tiles, an array of (cluster, i, j) that says in which pairs of blocks a set is compared.

    A cluster of at most block_shingles shingles and BLOCK_SETS sets is one block. The bands of a larger one are cut by hash into blocks of about that size, and
    each block meets the blocks of its own band and of the next one. All of this comes from sums for each cluster and band.
    """
    starts = F.array(*(F.lit(int(x)) for x in rule.tiles(largest)[0]))
    members = durable(members.withColumn("band", F.size(F.filter(starts, lambda x: x <= F.col("n"))).cast("long")))
    weight = F.greatest(F.col("n"), F.lit(block_shingles // BLOCK_SETS))
    sums = durable(members.groupBy("cluster", "band").agg(F.sum(weight).alias("s")))
    large = sums.groupBy("cluster").agg(F.sum("s").alias("all")).filter(F.col("all") > block_shingles).select("cluster")
    cut = sums.join(large, "cluster").withColumn("blocks", F.ceil(F.col("s") / block_shingles))
    # A row for each band of a cluster.
    near = lambda by, c: F.coalesce(F.when(F.lag("band", by).over(order) == F.col("band") - by, F.lag(c, by).over(order)), F.lit(0))
    order = Window.partitionBy("cluster").orderBy("band")
    cut = durable(cut.select("cluster", "band", "blocks", near(1, "blocks").alias("before"), near(-1, "blocks").alias("after")))
    cut = F.broadcast(cut) if cut.count() <= BROADCAST_MEMBERS else cut
    block = lambda k, band: F.shiftleft(band, 32) + k
    rows = members.join(cut, ["cluster", "band"], "left").withColumn("block", F.coalesce(block(F.pmod(F.xxhash64("cid"), "blocks"), F.col("band")), F.lit(0)))

    def facing(count: str, away: int) -> Column:
        """The tiles with the blocks of a band."""
        other = lambda k: block(k, F.col("band") + away)
        all_of = F.when(F.col(count) > 0, F.sequence(F.lit(0), F.col(count) - 1)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(all_of, lambda k: F.struct("cluster", F.least("block", other(k)).alias("i"), F.greatest("block", other(k)).alias("j")))

    whole = F.array(F.struct("cluster", F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j")))
    tiles = F.concat(facing("blocks", 0), facing("before", -1), facing("after", 1))
    return rows.withColumn("tiles", F.when(F.col("blocks").isNull(), whole).otherwise(tiles)).drop("band", "blocks", "before", "after")


def _grouped(docs: DataFrame, rule: Rule, block_shingles: int, count_links: bool, *more: str) -> DataFrame:
    """doc_id, more, n_shingles, component (null for an empty set), component_id and n_links (null unless counted) of each row of docs."""
    tune(docs.sparkSession)
    rows = texts_of(docs, *more)
    described = durable(_describe(rows, rule.words, more))
    classes = described.filter("n > 0").groupBy("high", "low", "n").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    classes = durable(classes.withColumn("cid", F.monotonically_increasing_id()).withColumn("rep", F.coalesce("least", F.lit(NO_ID))))
    largest, count, total = classes.agg(F.max("n"), F.count(F.lit(1)), F.sum(F.col("n") * F.col("copies"))).first()
    known = described.filter("n >= 0").select("doc_id", *more, F.col("n").alias("n_shingles"), "high", "low")
    if not count:
        none = F.lit(None).cast("long")
        return known.select("doc_id", *more, "n_shingles", none.alias("component"), none.alias("component_id"), none.alias("n_links"))
    often = described.filter("n = -1").select(F.explode("frequent").alias("f")).groupBy("f.s").agg(F.sum("f.c").alias("c"))
    often = often.filter(F.col("c") * 1000 >= count * FREQUENT_PER_MILLE).orderBy(F.desc("c"), "s").limit(MOST_FREQUENT).select("s")
    frequent = np.sort(np.array([r[0] for r in often.collect()], np.int64).view(U))
    chosen = durable(classes.join(promising(rows.select("text"), rule, total), ["high", "low"]))
    by_id = rows.select("text", F.coalesce("doc_id", F.lit(NO_ID)).alias("rep"))
    few = chosen.count() <= BROADCAST_MEMBERS
    ids = chosen.select("rep").distinct()
    clusters = components(candidates(by_id.join(F.broadcast(ids) if few else ids, "rep", "left_semi"), rule, largest, frequent))
    members = chosen.join(clusters.select(F.col("node").alias("high"), F.col("component").alias("cluster")), "high")
    members = durable(_blocked(members.select("cluster", "cid", "rep", "high", "low", "n", "copies"), rule, largest, block_shingles))
    wanted = members.select("rep", "cid", "copies", "high", "low", "block", "tiles")
    if members.count() <= BROADCAST_MEMBERS:
        wanted = F.broadcast(wanted)
    fetched = by_id.join(wanted, "rep").drop("rep")
    laid = _tile_rows(fetched, rule.words).repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "n", "cid")
    links = durable(_links(laid, rule, count_links))
    linked = components(links.filter("b is not null")).select(F.col("node").alias("cid"), "component")
    of_class = classes.select("high", "low", "cid", "least", "copies").join(linked, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    # Durable, so that a hot component's rows can be split where they meet its least id.
    least = durable(of_class.groupBy("component").agg(F.min("least").alias("component_id")))
    if count_links:
        counted = links.filter("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("n_links"))
        of_class = of_class.join(counted, "cid", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1)
    else:
        of_class = of_class.withColumn("n_links", F.lit(None).cast("long"))
    of_class = of_class.join(least, "component").select("high", "low", "component", "component_id", "n_links")
    return known.join(of_class, ["high", "low"], "left").drop("high", "low")


def near_groups(docs: DataFrame, rule: Rule = Rule(3, 90, 100), block_shingles: int = BLOCK_SHINGLES, count_links: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links for each row of docs (doc_id, text); component_id is the least doc_id reachable by links.

    n_links is how many other rows a row is linked with; without count_links the column is left out.

    A text without words (null and empty ones too) has an empty set and is linked with nothing. Texts of equal sets are
    linked. Rows whose id is null take part in links; a component of such rows only has a null id. An empty table gives an
    empty result. Other columns are ignored.
    """
    out = _grouped(docs, rule, block_shingles, count_links)
    more = [F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")] if count_links else []
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), *more)


def one_of_each(docs: DataFrame, rule: Rule = Rule(5, 80, 100)) -> DataFrame:
    """docs with one row of each component, that with the least doc_id; texts without words all stay, and so do all columns, whatever their names.

    Rows are told apart by id and text: of several texts with the least id of their component one stays, and one of repeated rows.
    A row with a null id stays only if its component has no other id, and then one row does.
    """
    the_id, the_key, staying, copies = unused(docs, "kept_id", "kept_key", "staying", "copies")
    key = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    keyed = docs.select("doc_id", "text", key.alias("key"))
    found = durable(_grouped(keyed, rule, BLOCK_SHINGLES, False, "key").filter("component is not null").select("doc_id", "key", "component"))
    one = F.min_by(F.struct("doc_id", "key"), F.struct(F.col("doc_id").isNull(), "doc_id", "key"))
    # Durable, so that a hot component's rows can be split where they meet the row that stays.
    kept = durable(found.groupBy("component").agg(one.alias("one"), F.count(F.lit(1)).alias("size")).filter("size > 1"))
    stays = F.col("doc_id").eqNullSafe(F.col("one.doc_id")) & (F.col("key") == F.col("one.key"))
    rows = found.join(kept, "component").select(F.col("doc_id").alias(the_id), F.col("key").alias(the_key), stays.alias(staying))
    gone = rows.groupBy(the_id, the_key).agg(F.bool_or(staying).alias(staying), F.count(F.lit(1)).alias(copies))
    return without_rows(docs, durable(gone.filter(~F.col(staying) | (F.col(copies) > 1))), key, the_id, the_key, staying)
