"""Merkle manifest of a table: a tree per language, and a tree over their roots.

Ranks come from a range partitioning and the counts of its parts, so no window holds a language.
Aligned blocks of 256 nodes keep each level as one string of hex digests: fixed-width substrings
of it are hashed to the next level, the substring beside a node's own is its sibling. The roots of
blocks are the next layer's nodes. Paths are put together from the top layer down, a block at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, keyed_join, let

#: levels that a block holds
LEVELS = 8
HEX = 64


def _field(value: Column) -> Column:
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(source: str = "source", lang: str = "lang", n_chars: str | Column = "n_chars") -> Column:
    """The digest of a row: its fields with their lengths, one after the other."""
    n = F.col(n_chars) if isinstance(n_chars, str) else n_chars
    return F.sha2(F.concat(*map(_field, (F.col("doc_id"), F.col(source), F.col(lang), n, F.col("text")))).cast("binary"), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, leaf, altered): altered is the leaf of the row with n_chars one higher where 7 divides the id's crc32.

    tree is empty for a null lang, else a colon and the lang, so it sorts as the trees do.
    """
    tampered = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", F.col("n_chars").cast("decimal(20,0)").alias("n_chars"), "text")
    tree = F.coalesce(F.concat(F.lit(":"), F.col("lang")), F.lit("")).alias("tree")
    return own.select(tree, "doc_id", leaf().alias("leaf"), F.when(tampered, leaf(n_chars=F.col("n_chars") + 1)).alias("altered"))


def ranked(rows: DataFrame, order: list[str], scratch: Scratch) -> DataFrame:
    """A written table of rows with `rank` from 0 in its tree and `height`, the levels above that tree's leaves."""
    placed = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("place", F.monotonically_increasing_id())
    placed = scratch.written(placed, "placed").withColumn("part", F.shiftright("place", 33))
    runs = placed.groupBy("tree", "part").agg(F.min("place").alias("first"), F.count("*").alias("size"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("size").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("size").over(tree)
    height = F.when(total < 2, 0).otherwise(F.length(F.bin(total - 1)))
    runs = scratch.written(runs.select("tree", "part", "size", (before - F.col("first")).alias("shift"), height.cast("int").alias("height")), "runs")
    return keyed_join(placed, runs, ["tree", "part"]).withColumn("rank", F.col("place") + F.col("shift")).drop("place", "part", "shift")


def _parents(level: Column) -> Column:
    """The next level of a string of digests: each two of them, at the end perhaps one, are hashed."""
    pair = lambda raw: lambda i: F.sha2(F.substr(raw, i * 2 * HEX + 1, F.lit(2 * HEX)), 256)
    count = lambda raw: F.ceil(F.octet_length(raw) / (2 * HEX)).cast("int")
    return let(level.cast("binary"), lambda raw: F.array_join(F.transform(F.sequence(F.lit(0), count(raw) - 1), pair(raw)), ""))


def _climbed(nodes: DataFrame, carried: list[str], scratch: Scratch) -> list[DataFrame]:
    """Layers of blocks (tree, block, height, rows, levels) from (tree, rank, height, hash) up to each tree's root."""
    layers = []
    while True:
        at = F.col("rank").bitwiseAND((1 << LEVELS) - 1).alias("at")
        block = F.shiftright("rank", LEVELS).alias("block")
        rows = F.sort_array(F.collect_list(F.struct(at, "hash", *carried))).alias("rows")
        blocks = nodes.groupBy("tree", block).agg(F.max("height").alias("height"), rows)
        steps = F.least(F.col("height"), F.lit(LEVELS))
        first = F.array(F.array_join(F.transform("rows", lambda r: r["hash"]), "")).cast("array<string>")
        climb = F.aggregate(F.sequence(F.lit(1), steps), first, lambda kept, _: F.concat(kept, F.array(_parents(F.element_at(kept, -1)))).cast("array<string>"))
        blocks = scratch.written(blocks.withColumn("levels", F.when(steps > 0, climb).otherwise(first)), "level-strings")
        layers.append(blocks)
        nodes = blocks.filter(F.col("height") > LEVELS).select("tree", F.col("block").alias("rank"), (F.col("height") - LEVELS).alias("height"), F.element_at("levels", -1).alias("hash"))
        carried = []
        if nodes.isEmpty():
            return layers


def _roots(layers: list[DataFrame]) -> DataFrame:
    """(tree, hash) of each tree."""
    tops = [b.filter(F.col("height") <= LEVELS).select("tree", F.element_at("levels", -1).alias("hash")) for b in layers]
    out = tops[0]
    for t in tops[1:]:
        out = out.unionByName(t)
    return out


def _segment(levels: Column, i: Column, k: Column) -> Column:
    """The sibling of node i at level k with its side, L or R; empty if the node stands alone."""
    mine = F.floor(i / F.pow(F.lit(2), k)).cast("int")
    other = mine.bitwiseXOR(F.lit(1))
    digest = F.substr(F.get(levels, k), other * HEX + 1, F.lit(HEX)).cast("string")
    return F.when(digest == "", "").otherwise(F.concat(F.when(other < mine, "L").otherwise("R"), digest))


def _descended(layers: list[DataFrame], tops: DataFrame, passed: list[str], scratch: Scratch) -> DataFrame:
    """The rows of the lowest layer with `path`: a segment a level, up to the end of the path of tops (tree, path, passed)."""
    above = None
    for number, blocks in reversed(list(enumerate(layers))):
        own = blocks.filter(F.col("height") <= LEVELS).join(tops, "tree")
        if above is not None:
            own = own.unionByName(blocks.filter(F.col("height") > LEVELS).join(above, ["tree", "block"]))
        steps = F.least(F.col("height"), F.lit(LEVELS))
        ways = let(
            F.transform("levels", lambda x: x.cast("binary")),
            lambda levels: F.transform("rows", lambda r, i: F.struct(r.alias("row"), F.when(steps > 0, F.transform(F.sequence(F.lit(0), steps - 1), lambda k: _segment(levels, i, k))).otherwise(F.array().cast("array<string>")).alias("own"))),
        )
        block = (F.shiftleft(F.col("block"), LEVELS) + F.col("way.row.at")).alias("block")
        out = own.select("tree", "block", "path", *passed, F.explode(ways).alias("way"))
        above = out.select("tree", block, F.concat("way.own", "path").alias("path"), *passed, *([] if number else ["way.row"]))
        if number:
            above = scratch.written(above, "paths")
    return above


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, leaf, altered, subroot, root, path) for each row of docs (doc_id, source, lang, n_chars, text).

    path has a segment a level from the leaf to the root over all languages: L or R and the
    sibling's digest, or an empty one where the node stands alone. altered is null where the row is
    not tampered with. Rows of one lang ascend by doc_id (null first), then by leaf; repeated rows
    are leaves of their own, a null lang is a tree of its own, a null field counts as `-`. Other
    columns are left out; without rows there are none in the result.
    """
    scratch = Scratch(docs.sparkSession)
    rows = scratch.written(leaves(docs).withColumn("row", F.monotonically_increasing_id()), "leaves")
    nodes = ranked(rows, ["doc_id", "leaf", "row"], scratch).select("tree", "rank", "height", F.col("leaf").alias("hash"), "doc_id", "altered")
    layers = _climbed(nodes, ["doc_id", "altered"], scratch)
    subroots = scratch.written(_roots(layers).select(F.lit("").alias("tree"), F.col("tree").alias("name"), "hash"), "subroots")
    crowns = _climbed(ranked(subroots, ["name"], scratch).select("tree", "rank", "height", "hash", "name"), ["name"], scratch)
    root = _roots(crowns).select("tree", F.col("hash").alias("root"), F.array().cast("array<string>").alias("path"))
    tops = _descended(crowns, root, ["root"], scratch).select(F.col("row.name").alias("tree"), "path", "root", F.col("row.hash").alias("subroot"))
    out = _descended(layers, scratch.written(tops, "tops"), ["root", "subroot"], scratch)
    lang = F.when(F.col("tree") != "", F.substr("tree", F.lit(2))).alias("lang")
    return out.select("row.doc_id", lang, F.col("row.hash").alias("leaf"), "row.altered", "subroot", "root", "path")


def siblings(path: Column) -> Column:
    """All siblings of a path in one string of digests."""
    return F.array_join(F.transform(path, lambda s: F.substr(s, F.lit(2))), "")


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and a path give."""
    side, digest = (lambda s: F.substr(s, F.lit(1), F.lit(1))), (lambda s: F.substr(s, F.lit(2)))
    text = lambda mine, s: F.when(side(s) == "L", F.concat(digest(s), mine)).when(side(s) == "R", F.concat(mine, digest(s))).otherwise(mine)
    return F.aggregate(path, start, lambda mine, s: F.sha2(text(mine, s).cast("binary"), 256))
