"""Near-duplicate groups by b-bit MinHash.

Texts with equal shingle sets are one node. A node's minima give band keys; then only the low
four bits of each are kept, sixteen to a long. Nodes that share a band key are candidates, bit
counts of the packed signatures estimate their similarity, corrected for chance collisions, and
the full shingle sets confirm a link.

A bucket of thousands of near copies isn't expanded into pairs: its nodes are compared with one
node of it, in a few rounds with another one each, and what is linked becomes one component.
A last round compares, block by block, all nodes of a bucket that are in different components
still, so no link that the bands find is lost: of texts at the threshold 0.85, the bands miss about 1 pair in 10**7
and the estimate (5 standard deviations below the threshold) as many.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, id_and_text, keyed_join, only, written
from .graph import components
from .shingles import ShingleSets, jaccard_at_least, mixed

ROWS = 5
LOW_BITS = 4
#: nodes that a task of the last round holds on one side
BLOCK = 128
LOW_NIBBLES = 0x1111111111111111


def band_count(percent: int) -> int:
    """Bands of ROWS minima that miss a pair at the threshold once in ten million at most."""
    return math.ceil(math.log(1e-7) / math.log(1 - (percent / 100) ** ROWS))


def _width(percent: int) -> int:
    return -(-band_count(percent) * ROWS * LOW_BITS // 64)


def least_matches(percent: int) -> int:
    """Low-bit matches that a pair at the threshold falls below by chance in 5 standard deviations."""
    k, c = _width(percent) * 64 // LOW_BITS, 0.5**LOW_BITS
    p = c + (1 - c) * percent / 100
    return math.floor(k * p - 5 * math.sqrt(k * p * (1 - p)))


def signatures(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(doc_id, n, node, bands array<long>, bits array<long>): node is a 64-bit digest of the set, null if it is empty."""
    width, bands = _width(percent), band_count(percent)
    schema = "doc_id long, n long, node long, bands array<long>, bits array<long>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets, k = ShingleSets(words), width * 64 // LOW_BITS
        seeds = mixed(np.arange(1, 2 * k + 1, dtype=np.uint64))
        times, plus = seeds[:k] | np.uint64(1), seeds[k:]
        shifts = np.arange(0, 64, LOW_BITS, dtype=np.uint64)
        for batch in batches:
            rows = []
            for doc, s in zip(batch["doc_id"].astype("Int64"), sets.sets(batch["text"]), strict=True):
                if not len(s):
                    rows.append((doc, 0, None, None, None))
                    continue
                least = np.full(k, np.iinfo(np.uint64).max, np.uint64)
                for at in range(0, len(s), 1024):
                    np.minimum(least, ((s[at : at + 1024, None] ^ plus) * times).min(axis=0), out=least)
                keys = np.zeros(bands, np.uint64) + np.arange(bands, dtype=np.uint64)
                for r in range(ROWS):
                    keys = mixed(keys + least[r : bands * ROWS : ROWS])
                low = mixed(least) & np.uint64((1 << LOW_BITS) - 1)
                bits = np.bitwise_or.reduce(low.reshape(width, -1) << shifts, axis=1)
                node = int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)
                rows.append((doc, len(s), node, keys.astype(np.int64), bits.astype(np.int64)))
            doc, n, node, keys, bits = zip(*rows, strict=True) if rows else ((),) * 5
            yield pd.DataFrame({"doc_id": pd.array(doc, "Int64"), "n": n, "node": pd.array(node, "Int64"), "bands": keys, "bits": bits})

    return docs.mapInPandas(run, schema)


def matches(a: Column, b: Column, width: int) -> Column:
    """The number of low-bit groups in which two packed signatures agree."""

    def one(i: int) -> Column:
        x = a[i].bitwiseXOR(b[i])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(F.lit(LOW_NIBBLES))
        return F.lit(64 // LOW_BITS) - F.bit_count(x)

    return reduce(lambda p, q: p + q, [one(i) for i in range(width)])


def similarity(a: Column, b: Column, percent: int = 85) -> Column:
    """Collision-corrected estimate of the Jaccard similarity of two packed signatures."""
    c, k = 0.5**LOW_BITS, _width(percent) * 64 // LOW_BITS
    return F.greatest(F.lit(0.0), (matches(a, b, _width(percent)) / F.lit(float(k)) - c) / (1 - c))


def least_estimate(percent: int) -> float:
    """The estimate at least_matches: a pair at the threshold falls below it by chance in 5 standard deviations."""
    c, k = 0.5**LOW_BITS, _width(percent) * 64 // LOW_BITS
    return max(0.0, (least_matches(percent) / k - c) / (1 - c)) - 1e-9


def _digest(s: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(s, digest_size=8).digest(), "little", signed=True)


def _full_sets(nodes: DataFrame, docs: DataFrame, words: int, scratch: Scratch) -> DataFrame:
    """(node, set) of the given (node, doc_id), from the whole texts again: once for all rounds."""

    def full(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets = ShingleSets(words)
        for batch in batches:
            found = [s.tobytes() for s in sets.sets(batch["text"])]
            yield pd.DataFrame({"node": [_digest(s) for s in found], "set": found})

    # null ids match nothing in a join, so those few rows come whole; repeated ids give sets more than once
    asked = only(docs, nodes.select("doc_id"), "doc_id").unionByName(docs.filter("doc_id is null"))
    found = asked.mapInPandas(full, "node long, set binary").dropDuplicates(["node"])
    return scratch.written(found, "sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Of pairs (a, b) of nodes those whose full shingle sets reach the threshold."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = [jaccard_at_least(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(batch["set_a"], batch["set_b"], strict=True)]
            yield batch.loc[keep, ["a", "b"]]

    pairs = scratch.written(pairs, "pairs")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b")
    return scratch.written(both.mapInPandas(check, "a long, b long"), "confirmed")


def _compared(buckets: DataFrame, member: DataFrame, sets: DataFrame, facts: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) between nodes of different components that share a bucket (bucket, node, pivot).

    Buckets with nodes in common are one group (a bucket alone where that is very large, so that a
    set isn't sent more often than it has bands). A group is cut into blocks; a task compares two
    blocks, so no pair of nodes is ever a row, and a link between two components that it has
    found already needs no second one.
    """
    least, limit = least_matches(percent), BLOCK * band_count(percent)
    roots = components(buckets.select(F.col("node").alias("a"), F.col("pivot").alias("b")), scratch)
    placed = buckets.join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("cluster"))
    sizes = placed.select("cluster", "node").distinct().groupBy("cluster").agg(F.count("*").alias("size"))
    sizes = scratch.written(sizes.withColumn("of", F.col("size")), "sizes")
    groups = scratch.written(keyed_join(placed, sizes, ["cluster"]).select(F.when(F.col("of") <= limit, F.col("cluster")).otherwise(F.col("bucket")).alias("group"), "node").distinct(), "groups")
    blocks = scratch.written(groups.groupBy("group").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("size")), "blocks")
    nodes = keyed_join(groups, blocks, ["group"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    sent = nodes.select("group", "node", "block", other).select("group", "node", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
    sets = sets.join(groups.select("node").distinct(), "node", "left_semi")
    data = sets.join(facts.select("node", "n", "bits"), "node").join(member, "node")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node", ignore_index=True)
        node, root, block, n = (rows[c].to_numpy() for c in ("node", "root", "block", "n"))
        bits = np.stack(rows["bits"].to_numpy()).astype(np.int64).view(np.uint64)
        sets = [np.frombuffer(x, np.uint64) for x in rows["set"]]
        number = {r: i for i, r in enumerate(dict.fromkeys(root.tolist()))}
        part = np.array([number[r] for r in root.tolist()])
        across = rows["x"].iloc[0] != rows["y"].iloc[0]
        links = []
        for i in range(len(node)):
            d = bits[i] ^ bits[i + 1 :]
            d |= d >> np.uint64(1)
            d |= d >> np.uint64(2)
            same = bits.shape[1] * (64 // LOW_BITS) - np.bitwise_count(d & np.uint64(LOW_NIBBLES)).sum(axis=1, dtype=np.int64)
            m = n[i + 1 :]
            fit = (same >= least) & (np.minimum(m, n[i]) * 100 >= np.maximum(m, n[i]) * percent) & (part[i + 1 :] != part[i])
            if across:
                fit &= block[i + 1 :] != block[i]
            for j in np.flatnonzero(fit) + i + 1:
                if part[i] != part[j] and jaccard_at_least(sets[i], sets[j], percent):
                    links.append((node[i], node[j]))
                    part[part == part[j]] = part[i]
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    keyed = sent.join(data, "node")
    return scratch.written(keyed.groupBy("group", "x", "y").applyInPandas(compare, "a long, b long"), "links-found")


def near_duplicates(docs: DataFrame, words: int = 3, percent: int = 85, rounds: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs.

    A null, empty or wordless text has no shingles, is linked with nothing and kept. Repeated rows
    are linked with each other; component_id is the smallest doc_id. A null doc_id is never a
    component_id unless a group has no other (then kept is false). Other columns are left out.
    rounds: comparisons of a bucket with one of its nodes before the last, full one.
    """
    docs = id_and_text(docs, id_col, text_col)
    scratch = Scratch(docs.sparkSession)
    keep = scratch.written
    signed = keep(signatures(docs, words, percent), "signatures")
    nodes = keep(signed.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("bits").alias("bits")), "nodes")
    keyed = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    shared = keep(keyed.groupBy("band", "key").agg(F.count("*").alias("size")).filter("size > 1"), "shared")
    buckets = keep(keyed_join(keyed, shared, ["band", "key"]).select(F.xxhash64("band", "key").alias("bucket"), "node"), "buckets")
    facts = keep(nodes.join(buckets.select("node").distinct(), "node", "left_semi").select("node", "doc_id", "n", "bits"), "facts")
    sets = _full_sets(facts.select("node", "doc_id"), docs, words, scratch)
    member = keep(facts.select("node", F.col("node").alias("root")), "member")

    def candidates(pairs: DataFrame) -> DataFrame:
        """pairs (a, b) whose sizes and bit counts allow a link, with the estimate of their similarity."""
        x = facts.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a"))
        y = facts.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b"))
        # many nodes have one pivot, so the pivots' side is the one to be sent to all of them
        pivots = keep(y.join(pairs.groupBy("b").agg(F.count("*").alias("size")), "b"), "pivots")
        both = keyed_join(pairs.join(x, "a"), pivots, ["b"], most=50_000)
        both = both.withColumn("estimate", similarity(F.col("bits_a"), F.col("bits_b"), percent))
        return both.filter((F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent) & (F.col("estimate") >= least_estimate(percent)))

    def rooted(pairs: DataFrame) -> DataFrame:
        """pairs (a, b) of nodes in different components, with those components."""
        ends = member.select(F.col("node").alias("b"), F.col("root").alias("root_b"))
        ends = keep(ends.join(pairs.groupBy("b").agg(F.count("*").alias("size")), "b"), "ends")
        found = keyed_join(pairs.join(member.select(F.col("node").alias("a"), F.col("root").alias("root_a")), "a"), ends, ["b"])
        return found.filter("root_a <> root_b")

    def joined(found: DataFrame) -> DataFrame:
        """member with the components that found links put together."""
        links = keep(rooted(found).select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct(), "root-links")
        moves = components(links, scratch).select(F.col("node").alias("root"), F.col("root").alias("to"))
        moves = keep(moves.join(member.groupBy("root").agg(F.count("*").alias("size")), "root"), "moves")
        if moves.isEmpty():
            return member
        there = keyed_join(member, moves, ["root"]).select("node", F.col("to").alias("root"))
        return keep(only(member, keep(there, "moved").select("node"), "node", "left_anti").unionByName(there), "member")

    for number in range(rounds + 1):
        mixed_ = buckets.join(member, "node").groupBy("bucket").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.min_by("node", F.xxhash64("node", F.lit(number))).alias("pivot"), F.count("*").alias("size"))
        mixed_ = keep(mixed_.filter("r0 <> r1").drop("r0", "r1"), "mixed")
        starred = keep(keyed_join(buckets, mixed_, ["bucket"]), "buckets")
        if starred.isEmpty():
            break
        if number == rounds:
            member = joined(_compared(starred, member, sets, facts, percent, scratch))
            break
        buckets = starred.select("bucket", "node")
        stars = keep(starred.select(F.col("node").alias("a"), F.col("pivot").alias("b")).filter("a <> b").distinct(), "stars")
        far = rooted(keep(candidates(stars), "close"))
        best = far.groupBy("root_a", "root_b").agg(F.max_by(F.struct("a", "b"), F.struct("estimate", "a", "b")).alias("p"))
        member = joined(_confirmed(best.select("p.a", "p.b"), sets, percent, scratch))

    ends = keep(signed.select("doc_id", "n", "node").join(member, "node", "left").select("doc_id", "n", F.coalesce("root", "node").alias("root")), "rooted")
    smallest = ends.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("smallest"), F.count("*").alias("size")).filter("size > 1")
    smallest = keep(smallest, "smallest")
    grouped = keyed_join(ends, smallest, ["root"])
    alone = only(ends.filter("root is not null"), smallest.select("root"), "root", "left_anti").unionByName(ends.filter("root is null")).withColumn("smallest", F.col("doc_id"))
    out = grouped.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), F.col("smallest").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("smallest"), F.lit(False)).alias("kept"))
    out = written(out, "near-duplicates")
    scratch.clear()
    return out
