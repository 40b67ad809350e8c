"""Jaccard join on word n-grams by prefixes under several token orders.

Under any one order of all tokens, two sets that reach the threshold share a token among the first
few of each. Here they must do so under three orders: all put rare tokens first, by counts of all
documents, and break ties by hashes of their own. The first order's prefixes give buckets; pairs
whose prefixes of the second and the third order don't meet as well are dropped; the full sets
confirm what is left. Texts with equal sets are one node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, id_and_text, keyed_join, only, written
from .linking import Linker
from .shingles import ShingleSets, mixed

ORDERS = 3
#: counters of tokens, by hash: one for about SHARED words of the corpus, between these bounds; a byte each is broadcast, so 64 MB at most
COUNTERS, MOST_COUNTERS, SHARED = 1 << 20, 1 << 26, 16
#: counters of a chunk, in which a task's counters travel
CHUNK = 1 << 18
LOG_STEPS = 8


def prefix_length(n: int, percent: int) -> int:
    """Tokens of which a set of n shares one with every set that reaches the threshold, whatever the order."""
    return n - -(-percent * n // 100) + 1


def counter_number(docs: DataFrame) -> int:
    """A power of two that is about the number of words of all texts by SHARED, within the bounds."""
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return min(MOST_COUNTERS, max(COUNTERS, 1 << (size // (6 * SHARED)).bit_length()))


def token_counts(docs: DataFrame, words: int, counters: int = COUNTERS) -> np.ndarray:
    """How many texts have a token, summed over the tokens of each counter, as LOG_STEPS * log2(count + 1) rounded to a byte.

    A task counts up to 255 a counter; sums of tasks go on from there.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets, total = ShingleSets(words), np.zeros(counters, np.uint8)

        def add(kept: list[np.ndarray]) -> None:
            at, times = np.unique(np.concatenate(kept).astype(np.uint32), return_counts=True)
            total[at] = np.minimum(total[at].astype(np.int64) + times, 255)

        for batch in batches:
            kept, size = [], 0
            for s in sets.sets(batch["text"]):
                kept.append(s & np.uint64(counters - 1))
                size += len(s)
                if size > 1 << 20:
                    add(kept)
                    kept, size = [], 0
            if size:
                add(kept)
        pack = zstandard.ZstdCompressor(level=1)
        for chunk, counts in enumerate(total.reshape(-1, min(CHUNK, counters))):
            if counts.any():
                yield pd.DataFrame({"chunk": np.array([chunk], np.int32), "counts": [pack.compress(counts.tobytes())]})

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        unpack, pack = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for chunk, counts in zip(batch["chunk"], batch["counts"], strict=True):
                more = np.frombuffer(unpack.decompress(counts), np.uint8).astype(np.uint32)
                total[chunk] = total[chunk] + more if chunk in total else more
        for chunk, counts in total.items():
            logs = np.round(np.log2(counts + 1.0) * LOG_STEPS).astype(np.uint8)
            yield pd.DataFrame({"chunk": np.array([chunk], np.int32), "counts": [pack.compress(logs.tobytes())]})

    ddl = "chunk int, counts binary"
    parts = docs.select("text").mapInPandas(count, ddl).repartition("chunk").mapInPandas(add_up, ddl)
    out = np.zeros((counters // min(CHUNK, counters), min(CHUNK, counters)), np.uint8)
    for row in parts.collect():  # MOST_COUNTERS bytes at most, whatever the corpus
        out[row.chunk] = np.frombuffer(zstandard.ZstdDecompressor().decompress(row.counts), np.uint8)
    return out.reshape(-1)


def rarity(logs: np.ndarray) -> np.ndarray:
    """The class of each of the 256 values that a counter may have: 0 up to one more than the mean, then one more for each doubling of what is above the mean."""
    count = 2 ** (np.arange(256) / LOG_STEPS) - 1
    mean = float((np.bincount(logs, minlength=256) * count).sum() / len(logs))
    return np.ceil(np.log2(np.maximum(np.round(count) - np.floor(mean), 1))).astype(np.uint8)


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def prefixes(s: np.ndarray, logs: np.ndarray, classes: np.ndarray, percent: int) -> list[np.ndarray]:
    """The first tokens of a set under each order: the first order goes by the counters, the others by their classes, so that hashes decide more."""
    p, own = prefix_length(len(s), percent), logs[s & np.uint64(len(logs) - 1)]
    out = []
    for number in range(1, ORDERS + 1):
        high = own if number == 1 else classes[own]
        key = (high.astype(np.uint64) << np.uint64(56)) | (mixed(s + mixed(np.full(1, number, np.uint64))) >> np.uint64(8))
        out.append(s[key <= np.partition(key, p - 1)[p - 1]])
    return out


def signatures(docs: DataFrame, words: int, percent: int, counters) -> DataFrame:
    """(doc_id, n, digest, first array<long>, second array<int>, third array<int>); the last two hold the low halves of tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets, logs = ShingleSets(words), counters.value
        classes = rarity(logs)
        for batch in batches:
            rows = []
            for s in sets.sets(batch["text"]):
                if len(s):
                    one, *more = prefixes(s, logs, classes, percent)
                    rows.append((len(s), _digest(s), one.view(np.int64), *(m.astype(np.uint32).view(np.int32) for m in more)))
                else:
                    rows.append((0, None, None, None, None))
            n, digest, one, two, three = zip(*rows, strict=True) if rows else ((),) * 5
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "n": n, "digest": digest, "first": one, "second": two, "third": three})

    return docs.mapInPandas(run, "doc_id long, n long, digest binary, first array<long>, second array<int>, third array<int>")


def _fits(a: str, b: str) -> Column:
    return F.arrays_overlap(f"{a}second", f"{b}second") & F.arrays_overlap(f"{a}third", f"{b}third")


def _meets(a, b) -> bool:
    """As _fits, for two rows (second, third) of sets."""
    return not a[0].isdisjoint(b[0]) and not a[1].isdisjoint(b[1])


def _prepared(rows: pd.DataFrame) -> list:
    return [(frozenset(x), frozenset(y)) for x, y in zip(rows["second"], rows["third"], strict=True)]


def _full_sets(docs: DataFrame, nodes: DataFrame, words: int, scratch: Scratch) -> DataFrame:
    """(node, set) of nodes (node, doc_id, digest), from their whole texts again."""

    def full(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets = ShingleSets(words)
        for batch in batches:
            found = list(sets.sets(batch["text"]))
            yield pd.DataFrame({"digest": [_digest(s) for s in found], "set": [s.tobytes() for s in found]})

    # null ids match nothing in a join, so those few rows come whole; what isn't asked for goes by its digest
    asked = only(docs, scratch.written(nodes.select("doc_id").filter("doc_id is not null").distinct(), "asked"), "doc_id").unionByName(docs.filter("doc_id is null"))
    named = scratch.written(nodes.select("node", "digest").withColumn("size", F.lit(1)), "digest-nodes")
    sets = scratch.written(keyed_join(asked.mapInPandas(full, "digest binary, set binary"), named, ["digest"], most=2_000_000).select("node", "set"), "sets")
    # ids that come more than once may bring a set more than once; only those are shuffled
    twice = scratch.written(sets.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1").select("node"), "twice")
    if twice.isEmpty():
        return sets
    return scratch.written(only(sets, twice, "node", "left_anti").unionByName(only(sets, twice, "node").dropDuplicates(["node"])), "sets")


def jaccard_components(docs: DataFrame, words: int = 3, percent: int = 90, rounds: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs.

    Two texts are linked where 100 * shared shingles >= percent * all shingles of both; component_id
    is the smallest doc_id that links reach. A null, empty or wordless text has no shingles and is
    linked with nothing. Repeated rows are linked with each other; a null doc_id is a component_id
    only if its component has no other. Other columns are left out.
    rounds: comparisons of a bucket with one of its nodes before all that is left is compared.
    """
    docs = id_and_text(docs, id_col, text_col)
    scratch = Scratch(docs.sparkSession)
    keep = scratch.written
    counters = docs.sparkSession.sparkContext.broadcast(token_counts(docs, words, counter_number(docs)))
    signed = keep(signatures(docs, words, percent, counters).withColumn("row", F.monotonically_increasing_id()), "signatures")
    digests = signed.filter("n > 0").groupBy("digest").agg(F.min("row").alias("node"), F.min("doc_id").alias("smallest"), F.count("*").alias("size"))
    digests = keep(digests, "digests")
    nodes = keep(only(signed, digests.select(F.col("node").alias("row")), "row").drop("doc_id").withColumnRenamed("row", "node"), "nodes")
    keyed = nodes.select("node", F.explode("first").alias("bucket"))
    shared = keep(keyed.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1"), "shared")
    buckets = keep(keyed_join(keyed, shared, ["bucket"], most=2_000_000), "buckets")
    met = keep(buckets.select("node").distinct(), "met")
    facts = keep(only(nodes, met, "node").select("node", "n", "second", "third"), "facts")
    ids = only(signed.select(F.col("row").alias("node"), "doc_id", "digest"), met, "node")
    sets = _full_sets(docs, keep(ids, "ids"), words, scratch)
    member = Linker(facts, sets, percent, _fits, _prepared, _meets, scratch).linked(buckets, rounds)

    rooted = keep(digests.join(member, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    roots = keep(rooted.groupBy("root").agg(F.min("smallest").alias("component_id"), F.count("*").alias("size")), "roots")
    named = keep(keyed_join(rooted.select("digest", "root", F.col("size").alias("rows")), roots, ["root"]).select("digest", "component_id", F.col("rows").alias("size")), "named")
    rows = signed.select("doc_id", F.col("n").alias("n_shingles"), "digest")
    out = keyed_join(rows.filter("digest is not null"), named, ["digest"]).drop("digest")
    out = out.unionByName(rows.filter("digest is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    out = written(out.select("doc_id", "n_shingles", "component_id"), "jaccard-components")
    scratch.clear()
    counters.unpersist()
    return out
