"""Components of nodes that share buckets, without making the pairs of a bucket.

The nodes of a bucket are compared with one node of it, in a few rounds with another one each, and
what is linked becomes one component. Then the nodes of buckets that still span components are
dealt to blocks by size, and every two blocks whose sizes allow a link are compared as one task:
first by what the filters need, then, for nodes that have a candidate left, by their full sets.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, keyed_join, only
from .graph import components
from .shingles import jaccard_at_least

#: nodes of a block, about; groups of more than WHOLE blocks are compared bucket by bucket
BLOCK, WHOLE = 128, 64
#: rows of a few numbers each that are sent to all tasks at most, so that wide rows stay where they are
NARROW = 2_000_000
#: rows that a task of the last step holds at once, about: with the columns of the filters, with full sets
LIGHT_ROWS, FULL_ROWS = 2_048, 256
CELL = ["group", "class_x", "x", "class_y", "y"]


class Linker:
    """Links nodes (long ids) whose sets reach 100 * intersection >= percent * union.

    facts: written table (node, n, filter columns). sets: written table (node, set binary).
    fits(a, b) is a condition on the filter columns with those prefixes; prepared(rows) turns the
    filter columns of a pandas frame into a list, and meets(x, y) is the same condition on two of it.
    """

    def __init__(self, facts: DataFrame, sets: DataFrame, percent: int, fits: Callable[[str, str], Column], prepared: Callable[[pd.DataFrame], list], meets: Callable[[object, object], bool], scratch: Scratch):
        self.facts, self.sets, self.percent, self.fits, self.prepared, self.meets, self.keep = facts, sets, percent, fits, prepared, meets, scratch.written
        self.scratch = scratch
        self.sizes = self.keep(facts.select("node", "n"), "node-sizes")
        self.member = self.keep(facts.select("node", F.col("node").alias("root")), "member")

    def beside(self, wide: DataFrame, narrow: DataFrame, on: str) -> DataFrame:
        """wide joined with a written table of few columns, which is sent to all tasks if it isn't large."""
        return wide.join(F.broadcast(narrow) if narrow.count() <= NARROW else narrow, on)

    def candidates(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) whose sizes and filters allow a link; many a have one b."""
        named = lambda df, p: df.select([F.col(c).alias(p if c == "node" else f"{p}_{c}") for c in df.columns])
        # sizes alone come first: they are narrow, and few pairs are left for the wide columns
        for end in ("a", "b"):
            pairs = self.beside(pairs, self.sizes.select(F.col("node").alias(end), F.col("n").alias(f"n_{end}")), end)
        pairs = self.keep(pairs.filter(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * self.percent).select("a", "b"), "candidates")
        ends = self.keep(pairs.groupBy("b").agg(F.count("*").alias("size")), "pivot-sizes")
        pivots = self.keep(self.beside(named(self.facts, "b"), ends, "b"), "pivots")
        both = keyed_join(self.beside(named(self.facts, "a"), pairs, "a"), pivots, ["b"], most=50_000)
        return both.filter(self.fits("a_", "b_")).select("a", "b")

    def rooted(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) of nodes in different components, with those components."""
        ends = self.member.select(F.col("node").alias("b"), F.col("root").alias("root_b"))
        ends = self.keep(ends.join(pairs.groupBy("b").agg(F.count("*").alias("size")), "b"), "ends")
        found = keyed_join(pairs.join(self.member.select(F.col("node").alias("a"), F.col("root").alias("root_a")), "a"), ends, ["b"])
        return found.filter("root_a <> root_b")

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose full sets reach the threshold."""
        percent = self.percent

        def check(batches):
            for batch in batches:
                fit = [jaccard_at_least(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(batch["set_a"], batch["set_b"], strict=True)]
                yield batch.loc[fit, ["a", "b"]]

        pairs = self.keep(pairs, "pairs")

        def side(p: str) -> DataFrame:
            """The sets of one end, and no others."""
            asked = self.keep(pairs.select(F.col(p).alias("node")).distinct(), "asked")
            return only(self.sets, asked, "node").select(F.col("node").alias(p), F.col("set").alias(f"set_{p}"))

        both = self.beside(side("a"), pairs, "a").join(side("b"), "b")
        return self.keep(both.mapInPandas(check, "a long, b long"), "confirmed")

    def join(self, links: DataFrame) -> None:
        """Puts the components of linked nodes together."""
        links = self.keep(self.rooted(links).select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct(), "root-links")
        moves = components(links, self.scratch).select(F.col("node").alias("root"), F.col("root").alias("to"))
        moves = self.keep(moves.join(self.member.groupBy("root").agg(F.count("*").alias("size")), "root"), "moves")
        if not moves.isEmpty():
            there = self.keep(keyed_join(self.member, moves, ["root"]).select("node", F.col("to").alias("root")), "moved")
            self.member = self.keep(only(self.member, there.select("node"), "node", "left_anti").unionByName(there), "member")

    def star(self, buckets: DataFrame) -> None:
        """Compares each node with the pivots of its buckets (bucket, node, pivot)."""
        pairs = self.keep(buckets.select(F.col("node").alias("a"), F.col("pivot").alias("b")).filter("a <> b").distinct(), "stars")
        far = self.rooted(self.keep(self.candidates(self.rooted(pairs).select("a", "b")), "close"))
        best = far.groupBy("root_a", "root_b").agg(F.min(F.struct("a", "b")).alias("p"))
        self.join(self.confirmed(best.select("p.a", "p.b")))

    def cells(self, buckets: DataFrame) -> DataFrame:
        """(group, class_x, x, class_y, y, node, class, sub): the nodes of each two blocks that are to be compared.

        Buckets with nodes in common are one group, or a bucket alone where that is very large. A
        class holds sizes within a factor of the threshold, so a link stays in a class or goes to the next.
        """
        roots = components(buckets.select(F.col("node").alias("a"), F.col("pivot").alias("b")), self.scratch)
        placed = buckets.join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("cluster"))
        sizes = placed.select("cluster", "node").distinct().groupBy("cluster").agg(F.count("*").alias("size"))
        sizes = self.keep(sizes.withColumn("of", F.col("size")), "sizes")
        group = F.when(F.col("of") <= BLOCK * WHOLE, F.col("cluster")).otherwise(F.col("bucket")).alias("group")
        groups = keyed_join(placed, sizes, ["cluster"]).select(group, "node").distinct()
        step = max(0.01, math.log(100 / self.percent) * 1.0001)
        groups = self.keep(groups.join(self.facts.select("node", F.floor(F.log("n") / step).cast("int").alias("class")), "node"), "groups")
        blocks = self.keep(groups.groupBy("group", "class").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("subs"), F.count("*").alias("size")), "blocks")
        beside = lambda by, name: blocks.select("group", (F.col("class") + by).alias("class"), F.col("subs").alias(name))
        blocks = self.keep(blocks.join(beside(-1, "up"), ["group", "class"], "left").join(beside(1, "down"), ["group", "class"], "left"), "neighbours")
        nodes = keyed_join(groups, blocks, ["group", "class"]).withColumn("sub", F.pmod(F.xxhash64("node"), F.col("subs")).cast("int"))

        def each(count: str, cell) -> Column:
            return F.when(F.col(count) > 0, F.transform(F.sequence(F.lit(0), F.col(count) - 1), cell)).otherwise(F.array().cast("array<struct<a:int,x:int,b:int,y:int>>"))

        struct = lambda a, x, b, y: F.struct(a.alias("a"), x.alias("x"), b.alias("b"), y.alias("y"))
        c, sub = F.col("class"), F.col("sub")
        mine = each("subs", lambda j: struct(c, F.least(sub, j), c, F.greatest(sub, j)))
        cells = F.concat(mine, each("up", lambda j: struct(c, sub, c + 1, j)), each("down", lambda j: struct(c - 1, j, c, sub)))
        out = nodes.select("group", "node", "class", "sub", F.explode(cells).alias("cell"))
        return out.select("group", F.col("cell.a").alias("class_x"), F.col("cell.x").alias("x"), F.col("cell.b").alias("class_y"), F.col("cell.y").alias("y"), "node", "class", "sub")

    def compare(self, buckets: DataFrame) -> None:
        """Links between nodes of different components that share a bucket (bucket, node, pivot): all of them that matter.

        Many cells go to one call of Python, so small ones cost little. First only the columns of
        the filters are sent; full sets follow for the nodes that have a candidate left in a cell.
        """
        percent, prepared, meets = self.percent, self.prepared, self.meets
        sent = self.keep(self.cells(buckets), "cells")
        asked = self.keep(sent.select("node").distinct(), "asked")
        light = self.keep(only(self.facts, asked, "node").join(only(self.member, asked, "node"), "node"), "light")

        def pairs(rows: pd.DataFrame) -> Iterator[tuple[int, int]]:
            """Places of rows, sorted by cell, that sizes, components, blocks and filters leave."""
            n, root, cls, sub = (rows[c].to_numpy() for c in ("n", "root", "class", "sub"))
            cell = rows[CELL].to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]).any(axis=1), [True]]))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                across, ready = tuple(cell[a, 1:3]) != tuple(cell[a, 3:5]), None
                for i in range(a, b - 1):
                    m = n[i + 1 : b]
                    fit = (np.minimum(m, n[i]) * 100 >= np.maximum(m, n[i]) * percent) & (root[i + 1 : b] != root[i])
                    if across:
                        fit &= (cls[i + 1 : b] != cls[i]) | (sub[i + 1 : b] != sub[i])
                    found = np.flatnonzero(fit) + i + 1
                    if len(found) and ready is None:  # for one cell at a time
                        ready = prepared(rows.iloc[a:b])
                    for j in found.tolist():
                        if meets(ready[i - a], ready[j - a]):
                            yield i, j

        def first(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values([*CELL, "node"], ignore_index=True)
            left = np.zeros(len(rows), bool)
            for i, j in pairs(rows):
                left[i] = left[j] = True
            return rows.loc[left, [*CELL, "node", "class", "sub"]]

        def second(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values([*CELL, "node"], ignore_index=True)
            sets, node, root = [np.frombuffer(x, np.uint64) for x in rows["set"]], rows["node"].to_numpy(), rows["root"].tolist()
            end, links = {r: r for r in root}, []

            def find(r: int) -> int:
                while end[r] != r:
                    r = end[r] = end[end[r]]
                return r

            for i, j in pairs(rows):
                a, b = find(root[i]), find(root[j])
                if a != b and jaccard_at_least(sets[i], sets[j], percent):
                    links.append((node[i], node[j]))
                    end[a] = b
            return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

        def dealt(df: DataFrame, rows: int) -> DataFrame:
            """A written table df with a number for the cells that are worked on together."""
            return df.withColumn("lot", F.pmod(F.xxhash64(*CELL), F.lit(max(1, df.count() // rows))))

        names = "group long, class_x int, x int, class_y int, y int, node long, class int, sub int"
        left = self.keep(self.beside(light, dealt(sent, LIGHT_ROWS), "node").groupBy("lot").applyInPandas(first, names), "cells-left")
        full = only(self.sets, self.keep(left.select("node").distinct(), "asked"), "node")
        found = self.beside(light, dealt(left, FULL_ROWS), "node").join(full, "node").groupBy("lot").applyInPandas(second, "a long, b long")
        self.join(self.keep(found, "links-found"))

    def linked(self, buckets: DataFrame, rounds: int = 2) -> DataFrame:
        """(node, root) for every node of facts; buckets (bucket, node) is a written table."""
        for number in range(rounds + 1):
            pivot = F.min_by("node", F.xxhash64("node", F.lit(number))).alias("pivot")
            mixed = buckets.join(self.member, "node").groupBy("bucket").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), pivot, F.count("*").alias("size"))
            # a bucket of two has no pair left after the first round
            mixed = self.keep(mixed.filter("r0 <> r1" if not number else "r0 <> r1 and size > 2").drop("r0", "r1"), "mixed")
            starred = self.keep(keyed_join(buckets, mixed, ["bucket"]), "buckets")
            if starred.isEmpty():
                break
            if number == rounds:
                self.compare(starred)
            else:
                self.star(starred)
                buckets = starred.select("bucket", "node")
        return self.member
