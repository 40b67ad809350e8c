"""Exact set similarity join by prefix, size and position, and the greedy choice of heads from its pairs.

Tokens are put in order of rarity, so the first few of a set, of which every similar set has one,
are tokens that few sets have: one that all sets have is joined only if a set has nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import written

SLACK = 1e-9


def least_overlap(n: Column, m: Column, threshold: float) -> Column:
    """How many tokens sets of n and m must share at least."""
    return F.ceil((n + m) * (threshold / (1 + threshold)) - SLACK)


def prefixes(sets: DataFrame, by: list[str], threshold: float) -> DataFrame:
    """(by, id, n, token, at): the first tokens of each set in order of rarity, those that no other set has left out; at is the place, from 0."""
    tokens = sets.select(*by, "id", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    counts = tokens.groupBy(*by, "token").agg(F.count("*").alias("c"))
    ranked = tokens.join(counts, [*by, "token"]).groupBy(*by, "id", "n").agg(F.sort_array(F.collect_list(F.struct("c", "token"))).alias("ranked"))
    length = (F.col("n") - F.ceil(F.col("n") * threshold - SLACK) + 1).cast("int")
    first = ranked.select(*by, "id", "n", F.posexplode(F.slice("ranked", F.lit(1), length)).alias("at", "t")).filter("t.c > 1")
    return first.select(*by, "id", "n", F.col("t.token").alias("token"), "at")


def similar_pairs(sets: DataFrame, threshold: float, by: list[str]) -> DataFrame:
    """(by, early, late): ids, the smaller one first, of sets with a Jaccard similarity of threshold, as a written table.

    sets: by (groups within which sets are compared), id (anything with an order, unique in its
    group), tokens (distinct). Empty sets have no pairs, nor have rows with a null in by or id.
    """
    sets = written(sets.filter(F.size("tokens") > 0).select(*by, "id", "tokens"), "sets")
    first = written(prefixes(sets, by, threshold), "prefixes")
    a, b = first.alias("a"), first.alias("b")
    same = " and ".join([*[f"a.{k} = b.{k}" for k in by], "a.token = b.token", "a.id < b.id"])
    n, m = F.col("a.n"), F.col("b.n")
    sizes = F.least(n, m) >= F.greatest(n, m) * threshold - SLACK
    places = 1 + F.least(n - F.col("a.at") - 1, m - F.col("b.at") - 1) >= least_overlap(n, m, threshold)
    met = a.join(b, F.expr(same)).filter(sizes & places).select(*[f"a.{k}" for k in by], F.col("a.id").alias("early"), F.col("b.id").alias("late")).distinct()
    side = lambda name, tokens: sets.select(*by, F.col("id").alias(name), F.col("tokens").alias(tokens))
    both = met.join(side("early", "x"), [*by, "early"]).join(side("late", "y"), [*by, "late"])
    shared = F.size(F.array_intersect("x", "y"))
    return written(both.filter(shared >= F.lit(threshold) * (F.size("x") + F.size("y") - shared) - SLACK).select(*by, "early", "late"), "similar")


def heads(pairs: DataFrame, by: list[str]) -> DataFrame:
    """(by, id, head): in ascending order each id goes to its smallest smaller partner that is a head, or else is one; heads have no row.

    Each round settles the ids that no open id stands before; as many rounds as the longest chain has links.
    """
    on = lambda end: [*by, end]
    named = lambda df, end: df.withColumnRenamed("id", end)
    left, gone = pairs, None
    while not left.isEmpty():
        late = left.select(*by, F.col("late").alias("id")).distinct()
        first = left.select(*by, F.col("early").alias("id")).distinct().join(late, [*by, "id"], "left_anti")
        more = written(left.join(named(first, "early"), on("early"), "left_semi").select(*by, F.col("late").alias("id")).distinct(), "members")
        gone = more if gone is None else gone.unionByName(more)
        left = written(left.join(named(first, "early"), on("early"), "left_anti").join(named(more, "early"), on("early"), "left_anti").join(named(more, "late"), on("late"), "left_anti"), "open")
    if gone is None:
        return pairs.select(*by, F.col("late").alias("id"), F.col("early").alias("head"))
    return pairs.join(named(gone, "early"), on("early"), "left_anti").groupBy(*by, F.col("late").alias("id")).agg(F.min("early").alias("head"))
