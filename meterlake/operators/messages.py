"""Near-duplicate messages of a conversation: word-trigram sets, exact Jaccard, greedy heads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import let
from ..functions.tables import written
from .similar import heads, similar_pairs

WORD = r"[\p{L}\p{Nd}]+"


def trigrams(text: Column) -> Column:
    """The set of word trigrams in lower case; of fewer than three words the words and pairs."""

    def made(w: Column) -> Column:
        at = lambda n: F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0)))
        joined = lambda n: F.transform(at(n), lambda i: F.array_join(F.slice(w, i + 1, n), " "))
        short = F.concat(w, F.when(F.size(w) == 2, joined(2)).otherwise(F.array().cast("array<string>")))
        return F.array_distinct(F.when(F.size(w) >= 3, joined(3)).otherwise(short))

    return let(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), made)


def near_duplicates(turns: DataFrame, threshold: float = 0.85, least_bytes: int = 200, system: bool = False) -> DataFrame:
    """(conv_id, turn, head_turn, head_nr, dropped_bytes): each message that repeats an earlier one of its role.

    A message goes to the earliest message before it that is a head and whose trigrams have a
    Jaccard similarity of threshold; else it is a head itself. Short messages and (unless `system`
    is true) system ones take no part. head_nr: the head's place in its conversation, from 1.
    Messages with equal sets are one, so a conversation that says one thing often makes no pairs;
    of the others only those that share a rare trigram are looked at. Sets and pairs are written
    tables, so turns are read once.
    Null texts, roles and ids take no part. Ties of turn: by text.
    """
    numbered = turns.select("conv_id", "turn", "role", "text", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "text")).alias("nr"))
    able = numbered.filter((F.octet_length("text") >= least_bytes) & (F.lit(system) | (F.col("role") != "system"))).withColumn("set", F.array_sort(trigrams(F.col("text")))).filter(F.size("set") > 0)
    same = Window.partitionBy("conv_id", "role", "set")
    keyed = written(able.withColumn("first", F.min("nr").over(same)), "messages")
    by = ["conv_id", "role"]
    pairs = similar_pairs(keyed.filter("nr = first").select(*by, F.col("nr").alias("id"), F.col("set").alias("tokens")), threshold, by)
    found = heads(pairs, by).select(*by, F.col("id").alias("nr"), "head")
    # a copy of a head goes to it, a copy of a member to the member's head
    found = keyed.select("conv_id", "role", "turn", "nr", "first", F.octet_length("text").alias("bytes")).join(found.withColumnRenamed("nr", "first"), ["conv_id", "role", "first"], "left")
    found = found.withColumn("head_nr", F.coalesce("head", "first")).filter("head_nr < nr")
    at = keyed.select("conv_id", F.col("nr").alias("head_nr"), F.col("turn").alias("head_turn"))
    return found.join(at, ["conv_id", "head_nr"]).select("conv_id", "turn", "head_turn", "head_nr", F.col("bytes").alias("dropped_bytes"))


def placeholder(head_nr: Column) -> Column:
    """What stands for a message that repeats the head_nr-th of its conversation."""
    return F.format_string("[duplicate of message #%d — omitted by dedupe]", head_nr)


def collapsed(turns: DataFrame, **how) -> DataFrame:
    """turns with a pointer to its head in place of each message that repeats an earlier one."""
    found = near_duplicates(turns, **how).select("conv_id", "turn", F.col("head_nr").alias("pointed"))
    out = turns.join(found, ["conv_id", "turn"], "left")
    return out.withColumn("text", F.when(F.col("pointed").isNotNull(), placeholder(F.col("pointed"))).otherwise(F.col("text"))).select(*turns.columns)
