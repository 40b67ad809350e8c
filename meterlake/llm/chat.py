"""Preference formatting in DataFrame functions.

The turns that a chosen and a rejected conversation begin with alike are rendered once as the
prompt; what follows in each is its completion, with the spans that count for the loss: the
assistant's texts and their closing marks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def neutral(text: Column) -> Column:
    """text without the template's own marks: `<|im_` in it becomes `<|_im_`, so a turn can't forge another."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|im_"), F.lit("<|_im_"))


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), neutral(role), F.lit("\n"), neutral(text), F.lit(END + "\n"))


def preference_pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """(pair_id, turn, role, text) twice to a row for each pair_id in both: pair_id, prompt_turns, prompt,
    and for chosen and rejected the completion and its mask.

    mask: array of struct<start, end> in code points of the completion, end exclusive; tokens
    outside don't count for the loss. Turns are in order of turn, then role, then text. Null
    roles and texts count as empty. Equal conversations have empty completions. A pair_id that is
    null or in one table only has no row. Other columns are left out. The turns of a conversation
    come together in one row, which is what is rendered of it anyway.
    """

    def numbered(df: DataFrame, side: str) -> DataFrame:
        turns = df.filter("pair_id is not null").select("pair_id", F.coalesce("turn", F.lit(0)).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        ordered = turns.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias(side))
        return ordered

    both = numbered(chosen, "chosen").join(numbered(rejected, "rejected"), "pair_id")
    same = F.zip_with("chosen", "rejected", lambda a, b: (a["role"] == b["role"]) & (a["text"] == b["text"]))
    first = F.array_position(F.transform(same, lambda x: F.coalesce(x, F.lit(False))), False)
    both = both.withColumn("prompt_turns", F.when(first > 0, first - 1).otherwise(F.size("chosen")).cast("int"))

    def text_of(turns: Column) -> Column:
        return F.array_join(F.transform(turns, lambda t: rendered(t["role"], t["text"])), "")

    def rest(side: str) -> Column:
        return F.slice(F.col(side), F.col("prompt_turns") + 1, F.greatest(F.size(side) - F.col("prompt_turns"), F.lit(0)))

    def mask(turns: Column) -> Column:
        """Folds over the turns with the place reached; an assistant's turn adds its text and closing mark."""
        spans = F.array().cast("array<struct<start:int,end:int>>")

        def step(acc: Column, t: Column) -> Column:
            size = F.length(rendered(t["role"], t["text"]))
            begin = acc["at"] + F.length(neutral(t["role"])) + len(START) + 1
            span = F.array(F.struct(begin.cast("int").alias("start"), (acc["at"] + size - 1).cast("int").alias("end")))
            return F.struct((acc["at"] + size).cast("int").alias("at"), F.when(t["role"] == "assistant", F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

        return F.aggregate(turns, F.struct(F.lit(0).alias("at"), spans.alias("spans")), step, lambda a: a["spans"])

    return both.select(
        "pair_id",
        "prompt_turns",
        text_of(F.slice(F.col("chosen"), 1, F.col("prompt_turns"))).alias("prompt"),
        text_of(rest("chosen")).alias("chosen_completion"),
        mask(rest("chosen")).alias("chosen_mask"),
        text_of(rest("rejected")).alias("rejected_completion"),
        mask(rest("rejected")).alias("rejected_mask"),
    )


def swapped_replies(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs for preference data from plain conversations (conv_id, turn, role, text): chosen is a
    conversation with an assistant turn as it is; rejected is the same up to its last assistant
    turn, which has the first assistant reply of the conversation whose id differs in the last
    bit (empty if there is none).
    """
    turns = conversations.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    replies = turns.filter("role = 'assistant'").groupBy("pair_id").agg(F.max("turn").alias("last"), F.min_by(F.coalesce("text", F.lit("")), F.struct("turn", "text")).alias("reply"))
    partner = replies.select(F.col("pair_id").bitwiseXOR(F.lit(1)).alias("pair_id"), F.col("reply").alias("other"))
    ends = replies.select("pair_id", "last").join(partner, "pair_id", "left")
    chosen = turns.join(ends.select("pair_id"), "pair_id", "left_semi")
    before = turns.join(ends.select("pair_id", "last"), "pair_id").filter("turn < last").select("pair_id", "turn", "role", "text")
    swapped = ends.select("pair_id", F.col("last").alias("turn"), F.lit("assistant").alias("role"), F.coalesce("other", F.lit("")).alias("text"))
    return chosen, before.unionByName(swapped)
