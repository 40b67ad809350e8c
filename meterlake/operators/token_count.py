"""Exact token counts with a byte-pair rank table: words are counted first, and each distinct word is merged once."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: how byte-level vocabularies of this kind cut a text into words.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Tokens around each message, and around a conversation.
PER_MESSAGE, PER_CONVERSATION = 3, 3
#: distinct words up to which their counts are sent to all tasks
FEW_WORDS = 500_000


def ranks_of(lines: list[str]) -> dict[bytes, int]:
    """The rank table of a file: a token in base64 and its rank on each line."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def rank_table(spark: SparkSession, path: str) -> dict[bytes, int]:
    """As ranks_of; a vocabulary has some 100,000 to 200,000 lines, whatever the corpus."""
    return ranks_of([r.value for r in spark.read.text(path).collect()])


def merged(word: bytes, ranks: dict[bytes, int]) -> int:
    """How many tokens are left of a word when the pair of lowest rank, the first of equal ones, is merged until none has a rank."""
    if word in ranks or not word:
        return min(1, len(word))
    end = list(range(1, len(word) + 1))  # where the part that begins here ends
    before, left = list(range(-1, len(word) - 1)), len(word)
    pairs: list[tuple[int, int, int]] = []

    def push(at: int) -> None:
        middle = end[at]
        if middle < len(word) and (rank := ranks.get(word[at : end[middle]])) is not None:
            heapq.heappush(pairs, (rank, at, end[middle]))

    for at in range(len(word) - 1):
        push(at)
    alive = [True] * len(word)
    while pairs:
        _, at, till = heapq.heappop(pairs)
        if not alive[at] or end[at] >= till or end[end[at]] != till:
            continue
        middle = end[at]
        alive[middle], end[at] = False, till
        left -= 1
        if till < len(word):
            before[till] = at
            push(at)
        if before[at] >= 0:
            push(before[at])
    return left


def text_tokens(texts: DataFrame, key: str, ranks: dict[bytes, int], text_col: str = "text", pattern: str = PATTERN) -> DataFrame:
    """(key, tokens): how many tokens all texts of a key have; keys of null or empty texts have 0.

    A key's words are counted before they are shuffled, so a word that is everywhere is one row a
    key; each distinct word is merged once.
    """
    kept = texts.sparkSession.sparkContext.broadcast(ranks)
    rows = texts.select(F.col(key).alias("key"), F.coalesce(text_col, F.lit("")).alias("text"))
    words = rows.select("key", F.explode_outer(F.regexp_extract_all("text", F.lit(f"(?U){pattern}"), F.lit(0))).alias("word"))
    counts = words.groupBy("key", "word").agg(F.count("word").alias("n"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"word": batch["word"], "each": [merged(w.encode(), kept.value) for w in batch["word"]]})

    distinct = words.select("word").filter("word is not null").distinct().mapInPandas(run, "word string, each long")
    found = counts.join(distinct, "word", "left")
    return found.groupBy("key").agg(F.coalesce(F.sum(F.col("n") * F.col("each")), F.lit(0)).alias("tokens")).withColumnRenamed("key", key)


def conversation_tokens(turns: DataFrame, key: str, ranks: dict[bytes, int], pattern: str = PATTERN) -> DataFrame:
    """(key, tokens) of conversations (role, text): what their texts and roles have, and the tokens around them."""
    around = turns.groupBy(key).agg((F.count("*") * PER_MESSAGE + PER_CONVERSATION).alias("around"))
    parts = turns.select(key, F.explode(F.array(F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))).alias("text"))
    inside = text_tokens(parts, key, ranks, pattern=pattern)
    # a null key is a conversation of its own
    return inside.join(around.withColumnRenamed(key, "_k"), F.col(key).eqNullSafe(F.col("_k"))).select(key, (F.col("tokens") + F.col("around")).alias("tokens"))
