"""Token counts against the public library."""

import random

import public_tokenizers
import pytest
import tiktoken

from meterlake.operators import token_count
from meterlake.operators.token_count import PATTERN, conversation_tokens, merged, ranks_of, text_tokens

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
with open(PATH) as f:
    RANKS = ranks_of(f.read().splitlines())
LIBRARY = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})
TEXTS = ["", None, " ", "hello world", "it's  we'll\n\n x", "Émile naïve ǅ ñ", "tab\tsep \t x\r\ny", "x" * 4000, "日本語 テキスト 😀😀", "1234567890 12 345", "\x1c a\x1fb \x85 c   d", "½ ² ⅷ", "a" * 50 + "b" * 50, "The the THE   \n", "'s 'S don't '", "word " * 3000]


def count(text):
    return len(LIBRARY.encode_ordinary(text or ""))


def test_merging():
    rng = random.Random(2)
    for _ in range(500):
        word = bytes(rng.choice(b"abet hsi\xc3\xa9n") for _ in range(rng.randint(0, 30)))
        assert merged(word, RANKS) == len(LIBRARY._encode_single_piece(word)) if word else merged(word, RANKS) == 0


def test_texts(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "again the same"), (None, "no key"), (None, "no key")]
    df = spark.createDataFrame(rows, "doc long, text string").selectExpr("*", "1 as key", "2 as word", "3 as n")
    got = {r.doc: r.tokens for r in text_tokens(df, "doc", RANKS).collect()}
    want = {i: count(t) for i, t in enumerate(TEXTS)}
    want[3] += count("again the same")
    want[None] = 2 * count("no key")
    assert got == want
    assert text_tokens(df.limit(0), "doc", RANKS).collect() == []


def test_conversations(spark):
    rows = [(1, "user", "hello there"), (1, "assistant", None), (2, None, ""), (None, "user", "x y"), (None, "user", "x y")]
    df = spark.createDataFrame(rows, "conv long, role string, text string")
    got = {r.conv: r.tokens for r in conversation_tokens(df, "conv", RANKS).collect()}
    one = lambda role, text: count(role) + count(text) + token_count.PER_MESSAGE
    assert got == {1: 3 + one("user", "hello there") + one("assistant", ""), 2: 3 + one("", ""), None: 3 + 2 * one("user", "x y")}


@pytest.mark.parametrize("table", ["conversations"])
def test_a_whole_table(spark, table):
    from meterlake.plans.more_queries import QUERIES

    data = "/root/testdata/sf0.001"
    turns = spark.read.parquet(f"{data}/{table}.parquet").collect()
    want = {}
    for t in turns:
        want[t.conv_id] = want.get(t.conv_id, 3) + 3 + count(t.role) + count(t.text)
    assert {r.conv_id: r.tokens for r in QUERIES["exact_tokens"](spark, data).collect()} == want
