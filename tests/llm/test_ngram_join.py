"""The n-gram Jaccard join against all pairs of sets, its filters and its order of tokens."""

import duckdb
import numpy as np
import pytest

from meterlake.llm import linking, ngram_join, queries
from meterlake.llm.ngram_join import jaccard_components, prefix_length, prefixes, rarity

from .samples import HARD, docs
from .test_minhash import brute, corpus


def run(spark, texts, percent=90, **more):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs(spark, texts, extra=True), 3, percent, **more).collect()}


@pytest.mark.parametrize("percent,rounds,block", [(90, 3, 128), (80, 0, 4), (90, 1, 4), (100, 1, 128)])
def test_same_groups_as_brute_force(spark, monkeypatch, percent, rounds, block):
    monkeypatch.setattr(linking, "BLOCK", block)
    texts = corpus()
    assert run(spark, texts, percent, rounds=rounds) == brute(texts, 3, percent)


@pytest.mark.parametrize("whole", [1, 64])
def test_a_passage_in_many_texts(spark, monkeypatch, whole):
    """Texts that share a long passage and little else, copies of some, and edits on either side of the threshold."""
    monkeypatch.setattr(linking, "WHOLE", whole)
    monkeypatch.setattr(linking, "BLOCK", 8)
    rng = np.random.default_rng(8)
    vocab = np.array([f"v{i}" for i in range(3000)])
    shared = " ".join(rng.choice(vocab, 60))
    texts = []
    for _ in range(60):
        own = list(rng.choice(vocab, int(rng.integers(0, 12))))
        texts.append(" ".join(own) + " " + shared)
    for size in (30, 61, 122):
        base = list(rng.choice(vocab, size))
        for edits in range(6):
            for _ in range(4):
                now = list(base)
                now[:edits] = rng.choice(vocab, edits)
                texts.append(" ".join(now))
    texts += texts[:5]
    assert run(spark, texts, rounds=1) == brute(texts, 3, 90)


def test_prefixes_meet_for_every_pair_at_the_threshold():
    rng = np.random.default_rng(2)
    logs = rng.integers(0, 100, ngram_join.COUNTERS).astype(np.uint8)
    classes = rarity(logs)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        away = (len(a) * 10) // 190  # replaced tokens: the intersection stays at 90 % of the union
        b = np.unique(np.concatenate([a[away:], rng.integers(0, 2**63, away, dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        assert 100 * both >= 90 * (len(a) + len(b) - both)
        for x, y in zip(prefixes(a, logs, classes, 90), prefixes(b, logs, classes, 90), strict=True):
            assert len(np.intersect1d(x, y))
        assert all(len(x) == prefix_length(len(a), 90) for x in prefixes(a, logs, classes, 90))


def test_orders_put_rare_tokens_first():
    counts = np.full(ngram_join.COUNTERS, ngram_join.LOG_STEPS, np.uint8)  # once each
    counts[:100] = 100
    s = np.arange(1000, dtype=np.uint64)
    for x in prefixes(s, counts, rarity(counts), 90):
        assert x.min() >= 100 and len(x) == 101


def test_counts_cover_all_texts(spark):
    texts = ["a b c d", "a b c", "b c d", "", None] * 50
    counts = ngram_join.token_counts(docs(spark, texts).fillna(""), 3)
    assert counts[counts > 0].tolist() == [round(ngram_join.LOG_STEPS * np.log2(101))] * 2
    assert ngram_join.counter_number(docs(spark, texts).fillna("")) == ngram_join.COUNTERS


def test_null_and_repeated_ids(spark):
    rows = [(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (None, "x y z"), (None, "x y z"), (3, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(str, jaccard_components(df).collect()))
    want = [(None, 4, 7), (7, 4, 7), (7, 4, 7), (None, 1, None), (None, 1, None), (3, 0, 3), (3, 0, 3)]
    assert got == sorted(f"Row(doc_id={a}, n_shingles={b}, component_id={c})" for a, b, c in want)


def test_very_long_texts(spark):
    base = [f"w{i % 5003}x{i}" for i in range(200_000)]
    near, far = list(base), list(base)
    near[:3000], far[:30_000] = ["q"] * 3000, ["q"] * 30_000
    texts = [" ".join(base), " ".join(near), " ".join(far)]
    assert [v[1] for _, v in sorted(run(spark, texts).items())] == [0, 0, 2]


@pytest.mark.parametrize("texts", [[], ["", None, " \t"], ["one"]])
def test_hardly_any_rows(spark, texts):
    assert run(spark, texts) == brute(texts, 3, 90)


def test_as_the_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    cur = con.execute(queries.OP12_SQL)
    names = [d[0] for d in cur.description]
    assert sorted(map(tuple, queries.op12_prefix_orders(spark, "/root/testdata/sf0.001").select(*names).collect())) == sorted(cur.fetchall())


def test_hard_texts(spark):
    texts = HARD * 3
    assert run(spark, texts) == brute(texts, 3, 90)
