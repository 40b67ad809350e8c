"""Hard negatives against all pairs in plain Python."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from meterlake.llm import negatives, queries
from meterlake.llm.negatives import hard_negatives, vectors

SCHEMA = "vec_id long, label int, embedding array<float>"


def brute(rows, positives=5, k=5):
    whole = []
    for vec_id, label, v in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole.append((vec_id, label, [math.floor(256 * float(x)) for x in v]))
    clip = lambda s: min(max(s, -(2**63)), 2**63 - 1)
    order = lambda x: (-x[1], x[0] is None, x[0] or 0)
    out = []
    for at, (a, label, v) in enumerate(whole):
        if a is None or a % 100:
            continue
        scored = [(r, clip(sum(x * y for x, y in zip(v, w))), other) for i, (r, other, w) in enumerate(whole) if i != at]
        best = sorted([x for x in scored if x[2] == label], key=order)[:positives]
        for p, score, _ in best:
            fit = sorted([x for x in scored if x[2] != label and 80 * score <= 100 * x[1] <= 100 * score], key=order)[:k]
            out += [(a, -1 if p is None else p, i, -1 if x[0] is None else x[0], score, x[1]) for i, x in enumerate(fit, 1)]
    return sorted(out)


def run(spark, rows, extra=False):
    df = spark.createDataFrame([(i, x, None if v is None else [None if c is None else float(c) for c in v]) for i, x, v in rows], SCHEMA)
    if extra:
        df = df.selectExpr("*", "1 as key", "2 as vec", "'x' as block", "3 as rank")
    got = hard_negatives(vectors(df), F.col("vec_id") % 100 == 0).collect()
    return sorted(tuple(-1 if v is None else v for v in r) for r in got)


def clusters(n=700, dims=20, seed=3, spread=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims))
    rows = []
    for i in range(n):
        v = centres[i % 6] + rng.normal(size=dims) * spread
        rows.append((i, int((i * 7 // 3) % 4), (v / np.linalg.norm(v)).astype(np.float32)))
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_as_all_pairs(spark, monkeypatch, small):
    if small:  # several blocks of anchors, dealt by a shuffle, and many of rows
        for name, value in (("ANCHORS", 2), ("BLOCK_BYTES", 2048), ("BROADCAST", 1), ("SALTS", 3), ("CELLS", 64)):
            monkeypatch.setattr(negatives, name, value)
    rows = clusters()
    want = brute(rows)
    assert len(want) > 60
    assert run(spark, rows, extra=True) == want


def test_bounds_hold_and_refine():
    rng = np.random.default_rng(1)

    def side(n):
        vec = (rng.normal(size=(n, 64)) * 100).astype(np.int64)
        row = {"key": np.arange(n).tobytes(), "id": np.arange(n).tobytes(), "label": np.zeros(n, np.int64).tobytes(), "known": np.ones(n, bool).tobytes(), "wanted": np.zeros((n, 5), np.int64).tobytes(), "vec": vec.tobytes()}
        return negatives.Side(row, "", 64), vec

    (a, x), (r, y) = side(30), side(50)
    true = x @ y.T
    low, high = negatives.dense_bounds(a, slice(0, 30), r)
    assert (low <= true).all() and (true <= high).all()
    i, j = np.nonzero(np.ones((30, 50), bool))
    low2, high2 = negatives.pair_bounds(a, i, r, j)
    assert (low2 <= true[i, j]).all() and (true[i, j] <= high2).all()
    assert (high2 - low2).mean() < (high - low).mean()
    assert (negatives.scores(a, i, r, j) == true[i, j]).all()


def test_nulls_ties_repeats_and_lengths(spark):
    nan, inf = float("nan"), float("inf")
    same = [(i, i % 3, [0.5, 0.25]) for i in range(95, 130)] + [(100, 1, [0.5, 0.25])] * 3 + [(None, 1, [0.5, 0.25]), (None, 2, [0.5, 0.25])]
    odd = [(200, None, [1.0]), (300, 1, None), (400, 1, [nan]), (500, 1, [inf, 0.0]), (600, 1, [None, 1.0]), (0, 1, []), (700, 2, [1.0, 0.0, 3.0]), (701, 2, [2.0] * 40), (702, 1, [2.0] * 41), (-100, 3, [-1.0]), (-99, 3, [-1.0])]
    rows = same + odd
    assert run(spark, rows) == brute(rows)


def test_hot_vector(spark):
    rows = clusters(300) + [(1000 + i, 1 + i % 2, clusters(1)[0][2]) for i in range(400)]
    assert run(spark, rows) == brute(rows)


def test_scores_beyond_53_bits(spark):
    rows = [(i, i % 2, [2.0**20 * (1 + i), -(2.0**19), 2.0**40]) for i in range(0, 200, 10)] + [(5, 1, [2.0**60, 2.0**60]), (300, 0, [2.0**30, 2.0**31])]
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(1, 1, [1.0])], [(100, 1, [1.0])]])
def test_hardly_any_rows(spark, rows):
    assert run(spark, rows) == []


def test_as_the_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.01/embeddings.parquet'")
    cur = con.execute(queries.OP13_SQL)
    names = [d[0] for d in cur.description]
    got = queries.op13_segment_summaries(spark, "/root/testdata/sf0.01").select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(cur.fetchall())
