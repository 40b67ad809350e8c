"""The Merkle manifest against a tree built with plain loops."""

import hashlib
import zlib

import duckdb
import pytest

from meterlake.llm import merkle, queries
from meterlake.llm.merkle import folded, manifest, siblings
from pyspark.sql import functions as F

from .samples import HARD

H = lambda s: hashlib.sha256(s.encode()).hexdigest()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def leaf_of(doc_id, text, lang, source, n_chars):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def climbed(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H("".join(levels[-1][i : i + 2])) for i in range(0, len(levels[-1]), 2)])
    return levels


def path_of(levels, i):
    out = []
    for level in levels[:-1]:
        run = level[i // 2 * 2 : i // 2 * 2 + 2]
        out.append((i % 2, run[1 - i % 2] if len(run) == 2 else ""))
        i //= 2
    return out


def brute(rows):
    """Sorted (doc_id, leaf, subroot, root, proof, folded, verified), None as -1."""
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(*r)))
        trees[lang] = own, climbed([leaf_of(*r) for r in own])
    top = climbed([trees[x][1][-1][0] for x in langs])
    out = []
    for k, lang in enumerate(langs):
        own, levels = trees[lang]
        for i, r in enumerate(own):
            path = path_of(levels, i) + path_of(top, k)
            bent = zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None and r[0] is not None
            now = leaf_of(*r[:4], r[4] + 1) if bent else leaf_of(*r)
            for odd, other in path:
                now = H(other + now if odd else now + other)
            out.append((-1 if r[0] is None else r[0], leaf_of(*r), levels[-1][0], top[-1][0], H("".join(s for _, s in path)), now, now == top[-1][0]))
    return sorted(out)


def run(spark, rows, extra=False):
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        df = df.selectExpr("*", "1 as tree", "2 as rank", "'x' as leaf", "3 as path", "4 as height", "5 as row")
    out = manifest(df).withColumn("folded", folded(F.coalesce("altered", "leaf"), F.col("path"))).withColumn("proof", F.sha2(siblings(F.col("path")), 256))
    got = out.select("doc_id", "leaf", "subroot", "root", "proof", "folded", F.expr("folded = root")).collect()
    return sorted(tuple(-1 if v is None else v for v in r) for r in got)


def rows_of(sizes):
    rows, n = [], 0
    for lang, size in sizes:
        for _ in range(size):
            rows.append((n * 7919 % 100_003, HARD[n % len(HARD)], lang, (None, "web", "é")[n % 3], (None, n, 5)[n % 3]))
            n += 1
    return rows


@pytest.mark.parametrize("levels", [2, 8])
def test_as_plain_loops(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    rows = rows_of([(None, 5), ("de", 1), ("en", 258), ("zz", 2), ("", 3), ("é", 17), ("e", 64), ("f", 65)])
    assert run(spark, rows, extra=True) == brute(rows)


def test_many_trees_and_long_texts(spark):
    rows = rows_of([(f"l{i}", 1 + i % 2) for i in range(300)]) + [(5, "word " * 200_000, "en", "x", 1)]
    assert run(spark, rows) == brute(rows)


def test_repeated_and_null_ids(spark):
    rows = [(None, "a", "en", "x", 1)] * 4 + [(3, "b", "en", "x", 1)] * 3 + [(3, "c", "en", None, 9_223_372_036_854_775_807), (None, None, None, None, None)]
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("n", [0, 1])
def test_hardly_any_rows(spark, n):
    rows = rows_of([("en", n)])
    assert run(spark, rows) == brute(rows) if n else run(spark, rows) == []


def test_as_the_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    cur = con.execute(queries.OP11_SQL)
    names = [d[0] for d in cur.description]
    assert sorted(map(tuple, queries.op11_level_strings(spark, "/root/testdata/sf0.001").select(*names).collect())) == sorted(cur.fetchall())
