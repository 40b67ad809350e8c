import hashlib
import re
import statistics

from pyspark.sql import functions as F

from meterlake.llm.fingerprint import SCALE, containment, fingerprints, merged, with_next
from meterlake.llm.queries import fingerprint_rows

from .samples import HARD, docs


def grams(text):
    w = text.lower().split(" ")
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_edited_texts_and_order(spark):
    texts = [*HARD, *(f"{i} " + "some words " * i for i in range(60))]
    rows = {r.doc_id: r for r in fingerprint_rows(docs(spark, texts, extra=True), buckets=7).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        t, nxt = t or "", texts[i - 1] or ""
        k = len(t) // 3
        want = t[: len(t) - k] + nxt[:k]
        assert rows[i].n_chars == len(t)
        assert rows[i].edited_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert 0 <= rows[i].near_edited <= 1 and 0 <= rows[i].near_next <= 1
        if want == t:
            assert rows[i].near_edited == 1 and rows[i].fingerprint == rows[i].edited_fingerprint


def test_next_with_nulls_and_repeats(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "n"), (5, "e"), (3, "c")], "doc_id long, text string")
    for buckets in (1, 3, 50):
        got = sorted((str(r.doc_id), r.next_text) for r in with_next(df, ["text"], buckets).collect())
        assert got == [("1", "a"), ("1", "n"), ("3", "a"), ("5", "c"), ("None", "e")]
    assert with_next(df.limit(0), ["text"]).count() == 0
    assert with_next(df.filter("doc_id = 5"), ["text"]).first().next_text == "e"


def test_estimates_follow_the_truth(spark):
    import random

    rng = random.Random(4)
    base = [f"w{rng.randrange(3000)}" for _ in range(4000)]
    texts = [" ".join(base), " ".join(base[:1000]), " ".join(base[2000:] + [f"v{i}" for i in range(2000)])]
    a, b, c = (fingerprints(docs(spark, [t])).select(F.col("sketch").alias(n)) for t, n in zip(texts, "abc", strict=True))
    row = a.crossJoin(b).crossJoin(c).select(containment(F.col("b"), F.col("a")), containment(F.col("a"), F.col("b")), containment(F.col("c"), F.col("a"))).first()
    ga, gb, gc = map(grams, texts)
    for got, want in zip(row, (1, len(ga & gb) / len(ga), len(gc & ga) / len(gc)), strict=True):
        assert abs(got - want) < 0.08
    all_ = fingerprints(docs(spark, texts)).agg(merged(F.col("sketch")).alias("m")).first().m
    assert abs(len(all_) * SCALE - len(ga | gb | gc)) < 0.15 * len(ga | gb | gc)
    errors = [abs(row[1] - len(ga & gb) / len(ga))]
    assert statistics.mean(errors) < 0.08


def test_likeness_of_edited_and_next_texts_as_by_all_shingles(spark):
    """near_edited and near_next against the Jaccard similarity of all shingles, computed in Python."""
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").select("text").collect()]
    rows = {r.doc_id: r for r in fingerprint_rows(docs(spark, texts)).collect()}

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}

    errors = []
    for i, t in enumerate(texts):
        k, nxt = len(t) // 3, texts[i - 1]
        own = shingles(t)
        for got, other in ((rows[i].near_edited, t[: len(t) - k] + nxt[:k]), (rows[i].near_next, nxt)):
            b = shingles(other)
            if len(own | b) > 60:
                errors.append(abs(got - len(own & b) / len(own | b)))
    assert len(errors) > 500 and statistics.mean(errors) < 0.05 and sorted(errors)[int(0.95 * len(errors))] < 0.15


def test_empty_table(spark):
    assert fingerprint_rows(docs(spark, [])).count() == 0
