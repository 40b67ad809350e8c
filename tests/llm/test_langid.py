import numpy as np
import pytest
from pyspark.sql import functions as F

from meterlake.llm.langid import codewords, held_out, identify, learn

from .samples import HARD, docs

DATA = "/root/testdata/sf0.01/documents.parquet"


def test_held_out_accuracy(spark):
    rows = spark.read.parquet(DATA)
    model = learn(rows.filter(~held_out(F.col("doc_id"))))
    out = identify(rows.filter(held_out(F.col("doc_id"))), model)
    right = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97 and model.languages == ["de", "en", "es", "fr"]
    sure = out.filter("not ambiguous").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert sure >= right


def test_hard_texts(spark):
    model = learn(docs(spark).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b")))
    for r in identify(docs(spark, extra=True).withColumn("score", F.lit("x")), model).collect():
        text = HARD[r.doc_id]
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text or ""))
        assert 0 <= r.score <= 1 and r.n_chars == 3


def test_few_languages(spark):
    one = learn(docs(spark, ["abc"]).withColumn("lang", F.lit("x")))
    assert one.predict("q")[0] == "x" and one.predict("1")[0] == "und"
    none = learn(docs(spark, ["abc"]).withColumn("lang", F.lit(None).cast("string")))
    assert none.predict("abc")[0] == "und"


def test_codewords_differ():
    for n in (2, 4, 5, 9, 30):
        code = codewords(n)
        assert len(np.unique(code, axis=0)) == n and (np.abs(code.sum(axis=0)) < n).all()


def test_empty_table_repeats_and_dirty_labels(spark):
    rows = spark.createDataFrame([(None, "le chat", "fr"), (None, "le chat", "fr"), (3, "the cat", "en"), (3, "the cat", "en")], "doc_id long, text string, lang string")
    model = learn(rows)
    assert identify(rows.limit(0), model).count() == 0 and learn(rows.limit(0)).languages == []
    assert sorted(r.lang_pred for r in identify(rows, model).collect()) == ["en", "en", "fr", "fr"]
    with pytest.raises(ValueError, match="over 2 distinct"):
        learn(docs(spark, ["a", "b", "c"]).withColumn("lang", F.col("doc_id").cast("string")), most_languages=2)


def plain_grams(text):
    """Classes of a text's 2- and 3-grams, one at a time."""
    m, out = 1 << 64, []
    padded = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    chars = [ord(c) for i, c in enumerate(padded) if not i or c != " " or padded[i - 1] != " "]
    if len(chars) < 2 or all(c == 32 for c in chars):
        return out
    two = [(a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F) % m for a, b in zip(chars, chars[1:])]
    three = [(g * 0x165667B19E3779F9 + c * 0x27D4EB2F165667C5) % m for g, c in zip(two, chars[2:])]
    for g in two + three:
        out.append(((g ^ (g >> 29)) * 0xBF58476D1CE4E5B9 % m) >> 50)
    return out


def plain_predictions(rows):
    """(lang_pred, score) by doc_id of rows (doc_id, text, lang), by loops over all splits of the languages in two."""
    import math
    import zlib
    from collections import Counter

    counts = {}
    for doc_id, text, lang in rows:
        if text is not None and lang is not None and zlib.crc32(str(doc_id).encode()) % 3 != 1 and (g := plain_grams(text)):
            counts.setdefault(lang, Counter()).update(g)
    languages, dims = sorted(counts), 1 << 14
    total = {x: sum(counts[x].values()) + dims / 2 for x in languages}
    share = lambda x, g: (counts[x][g] + 0.5) / total[x]
    bits = []
    for split in range((1 << (len(languages) - 1)) - 1):
        up = [x for i, x in enumerate(languages) if i == 0 or split >> (i - 1) & 1]
        down = [x for x in languages if x not in up]
        p = [sum(share(x, g) for x in up) / len(up) for g in range(dims)]
        n = [sum(share(x, g) for x in down) / len(down) for g in range(dims)]
        w = [math.log(a / b) for a, b in zip(p, n)]
        high, low = sum(a * b for a, b in zip(p, w)), sum(a * b for a, b in zip(n, w))
        bits.append((up, w, (high + low) / 2, (high - low) / 2))
    out = {}
    for doc_id, text, _ in rows:
        g = plain_grams(text or "")
        if not g:
            out[doc_id] = ("und", 0.0)
            continue
        loss = dict.fromkeys(languages, 0.0)
        for up, w, middle, spread in bits:
            margin = (sum(w[x] for x in g) / len(g) - middle) / spread
            for x in languages:
                loss[x] += math.exp(-max(-3.0, min(3.0, margin if x in up else -margin))) * spread / sum(b[3] for b in bits)
        least = min(loss.values())
        near = {x: math.exp(-4 * (v - least)) for x, v in loss.items()}
        best = max(languages, key=lambda x: near[x])
        out[doc_id] = (best, near[best] / sum(near.values()))
    return out


def test_as_plain_loops(spark):
    from meterlake.llm.queries import op8_output_codes

    data = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang").collect()]
    want = plain_predictions(rows)
    got = {r.doc_id: (r.lang_pred, r.score) for r in op8_output_codes(spark, data).collect()}
    assert got.keys() == want.keys()
    for doc_id, (lang, score) in want.items():
        assert got[doc_id][0] == lang and abs(got[doc_id][1] - score) < 1e-3
