import corpus_pipeline
import public_tokenizers
from meterlake.llm.langid import held_out, learn
from meterlake.llm.pii import base_spans
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .test_minhash import brute

DATA = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    extra = spark.createDataFrame([(10**6, None, None, None, 0), (10**6 + 1, "12 34", "en", "s", 5), (10**6 + 2, "a mail to a@b.org now", "en", "s", 21)], docs.schema)
    docs = docs.unionByName(extra)
    kept = docs
    results = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, kept, DATA)
        assert i == 3 or out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{i}")
        kept = spark.read.parquet(f"{tmp_path}/{i}")
        results.append(kept)
    texts = {r.doc_id: r.text for r in docs.collect()}

    lang = {r.doc_id: r for r in results[0].collect()}
    assert set(lang) == {i for i, t in texts.items() if any(c.isalpha() for c in t or "")}
    model = learn(docs.filter(~held_out(F.col("doc_id"))))
    assert all(r.lang == model.predict(r.text)[0] and r.text == texts[r.doc_id] for r in lang.values())

    ids = sorted(lang)
    groups = brute([texts[i] for i in ids], 5, 80)
    near = {r.doc_id for r in results[1].collect()}
    assert near == {ids[i] for i, (_, root) in groups.items() if root == i}

    clean = {r.doc_id: r for r in results[2].collect()}
    assert set(clean) == near and clean[10**6 + 2].text == "a mail to [email] now"
    assert all(base_spans(r.text) == [] or "[" in r.text for r in clean.values())
    assert all(r.n_chars == len(r.text) for r in clean.values())
    assert all(r.text == texts[i] for i, r in clean.items() if not base_spans(texts[i]) and "[" not in r.text)

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    total = {}
    for r in results[3].collect():
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert total == {i: len(library.encode(r.text, add_special_tokens=False).ids) + 1 for i, r in clean.items()}


def test_dedup_keeps_one_row_of_each_group(spark):
    words = [f"word{i}" for i in range(400)]
    a, b, c, d, e = (" ".join(words[i : i + 60]) for i in range(0, 300, 60))
    rows = [(7, a), (7, a), (None, a), (3, b), (3, c), (9, b), (None, d), (None, e), (None, e), (5, a + " more"), (None, "short one"), (None, "short two"), (1, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    left = corpus_pipeline.dedup_stage(spark, docs, DATA)
    assert left.columns == docs.columns
    want = [(5, a + " more"), (3, b), (3, c), (None, d), (None, e), (None, "short one"), (None, "short two"), (1, "")]
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=repr) == sorted(want, key=repr)


def test_empty_table_and_repeated_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, rows in (("empty", []), ("twice", [(1, "some words of a text that comes twice", "en", "s", 37)] * 2)):
        docs = spark.createDataFrame(rows, schema)
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs.write.parquet(f"{tmp_path}/{name}{i}")
            docs = stage(spark, spark.read.schema(docs.schema).parquet(f"{tmp_path}/{name}{i}"), DATA)
        assert docs.count() == min(1, len(rows))
