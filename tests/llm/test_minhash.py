import re

import numpy as np
import pytest

from pyspark.sql import functions as F

from meterlake.llm import minhash
from meterlake.llm.common import Scratch, shared_folder
from meterlake.llm.graph import components
from meterlake.llm.minhash import near_duplicates
from meterlake.llm.shingles import ShingleSets

from .samples import HARD, docs


def brute(texts, words, percent):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())

    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


def corpus(seed=5):
    """Copies, and chains of copies with a few words changed each."""
    rng = np.random.default_rng(seed)
    vocab = [f"w{i}" for i in range(400)]
    out = list(HARD)
    for size, edits in ((40, 1), (60, 2), (200, 3), (200, 9), (12, 1), (80, 0)):
        base = list(rng.choice(vocab, size))
        for _ in range(14):
            for at in rng.integers(0, size, edits):
                base[at] = str(rng.choice(vocab))
            out.append(" ".join(base))
    base = list(rng.choice(vocab, 120))
    for _ in range(40):
        own = list(base)
        for at in rng.integers(0, 120, int(rng.integers(1, 8))):
            own[at] = str(rng.choice(vocab))
        out.append("\n".join(own).upper())
    return out


@pytest.mark.parametrize("words,percent", [(3, 85), (5, 80)])
def test_same_groups_as_brute_force(spark, words, percent):
    texts = corpus()
    got = {r.doc_id: r for r in near_duplicates(docs(spark, texts, extra=True), words, percent, rounds=1 if words == 5 else 3).collect()}
    want = brute(texts, words, percent)
    assert {i: (got[i].n_shingles, got[i].component_id) for i in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(None, "a b c"), (7, "a b c"), (7, "a b c"), (3, None), (9, "x y z"), (9, "p q r")]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(None, 7, False), (7, 7, True), (7, 7, True), (3, 3, True), (9, 9, True), (9, 9, True)], key=str)
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.range(1, 60).selectExpr("id as a", "id - 1 as b")
    assert {r.root for r in components(links).collect()} == {0}


def test_blocks_do_not_change_sets():
    texts = ["a b c d"] * 3 + ["x " * 700_000, "A B  c\td", ""]
    a = list(ShingleSets(3).sets(texts))
    assert all((x == y).all() for t, x in zip(texts, a, strict=True) for y in ShingleSets(3).sets([t]))
    assert (a[0] == a[4]).all() and len(a[5]) == 0


def test_near_copies_without_ids_are_linked(spark):
    words = [f"w{i}" for i in range(200)]
    near = " ".join([*words[:-1], "other"])
    rows = spark.createDataFrame([(None, " ".join(words)), (7, near), (7, near), (9, "far from these texts")], "doc_id long, text string")
    found = sorted((r["component_id"], r["kept"]) for r in near_duplicates(rows).collect())
    assert found == [(7, False), (7, True), (7, True), (9, True)]


@pytest.mark.parametrize("block", [7, 40])
def test_last_round_alone_over_many_blocks(spark, monkeypatch, block):
    """No pivot rounds: all links come from comparing blocks, within and across; small blocks also bring buckets over the limit of a group."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    texts = corpus(11)
    got = {r.doc_id: r for r in near_duplicates(docs(spark, texts), 3, 85, rounds=0).collect()}
    assert {i: (got[i].n_shingles, got[i].component_id) for i in got} == brute(texts, 3, 85)


def test_one_bucket_of_more_nodes_than_two_blocks(spark):
    """1,200 nodes of one bucket, few of them alike: the links within and across blocks are those of brute force."""
    rng = np.random.default_rng(3)
    vocab = [f"w{i}" for i in range(3000)]
    texts = [" ".join(rng.choice(vocab, 60)) for _ in range(1100)]
    texts += [" ".join([*t.split(" ")[:59], "changed"]) for t in texts[::11]]
    made = [s for s in ShingleSets(3).sets(texts)]
    signed = minhash.signatures(docs(spark, texts), 3, 85).filter("n > 0").toPandas()
    assert len(signed) == len(texts) > 2 * minhash.BLOCK
    facts = spark.createDataFrame(signed[["node", "doc_id", "n", "bits"]].astype({"node": "int64"}).assign(bits=[list(map(int, b)) for b in signed["bits"]]), "node long, doc_id long, n long, bits array<long>")
    node_of = dict(zip(signed["doc_id"].astype(int), signed["node"].astype(int), strict=True))
    sets = spark.createDataFrame([(node_of[i], bytearray(s.tobytes())) for i, s in enumerate(made)], "node long, set binary")
    member = facts.selectExpr("node", "node as root")
    pivot = min(node_of.values())
    buckets = facts.selectExpr("1L as bucket", "node", f"{pivot}L as pivot")
    found = {tuple(sorted(r)) for r in minhash._compared(buckets, member, sets, facts, 85, Scratch(spark)).collect()}
    want = {tuple(sorted((node_of[i], node_of[j]))) for k, j in enumerate(range(1100, len(texts))) for i in [11 * k]}
    assert found == want


def test_estimate_is_corrected_for_collisions(spark):
    """The mean error of the estimate is near 0 at any similarity, and unrelated texts are near 0."""
    rng = np.random.default_rng(4)
    vocab = [f"w{i}" for i in range(5000)]
    base = list(rng.choice(vocab, 400))
    texts = [" ".join(base)]
    for share in np.linspace(0.02, 1, 60):
        own = list(base)
        cut = int(share * 400)
        own[:cut] = rng.choice(vocab, cut)
        texts.append(" ".join(own))
    sets = [set(s.tolist()) for s in ShingleSets(3).sets(texts)]
    true = [len(sets[0] & s) / len(sets[0] | s) for s in sets]
    signed = minhash.signatures(docs(spark, texts), 3, 85)
    first = signed.filter("doc_id = 0").select(F.col("bits").alias("a"))
    rows = signed.join(F.broadcast(first), how="inner").select("doc_id", minhash.similarity(F.col("a"), F.col("bits"), 85).alias("s")).collect()
    error = [r.s - true[r.doc_id] for r in rows]
    assert abs(np.mean(error)) < 0.03 and max(map(abs, error)) < 0.2


def test_intermediate_tables_are_removed(spark):
    import os

    folder = shared_folder(spark)
    before = set(os.listdir(folder))
    near_duplicates(docs(spark, corpus()), 3, 85)
    assert {x.split("-")[0] for x in set(os.listdir(folder)) - before} == {"near"}
