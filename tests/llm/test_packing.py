import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from meterlake.llm.packing import best_fit, pack_documents, packed, sequences
from meterlake.llm.tokens import ChunkEncoder

from .samples import HARD, docs


@pytest.mark.parametrize("name,spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_chunks_encode_as_the_library(name, spaced):
    path = public_tokenizers.path(name)
    library, texts = Tokenizer.from_file(path), [t or "" for t in HARD]
    got = [np.frombuffer(x, "<u4").tolist() for x in ChunkEncoder(path, spaced).encode(texts)]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_pieces_and_places(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = pack_documents(docs(spark, extra=True), path, capacity=64).collect()
    library = Tokenizer.from_file(path)
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for i, text in enumerate(HARD):
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        assert np.frombuffer(b"".join(p.ids for p in pieces), "<u4").tolist() == ids
        assert [p.piece for p in pieces] == list(range(len(pieces)))
        assert all(p.length == 64 for p in pieces[1:]) and (len(ids) > 64 or len(pieces) == 1)
        assert all(p.ids_crc32 == zlib.crc32(p.ids) for p in pieces)
    for items in by_seq.values():
        at = 0
        for r in sorted(items, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    whole = sequences(pack_documents(docs(spark), path, capacity=64))
    assert all(len(r.ids) == 4 * r.length for r in whole.collect())


def test_rounds_merge_what_partitions_leave(spark):
    sizes = [int(x) for x in np.random.default_rng(3).integers(1, 2047, 3000)]
    lengths = spark.createDataFrame(list(enumerate(sizes)), "key long, length int")
    bins = packed(lengths, rows_per_task=500).join(lengths, "key").groupBy("bin").sum("length").collect()
    assert sum(r[1] for r in bins) == sum(sizes) and max(r[1] for r in bins) <= 2048
    assert len(bins) <= 1.03 * -(-sum(sizes) // 2048)


def test_nothing_fits_together(spark):
    lengths = spark.range(600).selectExpr("id as key", "cast(40 as int) as length")
    assert packed(lengths, capacity=64, rows_per_task=50).select("bin").distinct().count() == 600


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pack_documents(empty, public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_best_fit_takes_the_tightest_bin():
    at, offset = best_fit(np.array([7, 6, 3, 4, 1]), 10)
    assert at.tolist() == [0, 1, 0, 1, 2] and offset.tolist() == [0, 0, 7, 6, 0]


def test_bins_do_not_depend_on_the_machines(spark):
    sizes = [int(x) for x in np.random.default_rng(5).integers(1, 2047, 25_000)]
    lengths = spark.createDataFrame(list(enumerate(sizes)), "key long, length int")
    found = [{r.key: (r.bin, r.offset) for r in packed(lengths.repartition(n), rows_per_task=6_000).collect()} for n in (1, 3, 11)]
    assert found[0] == found[1] == found[2]
