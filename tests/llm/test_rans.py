import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from meterlake.llm.rans import Coder, encode_corpus, normalized, read_token_files, token_table, write_token_files

from .samples import HARD, docs


@pytest.mark.parametrize("n", [0, 1, 63, 64, 1000, 70_000])
def test_round_trip(n):
    ids = np.minimum(np.random.default_rng(n).geometric(0.01, n), 900).astype(np.int64)
    freq, bits = normalized(np.bincount(ids, minlength=5))
    coder = Coder(freq, bits, lanes=128, checkpoint_steps=16)
    frame = coder.encode(ids)
    assert coder.decode(frame).tolist() == ids.tolist()
    if n == 70_000:
        assert len(frame) < 1.6 * n
        lanes = 128
        assert coder.decode(frame, range(1, 3)).tolist() == ids[16 * lanes : 48 * lanes].tolist()
        bad = bytearray(frame)
        bad[-9] ^= 255
        with pytest.raises(ValueError):
            coder.decode(bytes(bad))


def test_every_seen_id_has_a_share():
    freq, bits = normalized(np.array([10**9, 1, 0, 1]))
    assert freq.sum() == 1 << bits and freq[1] == freq[3] == 1 and freq[2] == 0


def test_files(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = {r.doc_id: r for r in read_token_files(spark, encode_corpus(docs(spark, extra=True), path)).collect()}
    library, start = Tokenizer.from_file(path), 0
    for i, text in enumerate(HARD):
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        assert (got[i].start, got[i].n_tokens, zlib.crc32(got[i].ids)) == (start, len(ids), zlib.crc32(ids))
        start += len(ids)


def test_many_frames_nulls_and_repeats(spark, tmp_path):
    rows = [(None, "a b"), (None, "c"), (5, "x y z"), (5, "x y z"), (-3, "n")] * 20
    tokens = token_table(spark.createDataFrame(rows, "doc_id long, text string"), public_tokenizers.path("word_bpe_49k.json"), 2)
    write_token_files(tokens, f"{tmp_path}/t", frame_ids=7, ids_per_file=40)
    assert 2 < spark.read.parquet(f"{tmp_path}/t/frames").select("part").distinct().count() < 20
    back = read_token_files(spark, f"{tmp_path}/t").orderBy("start").collect()
    assert len(back) == 100 and [r.doc_id for r in back] == [None] * 40 + [-3] * 20 + [5] * 40
    assert [r.start for r in back] == [0, *np.cumsum([r.n_tokens for r in back])[:-1]]


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert read_token_files(spark, encode_corpus(empty, public_tokenizers.path("word_bpe_49k.json"))).count() == 0
