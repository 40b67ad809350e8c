import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from meterlake.llm import bpe
from meterlake.llm.bpe import PairIndexBPE, decode_documents, encode_documents, round_trip

from .samples import HARD, docs

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
BPE = PairIndexBPE(PATH)
MORE = ["aaaaaaaaa aaaa aaa aa a", "hahaha hahahaha", "word, word. word; 'word'", "Straße, Ærø! ŁÓDŹ. ×÷ ʰa ɐb", "--- ..... ,,, '''", "x" * 70 + " " + "y" * 70]


def test_same_ids_and_text_as_the_library(spark):
    out = {r.doc_id: r for r in decode_documents(encode_documents(docs(spark, HARD + MORE, extra=True), PATH), PATH).collect()}
    again = {r.doc_id: r for r in round_trip(docs(spark, HARD + MORE, extra=True), PATH).collect()}
    for i, text in enumerate(HARD + MORE):
        ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
        decoded = LIBRARY.decode(ids, skip_special_tokens=False)
        assert out[i].ids == ids
        assert out[i].text == decoded
        assert again[i].n_tokens == len(ids)
        assert again[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert again[i].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\tab'.,1é<|>"), st.characters(exclude_categories=["Cs", "Cn"])), max_size=40))
def test_any_text(text):
    ids = BPE.encode([text])[0].tolist()
    assert ids == LIBRARY.encode(text, add_special_tokens=False).ids
    assert BPE.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("chars", [1, 50, 4000])
def test_blocks_change_nothing(monkeypatch, chars):
    texts = [t or "" for t in HARD + MORE] * 2
    whole = [x.tolist() for x in BPE.encode(texts)]
    monkeypatch.setattr(bpe, "BLOCK_CHARS", chars)
    assert [x.tolist() for x in BPE.encode(texts)] == whole


def test_empty_table_null_ids_and_repeated_rows(spark):
    assert round_trip(docs(spark, []), PATH).count() == 0
    assert decode_documents(encode_documents(docs(spark, []), PATH), PATH).count() == 0
    rows = spark.createDataFrame([(None, "a b"), (None, "a b"), (3, None), (3, None), (3, "a b")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_tokens) for r in round_trip(rows, PATH).collect()) == [(0, 2), (0, 2), (3, 0), (3, 0), (3, 2)]


def test_broken_bytes_decode_as_the_library_does():
    for ids in ([50257 - 1, 220], [127, 128, 129], [158, 223], [10, 200, 30]):
        assert BPE.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)
