"""Byte-level BPE by a pair occurrence index.

The distinct words of a partition's texts, some millions of characters at a time, stand in one
array of symbols. An index maps each mergeable pair to all its positions; active ranks are applied
in ascending order, each at all its positions at once, and only the lists of the pairs beside a
merge change.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

from .common import id_and_text
from .tokens import _LONE_SPACE, _TOUCHING

#: Characters of text whose distinct words are merged together: some 100 MB of symbols, lists and ids.
BLOCK_CHARS = 8_000_000
#: Latin letters and the ASCII marks behind them, which every such pattern cuts between.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ɏ]+)([!-/:-@\[-`{-~]*)")

# Fixed value: the public pre-tokenizer pattern of this kind of vocabulary.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file, by rule: printable Latin-1 as itself, the rest from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _chunks(text: str) -> list[str]:
    """text cut at its lone spaces, where every word ends."""
    if _TOUCHING.search(text) or text[:1].isspace() or text[-1:].isspace():
        return _LONE_SPACE.split(text)
    return text.split(" ")


class PairIndexBPE:
    """Encodes and decodes texts with the merges of a tokenizers file (byte-level, no normalizer).

    A pair that the file lists twice has its first rank; equal texts have equal ids, whatever else
    is in a block.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        self.words = regex.compile(WORDS)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.of_byte = np.zeros(256, np.int32)
        for letter, byte in letters.items():
            self.of_byte[byte] = vocab[letter]
        self.shift = np.int64(max([*vocab.values(), *self.special.values()]).bit_length())
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.left, self.right, self.made = (np.array(x, np.int32) for x in ([vocab[a] for a, _ in pairs], [vocab[b] for _, b in pairs], [vocab[a + b] for a, b in pairs]))
        keys, first = np.unique(self._key(self.left, self.right), return_index=True)
        self.keys, self.ranks = np.append(keys, np.iinfo(np.int64).max), np.append(first, -1).astype(np.int32)
        self.byte_ranks = self.rank(np.repeat(self.of_byte, 256), np.tile(self.of_byte, 256))
        self.bytes_of: dict[int, bytes] = {i: bytes(letters[c] for c in token) for token, i in vocab.items()}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}

    def _key(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a.astype(np.int64) << self.shift) | b

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, -1 if they don't merge; a symbol under 0 merges with none."""
        key = self._key(a, b)
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def merge_all(self, words: list[str]) -> list[bytes]:
        """The ids of each word, unsigned 32-bit: all words in one array, each followed by a stop."""
        if not words:
            return []
        raw = [w.encode() for w in words]
        stops = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1) - 1
        letter = np.ones(int(stops[-1]) + 1, bool)
        letter[stops] = False
        data = np.zeros(len(letter), np.uint8)
        data[letter] = np.frombuffer(b"".join(raw), np.uint8)
        sym = np.where(letter, self.of_byte[data], -1).astype(np.int32)
        nxt = np.arange(1, len(sym) + 1, dtype=np.int32)
        prv = np.arange(-1, len(sym) - 1, dtype=np.int32)  # -1 is the last stop

        at: dict[int, list[np.ndarray]] = {}  # the index: rank to positions
        active: list[int] = []

        def listed(rank: np.ndarray, position: np.ndarray) -> None:
            """Adds positions to the lists of their ranks."""
            order = np.argsort(rank, kind="stable")
            rank, position = rank[order], position[order]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            for r, a, b in zip(rank[[0, *cuts]].tolist(), [0, *cuts.tolist()], [*cuts.tolist(), len(rank)], strict=True):
                if r in at:
                    at[r].append(position[a:b])
                else:
                    at[r] = [position[a:b]]
                    heapq.heappush(active, r)

        both = np.flatnonzero(letter[:-1] & letter[1:])
        rank = self.byte_ranks[data[both].astype(np.int32) << 8 | data[both + 1]]
        if (rank >= 0).any():
            listed(rank[rank >= 0], both[rank >= 0].astype(np.int32))
        while active:
            r = heapq.heappop(active)
            lists = at.pop(r)
            a, b = self.left[r], self.right[r]
            i = lists[0] if len(lists) == 1 else np.concatenate(lists)
            i = i[sym[i] == a]
            i = i[sym[nxt[i]] == b]
            if not len(i):
                continue
            if len(lists) > 1:
                i = np.unique(i)
            j = nxt[i]
            if a == b and len(i) > 1:  # of a run of one symbol every other pair, from the left
                number = np.arange(len(i))
                starts = np.append(True, i[1:] != j[:-1])
                odd = (number - np.maximum.accumulate(np.where(starts, number, 0))) % 2 == 1
                i, j = i[~odd], j[~odd]
            k = nxt[j]
            sym[i], sym[j] = self.made[r], -2
            nxt[i], prv[k] = k, i
            h = prv[i]
            x, y = np.concatenate([h, i]), np.concatenate([i, k])
            rank = self.rank(sym[x], sym[y])
            good = rank >= 0
            if good.any():
                listed(rank[good], x[good])
        alive = sym >= 0
        ends = np.cumsum(alive)[stops] * 4
        ids = sym[alive].astype("<u4").tobytes()
        return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def _pieces(self, chunk: str) -> list[str | int]:
        if self.split is None or "<|" not in chunk:
            return self.words.findall(chunk)
        return [p for part in self.split.split(chunk) for p in ([self.special[part]] if part in self.special else self.words.findall(part))]

    def _learned(self, chunks: set[str], lead: str) -> dict[str, bytes]:
        """The ids of each chunk, with lead before it."""
        plain = {c: m[1] for c in chunks if (m := _PLAIN.fullmatch(c))}
        others = {c: self._pieces(lead + c) for c in chunks - plain.keys()}
        marks = {c[len(w) :] for c, w in plain.items()}
        words = list({lead + w for w in plain.values()} | marks | {w for p in others.values() for w in p if isinstance(w, str)})
        ids = dict(zip(words, self.merge_all(words), strict=True))
        out = {c: ids[lead + w] + ids[c[len(w) :]] if len(w) < len(c) else ids[lead + w] for c, w in plain.items()}
        out |= {c: b"".join([ids[w] if isinstance(w, str) else w.to_bytes(4, "little") for w in p]) for c, p in others.items()}
        return out

    def encode(self, texts: Iterable[str]) -> list[np.ndarray]:
        """The ids of each text; works in blocks of BLOCK_CHARS characters and one text more."""
        out: list[np.ndarray] = []
        block: list[str] = []
        size = 0
        for text in texts:
            block.append(text)
            size += len(text)
            if size > BLOCK_CHARS:
                out += self._block(block)
                block, size = [], 0
        return out + self._block(block)

    def _block(self, block: list[str]) -> list[np.ndarray]:
        """Texts are cut into chunks twice, which is cheaper than to keep the chunks."""
        first, rest = set(), set()
        for text in block:
            head, *tail = _chunks(text)
            first.add(head)
            rest.update(tail)
        first, rest = self._learned(first, ""), self._learned(rest, " ")
        out = []
        for text in block:
            head, *tail = _chunks(text)
            out.append(np.frombuffer(first[head] + b"".join(map(rest.__getitem__, tail)), "<u4"))
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """The text; bytes that aren't UTF-8 become U+FFFD. Special tokens stay."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def _on_documents(docs: DataFrame, path: str, schema: str, made) -> DataFrame:
    """Columns of schema from made(bpe, texts) for each batch of (doc_id, text) rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = PairIndexBPE(path)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), **made(bpe, batch["text"])})

    return docs.mapInPandas(run, f"doc_id long, {schema}")


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of each row of docs. Null texts count as empty: no ids. Repeated rows and null ids stay; other columns are left out."""
    return _on_documents(id_and_text(docs, id_col, text_col), path, "ids array<int>", lambda bpe, texts: {"ids": [x.astype("int32") for x in bpe.encode(texts)]})


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each text encoded and its ids decoded again, in one pass.

    The digests are of the decimal ids joined by commas and of the decoded text in UTF-8. Nulls,
    repeated rows and other columns as for encode_documents.
    """

    def both(bpe: PairIndexBPE, texts: pd.Series) -> dict:
        encoded = bpe.encode(texts)
        decoded = (bpe.decode(x.tolist()).encode() for x in encoded)
        return {"n_tokens": [len(x) for x in encoded], "ids_sha256": [ids_digest(x) for x in encoded], "decoded_sha256": [hashlib.sha256(x).hexdigest() for x in decoded]}

    return _on_documents(id_and_text(docs, id_col, text_col), path, "n_tokens long, ids_sha256 string, decoded_sha256 string", both)


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) with the decoded text added. Null ids give a null text. An id that the vocabulary lacks is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = PairIndexBPE(path)
        for batch in batches:
            yield batch.assign(doc_id=batch["doc_id"].astype("Int64"), text=[None if x is None else bpe.decode(x.tolist()) for x in batch["ids"]])

    return encoded.select("doc_id", "ids").mapInPandas(run, "doc_id long, ids array<int>, text string")


def ids_digest(ids: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, ids.tolist())).encode()).hexdigest()
