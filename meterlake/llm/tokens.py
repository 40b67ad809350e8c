"""Fast exact encoding with a tokenizers file: each distinct word of a task is encoded by the library once.

Texts are cut where every pre-tokenizer in use cuts too: at lone spaces, at lone line ends, and
between a word of letters and the marks behind it. The ids of a text are those of its parts, joined.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import lru_cache

#: A space may stand at a cut only if no other white space touches it.
_TOUCHING = re.compile(r"\s\s")
_SEPARATORS = re.compile("[\x1c-\x1f]")
_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Longer parts are encoded anew each time, so that the caches stay small.
LONGEST_CACHED = 48
#: Bytes that a cache may take while a task runs: text, ids and the table's share of each entry.
CACHE_BYTES = 200_000_000
#: What an entry takes beside the bytes of its text and ids.
ENTRY_BYTES = 150
#: The letter that stands for each byte in byte-level vocabularies: printable Latin-1 as itself, the rest from 256 on.
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_LETTER = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}
_PACK = [struct.Struct(f"<{n}I").pack for n in range(16)]


class _Known(dict):
    """Text to what `make` gives for it. Two generations of half the bytes each: when the younger is full it becomes the older, and what is asked for moves back."""

    def __init__(self, make, size: int):
        super().__init__()
        self.make, self.most, self.size = make, size // 2, 0
        self.older: dict[str, bytes] = {}

    def forget(self) -> None:
        self.clear()
        self.older, self.size = {}, 0

    def __missing__(self, text: str) -> bytes:
        out = self.older.get(text)
        if out is None:
            out = self.make(text)
            if len(text) > LONGEST_CACHED:
                return out
        self.size += ENTRY_BYTES + len(text) + len(out)
        if self.size > self.most:
            self.older, self.size = dict(self), 0
            self.clear()
        self[text] = out
        return out


class ChunkEncoder:
    """ids of texts as little-endian unsigned 32-bit bytes.

    spaced: the tokenizer keeps a space as the start of the token after it (byte-level BPE);
    otherwise white space is dropped and letters are lower-cased.
    """

    def __init__(self, path: str, spaced: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.model = self.tokenizer.model
        self.spaced = spaced
        self.space = " ".translate(_LETTER)
        self.first = _Known(self._part, CACHE_BYTES // 10 if spaced else CACHE_BYTES)
        self.rest = _Known(self._after_space, CACHE_BYTES)

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        return [self._spaced(t) if self.spaced else self._bare(t) for t in texts]

    def _bare(self, text: str) -> bytes:
        """White space only parts words here; U+001C to U+001F part words for Python alone, so texts with them are cut at spaces."""
        words = text.split(" ") if _SEPARATORS.search(text) else text.split()
        return b"".join(map(self.first.__getitem__, words))

    def _spaced(self, text: str) -> bytes:
        if _TOUCHING.search(text) or text[:1].isspace() or text[-1:].isspace():
            return self._line(_LONE_SPACE.split(text))
        if "\n" not in text:
            return self._line(text.split(" "))
        return self.first["\n"].join([self._line(line.split(" ")) for line in text.split("\n")])

    def _line(self, chunks: list[str]) -> bytes:
        return self.first[chunks[0]] + b"".join(map(self.rest.__getitem__, chunks[1:]))

    def _after_space(self, chunk: str) -> bytes:
        if chunk.isascii() and chunk.isalpha():
            return self._ids(self.space + chunk)
        word = chunk.rstrip(_MARKS)
        if len(word) < len(chunk) and word.isalpha():
            return self.rest[word] + self.first[chunk[len(word) :]]
        return self._word(" " + chunk)

    def _part(self, part: str) -> bytes:
        if part.isascii() and part.isalpha():
            return self._ids(part if self.spaced else part.lower())
        word = part.rstrip(_MARKS)
        if len(word) < len(part) and word.isalpha():
            return self.first[word] + self.first[part[len(word) :]]
        return self._word(part)

    def _ids(self, letters: str) -> bytes:
        """Of a word as the library's pre-tokenizer hands it to its model."""
        ids = [t.id for t in self.model.tokenize(letters)]
        return _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, text: str) -> bytes:
        """Latin words go to the library's model at once; all else takes the whole way."""
        bare = text[1:] if text[:1] == " " else text
        if bare.isalpha() and max(bare) < "İ" and (self.spaced or unicodedata.is_normalized("NFC", bare)):
            word = text if self.spaced else bare.lower()
            return self._ids(word.encode().decode("latin-1").translate(_LETTER))
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)


@lru_cache(maxsize=1)
def _loaded(path: str, spaced: bool) -> ChunkEncoder:
    return ChunkEncoder(path, spaced)


@contextmanager
def encoder(path: str, spaced: bool) -> Iterator[ChunkEncoder]:
    """The encoder of this Python worker, whose tokenizer file is read once. When a task is done with it, its caches are emptied: idle workers hold no more than the tokenizer."""
    found = _loaded(path, spaced)
    try:
        yield found
    finally:
        found.first.forget()
        found.rest.forget()
