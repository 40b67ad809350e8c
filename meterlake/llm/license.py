"""Licence scans by conditional compression.

Sentences and lines with a cue word, and what stands between near ones, are candidate blocks. Each
is compressed with Zstandard alone and with each template as a raw dictionary; templates are ranked
by how much smaller they make it. A block takes in the lines around it, and the blocks after it,
for as long as the best templates explain most of their bytes. Wherever a block has the words of a
template, the template is confirmed by its exact differences in wording: it must be covered, differ
in no word that tells licences apart, and have few words put in between. A block may hold several
licences; the ranking decides between those of equal length.
"""

from __future__ import annotations

import difflib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text

# Standard wordings, by licence. A licence may have several.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0 Universal."),
    ("Proprietary", "All rights reserved."),
]
CUE = re.compile(r"licen[cs]e|copyright|permission is|permission to use|all rights reserved|warrant|spdx|redistribut|public domain|\bmpl\b|mozilla|\bcc0?\b", re.IGNORECASE)
#: Words in which a block may not differ from its template.
TELLING = re.compile(r"[0-9.]+|v|mit|apache|gnu|lesser|bsd|isc|mozilla|cc|cc0|by|nc|nd|sa|not|without|no|neither|prior")

_BREAK = re.compile(r"(?<=[.!?])[\x20\t]+|\n")
_WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
_CLOSING = re.compile(r"[^\w\s]*")
#: Segments without a cue that a block may hold between two with one.
GAP = 2
LEAST_COVERED = 0.85
LEAST_REDUCTION = 0.25
#: Share of a segment's compressed size that one of the best templates must save for a block to take it in.
EXPLAINED = 0.4
#: Templates that are tried on a segment beside a block.
BEST = 3


def segments(text: str) -> list[tuple[int, int]]:
    """(start, end) of lines and sentences that aren't blank."""
    cuts = [*((m.start(), m.end()) for m in _BREAK.finditer(text)), (len(text), len(text))]
    starts = [0, *(b for _, b in cuts[:-1])]
    return [(s, e) for s, (e, _) in zip(starts, cuts, strict=True) if text[s:e].strip()]


def candidate_blocks(text: str) -> list[tuple[int, int]]:
    """(start, end) in code points, end exclusive, of cue segments and up to GAP others between two."""
    if not CUE.search(text):
        return []
    blocks: list[list[int]] = []
    last = -GAP - 2
    for number, (start, end) in enumerate(segments(text)):
        if CUE.search(text, start, end):
            if number - last <= GAP + 1:
                blocks[-1][1] = end
            else:
                blocks.append([start, end])
            last = number
    return [(a, b) for a, b in blocks]


def wording(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class LicenseScanner:
    """Identifies blocks; equal blocks are looked at once while the cache holds."""

    def __init__(self, templates: list[tuple[str, str]] | None = None, cache: int = 50_000):
        import zstandard as zstd

        self.templates = [(name, text, wording(text)) for name, text in templates or TEMPLATES]
        plain = dict(write_content_size=False, write_checksum=False, write_dict_id=False)
        self.alone = zstd.ZstdCompressor(level=3, **plain)
        self.with_template = [zstd.ZstdCompressor(level=3, dict_data=zstd.ZstdCompressionDict(text.encode(), dict_type=zstd.DICT_TYPE_RAWCONTENT), **plain) for _, text, _ in self.templates]
        self.frame = len(self.alone.compress(b""))
        self.seen: dict[str, tuple] = {}
        self.cache = cache

    def ranked(self, block: str) -> list[tuple[float, int]]:
        """(share by which the template makes the block smaller, template number), best first."""
        raw = block.encode()
        size = len(self.alone.compress(raw))
        return sorted(((1 - len(c.compress(raw)) / size, i) for i, c in enumerate(self.with_template)), key=lambda x: (-x[0], x[1]))

    def _explained(self, text: str, block: tuple[int, int], grown: tuple[int, int], numbers: list[int]) -> bool:
        """Whether a template saves EXPLAINED of the segment by which a block would grow, or of what it adds to the block."""
        sizes = lambda a, b: np.array([len(c.compress(text[a:b].encode())) for c in (self.alone, *(self.with_template[n] for n in numbers))])
        segment = (grown[0], block[0]) if grown[0] < block[0] else (block[1], grown[1])
        added, own = sizes(*grown) - sizes(*block), sizes(*segment) - self.frame
        return min(own[1:]) <= (1 - EXPLAINED) * own[0] or (added[0] > 3 and min(added[1:]) <= (1 - EXPLAINED) * added[0])

    def grown_blocks(self, text: str) -> list[tuple[int, int]]:
        """candidate_blocks, each with the segments around it that its best templates explain; blocks that meet are one.

        A segment, or it and the next two, is explained if a template saves at least EXPLAINED of
        its compressed size. Lines of wrapped text without a cue are so
        taken in. A block whose best template saves less than LEAST_REDUCTION doesn't grow.
        """
        todo = candidate_blocks(text)
        if not todo:
            return []
        parts = segments(text)
        first = {s: i for i, (s, _) in enumerate(parts)}
        last = {e: i for i, (_, e) in enumerate(parts)}
        spans = [(first[a], last[b]) for a, b in todo]
        out: list[list[int]] = []
        at = 0
        while at < len(spans):
            a, b = spans[at]
            at += 1
            floor = out[-1][1] + 1 if out else 0
            order = self.ranked(text[parts[a][0] : parts[b][1]])
            while order[0][0] >= LEAST_REDUCTION:
                numbers = [n for _, n in order[:BEST]]
                block = parts[a][0], parts[b][1]
                lo = next((i for i in range(a - 1, max(floor, a - 3) - 1, -1) if self._explained(text, block, (parts[i][0], block[1]), numbers)), a)
                hi = next((i for i in range(b + 1, min(len(parts), b + 4)) if self._explained(text, block, (block[0], parts[i][1]), numbers)), b)
                if (lo, hi) == (a, b):
                    break
                a, b = lo, hi
                while at < len(spans) and b >= spans[at][0] - 1:  # it has met the next block
                    b = max(b, spans[at][1])
                    at += 1
                order = self.ranked(text[parts[a][0] : parts[b][1]])
            out.append([a, b])
        return [(parts[a][0], parts[b][1]) for a, b in out]

    def aligned(self, own: list[str], number: int) -> tuple[float, list[str], bool, list[int], list[int]]:
        """(share of the template's words that own has in order, differences within them, whether no telling word is left out or changed, places in own of the words shared, and of those put in between)."""
        want = self.templates[number][2]
        ops = difflib.SequenceMatcher(None, want, own, autojunk=False).get_opcodes()
        shared = [i for op, _, _, c, d in ops if op == "equal" for i in range(c, d)]
        inner = [(a, b, c, d) for op, a, b, c, d in ops if op != "equal" and (b > a or 0 < a < len(want))]
        telling = any(TELLING.fullmatch(w) for a, b, c, d in inner if b > a for w in [*want[a:b], *own[c:d]])
        shown = [f"-{' '.join(want[a:b])}" * (b > a) + f"+{' '.join(own[c:d])}" * (d > c) for a, b, c, d in inner]
        return len(shared) / max(1, len(want)), shown, not telling, shared, [i for a, b, c, d in inner if b == a for i in range(c, d)]

    def harmless(self, words: list[str], number: int) -> bool:
        """Whether words put into a template leave the licence what it is: none is telling, and they aren't more than may be left out."""
        return len(words) <= max(2, (1 - LEAST_COVERED) * len(self.templates[number][2])) and not any(TELLING.fullmatch(w) for w in words)

    def _cut(self, own: list[str], start: int, shared: list[int], number: int) -> bool:
        """parted, for a window that begins at start and shares the given places with the template."""
        want = self.templates[number][2]
        first, last = start + shared[0], start + shared[-1]
        head = next((i for i, w in enumerate(want) if w == own[first]), 0)
        tail = next((i for i, w in enumerate(reversed(want)) if w == own[last]), 0)
        return self.parted(own, first, last + 1, number, head, tail)

    def parted(self, own: list[str], start: int, end: int, number: int, head: int, tail: int) -> bool:
        """Whether the template's first or last words, of which `head` and `tail` are missing from own[start:end], stand apart from it with words between that change the licence.

        Three of them in a row are what is looked for, within a template's length.
        """
        want = self.templates[number][2]
        cuts = []
        if head > 2:
            near = range(max(0, start - len(want)), start - 2)
            cuts += [own[i + 3 : start] for i in near if own[i : i + 3] == want[:3]][-1:]
        if tail > 2:
            near = range(end, min(len(own), end + len(want)) - 2)
            cuts += [own[end:i] for i in near if own[i : i + 3] == want[-3:]][:1]
        return not all(self.harmless(list((Counter(c) - Counter([*want[3:head], *want[len(want) - tail : -3]])).elements()), number) for c in cuts)

    def places(self, own: list[str], number: int) -> list[tuple[float, list[str], list[int], list[int]]]:
        """(covered, differences, places of the words shared, of those put in) wherever own has the template with few words between.

        A window is aligned only if it starts with a word that a covered template can start with and
        has enough of the template's words, in any order; the count moves along with the window. Of
        windows that start close together the one with no telling word put in, then the one that
        covers most counts.
        """
        want = self.templates[number][2]
        need = LEAST_COVERED * len(want)
        first = set(want[: int(len(want) - need) + 1])
        width = len(want) + max(3, len(want) // 4)
        free, common, out, last, best, rank, until = Counter(want), 0, [], -1, None, (False, 0.0), 0.0
        for i in range(1 - width, len(own)):
            if i + width <= len(own):
                w = own[i + width - 1]
                common += free[w] > 0
                free[w] -= 1
            if i > 0:
                w = own[i - 1]
                free[w] += 1
                common -= free[w] > 0
            if best and (rank == (True, 1) or i > until):
                out.append(best)
                last, best = best[2][-1], None
            if i > last and common >= need and own[i] in first:
                covered, shown, same, shared, put_in = self.aligned(own[i : i + width], number)
                if covered < LEAST_COVERED or not same or self._cut(own, i, shared, number):
                    continue
                new = self.harmless([own[i + j] for j in put_in], number), covered
                if best is None or new > rank:
                    until = until if best else i + width - need
                    best, rank = (covered, shown, [i + j for j in shared], [i + j for j in put_in]), new
        return out + [best] * (best is not None)

    def located(self, block: str) -> tuple[float, list[tuple]]:
        """(best reduction of the whole block, (start, end, licence, reduction, covered, differences) of each confirmed template by start).

        Of templates with the same words the longest counts, then the one ranked first; another one
        counts beside it if it has a telling word of its own or as many other words as common ones.
        Words of another confirmed licence may stand within a template.
        """
        if block in self.seen:
            return self.seen[block]
        order = self.ranked(block)
        words = list(_WORD.finditer(block.lower()))
        if len(block.lower()) != len(block):  # a letter that has two in lower case
            words = list(_WORD.finditer("".join(c.lower() if len(c.lower()) == 1 else c for c in block)))
        own = [m[0] for m in words]
        has = Counter(own)
        found = []
        for rank, (reduction, number) in enumerate(order):
            want = Counter(self.templates[number][2])
            if (want & has).total() < LEAST_COVERED * want.total():
                continue
            here = self.places(own, number)
            if not here and reduction >= LEAST_REDUCTION:
                covered, shown, same, shared, put_in = self.aligned(own, number)
                here = [(covered, shown, shared, put_in)] if covered >= LEAST_COVERED and same else []
            for covered, shown, shared, put_in in here:
                firm = self.harmless([own[i] for i in put_in], number)
                found.append((not firm, -len(shared), rank, shared[0], number, covered, shown, shared, put_in))
        used: set[int] = set()
        out = []
        for _, _, _, _, number, covered, shown, shared, put_in in sorted(found, key=lambda x: x[:4]):
            fresh = [i for i in shared if i not in used]
            if not self.harmless([own[i] for i in put_in if i not in used], number):
                continue
            if not fresh or (2 * len(fresh) < len(shared) and not any(TELLING.fullmatch(own[i]) for i in fresh)):
                continue
            used.update(shared)
            start, end = words[shared[0]].start(), words[shared[-1]].end()
            end = _CLOSING.match(block, end).end()
            part = block[start:end].encode()
            reduction = 1 - len(self.with_template[number].compress(part)) / len(self.alone.compress(part))
            out.append((start, end, self.templates[number][0], reduction, covered, shown))
        result = order[0][0], sorted(out, key=lambda x: (*x[:2], x[2]))
        if len(self.seen) >= self.cache:
            self.seen.clear()
        if len(block) < 2000:
            self.seen[block] = result
        return result

    def identify(self, block: str) -> tuple[str | None, float, float, list[str]]:
        """(licence or None, reduction, covered, differences) of the first confirmed template."""
        best, found = self.located(block)
        return found[0][2:] if found else (None, best, 0.0, [])

    def rows(self, text: str) -> Iterator[tuple]:
        """(start, end, licence or None, reduction, covered, differences): each confirmed span, and what has a cue beside them."""
        for a, b in self.grown_blocks(text):
            best, found = self.located(text[a:b])
            if not found:
                yield a, b, None, best, 0.0, []
                continue
            at = a
            for start, end, *rest in [*found, (b - a, b - a)]:
                for c, d in candidate_blocks(text[at : a + start]):
                    yield at + c, at + d, None, self.ranked(text[at + c : at + d])[0][0], 0.0, []
                if rest:
                    yield a + start, a + end, *rest
                at = max(at, a + end)


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each confirmed span, and for each candidate block or rest of one without: doc_id, start, end, block, license (null if none is confirmed), reduction, covered, differences.

    Null and empty texts have no block. Repeated rows have theirs each; other columns are left out.
    Equal reductions: the template listed first.
    """
    schema = "doc_id long, start int, end int, block string, license string, reduction double, covered double, differences array<string>"
    fields = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("block", pa.string()), ("license", pa.string()), ("reduction", pa.float64()), ("covered", pa.float64()), ("differences", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = LicenseScanner(templates)
        for batch in batches:
            rows = [(doc, a, b, text[a:b], *rest) for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True) for a, b, *rest in scanner.rows(text)]
            if rows:  # many batches have none
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=fields)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, schema)
