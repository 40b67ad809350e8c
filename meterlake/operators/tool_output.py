"""Reduction of command output: noise goes, critical lines never do.

Levels: conservative (scrubbed only), balanced, aggressive. If a critical line of the text isn't in
what a rule set leaves, the text comes back as it is. `reduced` has the rule set of each tool, with
blocks, counts and headers that depend on the lines before, so it is an Arrow UDF; `filtered` takes
a table of plain rules and is made of SQL functions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import let, stripped
from ..functions.tool_rules import TOOLS, Count, Tool
from .text import ESCAPES, scrubbed

LEVELS = ["conservative", "balanced", "aggressive"]
RESULT = "text string, bytes_before int, bytes_after int, lines_dropped int, critical_kept boolean, how string"
_ESCAPES = re.compile(ESCAPES)


def scrub(text: str) -> str:
    """As `text.scrubbed`."""
    out: list[str] = []
    for line in _ESCAPES.sub("", text).split("\n"):
        line = line.rstrip(" \t\r")
        if not out or line != out[-1]:
            out.append(line)
    return "\n".join(out).strip("\n")


@cache
def _compiled(pattern: str) -> re.Pattern:
    return re.compile(pattern or "(?!)")


@dataclass
class Reduced:
    text: str
    dropped: int = 0
    critical_kept: bool = True
    how: str = "scrub"

    @property
    def size(self) -> int:
        return len(self.text.encode())


class Reducer:
    """One tool's rules, applied to whole texts."""

    def __init__(self, tool: Tool):
        self.tool = tool
        self.fits = {k: _compiled(getattr(tool, k)).search for k in ("sniff", "critical", "uncritical", "drop", "keep", "more", "header", "header_lines", "header_ends", "table")}

    def _has(self, kind: str, line: str) -> bool:
        return bool(self.fits[kind](line.strip()) or self.fits[kind](line))

    def critical(self, line: str) -> bool:
        t = line.strip()
        return bool(t and self.fits["critical"](t) and not self.fits["uncritical"](t))

    def reduce(self, text: str, level: str, clean: str | None = None) -> Reduced:
        """clean: the scrubbed text, where it is known."""
        clean = scrub(text) if clean is None else clean
        if self.tool.json and clean.lstrip()[:1] in ("{", "["):
            return Reduced(text, how="json")
        if not self.fits["sniff"](clean):
            return Reduced(clean)
        out = Reduced(clean, how="rules") if level == "conservative" else self._lines(clean, level == "aggressive")
        critical = lambda t: {line.strip() for line in t.split("\n") if self.critical(line)}
        return out if critical(text) <= critical(out.text) else Reduced(text, critical_kept=False, how="raw")

    def _lines(self, clean: str, aggressive: bool) -> Reduced:
        tool, kept, dropped = self.tool, [], 0
        table = bool(tool.table) and bool(self.fits["table"](clean))
        blocks = () if table else tool.blocks
        counts = [c for c in tool.counts if (aggressive or c.balanced) and (table or not tool.table)]
        headed = tool.header and (aggressive or tool.header_balanced)
        listed: dict[Count, list[str]] = {c: [] for c in counts}
        open_list: Count | None = None  # within the lines after a count's first one
        seen_first: set[Count] = set()
        block, header = None, None

        def flush(count: Count) -> None:
            nonlocal dropped
            lines = listed[count]
            if lines:
                summary = count.summary.format(n=len(" ".join(lines).split()) if count.words else len(lines))
                if count.always or len(summary.encode()) < len("\n".join(lines).encode()):
                    kept.append(summary)
                    dropped += len(lines)
                else:
                    kept.extend(lines)
                listed[count] = []

        def flush_runs() -> None:
            for count in counts:
                if count.in_place:
                    flush(count)

        def stay(line: str) -> None:
            nonlocal header, dropped
            flush_runs()
            if header is not None and self._has("header_ends", line):
                header, dropped = None, dropped + 1
            elif header is not None and self._has("header_lines", line):
                kept.append(header)
                header = None
            kept.append(line)

        for line in clean.split("\n"):
            blank, critical = not line.strip(), self.critical(line)
            if block:
                if _compiled(block.inside).search(line) and (not critical or block.before_critical or block.past_critical):
                    if block.keep and not blank or critical and not block.before_critical:
                        stay(line)
                    else:
                        dropped += 1
                    continue
                block = None
            opened = next((b for b in blocks if _compiled(b.start).search(line.strip()) and (b.start_stays or not critical)), None)
            if opened:
                block = opened
                if opened.start_stays:
                    stay(line)
                else:
                    dropped += 1
                continue
            if blank and open_list:
                flush(open_list)
                open_list = None
            if critical:
                open_list = None
                stay(line)
                open_list = next((c for c in counts if c.after and _compiled(c.after).search(line.strip())), None)
                continue
            if self._has("keep", line) and not self._has("drop", line):
                stay(line)
                continue
            if headed and self.fits["header"](line):
                flush_runs()
                dropped += header is not None
                header = line
                continue
            if blank and tool.blanks or not table and self._has("drop", line):
                dropped += 1
                for c in counts:
                    if c.ended_by_dropped:
                        flush(c)
                        open_list = None if open_list is c else open_list
                continue
            count = next((c for c in counts if (not c.after or c is open_list) and (_compiled(c.lines).search(line.strip()) or _compiled(c.lines).search(line))), None)
            if count and count.but_first and count not in seen_first:
                seen_first.add(count)
                count = None
            if count:
                listed[count].append(line)
                continue
            open_list = None
            if aggressive and self._has("more", line):
                dropped += 1
                continue
            stay(line)
        flush_runs()
        dropped += header is not None
        for c in counts:
            flush(c)
        while kept and not kept[0].strip():
            kept.pop(0)
        while kept and not kept[-1].strip():
            kept.pop()
        return Reduced("\n".join(kept), dropped, how="rules")


def marks(pattern: str) -> list[str]:
    """For each alternative of a regular expression the longest run of plain characters in it, lower-cased: a text that the
    alternative fits has it. An empty one says nothing. Alternatives in brackets are taken as one."""
    runs, depth, i = [[""]], 0, 0
    while i < len(pattern):
        c, plain = pattern[i], ""
        if c == "\\":
            i += 1
            plain = {"n": "\n", "t": "\t"}.get(pattern[i], "" if pattern[i].isalnum() else pattern[i])
        elif c == "[":
            i = pattern.index("]", i + 2)
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and not depth:
            runs.append([""])
        elif c == "{":
            i = pattern.index("}", i)
        elif c not in "^$.*+?|":
            plain = c
        i += 1
        if plain and not depth and pattern[i : i + 1] not in ("*", "?", "{"):
            runs[-1][-1] += plain
        else:
            runs[-1].append("")
    return [max(own, key=len).lower() for own in runs]


class Sniffer:
    """Which rule sets may know a text: one automaton over the marks of all of them, in one pass over the text."""

    def __init__(self, tools: list[Tool]):
        owners: dict[str, list[int]] = {}
        for at, tool in enumerate(tools):
            for mark in marks(tool.sniff):
                owners.setdefault(mark, []).append(at)
        self.always = owners.pop("", [])
        self.automaton = ahocorasick.Automaton()
        for mark, of in owners.items():
            self.automaton.add_word(mark, of)
        self.automaton.make_automaton()

    def candidates(self, text: str) -> set[int]:
        found = set(self.always)
        for _, of in self.automaton.iter(text.lower()):
            found.update(of)
        return found


class Registry:
    """Reducers by command name and alias. overrides: a level for some commands."""

    def __init__(self, tools: list[Tool] | None = None, overrides: dict[str, str] | None = None):
        self.tools = TOOLS if tools is None else tools
        own = [Reducer(tool) for tool in self.tools]
        self.reducers = {name: r for r in own for name in r.tool.names}
        self.overrides = overrides or {}
        # later tools take over a name; what is left of each, with the name that comes first
        self.first = [min((n for n in r.tool.names if self.reducers[n] is r), default=None) for r in own]
        self.sniffer = Sniffer(self.tools)

    def reduce(self, command: str | None, text: str, level: str) -> Reduced:
        """By the program that a command line starts with; unknown ones are only scrubbed, empty texts stay."""
        if not text:
            return Reduced(text, critical_kept=False, how="raw")
        name = re.split(r"[/\\]", ((command or "").split() or [""])[0])[-1].lower()
        found = self.reducers.get(name)
        return found.reduce(text, self.overrides.get(name, level)) if found else Reduced(scrub(text))

    def sniffed(self, text: str, level: str) -> tuple[Reduced, str]:
        """The smallest of what the rule sets make of a text of unknown origin; ties: the first command by name, none first.

        Only the rule sets of which a mark is in the text are tried; the others don't know it.
        """
        clean = scrub(text)
        best, by = Reduced(clean), ""
        for name in sorted(self.first[i] for i in self.sniffer.candidates(clean) if self.first[i]):
            out = self.reducers[name].reduce(text, level, clean)
            if out.how in ("rules", "json") and out.critical_kept and out.size < best.size:
                best, by = out, name
        return best, by


def reduced(text: Column, command: Column, level: Column, overrides: dict[str, str] | None = None) -> Column:
    """struct of RESULT for each text; null for a null text. An unknown level counts as conservative."""

    @F.pandas_udf(RESULT)
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        tools = Registry(overrides=overrides)
        for texts, commands, levels in batches:
            out = [None if t is None else tools.reduce(c, t, v if v in LEVELS else LEVELS[0]) for t, c, v in zip(texts, commands, levels, strict=True)]
            yield pd.DataFrame(
                {
                    "text": [r and r.text for r in out],
                    "bytes_before": pd.array([None if r is None else len(t.encode()) for r, t in zip(out, texts, strict=True)], "Int32"),
                    "bytes_after": pd.array([None if r is None else r.size for r in out], "Int32"),
                    "lines_dropped": pd.array([None if r is None else r.dropped for r in out], "Int32"),
                    "critical_kept": pd.array([None if r is None else r.critical_kept for r in out], "boolean"),
                    "how": [r and r.how for r in out],
                }
            )

    return F.when(text.isNotNull(), run(text, command, level))


def sniffed(text: Column, level: str = "balanced") -> Column:
    """struct<command, text>: as Registry.sniffed; null for a null text."""

    @F.pandas_udf("command string, text string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tools = Registry()
        for texts in batches:
            found = [(Reduced(""), "") if t is None else tools.sniffed(t, level) for t in texts]
            yield pd.DataFrame({"command": [c for _, c in found], "text": [r.text for r, _ in found]})

    return F.when(text.isNotNull(), run(text))


def filtered(text: Column, critical: list[str], balanced: list[str], aggressive: list[str], level: str) -> Column:
    """A text by plain rules, regular expressions that are searched in stripped lines: critical ones stay, those of the level go.

    If a critical line would be lost, as scrubbing may do to one with escape codes, the text comes
    back as it is.
    """
    one = lambda patterns: "|".join(f"(?:{p})" for p in patterns) or r"(?!)"
    is_critical = lambda x: (x != "") & x.rlike(one(critical))
    drops = {"conservative": [], "balanced": balanced, "aggressive": [*balanced, *aggressive]}[level]
    lines = F.split(scrubbed(text), "\n")
    kept = F.filter(lines, lambda x: is_critical(stripped(x)) | ~stripped(x).rlike(one(drops))) if drops else lines
    compact = F.regexp_replace(F.array_join(kept, "\n"), r"\A(?:[ \t]*\n)+|(?:\n[ \t]*)+\z", "")
    needed = F.filter(F.transform(F.split(text, "\n"), stripped), is_critical)
    return let(compact, lambda c: F.when(F.size(F.array_except(needed, F.transform(F.split(c, "\n"), stripped))) > 0, text).otherwise(c))


def reduced_results(blocks: DataFrame, level: str = "balanced") -> DataFrame:
    """(…, text, saved_bytes) of tool-result blocks (text, command): what the tool's rules leave, if that is shorter."""
    out = blocks.withColumn("r", reduced(F.col("text"), F.col("command"), F.lit(level)))
    shorter = F.col("r.bytes_after") < F.col("r.bytes_before")
    return out.withColumns({"saved_bytes": F.when(shorter, F.col("r.bytes_before") - F.col("r.bytes_after")).otherwise(0), "text": F.when(shorter, F.col("r.text")).otherwise(F.col("text"))}).drop("r")
