"""Reduction of tool results inside request bodies: the strings change in place, every other byte stays."""

from __future__ import annotations

import json
from collections.abc import Iterator
from json.scanner import py_make_scanner

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tool_output import LEVELS, Registry

#: Providers whose bodies are known, and the saved tokens from which a body is rewritten.
PROVIDERS = ["openai", "anthropic"]
LEAST_TOKENS = 16


class _Placed(str):
    """A string of a JSON text and where its literal stands."""

    start: int
    end: int


class _Decoder(json.JSONDecoder):
    def __init__(self):
        def refused(name: str):
            raise ValueError(name)

        super().__init__(parse_constant=refused)

        def placed(text: str, begin: int, strict: bool) -> tuple[_Placed, int]:
            value, end = json.decoder.scanstring(text, begin, strict)
            out = _Placed(value)
            out.start, out.end = begin - 1, end
            return out, end

        self.parse_string = placed
        self.scan_once = py_make_scanner(self)


_DECODER = _Decoder()


def tool_results(body: str) -> list[_Placed]:
    """The tool results of a body in order: the content of messages of role `tool`, and the texts within blocks of type `tool_result`.

    What isn't JSON with a list of messages has none. Of a repeated key the last counts.
    """
    try:
        messages = _DECODER.decode(body).get("messages")
    except (ValueError, RecursionError, AttributeError):
        return []
    found: list[_Placed] = []
    for message in messages if isinstance(messages, list) else []:
        if not isinstance(message, dict):
            continue
        content = message.get("content")
        if message.get("role") == "tool":
            found.append(content)
            continue
        for block in content if isinstance(content, list) and all(isinstance(b, dict) for b in content) else []:
            if block.get("type") == "tool_result":
                inner = block.get("content")
                parts = [p.get("text") for p in inner] if isinstance(inner, list) and all(isinstance(p, dict) for p in inner) else [inner]
                found.extend(parts)
    return sorted((x for x in found if isinstance(x, _Placed) and x), key=lambda x: x.start)


def rewritten_body(body: str, tools: Registry, level: str, least_tokens: int = LEAST_TOKENS) -> tuple[str, int, int]:
    """(body, bytes before, bytes after) of the results that became shorter; the body as it is, with 0 and 0, if that saves less than least_tokens."""
    out, at, before, after = [], 0, 0, 0
    for found in tool_results(body):
        try:
            found.encode()
        except UnicodeEncodeError:  # half of a surrogate pair can't be written again
            continue
        r, _ = tools.sniffed(str(found), level)
        size = len(found.encode())
        if r.critical_kept and r.size < size:
            out += [body[at : found.start], json.dumps(r.text, ensure_ascii=False)]
            at, before, after = found.end, before + size, after + r.size
    if (before - after) // 4 < least_tokens or before == after:
        return body, 0, 0
    return "".join([*out, body[at:]]), before, after


def rewritten(requests: DataFrame, level: str = "balanced", least_tokens: int = LEAST_TOKENS, body_col: str = "body", provider_col: str = "provider") -> DataFrame:
    """requests with the body rewritten, and bytes_before, bytes_after (of the results that changed) and saved_tokens, 0 where nothing did.

    A null body stays null. Bodies of providers other than PROVIDERS stay as they are. A body is one unit of work.
    """
    level = level if level in LEVELS else LEVELS[0]

    @F.pandas_udf("body string, bytes_before long, bytes_after long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tools = Registry()
        for bodies in batches:
            rows = [("", 0, 0) if b is None else rewritten_body(b, tools, level, least_tokens) for b in bodies]
            yield pd.DataFrame(rows, columns=["body", "bytes_before", "bytes_after"])

    known = F.col(provider_col).isin(PROVIDERS) & F.col(body_col).isNotNull()
    out = requests.withColumn("_r", F.when(known, run(F.col(body_col))))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    sizes = {"bytes_before": zero(F.col("_r.bytes_before")), "bytes_after": zero(F.col("_r.bytes_after"))}
    out = out.withColumns({body_col: F.coalesce("_r.body", body_col), **sizes}).drop("_r")
    return out.withColumn("saved_tokens", F.floor((F.col("bytes_before") - F.col("bytes_after")) / 4))
