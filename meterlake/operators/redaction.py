"""Secrets and e-mail addresses in texts: nine rules, an entropy rule, and one placeholder for each span.

Overlapping findings: the earliest start holds, then the longest, then the rule listed first.
Offsets are in code points. The spans of several rules meet in one text, which SQL functions
can't express, so this is an Arrow UDF.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import bounded_batches

# Kind, what must be in a text for the rule to apply (lower case), pattern. Where a pattern has a group, the group is the secret.
RULES = [
    ("anthropic_api_key", "sk-ant-", r"sk-ant-(?:api\d{2}-)?[A-Za-z0-9_-]{32,}"),
    ("openai_api_key", "sk-", r"sk-(?:proj-)?[A-Za-z0-9_-]{20,}"),
    ("gemini_api_key", "aiza", r"AIza[0-9A-Za-z_-]{35}"),
    ("github_token", "gh", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    ("aws_access_key_id", "akia", r"\bAKIA[0-9A-Z]{16}\b"),
    ("aws_secret_access_key", "aws", r"(?i)aws[_-]?secret[_-]?access[_-]?key[\"':=\s]+([A-Za-z0-9/+=]{40})"),
    ("jwt", "eyj", r"\beyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\b"),
    ("bearer_token", "bearer", r"(?i)bearer\s+([A-Za-z0-9._\-+/=]{16,})"),
    ("email", "@", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"),
]
HIGH_ENTROPY = "high_entropy"
# Fixed value: what parts tokens for the entropy rule.
PARTS = r" \t\n\r\",;:=()\[\]{}"
FINDING = "array<struct<kind:string,start:int,end:int>>"


def entropy(token: str) -> float:
    """Bits a character."""
    n = len(token)
    return -sum(c / n * math.log2(c / n) for c in Counter(token).values())


class Redactor:
    """Finds the spans of a text. least_bytes: of a token for the entropy rule; threshold: bits a character, None for no such rule."""

    def __init__(self, least_bytes: int = 20, threshold: float | None = 4.5):
        self.rules = [(kind, hint, re.compile(p, re.ASCII)) for kind, hint, p in RULES]
        self.least, self.threshold = least_bytes, threshold
        # a token of n characters has log2(n) bits at most, and four bytes a character
        chars = max(1, least_bytes // 4, math.ceil(2**threshold)) if threshold else 1
        self.tokens = re.compile(f"[^{PARTS}]{{{chars},}}")

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        low = text.lower()
        found = []
        for order, (kind, hint, pattern) in enumerate(self.rules):
            if hint in low:
                found += [(*m.span(pattern.groups), order, kind) for m in pattern.finditer(text)]
        if self.threshold:
            for m in self.tokens.finditer(text):
                a, b = m.span()
                if len(m[0].encode("utf-8", "replace")) >= self.least and not any(a < e and b > s for s, e, *_ in found) and entropy(m[0]) >= self.threshold:
                    found.append((a, b, len(RULES), HIGH_ENTROPY))
        out: list[tuple[str, int, int]] = []
        for a, b, _, kind in sorted(found, key=lambda f: (f[0], -f[1], f[2])):
            if b > a and not (out and a < out[-1][2]):
                out.append((kind, a, b))
        return out

    def redact(self, text: str) -> str:
        out, at = [], 0
        for kind, a, b in self.spans(text):
            out += [text[at:a], f"<redacted:{kind}>"]
            at = b
        return "".join([*out, text[at:]])


def findings(text: Column, **how) -> Column:
    """array<struct<kind, start, end>> of a text, by start; null for null."""

    @F.pandas_udf(FINDING)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        r = Redactor(**how)
        for texts in batches:
            yield texts.map(lambda t: [dict(kind=k, start=a, end=b) for k, a, b in r.spans(t)], na_action="ignore")

    return found(text)


def replaced(text: Column, **how) -> Column:
    """The text with a placeholder for each finding; null for null."""

    @F.pandas_udf("string")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        r = Redactor(**how)
        for texts in batches:
            yield texts.map(r.redact, na_action="ignore")

    return clean(text)


def _replaced_all(texts: Column, **how) -> Column:
    """Of an array of arrays of texts, each text with placeholders; a text that a row has several times is looked at once."""

    @F.pandas_udf("array<array<string>>")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        r = Redactor(**how)

        def of(row: list) -> list:
            known: dict[str | None, str | None] = {None: None}
            return [None if a is None else [known[t] if t in known else known.setdefault(t, r.redact(t)) for t in a] for a in row]

        for rows in batches:
            yield rows.map(of)

    return clean(texts)


def redacted(df: DataFrame, *columns: str, **how) -> DataFrame:
    """df with the given columns redacted: strings, arrays of strings, and the values of maps.

    All columns of a row go through one Python function, as each function takes a worker of its own in every task.
    """
    bounded_batches(df.sparkSession)
    kinds = dict(df.dtypes)
    if [kinds[c] for c in columns] == ["string"]:
        return df.withColumns({c: replaced(F.col(c), **how) for c in columns})
    as_array = {"string": lambda c: F.array(c), "array<string>": F.col, "map<string,string>": F.map_values}
    back = {"string": lambda c, x: F.get(x, F.lit(0)), "array<string>": lambda c, x: x, "map<string,string>": lambda c, x: F.map_from_arrays(F.map_keys(c), x)}
    for c in columns:
        if kinds[c] not in back:
            raise TypeError(f"{c}: {kinds[c]} can't be redacted")
    if not columns:
        return df
    cleaned = df.withColumn("_cleaned", _replaced_all(F.array(*[as_array[kinds[c]](c) for c in columns]), **how))
    return cleaned.withColumns({c: back[kinds[c]](c, F.get("_cleaned", F.lit(i))) for i, c in enumerate(columns)}).drop("_cleaned")


# The fields of an event that may hold what a user wrote; numbers, providers and kinds have none.
ENVELOPE = ["source", "attributes", "prompt_hash", "model", "response_model", "finish_reason", "error_code", "workflow_id", "parent_workflow_id", "agent_id", "session_id", "user_id", "reason", "summary", "details", "replay_metadata", "source_id", "section_id", "path", "repo_id", "conflicts_with", "redundant_with"]


def redacted_events(events: DataFrame, **how) -> DataFrame:
    """Events with each field redacted that may hold what a user wrote, where the table has it as text."""
    texts = ("string", "array<string>", "map<string,string>")
    return redacted(events, *[c for c, kind in events.dtypes if c in ENVELOPE and kind in texts], **how)


def counts(df: DataFrame, column: str, **how) -> DataFrame:
    """(kind, findings) over a text column."""
    bounded_batches(df.sparkSession)
    found = df.select(F.explode(findings(F.col(column), **how)).alias("f"))
    return found.groupBy("f.kind").agg(F.count("*").alias("findings"))
