"""Text operators: compression, pruning, trimming, estimates, findings, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import let, stripped, unrepeated


# Characters a token, ASCII and other, and tokens for each message and for the whole, by provider; "" for all others.
TOKEN_RATES = {"anthropic": (3.5, 1.4, 5, 3), "gemini": (4.0, 1.6, 3, 2), "": (4.0, 1.5, 4, 3)}


def token_estimate(text: Column, ascii_per_token: float | Column = 4.0, other_per_token: float | Column = 1.5) -> Column:
    """Tokens of a text by its characters, rounded up; null for null."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    plain = F.length(F.regexp_replace(text, r"[^\x00-\x7F]", ""))
    return F.ceil(plain / as_column(ascii_per_token) + (F.length(text) - plain) / as_column(other_per_token)).cast("long")


def rates_of(provider: Column) -> Column:
    """struct<ascii, other, message, whole> of a provider."""
    row = lambda r: F.struct(F.lit(r[0]).alias("ascii"), F.lit(r[1]).alias("other"), F.lit(r[2]).alias("message"), F.lit(r[3]).alias("whole"))
    out = row(TOKEN_RATES[""])
    for name, rates in TOKEN_RATES.items():
        out = F.when(provider == name, row(rates)).otherwise(out) if name else out
    return out


def message_tokens(turns: DataFrame, keys: list[str], provider: str = "provider") -> DataFrame:
    """(keys, tokens): the messages (role, text, provider) of each conversation with what a provider adds to each and to the whole."""
    r = rates_of(F.col(provider))
    rows = turns.withColumn("r", r)
    size = lambda c: F.coalesce(token_estimate(F.col(c), F.col("r.ascii"), F.col("r.other")), F.lit(0))
    return rows.groupBy(*keys).agg((F.sum(size("role") + size("text") + F.col("r.message")) + F.max("r.whole")).cast("long").alias("tokens"))


def compressed(text: Column) -> Column:
    """Plain quotes, dashes and spaces, no HTML comments, no space at line ends or in runs, no runs of blank lines, no repeated lines.

    A line goes if it equals the one before but for space at its ends; blank lines stay.
    """
    t = F.translate(text, "‘’“”—–\u00a0", "''\"\"-- ")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", "")
    t = F.regexp_replace(t, r"[ \t]+(\n|\z)", "$1")
    t = F.regexp_replace(t, r"[ \t]{2,}", " ")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return F.array_join(unrepeated(F.split(t, "\n"), lambda x, y: (stripped(x) != "") & (stripped(x) == stripped(y))), "\n")


# What parts chunks, a line of dashes or equals signs, and what begins one where nothing parts them.
SEPARATOR = r"(?:-{3,}|={3,})\s*$"
HEADING = r"(?:\d+\.\s|\[\d+\]\s)"


def chunks(text: Column) -> Column:
    """The chunks of a retrieved context: between separator lines, else from each of several numbered headings on; none otherwise."""
    trim_all = lambda parts: F.transform(parts, lambda c: F.regexp_replace(c, r"\A\s+|\s+\z", ""))
    parted = F.filter(trim_all(F.split(text, "(?md)^" + SEPARATOR)), lambda c: c != "")
    headed = F.filter(F.split(text, f"(?md)^(?={HEADING})"), lambda c: c.rlike(r"\A" + HEADING))
    return F.when(text.rlike("(?md)^" + SEPARATOR), parted).otherwise(let(headed, lambda h: F.when(F.size(h) > 1, trim_all(h)).otherwise(F.array().cast("array<string>"))))


def pruned(text: Column, most: int = 8, keep: int = 4) -> Column:
    """The first `keep` chunks of a text with `most` chunks or more, parted by dashes; other texts are left whole."""
    return let(chunks(text), lambda c: F.when((F.size(c) >= most) & (F.size(c) > keep), F.array_join(F.slice(c, 1, keep), "\n---\n")).otherwise(text))


def trimmed(turns: DataFrame, keep: int = 4) -> DataFrame:
    """System turns, and those from the `keep`th last user turn on."""
    later = Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, -1)
    after = F.coalesce(F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(later), F.lit(0))
    return turns.withColumn("after", after).filter((F.col("role") == "system") | (F.col("after") < keep)).drop("after")


def duplicate_groups(docs: DataFrame) -> DataFrame:
    """Hashes that two documents or more share."""
    return docs.groupBy(F.concat(F.lit("sha256:"), F.sha2(F.col("text").cast("binary"), 256)).alias("hash")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first")).filter("copies >= 2")


#: Escape codes of terminals.
ESCAPES = r"\x1b\[[0-9;?]*[ -/]*[@-~]"


def scrubbed(text: Column) -> Column:
    """Terminal output without escape codes, spaces at line ends, repeated lines, blank runs and blank lines at either end."""
    t = F.regexp_replace(F.regexp_replace(text, ESCAPES, ""), r"[ \t\r]+(\n|\z)", "$1")
    return F.regexp_replace(F.array_join(unrepeated(F.split(t, "\n"), lambda x, y: x == y), "\n"), r"\A\n+|\n+\z", "")
