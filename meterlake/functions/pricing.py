"""Effective-dated, longest-prefix price resolution and event cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A sample card (provider, model or prefix*, effective from, input, output, cached input; USD per million tokens).
CARD = [
    ("openai", "gpt*", "2024-01-01", 2.0, 8.0, 0.5),
    ("openai", "gpt-1*", "2024-01-01", 0.4, 1.6, 0.1),
    ("openai", "gpt-2", "2024-01-01", 10.0, 30.0, 0.0),
    ("anthropic", "claude*", "2024-01-01", 3.0, 15.0, 0.3),
    ("gemini", "gemini*", "2024-01-01", 1.25, 5.0, 0.0),
    ("mistral", "mistral-0", "2024-01-01", 0.2, 0.6, 0.0),
    ("openai", "gpt*", "2024-01-15", 1.5, 6.0, 0.4),
    ("openai", "gpt-2", "2024-01-15", 8.0, 24.0, 0.8),
    ("anthropic", "claude*", "2024-01-15", 3.0, 15.0, 0.3),
    ("anthropic", "claude-1", "2024-01-15", 0.8, 4.0, 0.08),
    ("gemini", "gemini*", "2024-01-15", 1.25, 5.0, 0.31),
    ("mistral", "mistral*", "2024-01-15", 0.2, 0.6, 0.0),
]
RATES = ["input_rate", "output_rate", "cached_rate"]


def rate_card(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    df = spark.createDataFrame(rows or CARD, "provider string, pattern string, effective_from string, input_rate double, output_rate double, cached_rate double")
    return df.withColumn("effective_from", F.col("effective_from").cast("timestamp_ntz"))


def resolved(models: DataFrame, card: DataFrame) -> DataFrame:
    """(provider, model) x validity: the exact entry, else the longest prefix, of each dated card.

    Works on distinct models, never on events. The earliest card also holds for all time before.
    """
    dates = card.select("effective_from").distinct()
    over = Window.orderBy("effective_from")  # a row for each dated card
    spans = dates.select("effective_from", F.lead("effective_from").over(over).alias("valid_to"), F.when(F.row_number().over(over) > 1, F.col("effective_from")).alias("valid_from"))
    prefix = F.expr("substring(pattern, 1, length(pattern) - 1)")
    fits = (F.col("pattern") == F.col("model")) | (F.col("pattern").endswith("*") & F.col("model").startswith(prefix))
    best = Window.partitionBy("provider", "model", "effective_from").orderBy((F.col("pattern") == F.col("model")).desc(), F.length("pattern").desc())
    found = models.select("provider", "model").distinct().join(card, "provider").filter(fits).withColumn("nr", F.row_number().over(best)).filter("nr = 1").drop("nr")
    return found.join(spans, "effective_from").select("provider", "model", "valid_from", "valid_to", "pattern", *RATES)


def cost(input_tokens: Column, cached: Column, output_tokens: Column) -> Column:
    """List price in USD: cached tokens within the input, at the input rate if they have none of their own."""
    inside = F.greatest(F.lit(0), F.least(F.coalesce(cached, F.lit(0)), input_tokens))
    cached_rate = F.when(F.col("cached_rate") > 0, F.col("cached_rate")).otherwise(F.col("input_rate"))
    return ((input_tokens - inside) * F.col("input_rate") + inside * cached_rate + output_tokens * F.col("output_rate")) / F.lit(1e6)


#: Card rows up to which each event looks through its provider's entries; of a larger card the distinct models are looked up, and events joined with what was found.
CARD_ROWS = 100


def _entries(spark: SparkSession, rows: list) -> DataFrame:
    """(card_provider, entries): for each provider the card's entries in order of preference, each with the time that its card holds."""
    dates = sorted({r["effective_from"] for r in rows})
    till = dict(zip(dates, [*dates[1:], None], strict=True))
    by: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["pattern"].endswith("*"), -len(r["pattern"]), r["pattern"])):
        start = r["effective_from"] if r["effective_from"] != dates[0] else None
        by.setdefault(r["provider"], []).append((r["pattern"].endswith("*"), r["pattern"].removesuffix("*"), start, till[r["effective_from"]], *(float(r[x]) for x in RATES)))
    entry = "starred:boolean,prefix:string,valid_from:timestamp_ntz,valid_to:timestamp_ntz,input_rate:double,output_rate:double,cached_rate:double"
    return spark.createDataFrame(sorted(by.items()), f"card_provider string, entries array<struct<{entry}>>").coalesce(1)


def _matched(events: DataFrame, rules: DataFrame) -> DataFrame:
    """events with the RATES of the first entry that fits, by one broadcast row for each provider: events aren't shuffled."""

    def fits(e: Column) -> Column:
        named = (e["prefix"] == F.col("model")) | (e["starred"] & F.col("model").startswith(e["prefix"]))
        return named & (e["valid_from"].isNull() | (F.col("ts") >= e["valid_from"])) & (e["valid_to"].isNull() | (F.col("ts") < e["valid_to"]))

    out = events.join(F.broadcast(rules), F.col("provider") == F.col("card_provider"), "left")
    out = out.withColumn("entry", F.get(F.filter("entries", fits), F.lit(0)))
    return out.select(*events.columns, *[F.col(f"entry.{r}").alias(r) for r in RATES])


def rated(events: DataFrame, card: DataFrame) -> DataFrame:
    """events with the RATES that hold for their provider, model and time; null without an entry.

    A card of up to CARD_ROWS rows is gathered and broadcast; a larger one is resolved for the
    distinct models and joined by them.
    """
    rows = card.select("provider", "pattern", "effective_from", *RATES).limit(CARD_ROWS + 1).collect()
    if len(rows) <= CARD_ROWS:
        return _matched(events, _entries(events.sparkSession, rows))
    on = F.expr("e.provider = r.provider and e.model = r.model and (r.valid_from is null or e.ts >= r.valid_from) and (r.valid_to is null or e.ts < r.valid_to)")
    return events.alias("e").join(resolved(events, card).alias("r"), on, "left").select("e.*", *[f"r.{c}" for c in RATES])


def priced(events: DataFrame, card: DataFrame) -> DataFrame:
    """events with list_price (null: no rate), and cost: what is recorded, else the list price, 0 for plan and trial.

    Where events have a response_model, that is what is priced, unless it is empty.
    """
    if "response_model" in events.columns:
        asked = events.withColumnRenamed("model", "request_model").withColumn("model", F.coalesce(F.nullif("response_model", F.lit("")), "request_model"))
        return priced(asked.drop("response_model").withColumn("answered", F.col("model")), card).drop("model").withColumnsRenamed({"request_model": "model", "answered": "response_model"})
    out = rated(events, card)
    out = out.withColumn("list_price", cost(F.col("input_tokens"), F.col("cached_input_tokens"), F.col("output_tokens"))).drop(*RATES)
    metered = F.when(F.col("cost_usd") > 0, F.col("cost_usd")).otherwise(F.coalesce("list_price", F.lit(0.0)))
    return out.withColumn("cost", F.when(F.col("cost_source") == "metered", metered).otherwise(0.0))


def overridden(base: DataFrame, override: DataFrame) -> DataFrame:
    """base with the rates of override where those aren't zero; entries that only override has are added."""
    o = override.withColumnsRenamed({r: f"o_{r}" for r in RATES})
    return base.join(o, ["provider", "pattern"], "full_outer").select("provider", "pattern", *[F.coalesce(F.expr(f"nullif(o_{r}, 0D)"), r, F.lit(0.0)).alias(r) for r in RATES])


def difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """provider, pattern, change (added, removed, modified) and the change of each rate."""
    n = new.withColumnsRenamed({r: f"n_{r}" for r in RATES})
    both = old.join(n, ["provider", "pattern"], "full_outer")
    change = F.when(F.col("input_rate").isNull(), "added").when(F.col("n_input_rate").isNull(), "removed").when(F.expr(" or ".join(f"{r} <> n_{r}" for r in RATES)), "modified")
    return both.select("provider", "pattern", change.alias("change"), *[F.round(F.coalesce(f"n_{r}", F.lit(0.0)) - F.coalesce(r, F.lit(0.0)), 6).alias(f"d_{r}") for r in RATES]).filter("change is not null")


# A model's output rate and cached rate as multiples of its input rate that one provider holds to, and how far off is a finding.
USUAL = {"anthropic": ((5.0, 0.40), (0.10, 0.50))}


def suspicious(rates: DataFrame) -> DataFrame:
    """(provider, pattern, field, input_rate, got, expected): rates that look wrong next to the input rate; entries without one are left out."""
    i, o, c = F.col("input_rate"), F.col("output_rate"), F.col("cached_rate")
    row = lambda on, field, got, expected: F.when(on, F.struct(F.lit(field).alias("field"), got.alias("got"), F.round(expected, 9).alias("expected")))
    found = [row((c > 0) & (c > i), "cached_above_input", c, i)]
    for provider, ((times, off), (part, near)) in USUAL.items():
        mine = F.col("provider") == provider
        found.append(row(mine & (o > 0) & ~(o / i).between(times * (1 - off), times * (1 + off)), "output", o, i * times))
        found.append(row(mine & (c > 0) & ~(c / i).between(part * (1 - near), part * (1 + near)), "cached", c, i * part))
    return rates.filter("input_rate > 0").select("provider", "pattern", "input_rate", F.explode(F.array_compact(F.array(*found))).alias("f")).select("provider", "pattern", "f.field", "input_rate", "f.got", "f.expected")


# Vendors that stand before a catalogue's ids, and the words that make another tier of a model.
VENDORS = ["anthropic", "openai", "mistral", "gemini", "vertex_ai", "google", "cohere", "groq", "deepseek", "xai", "perplexity", "cerebras"]
TIERS = ["fast", "mini", "nano", "lite", "pro", "turbo", "vision", "thinking", "reasoning", "audio", "embed", "embedding", "tts", "image", "coder", "ocr", "guard", "search", "rerank", "moderation"]


def catalogue_rates(entries: DataFrame, keys: DataFrame) -> DataFrame:
    """(provider, pattern, id, RATES) from a foreign catalogue (provider, id, input_cost, output_cost, cached_cost; USD a token) in the names of our own keys (provider, key).

    An id stands for the longest key that it begins with, up to a dash, unless the next word makes
    another tier; else for itself without `-latest` or a date. Of ids for one key the one with the
    newest date counts, then `-latest`, then the first by name. keys are a small table, sent as
    one row for each provider; entries of other providers and without a price are left out.
    """
    listed = keys.groupBy("provider").agg(F.transform(F.array_sort(F.collect_set(F.struct((-F.length("key")).alias("n"), "key"))), lambda x: x["key"]).alias("keys"))
    rows = entries.join(F.broadcast(listed), "provider").filter("coalesce(input_cost, 0) <> 0 or coalesce(output_cost, 0) <> 0")
    stem = F.when(F.lower(F.substring_index("id", "/", 1)).isin(VENDORS) & F.col("id").contains("/"), F.regexp_replace("id", "^[^/]*/", "")).otherwise(F.col("id"))
    rows = rows.withColumn("stem", stem)

    def fits(k: Column) -> Column:
        rest = F.substr("stem", F.length(k) + 1)
        word = F.split(rest, "-")
        return F.col("stem").startswith(k) & ((rest == "") | (rest.startswith("-") & ~F.get(word, F.lit(1)).isin(TIERS)))

    own = F.btrim(F.regexp_replace(F.regexp_replace("stem", "-latest$", ""), r"-\d{6,8}$", ""))
    digits = F.regexp_extract("stem", r"-(\d{4,8})$", 1)
    month = (F.length(digits) != 4) | digits.rlike("^2[0-9](0[1-9]|1[0-2])$")
    date = F.when((digits != "") & month, digits.cast("int"))
    tier = F.when(date.isNotNull(), 3).when(F.col("stem").endswith("-latest"), 2).otherwise(1)
    per_million = lambda c: F.round(F.coalesce(F.col(c), F.lit(0.0)) * 1e6, 6)
    rows = rows.withColumn("pattern", F.coalesce(F.get(F.filter("keys", fits), F.lit(0)), own))
    best = F.min_by(F.struct("id", per_million("input_cost").alias("input_rate"), per_million("output_cost").alias("output_rate"), per_million("cached_cost").alias("cached_rate")), F.struct(-tier, -F.coalesce(date, F.lit(0)), F.col("id")))
    return rows.groupBy("provider", "pattern").agg(best.alias("b")).select("provider", "pattern", "b.*")


def without_pinned(rates: DataFrame, pinned: DataFrame) -> DataFrame:
    """rates without the entries (provider, pattern) that are pinned: an override must not touch those."""
    return rates.join(pinned.select("provider", "pattern"), ["provider", "pattern"], "left_anti")


def snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """(taken, provider, pattern, RATES) of the JSON-lines snapshots in a folder; a snapshot's time is its file's name."""
    raw = spark.read.schema("provider string, pattern string, input_rate double, output_rate double, cached_rate double").json(folder)
    taken = F.try_to_timestamp(F.regexp_extract(F.col("_metadata.file_path"), r"(\d{4}-\d{2}-\d{2}(?:T\d{2}-?\d{2}-?\d{2})?)[^/]*$", 1))
    return raw.select(taken.alias("taken"), "provider", "pattern", *RATES).filter("provider is not null and pattern is not null")
