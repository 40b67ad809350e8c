"""Rate-limit windows of plans: what vendors report, what is left, and how far the figures can be trusted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Provider, whether the window is over a day, the attributes with its used share and reset time, and the name of the meter.
WINDOW_KEYS = [
    ("anthropic", False, "five_hour_used_pct", "five_hour_reset_at", "anthropic_cookie:five_hour"),
    ("anthropic", True, "seven_day_used_pct", "seven_day_reset_at", "anthropic_cookie:seven_day"),
    ("openai", False, "primary_used_pct", "primary_resets_at", "codex:primary"),
    ("openai", True, "secondary_used_pct", "secondary_resets_at", "codex:secondary"),
]
# Granularities of events that aren't one message each.
NOT_MESSAGES = ["assistant_turn", "daily", "bucket", "quota_snapshot", "monthly_snapshot"]
# Observations in order of trust, with the level and source that the first one above 0 gives.
SIGNALS = [
    ("vendor_api", "high", "vendor_usage_api"),
    ("cookie", "high", "anthropic_cookie"),
    ("jsonl", "high", "claude_code_jsonl"),
    ("codex", "high", "codex_jsonl"),
    ("copilot", "high", "github_copilot"),
    ("cursor", "high", "cursor_web"),
]


def is_message(attributes: Column) -> Column:
    """Whether an event stands for one message; its granularity says otherwise."""
    return ~F.coalesce(F.try_element_at(attributes, F.lit("granularity")), F.lit("")).isin(NOT_MESSAGES)


def tokens_of(events: DataFrame) -> Column:
    """total_tokens, or where there are none input and output together."""
    both = F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))
    return F.when(F.coalesce("total_tokens", F.lit(0)) != 0, F.col("total_tokens")).otherwise(both) if "total_tokens" in events.columns else both


def window_use(events: DataFrame, now, hours: int) -> DataFrame:
    """(provider, messages, tokens) of plan-covered requests in the hours up to now."""
    held = events.filter((F.col("cost_source") == "plan_included") & (F.col("ts") >= F.lit(now) - F.make_dt_interval(hours=F.lit(hours))) & (F.col("ts") <= F.lit(now)))
    counts = F.count_if(is_message(F.col("attributes"))) if "attributes" in events.columns else F.count("*")
    return held.groupBy("provider").agg(counts.alias("messages"), F.coalesce(F.sum(tokens_of(events)), F.lit(0)).alias("tokens"))


def reported(events: DataFrame, now, hours: int) -> DataFrame:
    """(provider, used_pct, resets_in_s, meter): the last report of each provider's window within twice its length, an hour at least.

    events have a map `attributes`. A share that isn't a number gives no row; a reset time that
    isn't one, or has passed, is null. Ties: the smaller event_id.
    """
    back = max(2 * hours, 1)
    keys = F.array(*[F.struct(F.lit(p).alias("provider"), F.lit(used).alias("used"), F.lit(reset).alias("reset"), F.lit(meter).alias("meter")) for p, long, used, reset, meter in WINDOW_KEYS if long == (hours > 24)])
    held = events.filter((F.col("ts") >= F.lit(now) - F.make_dt_interval(hours=F.lit(back))) & (F.col("ts") <= F.lit(now)))
    fits = F.get(F.filter(keys, lambda k: (k["provider"] == F.col("provider")) & F.map_contains_key(F.col("attributes"), k["used"])), F.lit(0))
    rows = held.withColumn("k", fits).filter("k is not null")
    get = lambda name: F.try_element_at(F.col("attributes"), F.col(f"k.{name}"))
    last = F.max_by(F.struct(get("used").alias("used"), get("reset").alias("reset"), F.col("k.meter").alias("meter")), F.struct("ts", -F.col("event_id")))
    resets = F.unix_timestamp(F.expr("try_to_timestamp(l.reset)")) - F.unix_timestamp(F.lit(now))
    out = rows.groupBy("provider").agg(last.alias("l")).withColumn("used_pct", F.expr("try_cast(l.used as double)")).filter("used_pct is not null")
    return out.select("provider", "used_pct", F.when(resets > 0, resets).alias("resets_in_s"), F.col("l.meter").alias("meter"))


def session_budget(plans: DataFrame, used: DataFrame, recent: DataFrame, vendor: DataFrame, recent_hours: float = 0.5) -> DataFrame:
    """A row for each plan (provider, cap, window_s): window_pct, headroom, rate_per_hour, cap_in_s, resets_in_s, confidence, action.

    used and recent: messages by provider in the window and in the last recent_hours; vendor: rows
    of `reported`, which hold over counts. Plans without a cap and a report are `unknown`.
    """
    rows = plans.join(used.select("provider", F.col("messages").alias("sent")), "provider", "left").join(recent.select("provider", F.col("messages").alias("lately")), "provider", "left").join(vendor, "provider", "left").fillna(0, ["sent", "lately"])
    pct2 = lambda x: F.round(x * 100) / 100
    told = F.col("used_pct").isNotNull()
    capped = (F.coalesce("cap", F.lit(0)) > 0) & (F.coalesce("window_s", F.lit(0)) > 0)
    share = F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("used_pct")))
    counted = F.round(F.col("sent") / F.nullif("cap", F.lit(0)) * 10000) / 100
    left = F.when(told & capped, F.greatest(F.round(F.col("cap") * (100 - share) / 100), F.lit(0)).cast("long")).when(capped, F.greatest(F.col("cap") - F.col("sent"), F.lit(0)))
    rate = F.when(~told & capped & (F.col("lately") > 0), F.round(F.col("lately") / F.lit(recent_hours) * 10) / 10)
    rows = rows.withColumns({"told": told, "capped": capped, "window_pct": F.when(told, pct2(share)).when(capped, counted), "headroom": left, "rate_per_hour": rate})
    p, h, r = F.col("window_pct"), F.col("headroom"), F.col("rate_per_hour")
    by_vendor = F.when(share >= 95, "wait_reset").when(share >= 80, "slow_down").when(share >= 60, "switch_model").otherwise("continue")
    hours = h / F.nullif(r, F.lit(0.0))
    burning = F.when((h <= 0) | (p >= 95), "wait_reset").when((p >= 80) & (hours < 1.0), "wait_reset").when(p >= 80, "slow_down").when((p >= 60) & (hours < 1.5), "switch_model").otherwise("continue")
    idle = F.when(p >= 80, "slow_down").otherwise("continue")
    action = F.when(F.col("told"), by_vendor).when(~F.col("capped"), "unknown").when(r.isNull(), idle).otherwise(burning)
    sure = F.when(F.col("told"), "high").when(r.isNull(), "low").when((F.lit(recent_hours) >= 0.5) & (F.col("lately") >= 5), "high").otherwise("medium")
    cap_in = F.when(r.isNull(), None).when(h == 0, 0).otherwise((hours * 3600).cast("long"))
    return rows.select("provider", "window_pct", "headroom", "rate_per_hour", cap_in.alias("cap_in_s"), F.coalesce("resets_in_s", "window_s").alias("resets_in_s"), sure.alias("confidence"), action.alias("action"))


def signal_quality(seen: DataFrame) -> DataFrame:
    """seen (counts of observations in a window: vendor_api, cookie, jsonl, codex, copilot, cursor, proxy, pings, cache) with level and source: the first that fits, most trusted first."""
    n = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0))
    ladder = [(n(c) > 0, level, source) for c, level, source in SIGNALS]
    ladder += [((n("proxy") > 0) & (n("proxy") >= n("pings")), "high", "proxy_traffic"), (n("proxy") > 0, "medium", "proxy_traffic"), (n("cache") > 0, "medium", "claude_code_stats_cache")]
    level, source = F.lit("low"), F.lit("mcp_tool_pings")
    for on, x, y in reversed(ladder):
        level, source = F.when(on, x).otherwise(level), F.when(on, y).otherwise(source)
    return seen.withColumns({"level": level, "source": source})


def headroom_with_reports(headroom: DataFrame, vendor: DataFrame) -> DataFrame:
    """headroom with window_pct and risk by the vendor's own report where there is one: high from 80, medium from 60, else low; a higher risk stays."""
    rank = lambda x: F.array_position(F.array(*map(F.lit, ("unknown", "low", "medium", "high"))), x)
    told = F.when(F.col("used_pct") >= 80, "high").when(F.col("used_pct") >= 60, "medium").when(F.col("used_pct") >= 0, "low")
    rows = headroom.join(vendor.select("provider", "used_pct"), "provider", "left")
    risk = F.when(F.col("used_pct").isNull() | (rank(F.col("risk")) > rank(told)), F.col("risk")).otherwise(told)
    return rows.withColumns({"risk": risk, "window_pct": F.coalesce(F.round("used_pct", 2), "window_pct")}).drop("used_pct")
