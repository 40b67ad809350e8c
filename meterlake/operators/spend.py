"""Spend questions over priced events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def exact_sum(column: str) -> Column:
    """A sum of money that doesn't depend on the order of the rows: exact in nano-dollars, then a double."""
    return F.coalesce(F.sum(F.col(column).cast("decimal(18,9)")).cast("double"), F.lit(0.0))


def _sums() -> list:
    return [
        F.count("*").alias("requests"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
        exact_sum("cost").alias("cost_usd"),
    ]


def bucketed(priced: DataFrame, bucket: str = "hour", key: str | None = None) -> DataFrame:
    """Requests, tokens and cost by hour or day, and by a column (null as empty)."""
    keys = [F.date_trunc(bucket, "ts").cast("timestamp_ntz").alias("bucket")] + ([F.coalesce(key, F.lit("")).alias(key)] if key else [])
    return priced.groupBy(*keys).agg(*_sums())


def summary(priced: DataFrame) -> DataFrame:
    return priced.agg(*_sums(), exact_sum("list_price").alias("api_value_usd"))


def unpriced(priced: DataFrame) -> DataFrame:
    """Models without a rate among metered requests that have no recorded cost."""
    return priced.filter("cost_source = 'metered' and coalesce(cost_usd, 0) <= 0 and list_price is null").groupBy("provider", "model").agg(F.count("*").alias("requests"))


def plan_covered(priced: DataFrame) -> DataFrame:
    """What requests that a plan or trial covers would have cost at list price."""
    return priced.filter("cost_source <> 'metered'").groupBy("provider", "cost_source").agg(F.count("*").alias("requests"), exact_sum("list_price").alias("shadow_usd"))


def cache_stats(events: DataFrame) -> DataFrame:
    total, cached = F.coalesce(F.sum("input_tokens"), F.lit(0)), F.coalesce(F.sum("cached_input_tokens"), F.lit(0))
    out = events.groupBy("provider").agg(total.alias("total"), cached.alias("cached"))
    return out.select("provider", "total", "cached", F.greatest(F.col("total") - F.col("cached"), F.lit(0)).alias("uncached"), F.round(F.when(F.col("total") > 0, F.col("cached") / F.col("total")).otherwise(0.0), 6).alias("ratio"))


def top_consumers(priced: DataFrame, key: str, n: int = 10) -> DataFrame:
    """The n keys of the highest cost; ties by tokens, then key."""
    out = priced.groupBy(key).agg(exact_sum("cost").alias("cost_usd"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"))
    return out.orderBy(F.desc("cost_usd"), F.desc("tokens"), key).limit(n)


def burn_rate(priced: DataFrame, now, hours: int = 24) -> DataFrame:
    """Hourly cost in the hours before now."""
    return bucketed(priced.filter((F.col("ts") >= F.lit(now) - F.expr(f"interval {hours} hours")) & (F.col("ts") < F.lit(now))), "hour")


def consumption(events: DataFrame, now) -> DataFrame:
    """Tokens of plan-covered requests this calendar month and in the last 7 days, by provider."""
    tokens = F.col("input_tokens") + F.col("output_tokens")
    month = F.col("ts") >= F.date_trunc("month", F.lit(now))
    week = F.col("ts") >= F.lit(now) - F.expr("interval 7 days")
    plan = events.filter((F.col("cost_source") == "plan_included") & (F.col("ts") <= F.lit(now)))
    return plan.groupBy("provider").agg(F.sum(F.when(month, tokens).otherwise(0)).alias("month_tokens"), F.sum(F.when(week, tokens).otherwise(0)).alias("week_tokens"), F.count_if(week).alias("week_messages"))


def budget_alerts(priced: DataFrame, limit_usd: float, warn: float = 0.75, critical: float = 0.95) -> DataFrame:
    """Share of a daily budget that each provider's day has used, and its level."""
    used = F.col("cost_usd") / F.lit(limit_usd)
    level = F.when(used >= 1, "exceeded").when(used >= critical, "critical").when(used >= warn, "warning").otherwise("ok")
    return bucketed(priced, "day", "provider").select("bucket", "provider", "cost_usd", used.alias("used"), level.alias("level"))


def source_counts(events: DataFrame) -> DataFrame:
    return events.groupBy(F.coalesce(F.nullif("source", F.lit("")), F.lit("(none)")).alias("source")).agg(F.count("*").alias("events"))


def retention(events: DataFrame, now, days: dict[str, int], default: int) -> DataFrame:
    """Rows of each cost source that are older than it is kept."""
    keep = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in days.items() for x in kv]), F.col("cost_source")), F.lit(default))
    return events.filter(F.col("ts") < F.lit(now) - F.make_dt_interval(keep)).groupBy("cost_source").agg(F.count("*").alias("to_delete"))
