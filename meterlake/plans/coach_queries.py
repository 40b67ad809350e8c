"""The registered queries of meterlake.operators.coach and their SQL; joined to those of meterlake.plans.queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pricing
from ..operators import coach, series, spend
from ..sources.usage import SYNTHETIC, usage_events
from .queries import _DAILY, _FIT, _HOLT, _HOLT_BAND, _LINE_BAND, _NOW, _ORDER, _PRICED, _SUMS, _USAGE, _X, NOW, _daily, _priced, _read, _usage

PLANS = [("openai", 4_000_000, 900), ("anthropic", 90_000_000, 500), ("gemini", 2_000_000_000, 5_000_000), ("none", 1000, 10)]
TASKS = [("a", datetime(2024, 1, 2, 3), datetime(2024, 1, 2, 9)), ("b", datetime(2024, 1, 5, 22), datetime(2024, 1, 7, 1)), ("c", datetime(2030, 1, 1), datetime(2030, 1, 2))]


def _headroom(spark: SparkSession, d: str) -> DataFrame:
    plans = spark.createDataFrame(PLANS, "provider string, quota_tokens long, messages long")
    return coach.headroom(spend.consumption(_usage(spark, d), NOW), plans, NOW)


def _tasks(spark: SparkSession, d: str) -> DataFrame:
    everything = pricing.priced(usage_events(_read(spark, d, "events")), pricing.rate_card(spark))  # demo data is part of a task
    return coach.task_metrics(everything, spark.createDataFrame(TASKS, "task string, begins timestamp_ntz, ends timestamp_ntz"))


def _waste(spark: SparkSession, d: str) -> DataFrame:
    return coach.waste(series.facts(_priced(spark, d)))


def _cache_keys(spark: SparkSession, d: str) -> DataFrame:
    return _usage(spark, d).select("event_id", coach.cache_key(F.col("provider"), F.lit("POST"), F.col("model"), F.col("prompt_hash")).alias("key"))


def _weekly(spark: SparkSession, d: str) -> DataFrame:
    return _usage(spark, d).groupBy("provider", F.date_trunc("week", "ts").alias("at")).agg(F.sum("input_tokens").cast("double").alias("value"))


def _daily_agents(spark: SparkSession, d: str) -> DataFrame:
    keys = [F.date_trunc("day", "ts").cast("timestamp_ntz").alias("bucket"), "agent_id", "model"]
    return _priced(spark, d).groupBy(*keys).agg(*spend._sums())


QUERIES = {
    "efficiency_score": lambda s, d: coach.efficiency(series.facts(_priced(s, d))),
    "waste_findings": _waste,
    "plan_headroom": _headroom,
    "kpi_grades": lambda s, d: coach.kpis(_usage(s, d)),
    "forecast_auto": lambda s, d: coach.auto_forecast(_weekly(s, d), "provider"),
    "forecast_breach": lambda s, d: coach.breach(series.holt_forecast(_daily(s, d), "provider", horizon=14), "provider", 200_000.0),
    "tier_crossings": lambda s, d: coach.tier_crossings(_priced(s, d), "workflow_id", 0.05),
    "repeat_reads": lambda s, d: coach.repeat_reads(_usage(s, d), ["workflow_id", "model"], "prompt_hash"),
    "workflow_list": lambda s, d: coach.workflow_list(_priced(s, d)),
    "trailing_messages": lambda s, d: coach.trailing(_usage(s, d), NOW, [5, 24, 168]),
    "source_warning": lambda s, d: coach.synthetic_share(usage_events(_read(s, d, "events")), SYNTHETIC),
    "budget_windows": lambda s, d: coach.budget_windows(_usage(s, d).select(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).distinct()),
    "task_metrics": _tasks,
    "cache_key": _cache_keys,
    "spend_weekly": lambda s, d: spend.bucketed(_priced(s, d), "week"),
    "rollup_hourly_workflow": lambda s, d: spend.bucketed(_priced(s, d), "hour", "workflow_id"),
    "rollup_daily_agent_model": _daily_agents,
}

_FACTS = f"""{_PRICED},
g AS (SELECT *, greatest(input_tokens - lag(input_tokens) {_ORDER}, 0) AS grown, lag(prompt_hash) {_ORDER} = prompt_hash AS again FROM priced),
sums AS (
  SELECT workflow_id, count(*) AS steps, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, max(input_tokens) AS max_context,
    count(DISTINCT model) AS models, count(DISTINCT agent_id) AS agents, coalesce(sum(grown), 0)::BIGINT AS growth, coalesce(bool_or(again), false) AS again FROM g GROUP BY ALL),
i AS (SELECT workflow_id, agent_id, row_number() {_ORDER} AS i, row_number() {_ORDER} - row_number() OVER (PARTITION BY workflow_id, agent_id ORDER BY ts, event_id) AS island FROM usage),
r AS (SELECT workflow_id, agent_id, island, count(*) AS run, min(i) AS first FROM i WHERE agent_id IS NOT NULL GROUP BY ALL),
runs AS (SELECT workflow_id, agent_id, run FROM r QUALIFY row_number() OVER (PARTITION BY workflow_id ORDER BY run DESC, first) = 1),
facts AS (SELECT s.*, runs.agent_id, coalesce(runs.run, 0) AS run FROM sums s LEFT JOIN runs USING (workflow_id))"""

_VALUES = ", ".join(str(p) for p in PLANS)
_TASKS = ", ".join(f"('{t}', TIMESTAMP '{a}', TIMESTAMP '{b}')" for t, a, b in TASKS)

ORACLE_SQL = {
    "efficiency_score": f"""WITH {_FACTS},
p AS (
  SELECT workflow_id,
    least(1, greatest(0, 1::DOUBLE / (1 + (max_context / 16384::DOUBLE) * (max_context / 16384::DOUBLE)) - least(0.3::DOUBLE, growth / 16384::DOUBLE * 0.3::DOUBLE)))::DOUBLE AS context,
    output_tokens / nullif(input_tokens + output_tokens, 0)::DOUBLE AS share,
    CASE WHEN run <= 4 THEN 1 ELSE greatest(0, 1 - (run - 4) / 8::DOUBLE) END::DOUBLE AS loops,
    CASE WHEN steps <= 4 THEN 1 ELSE (least(1, greatest(agents, 1) / 3::DOUBLE) + least(1, greatest(models, 1) / 2::DOUBLE)) / 2 END::DOUBLE AS diversity
  FROM facts),
q AS (
  SELECT workflow_id, context, loops, diversity,
    CASE WHEN share >= 0.5 THEN greatest(0.7::DOUBLE, 1 - (share - 0.3::DOUBLE) * 0.4::DOUBLE) WHEN share >= 0.2 THEN 1 - abs(share - 0.3::DOUBLE) / 0.1::DOUBLE * 0.05::DOUBLE ELSE coalesce(share / 0.2::DOUBLE, 0) END::DOUBLE AS io
  FROM p),
t AS (SELECT *, least(1, greatest(0, context * 0.4::DOUBLE + io * 0.3::DOUBLE + loops * 0.2::DOUBLE + diversity * 0.1::DOUBLE))::DOUBLE AS total FROM q)
SELECT workflow_id, round(context, 6) AS context, round(io, 6) AS io, round(loops, 6) AS loops, round(diversity, 6) AS diversity, round(total, 6) AS total, round(total * 100)::INTEGER AS grade FROM t""",
    "waste_findings": f"""WITH {_FACTS}
SELECT workflow_id, 'oversized_context' AS finding, NULL::VARCHAR AS agent_id, (max_context - 32768)::BIGINT AS excess FROM facts WHERE max_context >= 32768
UNION ALL SELECT workflow_id, 'context_growth', NULL, (growth - 16384)::BIGINT FROM facts WHERE growth >= 16384
UNION ALL SELECT workflow_id, 'agent_loop', agent_id, (run - 4)::BIGINT FROM facts WHERE run >= 4
UNION ALL SELECT workflow_id, 'repeated_prompt', NULL, 0::BIGINT FROM facts WHERE again""",
    "plan_headroom": f"""WITH {_USAGE},
plans(provider, quota, messages) AS (VALUES {_VALUES}),
u AS (
  SELECT provider, sum(input_tokens + output_tokens) FILTER (ts >= date_trunc('month', {_NOW})) AS month, sum(input_tokens + output_tokens) FILTER (ts >= {_NOW} - INTERVAL 7 DAY) AS week, count(*) FILTER (ts >= {_NOW} - INTERVAL 7 DAY) AS messages
  FROM usage WHERE cost_source = 'plan_included' AND ts <= {_NOW} GROUP BY ALL),
p AS (SELECT provider, quota, plans.messages AS cap, coalesce(month, 0)::BIGINT AS month, coalesce(week, 0)::BIGINT AS week, coalesce(u.messages, 0) AS sent FROM plans LEFT JOIN u USING (provider)),
q AS (
  SELECT provider, round(month::DOUBLE / quota * 10000) / 100 AS month_pct, round(sent::DOUBLE / cap * 10000) / 100 AS window_pct, quota <= month AS gone,
    CASE WHEN week <= 0 THEN NULL WHEN quota <= month THEN 0 ELSE round((quota - month) / (week / 7::DOUBLE) * 10) / 10 END::DOUBLE AS headroom_days,
    date_diff('second', {_NOW}, date_trunc('month', {_NOW}) + INTERVAL 1 MONTH) / 86400::DOUBLE AS days
  FROM p),
k AS (
  SELECT *, CASE WHEN window_pct >= 80 THEN 3 WHEN window_pct >= 60 THEN 2 WHEN window_pct > 0 THEN 1 ELSE 0 END AS a,
    CASE WHEN headroom_days IS NULL THEN CASE WHEN month_pct >= 80 THEN 3 WHEN month_pct >= 60 THEN 2 ELSE 0 END
      WHEN gone OR (month_pct >= 80 AND headroom_days < days) THEN 3 WHEN month_pct >= 60 OR headroom_days < days * 1.5 THEN 2 ELSE 1 END AS b
  FROM q)
SELECT provider, month_pct, window_pct, headroom_days, ['unknown', 'low', 'medium', 'high'][greatest(a, b) + 1] AS risk FROM k""",
    "kpi_grades": f"""WITH {_USAGE},
v AS (
  SELECT 'spend_attribution' AS kpi, round(count(*) FILTER (coalesce(workflow_id, '') <> '' OR coalesce(agent_id, '') <> '')::DOUBLE / nullif(count(*), 0) * 100, 6) AS value FROM usage
  UNION ALL SELECT 'cache_hit', round(sum(cached_input_tokens)::DOUBLE / nullif(sum(input_tokens), 0) * 100, 6) FROM usage)
SELECT kpi, value, CASE WHEN value >= 90 THEN 'A' WHEN value >= 70 THEN 'B' WHEN value >= 50 THEN 'C' WHEN value IS NOT NULL THEN 'F' END AS grade FROM v""",
    "forecast_auto": f"""WITH RECURSIVE {_USAGE},
weekly AS (SELECT provider, date_trunc('week', ts)::TIMESTAMP AS moment, sum(input_tokens)::DOUBLE AS value FROM usage GROUP BY ALL),
{_X.format("weekly")}, {_HOLT},
f AS (SELECT provider, {_FIT} FROM (SELECT provider, value, i - 1 AS x FROM x) GROUP BY ALL)
SELECT provider, step::INTEGER AS step, {_HOLT_BAND}, 'holt' AS model FROM h, range(1, 4) r(step) WHERE i = n AND n >= 4
UNION ALL SELECT provider, step::INTEGER, {_LINE_BAND}, 'linear' FROM f, range(1, 4) r(step) WHERE n BETWEEN 2 AND 3""",
    "forecast_breach": f"""WITH RECURSIVE {_DAILY}, {_X.format("daily")}, {_HOLT},
p AS (SELECT provider, step::INTEGER AS step, round(greatest(0, l + step * t), 4) AS predicted FROM h, range(1, 15) r(step) WHERE i = n),
s AS (SELECT *, sum(predicted) OVER (PARTITION BY provider ORDER BY step) AS running FROM p)
SELECT provider, min(step) AS step FROM s WHERE running >= 200000 GROUP BY ALL""",
    "tier_crossings": f"""WITH {_PRICED},
c AS (SELECT workflow_id, ts, event_id, floor((sum(cost::DECIMAL(18,9)) OVER (PARTITION BY workflow_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::DOUBLE / 0.05::DOUBLE)::BIGINT AS tier FROM priced),
b AS (SELECT *, coalesce(lag(tier) {_ORDER}, 0) AS before FROM c)
SELECT workflow_id, event_id, tier FROM b WHERE tier > before""",
    "repeat_reads": f"WITH {_USAGE}, p AS (SELECT workflow_id, model, prompt_hash = lag(prompt_hash) OVER (PARTITION BY workflow_id, model ORDER BY ts, event_id) AS same FROM usage) SELECT workflow_id, model, count(*) AS reads, count(*) FILTER (same) AS repeats FROM p GROUP BY ALL",
    "workflow_list": f"WITH {_PRICED} SELECT workflow_id, count(*) AS requests, sum(input_tokens + output_tokens)::BIGINT AS tokens, coalesce(sum(cost::DECIMAL(18,9))::DOUBLE, 0) AS cost_usd FROM priced WHERE coalesce(workflow_id, '') <> '' GROUP BY ALL",
    "trailing_messages": f"WITH {_USAGE} SELECT provider, hours, count(*) AS messages, sum(input_tokens + output_tokens)::BIGINT AS tokens FROM usage, (VALUES (5), (24), (168)) w(hours) WHERE ts > {_NOW} - to_hours(hours) AND ts <= {_NOW} GROUP BY ALL",
    "source_warning": f"WITH {_USAGE}, s AS (SELECT count(*) AS events, count(*) FILTER (source = 'demo') AS synthetic FROM everything) SELECT events, synthetic, round(coalesce(synthetic::DOUBLE / nullif(events, 0), 0), 6) AS share, coalesce(synthetic::DOUBLE / nullif(events, 0), 0) > 0.1 AS warn FROM s",
    "budget_windows": f"WITH {_USAGE}, d AS (SELECT DISTINCT date_trunc('day', ts)::TIMESTAMP AS day FROM usage) SELECT day, period, begins::TIMESTAMP AS begins, ends::TIMESTAMP AS ends FROM (SELECT day, 'day' AS period, day AS begins, day + INTERVAL 1 DAY AS ends FROM d UNION ALL SELECT day, 'week', date_trunc('week', day), date_trunc('week', day) + INTERVAL 7 DAY FROM d UNION ALL SELECT day, 'month', date_trunc('month', day), date_trunc('month', day) + INTERVAL 1 MONTH FROM d)",
    "task_metrics": f"WITH {_PRICED.replace('FROM usage u)', 'FROM everything u)')}, tasks(task, begins, ends) AS (VALUES {_TASKS}) SELECT task, count(event_id) AS turns, coalesce(sum(input_tokens), 0)::BIGINT AS input_tokens, coalesce(sum(cost::DECIMAL(18,9))::DOUBLE, 0) AS cost_usd, date_sub('second', any_value(begins), min(ts)) AS first_wait_s FROM tasks LEFT JOIN priced ON ts BETWEEN begins AND ends GROUP BY task",
    "cache_key": f"WITH {_USAGE} SELECT event_id, sha256(provider || chr(0) || 'POST' || chr(0) || model || chr(0) || prompt_hash) AS key FROM usage",
    "spend_weekly": f"WITH {_PRICED} SELECT date_trunc('week', ts)::TIMESTAMP AS bucket, {_SUMS} FROM priced GROUP BY ALL",
    "rollup_hourly_workflow": f"WITH {_PRICED} SELECT date_trunc('hour', ts) AS bucket, workflow_id, {_SUMS} FROM priced GROUP BY ALL",
    "rollup_daily_agent_model": f"WITH {_PRICED} SELECT date_trunc('day', ts)::TIMESTAMP AS bucket, agent_id, model, {_SUMS} FROM priced GROUP BY ALL",
}
