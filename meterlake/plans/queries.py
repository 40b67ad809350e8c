"""The registered queries of the ledger and text operators, and the SQL each is held against."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pricing
from ..functions.tables import spread
from ..operators import messages, redaction, series, spend, text, tool_output
from ..sources.usage import usage_events, without_sources
from . import tool_samples

NOW = datetime(2024, 1, 25, 12)


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _usage(spark: SparkSession, d: str) -> DataFrame:
    return without_sources(usage_events(_read(spark, d, "events")))


def _priced(spark: SparkSession, d: str) -> DataFrame:
    return pricing.priced(_usage(spark, d), pricing.rate_card(spark))


def _daily(spark: SparkSession, d: str) -> DataFrame:
    return _usage(spark, d).groupBy("provider", F.date_trunc("day", "ts").alias("at")).agg(F.sum("input_tokens").cast("double").alias("value"))


def _card(spark: SparkSession, d: str, new: bool = True) -> DataFrame:
    """Parts as entries of a rate card: an old one, and a new one with other parts, changed rates and gaps."""
    key, size = F.col("p_partkey"), F.col("p_size")
    base = (key % 50 + 1) / 4.0
    changed = F.when(size % 10 == 1, 0.0).when(size % 4 == 0, base * 2).otherwise(base) if new else base
    provider = F.get(F.array(*map(F.lit, PROVIDERS)), (key % 4).cast("int"))
    pattern = F.concat(F.lit("m-"), key.cast("string"), F.when(key % 3 == 0, "*").otherwise(""))
    rows = _read(spark, d, "part").filter(key % (7 if new else 5) != 0)
    return rows.select(provider.alias("provider"), pattern.alias("pattern"), changed.alias("input_rate"), (base * (size % 9 + 1)).alias("output_rate"), (base * (size % 12) / 8.0).alias("cached_rate"))


PROVIDERS = ["openai", "anthropic", "gemini", "mistral"]


def _cheapest(spark: SparkSession, d: str) -> DataFrame:
    total = F.col("input_rate") + F.col("output_rate")
    return _card(spark, d).groupBy("provider").agg(F.min_by("pattern", F.struct(total, F.col("pattern"))).alias("pattern"), F.min(total).alias("total"))


def _first_latencies(spark: SparkSession, d: str) -> DataFrame:
    return series.upper_medians(_usage(spark, d).filter("input_tokens is not null"), "provider", "input_tokens")


def _token_estimates(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "conversations").groupBy("conv_id").agg(F.sum(text.token_estimate(F.col("text")) + 4).alias("tokens"))


def _sectioned(spark: SparkSession, d: str) -> DataFrame:
    """documents as retrieved contexts: a third as they are, a third with dashes between sentences, a third with numbers before them."""
    t, kind = F.col("text"), F.pmod("doc_id", F.lit(3))
    return _read(spark, d, "documents").select("doc_id", F.when(kind == 1, F.replace(t, F.lit(". "), F.lit(".\n---\n"))).when(kind == 2, F.concat(F.lit("1. "), F.replace(t, F.lit(". "), F.lit(".\n2. ")))).otherwise(t).alias("t"))


def _leaky(spark: SparkSession, d: str) -> DataFrame:
    """documents with a made-up secret of one kind or another behind most."""
    h = F.sha2(F.col("text").cast("binary"), 256)
    kind = F.pmod("doc_id", F.lit(6))
    tail = F.when(kind == 0, F.concat(F.lit(" AKIA"), F.upper(F.substring(h, 1, 16)))).when(kind == 1, F.concat(F.lit(" Bearer "), h)).when(kind == 2, F.concat(F.lit(" key=sk-ant-"), h))
    tail = tail.when(kind == 3, F.concat(F.lit(" v "), F.base64(F.unhex(h)))).when(kind == 4, F.concat(F.lit(' aws_secret_access_key = "'), F.substring(h, 1, 40), F.lit('"')))
    return _read(spark, d, "documents").select("doc_id", F.concat("text", tail.otherwise("")).alias("text"))


def _echoed(spark: SparkSession, d: str) -> DataFrame:
    """conversations in which every message comes again, once as it was but for its start and once without some letters."""
    c = _read(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    cut = c.withColumns({"turn": F.col("turn") + 1000, "text": F.substring("text", 13, 1 << 30)})
    return c.unionByName(cut).unionByName(cut.withColumns({"turn": F.col("turn") + 1000, "text": F.replace(F.col("text"), F.lit(" d"), F.lit(" "))}))


def tool_samples_text(lines, w, k):
    """Sample lines with their slots filled by a word and a count, as one text."""
    text = lambda c: c.cast("string")

    def filled(line):
        for slot, value in (("{w}", w), ("{k}", text(k)), ("{k1}", text(k + 1)), ("{k2}", text(k * 2))):
            line = F.replace(line, F.lit(slot), value)
        times = F.when(line.contains("{i}"), k).otherwise(1)
        return F.transform(F.sequence(F.lit(1), times.cast("int")), lambda i: F.replace(line, F.lit("{i}"), text(i)))

    return F.array_join(F.flatten(F.transform(lines, filled)), "\n")


def sample_lines(commands, key, w, k):
    """The text that a command of a list prints, by a key modulo their number."""
    lines = F.lit(None).cast("array<string>")
    for at, command in enumerate(commands):
        own = F.array(*[F.lit(line) for c, _, mark, line in tool_samples.templates() if c == command and mark in "!.-~"])
        lines = F.when(key % len(commands) == at, own).otherwise(lines)
    return tool_samples_text(lines, w, k)


def _outputs(spark: SparkSession, d: str, commands: list[str]) -> DataFrame:
    """(p_partkey, command, t): a command's output for each part, its names and counts from the part's columns."""
    lines = spark.createDataFrame([t for t in tool_samples.templates() if t[2] in "!.-~"], "command string, nr int, mark string, line string")
    # a row for each of the sample commands, so it may be sent to all tasks
    bare = lines.groupBy("command").agg(F.transform(F.array_sort(F.collect_list(F.struct("nr", "line"))), lambda x: x["line"]).alias("lines"))
    names = F.array(*map(F.lit, commands))
    w, k = F.lower(F.replace("p_brand", F.lit("#"))).alias("w"), (F.col("p_size") % 5 + 3).alias("k")
    parts = spread(_read(spark, d, "part").select("p_partkey", F.get(names, (F.col("p_partkey") % len(commands)).cast("int")).alias("command"), w, k), 5_000)
    return parts.join(F.broadcast(bare), "command").select("p_partkey", "command", tool_samples_text(F.col("lines"), F.col("w"), F.col("k")).alias("t"))


def _tool_outputs(spark: SparkSession, d: str) -> DataFrame:
    """Each command's output reduced at two levels."""
    rows = _outputs(spark, d, [*tool_samples.SAMPLES]).withColumn("level", F.explode(F.array(F.lit("balanced"), F.lit("aggressive"))))
    out = rows.withColumn("r", tool_output.reduced(F.col("t"), F.col("command"), F.col("level")))
    return out.select("p_partkey", "command", "level", F.col("r.text").alias("text"), F.col("r.critical_kept").alias("critical_kept"), F.col("r.bytes_before").alias("bytes_before"))


def _sniffed(spark: SparkSession, d: str) -> DataFrame:
    """The same texts with the command unknown."""
    out = _outputs(spark, d, tool_samples.SNIFFED).withColumn("r", tool_output.sniffed(F.col("t")))
    return out.select("p_partkey", F.col("r.text").alias("text"))


# Plain rules for prose: what must stay, what goes, what goes at the aggressive level.
PROSE_RULES = (["[A-Za-z0-9._-]+@", "[Ll]icen[cs]ed"], ["^.{0,40}$", "^[A-D]"], ["e[rn]\\.$", "^[E-H]"])


def _text_digest(column) -> list:
    return [F.length(column).alias("length"), F.md5(column.cast("binary")).alias("digest")]


QUERIES = {
    "spend_hourly_by_model": lambda s, d: spend.bucketed(_priced(s, d), "hour", "model"),
    "spend_daily_by_provider": lambda s, d: spend.bucketed(_priced(s, d), "day", "provider"),
    "spend_summary": lambda s, d: spend.summary(_priced(s, d)),
    "unpriced_models": lambda s, d: spend.unpriced(_priced(s, d)),
    "plan_covered_value": lambda s, d: spend.plan_covered(_priced(s, d)),
    "cache_stats": lambda s, d: spend.cache_stats(_usage(s, d)),
    "top_consumers": lambda s, d: spend.top_consumers(_priced(s, d), "workflow_id"),
    "burn_rate_24h": lambda s, d: spend.burn_rate(_priced(s, d), NOW),
    "source_counts": lambda s, d: spend.source_counts(usage_events(_read(s, d, "events"))),
    "plan_consumption": lambda s, d: spend.consumption(_usage(s, d), NOW),
    "budget_alerts": lambda s, d: spend.budget_alerts(_priced(s, d), 2.0),
    "retention_plan": lambda s, d: spend.retention(_usage(s, d), NOW, {"trial": 5, "metered": 20}, 10),
    "rate_overrides": lambda s, d: pricing.overridden(_card(s, d, False), _card(s, d)),
    "rate_diff": lambda s, d: pricing.difference(_card(s, d, False), _card(s, d)),
    "cheapest_model": _cheapest,
    "anomaly_rolling": lambda s, d: series.rolling_anomalies(_daily(s, d), "provider", 1.5),
    "anomaly_fixed": lambda s, d: series.fixed_anomalies(_daily(s, d), "provider", 1.5),
    "forecast_linear": lambda s, d: series.linear_forecast(_daily(s, d), "provider"),
    "forecast_holt": lambda s, d: series.holt_forecast(_daily(s, d), "provider"),
    "workflow_steps": lambda s, d: series.steps(_usage(s, d)),
    "workflow_summary": lambda s, d: series.traces(_priced(s, d)),
    "agent_longest_run": lambda s, d: series.longest_runs(_usage(s, d)),
    "prompt_repeat": lambda s, d: series.first_repeats(_usage(s, d)),
    "scorecard_upper_median": _first_latencies,
    "latest_cost": lambda s, d: series.latest(_usage(s, d), "workflow_id", "cost_usd"),
    "token_estimate": _token_estimates,
    "prompt_compress": lambda s, d: _read(s, d, "documents").select("doc_id", *_text_digest(text.compressed(F.col("text")))),
    "chunk_prune": lambda s, d: _sectioned(s, d).select("doc_id", *_text_digest(text.pruned(F.col("t")))),
    "noise_scrub": lambda s, d: _read(s, d, "documents").select("doc_id", *_text_digest(text.scrubbed(F.col("text")))),
    "redact_text": lambda s, d: redaction.redacted(_leaky(s, d), "text").select("doc_id", *_text_digest(F.col("text"))),
    "redaction_counts": lambda s, d: redaction.counts(_leaky(s, d), "text"),
    "rule_duplicates": lambda s, d: text.duplicate_groups(_read(s, d, "documents")),
    "context_trim": lambda s, d: text.trimmed(_read(s, d, "conversations"), 2).select("conv_id", "turn", "role"),
    "tool_output_reduce": _tool_outputs,
    "tool_output_sniffed": _sniffed,
    "tool_output_rules": lambda s, d: _read(s, d, "documents").select("doc_id", *_text_digest(tool_output.filtered(F.col("text"), *PROSE_RULES, "aggressive"))),
    "near_dup_messages": lambda s, d: messages.near_duplicates(_echoed(s, d)),
}

_USAGE = """
raw AS (
  SELECT event_id, ts, user_id, value, event_type, cast(json_extract(props, '$.k') AS BIGINT) AS k FROM events),
tokens AS (
  SELECT event_id, ts, user_id, k,
    CASE event_type WHEN 'click' THEN 'openai' WHEN 'view' THEN 'anthropic' WHEN 'purchase' THEN 'gemini' WHEN 'signup' THEN 'mistral' ELSE 'cohere' END AS provider,
    CASE event_type WHEN 'click' THEN 'gpt' WHEN 'view' THEN 'claude' WHEN 'purchase' THEN 'gemini' WHEN 'signup' THEN 'mistral' ELSE 'nova' END || '-' || (user_id % 3) AS model,
    cast(floor(value * 100) AS BIGINT) AS input_tokens, cast(floor(value * 10) AS BIGINT) AS output_tokens,
    CASE WHEN k % 4 <> 0 THEN round(value * cast(0.001 AS DOUBLE), 6) END AS cost_usd
  FROM raw),
everything AS (
  SELECT *, input_tokens * k // 100 AS cached_input_tokens, 'wf-' || user_id AS workflow_id,
    CASE WHEN k % 11 <> 0 THEN 'agent-' || (user_id % 7) END AS agent_id, cast(k % 5 AS VARCHAR) AS prompt_hash,
    CASE WHEN k < 20 THEN 'plan_included' WHEN k < 25 THEN 'trial' ELSE 'metered' END AS cost_source,
    CASE WHEN k % 10 = 9 THEN 'demo' WHEN k % 10 <> 8 THEN 'proxy' END AS source
  FROM tokens),
usage AS (SELECT * FROM everything WHERE source IS NULL OR source <> 'demo')"""

_CARD = "card(provider, pattern, effective_from, input_rate, output_rate, cached_rate) AS (VALUES " + ", ".join(f"('{p}', '{m}', TIMESTAMP '{t}', {i}::DOUBLE, {o}::DOUBLE, {c}::DOUBLE)" for p, m, t, i, o, c in pricing.CARD) + ")"

_PRICED = f"""{_USAGE},
{_CARD},
dated AS (
  SELECT u.*, coalesce((SELECT max(effective_from) FROM card WHERE effective_from <= u.ts), (SELECT min(effective_from) FROM card)) AS card_date FROM usage u),
models AS (SELECT DISTINCT provider, model, card_date FROM dated),
rates AS (
  SELECT m.provider, m.model, m.card_date, c.input_rate, c.output_rate, c.cached_rate
  FROM models m JOIN card c ON c.provider = m.provider AND c.effective_from = m.card_date
    AND (c.pattern = m.model OR (c.pattern LIKE '%*' AND starts_with(m.model, left(c.pattern, length(c.pattern) - 1))))
  QUALIFY row_number() OVER (PARTITION BY m.provider, m.model, m.card_date ORDER BY (c.pattern = m.model) DESC, length(c.pattern) DESC) = 1),
listed AS (
  SELECT d.*, greatest(0, least(d.cached_input_tokens, d.input_tokens)) AS inside, r.input_rate, r.output_rate,
    CASE WHEN r.cached_rate > 0 THEN r.cached_rate ELSE r.input_rate END AS cached_rate
  FROM dated d LEFT JOIN rates r USING (provider, model, card_date)),
valued AS (
  SELECT *, ((input_tokens - inside) * input_rate + inside * cached_rate + output_tokens * output_rate) / 1e6::DOUBLE AS list_price FROM listed),
priced AS (
  SELECT *, CASE WHEN cost_source = 'metered' THEN CASE WHEN cost_usd > 0 THEN cost_usd ELSE coalesce(list_price, 0) END ELSE 0 END::DOUBLE AS cost FROM valued)"""

_SUMS = "count(*) AS requests, coalesce(sum(input_tokens), 0)::BIGINT AS input_tokens, coalesce(sum(output_tokens), 0)::BIGINT AS output_tokens, coalesce(sum(cost::DECIMAL(18,9))::DOUBLE, 0) AS cost_usd"
_DAILY = f"{_USAGE}, daily AS (SELECT provider, date_trunc('day', ts)::TIMESTAMP AS moment, sum(input_tokens)::DOUBLE AS value FROM usage GROUP BY ALL)"
_NOW = f"TIMESTAMP '{NOW}'"
_LEVEL = "CASE WHEN z >= 3 THEN 'high' WHEN z >= 2.25 THEN 'medium' WHEN z >= 1.5 THEN 'low' ELSE 'none' END AS severity"
_PARTS = f"""named AS (SELECT p_partkey, p_size, ({PROVIDERS})[p_partkey % 4 + 1] AS provider, 'm-' || p_partkey || CASE WHEN p_partkey % 3 = 0 THEN '*' ELSE '' END AS pattern, (p_partkey % 50 + 1) / 4.0::DOUBLE AS base FROM part),
listed_parts AS (SELECT *, base * (p_size % 9 + 1) AS output_rate, base * (p_size % 12) / 8.0::DOUBLE AS cached_rate FROM named),
old AS (SELECT provider, pattern, base AS input_rate, output_rate, cached_rate FROM listed_parts WHERE p_partkey % 5 <> 0),
new AS (SELECT provider, pattern, CASE WHEN p_size % 10 = 1 THEN 0 WHEN p_size % 4 = 0 THEN base * 2 ELSE base END::DOUBLE AS input_rate, output_rate, cached_rate FROM listed_parts WHERE p_partkey % 7 <> 0)"""
_ORDER = "OVER (PARTITION BY workflow_id ORDER BY ts, event_id)"


def _lines_kept(source: str, dropped: str) -> str:
    """SQL of the lines of `t` in source, without those for which dropped holds; x is a line, y the one before."""
    return f"""lines AS (SELECT doc_id, string_split(t, chr(10)) AS l FROM {source}),
kept AS (SELECT doc_id, array_to_string(list_filter(l, lambda x, i: i = 1 OR NOT ({dropped.replace("y", "l[i - 1]")})), chr(10)) AS t FROM lines)"""


_BLANKS = "' ' || chr(9) || chr(13) || chr(11) || chr(12)"
def _rule_sql(kind: str, pattern: str) -> str:
    """The rest of a regexp_replace() that puts a mark for what a rule finds; what stands before a group stays."""
    p = pattern.replace("(?i)", "(?i)(").replace("([A-Za", ")([A-Za") if "(?i)" in pattern else f"(){pattern}"
    return ", '" + p.replace("'", "''") + f"', '\\1' || chr(1) || '{kind}' || chr(2), 'g')"


_NO_PARTS = "[^ \\t\\n\\r\",;:=()\\[\\]{}]+"
#: Each rule in turn puts chr(1) kind chr(2) for what it finds; then tokens of high entropy without such a mark follow.
_REDACTED = f"""leaky AS (
  SELECT doc_id, text || CASE doc_id % 6 WHEN 0 THEN ' AKIA' || upper(substr(sha256(text), 1, 16)) WHEN 1 THEN ' Bearer ' || sha256(text) WHEN 2 THEN ' key=sk-ant-' || sha256(text)
    WHEN 3 THEN ' v ' || to_base64(unhex(sha256(text))) WHEN 4 THEN ' aws_secret_access_key = "' || substr(sha256(text), 1, 40) || '"' ELSE '' END AS t FROM documents),
ruled AS (SELECT doc_id, {"regexp_replace(" * len(redaction.RULES)}t{"".join(_rule_sql(k, p) for k, _, p in redaction.RULES)} AS t FROM leaky),
parted AS (SELECT doc_id, list_transform(regexp_extract_all(t, '{_NO_PARTS}|{_NO_PARTS.replace("[^", "[")}'), lambda x: CASE WHEN strlen(x) >= 20 AND NOT contains(x, chr(1)) AND NOT contains(x, chr(2)) AND regexp_full_match(x, '{_NO_PARTS}') AND list_aggregate(string_split(x, ''), 'entropy') >= 4.5 THEN chr(1) || 'high_entropy' || chr(2) ELSE x END) AS parts FROM ruled),
whole AS (SELECT doc_id, array_to_string(parts, '') AS t FROM parted),
redacted AS (SELECT doc_id, replace(replace(t, chr(1), '<redacted:'), chr(2), '>') AS t, regexp_extract_all(t, chr(1) || '([a-z_]+)' || chr(2), 1) AS kinds FROM whole)"""
_FIT = "regr_slope(value, x) AS slope, regr_intercept(value, x) AS base, count(*) AS n, regr_syy(value, x) AS syy, regr_sxy(value, x) AS sxy, regr_sxx(value, x) AS sxx"
_LINE_BAND = "round(greatest(0, (base + slope * (n - 1 + step))), 4) AS predicted, round(greatest(0, (base + slope * (n - 1 + step)) - 1.96::DOUBLE * CASE WHEN n > 2 THEN sqrt(greatest(0, syy - sxy * sxy / sxx) / (n - 2)) ELSE 0 END), 4) AS lower, round(greatest(0, (base + slope * (n - 1 + step)) + 1.96::DOUBLE * CASE WHEN n > 2 THEN sqrt(greatest(0, syy - sxy * sxy / sxx) / (n - 2)) ELSE 0 END), 4) AS upper"
_HOLT_BAND = "round(greatest(0, (l + step * t)), 4) AS predicted, round(greatest(0, (l + step * t) - 1.96::DOUBLE * sqrt(step::DOUBLE) * CASE WHEN n > 2 THEN sqrt(ss / (n - 2)) ELSE 0 END), 4) AS lower, round(greatest(0, (l + step * t) + 1.96::DOUBLE * sqrt(step::DOUBLE) * CASE WHEN n > 2 THEN sqrt(ss / (n - 2)) ELSE 0 END), 4) AS upper"
_HOLT = """h AS (
  SELECT provider, i, n, value AS l, nxt - value AS t, 0::DOUBLE AS ss FROM x WHERE i = 1 AND n >= 2
  UNION ALL
  SELECT h.provider, x.i, h.n, 0.6::DOUBLE * x.value + 0.4::DOUBLE * (h.l + h.t), 0.3::DOUBLE * (0.6::DOUBLE * x.value + 0.4::DOUBLE * (h.l + h.t) - h.l) + 0.7::DOUBLE * h.t,
    h.ss + (x.value - h.l - h.t) * (x.value - h.l - h.t)
  FROM h JOIN x ON x.provider = h.provider AND x.i = h.i + 1)"""
_X = "x AS (SELECT provider, value, row_number() OVER (PARTITION BY provider ORDER BY moment) AS i, lead(value) OVER (PARTITION BY provider ORDER BY moment) AS nxt, count(*) OVER (PARTITION BY provider) AS n FROM {})"
def template_values() -> str:
    """The samples' lines as rows of a VALUES list (command, nr, mark, line)."""
    return ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x) for x in t) + ")" for t in tool_samples.templates())


def _outputs_sql(commands: list[str]) -> str:
    return f"""t(command, nr, mark, line) AS (VALUES {template_values()}),
p AS (SELECT p_partkey, ({commands})[p_partkey % {len(commands)} + 1] AS command, lower(replace(p_brand, '#', '')) AS w, p_size % 5 + 3 AS k FROM part),
f AS (SELECT p_partkey, command, k, nr, mark, replace(replace(replace(replace(line, '{{w}}', w), '{{k}}', k::VARCHAR), '{{k1}}', (k + 1)::VARCHAR), '{{k2}}', (2 * k)::VARCHAR) AS line FROM p JOIN t USING (command)),
x AS (SELECT p_partkey, command, nr, mark, i, replace(line, '{{i}}', i::VARCHAR) AS line FROM (SELECT *, unnest(CASE WHEN contains(line, '{{i}}') THEN range(1, k + 1) ELSE [1] END) AS i FROM f))"""


_TEXT_OUT = "length(t)::INTEGER AS length, md5(t) AS digest"
ORACLE_SQL = {
    "spend_hourly_by_model": f"WITH {_PRICED} SELECT date_trunc('hour', ts) AS bucket, model, {_SUMS} FROM priced GROUP BY ALL",
    "spend_daily_by_provider": f"WITH {_PRICED} SELECT date_trunc('day', ts)::TIMESTAMP AS bucket, provider, {_SUMS} FROM priced GROUP BY ALL",
    "spend_summary": f"WITH {_PRICED} SELECT {_SUMS}, coalesce(sum(list_price::DECIMAL(18,9))::DOUBLE, 0) AS api_value_usd FROM priced",
    "unpriced_models": f"WITH {_PRICED} SELECT provider, model, count(*) AS requests FROM priced WHERE cost_source = 'metered' AND coalesce(cost_usd, 0) <= 0 AND list_price IS NULL GROUP BY ALL",
    "plan_covered_value": f"WITH {_PRICED} SELECT provider, cost_source, count(*) AS requests, coalesce(sum(list_price::DECIMAL(18,9))::DOUBLE, 0) AS shadow_usd FROM priced WHERE cost_source <> 'metered' GROUP BY ALL",
    "cache_stats": f"WITH {_USAGE}, s AS (SELECT provider, sum(input_tokens)::BIGINT AS total, sum(cached_input_tokens)::BIGINT AS cached FROM usage GROUP BY ALL) SELECT provider, total, cached, greatest(total - cached, 0) AS uncached, round(CASE WHEN total > 0 THEN cached::DOUBLE / total ELSE 0 END, 6) AS ratio FROM s",
    "top_consumers": f"WITH {_PRICED} SELECT workflow_id, sum(cost::DECIMAL(18,9))::DOUBLE AS cost_usd, sum(input_tokens + output_tokens)::BIGINT AS tokens FROM priced GROUP BY ALL ORDER BY cost_usd DESC, tokens DESC, workflow_id LIMIT 10",
    "burn_rate_24h": f"WITH {_PRICED} SELECT date_trunc('hour', ts) AS bucket, {_SUMS} FROM priced WHERE ts >= {_NOW} - INTERVAL 24 HOUR AND ts < {_NOW} GROUP BY ALL",
    "source_counts": f"WITH {_USAGE} SELECT coalesce(nullif(source, ''), '(none)') AS source, count(*) AS events FROM everything GROUP BY ALL",
    "plan_consumption": f"WITH {_USAGE} SELECT provider, sum(CASE WHEN ts >= date_trunc('month', {_NOW}) THEN input_tokens + output_tokens ELSE 0 END)::BIGINT AS month_tokens, sum(CASE WHEN ts >= {_NOW} - INTERVAL 7 DAY THEN input_tokens + output_tokens ELSE 0 END)::BIGINT AS week_tokens, count(*) FILTER (ts >= {_NOW} - INTERVAL 7 DAY) AS week_messages FROM usage WHERE cost_source = 'plan_included' AND ts <= {_NOW} GROUP BY ALL",
    "budget_alerts": f"WITH {_PRICED}, s AS (SELECT date_trunc('day', ts)::TIMESTAMP AS bucket, provider, sum(cost::DECIMAL(18,9))::DOUBLE AS cost_usd FROM priced GROUP BY ALL) SELECT bucket, provider, cost_usd, cost_usd / 2 AS used, CASE WHEN cost_usd / 2 >= 1 THEN 'exceeded' WHEN cost_usd / 2 >= 0.95 THEN 'critical' WHEN cost_usd / 2 >= 0.75 THEN 'warning' ELSE 'ok' END AS level FROM s",
    "retention_plan": f"WITH {_USAGE} SELECT cost_source, count(*) AS to_delete FROM usage WHERE ts < {_NOW} - to_days(CASE cost_source WHEN 'trial' THEN 5 WHEN 'metered' THEN 20 ELSE 10 END) GROUP BY ALL",
    "rate_overrides": f"WITH {_PARTS} SELECT coalesce(o.provider, n.provider) AS provider, coalesce(o.pattern, n.pattern) AS pattern, coalesce(nullif(n.input_rate, 0), o.input_rate, 0) AS input_rate, coalesce(nullif(n.output_rate, 0), o.output_rate, 0) AS output_rate, coalesce(nullif(n.cached_rate, 0), o.cached_rate, 0) AS cached_rate FROM old o FULL JOIN new n ON o.provider = n.provider AND o.pattern = n.pattern",
    "rate_diff": f"WITH {_PARTS} SELECT coalesce(o.provider, n.provider) AS provider, coalesce(o.pattern, n.pattern) AS pattern, CASE WHEN o.provider IS NULL THEN 'added' WHEN n.provider IS NULL THEN 'removed' ELSE 'modified' END AS change, round(coalesce(n.input_rate, 0) - coalesce(o.input_rate, 0), 6) AS d_input_rate, round(coalesce(n.output_rate, 0) - coalesce(o.output_rate, 0), 6) AS d_output_rate, round(coalesce(n.cached_rate, 0) - coalesce(o.cached_rate, 0), 6) AS d_cached_rate FROM old o FULL JOIN new n ON o.provider = n.provider AND o.pattern = n.pattern WHERE o.provider IS NULL OR n.provider IS NULL OR o.input_rate <> n.input_rate OR o.output_rate <> n.output_rate OR o.cached_rate <> n.cached_rate",
    "cheapest_model": f"WITH {_PARTS} SELECT provider, arg_min(pattern, (input_rate + output_rate, pattern)) AS pattern, min(input_rate + output_rate) AS total FROM new GROUP BY ALL",
    "anomaly_rolling": f"WITH {_DAILY}, w AS (SELECT *, count(value) OVER f AS n, avg(value) OVER f AS mean, coalesce(stddev_samp(value) OVER f, 0) AS sd FROM daily WINDOW f AS (PARTITION BY provider ORDER BY moment ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)), z AS (SELECT *, CASE WHEN sd > 0 THEN (value - mean) / sd ELSE 0 END AS z FROM w WHERE n >= 4) SELECT provider, moment AS \"at\", value, round(mean, 6) AS mean, round(z, 6) AS z, {_LEVEL} FROM z WHERE CASE WHEN sd > 0 THEN z >= 1.5 ELSE value > mean * 1.5 OR value < mean * 0.5 END",
    "anomaly_fixed": f"WITH {_DAILY}, z AS (SELECT *, (value - avg(value) OVER (PARTITION BY provider)) / nullif(stddev_samp(value) OVER (PARTITION BY provider), 0) AS z FROM daily) SELECT provider, moment AS \"at\", value, round(z, 6) AS z, {_LEVEL} FROM z WHERE z >= 1.5",
    "forecast_linear": f"WITH {_DAILY}, x AS (SELECT provider, value, row_number() OVER (PARTITION BY provider ORDER BY moment) - 1 AS x FROM daily), f AS (SELECT provider, {_FIT} FROM x GROUP BY ALL) SELECT provider, step::INTEGER AS step, {_LINE_BAND} FROM f, range(1, 4) r(step) WHERE n >= 2",
    "forecast_holt": f"WITH RECURSIVE {_DAILY}, {_X.format('daily')}, {_HOLT} SELECT provider, step::INTEGER AS step, {_HOLT_BAND} FROM h, range(1, 4) r(step) WHERE i = n",
    "workflow_steps": f"WITH {_USAGE} SELECT workflow_id, event_id, row_number() {_ORDER} AS step, input_tokens - lag(input_tokens) {_ORDER} AS growth, date_sub('second', lag(ts) {_ORDER}, ts) AS gap_s FROM usage",
    "workflow_summary": f"WITH {_PRICED}, g AS (SELECT *, greatest(input_tokens - lag(input_tokens) {_ORDER}, 0) AS grown FROM priced) SELECT workflow_id, count(*) AS steps, sum(input_tokens)::BIGINT AS input_tokens, max(input_tokens) AS max_context, sum(cost::DECIMAL(18,9))::DOUBLE AS cost_usd, count(DISTINCT model) AS models, count(DISTINCT agent_id) AS agents, coalesce(sum(grown), 0)::BIGINT AS growth, coalesce(sum(output_tokens), 0)::BIGINT AS output_tokens, date_sub('second', min(ts), max(ts)) AS seconds FROM g GROUP BY ALL",
    "agent_longest_run": f"WITH {_USAGE}, i AS (SELECT workflow_id, agent_id, row_number() {_ORDER} AS i, row_number() {_ORDER} - row_number() OVER (PARTITION BY workflow_id, agent_id ORDER BY ts, event_id) AS island FROM usage), r AS (SELECT workflow_id, agent_id, island, count(*) AS run, min(i) AS first FROM i WHERE agent_id IS NOT NULL GROUP BY ALL) SELECT workflow_id, agent_id, run FROM r QUALIFY row_number() OVER (PARTITION BY workflow_id ORDER BY run DESC, first) = 1",
    "prompt_repeat": f"WITH {_USAGE}, p AS (SELECT workflow_id, prompt_hash, row_number() {_ORDER} AS step, lag(prompt_hash) {_ORDER} AS before FROM usage) SELECT workflow_id, min(step) AS step, arg_min(prompt_hash, step) AS prompt_hash FROM p WHERE before = prompt_hash GROUP BY ALL",
    "scorecard_upper_median": f"WITH {_USAGE}, r AS (SELECT provider, input_tokens, row_number() OVER (PARTITION BY provider ORDER BY input_tokens) AS nr, count(*) OVER (PARTITION BY provider) AS n FROM usage WHERE input_tokens IS NOT NULL) SELECT provider, input_tokens AS upper_median FROM r WHERE nr = n // 2 + 1",
    "latest_cost": f"WITH {_USAGE} SELECT workflow_id, ts, cost_usd FROM usage WHERE cost_usd IS NOT NULL QUALIFY row_number() OVER (PARTITION BY workflow_id ORDER BY ts DESC, event_id) = 1",
    "token_estimate": "WITH p AS (SELECT conv_id, text, length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) AS plain FROM conversations) SELECT conv_id, sum(ceil(plain / 4.0::DOUBLE + (length(text) - plain) / 1.5::DOUBLE) + 4)::BIGINT AS tokens FROM p GROUP BY ALL",
    "prompt_compress": "WITH c AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(text, '‘’“”—–' || chr(160), '''''\"\"-- '), '(?s)<!--.*?-->', '', 'g'), '(?m)[ \\t]+$', '', 'g'), '[ \\t]{2,}', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g') AS t FROM documents), " + _lines_kept("c", f"trim(x, {_BLANKS}) <> '' AND trim(x, {_BLANKS}) = trim(y, {_BLANKS})") + f" SELECT doc_id, {_TEXT_OUT} FROM kept",
    "chunk_prune": "WITH d AS (SELECT doc_id, CASE doc_id % 3 WHEN 1 THEN replace(text, '. ', '.' || chr(10) || '---' || chr(10)) WHEN 2 THEN '1. ' || replace(text, '. ', '.' || chr(10) || '2. ') ELSE text END AS t FROM documents), n AS (SELECT doc_id, t, string_split(regexp_replace(t, '(?m)^((?:\\d+\\.\\s|\\[\\d+\\]\\s))', chr(1) || '\\1', 'g'), chr(1))[2:] AS headed FROM d), c AS (SELECT doc_id, t, CASE WHEN regexp_matches(t, '(?m)^(?:-{3,}|={3,})\\s*$') THEN list_filter(list_transform(string_split_regex(t, '(?m)^(?:-{3,}|={3,})\\s*$'), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda x: x <> '') WHEN len(headed) > 1 THEN list_transform(headed, lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) ELSE [] END AS c FROM n), p AS (SELECT doc_id, CASE WHEN len(c) >= 8 THEN array_to_string(c[1:4], chr(10) || '---' || chr(10)) ELSE t END AS t FROM c) SELECT doc_id, " + _TEXT_OUT + " FROM p",
    "noise_scrub": "WITH c AS (SELECT doc_id, regexp_replace(regexp_replace(text, '\\x1b\\[[0-9;?]*[ -/]*[@-~]', '', 'g'), '(?m)[ \\t\\r]+$', '', 'g') AS t FROM documents), " + _lines_kept("c", "x = y") + ", e AS (SELECT doc_id, trim(t, chr(10)) AS t FROM kept) SELECT doc_id, " + _TEXT_OUT + " FROM e",
    "redact_text": f"WITH {_REDACTED} SELECT doc_id, {_TEXT_OUT} FROM redacted",
    "redaction_counts": f"WITH {_REDACTED} SELECT kind, count(*) AS findings FROM (SELECT unnest(kinds) AS kind FROM redacted) GROUP BY kind",
    "rule_duplicates": "SELECT 'sha256:' || sha256(text) AS hash, count(*) AS copies, min(doc_id) AS first FROM documents GROUP BY sha256(text) HAVING count(*) >= 2",
    "context_trim": "WITH a AS (SELECT conv_id, turn, role, coalesce(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS later FROM conversations) SELECT conv_id, turn, role FROM a WHERE role = 'system' OR later < 2",
    "tool_output_reduce": f"""WITH {_outputs_sql([*tool_samples.SAMPLES])},
b AS (SELECT p_partkey, sum(strlen(line) + 1)::INTEGER - 1 AS bytes_before FROM x WHERE mark IN ('!', '.', '-', '~') GROUP BY p_partkey),
o AS (SELECT p_partkey, command, level, string_agg(line, chr(10) ORDER BY nr, i) AS text FROM x, (VALUES ('balanced', '!.~='), ('aggressive', '!.+=')) v(level, marks) WHERE contains(marks, mark) GROUP BY ALL),
c AS (SELECT x.p_partkey, o.level, bool_and(contains(chr(10) || o.text || chr(10), chr(10) || x.line || chr(10))) AS critical_kept FROM x JOIN o USING (p_partkey) WHERE x.mark = '!' GROUP BY ALL)
SELECT p_partkey, command, level, regexp_replace(trim(text, chr(10)), '\\x1b\\[[0-9;]*m', '', 'g') AS text, coalesce(critical_kept, true) AS critical_kept, bytes_before FROM o LEFT JOIN c USING (p_partkey, level) JOIN b USING (p_partkey)""",
    "tool_output_sniffed": f"WITH {_outputs_sql(tool_samples.SNIFFED)} SELECT p_partkey, trim(string_agg(line, chr(10) ORDER BY nr, i), chr(10)) AS text FROM x WHERE mark IN ('!', '.', '~', '=') GROUP BY p_partkey",
    "tool_output_rules": "WITH c AS (SELECT doc_id, text, regexp_replace(regexp_replace(text, '\\x1b\\[[0-9;?]*[ -/]*[@-~]', '', 'g'), '(?m)[ \\t\\r]+$', '', 'g') AS t FROM documents), "
    + _lines_kept("c", "x = y")
    + ", s AS (SELECT doc_id, string_split(trim(t, chr(10)), chr(10)) AS l FROM kept), f AS (SELECT doc_id, list_filter(l, lambda x: "
    + f"(trim(x, {_BLANKS}) <> '' AND regexp_matches(trim(x, {_BLANKS}), '{'|'.join(f'(?:{p})' for p in PROSE_RULES[0])}')) OR NOT regexp_matches(trim(x, {_BLANKS}), '{'|'.join(f'(?:{p})' for p in [*PROSE_RULES[1], *PROSE_RULES[2]])}')) AS l FROM s)"
    + f", o AS (SELECT doc_id, trim(array_to_string(l, chr(10)), {_BLANKS} || chr(10)) AS t FROM f) SELECT doc_id, {_TEXT_OUT} FROM o",
    "near_dup_messages": """WITH RECURSIVE n AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS nr FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT conv_id, turn + 1000, role, substr(text, 13) FROM conversations UNION ALL SELECT conv_id, turn + 2000, role, replace(substr(text, 13), ' d', ' ') FROM conversations)),
w AS (SELECT *, regexp_extract_all(lower(text), '[\\p{L}\\p{Nd}]+') AS w FROM n WHERE strlen(text) >= 200 AND role <> 'system'),
g AS (SELECT *, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) = 2 THEN [w[1], w[2], w[1] || ' ' || w[2]] ELSE w END) AS s FROM w WHERE len(w) > 0),
p AS (SELECT a.conv_id, a.role, a.nr AS early, b.nr AS late FROM g a JOIN g b ON a.conv_id = b.conv_id AND a.role = b.role AND a.nr < b.nr AND len(list_intersect(a.s, b.s)) >= 0.85::DOUBLE * (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s)))),
q AS (SELECT conv_id, role, late, list(early ORDER BY early) AS earlier FROM p GROUP BY ALL),
l AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY late) AS i FROM q),
f AS (
  SELECT conv_id, role, i, late, list_filter(earlier, lambda e: true)[1] AS head, [late] AS members FROM l WHERE i = 1
  UNION ALL
  SELECT l.conv_id, l.role, l.i, l.late, list_filter(l.earlier, lambda e: NOT list_contains(f.members, e))[1],
    CASE WHEN len(list_filter(l.earlier, lambda e: NOT list_contains(f.members, e))) > 0 THEN list_append(f.members, l.late) ELSE f.members END
  FROM f JOIN l ON l.conv_id = f.conv_id AND l.role = f.role AND l.i = f.i + 1)
SELECT f.conv_id, x.turn, h.turn AS head_turn, f.head::INTEGER AS head_nr, strlen(x.text)::INTEGER AS dropped_bytes
FROM f JOIN n x ON x.conv_id = f.conv_id AND x.nr = f.late JOIN n h ON h.conv_id = f.conv_id AND h.nr = f.head WHERE f.head IS NOT NULL""",
}
