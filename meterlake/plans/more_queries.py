"""Queries of quotas, prompts, tools, logs, rules, evaluations and the ledger, and the SQL each is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pricing
from ..functions.tables import written
from ..operators import bodies, coach, order, quality, quotas, rulebook, series, talk, text, token_count
from ..sources import ledger, logs
from ..sources.usage import usage_events, without_sources
from . import tool_samples
from .queries import _CARD, _NOW, _PARTS, _PRICED, _USAGE, NOW, PROVIDERS, _card, _priced, _read, _usage, sample_lines, template_values, tool_samples_text

_K = "json_extract(props, '$.k')"


def _values(rows: list[tuple]) -> str:
    one = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else "NULL" if x is None else f"{x}::DOUBLE" if isinstance(x, float) else str(x)
    return ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


# ---- quotas

PLANS = [("openai", 40, 86400), ("anthropic", 90, 86400), ("gemini", 20, 86400), ("mistral", 0, 86400), ("cohere", 900, 86400)]


def _with_attributes(spark: SparkSession, d: str) -> DataFrame:
    """Usage events that at times carry a quota report, or aren't one message each."""
    k = F.col("k").cast("string")
    report = F.when(F.col("provider") == "anthropic", F.create_map(F.lit("five_hour_used_pct"), k, F.lit("five_hour_reset_at"), F.lit("2024-01-25T13:30:00Z"))).when(F.col("provider") == "openai", F.create_map(F.lit("primary_used_pct"), F.concat(k, F.lit("x"))))
    none = F.create_map().cast("map<string,string>")
    own = F.when(F.col("k") % 7 == 0, F.coalesce(report, none)).when(F.col("k") % 5 == 0, F.create_map(F.lit("granularity"), F.lit("assistant_turn"))).otherwise(none)
    return _usage(spark, d).withColumn("attributes", own)


def _session_budget(spark: SparkSession, d: str) -> DataFrame:
    events = _with_attributes(spark, d)
    plans = spark.createDataFrame(PLANS, "provider string, cap long, window_s long")
    return quotas.session_budget(plans, quotas.window_use(events, NOW, 24), quotas.window_use(events, NOW, 3), quotas.reported(events, NOW, 24), 3.0)


_ATTRIBUTED = f"""{_USAGE},
a AS (SELECT *, CASE WHEN k % 7 = 0 AND provider = 'anthropic' THEN k::VARCHAR END AS pct, k % 7 <> 0 AND k % 5 = 0 AS turn FROM usage),
w AS (SELECT * FROM a WHERE cost_source = 'plan_included' AND ts <= {_NOW})"""
_REPORTED = f"v AS (SELECT provider, arg_max(pct::DOUBLE, (ts, -event_id)) AS used FROM a WHERE pct IS NOT NULL AND ts <= {_NOW} AND ts >= {_NOW} - INTERVAL 48 HOUR GROUP BY ALL)"
_BUDGET_SQL = f"""WITH {_ATTRIBUTED}, {_REPORTED},
plans(provider, cap, window_s) AS (VALUES {_values(PLANS)}),
u AS (SELECT provider, count(*) FILTER (NOT turn) AS sent, count(*) FILTER (NOT turn AND ts >= {_NOW} - INTERVAL 3 HOUR) AS lately FROM w WHERE ts >= {_NOW} - INTERVAL 24 HOUR GROUP BY ALL),
j AS (SELECT p.*, coalesce(sent, 0) AS sent, coalesce(lately, 0) AS lately, used FROM plans p LEFT JOIN u USING (provider) LEFT JOIN v USING (provider)),
m AS (SELECT *, CASE WHEN used IS NOT NULL THEN round(used * 100) / 100 WHEN cap > 0 THEN round(sent::DOUBLE / cap * 10000) / 100 END AS window_pct,
  CASE WHEN cap > 0 THEN CASE WHEN used IS NOT NULL THEN round(cap * (100 - used) / 100)::BIGINT ELSE greatest(cap - sent, 0) END END AS headroom,
  CASE WHEN used IS NULL AND cap > 0 AND lately > 0 THEN round(lately / 3::DOUBLE * 10) / 10 END AS rate_per_hour FROM j)
SELECT provider, window_pct, headroom::BIGINT AS headroom, rate_per_hour,
  CASE WHEN rate_per_hour IS NULL THEN NULL WHEN headroom = 0 THEN 0 ELSE trunc(headroom / rate_per_hour * 3600)::BIGINT END AS cap_in_s,
  CASE WHEN used IS NOT NULL THEN date_diff('second', {_NOW}, TIMESTAMP '2024-01-25 13:30:00') ELSE window_s END AS resets_in_s,
  CASE WHEN used IS NOT NULL THEN 'high' WHEN rate_per_hour IS NULL THEN 'low' WHEN lately >= 5 THEN 'high' ELSE 'medium' END AS confidence,
  CASE WHEN used IS NOT NULL THEN CASE WHEN used >= 95 THEN 'wait_reset' WHEN used >= 80 THEN 'slow_down' WHEN used >= 60 THEN 'switch_model' ELSE 'continue' END
    WHEN cap = 0 THEN 'unknown' WHEN rate_per_hour IS NULL THEN CASE WHEN window_pct >= 80 THEN 'slow_down' ELSE 'continue' END
    WHEN headroom <= 0 OR window_pct >= 95 OR (window_pct >= 80 AND headroom / rate_per_hour < 1) THEN 'wait_reset' WHEN window_pct >= 80 THEN 'slow_down'
    WHEN window_pct >= 60 AND headroom / rate_per_hour < 1.5 THEN 'switch_model' ELSE 'continue' END AS action FROM m"""

SEEN = ["vendor_api", "cookie", "jsonl", "codex", "copilot", "cursor", "proxy", "pings", "cache"]


def _signals(spark: SparkSession, d: str) -> DataFrame:
    """Observations of each workflow and day: counted by k."""
    day = _usage(spark, d).groupBy("workflow_id", F.to_date("ts").alias("day"))
    return quotas.signal_quality(day.agg(*[F.count_if(F.col("k") % 23 == i).alias(c) for i, c in enumerate(SEEN)]))


_SIGNAL_SQL = f"""WITH {_USAGE}, n AS (SELECT workflow_id, ts::DATE AS day, {", ".join(f"count(*) FILTER (k % 23 = {i}) AS {c}" for i, c in enumerate(SEEN))} FROM usage GROUP BY ALL)
SELECT *, CASE WHEN vendor_api + cookie + jsonl + codex + copilot + cursor > 0 OR (proxy > 0 AND proxy >= pings) THEN 'high' WHEN proxy > 0 OR cache > 0 THEN 'medium' ELSE 'low' END AS level,
  CASE WHEN vendor_api > 0 THEN 'vendor_usage_api' WHEN cookie > 0 THEN 'anthropic_cookie' WHEN jsonl > 0 THEN 'claude_code_jsonl' WHEN codex > 0 THEN 'codex_jsonl' WHEN copilot > 0 THEN 'github_copilot' WHEN cursor > 0 THEN 'cursor_web'
    WHEN proxy > 0 THEN 'proxy_traffic' WHEN cache > 0 THEN 'claude_code_stats_cache' ELSE 'mcp_tool_pings' END AS source FROM n"""

# ---- prices

#: What stands before and behind a stem in a foreign catalogue.
VENDOR, ENDS = ["", "openai/", "anthropic/"], ["", "-latest", "-20240501", "-2405", "-240101", "-mini", "-20240301", "0"]


def _catalogue(spark: SparkSession, d: str) -> DataFrame:
    """Parts as a foreign catalogue's entries, suppliers as our own keys."""
    key, size = F.col("p_partkey"), F.col("p_size")
    of = lambda values, i: F.get(F.array(*map(F.lit, values)), i.cast("int"))
    stem = lambda n: F.concat(F.lit("gpt-"), n.cast("string"))
    million = lambda x: x / F.lit(1e6)
    entries = _read(spark, d, "part").select(
        of([*PROVIDERS, "nobody"], key % 5).alias("provider"),
        F.concat(of(VENDOR, size % 3), stem(key % 40), of(ENDS, size % 8)).alias("id"),
        million(F.when(size % 11 == 0, 0.0).otherwise(key % 90 + 1.0)).alias("input_cost"),
        million(F.when(size % 11 == 0, 0.0).otherwise(size * 2.0)).alias("output_cost"),
        F.when(size % 2 == 0, million(size / 2.0)).alias("cached_cost"),
    )
    keys = _read(spark, d, "supplier").select(of(PROVIDERS, F.col("s_suppkey") % 4).alias("provider"), stem(F.col("s_suppkey") % 30).alias("key")).distinct()
    # one of several entries with one id is as good as another, so those with the smallest rates are taken
    entries = entries.groupBy("provider", "id").agg(F.min("input_cost").alias("input_cost"), F.min("output_cost").alias("output_cost"), F.min("cached_cost").alias("cached_cost"))
    return pricing.catalogue_rates(entries, keys)


_CATALOGUE_SQL = f"""WITH g AS (SELECT ({[*PROVIDERS, "nobody"]})[p_partkey % 5 + 1] AS provider, ({VENDOR})[p_size % 3 + 1] || 'gpt-' || (p_partkey % 40) || ({ENDS})[p_size % 8 + 1] AS id,
  CASE WHEN p_size % 11 = 0 THEN 0 ELSE p_partkey % 90 + 1 END / 1e6::DOUBLE AS i, CASE WHEN p_size % 11 = 0 THEN 0 ELSE p_size * 2 END / 1e6::DOUBLE AS o, CASE WHEN p_size % 2 = 0 THEN p_size / 2.0::DOUBLE / 1e6::DOUBLE END AS c FROM part),
e AS (SELECT provider, id, min(i) AS i, min(o) AS o, min(c) AS c FROM g GROUP BY ALL),
keys AS (SELECT DISTINCT ({PROVIDERS})[s_suppkey % 4 + 1] AS provider, 'gpt-' || (s_suppkey % 30) AS key FROM supplier),
s AS (SELECT *, CASE WHEN contains(id, '/') THEN regexp_replace(id, '^[^/]*/', '') ELSE id END AS stem FROM e WHERE provider IN (SELECT provider FROM keys) AND (i <> 0 OR o <> 0)),
k AS (SELECT s.*, key FROM s LEFT JOIN keys USING (provider) WHERE starts_with(stem, key) AND (stem = key OR (stem[len(key) + 1] = '-' AND NOT list_contains({pricing.TIERS}, split_part(stem[len(key) + 1:], '-', 2))))),
b AS (SELECT provider, id, arg_max(key, len(key)) AS key FROM k GROUP BY ALL),
p AS (SELECT s.*, coalesce(b.key, regexp_replace(regexp_replace(stem, '-latest$', ''), '-\\d{{6,8}}$', '')) AS pattern, regexp_extract(stem, '-(\\d{{4,8}})$', 1) AS digits FROM s LEFT JOIN b USING (provider, id)),
r AS (SELECT *, CASE WHEN digits <> '' AND (len(digits) <> 4 OR regexp_matches(digits, '^2[0-9](0[1-9]|1[0-2])$')) THEN digits::INTEGER END AS date FROM p)
SELECT provider, pattern, id, round(i * 1e6, 6) AS input_rate, round(o * 1e6, 6) AS output_rate, round(coalesce(c, 0) * 1e6, 6) AS cached_rate FROM r
QUALIFY row_number() OVER (PARTITION BY provider, pattern ORDER BY CASE WHEN date IS NOT NULL THEN 3 WHEN ends_with(stem, '-latest') THEN 2 ELSE 1 END DESC, coalesce(date, 0) DESC, id) = 1"""
_GUARD_SQL = f"""WITH {_PARTS}, r AS (SELECT * FROM new WHERE input_rate > 0)
SELECT provider, pattern, 'cached_above_input' AS field, input_rate, cached_rate AS got, input_rate AS expected FROM r WHERE cached_rate > input_rate
UNION ALL SELECT provider, pattern, 'output', input_rate, output_rate, round(input_rate * 5, 9) FROM r WHERE provider = 'anthropic' AND output_rate > 0 AND output_rate / input_rate NOT BETWEEN 3 AND 7
UNION ALL SELECT provider, pattern, 'cached', input_rate, cached_rate, round(input_rate * 0.1, 9) FROM r WHERE provider = 'anthropic' AND cached_rate > 0 AND cached_rate / input_rate NOT BETWEEN 0.05 AND 0.15"""

# ---- prompts and replies

SHORT = ["yes", "fix it", " Do it ", "try again please", "what is src/main.go doing?", "continue", "that is wrong", "go", "commit and push", "make the tests of the parser pass now", "why?"]


def _prompts(spark: SparkSession, d: str) -> DataFrame:
    """What users wrote, half of it in short phrases."""
    number = F.col("conv_id") * 7 + F.col("turn")
    phrase = F.get(F.array(*map(F.lit, SHORT)), (number % 22).cast("int"))
    return _read(spark, d, "conversations").filter("role = 'user'").select(F.coalesce(phrase, F.col("text")).alias("text"))


_PROMPTS = f"""f AS (SELECT regexp_replace(coalesce(([{", ".join("'" + x + "'" for x in SHORT)}])[(conv_id * 7 + turn) % 22 + 1], text), '^\\s+|\\s+$', '', 'g') AS text FROM conversations WHERE role = 'user'),
p AS (SELECT text, lower(text) AS low, strlen(text) AS b, CASE WHEN text = '' THEN 0 ELSE len(string_split_regex(text, '\\s+')) END AS w FROM f)"""
_IN = lambda words: "(" + ", ".join(f"'{x}'" for x in words) + ")"
_FINDINGS = f"""{_PROMPTS},
found AS (SELECT count(*) AS prompts, count(*) FILTER (w < 5) AS under_5_words, count(*) FILTER (w >= 5 AND w < 15) AS under_15_words, count(*) FILTER (w >= 15 AND w < 50) AS under_50_words, count(*) FILTER (w >= 50 AND w < 200) AS under_200_words,
  count(*) FILTER (w >= 200) AS longer, count(*) FILTER (low IN {_IN(talk.ACKS)}) AS acks, count(*) FILTER (low IN {_IN(talk.VAGUE)}) AS vague, count(*) FILTER (b < 15 AND w <= 3) AS vague_short,
  count(*) FILTER (b < 60 AND contains(text, '?')) AS short_questions, count(*) FILTER (regexp_matches(text, '{talk.REGENERATE.replace("'", "''")}')) AS regenerates, count(*) FILTER (b > 5 AND b < 30 AND NOT regexp_matches(text, '[.,:;()]')) AS no_context,
  count(*) FILTER (w >= 3 AND w <= 20 AND NOT ({" OR ".join(f"contains(text, '{m}')" for m in talk.FILE_MARKS)})) AS no_file, min(b)::INTEGER AS min_bytes, max(b)::INTEGER AS max_bytes, round(avg(b), 6) AS mean_bytes, round(avg(w), 6) AS mean_words FROM p)"""
_REPEATED = "repeats AS (SELECT low AS text, count(*) AS times FROM p WHERE b > 5 GROUP BY low HAVING count(*) >= 3 ORDER BY times DESC, text LIMIT 10)"
_ADVICE = f"""{_FINDINGS}, {_REPEATED},
n AS (SELECT *, (SELECT coalesce(sum(times - 1), 0) FROM repeats) AS wasted, greatest(acks - floor(0.1::DOUBLE * prompts), 0) AS extra FROM found),
found_some AS (
  SELECT 'scope_vague_directives' AS id, vague AS frequency, vague * 3.0 AS impact, vague * 3 AS turns_saved FROM n WHERE vague > 0
  UNION ALL SELECT 'reduce_confirmation_loops', acks, extra, extra FROM n WHERE prompts > 0 AND acks / prompts::DOUBLE > 0.15
  UNION ALL SELECT 'stop_repeating', wasted, wasted * 1.5, wasted FROM n WHERE wasted > 0
  UNION ALL SELECT 'cite_file_paths', no_file, no_file * 0.3, no_file // 4 FROM n WHERE prompts >= 20 AND no_file / prompts::DOUBLE > 0.3),
advice AS (SELECT id, frequency::BIGINT AS frequency, round(impact::DOUBLE, 6) AS impact, turns_saved::BIGINT AS turns_saved FROM found_some)"""
_TURNS = f"""{_PRICED}, t AS (SELECT model, count(*) AS turns, sum(input_tokens)::DOUBLE AS i, sum(cached_input_tokens)::DOUBLE AS c, sum(output_tokens)::DOUBLE AS o, sum(list_price::DECIMAL(18,9))::DOUBLE AS cost FROM priced WHERE coalesce(input_tokens, 0) > 0 OR coalesce(output_tokens, 0) > 0 GROUP BY ROLLUP (model)),
turn_stats AS (SELECT model, turns, round(coalesce(i, 0) / turns, 6) AS mean_input, round(coalesce(c, 0) / turns, 6) AS mean_cached, round(coalesce(o, 0) / turns, 6) AS mean_output, round(coalesce(cost, 0) / turns, 6) AS mean_cost_usd FROM t WHERE turns > 0)"""


def _advice(spark: SparkSession, d: str) -> DataFrame:
    prompts = _prompts(spark, d)
    return talk.recommendations(talk.prompt_findings(prompts), talk.repeated_prompts(prompts))


def _replies(spark: SparkSession, d: str) -> DataFrame:
    """Replies of which some have fillers, articles and code."""
    more = F.when(F.col("turn") % 4 == 1, F.lit(" just the ```code of a``` really an end")).when(F.col("turn") % 4 == 3, F.lit(" a ```b``` c ``` d")).otherwise("")
    return _read(spark, d, "conversations").withColumn("text", F.concat("text", more))


_REPLIES_SQL = f"""WITH r AS (SELECT conv_id, string_split(text || CASE turn % 4 WHEN 1 THEN ' just the ```code of a``` really an end' WHEN 3 THEN ' a ```b``` c ``` d' ELSE '' END, '```') AS parts FROM conversations WHERE role = 'assistant'),
w AS (SELECT conv_id, len(parts) > 1 AS code, list_transform(regexp_extract_all(array_to_string(list_filter(parts, lambda x, i: i % 2 = 1), ' '), '{talk.WORD.replace("'", "''")}'), lambda x: lower(x)) AS w FROM r),
c AS (SELECT conv_id, code, len(w) AS words, len(list_filter(w, lambda x: x IN {_IN(talk.ARTICLES)})) AS articles, len(list_filter(w, lambda x: x IN {_IN(talk.FILLERS)})) AS fillers, length(array_to_string(w, '')) AS letters FROM w),
s AS (SELECT conv_id, count(*) AS replies, sum(words)::BIGINT AS words, sum(articles)::DOUBLE AS a, sum(fillers)::DOUBLE AS f, sum(letters)::DOUBLE AS l, count(*) FILTER (code)::DOUBLE AS coded FROM c GROUP BY ROLLUP (conv_id)),
t AS (SELECT *, replies >= 3 AND words > 0 AND a / words < 0.025 AND f / words < 0.005 AS terse FROM s)
SELECT conv_id, replies, words, round(words::DOUBLE / replies, 6) AS mean_words, round(CASE WHEN words > 0 THEN l / words ELSE 0 END, 6) AS mean_word, round(CASE WHEN words > 0 THEN a / words ELSE 0 END, 6) AS article_share, round(CASE WHEN words > 0 THEN f / words ELSE 0 END, 6) AS filler_share,
  round(CASE WHEN words > 0 THEN coded / replies ELSE 0 END, 6) AS code_share, terse, CASE WHEN terse THEN floor(floor(words * 1.3::DOUBLE) * (0.15::DOUBLE / (1 - 0.15::DOUBLE)))::BIGINT ELSE 0 END AS saved_tokens FROM t"""

# ---- tools and session logs

COMMANDS = ["git status", "cd /a && rm -rf build", "sudo FOO=1 /usr/bin/pytest -q | tail", "git push --force", "export A=1; make all", "drop table x", "", "cd /a"]


def _blocks(spark: SparkSession, d: str, output=None) -> DataFrame:
    """Every usage event as a tool call, most with a result, some with prose. output: a function of k, for what the shell's results say."""
    e = _usage(spark, d).select("event_id", "ts", "k", F.col("workflow_id").alias("session"))
    k, own = F.col("k"), F.col("event_id").cast("string")
    name = F.when(k % 3 == 0, "Bash").when(k % 3 == 1, "Read").otherwise("Grep")
    command = F.when(name == "Bash", F.get(F.array(*map(F.lit, COMMANDS)), (k % 8).cast("int")))
    path = F.when(name == "Read", F.concat(F.lit("/a/f"), (k % 4).cast("string"), F.when(k % 2 == 0, ".PY").otherwise("")))
    said = F.repeat(F.concat(F.lit("line "), (k % 6).cast("string"), F.lit("\n")), (k % 9).cast("int"))
    said = F.when(k % 3 == 0, F.coalesce(output(k), said)).otherwise(said) if output else said
    kinds = {"id": "string", "kind": "string", "role": "string", "name": "string", "command": "string", "path": "string", "ranged": "boolean", "content": "string", "is_error": "boolean"}
    no = {"ranged": F.lit(False), "is_error": F.lit(False)}

    def block(**fields):
        return F.struct(*[(no | fields).get(c, F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()])

    parts = F.array(
        block(id=own, kind=F.lit("tool_use"), name=name, command=command, path=path, ranged=k % 5 == 0),
        F.when(k % 11 != 0, block(id=own, kind=F.lit("tool_result"), content=said, is_error=k % 9 == 1)),
        F.when(k % 13 == 0, block(id=F.concat(F.lit("o"), own), kind=F.lit("tool_result"), content=F.lit("lost"))),
        F.when(k % 4 == 0, block(id=own, kind=F.lit("text"), role=F.when(k % 8 == 0, "assistant").otherwise("user"), content=F.col("session"))),
    )
    return e.select("session", "ts", F.explode(F.array_compact(parts)).alias("b")).select("session", "ts", "b.*")


_BLOCKS = f"""{_USAGE},
e AS (SELECT event_id, ts, k, workflow_id AS session, CASE k % 3 WHEN 0 THEN 'Bash' WHEN 1 THEN 'Read' ELSE 'Grep' END AS name FROM usage),
results AS (
  SELECT session, ts, event_id::VARCHAR AS id, repeat('line ' || (k % 6) || chr(10), (k % 9)::INTEGER) AS content, name, CASE WHEN name = 'Bash' THEN (['git', 'rm', 'pytest', 'git', 'make', 'drop', '', ''])[k % 8 + 1] ELSE '' END AS command,
    CASE WHEN name = 'Read' THEN '/a/f' || (k % 4) || CASE WHEN k % 2 = 0 THEN '.PY' ELSE '' END ELSE '' END AS path, k % 5 = 0 AS ranged FROM e WHERE k % 11 <> 0
  UNION ALL SELECT session, ts, 'o' || event_id, 'lost', 'unknown', '', '', false FROM e WHERE k % 13 = 0),
r AS (SELECT *, strlen(content)::BIGINT AS bytes FROM results),
prose AS (SELECT ts, CASE WHEN k % 8 = 0 THEN 'assistant_prose' ELSE 'user_prose' END AS part, strlen(session)::BIGINT AS bytes FROM e WHERE k % 4 = 0),
reads AS (SELECT *, row_number() OVER (PARTITION BY session, path ORDER BY ts, id) AS nr, row_number() OVER (PARTITION BY content ORDER BY ts, session, id) AS again FROM r WHERE name = 'Read' AND bytes > 0)"""


SHELL = {0: "git", 2: "pytest", 3: "git", 4: "make"}  # by k modulo 8


def _shell_output(k):
    """What git, pytest and make print, with counts from k; null for other commands."""
    out = F.lit(None).cast("string")
    for at, command in SHELL.items():
        lines = F.array(*[F.lit(line) for c, _, mark, line in tool_samples.templates() if c == command and mark in "!.-~"])
        out = F.when(k % 8 == at, tool_samples_text(lines, F.lit("f"), k % 5 + 3)).otherwise(out)
    return out


def _shell_sizes(marks: str) -> str:
    return f"coalesce(sum(strlen(line) + 1) FILTER (contains('{marks}', mark)), 0)::BIGINT - 1"


_SHELL_SQL = f"""{_BLOCKS},
t(command, nr, mark, line) AS (VALUES {_values([t for t in tool_samples.templates() if t[0] in SHELL.values()])}),
runs AS (SELECT event_id, k, k % 5 + 3 AS n, (['git', 'rm', 'pytest', 'git', 'make', 'drop', 'unknown', 'unknown'])[k % 8 + 1] AS command FROM e WHERE name = 'Bash' AND k % 11 <> 0),
filled AS (SELECT event_id, runs.command, nr, mark, replace(replace(replace(replace(line, '{{w}}', 'f'), '{{k}}', n::VARCHAR), '{{k1}}', (n + 1)::VARCHAR), '{{k2}}', (2 * n)::VARCHAR) AS line, n FROM runs JOIN t ON t.command = runs.command),
repeated AS (SELECT event_id, command, mark, unnest(CASE WHEN contains(line, '{{i}}') THEN list_transform(range(1, n + 1), lambda i: replace(line, '{{i}}', i::VARCHAR)) ELSE [line] END) AS line FROM filled),
sizes AS (SELECT event_id, command, {_shell_sizes('!.-~')} AS raw, {_shell_sizes('!.~=')} AS balanced, {_shell_sizes('!.+=')} AS aggressive FROM repeated GROUP BY ALL
  UNION ALL SELECT event_id, command, (k % 9) * 7, 6, 6 FROM runs WHERE command NOT IN {tuple(sorted(set(SHELL.values())))} AND k % 9 > 0)
SELECT command, count(*) AS runs, sum(raw)::BIGINT AS raw_bytes, sum(raw - balanced)::BIGINT AS saved_balanced, sum(raw - aggressive)::BIGINT AS saved_aggressive FROM sizes GROUP BY command"""


def _timeline(spark: SparkSession, d: str) -> DataFrame:
    return talk.weekly_timeline(_blocks(spark, d), _usage(spark, d).select("ts", "input_tokens", "output_tokens"))


def _tool_events(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("kind") == "tool_use", "use").when(F.col("kind") == "tool_result", "result")
    return _blocks(spark, d).select("session", "ts", kind.alias("kind"), "id", "name", "command", "is_error").filter("kind is not null")


def _log_lines(spark: SparkSession, d: str) -> DataFrame:
    """conversations as lines of a session log: every third message's content as parts, some lines as tools leave them."""
    c = _read(spark, d, "conversations")
    parts = F.to_json(F.struct(F.lit("m").alias("x"), F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")), F.struct(F.lit("image").alias("type"), F.lit("i").alias("text")), F.struct(F.lit("text").alias("type"), F.lit("end").alias("text"))).alias("content")))
    plain = F.to_json(F.struct(F.col("text").alias("content")))
    message = F.when(F.col("turn") % 3 == 1, parts).when(F.col("turn") % 5 == 4, F.lit('{"content":"<tag> tool"}')).otherwise(plain)
    head = F.to_json(F.struct(F.initcap("role").alias("type"), F.col("conv_id").cast("string").alias("sessionId"), F.lit("2024-01-01T00:00:00Z").alias("timestamp")))
    whole = F.concat(F.expr("substring(h, 1, length(h) - 1)"), F.lit(',"message":'), F.col("m"), F.lit("}"))
    return c.withColumns({"h": head, "m": message}).select(whole.alias("value"))


def _logged(read):
    return lambda s, d: read(_log_lines(s, d)).groupBy("session").agg(F.count("*").alias("texts"), F.sum(F.length("text")).cast("long").alias("letters"))


def _logged_sql(role: str) -> str:
    text = "CASE WHEN turn % 3 = 1 THEN text || chr(10) || 'end' WHEN turn % 5 = 4 THEN '<tag> tool' ELSE text END"
    keep = "trim(t, ' ' || chr(9) || chr(10) || chr(13)) <> ''" + (" AND NOT starts_with(ltrim(t), '<') AND NOT contains(t, 'tool_use_id')" if role == "user" else "")
    return f"WITH x AS (SELECT conv_id::VARCHAR AS session, {text} AS t FROM conversations WHERE role = '{role}') SELECT session, count(*) AS texts, sum(length(t))::BIGINT AS letters FROM x WHERE {keep} GROUP BY session"


def _bodies(spark: SparkSession, d: str) -> DataFrame:
    """Each conversation as a request body."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    messages = F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))
    return _read(spark, d, "conversations").groupBy("conv_id").agg(F.to_json(F.struct(F.lit("m-1").alias("model"), F.lit(True).alias("stream"), F.lit(64).alias("max_tokens"), messages.alias("messages"))).alias("body")).withColumn("path", F.lit("/v1/chat"))


SHAPES = ["openai", "anthropic", "mistral"]


def _tool_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Each conversation as a request body in which the assistant's turns are results of tools, in one of three shapes."""
    esc = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t"))
    turn, conv = F.col("turn"), F.col("conv_id")
    result = esc(sample_lines(tool_samples.SNIFFED, conv * 3 + turn, F.lit("f"), turn % 5 + 3))
    inside = F.when(turn % 4 == 1, F.concat(F.lit('[{"type": "text", "text": "'), result, F.lit('"}]'))).otherwise(F.concat(F.lit('"'), result, F.lit('"')))
    block = F.concat(F.lit('{"content": [{"type": "tool_result", "content": '), inside, F.lit('}], "role": "user"}'))
    plain = F.concat(F.lit('{"role": "tool", "tool_call_id": "t'), turn.cast("string"), F.lit('", "content":  "'), result, F.lit('"}'))
    other = F.concat(F.lit('{"role": "'), F.col("role"), F.lit('", "content": "'), esc(F.coalesce("text", F.lit(""))), F.lit('"}'))
    message = F.when(F.col("role") != "assistant", other).when(conv % 3 == 1, block).otherwise(plain)
    rows = _read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", message.alias("m")))).alias("m"))
    body = F.concat(F.lit('{"model": "m-1",  "messages": ['), F.array_join(F.transform("m", lambda x: x["m"]), ", "), F.lit('], "max_tokens": 64}'))
    return rows.select("conv_id", F.get(F.array(*map(F.lit, SHAPES)), (conv % 3).cast("int")).alias("provider"), body.alias("body"))


def _rewritten_bodies(spark: SparkSession, d: str) -> DataFrame:
    out = bodies.rewritten(_tool_bodies(spark, d))
    return out.select("conv_id", F.md5(F.col("body").cast("binary")).alias("digest"), "bytes_before", "bytes_after", "saved_tokens")


_ESC = "replace(replace(replace(replace({}, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n'), chr(9), '\\t')"
_REWRITTEN_SQL = f"""WITH t(command, nr, mark, line) AS (VALUES {template_values()}),
c AS (SELECT conv_id, turn, role, text, ({tool_samples.SNIFFED})[(conv_id * 3 + turn) % {len(tool_samples.SNIFFED)} + 1] AS command, turn % 5 + 3 AS k FROM conversations),
f AS (SELECT conv_id, turn, nr, mark, k, replace(replace(replace(replace(line, '{{w}}', 'f'), '{{k}}', k::VARCHAR), '{{k1}}', (k + 1)::VARCHAR), '{{k2}}', (2 * k)::VARCHAR) AS line FROM c JOIN t USING (command) WHERE role = 'assistant'),
x AS (SELECT conv_id, turn, nr, mark, i, replace(line, '{{i}}', i::VARCHAR) AS line FROM (SELECT *, unnest(CASE WHEN contains(line, '{{i}}') THEN range(1, k + 1) ELSE [1] END) AS i FROM f)),
s AS (SELECT conv_id, turn, string_agg(line, chr(10) ORDER BY nr, i) FILTER (mark IN ('!', '.', '-', '~')) AS raw, trim(string_agg(line, chr(10) ORDER BY nr, i) FILTER (mark IN ('!', '.', '~', '=')), chr(10)) AS less FROM x GROUP BY ALL),
r AS (SELECT *, conv_id % 3 < 2 AND strlen(less) < strlen(raw) AS shorter FROM s),
shown AS (SELECT conv_id, turn, shorter, strlen(raw) AS before, strlen(less) AS after, {_ESC.format("raw")} AS a, CASE WHEN shorter THEN {_ESC.format("less")} ELSE {_ESC.format("raw")} END AS b FROM r),
m AS (SELECT c.conv_id, c.turn, shorter, before, after, unnest([1, 2]) AS version, CASE WHEN role <> 'assistant' THEN '{{"role": "' || role || '", "content": "' || {_ESC.format("coalesce(text, '')")} || '"}}'
  ELSE CASE WHEN c.conv_id % 3 = 1 THEN '{{"content": [{{"type": "tool_result", "content": ' || CASE WHEN c.turn % 4 = 1 THEN '[{{"type": "text", "text": "' ELSE '"' END ELSE '{{"role": "tool", "tool_call_id": "t' || c.turn || '", "content":  "' END || unnest([a, b])
    || CASE WHEN c.conv_id % 3 = 1 THEN CASE WHEN c.turn % 4 = 1 THEN '"}}]' ELSE '"' END || '}}], "role": "user"}}' ELSE '"}}' END END AS m FROM c LEFT JOIN shown USING (conv_id, turn)),
b AS (SELECT conv_id, version, '{{"model": "m-1",  "messages": [' || string_agg(m, ', ' ORDER BY turn) || '], "max_tokens": 64}}' AS body, coalesce(sum(before) FILTER (shorter), 0)::BIGINT AS before, coalesce(sum(after) FILTER (shorter), 0)::BIGINT AS after FROM m GROUP BY ALL),
w AS (SELECT *, (before - after) // 4 >= 16 AS changed FROM b)
SELECT conv_id, md5(body) AS digest, CASE WHEN changed THEN before ELSE 0 END AS bytes_before, CASE WHEN changed THEN after ELSE 0 END AS bytes_after, CASE WHEN changed THEN (before - after) // 4 ELSE 0 END AS saved_tokens FROM w WHERE version = CASE WHEN changed THEN 2 ELSE 1 END"""

# ---- rules


def _rule_documents(spark: SparkSession, d: str) -> DataFrame:
    """documents with a heading before each sentence but the first; anchors repeat, so they drift."""
    t = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")), F.lit(". "), F.lit(".\n## Part\n"))
    return _read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("source_id"), t.alias("text"))


def _rule_sections(spark: SparkSession, d: str) -> DataFrame:
    return rulebook.sections(_rule_documents(spark, d))


_SECTIONS = """s AS (SELECT doc_id::VARCHAR AS source_id, string_split(replace(replace(coalesce(text, ''), chr(10), ' '), '. ', '.' || chr(10) || '## Part' || chr(10)), chr(10) || '## Part' || chr(10)) AS p FROM documents),
u AS (SELECT source_id, generate_subscripts(p, 1) - 1 AS nr, unnest(p) AS b FROM s),
parts AS (SELECT source_id, nr, CASE WHEN nr = 0 THEN '' ELSE '/Part' END AS anchor, CASE WHEN b = '' THEN '' ELSE b || chr(10) END AS body, source_id || '#' || CASE WHEN nr = 0 THEN '_preamble' ELSE '/Part' END AS id FROM u)"""


def _compressed(spark: SparkSession, d: str) -> DataFrame:
    """No SQL: which section stays depends on those before it. Held against plain loops in tests/test_similar.py."""
    out = rulebook.compressed(_rule_documents(spark, d))
    return out.select("source_id", "nr", "reason", "duplicate_of", "original_tokens", "compressed_tokens", "accepted", F.md5(F.col("body").cast("binary")).alias("digest"))


def _task_scores(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items as tasks: their first two words as a tool, three more pairs of words as keywords; (task, id, tokens, score) of the sections they concern."""
    words = F.split(F.lower("text"), " ")
    pair = lambda i: F.array_join(F.slice(words, i, 2), " ")
    tasks = _read(spark, d, "benchmark").filter(F.size(words) >= 8).select(F.col("item_id").alias("task"), F.array(pair(1)).alias("tools"), F.array(pair(3), pair(5), pair(7)).alias("keywords"))
    parts = written(_rule_sections(spark, d), "sections")  # it is read four times, and then no task has two Python workers
    scores = rulebook.task_relevance(parts, tasks)
    tokens = parts.select("source_id", "nr", F.ceil(F.octet_length("body") / 4).cast("long").alias("tokens"))
    out = scores.filter("score >= 1").join(tokens, ["source_id", "nr"])
    return out.select("task", F.concat_ws("#", "source_id", F.col("nr").cast("string")).alias("id"), "tokens", "score")


_SCORES_SQL = f"""{_SECTIONS},
k AS (SELECT item_id AS task, string_split(lower(text), ' ') AS w FROM benchmark),
terms AS (SELECT task, unnest([1, 2, 2, 2]) AS kind, trim(unnest([w[1] || ' ' || w[2], w[3] || ' ' || w[4], w[5] || ' ' || w[6], w[7] || ' ' || w[8]])) AS term FROM k WHERE len(w) >= 8),
low AS (SELECT source_id || '#' || nr AS id, ceil(strlen(body) / 4.0::DOUBLE)::BIGINT AS tokens, lower(body) AS body, lower(anchor) AS anchor FROM parts),
near AS (SELECT DISTINCT term, id, contains(anchor, term) AS a, contains(body, term) AS b FROM (SELECT DISTINCT term FROM terms) t JOIN low ON contains(anchor, term) OR contains(body, term)),
scores AS (SELECT task, id, sum(CASE WHEN kind = 1 THEN 1 ELSE CASE WHEN a THEN 1 ELSE 0 END + CASE WHEN b THEN 0.5 ELSE 0 END END)::DOUBLE AS score FROM terms JOIN near USING (term) GROUP BY ALL),
scored AS (SELECT task, id, tokens, score FROM scores JOIN low USING (id) WHERE score >= 1)"""
_ROUTES_SQL = f"""WITH RECURSIVE {_SCORES_SQL},
o AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY score DESC, id) AS i FROM scored),
f AS (
  SELECT task, i, id, tokens, tokens <= 200 AS taken, CASE WHEN tokens <= 200 THEN tokens ELSE 0 END AS used FROM o WHERE i = 1
  UNION ALL SELECT o.task, o.i, o.id, o.tokens, f.used + o.tokens <= 200, CASE WHEN f.used + o.tokens <= 200 THEN f.used + o.tokens ELSE f.used END FROM f JOIN o ON o.task = f.task AND o.i = f.i + 1)
SELECT task, (row_number() OVER (PARTITION BY task ORDER BY i) - 1)::INTEGER AS place, id, tokens FROM f WHERE taken"""


def _exposures(spark: SparkSession, d: str) -> DataFrame:
    n = _usage(spark, d).groupBy("workflow_id", "agent_id").agg(F.count("*").alias("requests"), F.count_if(F.col("k") % 17 == 0).alias("retries"), F.sum("output_tokens").alias("output_tokens"), F.sum(F.when(F.col("k") % 2 == 0, F.col("input_tokens")).otherwise(0)).alias("baseline_tokens"))
    return n.withColumn("rule_tokens", F.col("requests") % 40)


_EXPOSED = f"""{_USAGE}, n AS (SELECT workflow_id, agent_id, count(*) AS requests, count(*) FILTER (k % 17 = 0) AS retries, sum(output_tokens)::BIGINT AS output_tokens, sum(CASE WHEN k % 2 = 0 THEN input_tokens ELSE 0 END)::BIGINT AS baseline_tokens FROM usage GROUP BY ALL),
b AS (SELECT *, requests % 40 AS rule_tokens, CASE WHEN baseline_tokens = 0 THEN trunc(output_tokens * 1.08::DOUBLE)::BIGINT ELSE baseline_tokens END AS base, greatest(trunc(requests * 0.1::DOUBLE)::BIGINT - retries, 0) AS retries_avoided FROM n),
c AS (SELECT *, rule_tokens * requests AS context_tokens, greatest(base - output_tokens, 0) + retries_avoided * 800 AS tokens_saved FROM b),
roi AS (SELECT workflow_id, agent_id, requests, retries, output_tokens, baseline_tokens, rule_tokens, retries_avoided, context_tokens, tokens_saved, CASE WHEN base > 0 THEN round((base - output_tokens)::DOUBLE / base, 6) ELSE 0 END AS context_reduction,
  CASE WHEN context_tokens > 0 THEN round((tokens_saved - context_tokens)::DOUBLE / context_tokens, 6) ELSE 0 END AS roi FROM c)"""


def _selected(spark: SparkSession, d: str) -> DataFrame:
    scored = _usage(spark, d).select("workflow_id", F.col("event_id").cast("string").alias("id"), F.col("output_tokens").alias("tokens"), (F.col("k") / 50.0).alias("score"))
    return rulebook.selected(scored, 2500, 1.3, "workflow_id").select("workflow_id", "place", "id", "tokens")


_SELECTED_SQL = f"""WITH RECURSIVE {_USAGE}, o AS (SELECT workflow_id, event_id::VARCHAR AS id, output_tokens AS tokens, row_number() OVER (PARTITION BY workflow_id ORDER BY k DESC, event_id::VARCHAR) AS i FROM usage WHERE k >= 65),
f AS (
  SELECT workflow_id, i, id, tokens, tokens <= 2500 AS taken, CASE WHEN tokens <= 2500 THEN tokens ELSE 0 END AS used FROM o WHERE i = 1
  UNION ALL SELECT o.workflow_id, o.i, o.id, o.tokens, f.used + o.tokens <= 2500, CASE WHEN f.used + o.tokens <= 2500 THEN f.used + o.tokens ELSE f.used END FROM f JOIN o ON o.workflow_id = f.workflow_id AND o.i = f.i + 1)
SELECT workflow_id, (row_number() OVER (PARTITION BY workflow_id ORDER BY i) - 1)::INTEGER AS place, id, tokens FROM f WHERE taken"""

# ---- learning, evaluation, coverage, routing


def _records(spark: SparkSession, d: str) -> DataFrame:
    e = _usage(spark, d)
    access = F.col("k") % 6 == 5
    return e.select(F.when(access, "access").otherwise("compress").alias("type"), (F.col("event_id") % 400).cast("string").alias("id"), F.concat(F.lit("cmd"), F.when(access, F.lit("")).otherwise((F.col("user_id") % 9).cast("string"))).alias("command"), F.col("input_tokens").alias("raw_bytes"), F.col("output_tokens").alias("tokens_saved"), (F.col("user_id") % 9 != 3).alias("handled"), (F.col("k") % 5 == 0).alias("generic_fallback"), "ts", "event_id")


_LEARN_SQL = f"""WITH {_USAGE}, c AS (SELECT (event_id % 400)::VARCHAR AS id, 'cmd' || (user_id % 9) AS command, * FROM usage WHERE k % 6 <> 5),
ran AS (SELECT command, count(*) AS runs, count(*) FILTER (user_id % 9 = 3 OR k % 5 = 0) AS generic_runs, sum(input_tokens)::BIGINT AS raw_bytes, sum(output_tokens)::BIGINT AS tokens_saved FROM c GROUP BY ALL),
owner AS (SELECT id, arg_max(command, ts) AS owner FROM c GROUP BY ALL),
met AS (SELECT coalesce(owner, 'cmd') AS command, count(*) AS accesses FROM usage u LEFT JOIN owner o ON o.id = (u.event_id % 400)::VARCHAR WHERE k % 6 = 5 GROUP BY ALL),
b AS (SELECT coalesce(r.command, m.command) AS command, coalesce(runs, 0) AS runs, coalesce(generic_runs, 0) AS generic_runs, coalesce(raw_bytes, 0) AS raw_bytes, coalesce(tokens_saved, 0) AS tokens_saved, coalesce(accesses, 0) AS accesses FROM ran r FULL JOIN met m ON r.command = m.command),
x AS (SELECT *, round(coalesce(generic_runs::DOUBLE / nullif(runs, 0), 0), 6) AS generic_ratio, round(coalesce(accesses::DOUBLE / nullif(runs, 0), 0), 6) AS access_rate FROM b)
SELECT *, runs >= 5 AND generic_ratio >= 0.5 AS next_formatter, runs >= 5 AND access_rate > 0.1 AS critical_miss, CASE WHEN runs < 5 OR generic_ratio >= 1 THEN NULL WHEN access_rate > 0.1 THEN 'lower' WHEN access_rate <= 0.01 THEN 'raise' END AS hint FROM x"""


def _steps(spark: SparkSession, d: str, shift: int = 0) -> DataFrame:
    e = _usage(spark, d).select(F.when(F.col("agent_id") != "agent-5", F.col("agent_id")).otherwise("").alias("optimizer"), ((F.col("k") + shift) / 100.0).alias("quality"), F.col("output_tokens").alias("saved"), "input_tokens", F.when(F.col("k") % 4 == 0, "applied").when(F.col("k") % 4 == 1, "skipped").otherwise("rejected").alias("decision"), "k")
    return e.withColumn("passed", quality.step_passes(F.col("quality"), F.col("saved"), F.col("input_tokens"), F.col("decision"), F.lit(0.3), F.lit(0.05), F.lit(True)))


def _steps_sql(shift: int, name: str) -> str:
    return f"""{name}_s AS (SELECT coalesce(nullif(CASE WHEN agent_id <> 'agent-5' THEN agent_id ELSE '' END, ''), 'unknown') AS optimizer, (k + {shift}) / 100.0::DOUBLE AS quality, output_tokens AS saved, input_tokens, CASE k % 4 WHEN 0 THEN 'applied' WHEN 1 THEN 'skipped' ELSE 'rejected' END AS decision FROM usage),
{name}_p AS (SELECT *, NOT (quality < 0.3 OR (input_tokens > 0 AND saved::DOUBLE / input_tokens < 0.05) OR (decision = 'skipped' AND saved = 0)) AS passed FROM {name}_s),
{name} AS (SELECT optimizer, count(*) AS cases, count(*) FILTER (passed) AS passed, round(count(*) FILTER (passed) * 100.0::DOUBLE / count(*), 6) AS success_pct, round(avg(quality), 6) AS mean_quality, sum(saved)::BIGINT AS saved, round(count(*) FILTER (decision = 'applied') * 100.0::DOUBLE / count(*), 6) AS apply_pct FROM {name}_p GROUP BY ROLLUP (optimizer))"""


def _gate(spark: SparkSession, d: str) -> DataFrame:
    now = quality.eval_report(_steps(spark, d, -14).filter("coalesce(optimizer, '') <> 'agent-2'"))
    return quality.gate(quality.eval_report(_steps(spark, d)), now)


_GATE_SQL = f"""WITH {_USAGE}, {_steps_sql(0, "b")}, {_steps_sql(-14, "w")},
n AS (SELECT optimizer, count(*) AS n, count(*) FILTER (passed) * 100.0::DOUBLE / count(*) AS s, avg(quality) AS q FROM w_p WHERE optimizer <> 'agent-2' GROUP BY ROLLUP (optimizer)),
j AS (SELECT b.*, n, round(s, 6) AS s, round(q, 6) AS q FROM b LEFT JOIN n ON n.optimizer IS NOT DISTINCT FROM b.optimizer)
SELECT 'success_rate_drop' AS violation, optimizer, round(success_pct - s, 6) AS observed, 5::DOUBLE AS bound FROM j WHERE optimizer IS NULL AND success_pct - s > 5
UNION ALL SELECT 'optimizer_disappeared', optimizer, 0, 0 FROM j WHERE optimizer IS NOT NULL AND n IS NULL
UNION ALL SELECT 'quality_drift', optimizer, round((q - mean_quality) / mean_quality * 100, 6), -10 FROM j WHERE optimizer IS NOT NULL AND (q - mean_quality) / mean_quality * 100 < -10"""

POLICIES = [("pkg/AF", 10, 50.0), ("pkg/NO", 7, 20.0), ("pkg/gone", 1, 30.0)]


def _debt(spark: SparkSession, d: str) -> DataFrame:
    lines = _read(spark, d, "lineitem").select(F.concat(F.lit("pkg/"), "l_returnflag", "l_linestatus", F.lit("/f.go:1.2,3.4 "), F.col("l_linenumber").cast("string"), F.lit(" "), (F.col("l_orderkey") % 3).cast("string")).alias("value"))
    return quality.coverage_debt(quality.coverage(lines), spark.createDataFrame(POLICIES, "package string, risk int, goal double"))


_DEBT_SQL = f"""WITH c AS (SELECT 'pkg/' || l_returnflag || l_linestatus AS package, sum(l_linenumber)::DOUBLE AS n, sum(CASE WHEN l_orderkey % 3 > 0 THEN l_linenumber ELSE 0 END)::DOUBLE AS hit FROM lineitem GROUP BY ALL), p(package, risk, goal) AS (VALUES {_values(POLICIES)}),
j AS (SELECT c.package, coalesce(risk, 4)::INTEGER AS risk, coalesce(goal, 60)::DOUBLE AS goal, hit * 100 / n AS pct FROM c LEFT JOIN p USING (package)),
debt AS (SELECT package, risk, round(pct, 6) AS coverage_pct, goal, round(risk * (1 - pct / 100), 6) AS risk_score, round(greatest(goal - pct, 0), 6) AS gap, goal = 0 OR pct >= goal AS goal_met FROM j)"""

ROUTES = [(1, "openai", "gpt-2", "gpt-x", ["gpt-1"], 0.9), (2, "openai", "gpt*", "gpt-1", [], 0.8), (3, "anthropic", "claude-2", "none", [""], 0.9), (4, "anthropic", "claude*", "claude-1", [], 0.95), (5, "mistral", "mistral*", "mistral-0", [], 0.2)]


def _routed(spark: SparkSession, d: str) -> DataFrame:
    rules = spark.createDataFrame(ROUTES, "nr int, provider string, pattern string, to_model string, fallbacks array<string>, quality double")
    asked = _usage(spark, d).select("event_id", "ts", "provider", "model", "input_tokens", "output_tokens")
    return quality.routed(asked, rules, pricing.rate_card(spark), ["gpt-1", "claude-1", "mistral-0"], 0.5)


_ROUTED_SQL = f"""WITH {_USAGE}, {_CARD},
t AS (SELECT event_id, ts, provider, model, input_tokens, output_tokens, CASE WHEN provider = 'openai' THEN 'gpt-1' WHEN provider = 'anthropic' AND model <> 'claude-2' THEN 'claude-1' END AS target,
  CASE WHEN provider = 'openai' THEN CASE WHEN model = 'gpt-2' THEN 0.9 ELSE 0.8 END WHEN provider = 'anthropic' THEN CASE WHEN model = 'claude-2' THEN 0.9 ELSE 0.95 END END::DOUBLE AS quality FROM usage),
m AS (SELECT DISTINCT provider, model FROM usage UNION SELECT DISTINCT provider, target FROM t WHERE target IS NOT NULL),
r AS (SELECT m.provider, m.model, c.effective_from, c.input_rate, c.output_rate FROM m JOIN card c ON c.provider = m.provider AND (c.pattern = m.model OR (c.pattern LIKE '%*' AND starts_with(m.model, left(c.pattern, length(c.pattern) - 1))))
  QUALIFY row_number() OVER (PARTITION BY m.provider, m.model, c.effective_from ORDER BY (c.pattern = m.model) DESC, length(c.pattern) DESC) = 1),
x AS (SELECT t.*, coalesce((SELECT max(effective_from) FROM card WHERE effective_from <= t.ts), (SELECT min(effective_from) FROM card)) AS at FROM t),
y AS (SELECT x.*, (x.input_tokens * a.input_rate + x.output_tokens * a.output_rate) / 1e6 AS was, (x.input_tokens * b.input_rate + x.output_tokens * b.output_rate) / 1e6 AS now FROM x LEFT JOIN r a ON a.provider = x.provider AND a.model = x.model AND a.effective_from = x.at LEFT JOIN r b ON b.provider = x.provider AND b.model = x.target AND b.effective_from = x.at)
SELECT event_id, ts, provider, model, input_tokens, output_tokens, target, quality, CASE WHEN target IS NOT NULL AND was - now > 0 THEN input_tokens + output_tokens ELSE 0 END AS saved_tokens, round(CASE WHEN target IS NOT NULL THEN coalesce(greatest(was - now, 0), 0) ELSE 0 END, 9) AS saved_usd FROM y"""

# ---- ledger


def _provided(spark: SparkSession, d: str) -> DataFrame:
    provider = F.get(F.array(F.lit("anthropic"), F.lit("gemini"), F.lit("mistral")), (F.col("conv_id") % 3).cast("int"))
    return _read(spark, d, "conversations").withColumn("provider", provider)


def _kpi_events(spark: SparkSession, d: str) -> DataFrame:
    return without_sources(usage_events(_read(spark, d, "events")), coach.KPI_EXCLUDED).withColumn("latency_s", (F.col("k") * 7).cast("double"))


def _kpis(spark: SparkSession, d: str) -> DataFrame:
    events = _kpi_events(spark, d)
    return coach.kpis(events, events.filter("k % 3 = 0").select(F.col("output_tokens").alias("saved_tokens")))


_KPI_SQL = f"""{_USAGE}, first AS (SELECT user_id || '-' || ts::DATE AS key, arg_min(k * 7.0::DOUBLE, (ts, event_id)) AS latency FROM usage GROUP BY ALL),
med AS (SELECT latency, row_number() OVER (ORDER BY latency) AS nr, count(*) OVER () AS n FROM first),
v AS (
  SELECT 'spend_attribution' AS kpi, round(count(*) FILTER (coalesce(workflow_id, '') <> '')::DOUBLE / nullif(count(*), 0) * 100, 6) AS value FROM usage
  UNION ALL SELECT 'cache_hit', round(sum(cached_input_tokens)::DOUBLE / nullif(sum(input_tokens), 0) * 100, 6) FROM usage
  UNION ALL SELECT 'token_efficiency', round(sum(output_tokens) FILTER (k % 3 = 0)::DOUBLE / nullif(sum(input_tokens), 0) * 100, 6) FROM usage
  UNION ALL SELECT 'first_value_time', round(latency, 6) FROM med WHERE nr = n // 2 + 1),
graded AS (SELECT kpi, value, CASE WHEN value IS NULL THEN NULL WHEN kpi = 'first_value_time' THEN CASE WHEN value <= 60 THEN 'A' WHEN value <= 300 THEN 'B' WHEN value <= 900 THEN 'C' ELSE 'F' END
  WHEN kpi = 'token_efficiency' THEN CASE WHEN value >= 20 THEN 'A' WHEN value >= 10 THEN 'B' WHEN value >= 5 THEN 'C' ELSE 'F' END ELSE CASE WHEN value >= 90 THEN 'A' WHEN value >= 70 THEN 'B' WHEN value >= 50 THEN 'C' ELSE 'F' END END AS grade FROM v)"""


def _tasks(spark: SparkSession, d: str) -> DataFrame:
    """Start and done markers, some of them doubled or without a start."""
    e = _usage(spark, d)
    kind = F.when(F.col("k") % 3 == 0, "start").when(F.col("k") % 3 == 1, "done").otherwise("note")
    return logs.tasks(e.select(kind.alias("kind"), (F.col("event_id") % 900).cast("string").alias("id"), F.col("event_id").cast("string").alias("description"), F.col("workflow_id").alias("session"), "ts"))


def _deltas(spark: SparkSession, d: str) -> DataFrame:
    """Running totals of tokens, as a cache of daily statistics would hold them."""
    e = _usage(spark, d).groupBy(F.to_date("ts").alias("day"), "model", F.date_trunc("hour", "ts").alias("taken")).agg(F.sum("output_tokens").alias("t"), F.min("k").alias("k"))
    total = F.sum("t").over(series.Window.partitionBy("day", "model").orderBy("taken"))
    known = F.col("model") != "nova-1"
    return logs.daily_deltas(e.select("day", "model", "taken", total.alias("tokens"), F.when(known, F.length("model")).alias("lifetime_input"), F.when(known, F.lit(5)).alias("lifetime_output")))


_DELTA_SQL = f"""WITH {_USAGE}, h AS (SELECT ts::DATE AS day, model, date_trunc('hour', ts) AS taken, sum(output_tokens)::BIGINT AS delta FROM usage GROUP BY ALL HAVING sum(output_tokens) > 0),
p AS (SELECT *, CASE WHEN model <> 'nova-1' THEN delta * length(model) // (length(model) + 5) ELSE delta // 100 END AS part FROM h) SELECT day, model, sum(part)::BIGINT AS input_tokens, sum(delta - part)::BIGINT AS output_tokens FROM p GROUP BY ALL"""


def _histograms(spark: SparkSession, d: str) -> DataFrame:
    h = series.histograms(_usage(spark, d), "workflow_id", ["model", "agent_id"])
    shown = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias(c)
    return h.select("workflow_id", shown("model_counts"), shown("agent_id_counts"))


def _counters(spark: SparkSession, d: str) -> DataFrame:
    """A counter in a payload, with an attribute of another name to fall back on, now and then not a number."""
    other = F.concat(F.lit('{"cache_read_input": "'), F.col("user_id").cast("string"), F.when(F.col("user_id") % 3 == 0, "x").otherwise(""), F.lit('"}'))
    e = _read(spark, d, "events").select(F.regexp_replace("props", '"k"', '"cached"').alias("payload"), other.alias("attributes"))
    return e.agg(F.sum(ledger.coalesced_counter("payload", "attributes", "cached", "cache_read_input")).alias("cached"))


def _exact_tokens(spark: SparkSession, d: str) -> DataFrame:
    """No SQL: merging by ranks is beyond it. Held against the public library in tests/test_token_count.py."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken")) as f:
        ranks = token_count.ranks_of(f.read().splitlines())
    return token_count.conversation_tokens(_read(spark, d, "conversations"), "conv_id", ranks)


QUERIES = {
    "session_budget": _session_budget,
    "latest_quota": lambda s, d: quotas.reported(_with_attributes(s, d), NOW, 24),
    "signal_quality": _signals,
    "rate_guard": lambda s, d: pricing.suspicious(_card(s, d)),
    "rate_catalogue": _catalogue,
    "prompt_findings": lambda s, d: talk.prompt_findings(_prompts(s, d)),
    "prompt_repeats": lambda s, d: talk.repeated_prompts(_prompts(s, d)),
    "prompt_advice": _advice,
    "prompt_savings": lambda s, d: talk.projected_savings(_advice(s, d), talk.turn_stats(_priced(s, d)).filter("model is null")),
    "turn_stats": lambda s, d: talk.turn_stats(_priced(s, d)),
    "reply_stats": lambda s, d: talk.reply_stats(_replies(s, d)),
    "tool_stats": lambda s, d: talk.tool_stats(_tool_events(s, d)),
    "tool_counts": lambda s, d: talk.tool_counts(_tool_events(s, d)),
    "context_composition": lambda s, d: talk.composition(_blocks(s, d)),
    "read_report": lambda s, d: talk.read_report(_blocks(s, d)),
    "read_repeats": lambda s, d: talk.rereads(_blocks(s, d)),
    "read_extensions": lambda s, d: talk.read_extensions(_blocks(s, d)),
    "weekly_timeline": _timeline,
    "command_roi": lambda s, d: talk.command_roi(_blocks(s, d, _shell_output)),
    "log_prompts": _logged(logs.user_prompts),
    "log_replies": _logged(logs.assistant_replies),
    "request_bodies": lambda s, d: logs.requests(_bodies(s, d)).select("conv_id", "model", "stream", "max_tokens", "messages", "has_system"),
    "request_messages": lambda s, d: logs.request_messages(_bodies(s, d).drop("path")).select("conv_id", F.col("nr").cast("int").alias("nr"), "role", F.md5(F.col("text").cast("binary")).alias("digest")),
    "request_rewrite": _rewritten_bodies,
    "rule_summary": lambda s, d: rulebook.document_summary(_rule_sections(s, d)),
    "rule_redundant": lambda s, d: rulebook.redundant(_rule_sections(s, d)).select("hash", "sections", "id"),
    "rule_drift": lambda s, d: rulebook.drifting(_rule_sections(s, d)),
    "rule_contrary": lambda s, d: rulebook.contrary(_rule_sections(s, d), [("a_vs_b", ["the that", "que la"], ["und die", "el que", "with"])]),
    "rule_compress": _compressed,
    "rule_relevance": _task_scores,
    "rule_routes": lambda s, d: rulebook.selected(_task_scores(s, d), 200, 1.0, "task").select("task", "place", "id", "tokens"),
    "rule_roi": lambda s, d: rulebook.returns(_exposures(s, d)),
    "rule_winners": lambda s, d: rulebook.winners(rulebook.returns(_exposures(s, d)).filter("agent_id is not null").select(F.col("workflow_id").alias("scenario"), F.col("agent_id").alias("profile"), "roi")),
    "rule_select": _selected,
    "fmt_learn": lambda s, d: quality.command_learning(_records(s, d)),
    "eval_report": lambda s, d: quality.eval_report(_steps(s, d)),
    "eval_gate": _gate,
    "coverage_debt": _debt,
    "coverage_overall": lambda s, d: quality.overall_coverage(_debt(s, d)),
    "model_routing": _routed,
    "replay_totals": lambda s, d: quality.replay_totals(_routed(s, d)),
    "scorecard_kpis": _kpis,
    "scorecard_grade": lambda s, d: coach.overall_grade(_kpis(s, d)),
    "task_fold": _tasks,
    "stats_cache_deltas": _deltas,
    "trace_histograms": _histograms,
    "event_scan": lambda s, d: ledger.events_between(_usage(s, d), NOW.replace(day=20), NOW, limit=500, provider="openai").select("event_id", "ts", "model"),
    "event_count": lambda s, d: ledger.count_between(_usage(s, d), NOW.replace(day=20), NOW, provider="openai"),
    "plan_stamp": lambda s, d: ledger.stamped(_usage(s, d).withColumn("cost_source", F.when(F.col("k") % 2 == 0, F.col("cost_source"))), ["openai", "gemini"]).groupBy("provider", "cost_source").agg(F.count("*").alias("events")),
    "otlp_records": lambda s, d: ledger.log_records(_usage(s, d), ["event_id", "provider", "model", "agent_id"]).select(F.md5(F.col("record").cast("binary")).alias("digest")),
    "latency_percentiles": lambda s, d: order.order_statistics(_read(s, d, "events"), "value", {"p50": order.at_share(0.5), "p99": order.at_share(0.99)}),
    "kind_counts": lambda s, d: ledger.kind_counts(_usage(s, d), "cost_source"),
    "session_ledger": lambda s, d: ledger.session_ledger(_usage(s, d), "session_id"),
    "rollup_hourly_provider_model": lambda s, d: _priced(s, d).groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("bucket"), "provider", "model").agg(F.count("*").alias("requests"), F.sum("input_tokens").alias("input_tokens")),
    "rollup_daily_savings": lambda s, d: _usage(s, d).filter("k % 3 = 0").groupBy(F.to_date("ts").alias("day"), F.col("prompt_hash").alias("kind")).agg(F.count("*").alias("applied"), F.sum("output_tokens").alias("saved_tokens")),
    "coach_budget": lambda s, d: coach.within_budget(_usage(s, d).withColumn("cost", F.col("output_tokens")), 3000, "workflow_id", "event_id").select("event_id", "running"),
    "counter_fallback": _counters,
    "exact_tokens": _exact_tokens,
    "message_tokens": lambda s, d: text.message_tokens(_provided(s, d), ["conv_id", "provider"]),
}

ORACLE_SQL = {
    "session_budget": _BUDGET_SQL,
    "latest_quota": f"WITH {_ATTRIBUTED}, {_REPORTED} SELECT provider, used AS used_pct, date_diff('second', {_NOW}, TIMESTAMP '2024-01-25 13:30:00') AS resets_in_s, 'anthropic_cookie:five_hour' AS meter FROM v",
    "signal_quality": _SIGNAL_SQL,
    "rate_guard": _GUARD_SQL,
    "rate_catalogue": _CATALOGUE_SQL,
    "prompt_findings": f"WITH {_FINDINGS} SELECT * FROM found",
    "prompt_repeats": f"WITH {_PROMPTS}, {_REPEATED} SELECT * FROM repeats",
    "prompt_advice": f"WITH {_ADVICE} SELECT * FROM advice",
    "prompt_savings": f"WITH {_ADVICE}, {_TURNS} SELECT id, turns_saved, floor(turns_saved * (mean_input + mean_output))::BIGINT AS tokens, round(turns_saved * mean_cost_usd, 6) AS cost_usd, round(turns_saved * 30.0::DOUBLE / 3600, 6) AS hours FROM advice, turn_stats WHERE model IS NULL",
    "turn_stats": f"WITH {_TURNS} SELECT * FROM turn_stats",
    "reply_stats": _REPLIES_SQL,
    "tool_stats": f"""WITH {_BLOCKS}, t AS (SELECT count(*) AS calls, count(*) FILTER (name = 'Bash' AND k % 8 IN (1, 3, 5)) AS destructive, count(*) FILTER (k % 11 <> 0 AND k % 9 = 1) AS failed FROM e)
SELECT calls, failed, destructive, round((calls - failed) * 100.0::DOUBLE / calls, 6) AS success_pct, round(destructive * 100.0::DOUBLE / calls, 6) AS destructive_pct FROM t""",
    "tool_counts": f"WITH {_BLOCKS} SELECT name, count(*) AS calls FROM e GROUP BY name",
    "context_composition": f"WITH {_BLOCKS} SELECT 'tool:' || name AS part, sum(bytes)::BIGINT AS bytes FROM r GROUP BY name UNION ALL SELECT part, sum(bytes)::BIGINT FROM prose GROUP BY part",
    "read_report": f"WITH {_BLOCKS} SELECT count(*) AS reads, coalesce(sum(bytes), 0)::BIGINT AS bytes, count(*) FILTER (ranged) AS ranged, coalesce(sum(bytes) FILTER (nr > 1), 0)::BIGINT AS repeat_bytes, coalesce(sum(bytes) FILTER (again > 1), 0)::BIGINT AS duplicate_bytes FROM reads",
    "read_repeats": f"WITH {_BLOCKS}, p AS (SELECT session, path, count(*) AS reads, sum(CASE WHEN nr > 1 THEN bytes ELSE 0 END)::BIGINT AS wasted FROM reads GROUP BY ALL HAVING count(*) > 1) SELECT path, sum(reads)::BIGINT AS reads, sum(wasted)::BIGINT AS wasted_bytes FROM p GROUP BY path HAVING sum(wasted) > 0 ORDER BY wasted_bytes DESC, path LIMIT 20",
    "read_extensions": f"WITH {_BLOCKS} SELECT CASE WHEN contains(path, '.') THEN '.py' ELSE '(none)' END AS ext, sum(bytes)::BIGINT AS bytes FROM reads GROUP BY ALL",
    "weekly_timeline": f"""WITH {_BLOCKS}, a AS (SELECT date_trunc('week', ts)::DATE AS week, input_tokens AS i, output_tokens AS o, 0 AS rb, 0 AS bb, 0 AS ob, 0 AS pb FROM usage
UNION ALL SELECT date_trunc('week', ts)::DATE, 0, 0, CASE name WHEN 'Read' THEN bytes ELSE 0 END, CASE name WHEN 'Bash' THEN bytes ELSE 0 END, CASE WHEN name NOT IN ('Read', 'Bash') THEN bytes ELSE 0 END, 0 FROM r
UNION ALL SELECT date_trunc('week', ts)::DATE, 0, 0, 0, 0, 0, bytes FROM prose WHERE part = 'assistant_prose')
SELECT week, sum(i)::BIGINT AS input_tokens, sum(o)::BIGINT AS output_tokens, sum(rb)::BIGINT AS read_bytes, sum(bb)::BIGINT AS bash_bytes, sum(ob)::BIGINT AS other_bytes, sum(pb)::BIGINT AS prose_bytes FROM a GROUP BY week""",
    "command_roi": f"WITH {_SHELL_SQL}",
    "log_prompts": _logged_sql("user"),
    "log_replies": _logged_sql("assistant"),
    "request_bodies": "SELECT conv_id, 'm-1' AS model, true AS stream, 64::BIGINT AS max_tokens, count(*)::INTEGER AS messages, arg_min(role, turn) = 'system' AS has_system FROM conversations GROUP BY conv_id",
    "request_messages": "SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS nr, role, md5(text) AS digest FROM conversations",
    "request_rewrite": _REWRITTEN_SQL,
    "rule_summary": f"""WITH {_SECTIONS}, t AS (SELECT *, strlen(body) AS b, ceil(strlen(body) / 4.0::DOUBLE)::BIGINT AS tokens FROM parts),
k AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY tokens DESC, nr) AS rank FROM t)
SELECT source_id, count(*) AS sections, sum(b)::BIGINT AS bytes, sum(tokens)::BIGINT AS tokens, round(coalesce(sum(tokens) * 1000.0::DOUBLE / nullif(sum(b), 0), 0), 6) AS tokens_per_k, string_agg(anchor, '|' ORDER BY rank) FILTER (rank <= 5) AS largest FROM k GROUP BY source_id""",
    "rule_redundant": f"WITH {_SECTIONS} SELECT 'sha256:' || sha256(body) AS hash, count(*) OVER (PARTITION BY body) AS sections, id FROM parts WHERE trim(body, ' ' || chr(9) || chr(10) || chr(13)) <> '' QUALIFY count(*) OVER (PARTITION BY body) >= 2",
    "rule_drift": f"WITH {_SECTIONS}, n AS (SELECT lower(anchor) AS anchor, count(*) AS sections, count(DISTINCT body) AS bodies FROM parts WHERE anchor <> '' GROUP BY lower(anchor) HAVING count(*) >= 2 AND count(DISTINCT body) >= 2) SELECT n.*, id, 'sha256:' || sha256(body) AS hash FROM n JOIN parts p ON lower(p.anchor) = n.anchor",
    "rule_contrary": f"""WITH {_SECTIONS}, h AS (SELECT id, bool_or(contains(lower(body), 'the that') OR contains(lower(body), 'que la')) AS a, bool_or(contains(lower(body), 'und die') OR contains(lower(body), 'el que') OR contains(lower(body), 'with')) AS b FROM parts GROUP BY id)
SELECT 'a_vs_b' AS pattern, true AS inside, id, NULL AS side FROM h WHERE a AND b
UNION ALL SELECT 'a_vs_b', false, id, CASE WHEN a THEN 'a' ELSE 'b' END FROM h WHERE a <> b AND (SELECT count(*) FROM h WHERE a AND NOT b) > 0 AND (SELECT count(*) FROM h WHERE b AND NOT a) > 0""",
    "rule_relevance": f"WITH {_SCORES_SQL} SELECT * FROM scored",
    "rule_routes": _ROUTES_SQL,
    "rule_roi": f"WITH {_EXPOSED} SELECT * FROM roi",
    "rule_winners": f"WITH {_EXPOSED} SELECT workflow_id AS scenario, agent_id AS profile FROM roi WHERE agent_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY workflow_id ORDER BY roi DESC, agent_id) = 1",
    "rule_select": _SELECTED_SQL,
    "fmt_learn": _LEARN_SQL,
    "eval_report": f"WITH {_USAGE}, {_steps_sql(0, 'r')} SELECT * FROM r",
    "eval_gate": _GATE_SQL,
    "coverage_debt": f"{_DEBT_SQL} SELECT * FROM debt",
    "coverage_overall": f"{_DEBT_SQL} SELECT round(sum(coverage_pct * risk) / sum(risk), 6) AS overall_pct, sum(risk)::BIGINT AS risk, count(*) FILTER (NOT goal_met) AS short FROM debt",
    "model_routing": _ROUTED_SQL,
    "replay_totals": f"SELECT count(*) AS requests, count(target) AS recommended, sum(saved_tokens)::BIGINT AS saved_tokens, sum(saved_usd::DECIMAL(18,9))::DOUBLE AS saved_usd FROM ({_ROUTED_SQL})",
    "scorecard_kpis": f"WITH {_KPI_SQL} SELECT * FROM graded",
    "scorecard_grade": f"WITH {_KPI_SQL} SELECT coalesce(max(grade), 'warming_up') AS grade, count(value) AS kpis FROM graded",
    "task_fold": f"""WITH {_USAGE}, m AS (SELECT (event_id % 900)::VARCHAR AS task, event_id::VARCHAR AS description, workflow_id AS session, ts, k % 3 AS kind FROM usage)
SELECT task, arg_min(description, ts) FILTER (kind = 0) AS description, arg_min(session, ts) FILTER (kind = 0) AS session, min(ts) FILTER (kind = 0) AS begins, max(ts) FILTER (kind = 1) AS ends FROM m GROUP BY task HAVING count(*) FILTER (kind = 0) > 0""",
    "stats_cache_deltas": _DELTA_SQL,
    "trace_histograms": f"""WITH {_USAGE}, m AS (SELECT workflow_id, model AS v, count(*) AS n FROM usage GROUP BY ALL), a AS (SELECT workflow_id, agent_id AS v, count(*) AS n FROM usage WHERE agent_id IS NOT NULL GROUP BY ALL),
x AS (SELECT workflow_id, string_agg(v || '=' || n, ',' ORDER BY v) AS model_counts FROM m GROUP BY ALL), y AS (SELECT workflow_id, string_agg(v || '=' || n, ',' ORDER BY v) AS agent_id_counts FROM a GROUP BY ALL)
SELECT workflow_id, model_counts, coalesce(agent_id_counts, '') AS agent_id_counts FROM x LEFT JOIN y USING (workflow_id)""",
    "event_scan": f"WITH {_USAGE} SELECT event_id, ts, model FROM usage WHERE provider = 'openai' AND ts >= TIMESTAMP '2024-01-20 12:00:00' AND ts < {_NOW} ORDER BY ts, event_id LIMIT 500",
    "event_count": f"WITH {_USAGE} SELECT count(*) AS events FROM usage WHERE provider = 'openai' AND ts >= TIMESTAMP '2024-01-20 12:00:00' AND ts < {_NOW}",
    "plan_stamp": f"WITH {_USAGE}, s AS (SELECT provider, CASE WHEN k % 2 = 0 THEN cost_source WHEN provider IN ('openai', 'gemini') THEN 'plan_included' END AS cost_source FROM usage) SELECT provider, cost_source, count(*) AS events FROM s GROUP BY ALL",
    "otlp_records": f"""WITH {_USAGE} SELECT md5('{{"timeUnixNano":"' || epoch_ns(ts) || '","attributes":[{{"key":"event_id","value":{{"stringValue":"' || event_id || '"}}}},{{"key":"provider","value":{{"stringValue":"' || provider || '"}}}},{{"key":"model","value":{{"stringValue":"' || model || '"}}}}' || coalesce(',{{"key":"agent_id","value":{{"stringValue":"' || agent_id || '"}}}}', '') || ']}}') AS digest FROM usage""",
    "latency_percentiles": "WITH o AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events WHERE value IS NOT NULL AND NOT isnan(value)) SELECT name, value FROM o, (VALUES ('p50', 0.5::DOUBLE), ('p99', 0.99::DOUBLE)) v(name, p) WHERE i = floor((n - 1) * p)",
    "kind_counts": f"WITH {_USAGE} SELECT cost_source, count(*) AS events FROM usage GROUP BY ALL",
    "session_ledger": f"WITH {_USAGE} SELECT count(*) AS entries, count(DISTINCT user_id || '-' || ts::DATE) AS sessions, coalesce(sum(cost_usd::DECIMAL(18,9))::DOUBLE, 0) AS total FROM usage",
    "rollup_hourly_provider_model": f"WITH {_USAGE} SELECT date_trunc('hour', ts) AS bucket, provider, model, count(*) AS requests, sum(input_tokens)::BIGINT AS input_tokens FROM usage GROUP BY ALL",
    "rollup_daily_savings": f"WITH {_USAGE} SELECT ts::DATE AS day, prompt_hash AS kind, count(*) AS applied, sum(output_tokens)::BIGINT AS saved_tokens FROM usage WHERE k % 3 = 0 GROUP BY ALL",
    "coach_budget": f"WITH {_USAGE}, r AS (SELECT event_id, sum(output_tokens) OVER (PARTITION BY workflow_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM usage) SELECT * FROM r WHERE running <= 3000",
    "message_tokens": """WITH r AS (SELECT conv_id, role, text, ['anthropic', 'gemini', 'mistral'][conv_id % 3 + 1] AS provider, [3.5, 4.0, 4.0][conv_id % 3 + 1]::DOUBLE AS a, [1.4, 1.6, 1.5][conv_id % 3 + 1]::DOUBLE AS o, [5, 3, 4][conv_id % 3 + 1] AS m, [3, 2, 3][conv_id % 3 + 1] AS w FROM conversations),
p AS (SELECT *, length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) AS plain FROM r)
SELECT conv_id, provider, (sum(ceil(length(role) / a) + ceil(plain / a + (length(text) - plain) / o) + m) + max(w))::BIGINT AS tokens FROM p GROUP BY ALL""",
    "counter_fallback": f"SELECT sum(coalesce(nullif(cast({_K} AS BIGINT), 0), CASE WHEN user_id % 3 = 0 THEN 0 ELSE user_id END))::BIGINT AS cached FROM events",
}
