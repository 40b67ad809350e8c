"""Readers, the ledger, rules, quotas and streams on small fixtures."""

import json
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from meterlake.functions import pricing
from meterlake.operators import coach, quality, quotas, rulebook, talk
from meterlake.sources import ledger, logs
from meterlake.sources.usage import token_counts
from meterlake.streaming import state

NOW = datetime(2024, 5, 15, 12)


def lines(spark, *rows):
    return spark.createDataFrame([(r if isinstance(r, str) else json.dumps(r),) for r in rows], "value string")


def test_prompts_and_replies(spark):
    at = {"sessionId": "s", "timestamp": "2026-01-01T00:00:00Z"}
    user = lambda content: {"type": "user", **at, "message": {"role": "user", "content": content}}
    rows = lines(spark, user("hello"), user([{"type": "text", "text": "a"}, {"type": "image"}, {"type": "text", "text": "b"}]), user("<command> x"), user("  "), user("see tool_use_id 3"), "not json", {**user("late"), "timestamp": "never"}, {"type": "Assistant", **at, "message": {"content": [{"type": "text", "text": "ok"}]}})
    assert sorted(r.text for r in logs.user_prompts(rows).collect()) == ["a\nb", "hello"]
    assert [r.text for r in logs.assistant_replies(rows).collect()] == ["ok"]


def test_tool_events_and_context(spark):
    at = {"sessionId": "s", "timestamp": "2026-01-05T00:00:00Z"}
    calls = [{"type": "tool_use", "id": "1", "name": "Bash", "input": {"command": "cd /x && git status"}}, {"type": "tool_use", "id": "2", "name": "Read", "input": {"file_path": "/a/b.PY", "offset": 3}}]
    results = [{"type": "tool_result", "tool_use_id": "1", "content": "12345"}, {"type": "tool_result", "tool_use_id": "2", "content": [{"type": "text", "text": "abc"}], "is_error": True}, {"type": "tool_result", "tool_use_id": "9", "content": "z"}]
    rows = lines(spark, {**at, "message": {"role": "assistant", "content": [*calls, {"type": "text", "text": "four"}]}}, {**at, "message": {"role": "user", "content": results}})
    blocks = logs.content_blocks(rows)
    assert {(r.name, r.command, r.bytes, r.ranged) for r in talk.joined_results(blocks).collect()} == {("Bash", "git", 5, False), ("Read", "", 3, True), ("unknown", "", 1, False)}
    assert {r.part: r.bytes for r in talk.composition(blocks).collect()} == {"tool:Bash": 5, "tool:Read": 3, "tool:unknown": 1, "assistant_prose": 4}
    assert [(r.ext, r.bytes) for r in talk.read_extensions(blocks).collect()] == [(".py", 3)]
    stats = talk.tool_stats(logs.tool_events(rows)).first()
    assert (stats.calls, stats.failed, stats.destructive, stats.success_pct) == (2, 1, 0, 50.0)
    assert talk.tool_stats(logs.tool_events(rows).limit(0)).first().success_pct == 0


def test_command_token(spark):
    cases = {"git status": "git", "cd /a && FOO=1 sudo /usr/bin/pytest -q | tail": "pytest", "export A=1; make all": "make", "cd /a": "", "": "", "A=1": "", "x\ny": "x", r"C:\bin\go.exe test": "go.exe"}
    df = spark.createDataFrame([(c,) for c in cases], "c string")
    assert {r.c: r.t for r in df.select("c", talk.command_token(F.col("c")).alias("t")).collect()} == cases


def test_token_count_lines(spark, tmp_path):
    use = lambda n: {"timestamp": "2026-01-01T00:00:01Z", "type": "event_msg", "payload": {"type": "token_count", "info": {"last_token_usage": {"input_tokens": n, "output_tokens": 2, "reasoning_output_tokens": 7}}, "rate_limits": {"primary": {"used_percent": 12.5, "resets_at": "x"}, "plan_type": "pro"}}}
    (tmp_path / "b.jsonl").write_text("\n".join(map(json.dumps, [{"type": "session_meta", "payload": {"id": "q"}}, use(9), {"type": "session_meta", "payload": {"id": "later"}}, use(4)])) + "\nnot json")
    rows = token_counts(spark, f"{tmp_path}/b.jsonl", model="m").orderBy("ordinal").collect()
    assert [(r.session_id, r.ordinal, r.input_tokens, r.output_tokens, r.total_tokens, r.model) for r in rows] == [("q", 1, 9, 9, 18, "m"), ("q", 2, 4, 9, 13, "m")]
    assert rows[0].attributes["primary_used_pct"] == "12.5" and rows[0].attributes["plan_type"] == "pro" and len({r.event_id for r in rows}) == 2


def test_stored_messages_requests_and_tasks(spark):
    data = lambda role, n: json.dumps({"role": role, "providerID": "OpenAI", "modelID": "m", "time": {"created": 1700000000000}, "tokens": {"input": n, "output": 2, "reasoning": 1, "cache": {"read": 3, "write": 4}}})
    rows = spark.createDataFrame([("1", "s", data("assistant", 5)), ("2", "s", data("user", 5)), ("3", "s", "{")], "id string, session_id string, data string")
    r = logs.stored_messages(rows).collect()
    assert [(x.provider, x.input_tokens, x.cached_input_tokens, x.output_tokens) for x in r] == [("openai", 12, 3, 3)]
    bodies = [({"model": "m", "messages": [{"role": "system", "content": "s"}, {"role": "user", "content": [{"type": "text", "text": "u"}]}], "stream": True}, "/v1"), ({"contents": [{"role": "user", "parts": [{"text": "a"}, {"text": "b"}]}]}, "/v1/models/gem-1:streamGenerate"), ({"prompt": "p", "max_tokens": 3, "system": "x"}, "/c"), ("junk", "/d")]
    df = spark.createDataFrame([(i, b if isinstance(b, str) else json.dumps(b), p) for i, (b, p) in enumerate(bodies)], "i int, body string, path string")
    got = {r.i: (r.model, r.stream, r.max_tokens, r.messages, r.has_system) for r in logs.requests(df).collect()}
    assert got == {0: ("m", True, None, 2, True), 1: ("gem-1", True, None, 1, False), 2: (None, False, 3, 1, True), 3: (None, False, None, 0, False)}
    texts = sorted((r.i, r.nr, r.role, r.text) for r in logs.request_messages(df.drop("path")).collect())
    assert texts == [(0, 0, "system", "s"), (0, 1, "user", "u"), (1, 0, "user", "a\nb"), (2, 0, "system", "x"), (2, 1, "user", "p")]
    marks = spark.createDataFrame([("start", "a", "one", "s", NOW), ("start", "a", "two", "s", NOW + timedelta(1)), ("done", "a", None, None, NOW + timedelta(2)), ("done", "b", None, None, NOW)], "kind string, id string, description string, session string, ts timestamp")
    assert [(r.task, r.description, r.ends - r.begins) for r in logs.tasks(marks).collect()] == [("a", "one", timedelta(2))]


def test_rule_documents(spark, tmp_path):
    (tmp_path / ".cursor/rules").mkdir(parents=True)
    for path in ("CLAUDE.md", "src/AGENTS.md", ".cursor/rules/a.mdc", "x.mcp.json", "notes.txt"):
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_text("# A\nbody\n")
    got = {r.path: (r.kind, r.scope, r.source_id) for r in logs.rule_documents(spark, str(tmp_path), "r").collect()}
    assert got == {"CLAUDE.md": ("claude_md", "repo", "r:CLAUDE.md"), "src/AGENTS.md": ("agents_md", "repo", "r:src/AGENTS.md"), ".cursor/rules/a.mdc": ("cursor_rules", "file_glob", "r:.cursor/rules/a.mdc"), "x.mcp.json": ("mcp_policy", "tool", "r:x.mcp.json")}


def test_sections_and_compression(spark):
    doc = "intro\n# A\none\n## B\n```\n# not a heading\n```\n### \n#x\n# C\n- same words in this long enough section of the text that is here twice, as it happens to be, and more words to be long enough\n# D\n* same words in this long enough section of the text that is here twice, as it happens to be, and more words to be long enough\n# E\none\n"
    assert [(a, n) for a, n, _ in rulebook.sections_of(doc)] == [("", 0), ("A", 1), ("A/B", 2), ("A/B/", 3), ("C", 1), ("D", 1), ("E", 1)]
    df = spark.createDataFrame([("d", doc), ("e", None)], "source_id string, text string")
    rows = [(r.anchor, r.reason, r.duplicate_of) for r in rulebook.compressed(df).filter("source_id = 'd'").orderBy("nr").collect()]
    assert rows[5] == ("D", "near_duplicate", "d#C") and rows[6] == ("E", "redundant", "d#A") and rows[1] == ("A", None, None)
    assert rulebook.compacted("a\n\n\n\nb  c\nb c\n\nb c\n x \n") == "a\n\nb c\n\nx"
    assert rulebook.sections(df).filter("source_id = 'e'").count() == 1


def test_relevance_and_greedy_selection(spark):
    parts = spark.createDataFrame([("Build", "use pytest here", "a/x.py", "r"), ("Other", "nothing", "b.md", "r")], "anchor string, body string, path string, repo string")
    assert [r.score for r in rulebook.relevance(parts, ["PyTest"], ["build"], ["src/y.py"], "r").collect()] == [3.5, 0.5]
    items = spark.createDataFrame([("a", 5, 3.0), ("b", 4, 2.0), ("c", 1, 1.5), ("d", 1, 0.5)], "id string, tokens long, score double")
    assert [r.id for r in rulebook.selected(items, 6).orderBy("place").collect()] == ["a", "c"]


def test_quotas(spark):
    plans = spark.createDataFrame([("a", 100, 3600), ("b", 100, 3600), ("c", 0, 0), ("d", 100, 3600)], "provider string, cap long, window_s long")
    counts = lambda **n: spark.createDataFrame(list(n.items()), "provider string, messages long")
    vendor = spark.createDataFrame([("d", 96.0, 60, "m")], "provider string, used_pct double, resets_in_s long, meter string")
    got = {r.provider: r for r in quotas.session_budget(plans, counts(a=85, b=10), counts(a=10), vendor).collect()}
    assert (got["a"].window_pct, got["a"].headroom, got["a"].rate_per_hour, got["a"].action, got["a"].confidence) == (85.0, 15, 20.0, "wait_reset", "high")
    assert (got["b"].action, got["b"].confidence) == ("continue", "low") and (got["c"].action, got["c"].window_pct) == ("unknown", None)
    assert (got["d"].action, got["d"].headroom, got["d"].resets_in_s, got["d"].confidence) == ("wait_reset", 4, 60, "high")
    head = spark.createDataFrame([("d", 10.0, "low"), ("a", 99.0, "high")], "provider string, window_pct double, risk string")
    assert {r.provider: (r.window_pct, r.risk) for r in quotas.headroom_with_reports(head, vendor).collect()} == {"d": (96.0, "high"), "a": (99.0, "high")}


def test_pricing_guard_and_pins(spark):
    rates = spark.createDataFrame([("anthropic", "m", 3.0, 15.0, 0.3), ("anthropic", "n", 3.0, 3.0, 4.0), ("x", "y", 1.0, 99.0, 2.0), ("x", "z", 0.0, 1.0, 1.0)], "provider string, pattern string, input_rate double, output_rate double, cached_rate double")
    assert sorted((r.pattern, r.field) for r in pricing.suspicious(rates).collect()) == [("n", "cached"), ("n", "cached_above_input"), ("n", "output"), ("y", "cached_above_input")]
    assert pricing.without_pinned(rates, rates.filter("provider = 'x'")).count() == 2


def test_large_cards_take_the_other_way(spark, monkeypatch):
    events = spark.createDataFrame([(i, "p", f"m-{i % 3}", NOW, 10, 0, 5, None, "metered") for i in range(9)], "event_id long, provider string, model string, ts timestamp_ntz, input_tokens long, cached_input_tokens long, output_tokens long, cost_usd double, cost_source string")
    card = pricing.rate_card(spark, [("p", "m*", "2024-01-01", 1.0, 1.0, 0.0), ("p", "m-1", "2024-01-01", 2.0, 2.0, 0.0), ("p", "m*", "2024-06-01", 9.0, 9.0, 0.0)])
    small = sorted((r.event_id, r.cost) for r in pricing.priced(events, card).collect())
    monkeypatch.setattr(pricing, "CARD_ROWS", 1)
    assert sorted((r.event_id, r.cost) for r in pricing.priced(events, card).collect()) == small
    answered = events.withColumn("response_model", F.when(F.col("event_id") == 0, "m-1").otherwise(""))
    row = pricing.priced(answered, card).filter("event_id = 0").first()
    assert (row.model, row.response_model, row.cost) == ("m-0", "m-1", 2 * 15 / 1e6)


def test_ledger(spark, tmp_path):
    path = f"{tmp_path}/events"
    rows = [(i, "prompt" if i % 2 else "coaching", NOW - timedelta(days=i)) for i in range(12)]
    events = spark.createDataFrame(rows, "event_id long, type string, ts timestamp")
    ledger.append_once(events, path)
    deleted = {r.type: r.deleted for r in ledger.apply_retention(spark, path, NOW, {"prompt": 4}, 9).collect()}
    assert deleted == {"prompt": 4, "coaching": 1}
    left = spark.read.parquet(path)
    assert sorted(r.event_id for r in left.collect()) == [0, 1, 2, 3, 4, 6, 8]
    assert [r.event_id for r in ledger.events_between(left, NOW - timedelta(days=3), NOW, type="prompt").collect()] == [3, 1]
    assert ledger.count_between(left, until=NOW).first().events == 6
    assert ledger.apply_retention(spark, path, NOW, {"prompt": 4}, 9).count() == 0
    bad = spark.createDataFrame([("", "prompt", NOW), ("a", "odd", NOW), ("b", "prompt", None), ("c", "prompt", NOW)], "event_id string, type string, ts timestamp")
    assert [r.rejected for r in ledger.checked(bad).collect()] == ["empty id", "unknown type", "no timestamp", None]
    log = spark.createDataFrame([(i, NOW + timedelta(hours=i), "login" if i % 2 else "delete", "me") for i in range(6)], "id long, ts timestamp, action string, actor string")
    assert [r.id for r in ledger.audited(log, "login", limit=2).collect()] == [5, 3]
    seen = []
    with pytest.raises(ExceptionGroup):
        ledger.fan_out(log, [lambda b: 1 / 0, lambda b: seen.append(b.count())])
    assert seen == [6]
    assert ledger.moment("7d", NOW) == NOW - timedelta(7) and ledger.moment("2024-01-01", NOW) == datetime(2024, 1, 1)
    assert ledger.bucket_and_group(None, "workflow") == ("hour", "workflow_id")
    with pytest.raises(ValueError):
        ledger.bucket_and_group("minute")
    zero = ledger.emptied(spark.createDataFrame([(0, "")], "n long, t string"), ["n"], ["t"]).first()
    assert (zero.n, zero.t) == (None, None)


def test_quota_events_and_merged_reports(spark):
    snap = spark.createDataFrame([(1, NOW, "anthropic", {"five_hour": 42.0}, {"five_hour": "2024-05-15T13:00:00Z"})], "event_id long, ts timestamp, provider string, used map<string,double>, resets map<string,string>")
    row = quotas.reported(logs.quota_events(snap, "cookie"), NOW, 5).first()
    assert (row.used_pct, row.resets_in_s, row.meter) == (42.0, 3600, "anthropic_cookie:five_hour")
    report = lambda cases, q: spark.createDataFrame([("x", cases, cases, 100.0, q, 5, 0.0)], "optimizer string, cases long, passed long, success_pct double, mean_quality double, saved long, apply_pct double")
    both = quality.merged_reports(report(1, 0.2), report(3, 0.6)).first()
    assert (both.cases, both.mean_quality, both.saved) == (4, 0.5, 10)


def test_decisions_and_scores(spark):
    cases = [("interactive", True, True, "applied"), ("interactive", True, False, "accepted"), ("interactive", None, True, "rejected"), ("replay", True, True, "skipped"), ("passive", None, False, "skipped")]
    df = spark.createDataFrame(cases, "m string, a boolean, c boolean, want string")
    assert all(r.want == r.got for r in df.select("want", quality.decision(F.col("m"), F.col("a"), F.col("c")).alias("got")).collect())
    n = spark.createDataFrame([(1, 0, 40), (3, 100, 10), (9, 100, 100)], "n int, before int, after int")
    got = [tuple(r) for r in n.select(quality.dedupe_quality(F.col("n")), quality.compress_quality(F.col("before"), F.col("after")), quality.trim_quality(F.col("n")), quality.saved_tokens(F.lit(None).cast("long"), F.lit(1), F.col("before"), F.col("after"))).collect()]
    assert [tuple(round(float(x), 9) for x in g) for g in got] == [(0.95, 1.0, 0.93, 0.0), (0.9, 0.55, 0.89, 22.0), (0.85, 0.95, 0.77, 0.0)]
    assert [r.withheld for r in quality.quality_gated(spark.createDataFrame([(0.9,), (0.8,), (None,)], "quality double")).collect()] == [False, True, True]
    assert coach.overall_grade(spark.createDataFrame([("x", None, None)], "kpi string, value double, grade string")).first().grade == "warming_up"


def test_coverage_lines(spark):
    rows = spark.createDataFrame([("mode: set",), ("a/b/f.go:1.2,3.4 3 1",), ("a/b/g.go:1.2,3.4 1 0",), ("f.go:1.1,2.2 2 0",), ("junk",)], "value string")
    assert {r.package: (r.statements, r.covered) for r in quality.coverage(rows).collect()} == {"a/b": (4, 3), "f.go": (2, 0)}


def test_streams_with_state(spark, tmp_path):
    rows = [("w" if i % 3 else "v", datetime(2024, 1, 1, 0, i), i, 0.02 * (i % 4), str(i // 5 % 2), 5, 3) for i in range(40)]
    events = spark.createDataFrame(rows, "workflow_id string, ts timestamp, event_id long, cost double, prompt_hash string, input_tokens long, output_tokens long")
    for part, (a, b) in enumerate(((0, 13), (13, 30), (30, 40))):
        events.filter(F.col("event_id").between(a, b - 1)).coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
    stream = lambda: spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    for name, df in (("tiers", state.tier_stream(stream(), "workflow_id", 0.1)), ("rereads", state.reread_stream(stream(), ["workflow_id"], "prompt_hash"))):
        df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start().awaitTermination()
    want = {(r.workflow_id, r.event_id, r.tier) for r in coach.tier_crossings(events, "workflow_id", 0.1).collect()}
    assert {(r.workflow_id, r.event_id, r.tier) for r in spark.table("tiers").collect()} == want
    repeats = sum(r.repeats for r in coach.repeat_reads(events, ["workflow_id"], "prompt_hash").collect())
    assert spark.table("rereads").count() == repeats
    state.rollup_deltas(stream(), ["workflow_id"], f"{tmp_path}/deltas", f"{tmp_path}/cp").awaitTermination()
    got = {(r.bucket, r.workflow_id): (r.requests, r.input_tokens) for r in state.rollup(spark, ["workflow_id"], f"{tmp_path}/deltas").collect()}
    assert got == {(datetime(2024, 1, 1), "w"): (26, 130), (datetime(2024, 1, 1), "v"): (14, 70)}


def test_price_snapshots(spark, tmp_path):
    (tmp_path / "2024-02-01.json").write_text('{"provider": "p", "pattern": "m", "input_rate": 1.0, "output_rate": 2.0}\njunk\n')
    row = pricing.snapshots(spark, str(tmp_path)).first()
    assert (row.taken.date(), row.pattern, row.output_rate) == (date(2024, 2, 1), "m", 2.0)


def test_waste_limits_by_start_of_the_id(spark):
    facts = spark.createDataFrame([(w, 300_000, 600_000, "a", 2, None) for w in ("claude-code:p", "codex:p", "other")], "workflow_id string, max_context long, growth long, agent_id string, run long, first_repeat long")
    found = sorted((r.workflow_id, r.finding, r.excess) for r in coach.waste(facts).collect())
    assert found == [("codex:p", "context_growth", 100_000), ("codex:p", "oversized_context", 50_000), ("other", "context_growth", 583_616), ("other", "oversized_context", 267_232)]
