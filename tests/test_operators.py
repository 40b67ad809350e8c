"""Small fixtures with results worked out by hand."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from meterlake.functions.pricing import cost, priced, rate_card, resolved
from meterlake.operators import series, text
from meterlake.sources.ledger import append_once
from meterlake.sources.usage import assistant_turns, token_counts, usage_events, without_sources
from meterlake.streaming.hourly import hourly, ingest


def test_longest_prefix_and_exact(spark):
    card = rate_card(spark, [("p", "m*", "2024-01-01", 1.0, 1.0, 0.0), ("p", "m-mini*", "2024-01-01", 2.0, 2.0, 0.0), ("p", "m-mini-1", "2024-01-01", 3.0, 3.0, 0.0)])
    models = spark.createDataFrame([("p", "m-mini-2024"), ("p", "m-x"), ("p", "m-mini-1"), ("p", "z")], "provider string, model string")
    assert {r.model: r.pattern for r in resolved(models, card).collect()} == {"m-mini-2024": "m-mini*", "m-x": "m*", "m-mini-1": "m-mini-1"}


def test_dated_cards(spark):
    card = rate_card(spark, [("p", "m", f"2024-01-0{d}", float(d), 0.0, 0.0) for d in (1, 5)])
    rows = [(i, "p", "m", datetime(2024, 1, d) if d else datetime(2023, 12, 1), 1_000_000, 0, 0, None, "metered") for i, d in enumerate((0, 1, 4, 5))]
    events = spark.createDataFrame(rows, "event_id long, provider string, model string, ts timestamp_ntz, input_tokens long, cached_input_tokens long, output_tokens long, cost_usd double, cost_source string")
    assert [r.cost for r in priced(events, card).orderBy("event_id").collect()] == [1.0, 1.0, 1.0, 5.0]


def test_cost(spark):
    row = spark.createDataFrame([(2.0, 8.0, 0.5)], "input_rate double, output_rate double, cached_rate double").select(cost(F.lit(1_000_000), F.lit(400_000), F.lit(100_000)).alias("c")).first()
    assert abs(row.c - 2.2) < 1e-9


def test_sources_keep_null(spark):
    df = spark.createDataFrame([(None,), ("demo",), ("proxy",)], "source string")
    assert sorted(map(str, (r.source for r in without_sources(df).collect()))) == ["None", "proxy"] and without_sources(df, []).count() == 3


def test_longest_run(spark):
    agents = ["a", "a", None, "a", "b", "b", "b"]
    df = spark.createDataFrame([("w", datetime(2024, 1, 1, 0, i), i, a) for i, a in enumerate(agents)], "workflow_id string, ts timestamp_ntz, event_id long, agent_id string")
    assert series.longest_runs(df).first()[1:] == ("b", 3)


def test_linear(spark):
    df = spark.createDataFrame([("k", i, float(i + 1)) for i in range(3)], "key string, at long, value double")
    assert series.linear_forecast(df, "key", 1).first().predicted == 4


def test_lines(spark):
    got = spark.createDataFrame([("x\nx\n\nx",)], "t string").select(text.compressed(F.col("t")), text.scrubbed(F.lit("\x1b[1ma \na"))).first()
    assert tuple(got) == ("x\n\nx", "a")


def test_trim(spark):
    turns = [("s", "system")] + [("t", r) for r in ["user", "assistant"] * 5]
    df = spark.createDataFrame([(1, i, r) for i, (_, r) in enumerate(turns)], "conv_id long, turn long, role string")
    assert text.trimmed(df, 4).count() == 9


def test_session_logs(spark, tmp_path):
    (tmp_path / "proj").mkdir()
    usage = {"input_tokens": 5, "output_tokens": 2, "cache_read_input_tokens": 3, "cache_creation_input_tokens": 1}
    turn = {"type": "Assistant", "timestamp": "2026-01-01T00:00:00Z", "sessionId": "s", "message": {"id": "m1", "model": "x", "usage": usage}}
    (tmp_path / "proj/a.jsonl").write_text("\n".join(map(json.dumps, [turn, turn, {**turn, "type": "user"}, {**turn, "timestamp": "bad", "message": {"id": "m2", "usage": usage}}])) + "\nnot json\n")
    row = assistant_turns(spark, f"{tmp_path}/proj/*.jsonl").collect()
    assert len(row) == 1 and (row[0].input_tokens, row[0].cached_input_tokens, row[0].project) == (9, 3, "proj")
    count = {"timestamp": "2026-01-01T00:00:01Z", "type": "event_msg", "payload": {"type": "token_count", "info": {"last_token_usage": {"input_tokens": 4, "cached_input_tokens": 1, "output_tokens": 2, "reasoning_output_tokens": 7}}}}
    (tmp_path / "b.jsonl").write_text("\n".join(map(json.dumps, [{"type": "session_meta", "payload": {"id": "q"}}, count, {**count, "timestamp": "2026-01-01T00:00:02Z"}])))
    rows = token_counts(spark, f"{tmp_path}/b.jsonl").orderBy("ordinal").collect()
    assert [(r.session_id, r.ordinal, r.output_tokens) for r in rows] == [("q", 1, 9), ("q", 2, 9)]


def test_append_once(spark, tmp_path):
    dated = lambda a, b, word: spark.range(a, b).selectExpr("id as event_id", "timestamp'2024-01-01' + make_interval(0, 0, 0, cast(id as int)) as ts", f"'{word}' as word")
    append_once(dated(0, 4, "first"), f"{tmp_path}/t")
    append_once(dated(0, 4, "again").union(dated(3, 6, "later")).union(dated(5, 6, "even later")), f"{tmp_path}/t")
    got = {r.event_id: r.word for r in spark.read.parquet(f"{tmp_path}/t").collect()}
    assert got == {0: "first", 1: "first", 2: "first", 3: "first", 4: "later", 5: "even later"}
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("day=")]) == 6


def test_stream_equals_batch(spark, tmp_path):
    events = usage_events(spark.read.parquet("/root/testdata/sf0.001/events.parquet")).withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = hourly(stream).writeStream.outputMode("complete").format("memory").queryName("hourly_out").trigger(availableNow=True).start()
    q.awaitTermination()
    want = events.groupBy(F.date_trunc("hour", "ts").alias("bucket"), "provider").agg(F.count("*").alias("requests"), F.sum("input_tokens").alias("input_tokens"))
    assert spark.table("hourly_out").exceptAll(want).isEmpty() and want.exceptAll(spark.table("hourly_out")).isEmpty()
    ingest(stream, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == events.count()
