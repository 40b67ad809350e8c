"""What a query holds in one Python worker or one task doesn't grow with its input."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from meterlake.functions import tables
from meterlake.operators import redaction, rulebook
from meterlake.plans import log_queries, more_queries, queries
from meterlake.sources import logs

TEXT = "".join(f"## Part\nline {i} of a rule\n" for i in range(400))


@pytest.fixture
def small(spark, monkeypatch):
    """Batches of about 20 kB."""
    before = spark.conf.get(tables.BATCH_BOUND, None)
    monkeypatch.setattr(tables, "BATCH_BYTES", 20_000, raising=False)
    spark.conf.unset(tables.BATCH_BOUND)
    yield
    spark.conf.unset(tables.BATCH_BOUND) if before is None else spark.conf.set(tables.BATCH_BOUND, before)


def batches(df) -> list[int]:
    """Rows of each batch that Python gets of a table in one partition."""

    def run(found):
        import pandas as pd

        yield from (pd.DataFrame({"n": [len(b)]}) for b in found)

    return [r.n for r in df.coalesce(1).mapInPandas(run, "n int").collect()]


def test_texts_come_in_small_batches(spark, small):
    docs = spark.range(40).select(F.col("id").cast("string").alias("source_id"), F.lit(TEXT).alias("text")).coalesce(1)
    assert rulebook.sections(docs).count() == 40 * 401
    assert len(batches(docs)) > 10  # it was one of 40 texts


def test_sections_are_handed_on_in_small_frames():
    frames = list(rulebook._frames(((str(i), i, "x" * 100) for i in range(1000)), ["a", "b", "c"], most=10_000))
    assert max(map(len, frames)) < 50 and sum(map(len, frames)) == 1000 and [*frames[0].columns] == ["a", "b", "c"]
    assert list(rulebook._frames(iter([]), ["a"])) == []


@pytest.fixture
def python(spark, monkeypatch):
    """The functions that are given to mapInPandas."""
    held, kind = [], type(spark.range(0))
    monkeypatch.setattr(kind, "mapInPandas", lambda self, f, schema, on=kind.mapInPandas: held.append(f) or on(self, f, schema))
    return held


def test_sections_of_one_batch_are_several_frames(spark, python):
    docs = pd.DataFrame({"source_id": [str(i) for i in range(100)], "text": TEXT})
    rulebook.sections(spark.createDataFrame(docs[:1]))
    frames = [*python[0](iter([docs]))]
    assert len(frames) > 3 and max(map(len, frames)) < 12_000  # the sections of a batch were one frame
    out = pd.concat(frames)
    assert len(out) == 100 * 401 and "".join(out[out.source_id == "7"].body) == TEXT.replace("## Part\n", "")


def test_found_terms_are_handed_on_in_small_frames(spark, python):
    n = 30_000
    parts = pd.DataFrame({"source_id": "s", "nr": range(n), "anchor": "/part", "body": "one two"})
    rulebook._found_terms(spark.createDataFrame(parts[:1]), spark.createDataFrame([("one",), ("two",), ("part",)], "term string"))
    frames = [*python[0](iter([parts]))]
    assert len(frames) > 5 and max(map(len, frames)) < 15_000  # what was found in a batch was one frame
    out = pd.concat(frames)
    assert len(out) == 3 * n and len(out.drop_duplicates(["term", "nr"])) == 3 * n and out.in_anchor.sum() == n


def test_no_task_of_routes_has_two_python_workers(spark):
    plan = more_queries.QUERIES["rule_routes"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1  # sections were cut anew before the terms were looked for, and for each join


def _most_in_a_task(df) -> float:
    sizes = [r["count"] for r in df.withColumn("part", F.spark_partition_id()).groupBy("part").count().collect()]
    return max(sizes) / sum(sizes)


@pytest.fixture
def shuffled(spark, monkeypatch):
    """Joins that aren't asked to broadcast shuffle."""
    monkeypatch.setattr(rulebook, "HOT", 50, raising=False)
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")
    before = [spark.conf.get(n) for n in names]
    for n, v in zip(names, ("-1", "false"), strict=True):
        spark.conf.set(n, v)
    yield
    for n, v in zip(names, before, strict=True):
        spark.conf.set(n, v)


def _parts(spark, body):
    rows = spark.range(0, 4000, 1, 4).select(F.col("id").cast("string").alias("source_id"), F.lit(1).alias("nr"), F.when(F.col("id") % 100 == 0, F.concat(F.lit("a"), (F.col("id") % 400).cast("string"))).otherwise("/Part").alias("anchor"), body.alias("body"))
    return rows.withColumn("hash", F.sha2("body", 256))


def test_drift_of_one_heading_is_spread(spark, shuffled):
    out = rulebook.drifting(_parts(spark, (F.col("id") % 7).cast("string"))).localCheckpoint()
    assert out.count() == 4000 and out.filter("anchor = '/part' and sections = 3960 and bodies = 7").count() == 3960
    assert out.filter("anchor <> '/part'").select("anchor", "sections").distinct().count() == 4
    assert _most_in_a_task(out) < 0.5  # all sections of the heading were in one task


def test_one_body_of_many_sections_is_spread(spark, shuffled):
    out = rulebook.redundant(_parts(spark, F.when(F.col("id") % 200 < 2, (F.col("id") % 400).cast("string")).otherwise("same"))).localCheckpoint()
    assert out.count() == 4000 and out.filter("sections = 3960").count() == 3960 and out.filter("sections = 10").count() == 40
    assert _most_in_a_task(out) < 0.5


def test_sections_that_stay_are_spread(spark, shuffled, monkeypatch):
    """They repeat none, and rows without an owner were all joined in one task."""
    held = {}
    monkeypatch.setattr(rulebook, "written", lambda df, name: held.setdefault(name, df.localCheckpoint()))
    parts = spark.range(0, 400, 1, 4).select((F.col("id") % 50).cast("string").alias("source_id"), F.col("id").cast("int").alias("nr"), F.lit("").alias("anchor"), F.col("id").cast("string").alias("body"))
    assert rulebook.compressed_corpus(parts).filter("reason is null and duplicate_of is null").count() == 400
    assert _most_in_a_task(held["compressed"]) < 0.6


def test_events_are_redacted_by_one_function(spark):
    none = F.lit(None)
    lists = {"conflicts_with": F.array(F.lit("x"), none, F.lit("b.c@example.org")), "attributes": F.create_map(F.lit("note"), F.lit("c.d@example.org"), F.lit("none"), none), "redundant_with": none.cast("array<string>")}
    out = redaction.redacted_events(spark.range(2).select("id", F.when(F.col("id") == 0, "mail a.b@example.org").alias("summary")).withColumns(lists))
    a, b = out.orderBy("id").collect()
    assert (a.summary, b.summary) == ("mail <redacted:email>", None)
    assert a.conflicts_with == ["x", None, "<redacted:email>"] and a.attributes == {"note": "<redacted:email>", "none": None} and a.redundant_with is None
    # a worker for each function in every task: there were four
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_each_stored_text_is_parsed_once(spark):
    data = [("1", "s", '{"role":"assistant","time":{"created":1700000000123},"providerID":"X","modelID":"m","tokens":{"input":"7","output":2,"cache":{"read":1}}}'), ("2", "s", "no json"), ("3", "s", '{"role":"assistant","tokens":5}'), ("4", "s", None)]
    out = logs.stored_messages(spark.createDataFrame(data, "id string, session_id string, data string"))
    (r,) = out.collect()
    assert (r.provider, r.model, r.input_tokens, r.cached_input_tokens, r.output_tokens) == ("x", "m", 8, 1, 2)
    assert "get_json_object" not in out._jdf.queryExecution().optimizedPlan().toString()  # it was there 15 times


def test_sessions_are_no_files(spark, monkeypatch):
    """A folder and a file for each session took most of the time."""
    monkeypatch.setattr(log_queries, "_text_files", lambda *_: pytest.fail("a file for each session"))
    assert log_queries.QUERIES["count_logs"](spark, "/root/testdata/sf0.001").count() > 0


@pytest.mark.parametrize("name", ["tool_output_sniffed", "tool_output_reduce"])
def test_outputs_are_spread(spark, monkeypatch, name):
    """The table of parts is small, so that a task or two had all rows."""
    monkeypatch.setattr(queries, "spread", lambda df, rows: tables.spread(df, 50), raising=False)
    assert _most_in_a_task(queries.QUERIES[name](spark, "/root/testdata/sf0.001").localCheckpoint()) < 0.6
