"""Usage events: one row per metered request, and the readers that bring session logs into that shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Sources that a spend question leaves out unless told otherwise.
SYNTHETIC = ["demo"]


def usage_events(events: DataFrame) -> DataFrame:
    """The `events` table as usage events; the JSON property is lifted to a column once."""
    k = F.get_json_object("props", "$.k").cast("long")
    family = F.create_map(*[F.lit(x) for pair in (("click", "openai"), ("view", "anthropic"), ("purchase", "gemini"), ("signup", "mistral")) for x in pair])
    model = F.create_map(*[F.lit(x) for pair in (("click", "gpt"), ("view", "claude"), ("purchase", "gemini"), ("signup", "mistral")) for x in pair])
    kind = F.col("event_type")
    out = events.select("event_id", "ts", "user_id", "value", kind, k.alias("k"))
    out = out.withColumns(
        {
            "provider": F.coalesce(F.try_element_at(family, kind), F.lit("cohere")),
            "model": F.concat_ws("-", F.coalesce(F.try_element_at(model, kind), F.lit("nova")), (F.col("user_id") % 3).cast("string")),
            "input_tokens": F.floor(F.col("value") * 100).cast("long"),
            "output_tokens": F.floor(F.col("value") * 10).cast("long"),
        }
    )
    return out.withColumns(
        {
            "cached_input_tokens": F.expr("input_tokens * k div 100"),
            "workflow_id": F.concat(F.lit("wf-"), F.col("user_id").cast("string")),
            "agent_id": F.when(F.col("k") % 11 != 0, F.concat(F.lit("agent-"), (F.col("user_id") % 7).cast("string"))),
            "session_id": F.concat_ws("-", F.col("user_id").cast("string"), F.to_date("ts").cast("string")),
            "prompt_hash": (F.col("k") % 5).cast("string"),
            "cost_source": F.when(F.col("k") < 20, "plan_included").when(F.col("k") < 25, "trial").otherwise("metered"),
            "cost_usd": F.when(F.col("k") % 4 != 0, F.round(F.col("value") * F.lit(0.001), 6)),
            "source": F.when(F.col("k") % 10 == 9, "demo").when(F.col("k") % 10 != 8, "proxy"),
        }
    ).drop("value", "event_type")


def without_sources(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Rows whose source is null or none of names (None: the synthetic ones; []: nothing is left out)."""
    names = SYNTHETIC if names is None else names
    return df.filter(F.col("source").isNull() | ~F.col("source").isin(names)) if names else df


def filtered(df: DataFrame, since=None, until=None, **equal) -> DataFrame:
    """Conjunctive filter: half-open [since, until) and equality on columns; None means no condition."""
    if since is not None:
        df = df.filter(F.col("ts") >= F.lit(since))
    if until is not None:
        df = df.filter(F.col("ts") < F.lit(until))
    for name, value in equal.items():
        if value is not None:
            df = df.filter(F.col(name) == value)
    return df


def assistant_turns(spark: SparkSession, glob: str) -> DataFrame:
    """Session logs of one kind (a JSON object a line): assistant messages with an id and tokens, once each.

    input = uncached + cache reads + cache writes; the project is the parent folder's name.
    """
    schema = "type string, timestamp string, sessionId string, message struct<id:string,model:string,usage:struct<input_tokens:long,output_tokens:long,cache_read_input_tokens:long,cache_creation_input_tokens:long>>"
    raw = spark.read.schema(schema).option("mode", "PERMISSIVE").json(glob).withColumn("project", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))
    use = F.col("message.usage")
    n = {c: F.coalesce(use[c], F.lit(0)) for c in ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens")}
    ts = F.try_to_timestamp(F.col("timestamp"))
    rows = raw.filter((F.lower("type") == "assistant") & (F.coalesce(F.col("message.id"), F.lit("")) != "") & ts.isNotNull() & (sum(n.values()) > 0))
    session = F.coalesce("sessionId", F.lit(""))
    out = rows.select(
        F.concat(F.lit("ccj-"), F.substring(F.sha2(F.col("message.id"), 256), 1, 16)).alias("event_id"),
        ts.alias("ts"),
        F.col("sessionId").alias("session_id"),
        "project",
        F.concat_ws(":", F.lit("claude-code"), "project", session).alias("workflow_id"),
        F.lit("claude-code").alias("agent_id"),
        F.col("message.model").alias("model"),
        (n["input_tokens"] + n["cache_read_input_tokens"] + n["cache_creation_input_tokens"]).alias("input_tokens"),
        n["cache_read_input_tokens"].alias("cached_input_tokens"),
        n["output_tokens"].alias("output_tokens"),
        F.create_map(F.lit("granularity"), F.lit("assistant_turn")).alias("attributes"),
    )
    first = F.min_by(F.struct(*out.columns[1:-1]), F.struct("ts", "session_id", "project"))  # of a message in several files the first in time
    once = out.groupBy("event_id").agg(first.alias("r"), F.any_value("attributes").alias("attributes"))
    return once.select("event_id", "r.*", "attributes")


def token_counts(spark: SparkSession, glob: str, model: str | None = None, provider: str = "openai") -> DataFrame:
    """`counts_of` log files, a session each."""
    return counts_of(spark.read.text(glob, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value"), model, provider)


def counts_of(logs: DataFrame, model: str | None = None, provider: str = "openai") -> DataFrame:
    """Session logs of another kind (file, value: its whole text), as files or as rows of an archive: token counts numbered by their place in the log; reasoning counts as output.

    The session is that of the file's first head line. Lines are numbered in the file, so counts of
    the same time keep their order. model: for lines that name none. attributes: what the log says
    of the rate limits.
    """
    limit = "struct<used_percent:double,window_minutes:long,resets_at:string>"
    schema = f"timestamp string, type string, payload struct<id:string,type:string,model:string,info:struct<last_token_usage:struct<input_tokens:long,cached_input_tokens:long,output_tokens:long,reasoning_output_tokens:long>,model_context_window:long>,rate_limits:struct<primary:{limit},secondary:{limit},plan_type:string>>"
    # whole files: a line's place is part of the record
    files = logs.select("file", F.posexplode(F.split("value", "\n")).alias("line", "value"))
    raw = files.withColumn("j", F.from_json("value", schema)).select("file", "line", "j.*")
    heads = raw.filter("type = 'session_meta'").groupBy("file").agg(F.min_by("payload.id", "line").alias("session_id"))
    use, limits = F.col("payload.info.last_token_usage"), F.col("payload.rate_limits")
    rows = raw.filter((F.col("payload.type") == "token_count") & use.isNotNull())
    order = Window.partitionBy("file").orderBy("line")
    output = F.coalesce(use["output_tokens"], F.lit(0)) + F.coalesce(use["reasoning_output_tokens"], F.lit(0))
    pairs = [("granularity", F.lit("assistant_turn")), ("plan_type", limits["plan_type"]), ("context_window", F.col("payload.info.model_context_window"))]
    pairs += [(f"{w}_{to}", limits[w][name]) for w in ("primary", "secondary") for to, name in (("used_pct", "used_percent"), ("window_minutes", "window_minutes"), ("resets_at", "resets_at"))]
    attributes = F.map_filter(F.create_map(*[x for k, v in pairs for x in (F.lit(k), v.cast("string"))]), lambda _, v: v.isNotNull())
    numbered = rows.join(heads, "file", "left").withColumn("ordinal", F.row_number().over(order))
    return numbered.select(
        F.concat(F.lit("cdx-"), F.substring(F.sha2(F.concat_ws(":", F.coalesce("session_id", "file"), F.col("ordinal").cast("string")), 256), 1, 16)).alias("event_id"),
        "session_id",
        "ordinal",
        F.try_to_timestamp(F.col("timestamp")).alias("ts"),
        F.lit(provider).alias("provider"),
        F.coalesce("payload.model", F.lit(model)).alias("model"),
        use["input_tokens"].alias("input_tokens"),
        use["cached_input_tokens"].alias("cached_input_tokens"),
        output.alias("output_tokens"),
        (F.coalesce(use["input_tokens"], F.lit(0)) + output).alias("total_tokens"),
        attributes.alias("attributes"),
    )
