"""Readers of session logs, message stores, caches and rule documents. Lines are JSON in a column `value`; a line that isn't JSON gives no row."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK = "array<struct<type:string,id:string,tool_use_id:string,name:string,text:string,is_error:boolean,input:string,content:string>>"


def lines(spark: SparkSession, glob: str) -> DataFrame:
    """(value, file, session): session is the file's name without its ending."""
    raw = spark.read.text(glob).withColumn("file", F.col("_metadata.file_path"))
    return raw.withColumn("session", F.regexp_extract("file", r"([^/]*?)(\.[^./]*)?$", 1))


def flat_content(content: Column) -> Column:
    """The text of message content in JSON: a string as it is, an array's text parts with line ends between; else empty."""
    parts = F.from_json(content, "array<struct<type:string,text:string>>")
    joined = F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: F.coalesce(p["text"], F.lit(""))), "\n")
    return F.when(content.startswith("["), F.coalesce(joined, F.lit(""))).otherwise(F.coalesce(content, F.lit("")))


def _messages(rows: DataFrame) -> DataFrame:
    get = lambda path: F.get_json_object("value", path)
    session = F.coalesce(get("$.sessionId"), F.col("session") if "session" in rows.columns else F.lit(None).cast("string"))
    return rows.select(F.lower(get("$.type")).alias("type"), session.alias("session"), F.try_to_timestamp(get("$.timestamp")).alias("ts"), get("$.message.role").alias("role"), get("$.message.content").alias("content"))


def is_synthetic(text: Column) -> Column:
    """What a tool has put into a user's turn: blank texts, those that begin with a tag, and tool results."""
    t = F.regexp_replace(text, r"\A\s+|\s+\z", "")
    return (t == "") | t.startswith("<") | t.contains("tool_use_id")


def user_prompts(rows: DataFrame) -> DataFrame:
    """(session, ts, text) of what users wrote."""
    found = _messages(rows).filter("type = 'user' and ts is not null").select("session", "ts", flat_content(F.col("content")).alias("text"))
    return found.filter(~is_synthetic(F.col("text")))


def assistant_replies(rows: DataFrame) -> DataFrame:
    """(session, ts, text) of the assistant's texts that aren't blank."""
    found = _messages(rows).filter("type = 'assistant' and ts is not null").select("session", "ts", flat_content(F.col("content")).alias("text"))
    return found.filter(F.btrim("text", F.lit(" \t\r\n")) != "")


def content_blocks(rows: DataFrame) -> DataFrame:
    """(session, ts, role, kind, id, name, command, path, ranged, content, is_error): the parts of each message's content array.

    For a call id is its own, for a result that of the call.
    """
    m = _messages(rows).filter(F.col("content").startswith("["))
    b = m.select("session", "ts", "role", F.explode(F.from_json("content", BLOCK)).alias("b"))
    arg = lambda name: F.get_json_object("b.input", f"$.{name}")
    return b.select(
        "session",
        "ts",
        "role",
        F.col("b.type").alias("kind"),
        F.coalesce("b.id", "b.tool_use_id").alias("id"),
        F.col("b.name").alias("name"),
        arg("command").alias("command"),
        arg("file_path").alias("path"),
        (arg("offset").isNotNull() | arg("limit").isNotNull()).alias("ranged"),
        F.when(F.col("b.type") == "text", F.col("b.text")).otherwise(flat_content(F.col("b.content"))).alias("content"),
        F.coalesce("b.is_error", F.lit(False)).alias("is_error"),
    )


def tool_events(rows: DataFrame) -> DataFrame:
    """(session, ts, kind, id, name, command, is_error) of tool calls and results."""
    kind = F.when(F.col("kind") == "tool_use", "use").when(F.col("kind") == "tool_result", "result")
    return content_blocks(rows).select("session", "ts", kind.alias("kind"), "id", "name", F.when(F.col("name") == "Bash", F.col("command")).alias("command"), "is_error").filter("kind is not null and ts is not null")


def stored_messages(rows: DataFrame) -> DataFrame:
    """Usage events of a message store's rows (id, session_id, data: JSON): the assistant's with tokens."""
    # each text is parsed once; leaves stay strings, as some stores quote their numbers
    shape = "struct<role:string,time:struct<created:string>,providerID:string,modelID:string,tokens:struct<input:string,output:string,reasoning:string,cache:struct<read:string,write:string>>>"
    parsed = rows.select("id", "session_id", F.from_json("data", shape).alias("d")).filter("d.role = 'assistant'")
    number = lambda path: F.coalesce(F.col(f"d.{path}").try_cast("bigint"), F.lit(0))
    paths = {"input": "tokens.input", "output": "tokens.output", "reasoning": "tokens.reasoning", "read": "tokens.cache.read", "write": "tokens.cache.write"}
    n = {c: F.col(c) for c in paths}
    out = parsed.withColumns({c: number(path) for c, path in paths.items()}).filter(sum(n.values()) > 0)
    return out.select(
        F.concat(F.lit("oc-"), F.substring(F.sha2(F.col("id"), 256), 1, 16)).alias("event_id"),
        F.timestamp_millis(F.col("d.time.created").try_cast("bigint")).alias("ts"),
        "session_id",
        F.lower("d.providerID").alias("provider"),
        F.col("d.modelID").alias("model"),
        (n["input"] + n["read"] + n["write"]).alias("input_tokens"),
        n["read"].alias("cached_input_tokens"),
        (n["output"] + n["reasoning"]).alias("output_tokens"),
    )


def daily_deltas(snapshots: DataFrame) -> DataFrame:
    """(day, model, input_tokens, output_tokens) that snapshots of running totals add.

    snapshots: taken, day, model, tokens (of that day so far), lifetime_input, lifetime_output. A
    snapshot's growth over the one before it of the same day and model is dealt to input and
    output as over the model's lifetime, 1 to 99 if that is unknown; integer division. A fall counts as nothing.
    """
    w = Window.partitionBy("day", "model").orderBy("taken")
    grown = snapshots.withColumn("delta", F.col("tokens") - F.coalesce(F.lag("tokens").over(w), F.lit(0))).filter("delta > 0")
    total = F.coalesce("lifetime_input", F.lit(0)) + F.coalesce("lifetime_output", F.lit(0))
    grown = grown.withColumn("total", total).withColumn("part", F.when(F.col("total") > 0, F.expr("delta * lifetime_input div total")).otherwise(F.expr("delta div 100")))
    return grown.groupBy("day", "model").agg(F.sum("part").alias("input_tokens"), F.sum(F.col("delta") - F.col("part")).alias("output_tokens"))


def quota_events(snapshots: DataFrame, source: str) -> DataFrame:
    """Events without tokens that carry a vendor's quota report (event_id, ts, provider, used: map of name to percentage, resets: map of name to time) as attributes."""
    pct = F.transform_keys(F.transform_values("used", lambda _, v: v.cast("string")), lambda k, _: F.concat(k, F.lit("_used_pct")))
    reset = F.transform_keys(F.transform_values("resets", lambda _, v: v.cast("string")), lambda k, _: F.concat(k, F.lit("_reset_at")))
    extra = F.create_map(F.lit("granularity"), F.lit("quota_snapshot"))
    return snapshots.select("event_id", "ts", "provider", F.lit(source).alias("source"), F.lit(0).cast("long").alias("input_tokens"), F.lit(0).cast("long").alias("output_tokens"), F.map_concat(pct, F.coalesce(reset, F.create_map().cast("map<string,string>")), extra).alias("attributes"))


def requests(rows: DataFrame, body: str = "body", path: str = "path") -> DataFrame:
    """rows with model, stream, max_tokens, messages and has_system of their JSON request bodies, in any of the usual shapes; the model may stand in the path."""
    get = lambda p: F.get_json_object(body, p)
    number = lambda *ps: F.coalesce(*[F.expr(f"try_cast(get_json_object({body}, '{p}') as bigint)") for p in ps])
    count = lambda p: F.size(F.from_json(get(p), "array<string>"))
    first = F.lower(F.coalesce(get("$.messages[0].role"), F.lit("")))
    system = get("$.system").isNotNull() | get("$.systemInstruction").isNotNull() | get("$.system_instruction").isNotNull() | get("$.preamble").isNotNull() | get("$.instructions").isNotNull() | first.isin("system", "developer")
    in_path = F.nullif(F.regexp_extract(path, r"/models/([^/:]+)", 1), F.lit(""))
    messages = F.coalesce(*[F.when(count(p) >= 0, count(p)) for p in ("$.messages", "$.contents", "$.input")], F.size(F.from_json(get("$.chat_history"), "array<string>")) + 1, F.when(F.coalesce(get("$.prompt"), get("$.message"), get("$.input")).isNotNull(), 1), F.lit(0))
    return rows.withColumns(
        {
            "model": F.coalesce(get("$.model"), in_path),
            "stream": F.coalesce(F.lower(get("$.stream")) == "true", F.lit(False)) | F.coalesce(F.col(path), F.lit("")).contains(":stream"),
            "max_tokens": number("$.max_tokens", "$.max_completion_tokens", "$.max_output_tokens", "$.generationConfig.maxOutputTokens"),
            "messages": messages,
            "has_system": system,
        }
    )


def request_messages(rows: DataFrame, body: str = "body") -> DataFrame:
    """(…, nr, role, text): the messages of JSON request bodies of three shapes, content flattened; a system text of its own comes first."""
    others = [c for c in rows.columns if c != body]
    get = lambda p: F.get_json_object(body, p)
    chat = F.transform(F.from_json(get("$.messages"), "array<struct<role:string,content:string>>"), lambda m: F.struct(m["role"].alias("role"), flat_content(m["content"]).alias("text")))
    parts = lambda c: F.array_join(F.transform(c["parts"], lambda p: F.coalesce(p["text"], F.lit(""))), "\n")
    contents = F.transform(F.from_json(get("$.contents"), "array<struct<role:string,parts:array<struct<text:string>>>>"), lambda c: F.struct(F.coalesce(c["role"], F.lit("user")).alias("role"), parts(c).alias("text")))
    single = F.coalesce(get("$.prompt"), get("$.input"))
    one = F.when(single.isNotNull(), F.array(F.struct(F.lit("user").alias("role"), single.alias("text"))))
    head = F.when(get("$.system").isNotNull(), F.array(F.struct(F.lit("system").alias("role"), flat_content(get("$.system")).alias("text")))).otherwise(F.array().cast("array<struct<role:string,text:string>>"))
    all_ = F.concat(head, F.coalesce(chat, contents, one, F.array().cast("array<struct<role:string,text:string>>")))
    return rows.select(*others, F.posexplode(all_).alias("nr", "m")).select(*others, "nr", "m.role", "m.text")


def tasks(markers: DataFrame) -> DataFrame:
    """(task, description, session, begins, ends) of start and done markers (kind, id, description, session, ts): the first start of an id and its last done; without a start no row."""
    start, done = F.col("kind") == "start", F.col("kind") == "done"
    first = F.min_by(F.when(start, F.struct("description", "session", "ts")), F.when(start, F.col("ts")))
    out = markers.groupBy(F.col("id").alias("task")).agg(first.alias("s"), F.max(F.when(done, F.col("ts"))).alias("ends"))
    return out.filter("s is not null").select("task", "s.description", "s.session", F.col("s.ts").alias("begins"), "ends")


# Where rule documents lie below a repository.
RULE_FILES = r"(?i)(^|/)(CLAUDE\.md|AGENTS\.md|mcp\.policy\.yaml|[^/]*\.mcp\.(yaml|yml|json)|CONTRIBUTING\.md|CONVENTIONS\.md)$|(^|/)\.cursor/rules/.+\.(md|mdc)$"


def rule_documents(spark: SparkSession, root: str, repo: str = "") -> DataFrame:
    """(source_id, repo, path, kind, scope, text) of the rule documents below a folder, whole texts.

    Spark passes over folders whose name begins with a dot, so those that may hold rules are named to it, three levels down.
    """
    from ..operators.rulebook import default_scope, source_id, source_kind

    jvm = spark.sparkContext._jvm
    hidden = []
    for above in ("", "*/", "*/*/", "*/*/*/"):
        at = jvm.org.apache.hadoop.fs.Path(f"{root}/{above}.cursor/rules")
        hidden += [str(f.getPath()) for f in at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at) or []]
    raw = spark.read.option("recursiveFileLookup", "true").text([root, *hidden], wholetext=True).withColumn("file", F.col("_metadata.file_path"))
    path = F.regexp_replace("file", "^.*?" + re.escape(root.strip("/")) + "/+", "")
    out = raw.withColumn("path", path).filter(F.col("path").rlike(RULE_FILES)).withColumn("repo", F.lit(repo))
    kind = source_kind(F.col("path"))
    return out.select(source_id(F.col("repo"), F.col("path")).alias("source_id"), "repo", "path", kind.alias("kind"), default_scope(kind).alias("scope"), F.col("value").alias("text"))
