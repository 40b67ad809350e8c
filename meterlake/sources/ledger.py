"""The event table: validation, appending once, retention, reading, stamping, auditing, export. Partitioned by day."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Kinds of events that the table takes.
TYPES = ["prompt", "workflow", "optimization", "coaching", "rule_source", "rule_analysis"]


def checked(events: DataFrame) -> DataFrame:
    """events with `rejected`: why a row can't be stored (no id, no time, a kind that isn't known), null if it can."""
    why = F.when(F.coalesce("event_id", F.lit("")) == "", "empty id") if dict(events.dtypes)["event_id"] == "string" else F.when(F.col("event_id").isNull(), "empty id")
    why = why.when(F.col("ts").isNull(), "no timestamp")
    return events.withColumn("rejected", why.when(~F.coalesce(F.col("type").isin(TYPES), F.lit(False)), "unknown type") if "type" in events.columns else why)


def emptied(events: DataFrame, counters: list[str], texts: list[str]) -> DataFrame:
    """Counters of 0 and empty texts as null, the form in which they are stored."""
    return events.withColumns({**{c: F.nullif(c, F.lit(0)) for c in counters}, **{c: F.nullif(c, F.lit("")) for c in texts}})


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def append_once(batch: DataFrame, path: str, key: str = "event_id", order: str = "ts", everywhere: bool = False) -> None:
    """Appends the rows whose key isn't in the table yet; of a key's rows in the batch the first by `order` and then by content.

    An event that keeps its time can only be among those of its day, so only those partitions are
    read. everywhere: a key counts whatever its day; then the key column of the whole table is
    read. A batch that comes twice changes nothing.
    """
    spark = batch.sparkSession
    replayed_retention(spark, path)
    dated = batch.withColumn("day", F.to_date(order))
    whole = F.to_json(F.struct(*[F.col(c) for c in batch.columns]))
    by = [key] if everywhere else ["day", key]
    fresh = dated.groupBy(*by).agg(F.min_by(F.struct(*dated.columns), F.struct(order, whole)).alias("r")).select("r.*")
    if _exists(spark, path):
        seen = spark.read.parquet(path)
        if not everywhere:
            days = [r.day for r in dated.select("day").distinct().collect()]  # the days of one batch
            seen = seen.filter(F.col("day").isin(days))
        fresh = fresh.join(seen.select(*by), by, "left_anti")
    fresh.write.mode("append").partitionBy("day").parquet(path)


def events_between(table: DataFrame, since=None, until=None, limit: int | None = None, **equal) -> DataFrame:
    """Events in [since, until) that meet the conditions, in order of time, then id; `limit` of them if given. On a table by day only its days are read."""
    df = table
    if since is not None:
        df = df.filter(F.col("ts") >= F.lit(since))
        df = df.filter(F.col("day") >= F.lit(since).cast("date")) if "day" in table.columns else df
    if until is not None:
        df = df.filter(F.col("ts") < F.lit(until))
        df = df.filter(F.col("day") <= F.lit(until).cast("date")) if "day" in table.columns else df
    for name, value in equal.items():
        if value is not None:
            df = df.filter(F.col(name) == value)
    out = df.orderBy("ts", "event_id")
    return out.limit(limit) if limit is not None else out


def count_between(table: DataFrame, since=None, until=None, **equal) -> DataFrame:
    """One row: how many events meet the conditions."""
    return events_between(table, since, until, **equal).agg(F.count("*").alias("events"))


def _removed(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _mark(spark: SparkSession, copy: str, touched: list) -> None:
    """The copy is whole from here on: these days are to be replaced from it."""
    spark.createDataFrame([(d,) for d in touched], "day date").coalesce(1).write.parquet(f"{copy}/days")


def _put_back(spark: SparkSession, path: str, copy: str) -> None:
    """Each marked day is replaced by what the copy has of it; doing it twice gives the same."""
    days = [r.day for r in spark.read.parquet(f"{copy}/days").collect()]
    left = spark.read.schema(spark.read.parquet(path).schema).parquet(f"{copy}/rows")
    left.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
    full = {r.day for r in left.select("day").distinct().collect()}
    for d in days:
        if d not in full:
            _removed(spark, f"{path.rstrip('/')}/day={d}")


def _cleared(spark: SparkSession, copy: str) -> None:
    """Without its mark a copy counts no more, so the mark goes first."""
    _removed(spark, f"{copy}/days")
    _removed(spark, copy)


def replayed_retention(spark: SparkSession, path: str) -> None:
    """Ends what a retention that stopped half way has begun: a marked copy is put back, one without a mark goes."""
    table = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path.rstrip("/"))
    store = table.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if table.getParent() is None or not store.exists(table.getParent()):
        return
    begin = f"{table.getName()}.retention-"
    for copy in sorted(x.getPath().toString() for x in store.listStatus(table.getParent()) if x.getPath().getName().startswith(begin)):
        if _exists(spark, f"{copy}/days/_SUCCESS"):
            _put_back(spark, path, copy)
        _cleared(spark, copy)


def apply_retention(spark: SparkSession, path: str, now, days: dict[str, int], default: int, column: str = "type") -> DataFrame:
    """Deletes what is older than each kind is kept; returns (column, deleted).

    Only the partitions that hold such rows are written again, each to replace itself, from a copy
    beside the table, one for each run. A run that stops leaves a copy that the next retention or
    append puts in place, or drops if it isn't whole, before it does anything else.
    """
    replayed_retention(spark, path)
    keep = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in days.items() for x in kv]), F.col(column)), F.lit(default))
    old = F.col("ts") < F.lit(now) - F.make_dt_interval(keep)
    table = spark.read.parquet(path)
    shortest = min([*days.values(), default])
    due = table.filter(F.col("day") <= F.date_sub(F.lit(now).cast("date"), shortest))
    counts = due.filter(old).groupBy(column, "day").agg(F.count("*").alias("deleted")).collect()  # kinds times days
    touched = sorted({r.day for r in counts})
    if touched:
        copy = f"{path.rstrip('/')}.retention-{uuid.uuid4().hex}"
        due.filter(F.col("day").isin(touched) & ~F.coalesce(old, F.lit(False))).write.parquet(f"{copy}/rows")
        _mark(spark, copy, touched)
        _put_back(spark, path, copy)
        _cleared(spark, copy)
    total: dict[str, int] = {}
    for r in counts:
        total[r[column]] = total.get(r[column], 0) + r.deleted
    return spark.createDataFrame(sorted(total.items(), key=str), f"{column} string, deleted long")


def stamped(events: DataFrame, planned: list[str]) -> DataFrame:
    """Prompt events without a cost source whose provider has a plan are covered by it."""
    free = (F.coalesce("cost_source", F.lit("")) == "") & F.col("provider").isin(planned)
    if "type" in events.columns:
        free = free & (F.col("type") == "prompt")
    return events.withColumn("cost_source", F.when(free, "plan_included").otherwise(F.col("cost_source")))


def audited(log: DataFrame, action: str | None = None, actor: str | None = None, since=None, until=None, limit: int = 100) -> DataFrame:
    """The last entries of an audit log that meet the conditions, newest first; ties by id."""
    df = log
    for name, value in (("action", action), ("actor", actor)):
        df = df.filter(F.col(name) == value) if value is not None else df
    df = df.filter(F.col("ts") >= F.lit(since)) if since is not None else df
    df = df.filter(F.col("ts") < F.lit(until)) if until is not None else df
    return df.orderBy(F.desc("ts"), "id").limit(limit)


def log_records(events: DataFrame, body: list[str], resource: dict[str, str] | None = None) -> DataFrame:
    """(ts, record): each event as a log record in JSON, its columns as attributes, nulls left out."""

    def attribute(name: str) -> Column:
        value = F.struct(F.col(name).cast("string").alias("stringValue"))
        return F.when(F.col(name).isNotNull(), F.struct(F.lit(name).alias("key"), value.alias("value")))

    fixed = [F.struct(F.lit(k).alias("key"), F.struct(F.lit(v).alias("stringValue")).alias("value")) for k, v in (resource or {}).items()]
    attributes = F.array_compact(F.array(*[attribute(c) for c in body], *fixed))
    nanos = (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).cast("string")
    return events.select("ts", F.to_json(F.struct(nanos.alias("timeUnixNano"), attributes.alias("attributes"))).alias("record"))


def fan_out(batch: DataFrame, sinks: list) -> None:
    """Gives a batch to several sinks (callables); one that fails doesn't keep the others from it, and the errors come together."""
    kept = batch.persist()
    errors = []
    try:
        for sink in sinks:
            try:
                sink(kept)
            except Exception as e:
                errors.append(e)
    finally:
        kept.unpersist()
    if errors:
        raise ExceptionGroup("sinks failed", errors)


def kind_counts(events: DataFrame, column: str = "kind") -> DataFrame:
    return events.groupBy(column).agg(F.count("*").alias("events"))


def session_ledger(entries: DataFrame, key: str = "session", amount: str = "cost_usd") -> DataFrame:
    """One row: entries, sessions and the sum of a ledger."""
    return entries.agg(F.count("*").alias("entries"), F.count_distinct(key).alias("sessions"), F.coalesce(F.sum(F.col(amount).cast("decimal(18,9)")).cast("double"), F.lit(0.0)).alias("total"))


def moment(text: str, now):
    """A time: ISO 8601, or so far before now, as 7d, 12h, 30m, 90s."""
    from datetime import datetime, timedelta

    units = {"d": "days", "h": "hours", "m": "minutes", "s": "seconds"}
    if text and text[-1] in units and text[:-1].replace(".", "", 1).isdigit():
        return now - timedelta(**{units[text[-1]]: float(text[:-1])})
    return datetime.fromisoformat(text)


def bucket_and_group(bucket: str | None = None, group: str | None = None) -> tuple[str, str | None]:
    """The names of a bucket width (hour by default) and a grouping column (none by default)."""
    columns = {"": None, "none": None, "provider": "provider", "model": "model", "workflow": "workflow_id", "agent": "agent_id"}
    if (bucket or "hour") not in ("hour", "day") or (group or "") not in columns:
        raise ValueError(f"unknown bucket or group: {bucket}, {group}")
    return bucket or "hour", columns[group or ""]


def coalesced_counter(payload: str, attributes: str, first: str, second: str) -> Column:
    """A counter that is a field of a JSON payload, or if that is missing or 0 an attribute; 0 where neither is a number."""
    one = F.expr(f"nullif(try_cast(get_json_object({payload}, '$.{first}') as bigint), 0)")
    return F.coalesce(one, F.expr(f"try_cast(get_json_object({attributes}, '$.{second}') as bigint)"), F.lit(0))
