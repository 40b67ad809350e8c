"""Streams with state of their own: tiers of running cost by key, repeated reads, and rollups kept as deltas."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tier_stream(stream: DataFrame, key: str, tier_usd: float) -> DataFrame:
    """(key, event_id, tier) for each event at which a key's running cost enters a higher tier than ever before.

    State is two numbers a key: the sum in nano-dollars and the highest tier. Events of a
    micro-batch are taken in order of ts and event_id; those of a later one come after them.
    """

    def run(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total, highest = state.get if state.exists else (0, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = []
        for event, cost in zip(rows["event_id"], rows["cost"], strict=True):
            total += round(cost * 1e9)
            tier = math.floor(total / 1e9 / tier_usd)
            if tier > highest:
                highest = tier
                out.append((keys[0], event, tier))
        state.update((total, highest))
        yield pd.DataFrame(out, columns=[key, "event_id", "tier"])

    kinds = dict(stream.dtypes)
    return stream.select(key, "ts", "event_id", "cost").groupBy(key).applyInPandasWithState(run, f"{key} {kinds[key]}, event_id {kinds['event_id']}, tier long", "total long, highest long", "append", GroupStateTimeout.NoTimeout)


def reread_stream(stream: DataFrame, keys: list[str], fingerprint: str) -> DataFrame:
    """(keys, event_id) for each read that finds the fingerprint of the read before of the same keys; state is one fingerprint for each combination."""

    def run(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = []
        for event, found in zip(rows["event_id"], rows[fingerprint], strict=True):
            if found is not None and found == last:
                out.append((*group, event))
            last = found
        state.update((last,))
        yield pd.DataFrame(out, columns=[*keys, "event_id"])

    kinds = dict(stream.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in [*keys, "event_id"])
    return stream.select(*keys, "ts", "event_id", fingerprint).groupBy(*keys).applyInPandasWithState(run, schema, f"last {kinds[fingerprint]}", "append", GroupStateTimeout.NoTimeout)


def rollup_deltas(stream: DataFrame, keys: list[str], path: str, checkpoint: str, bucket: str = "hour") -> StreamingQuery:
    """Writes each micro-batch's sums to a partition of its own, so a batch that comes again replaces itself; late events are just more deltas."""

    def write(batch: DataFrame, number: int) -> None:
        sums = batch.groupBy(F.date_trunc(bucket, "ts").alias("bucket"), *keys).agg(F.count("*").alias("requests"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
        sums.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rollup(spark: SparkSession, keys: list[str], path: str) -> DataFrame:
    """The deltas as totals: they are summed when read."""
    return spark.read.parquet(path).groupBy("bucket", *keys).agg(*[F.sum(c).alias(c) for c in ("requests", "input_tokens", "output_tokens")])


def from_topic(spark: SparkSession, servers: str, topic: str, schema: str) -> DataFrame:
    """A Kafka topic of JSON events as rows; needs Spark's Kafka package."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("e")).select("e.*").filter("event_id is not null")
