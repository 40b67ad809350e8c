"""Rollups kept as deltas of micro-batches, compacted under a manifest that readers follow.

Below a path, `batch=N` holds what batch N adds, `base=V` the totals of all batches up to a number.
`manifest=V` says which base counts and up to which batch it holds; the highest finished one is
read. A base without a manifest isn't read, so a run may stop between any two steps: deltas up to
the manifest's number are in its base, later ones are added to it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SUMS = ("requests", "input_tokens", "output_tokens")
MANIFEST = "base int, till long, backfills array<string>"


def _store(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, path: str, kind: str) -> list[int]:
    """Numbers of the finished folders of a kind."""
    top, store = _store(spark, path)
    if not store.exists(top):
        return []
    found = [(re.fullmatch(rf"{kind}=(\d+)", x.getPath().getName()), x.getPath()) for x in store.listStatus(top)]
    return sorted(int(m[1]) for m, p in found if m and store.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


class Rollup:
    """Totals by bucket and keys (columns of events) below a path. One process at a time compacts or fills in."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], bucket: str = "hour"):
        self.spark, self.path, self.keys, self.bucket = spark, path.rstrip("/"), keys, bucket

    def sums(self, events: DataFrame) -> DataFrame:
        at = F.date_trunc(self.bucket, "ts").alias("bucket")
        return events.groupBy(at, *self.keys).agg(F.count("*").alias("requests"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in SUMS[1:]])

    def add(self, events: DataFrame, number: int) -> None:
        """What batch `number` adds; a batch that comes again replaces itself, or is passed over once it is in a base."""
        if number > self._manifest()[1]:
            self.sums(events).write.mode("overwrite").parquet(f"{self.path}/batch={number}")

    def stream(self, events: DataFrame, checkpoint: str) -> StreamingQuery:
        return events.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def _manifest(self) -> tuple[int | None, int, list[str]]:
        versions = _numbers(self.spark, self.path, "manifest")
        if not versions:
            return None, -1, []
        row = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest={versions[-1]}").first()
        return row.base, row.till, list(row.backfills)

    def totals(self) -> DataFrame:
        """(bucket, keys, sums): the base and the deltas behind it."""
        base, till, _ = self._manifest()
        return self._totals(base, [n for n in _numbers(self.spark, self.path, "batch") if n > till])

    def _totals(self, base: int | None, batches: list[int]) -> DataFrame:
        paths = [f"{self.path}/batch={n}" for n in batches] + ([f"{self.path}/base={base}"] if base is not None else [])
        if not paths:
            raise FileNotFoundError(f"no rollup below {self.path}")
        schema = self.spark.read.parquet(paths[-1]).schema
        return self.spark.read.schema(schema).parquet(*paths).groupBy("bucket", *self.keys).agg(*[F.sum(c).alias(c) for c in SUMS])

    def _switch(self, totals: DataFrame, till: int, backfills: list[str]) -> None:
        """A new base, then the manifest that makes it count."""
        number = max([*_numbers(self.spark, self.path, "manifest"), *_numbers(self.spark, self.path, "base"), 0]) + 1
        totals.write.mode("overwrite").parquet(f"{self.path}/base={number}")
        self._publish(number, till, backfills)

    def _publish(self, number: int, till: int, backfills: list[str]) -> None:
        self.spark.createDataFrame([(number, till, backfills)], MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest={number}")

    def compact(self) -> None:
        """All deltas that are there become part of the base."""
        base, till, filled = self._manifest()
        new = [n for n in _numbers(self.spark, self.path, "batch") if n > till]
        if new:
            self._switch(self._totals(base, new), new[-1], filled)

    def backfill(self, events: DataFrame, since, until, name: str) -> bool:
        """Buckets in [since, until) are made anew from events, which hold all that the batches so far brought of them.

        A name is filled in once: a second call changes nothing. Whether it did something.
        """
        base, till, filled = self._manifest()
        if name in filled:
            return False
        new = [n for n in _numbers(self.spark, self.path, "batch") if n > till]
        inside = (F.col("bucket") >= F.lit(since)) & (F.col("bucket") < F.lit(until))
        anew = self.sums(events).filter(inside)
        if new or base is not None:
            anew = self._totals(base, new).filter(~inside).unionByName(anew)
        self._switch(anew, max([till, *new]), [*filled, name])
        return True

    def vacuum(self) -> None:
        """Removes what no reader of the newest manifest needs: older manifests and bases, and deltas in the base."""
        base, till, _ = self._manifest()
        last = max(_numbers(self.spark, self.path, "manifest"), default=0)
        top, store = _store(self.spark, self.path)
        for kind, stale in (("batch", lambda n: n <= till), ("base", lambda n: base is not None and n < base), ("manifest", lambda n: n < last)):
            for n in filter(stale, _numbers(self.spark, self.path, kind)):
                store.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(top, f"{kind}={n}"), True)
