"""Usage reports of a vendor's admin interface as a data source with a cursor: saved response pages, read once each bucket.

The cursor is the end of the last bucket that was read. As a batch source it gives all buckets, as
a stream those that end behind the checkpoint's cursor.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "bucket_start timestamp_ntz, bucket_end timestamp_ntz, model string, api_key_id string, workspace_id string, uncached_input_tokens long, cache_read_input_tokens long, cache_creation_tokens long, output_tokens long, page string"
NAME = "usage_pages"
#: where a stream without a checkpoint begins
FIRST = "0001-01-01T00:00:00+00:00"


def _time(text: str) -> datetime:
    at = datetime.fromisoformat(text.replace("Z", "+00:00"))
    return at if at.tzinfo else at.replace(tzinfo=UTC)


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")


def _page(path: str) -> list[dict] | None:
    """The buckets of a page; None while it is half written."""
    store, name = _store(path)
    try:
        with store.open_input_file(name) as file:
            page = json.loads(file.read())
        return [b for b in page["data"] if _time(b["starting_at"]) <= _time(b["ending_at"])]
    except (ValueError, KeyError, TypeError, AttributeError, FileNotFoundError):
        return None


class _Page(InputPartition):
    def __init__(self, path: str, after: str, till: str | None):
        self.path, self.after, self.till = path, after, till


def _rows(part: _Page | None) -> Iterator[tuple]:
    if part is None:  # what Spark hands over where there are no partitions
        return
    after, till = _time(part.after), _time(part.till) if part.till else None
    number = lambda x: int(x or 0)
    for bucket in _page(part.path) or []:
        begin, end = _time(bucket["starting_at"]), _time(bucket["ending_at"])
        if end <= after or (till and end > till):
            continue
        for r in bucket.get("results") or []:
            created = r.get("cache_creation") or {}
            made = sum(number(v) for v in created.values()) if isinstance(created, dict) else 0
            plain = lambda t: t.astimezone(UTC).replace(tzinfo=None)
            yield plain(begin), plain(end), r.get("model"), r.get("api_key_id"), r.get("workspace_id"), number(r.get("uncached_input_tokens")), number(r.get("cache_read_input_tokens")), made or number(r.get("cache_creation_input_tokens")), number(r.get("output_tokens")), part.path


class _Pages:
    def __init__(self, folder: str):
        self.folder = folder

    def paths(self) -> list[str]:
        from pyarrow import fs

        store, name = _store(self.folder)
        found = store.get_file_info(fs.FileSelector(name, recursive=False, allow_not_found=True))
        return sorted(f"file://{x.path}" if ":/" not in self.folder else self.folder.split(":", 1)[0] + "://" + x.path for x in found if x.is_file and x.path.endswith(".json"))


class _Batch(DataSourceReader):
    def __init__(self, folder: str):
        self.pages = _Pages(folder)

    def partitions(self) -> list[_Page]:
        return [_Page(p, FIRST, None) for p in self.pages.paths()]

    def read(self, partition: _Page) -> Iterator[tuple]:
        return _rows(partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, folder: str, first: str):
        self.pages, self.first = _Pages(folder), first

    def initialOffset(self) -> dict:
        return {"cursor": self.first}

    def latestOffset(self) -> dict:
        """The end of the last bucket of the whole pages; only the pages' times pass here."""
        ends = [_time(b["ending_at"]) for p in self.pages.paths() for b in _page(p) or []]
        return {"cursor": max([_time(self.first), *ends]).isoformat()}

    def partitions(self, start: dict, end: dict) -> list[_Page]:
        return [_Page(p, start["cursor"], end["cursor"]) for p in self.pages.paths()]

    def read(self, partition: _Page) -> Iterator[tuple]:
        return _rows(partition)

    def commit(self, end: dict) -> None:
        """The checkpoint holds the cursor."""


class UsagePages(DataSource):
    """Options: path, a folder of pages (.json); first, the time from which a new stream reads."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options["path"], self.options.get("first", FIRST))


def registered(spark: SparkSession) -> None:
    spark.dataSource.register(UsagePages)


def polled_events(rows: DataFrame) -> DataFrame:
    """Usage events of report rows: event_id (the same for the same bucket, model, key and workspace), ts (the bucket's start), tokens.

    Rows without a model or without tokens give none. Of a bucket that several pages report the
    last page by name counts; rows of a page for one event are added up. Input is what the model read, cached or not.
    """
    total = F.col("uncached_input_tokens") + F.col("cache_read_input_tokens")
    rows = rows.filter((F.coalesce("model", F.lit("")) != "") & (total + F.col("output_tokens") > 0))
    stamp = F.date_format("bucket_start", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    key = F.concat_ws("|", stamp, "model", F.coalesce("api_key_id", F.lit("")), F.coalesce("workspace_id", F.lit("")))
    rows = rows.withColumn("event_id", F.concat(F.lit("ana-"), F.substring(F.sha2(key, 256), 1, 16)))
    sums = rows.groupBy("event_id", "bucket_start", "model", "page").agg(F.sum(total).alias("input_tokens"), F.sum("cache_read_input_tokens").alias("cached_input_tokens"), F.sum("cache_creation_tokens").alias("cache_creation_tokens"), F.sum("output_tokens").alias("output_tokens"))
    last = sums.groupBy("event_id", F.col("bucket_start").alias("ts"), "model").agg(F.max_by(F.struct("input_tokens", "cached_input_tokens", "cache_creation_tokens", "output_tokens"), "page").alias("n"))
    return last.select("event_id", "ts", "model", "n.*")
