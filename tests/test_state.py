"""Task state with timers over restarts, compacted rollups, retention that stops half way."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from meterlake.sources import ledger
from meterlake.streaming.rollups import Rollup
from meterlake.streaming.tasks import task_stream

MARKER = "kind string, id string, description string, session string, ts timestamp"


def at(hour, minute=0):
    return datetime(2024, 1, 1) + timedelta(hours=hour, minutes=minute)


class Stream:
    """A task stream that is started anew for each batch of markers, from its checkpoint."""

    def __init__(self, spark, folder):
        self.spark, self.folder, self.seen = spark, str(folder), 0
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def __call__(self, *markers):
        self.spark.createDataFrame(markers, MARKER).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")
        source = self.spark.readStream.schema(MARKER).parquet(f"{self.folder}/in")
        out = task_stream(source, timedelta(hours=4), timedelta(hours=10), "1 hour")
        out.writeStream.format("parquet").option("path", f"{self.folder}/out").option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        rows = self.spark.read.parquet(f"{self.folder}/out").orderBy("task", "status", "ends").collect()
        return [(r.task, r.description, r.begins.hour, r.ends and r.ends.hour, r.status) for r in rows]


def test_tasks_over_restarts(spark, tmp_path):
    try:
        run = Stream(spark, tmp_path)
        start = lambda i, h, d="d": ("start", i, d, "s", at(h))
        done = lambda i, h: ("done", i, None, None, at(h))
        assert run(start("a", 1, "first"), start("a", 2, "second"), start("b", 1), done("c", 1), (None, "d", None, None, at(1)), ("start", None, None, None, at(1))) == []
        found = [("a", "first", 1, 3, "done")]
        assert run(done("a", 2), done("a", 3), start("e", 3), done("e", 2)) == found
        found = [*found, ("b", "d", 1, None, "expired"), ("e", "d", 3, None, "expired")]
        assert run(start("z", 10)) == found  # the watermark is at 9 when this batch is over
        assert run(done("b", 11), start("y", 12)) == sorted([*found, ("b", "d", 1, 11, "late")], key=lambda r: (r[0], r[4]))
        run(start("x", 30))  # the states of a, b and e go
        again = run(done("b", 31), start("b", 32, "new"), done("b", 33))
        assert ("b", "new", 8, 9, "done") in again and sum(r[0] == "b" for r in again) == 3
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


EVENT = "ts timestamp_ntz, provider string, input_tokens long, output_tokens long"


def events(spark, *rows):
    return spark.createDataFrame([(at(h), p, i, 1) for h, p, i in rows], EVENT)


def shown(rollup):
    return sorted((r.bucket.hour, r.provider, r.requests, r.input_tokens) for r in rollup.totals().collect())


def test_totals_stay_through_compaction(spark, tmp_path):
    r = Rollup(spark, str(tmp_path), ["provider"])
    with pytest.raises(FileNotFoundError):
        r.totals()
    r.add(events(spark, (1, "a", 5), (1, "a", 6), (2, "b", 1)), 0)
    r.add(events(spark, (1, "a", 7), (3, None, 2)), 1)
    want = [(1, "a", 3, 18), (2, "b", 1, 1)]
    key = lambda rows: [x for x in rows if x[1]]
    assert key(sorted(map(tuple, r.totals().select(F.hour("bucket"), "provider", "requests", "input_tokens").filter("provider is not null").collect()))) == want
    r.compact()
    full = r.totals().count()
    r.compact()  # nothing new
    r.add(events(spark, (9, "late", 9)), 1)  # a batch that is in the base comes again
    assert r.totals().count() == full == 3
    r.add(events(spark, (2, "b", 4)), 2)
    r.vacuum()
    assert sorted(p.name for p in tmp_path.iterdir()) == ["base=1", "batch=2", "manifest=1"]
    assert r.totals().filter("provider = 'b'").first().input_tokens == 5


def test_a_compaction_that_dies(spark, tmp_path, monkeypatch):
    r = Rollup(spark, str(tmp_path), ["provider"])
    for n in range(3):
        r.add(events(spark, (1, "a", 1 + n)), n)

    def dies(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(Rollup, "_publish", dies)
        with pytest.raises(KeyboardInterrupt):
            r.compact()
    assert (tmp_path / "base=1").exists() and shown(r) == [(1, "a", 3, 6)]
    r.add(events(spark, (1, "a", 10)), 3)
    r.compact()
    assert shown(r) == [(1, "a", 4, 16)]
    r.vacuum()
    assert shown(r) == [(1, "a", 4, 16)]


def test_a_backfill_counts_once(spark, tmp_path):
    r = Rollup(spark, str(tmp_path), ["provider"])
    r.add(events(spark, (1, "a", 1), (2, "a", 2)), 0)
    r.compact()
    r.add(events(spark, (2, "a", 3), (3, "a", 4)), 1)
    truth = events(spark, (1, "a", 99), (2, "a", 2), (2, "a", 3), (2, "a", 50), (3, "a", 99))
    assert r.backfill(truth, at(2), at(3), "fix-1") and not r.backfill(truth, at(2), at(3), "fix-1")
    assert shown(r) == [(1, "a", 1, 1), (2, "a", 3, 55), (3, "a", 1, 4)]
    r.add(events(spark, (2, "a", 7)), 2)
    r.compact()
    assert shown(r) == [(1, "a", 1, 1), (2, "a", 4, 62), (3, "a", 1, 4)]
    assert not r.backfill(truth, at(2), at(3), "fix-1")


def test_a_stream_of_rollups(spark, tmp_path):
    rows = events(spark, *[(h % 5, "ab"[h % 2], h) for h in range(20)])
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    r = Rollup(spark, str(tmp_path / "out"), ["provider"])
    for _ in range(2):
        r.stream(spark.readStream.schema(EVENT).parquet(str(tmp_path / "in")), str(tmp_path / "checkpoint")).awaitTermination()
        r.compact()
    assert shown(r) == sorted((x.bucket.hour, x.provider, x.requests, x.input_tokens) for x in r.sums(rows).collect())


LEDGER = "event_id long, ts timestamp_ntz, type string"


def stored(spark, path):
    return sorted(r.event_id for r in spark.read.parquet(path).collect())


@pytest.mark.parametrize("step", ["copied", "marked", "replaced"])
def test_retention_that_stops_half_way(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "table")
    day = lambda d, h=1: datetime(2024, 1, d, h)
    rows = [(1, day(1), "trial"), (2, day(1), "metered"), (3, day(2), "trial"), (4, day(20), "trial"), (5, day(20), "metered")]
    ledger.append_once(spark.createDataFrame(rows, LEDGER), path)

    def dies(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(ledger, {"copied": "_mark", "marked": "_put_back", "replaced": "_cleared"}[step], dies)
        with pytest.raises(KeyboardInterrupt):
            ledger.apply_retention(spark, path, day(21), {"trial": 10, "metered": 400}, 400)
    ledger.append_once(spark.createDataFrame([(6, day(1, 5), "metered"), (2, day(1), "metered")], LEDGER), path)
    ledger.apply_retention(spark, path, day(21), {"trial": 10, "metered": 400}, 400)
    assert stored(spark, path) == [2, 4, 5, 6]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["table"]


def test_keys_of_all_days(spark, tmp_path):
    path = str(tmp_path / "table")
    ledger.append_once(spark.createDataFrame([(1, datetime(2024, 1, 1), "prompt")], LEDGER), path)
    again = spark.createDataFrame([(1, datetime(2024, 1, 2), "prompt"), (2, datetime(2024, 1, 2), "prompt"), (2, datetime(2024, 1, 3), "prompt")], LEDGER)
    ledger.append_once(again, path, everywhere=True)
    assert sorted((r.event_id, r.ts.day) for r in spark.read.parquet(path).collect()) == [(1, 1), (2, 2)]
