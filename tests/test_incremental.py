"""Scans that read new bytes only, rotated logs, and polling with a cursor."""

import json
import os
import random

import pytest

from meterlake.sources import incremental, ledger, polled
from meterlake.sources.incremental import LineScan, numbered, replayed, rotated_out


def write(path, text, mode="w"):
    with open(path, mode) as f:
        f.write(text)


def scanned(scan, size=incremental.RANGE, commit=True):
    """The new lines by path, and how many bytes were read for them."""
    plan = scan.plan()
    rows = sorted(scan.lines(plan, size).select("path", "at", "value").collect())
    if commit:
        scan.commit(plan)
    by = {}
    for path, _, value in rows:
        by.setdefault(os.path.basename(path), []).append(value)
    return by, sum(r.end - r.begin for r in plan.collect())


def test_only_new_bytes_are_read(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    scan = lambda: LineScan(spark, str(logs), str(tmp_path / "state"))
    write(logs / "a.jsonl", "a1\na2\nto")
    write(logs / "b.jsonl", "b1\r\n")
    write(logs / "c.jsonl", "no end")
    assert scanned(scan()) == ({"a.jsonl": ["a1", "a2"], "b.jsonl": ["b1"]}, 10)
    assert scanned(scan()) == ({}, 0)
    write(logs / "a.jsonl", "rn\na3\n", "a")
    write(logs / "d.jsonl", "é\n\n")
    assert scanned(scan()) == ({"a.jsonl": ["torn", "a3"], "d.jsonl": ["é", ""]}, 8 + 4)


def test_a_scan_that_dies_is_repeated(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    write(logs / "a.jsonl", "a1\n")
    first = LineScan(spark, str(logs), str(tmp_path / "state"))
    assert scanned(first, commit=False)[0] == {"a.jsonl": ["a1"]}
    os.makedirs(tmp_path / "state" / "files-7")  # a commit that wasn't finished
    write(logs / "a.jsonl", "a2\n", "a")
    again = LineScan(spark, str(logs), str(tmp_path / "state"))
    assert scanned(again) == ({"a.jsonl": ["a1", "a2"]}, 6)
    assert scanned(LineScan(spark, str(logs), str(tmp_path / "state"))) == ({}, 0)


def test_replaced_and_truncated_files_are_read_anew(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    scan = LineScan(spark, str(logs), str(tmp_path / "state"))
    for name in "abc":
        write(logs / f"{name}.jsonl", f"{name}1\n{name}2\n")
    p = scan.plan()
    kept = [tuple(r) for r in scan.lines(p).select("id", "generation", "value").collect()]
    scan.commit(p)
    write(logs / "a.jsonl", "x1\nx2\nx3\n")  # replaced by something longer
    write(logs / "b.jsonl", "b1\n")  # truncated
    write(logs / "c.jsonl", "c3\n", "a")
    p = scan.plan()
    kept += [tuple(r) for r in scan.lines(p).select("id", "generation", "value").collect()]
    scan.commit(p)
    rows = scan.current(spark.createDataFrame(kept, "id string, generation int, value string"))
    assert sorted(r.value for r in rows.collect()) == ["b1", "c1", "c2", "c3", "x1", "x2", "x3"]


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
def test_ranges_have_each_line_once(spark, tmp_path, size):
    rng = random.Random(size)
    want = ["x" * rng.choice([0, 1, 5, 30]) + str(i) for i in range(60)] + ["", ""]
    write(tmp_path / "a.txt", "\n".join(want) + "\n" + "rest")
    scan = LineScan(spark, str(tmp_path / "a.txt"), str(tmp_path / "state"))
    assert scanned(scan, size)[0] == {"a.txt": want}


def test_totals_equal_a_full_scan(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    rng, scan, seen = random.Random(3), LineScan(spark, str(logs), str(tmp_path / "state")), []
    for _ in range(3):
        for name in ("a", "b", "c"):
            write(logs / name, "".join(f'{{"n":{rng.randint(0, 9)}}}\n' for _ in range(rng.randint(0, 20))) + "{", "a")
        seen += sum(scanned(scan, 16)[0].values(), [])
    full = sum(scanned(LineScan(spark, str(logs), str(tmp_path / "other")))[0].values(), [])
    assert sorted(seen) == sorted(full)


def record(kind, n):
    return json.dumps({"kind": kind, "payload": {"n": n}, "timestamp": "2024-01-01T00:00:00Z"}) + "\n"


def test_a_log_that_is_rotated_between_scans(spark, tmp_path):
    log = str(tmp_path / "events.jsonl")
    scan = lambda: LineScan(spark, str(tmp_path / "events.jsonl*"), str(tmp_path / "state"), by="first_line")
    write(log, record("a", 0) + record("a", 1) + '{"kind": "a", "pay')
    assert len(scanned(scan())[0]["events.jsonl"]) == 2
    write(log, 'load": {"n": 2}}\n', "a")
    assert rotated_out(spark, log, max_bytes=10) and not rotated_out(spark, log, max_bytes=10)
    write(log, record("b", 3))
    by, size = scanned(scan())
    assert {k: [json.loads(x)["payload"]["n"] for x in v] for k, v in by.items()} == {"events.jsonl.1": [2], "events.jsonl": [3]}
    for n in range(4, 7):
        rotated_out(spark, log, max_bytes=10)
        write(log, record("c", n))
    assert sorted(os.listdir(tmp_path)) == ["events.jsonl", "events.jsonl.1", "events.jsonl.2", "events.jsonl.3", "state"]
    by, _ = scanned(scan())
    assert sorted(json.loads(x)["payload"]["n"] for v in by.values() for x in v) == [4, 5, 6]


def test_replay_of_four_segments_with_torn_lines(spark, tmp_path):
    log, want = str(tmp_path / "events.jsonl"), []
    for segment, name in ((3, ".3"), (2, ".2"), (1, ".1"), (0, "")):
        text = ""
        for i in range(3):
            want.append((f"k{i % 2}", segment * 10 + i))
            text += record(*want[-1])
            text += "not json\n" if i == 1 else '[1]\n{"payload": 1}\n' if i == 0 else ""
        write(log + name, text + '{"kind": "torn", "payload"')
    scan = LineScan(spark, log + "*", str(tmp_path / "state"), by="first_line")
    records = numbered(replayed(scan.lines(scan.plan())))
    assert [(r.kind, json.loads(r.payload)["n"]) for r in records.orderBy("nr").collect()] == want
    assert [r.nr for r in records.orderBy("nr").collect()] == list(range(12))
    assert {(r.kind, r.events) for r in ledger.kind_counts(records, "kind").collect()} == {("k0", 8), ("k1", 4)}


# ---- polling


def bucket(hour, *results, minutes=60):
    return {"starting_at": f"2024-01-01T{hour:02}:00:00Z", "ending_at": f"2024-01-01T{hour + minutes // 60:02}:{minutes % 60:02}:00Z", "results": [{"model": m, "uncached_input_tokens": u, "cache_read_input_tokens": c, "output_tokens": o, **more} for m, u, c, o, more in results]}


def page(folder, name, *buckets, cut=None):
    text = json.dumps({"data": buckets, "has_more": False})
    write(folder / f"{name}.json", text[:cut])


def streamed(spark, folder, tmp_path):
    out = str(tmp_path / "out")
    q = spark.readStream.format(polled.NAME).option("path", str(folder)).option("first", "2024-01-01T00:30:00Z").load().writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "checkpoint")).option("path", out).trigger(once=True).start()
    q.awaitTermination()
    return sorted((r.bucket_start.hour, r.model, r.output_tokens) for r in spark.read.parquet(out).collect())


def test_polling_with_restarts(spark, tmp_path):
    polled.registered(spark)
    folder = tmp_path / "pages"
    folder.mkdir()
    page(folder, "p1", bucket(0, ("m", 1, 1, 1, {}), minutes=20), bucket(1, ("m", 5, 2, 3, {}), ("n", 1, 0, 1, {})))
    page(folder, "p2", bucket(2, ("m", 5, 2, 4, {})), cut=-5)  # half written
    assert streamed(spark, folder, tmp_path) == [(1, "m", 3), (1, "n", 1)]
    assert streamed(spark, folder, tmp_path) == [(1, "m", 3), (1, "n", 1)]
    page(folder, "p2", bucket(1, ("m", 5, 2, 3, {})), bucket(2, ("m", 5, 2, 4, {})))
    page(folder, "p3", bucket(3))
    assert streamed(spark, folder, tmp_path) == [(1, "m", 3), (1, "n", 1), (2, "m", 4)]
    batch = spark.read.format(polled.NAME).option("path", str(folder)).load()
    events = sorted((r.ts.hour, r.model, r.input_tokens, r.cached_input_tokens, r.output_tokens) for r in polled.polled_events(batch).collect())
    assert events == [(0, "m", 2, 1, 1), (1, "m", 7, 2, 3), (1, "n", 1, 0, 1), (2, "m", 7, 2, 4)]


def test_events_of_report_rows(spark, tmp_path):
    polled.registered(spark)
    page(tmp_path, "a", bucket(1, ("m", 1, 0, 0, {"api_key_id": "k"}), ("m", 2, 0, 0, {}), ("m", 3, 0, 0, {"service_tier": "x"}), ("", 9, 9, 9, {}), ("z", 0, 0, 0, {"cache_creation": {"ephemeral_5m_input_tokens": 4}})))
    page(tmp_path, "b", bucket(1, ("m", 7, 0, 0, {"cache_creation": {"ephemeral_5m_input_tokens": 4, "ephemeral_1h_input_tokens": 1}})))
    rows = spark.read.format(polled.NAME).option("path", f"file://{tmp_path}").load()
    got = polled.polled_events(rows).collect()
    assert sorted((r.model, r.input_tokens, r.cache_creation_tokens) for r in got) == [("m", 1, 0), ("m", 7, 5)]
    assert len({r.event_id for r in got}) == 2 and all(len(r.event_id) == 20 and r.event_id.startswith("ana-") for r in got)
    again = {r.event_id for r in polled.polled_events(rows).collect()}
    assert again == {r.event_id for r in got}


def test_an_empty_folder(spark, tmp_path):
    polled.registered(spark)
    assert spark.read.format(polled.NAME).option("path", str(tmp_path)).load().collect() == []
