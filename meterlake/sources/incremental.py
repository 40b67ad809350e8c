"""Folders of growing line files, read by their new bytes only.

A scan keeps a table of files: how far each was read and a fingerprint of its beginning. The next
one reads the heads of files whose size has changed, and then only what stands behind the offset,
in byte ranges that are dealt to tasks. A file that became shorter, or begins differently, is read
anew under the next generation. Lines that don't end yet wait for a later scan.

Files may be known by their path, or by their first line: then a log that is rotated (x, x.1, x.2,
the highest number being the oldest) keeps its place when its segments are renamed between scans.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HEAD = 1024
STEP = 1 << 16
RANGE = 64 << 20
FILES = "id string, path string, offset long, head string, head_size long, generation int"
PLAN = "id string, path string, begin long, end long, head string, head_size long, generation int"


def _opened(path: str):
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path if re.match(r"\w+:/", path) else f"file://{path}")
    return store.open_input_file(name)


def _head(file, size: int) -> str:
    return hashlib.sha256(file.read_at(size, 0)).hexdigest()


def _last_line_end(file, size: int) -> int:
    """Bytes up to the end of the last whole line."""
    while size > 0:
        at = max(0, size - STEP)
        found = file.read_at(size - at, at).rfind(b"\n")
        if found >= 0:
            return at + found + 1
        size = at
    return 0


def _first_line(file, end: int) -> str:
    line, at = hashlib.sha256(), 0
    while at < end:
        part = file.read_at(min(STEP, end - at), at)
        line.update(part.split(b"\n", 1)[0])
        if b"\n" in part:
            break
        at += len(part)
    return line.hexdigest()


class LineScan:
    """Scans of the files that fit a glob; `state` is a folder for the table of files, a version for each committed scan.

    by: "path", or "first_line" for rotated logs (segments that begin with the same line count as one).
    """

    def __init__(self, spark: SparkSession, glob: str, state: str, by: str = "path"):
        if by not in ("path", "first_line"):
            raise ValueError(by)
        self.spark, self.glob, self.state, self.by = spark, glob, state.rstrip("/"), by

    def _folders(self, kind: str) -> list[int]:
        """Numbers of the finished folders of a kind; one that wasn't finished doesn't count."""
        jvm = self.spark.sparkContext._jvm
        top = jvm.org.apache.hadoop.fs.Path(self.state)
        store = top.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not store.exists(top):
            return []
        names = [(x.getPath().getName(), x.getPath()) for x in store.listStatus(top)]
        return sorted(int(m[1]) for n, p in names if (m := re.fullmatch(rf"{kind}-(\d+)", n)) and store.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def files(self) -> DataFrame:
        """The table of files after the last committed scan."""
        versions = self._folders("files")
        return self.spark.read.schema(FILES).parquet(f"{self.state}/files-{versions[-1]}") if versions else self.spark.createDataFrame([], FILES)

    def plan(self) -> DataFrame:
        """(id, path, begin, end, head, head_size, generation): what is to be read of each file, nothing where begin is end.

        Written beside the state, so that a commit is about what was read even if files grow meanwhile.
        """
        listed = self.spark.read.format("binaryFile").load(self.glob).select("path", "length")  # contents aren't read
        by_line = self.by == "first_line"
        known = self.files().select("id", F.col("path").alias("was"), "offset", "head", "head_size", "generation")
        # a row for each file: by path all is known at once, by first line all beginnings are looked at
        rows = listed.join(known.withColumnRenamed("was", "path"), "path", "left") if not by_line else listed

        def looked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for row in batch.to_dict("records"):
                    with _opened(row["path"]) as file:
                        end = _last_line_end(file, row["length"])
                        name = (_first_line(file, end) if end else None) if by_line else row["path"]
                        before = None if by_line or pd.isna(row["offset"]) else int(row["offset"])
                        same = before is not None and end >= before and _head(file, int(row["head_size"])) == row["head"]
                        generation = 0 if by_line or before is None else int(row["generation"]) + (not same)
                        size = min(HEAD, end)
                        out.append((name, row["path"], before if same else 0, end, _head(file, size), size, generation))
                yield pd.DataFrame(out, columns=[c.split()[0] for c in PLAN.split(", ")])

        found = rows.mapInPandas(looked, PLAN).filter("id is not null")
        if by_line:
            place = found.join(known.select("id", "offset", F.col("head_size").alias("seen")), "id", "left")
            # the same first line with fewer bytes than were read is another file
            anew = F.col("offset").isNotNull() & (F.col("end") < F.col("offset"))
            found = place.select("id", "path", F.when(anew, 0).otherwise(F.coalesce("offset", F.lit(0))).alias("begin"), "end", "head", "head_size", F.when(anew, 1).otherwise(0).cast("int").alias("generation"))
        number = max([*self._folders("files"), *self._folders("plan"), 0]) + 1
        path = f"{self.state}/plan-{number}"
        found.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(PLAN).parquet(path)

    def lines(self, plan: DataFrame, size: int = RANGE) -> DataFrame:
        """(value, path, id, generation, at, segment): each new line with the byte it begins at; segment is the rotation number, 0 for the newest.

        Ranges are `size` bytes; a line belongs to the range it begins in.
        """
        pieces = plan.filter("begin < end").withColumn("start", F.explode(F.sequence("begin", F.col("end") - 1, F.lit(size).cast("long"))))
        pieces = pieces.select("id", "path", "generation", "start", F.least(F.col("start") + size, "end").alias("till"), "end", "begin")

        def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for row in batch.to_dict("records"):
                    with _opened(row["path"]) as file:
                        yield from _read_range(file, row)

        # pieces of a file go to different tasks
        dealt = pieces.repartition("path", "start")
        out = dealt.mapInPandas(read, "value string, path string, id string, generation int, at long")
        return out.withColumn("segment", F.coalesce(F.expr("try_cast(regexp_extract(path, '\\\\.([0-9]+)$', 1) as int)"), F.lit(0)))

    def commit(self, plan: DataFrame) -> None:
        """What the plan says is read from now on. Files that are gone are forgotten."""
        number = max([*self._folders("files"), 0]) + 1
        table = plan.select("id", "path", F.col("end").alias("offset"), "head", "head_size", "generation")
        table.write.mode("overwrite").parquet(f"{self.state}/files-{number}")

    def current(self, lines: DataFrame) -> DataFrame:
        """Of the lines of all scans those whose file wasn't replaced since."""
        return lines.join(self.files().select("id", "generation"), ["id", "generation"], "left_semi")


def _read_range(file, row: dict) -> Iterator[pd.DataFrame]:
    """The whole lines that begin within start to till; the one that begins before start belongs to the range before."""
    at = row["start"]
    if at > row["begin"]:  # go on to the first beginning of a line at or behind start
        at -= 1
        while at < row["end"]:
            part = file.read_at(min(STEP, row["end"] - at), at)
            found = part.find(b"\n")
            at += len(part) if found < 0 else found + 1
            if found >= 0:
                break
    rest, begins = b"", at
    while begins < row["till"]:
        part = file.read_at(min(STEP, row["end"] - at), at)
        if not part:
            break
        at += len(part)
        *whole, rest = (rest + part).split(b"\n")
        out = []
        for line in whole:
            if begins >= row["till"]:
                break
            out.append((line.decode("utf-8", "replace").removesuffix("\r"), begins))
            begins += len(line) + 1
        if out:
            yield pd.DataFrame({"value": [v for v, _ in out], "path": row["path"], "id": row["id"], "generation": row["generation"], "at": [p for _, p in out]})


def replayed(lines: DataFrame) -> DataFrame:
    """(kind, payload, ts, segment, at) of the records of an event log; lines that are no JSON object with a kind give no row."""
    get = lambda name: F.get_json_object("value", f"$.{name}")
    rows = lines.select(get("kind").alias("kind"), get("payload").alias("payload"), F.try_to_timestamp(get("timestamp")).alias("ts"), "segment", "at")
    return rows.filter("kind is not null")


def numbered(records: DataFrame) -> DataFrame:
    """records with `nr`, their order from the oldest segment on, counted by segment first, so that no window holds more than a segment."""
    sizes = records.groupBy("segment").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy(F.desc("segment")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = records.join(F.broadcast(sizes.select("segment", before.alias("before"))), "segment")  # a row for each segment, a handful
    return placed.withColumn("nr", F.col("before") + F.row_number().over(Window.partitionBy("segment").orderBy("at")) - 1).drop("before")


def rotated_out(spark: SparkSession, path: str, backups: int = 3, max_bytes: int = 10 << 20) -> bool:
    """Renames path to path.1, path.1 to path.2 and so on, if it has max_bytes or more; the segment behind the last backup goes. Whether it did."""
    jvm = spark.sparkContext._jvm
    at = lambda n: jvm.org.apache.hadoop.fs.Path(f"{path}.{n}" if n else path)
    store = at(0).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(at(0)) or store.getFileStatus(at(0)).getLen() < max_bytes:
        return False
    store.delete(at(backups), False)
    for n in range(backups - 1, -1, -1):
        if store.exists(at(n)):
            store.rename(at(n), at(n + 1))
    return True
