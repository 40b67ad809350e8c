"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


BATCH_BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where that is unset and the master is local (tests, a laptop) a temporary folder is made and set.
    """
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="meterlake-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """df as a table written to the shared folder: cuts the lineage and survives lost executors."""
    path = path or fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables written on the way to a result. When the result itself has been written, `clear` removes them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame, name: str) -> DataFrame:
        self.paths.append(fresh_path(self.spark, name))
        return written(df, name, self.paths[-1])

    def clear(self) -> None:
        jvm = self.spark.sparkContext._jvm
        for path in self.paths:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        self.paths = []


def keyed_join(df: DataFrame, keys: DataFrame, on: list[str], most: int = 250_000, hot: int = 10_000) -> DataFrame:
    """df joined with keys, a written table of a row for each key; one key may have a large share of df.

    keys have a column `size`, the rows of df with that key. Up to `most` keys are broadcast, so
    df stays where it is. Of more, those with over `hot` rows are broadcast, which are few as each
    stands for so many rows; the others are joined by a shuffle that no key makes uneven.
    """
    keyed = keys.drop("size")
    if keys.count() <= most:
        return df.join(F.broadcast(keyed), on)
    return df.join(F.broadcast(keys.filter(F.col("size") > hot).drop("size")), on).unionByName(df.join(keys.filter(F.col("size") <= hot).drop("size"), on))


def only(df: DataFrame, keys: DataFrame, on: str, how: str = "left_semi", most: int = 2_000_000) -> DataFrame:
    """The rows of df whose key is among keys, a written table of one long column (left_anti: the others).

    Up to `most` keys (some 50 MB as a hash table) are broadcast, so wide rows of df stay where
    they are; beyond that both sides are shuffled.
    """
    return df.join(F.broadcast(keys) if keys.count() <= most else keys, on, how)


def let(value: Column, body) -> Column:
    """body(value) with value computed once per row, also when body uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bounded_batches(df: DataFrame) -> None:
    """Batches of whole texts for Python are bounded by bytes from here on, unless the session has a bound of its own."""
    if df.sparkSession.conf.get(BATCH_BOUND, None) in (None, "-1", str(2**31 - 1)):
        df.sparkSession.conf.set(BATCH_BOUND, str(BATCH_BYTES))


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator works on, under fixed names; a null text counts as empty.

    """
    bounded_batches(df)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def schema(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl) if hasattr(T, "_parse_datatype_string") else T.StructType.fromDDL(ddl)
