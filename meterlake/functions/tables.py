"""Tables written on the way: they cut the lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

BATCH_BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"
#: bytes of a batch for Python, and about what a function makes of it before it hands that on
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession | None) -> None:
    """Batches of texts for Python are bounded by bytes from here on, unless the session has a bound of its own; without it 10,000 rows of any size are one batch."""
    if spark is not None and spark.conf.get(BATCH_BOUND, None) in (None, "-1", str(2**31 - 1), str(2**63 - 1)):
        spark.conf.set(BATCH_BOUND, str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, which driver and executors share; only where that is unset and the master is local a temporary folder."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="meterlake-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, rows: int) -> DataFrame:
    """df dealt out in tasks of about `rows` rows: a table of few bytes is read by a few tasks, however dear each row is to what follows."""
    return df.repartition(max(1, -(-df.count() // rows)))
