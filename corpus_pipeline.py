"""The training-data pipeline: language, near-duplicates, personal data, packing.

STAGES are (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame that
is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.llm.common import only, written
from meterlake.llm.langid import UNKNOWN, held_out, identify, learn
from meterlake.llm.minhash import near_duplicates
from meterlake.llm.packing import pack_documents
from meterlake.llm.pii import redact

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any language (null, empty or letterless texts) go; the others get the language found."""
    model = learn(docs.filter(~held_out(F.col("doc_id"))))
    kept = identify(docs.select(*COLUMNS), model).filter(F.col("lang_pred") != UNKNOWN)
    return kept.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays: that of the smallest id (a null id counts as the largest).

    Rows are told apart by a key written with them, so ids may be null or repeated.
    """
    rows = written(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "rows")
    found = near_duplicates(rows, words=5, percent=80, id_col="row").select(F.col("doc_id").alias("row"), "component_id")
    found = written(found.join(rows.select("row", "doc_id"), "row"), "found")
    stay = found.groupBy("component_id").agg(F.min_by("row", F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("row"))
    gone = written(found.join(stay.select("row"), "row", "left_anti").select("row"), "gone")
    return only(rows, gone, "row", "left_anti").select(*COLUMNS)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets; n_chars follows the text."""
    return redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their place in sequences of 2048 tokens."""
    import public_tokenizers

    out = pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("language", language_stage), ("near_dedup", dedup_stage), ("pii", pii_stage), ("packing", packing_stage)]
#: No SQL: a trained classifier, MinHash components and a tokenizer are beyond it. See tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir; what a stage returns is written before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
