"""Threshold-scaled document sketches, in DataFrame functions only.

A sketch retains every word-shingle hash below a fixed fraction of the hash range, so sketches of
very unequal documents are samples at the same rate: they merge by union and estimate containment
without being resized.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_and_text, let

WORDS = 5
#: One in so many shingle hashes is retained.
SCALE = 4
_LEAST = -(1 << 63)


def words_of(text: Column) -> Column:
    """Lower-cased runs of characters other than space and tab to carriage return."""
    return F.array_remove(F.split(F.translate(F.lower(text), "\t\n\x0b\x0c\r", "     "), " "), "")


def sketch(text: Column, words: int = WORDS, scale: int = SCALE) -> Column:
    """struct<n: long, digest: long, hashes: array<long>> of a text; null counts as empty.

    n: shingles, repeated ones included. digest: hash of the whole word sequence, by which equal
    texts are known however few hashes are retained. hashes: sorted distinct retained ones, from 0
    up to 2**64 / scale. A text of fewer words is one shingle; one without words has none.
    """

    def shingled(h: Column) -> Column:
        many = F.size(h) >= words
        each = F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - words, F.lit(0))), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(words)]))
        hashes = F.when(many, each).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<long>"))
        low = F.filter(hashes, lambda x: x < F.lit(_LEAST + (1 << 64) // scale))
        return F.struct(
            F.when(F.size(h) > 0, F.greatest(F.size(h) - (words - 1), F.lit(1))).otherwise(0).cast("long").alias("n"),
            F.xxhash64(h).alias("digest"),
            F.array_sort(F.array_distinct(F.transform(low, lambda x: x - F.lit(_LEAST)))).alias("hashes"),
        )

    return let(F.transform(words_of(F.coalesce(text, F.lit(""))), lambda w: F.xxhash64(w)), shingled)


def shown(s: Column) -> Column:
    """A sketch as text: n:digest:hashes, numbers in decimal."""
    return F.concat(s["n"].cast("string"), F.lit(":"), s["digest"].cast("string"), F.lit(":"), F.array_join(s["hashes"].cast("array<string>"), ","))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity, 0 to 1: 1 for equal word sequences, 0 if neither has a retained hash."""
    both = F.size(F.array_intersect(a["hashes"], b["hashes"]))
    either = F.size(a["hashes"]) + F.size(b["hashes"]) - both
    same = (a["n"] == b["n"]) & (a["digest"] == b["digest"])
    return F.when(same, 1.0).when(either == 0, 0.0).otherwise(both / either)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has; null if a has no retained hash."""
    return F.when(F.size(a["hashes"]) > 0, F.size(F.array_intersect(a["hashes"], b["hashes"])) / F.size(a["hashes"]))


def merged(sketches: Column) -> Column:
    """Aggregate: the hashes of the sketch of all documents of a group together; partly summed before the shuffle.

    A group's merged sketch is one value: 8 bytes for each distinct retained hash.
    """
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(sketches["hashes"]))))


def with_next(docs: DataFrame, columns: list[str], buckets: int | None = None) -> DataFrame:
    """docs with next_<column>: the row after it by descending doc_id; after the last comes the first.

    No task sorts all rows: quantiles of doc_id cut them into buckets, and the first row of a
    bucket is also dealt to the bucket before it, as the row after that one's last. Equal doc_ids
    are in order of the columns, null doc_ids come last. The driver gathers the bucket bounds only.
    """
    spark = docs.sparkSession
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    step = max(1, round(buckets**0.5))
    shares = F.array(*[F.lit(i / buckets) for i in range(1, buckets)]) if buckets > 1 else F.array(F.lit(1.0))
    found = docs.agg(F.percentile_approx("doc_id", shares, 10 * buckets).alias("cuts"), F.max("doc_id").alias("top")).first()
    bounds = sorted({*(found["cuts"] or []), *([found["top"]] if found["top"] is not None else [])})
    n = max(1, len(bounds))
    below = F.lit(0)
    if bounds:  # the number of bounds below doc_id: first among each step-th, then among the step that follow
        all_ = F.lit(bounds).cast("array<long>")
        coarse = F.lit(bounds[step - 1 :: step] or bounds[-1:]).cast("array<long>")
        at = F.size(F.filter(coarse, lambda b: b < F.col("doc_id"))) * step
        below = let(at, lambda a: a + F.size(F.filter(F.slice(all_, a + 1, step), lambda b: b < F.col("doc_id"))))
        below = F.when(F.col("doc_id").isNull(), 0).otherwise(below)
    cut = docs.withColumn("bucket", below)
    head = F.coalesce(F.element_at(F.lit(bounds).cast("array<long>"), F.col("bucket") + 1) == F.col("doc_id"), F.lit(False)) if bounds else F.lit(False)
    mine = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("copy"))
    copy = F.struct(((F.col("bucket") + 1) % n).alias("bucket"), F.lit(True).alias("copy"))
    dealt = cut.withColumn("to", F.explode(F.when(head, F.array(mine, copy)).otherwise(F.array(mine)))).withColumn("bucket", F.col("to.bucket"))
    order = Window.partitionBy("bucket").orderBy(F.col("to.copy"), F.col("doc_id").desc_nulls_last(), *[F.col(c) for c in columns])
    out = dealt.withColumn("next", F.lead(F.struct(*columns)).over(order)).filter(~F.col("to.copy"))
    return out.select(*docs.columns, *[F.col(f"next.{c}").alias(f"next_{c}") for c in columns])


def edited(text: Column, following: Column) -> Column:
    """text with its last third of code points replaced by as many of the following text, or all it has."""
    third = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.left(text, F.length(text) - third), F.left(F.coalesce(following, F.lit("")), third))


def fingerprints(docs: DataFrame, words: int = WORDS, scale: int = SCALE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, sketch of each row; null texts count as empty, repeated rows stay, other columns are left out."""
    return id_and_text(docs, id_col, text_col).withColumn("sketch", sketch(F.col("text"), words, scale))
