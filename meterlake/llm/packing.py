"""Best-fit packing by hierarchical residual packing.

Documents are tokenised once and cut into pieces of at most `capacity` tokens. Partitions pack
their pieces best-fit, largest first. Nearly full bins leave; the underfull ones become items of
the next round, over fewer partitions, until one partition is left or a round gains nothing.
A round works on (key, length, bin, offset) rows only; the token ids wait in the written table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, written
from .tokens import encoder

PIECES = "key long, doc_id long, piece int, start long, length int, ids_crc32 long, ids binary"
PLACED = "key long, length int, bin long, offset int, done boolean"


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every document: key (unique), doc_id, piece, start, length, ids_crc32, ids.

    ids: little-endian unsigned 32-bit. A document within capacity is one piece; a longer one is
    cut so that its first piece takes what is over and the others are full. A null or empty text
    has the end id alone (or no piece, if end_id is None). Repeated rows have pieces each.
    """
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = TaskContext.get().partitionId() << 34
        with encoder(tokenizer_path, spaced=True) as tokens:
            for batch in batches:
                rows = []
                for doc, ids in zip(batch["doc_id"], tokens.encode(batch["text"]), strict=True):
                    ids += end
                    n, cut = len(ids) // 4, 0
                    for piece in range(-(-n // capacity)):
                        till = cut + capacity if piece or n % capacity == 0 else n % capacity
                        part = ids[4 * cut : 4 * till]
                        rows.append((key, doc, piece, cut, till - cut, zlib.crc32(part), part))
                        key, cut = key + 1, till
                out = pd.DataFrame(rows, columns=["key", "doc_id", "piece", "start", "length", "ids_crc32", "ids"])
                out["doc_id"] = out["doc_id"].astype("Int64")
                yield out

    return id_and_text(docs, id_col, text_col).mapInPandas(run, PIECES)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of the bin, offset in it) of each size, placed in the order given.

    Open bins stand in stacks by residual, and one integer has a bit for each stack that isn't
    empty; its lowest bit from the size up is the tightest residual.
    """
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_, bins = 0, 0
    at, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for i, size in enumerate(sizes.tolist()):
        if fit := open_ >> size:
            residual = size + (fit & -fit).bit_length() - 1
            stack = stacks[residual]
            b = stack.pop()
            if not stack:
                open_ &= ~(1 << residual)
        else:
            b, residual = bins, capacity
            bins += 1
        at[i], offset[i] = b, capacity - residual
        if left := residual - size:
            stacks[left].append(b)
            open_ |= 1 << left
    return at, offset


def _round(capacity: int, slack: int, last: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = list(batches)
        if not frames or not sum(map(len, frames)):
            return
        rows = pd.concat(frames, ignore_index=True)
        bins, inverse = np.unique(rows["bin"].to_numpy(), return_inverse=True)
        used = np.bincount(inverse, weights=rows["length"].to_numpy()).astype(np.int64)
        order = np.lexsort((bins, -used))  # whatever order the rows came in
        place, offset = best_fit(used[order], capacity)
        filled = np.bincount(place, weights=used[order]).astype(np.int64)
        opener = np.full(len(filled), np.iinfo(np.int64).max)
        np.minimum.at(opener, place, bins[order])
        new, shift = np.empty(len(bins), np.int64), np.empty(len(bins), np.int64)
        new[order], shift[order] = place, offset
        rows["offset"] = (rows["offset"].to_numpy() + shift[inverse]).astype("int32")
        rows["done"] = last | (filled >= capacity - slack)[new][inverse]
        rows["bin"] = opener[new][inverse]
        yield rows[["key", "length", "bin", "offset", "done"]]

    return run


def packed(lengths: DataFrame, capacity: int = 2048, slack: int | None = None, fan_in: int = 8, rows_per_task: int = 50_000) -> DataFrame:
    """(key, length) to (key, bin, offset): bins of at most capacity, gapless from offset 0.

    slack: a bin that wants no more than this counts as nearly full (capacity / 64 if None). A
    task holds rows_per_task rows or about fan_in times what a task of the round before left over.
    keys are unique; lengths are from 1 to capacity. An empty input gives no rows. The bins depend
    on keys and lengths alone, not on the machines.
    """
    slack = capacity // 64 if slack is None else slack
    full = lengths.filter(F.col("length") >= capacity).select("key", F.col("key").alias("bin"), F.lit(0).alias("offset"))
    todo = lengths.filter(F.col("length") < capacity).select("key", "length", F.col("key").alias("bin"), F.lit(0).alias("offset"))
    count = todo.count()
    parts, before, done = max(1, -(-count // rows_per_task)), None, [full]
    while count:
        last = parts == 1 or (before is not None and count > 0.98 * before)
        table = written(todo.repartition(parts, "bin").mapInPandas(_round(capacity, slack, last), PLACED), "packing")
        done.append(table.filter("done").select("key", "bin", "offset"))
        if last:
            break
        todo = table.filter("not done").select("key", "length", "bin", "offset")
        before, count = count, todo.select("bin").distinct().count()
        rows = todo.count()
        parts = max(-(-rows // rows_per_task), parts // fan_in, 1)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset.

    Nulls, ties, repeated rows and empty tables: see tokenized_pieces and packed. Other columns of
    docs, whatever their names, are left out.
    """
    pieces = written(tokenized_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col), "pieces")
    placed = packed(pieces.select("key", "length"), capacity, **how)
    return pieces.join(placed, "key").select("doc_id", "piece", "start", "length", "ids_crc32", "ids", F.col("bin").alias("sequence_id"), F.col("offset").cast("long").alias("offset"))


def sequences(packed_docs: DataFrame) -> DataFrame:
    """(sequence_id, length, ids): the packed sequences themselves; a group is one sequence, so at most capacity tokens."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return packed_docs.groupBy("sequence_id").agg(F.sum("length").alias("length"), joined.alias("ids"))
