"""Hard negatives by segment summaries.

Vectors are stored in blocks with each segment's mean and deviation (the length of the segment
after its mean is taken off), for 4 and for 16 segments. Of two vectors, the product of a
segment's means times its width, plus or minus the product of the deviations, bounds the
segment's part of the inner product. The bounds of 4 segments are taken for all rows of a block
at once, those of 16 for the pairs that remain, and what still remains is scored exactly.

Every block of anchors meets every block of rows once; a meeting returns the best few rows of
each query, so what is shuffled grows with anchors times blocks, not with pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches

COARSE, FINE = 4, 16
#: anchors of a block; bytes of vectors of a block of rows
ANCHORS, BLOCK_BYTES = 512, 2 << 20
#: blocks of anchors that are broadcast (some 16 MB at most by BLOCK_BYTES); beyond it both sides are dealt by SALTS keys a block
BROADCAST, SALTS = 8, 64
#: values of a dense matrix of bounds
CELLS = 1 << 20
FAR = 9.2e18
BLOCK = "block long, n int, key binary, id binary, known binary, label binary, wanted binary, vec binary"


def _summary(vec: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Means (times the root of the width, so that their products need no factor) and deviations by segment."""
    parts = vec.reshape(len(vec), segments, -1)
    mean = parts.mean(axis=2)
    return mean * np.sqrt(parts.shape[2]), np.sqrt(((parts - mean[:, :, None]) ** 2).sum(axis=2))


class Side:
    """A block of vectors as arrays, with their summaries."""

    def __init__(self, row, prefix: str, dims: int):
        raw = lambda name, kind: np.frombuffer(row[prefix + name], kind)
        self.key, self.id, self.label, self.known = raw("key", np.int64), raw("id", np.int64), raw("label", np.int64), raw("known", np.bool_)
        n = len(self.key)
        self.wanted = raw("wanted", np.int64).reshape(n, -1)
        self.whole = raw("vec", np.int64).reshape(n, dims)
        self.vec = self.whole.astype(np.float64)
        self.coarse, self.fine = (_summary(self.vec, s) for s in (COARSE, FINE))
        self.norm = np.sqrt((self.vec**2).sum(axis=1))
        self.top = float(np.abs(self.vec).max(initial=0.0))


def _slack(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """More than rounding can move a bound."""
    return 1e-9 * a * b + 1e-6


def dense_bounds(a: Side, part: slice, r: Side) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the scores of anchors a[part] with all rows r, by coarse segments."""
    mid, off = a.coarse[0][part] @ r.coarse[0].T, a.coarse[1][part] @ r.coarse[1].T + _slack(a.norm[part, None], r.norm)
    return np.minimum(mid - off, FAR), np.maximum(mid + off, -FAR)


def pair_bounds(a: Side, i: np.ndarray, r: Side, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the scores of pairs a[i], r[j], by fine segments."""
    mid, off = np.empty(len(i)), np.empty(len(i))
    for at in range(0, len(i), CELLS // FINE):
        x, y = i[at : at + CELLS // FINE], j[at : at + CELLS // FINE]
        mid[at : at + len(x)] = (a.fine[0][x] * r.fine[0][y]).sum(axis=1)
        off[at : at + len(x)] = (a.fine[1][x] * r.fine[1][y]).sum(axis=1)
    off += _slack(a.norm[i], r.norm[j])
    return np.minimum(mid - off, FAR), np.maximum(mid + off, -FAR)


def scores(a: Side, i: np.ndarray, r: Side, j: np.ndarray) -> np.ndarray:
    """Integer inner products of pairs; beyond 64 bits the nearest integer of 64 bits."""
    out, dims = np.empty(len(i), np.int64), a.vec.shape[1]
    exact = dims * a.top * r.top < 2**53
    for at in range(0, len(i), step := max(1, CELLS // dims)):
        x, y = i[at : at + step], j[at : at + step]
        if exact:
            out[at : at + step] = (a.vec[x] * r.vec[y]).sum(axis=1).astype(np.int64)
        else:
            whole = (a.whole[x].astype(object) * r.whole[y].astype(object)).sum(axis=1)
            out[at : at + step] = [min(max(int(v), -(2**63)), 2**63 - 1) for v in whole]
    return out


def _kth(values: np.ndarray, k: int) -> float:
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else -np.inf


def _best(score: np.ndarray, j: np.ndarray, r: Side, k: int) -> np.ndarray:
    """Places of the k highest scores; ties by smaller id, a null id last."""
    return np.lexsort((r.id[j], ~r.known[j], -score.astype(np.float64) if np.abs(score).max(initial=0) < 2**53 else [-int(s) for s in score]))[:k]


def nearest_of_label(a: Side, r: Side, k: int) -> Iterator[tuple[int, int, int, int]]:
    """(anchor, 0, row, score) of the k best rows of each anchor's label, the anchor itself not counted."""
    for at in range(0, len(a.key), step := max(1, CELLS // max(1, len(r.key)))):
        part = slice(at, at + step)
        allowed = (a.label[part, None] == r.label) & (a.key[part, None] != r.key)
        low, high = dense_bounds(a, part, r)
        low[~allowed] = -np.inf
        least = np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k] if low.shape[1] >= k else np.full(len(low), -np.inf)
        i, j = np.nonzero(allowed & (high >= least[:, None]))
        i += at
        low, high = pair_bounds(a, i, r, j)
        for x in np.unique(i):
            mine = np.arange(*np.searchsorted(i, [x, x + 1]))
            mine = mine[high[mine] >= _kth(low[mine], k)]
            score = scores(a, i[mine], r, j[mine])
            for b in _best(score, j[mine], r, k):
                yield int(x), 0, int(j[mine[b]]), int(score[b])


def window_of(score: int, low: int, high: int) -> tuple[int, int]:
    """The scores s with low * score <= 100 * s <= high * score, as a closed range."""
    return -(-low * int(score) // 100), high * int(score) // 100


def nearest_in_windows(a: Side, r: Side, k: int, low_percent: int, high_percent: int) -> Iterator[tuple[int, int, int, int]]:
    """(anchor, number of the positive, row, score) of the k best rows of other labels within the window of each positive."""
    windows = [[(w, *window_of(s, low_percent, high_percent)) for w, s in enumerate(scores_, 1) if s != np.iinfo(np.int64).min] for scores_ in a.wanted.tolist()]
    windows = [[w for w in ws if w[1] <= w[2]] for ws in windows]
    bottom = np.array([float(min((w[1] for w in ws), default=np.inf)) for ws in windows])
    ceiling = np.array([float(max((w[2] for w in ws), default=-np.inf)) for ws in windows])
    for at in range(0, len(a.key), step := max(1, CELLS // max(1, len(r.key)))):
        part = slice(at, at + step)
        low, high = dense_bounds(a, part, r)
        i, j = np.nonzero((a.label[part, None] != r.label) & (high >= bottom[part, None]) & (low <= ceiling[part, None]))
        i += at
        low, high = pair_bounds(a, i, r, j)
        for x in np.unique(i):
            mine = np.arange(*np.searchsorted(i, [x, x + 1]))
            left = []
            for w, first, last in windows[x]:
                inside = low[mine] >= first
                least = max(first, _kth(low[mine][inside & (high[mine] <= last)], k))
                left.append((w, first, last, (high[mine] >= least) & (low[mine] <= last)))
            asked = np.logical_or.reduce([m for *_, m in left])
            mine, left = mine[asked], [(w, first, last, m[asked]) for w, first, last, m in left]
            score = scores(a, i[mine], r, j[mine])
            for w, first, last, m in left:
                fit = np.flatnonzero(m & (score >= first) & (score <= last))
                for b in fit[_best(score[fit], j[mine[fit]], r, k)]:
                    yield int(x), w, int(j[mine[b]]), int(score[b])


def _blocks(rows: DataFrame, size: int, dims: int, wanted: int = 0) -> DataFrame:
    """rows (key, vec_id, label, vec[, wanted]) in blocks of at most `size`, each within a partition; shorter vectors are filled with zeros."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, kept = TaskContext.get().partitionId() << 32, []

        def out(row: pd.DataFrame) -> pd.DataFrame:
            vec = np.zeros((len(row), dims), np.int64)
            for i, v in enumerate(row["vec"]):
                vec[i, : len(v)] = v
            asked = np.full((len(row), wanted), np.iinfo(np.int64).min)
            if wanted:
                for i, v in enumerate(row["wanted"]):
                    asked[i, : len(v)] = v
            ids = row["vec_id"].astype("Int64")
            cells = (row["key"].to_numpy(np.int64), ids.fillna(2**63 - 1).to_numpy(np.int64), ids.notna().to_numpy(np.bool_), row["label"].to_numpy(np.int64), asked, vec)
            return pd.DataFrame([[number, len(row), *(c.tobytes() for c in cells)]], columns=["block", "n", "key", "id", "known", "label", "wanted", "vec"])

        for batch in batches:
            kept.append(batch)
            while sum(map(len, kept)) >= size:
                rest = pd.concat(kept, ignore_index=True)
                yield out(rest[:size])
                number, kept = number + 1, [rest[size:]]
        if sum(map(len, kept)):
            yield out(pd.concat(kept, ignore_index=True))

    return rows.mapInPandas(pack, BLOCK)


def _met(anchors: DataFrame, rows: DataFrame, dims: int, found) -> DataFrame:
    """found(anchors, rows) for each pair of a block of anchors and a block of rows: (anchor, number, id, score).

    anchors, rows: written tables of blocks. Few blocks of anchors are broadcast, more are shuffled with the rows.
    """
    numbers = [r.block for r in anchors.select("block").collect()] if (few := anchors.count() <= BROADCAST) else []
    named = lambda df, prefix: df.select([F.col(c).alias(prefix + c) for c in df.columns])
    left, right = named(anchors, "a_"), named(rows, "r_")
    if few:
        both = right.withColumn("a_block", F.explode(F.array(*map(F.lit, numbers)).cast("array<long>"))).join(F.broadcast(left), "a_block")
    else:
        number = Window.partitionBy().orderBy("block")
        ids = anchors.select("block", (F.row_number().over(number) - 1).alias("of"))
        left = left.join(ids.select(F.col("block").alias("a_block"), "of"), "a_block")
        count = anchors.count()
        left = left.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        right = right.withColumn("salt", F.pmod(F.xxhash64("r_block"), F.lit(SALTS)).cast("int")).withColumn("of", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
        both = right.join(left, ["of", "salt"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                a, r = Side(row, "a_", dims), Side(row, "r_", dims)
                out = [(a.key[i], w, r.id[j] if r.known[j] else None, s) for i, w, j, s in found(a, r)]
                if out:
                    yield pd.DataFrame({"anchor": [x[0] for x in out], "number": [x[1] for x in out], "id": pd.array([x[2] for x in out], "Int64"), "score": [x[3] for x in out]})

    return both.mapInPandas(run, "anchor long, number int, id long, score long")


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "number").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def vectors(df: DataFrame, scale: int = 256, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, label, vec): components times scale, rounded down to integers (beyond 64 bits the nearest of those).

    Rows with a null label, a null vector, or a component that is null or not finite take no part.
    """
    fit = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.filter(F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & fit)
    vec = F.transform(F.col(vector_col).cast("array<double>"), lambda x: F.floor(x * float(scale)))
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), vec.alias("vec"))


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows (vec_id, label, vec of integers).

    An anchor's positives are its best rows of the same label; a positive's negatives are the best
    rows of other labels that score from low to high percent of it. Ties go to the smaller id, a
    null id comes last. Every row counts as itself: a row with an anchor's id is another row, and
    repeated anchors have results of their own. Vectors of different lengths are filled with zeros,
    a positive with a negative score has no negatives, without anchors the result is empty. Rows
    with null labels or vectors take no part; other columns are left out.
    """
    bounded_batches(rows)
    scratch = Scratch(rows.sparkSession)
    rows = rows.select("vec_id", "label", "vec").filter("label is not null and vec is not null")
    rows = scratch.written(rows.withColumn("key", F.monotonically_increasing_id()), "vectors")
    longest = rows.agg(F.max(F.size("vec"))).first()[0] or 0
    dims = max(1, -(-longest // FINE)) * FINE
    anchors = scratch.written(rows.filter(is_anchor), "anchors")
    count = max(1, -(-anchors.count() // ANCHORS))
    in_blocks = scratch.written(_blocks(rows, max(1, BLOCK_BYTES // (8 * dims)), dims), "blocks")
    asking = scratch.written(_blocks(anchors.repartition(count), max(1, min(ANCHORS, BLOCK_BYTES // (8 * dims))), dims), "anchor-blocks")
    best = _first(_met(asking, in_blocks, dims, lambda a, r: nearest_of_label(a, r, positives)), positives)
    best = scratch.written(best.select("anchor", F.col("rank").alias("number"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    wanted = best.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("number", "positive_score"))).alias("found"))
    wanted = wanted.select(F.col("anchor").alias("key"), F.col("found.positive_score").alias("wanted"))
    again = anchors.join(wanted, "key").repartition(count)
    asking = scratch.written(_blocks(again, max(1, min(ANCHORS, BLOCK_BYTES // (8 * dims))), dims, positives), "anchor-windows")
    found = _first(_met(asking, in_blocks, dims, lambda a, r: nearest_in_windows(a, r, negatives, low, high)), negatives)
    out = found.select("anchor", "number", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(best, ["anchor", "number"])
    out = out.join(anchors.select(F.col("key").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
