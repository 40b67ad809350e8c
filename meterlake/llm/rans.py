"""Token-id files: static range asymmetric numeral system over interleaved lanes.

One frequency table for all files, counted over every id, is stored beside them. A frame holds
whole documents, about `frame_ids` ids, and can be decoded alone: id number i is in lane
i mod lanes. Each `checkpoint_steps` steps a checkpoint keeps the lanes' states, the place in the
word stream and a CRC-32 of the ids up to the next one, so segments decode in parallel and
errors are found. The frames are rows of Parquet files, which Spark commits whole or not at all
to any file system it can write to.

Frame: magic "MRA1", then unsigned 32-bit little-endian n_ids, lanes, scale_bits,
checkpoint_steps, n_checkpoints; places and CRCs (32-bit) and states (64-bit, lanes for each
checkpoint); words (32-bit).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, id_and_text, written
from .tokens import encoder

MAGIC = b"MRA1"
LOW = np.uint64(1 << 31)
HALF = np.uint64(32)
FRAMES = "part int, frame int, part_start long, doc_ids array<long>, lengths array<int>, payload binary"


def normalized(counts: np.ndarray, scale_bits: int | None = None) -> tuple[np.ndarray, int]:
    """(frequencies with sum 2**scale_bits, scale_bits); each id with a count has 1 at least."""
    seen = int((counts > 0).sum())
    bits = scale_bits or min(24, max(12, 3 + seen.bit_length()))
    total, size = max(1, int(counts.sum())), 1 << bits
    freq = np.where(counts > 0, np.maximum(1, (counts.astype(np.float64) * size / total).astype(np.int64)), 0)
    if not seen:
        return freq, bits
    over = int(freq.sum()) - size
    for i in np.argsort(-freq, kind="stable"):
        if not over:
            break
        step = min(over, int(freq[i]) - 1) if over > 0 else over
        freq[i] -= step
        over -= step
    return freq, bits


class Coder:
    """Encodes and decodes frames with one frequency table."""

    def __init__(self, freq: np.ndarray, scale_bits: int, lanes: int = 1024, checkpoint_steps: int = 128):
        self.freq, self.bits, self.lanes, self.steps = freq.astype(np.uint64), scale_bits, lanes, checkpoint_steps
        self.cum = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64) if len(freq) else self.freq
        self.symbols: np.ndarray | None = None

    def encode(self, ids: np.ndarray) -> bytes:
        n = len(ids)
        lanes = max(1, min(self.lanes, n // 64))
        steps, k = -(-n // lanes), np.uint64(self.bits)
        state, words, points = np.full(lanes, LOW, np.uint64), [], []
        for t in range(steps - 1, -1, -1):
            s = ids[t * lanes : (t + 1) * lanes]
            f, x = self.freq[s], state[: len(s)]
            full = x >= f << np.uint64(63 - self.bits)
            words.append(x[full].astype("<u4"))
            x = np.where(full, x >> HALF, x)
            q = x // f
            state[: len(s)] = (q << k) + (x - q * f) + self.cum[s]
            if t % self.steps == 0:
                points.append((t, len(words), state.copy()))
        words.reverse()
        ends = np.concatenate([[0], np.cumsum([len(w) for w in words])])
        points.reverse()
        places = np.array([ends[steps - done] for _, done, _ in points], "<u4")
        crcs = np.array([zlib.crc32(ids[t * lanes : (t + self.steps) * lanes].astype("<u4")) for t, _, _ in points], "<u4")
        head = struct.pack("<4s5I", MAGIC, n, lanes, self.bits, self.steps, len(points))
        return b"".join([head, places.tobytes(), crcs.tobytes(), *(p[2].astype("<u8").tobytes() for p in points), *(w.tobytes() for w in words)])

    def decode(self, frame: bytes, segments: range | None = None) -> np.ndarray:
        """The ids of all segments or the given ones; ValueError if a checksum doesn't hold."""
        magic, n, lanes, bits, every, points = struct.unpack_from("<4s5I", frame)
        if magic != MAGIC or bits != self.bits:
            raise ValueError("not a frame of this table")
        if self.symbols is None:
            self.symbols = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        at = 24
        places = np.frombuffer(frame, "<u4", points, at)
        crcs = np.frombuffer(frame, "<u4", points, at + 4 * points)
        states = np.frombuffer(frame, "<u8", points * lanes, at + 8 * points).reshape(points, lanes)
        words = np.frombuffer(frame, "<u4", -1, at + 8 * points + 8 * points * lanes)
        out, k, mask = [], np.uint64(bits), np.uint64((1 << bits) - 1)
        for p in segments if segments is not None else range(points):
            state, place = states[p].copy(), int(places[p])
            ids = np.empty(min(every * lanes, n - p * every * lanes), np.uint32)
            for t in range(0, len(ids), lanes):
                width = min(lanes, len(ids) - t)
                x = state[:width]
                slot = x & mask
                s = self.symbols[slot]
                ids[t : t + width] = s
                x = self.freq[s] * (x >> k) + slot - self.cum[s]
                low = np.flatnonzero(x < LOW)
                x[low] = (x[low] << HALF) | words[place : place + len(low)]
                place += len(low)
                state[:width] = x
            after = states[p + 1] if p + 1 < points else LOW
            if zlib.crc32(ids) != crcs[p] or (state != after).any():
                raise ValueError(f"segment {p} is damaged")
            out.append(ids)
        return np.concatenate(out) if out else np.empty(0, np.uint32)


def narrowest(tokenizer_path: str, end_id: int | None) -> str:
    """The little-endian unsigned type that holds all ids of a vocabulary: 16 bits if they do, else 32."""
    with encoder(tokenizer_path, spaced=False) as tokens:
        most = max([end_id or 0, *tokens.tokenizer.get_vocab(with_added_tokens=True).values()])
    return "<u2" if most < 1 << 16 else "<u4"


def token_table(docs: DataFrame, tokenizer_path: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text", id_type: str = "<u4") -> DataFrame:
    """(doc_id, ids): ids in id_type, the end id last; a null text counts as empty."""
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with encoder(tokenizer_path, spaced=False) as tokens:
            for batch in batches:
                ids = [x + end for x in tokens.encode(batch["text"])]
                if id_type != "<u4":
                    ids = [np.frombuffer(x, "<u4").astype(id_type).tobytes() for x in ids]
                yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "ids": ids})

    return id_and_text(docs, id_col, text_col).mapInPandas(run, "doc_id long, ids binary")


def id_counts(tokens: DataFrame, id_type: str = "<u4") -> DataFrame:
    """(id, n) over all ids; each task sums its own first, so a task sends a row for each id at most."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            n = np.bincount(np.frombuffer(b"".join(batch["ids"]), id_type))
            if len(n) > len(total):
                n, total = total, n
            total[: len(n)] += n
        ids = np.flatnonzero(total)
        yield pd.DataFrame({"id": ids.astype("int64"), "n": total[ids].astype("int64")})

    return tokens.select("ids").mapInPandas(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_token_files(tokens: DataFrame, path: str, frame_ids: int = 1 << 18, ids_per_file: int = 1 << 23, id_type: str = "<u4") -> None:
    """Writes path/frames and path/frequencies: documents in ascending doc_id order (nulls first).

    The table that the driver gathers has a row for each id of the vocabulary at most. Repeated
    doc_ids stay, in the order of a hash of their ids. id_type: of the ids in tokens. A file has about
    ids_per_file ids.
    """
    spark = tokens.sparkSession
    counts = id_counts(tokens, id_type).toPandas()
    dense = np.zeros(int(counts["id"].max()) + 1 if len(counts) else 0, np.int64)
    dense[counts["id"].to_numpy(dtype=np.int64)] = counts["n"].to_numpy()
    freq, bits = normalized(dense)
    spark.createDataFrame([(bits, freq.tolist())], "scale_bits int, freq array<long>").coalesce(1).write.parquet(f"{path}/frequencies")
    coder = Coder(freq, bits)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        frame, start, docs, texts, size = 0, 0, [], [], 0
        width = np.dtype(id_type).itemsize

        def flush() -> pd.DataFrame:
            ids = np.frombuffer(b"".join(texts), id_type)
            return pd.DataFrame({"part": [part], "frame": [frame], "part_start": [start], "doc_ids": [docs], "lengths": [[len(x) // width for x in texts]], "payload": [coder.encode(ids)]})

        for batch in batches:
            for doc, ids in zip(batch["doc_id"], batch["ids"], strict=True):
                docs.append(None if pd.isna(doc) else int(doc))
                texts.append(ids)
                size += len(ids) // width
                if size >= frame_ids:
                    yield flush()
                    frame, start, docs, texts, size = frame + 1, start + size, [], [], 0
        if docs:
            yield flush()

    parts = max(1, -(-int(dense.sum()) // ids_per_file))
    # rows of one id, null for instance, may be many: those with other ids of tokens can go to other files
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("ids")]
    ordered = tokens.repartitionByRange(parts, *order).sortWithinPartitions(*order, "ids")
    ordered.mapInPandas(run, FRAMES).write.option("compression", "uncompressed").parquet(f"{path}/frames")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of files that write_token_files wrote, decoded frame by frame."""
    head = spark.read.parquet(f"{path}/frequencies").first()
    coder = Coder(np.array(head["freq"], np.int64), head["scale_bits"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, start, docs, lengths, payload in zip(batch["part"], batch["part_start"], batch["doc_ids"], batch["lengths"], batch["payload"], strict=True):
                raw = coder.decode(payload).astype("<u4").tobytes()
                ends = np.cumsum(lengths)
                begin = ends - lengths
                yield pd.DataFrame({"part": part, "doc_id": pd.array([None if pd.isna(d) else d for d in docs], "Int64"), "within": start + begin, "n_tokens": lengths, "ids": [raw[4 * a : 4 * b] for a, b in zip(begin, ends, strict=True)]})

    frames = spark.read.schema(FRAMES).parquet(f"{path}/frames")
    # a row for each part file: the files are as many as the partitions that wrote them
    sizes = frames.groupBy("part").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("part", before.alias("before"))
    rows = frames.mapInPandas(run, "part int, doc_id long, within long, n_tokens long, ids binary")
    # broadcast: a row for each partition that wrote frames, 16 bytes, so 1.6 MB for 100,000 of them
    return rows.join(F.broadcast(offsets), "part").select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids")


def encode_corpus(docs: DataFrame, tokenizer_path: str, end_id: int | None = 2, path: str | None = None, **columns) -> str:
    """Tokenises docs and writes token files in the shared folder; returns their path."""
    path = path or fresh_path(docs.sparkSession, "token-files")
    id_type = narrowest(tokenizer_path, end_id)
    tokens = written(token_table(docs, tokenizer_path, end_id, id_type=id_type, **columns), "tokens")
    write_token_files(tokens, path, id_type=id_type)
    return path
