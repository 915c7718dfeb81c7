"""Operator 1: token ids in a compact binary store.

Ids are coded with one canonical, length-limited Huffman code made from counts over all documents.
Documents lie in ascending ``doc_id`` order (null first; ties by their ids) in independent blocks; a
block holds whole documents, closes at ``block_tokens`` ids, and has the bit offset of every
``every``-th id, so a reader can start inside it.  Each block is a row of a Parquet file: the
container brings atomic commits and works on any store that Spark can write to.

Scale: one shuffle (by range of doc_id, of 2-byte ids where the vocabulary allows).  The codebook has
at most a row for each id of the vocabulary; offsets need one number for each range partition.

Edge cases: a null or empty text has no ids but the end id; a null doc_id is kept and comes first;
repeated rows are all kept; an empty table gives an empty store and an empty result; other columns
are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import empty_text, stored, text_slices
from .tokens import encoder

TOKENS = "doc_id long, n_tokens long, ids binary"
RANGE_BYTES = 8 << 20  # of ids in a range of documents
BLOCKS = (
    "part int, block int, start_in_part long, n_tokens long, doc_ids array<long>, doc_tokens array<int>,"
    " payload binary, marks binary"
)


def tokenise(docs: DataFrame, tokenizer_path: str, tail: tuple[int, ...], width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids): each whole text's ids, then ``tail``, as little-endian integers of ``width`` bytes."""
    end = np.array(tail, f"<u{width}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = encoder(tokenizer_path).many
        for batch in batches:
            for i, j, data, off in text_slices(batch.column(1), 2 << 20):
                own, bounds = many(data, off)
                ids = np.insert(own.astype(end.dtype), np.repeat(bounds[1:], len(end)), np.tile(end, j - i))
                bounds = bounds + len(end) * np.arange(j - i + 1)
                held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(bounds * width), pa.py_buffer(ids)])
                yield pa.record_batch([batch.column(0).slice(i, j - i), pa.array(np.diff(bounds)), held.cast(pa.binary())], ["doc_id", "n_tokens", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), empty_text(text_col).alias("text")).mapInArrow(run, TOKENS)


def id_width(tokenizer_path: str, *more: int) -> int:
    """2 bytes an id where every id of the vocabulary fits."""
    return 2 if max(encoder(tokenizer_path).tokenizer.get_vocab_size(True), *more) < 1 << 16 else 4


def count_ids(tokens: DataFrame, width: int) -> DataFrame:
    """(id, times) over all documents; each task adds up its own rows first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                ids = np.frombuffer(b"".join(batch.column(0).slice(i, 256).to_pylist()), f"<u{width}")
                own = np.bincount(ids)
                if len(own) > len(total):
                    total, own = own, total
                total[: len(own)] += own
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["id", "times"])

    return tokens.select("ids").mapInArrow(run, "id long, times long").groupBy("id").agg(F.sum("times").alias("times"))


def code_lengths(times: list[int], limit: int) -> list[int]:
    """Optimal prefix-code lengths of at most ``limit`` bits, by merging coins level by level (package-merge)."""
    n = len(times)
    if n <= 1:
        return [1] * n
    if n > 1 << limit:
        raise ValueError(f"{n} ids need more than {limit} bits")
    order = np.argsort(np.array(times), kind="stable")
    weight = np.array(times, np.int64)[order]
    # a level's list holds leaves and packages of the level below; flags say which are leaves
    flags, packages = [], np.zeros(0, np.int64)
    for _ in range(limit):
        merged = np.concatenate((weight, packages))
        by = np.argsort(merged, kind="stable")
        flags.append(by < n)
        merged = merged[by]
        even = len(merged) // 2 * 2
        packages = merged[0:even:2] + merged[1:even:2]
    # from the last level down: of the first 2n-2 items, count leaves, open packages
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for leaf in reversed(flags):
        leaves = int(leaf[:take].sum())
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out.tolist()


@dataclass
class Codebook:
    """Canonical code: ids ascending by (length, id) take ascending codes."""

    ids: np.ndarray
    lengths: np.ndarray
    codes: np.ndarray

    @classmethod
    def of(cls, ids: list[int], lengths: list[int]) -> Codebook:
        ids_, lengths_ = np.array(ids, np.int64), np.array(lengths, np.int64)
        by = np.lexsort((ids_, lengths_))
        ids_, lengths_ = ids_[by], lengths_[by]
        most = int(lengths_.max(initial=1))
        steps = np.left_shift(1, most - lengths_)
        codes = (np.cumsum(steps) - steps) >> (most - lengths_)
        return cls(ids_, lengths_, codes)

    def encode_table(self) -> tuple[np.ndarray, np.ndarray]:
        size = int(self.ids.max(initial=0)) + 1
        length, code = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        length[self.ids], code[self.ids] = self.lengths, self.codes
        return length, code

    def decode_table(self) -> tuple[int, np.ndarray, np.ndarray]:
        """(bits of the window, id and length for every window)."""
        most = int(self.lengths.max(initial=1))
        reach = np.left_shift(1, most - self.lengths)
        size = 1 << most
        ids, lengths = np.zeros(size, np.uint32), np.ones(size, np.uint8)
        ids[: reach.sum()] = np.repeat(self.ids, reach)
        lengths[: reach.sum()] = np.repeat(self.lengths, reach)
        return most, ids, lengths


def pack_bits(ids: np.ndarray, length: np.ndarray, code: np.ndarray, every: int) -> tuple[bytes, bytes]:
    """(payload, marks): codes one after another, high bit first; marks are the bits of each run of ``every`` ids, as 2-byte integers."""
    if len(ids) == 0:
        return b"", b""
    n_bits, value = length[ids], code[ids]
    end = np.cumsum(n_bits)
    begin = end - n_bits
    word, used = (begin >> np.uint64(6)).astype(np.int64), begin & np.uint64(63)
    room = np.int64(64) - used.astype(np.int64) - n_bits.astype(np.int64)
    over = room < 0
    main = np.where(over, value >> (-np.minimum(room, 0)).astype(np.uint64), value << np.maximum(room, 0).astype(np.uint64))
    out = np.zeros(int(word[-1]) + 2, np.uint64)
    first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    out[word[first]] = np.bitwise_or.reduceat(main, first)
    at = np.flatnonzero(over)
    out[word[at] + 1] |= value[at] << (64 + room[at]).astype(np.uint64)
    marks = np.diff(np.concatenate((begin[::every], end[-1:]))).astype("<u2")
    return out.astype(">u8").tobytes()[: (int(end[-1]) + 7) // 8], marks.tobytes()


def unpack_bits(payload: bytes, marks: bytes, n_ids: int, most: int, ids: np.ndarray, lengths: np.ndarray, every: int) -> np.ndarray:
    """All ids of a block: every run between two marks is decoded by table, all runs in step."""
    if n_ids == 0:
        return np.zeros(0, np.uint32)
    raw = np.frombuffer(payload + bytes(8), np.uint8).astype(np.uint64)
    lanes = (raw[:-4] << np.uint64(32)) | (raw[1:-3] << np.uint64(24)) | (raw[2:-2] << np.uint64(16)) | (raw[3:-1] << np.uint64(8)) | raw[4:]
    runs = np.frombuffer(marks, "<u2").astype(np.int64)
    at = np.cumsum(runs) - runs
    out = np.zeros((every, len(runs)), np.uint32)
    mask, last = np.uint64((1 << most) - 1), len(lanes) - 1
    for i in range(every):
        shift = (40 - most - (at & 7)).astype(np.uint64)
        window = ((lanes[np.minimum(at >> 3, last)] >> shift) & mask).astype(np.int64)
        out[i] = ids[window]
        at = at + lengths[window]
    return out.T.reshape(-1)[:n_ids]


def write_token_store(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    end_id: int = 1,
    block_tokens: int = 1 << 17,
    every: int = 128,
    max_bits: int = 18,
    partitions: int | None = None,
) -> None:
    """Write ``path``/blocks and ``path``/codebook.  ``every`` * ``max_bits`` must stay below 2**16, ``max_bits`` at most 32."""
    if every * max_bits >= 1 << 16 or max_bits > 32:
        raise ValueError("a run between two marks must have fewer than 65536 bits, a code at most 32")
    spark = docs.sparkSession
    width = id_width(tokenizer_path, end_id)
    tokens = stored(tokenise(docs, tokenizer_path, (end_id,), width), "tokens")
    counts = sorted((r.id, r.times) for r in count_ids(tokens, width).collect())  # a row for each id of the vocabulary at most
    lengths = code_lengths([t for _, t in counts], max_bits)
    book = Codebook.of([i for i, _ in counts], lengths)
    spark.createDataFrame([(i, n) for (i, _), n in zip(counts, lengths, strict=True)], "id int, bits int").coalesce(1).write.parquet(f"{path}/codebook")
    shared = spark.sparkContext.broadcast(book.encode_table())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, code = shared.value
        part, block, before = TaskContext.get().partitionId(), 0, 0
        doc_ids: list = []
        held: list[bytes] = []
        n = 0

        def close() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), f"<u{width}").astype(np.int64)
            payload, marks = pack_bits(ids, length, code, every)
            row = [part, block, before, n, doc_ids, [len(x) // width for x in held], payload, marks]
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary())
            return pa.record_batch([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], ["part", "block", "start_in_part", "n_tokens", "doc_ids", "doc_tokens", "payload", "marks"])

        for batch in batches:
            for doc, ids in zip(batch.column(0), batch.column(2), strict=True):
                doc_ids.append(doc.as_py())
                held.append(ids.as_py())
                n += len(held[-1]) // width
                if n >= block_tokens:
                    yield close()
                    block, before, doc_ids, held, n = block + 1, before + n, [], [], 0
        if held:
            yield close()

    keys = [F.col("doc_id").asc_nulls_first(), F.col("n_tokens"), F.xxhash64("ids")]
    ranges = max(spark.sparkContext.defaultParallelism, math.ceil(width * sum(n for _, n in counts) / RANGE_BYTES))
    ranged = tokens.repartitionByRange(partitions or ranges, *keys).sortWithinPartitions(*keys)
    ranged.mapInArrow(run, BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    spark.createDataFrame([(every, max_bits, end_id)], "every int, max_bits int, end_id int").coalesce(1).write.parquet(f"{path}/header")


def read_token_store(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) from the files alone; ids are little-endian 4-byte integers."""
    every = spark.read.parquet(f"{path}/header").first().every
    rows = spark.read.parquet(f"{path}/codebook").collect()  # a row for each id of the vocabulary at most
    book = Codebook.of([r.id for r in rows], [r.bits for r in rows])
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    base, total = {}, 0
    for r in sorted(blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()):  # a row for each range partition
        base[r.part], total = total, total + r.n
    shared = spark.sparkContext.broadcast((base, book.ids, book.lengths, book.codes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, *fields = shared.value
        most, ids, lengths = Codebook(*fields).decode_table()
        for batch in batches:
            for row in batch.to_pylist():
                flat = unpack_bits(row["payload"], row["marks"], row["n_tokens"], most, ids, lengths, every).astype("<u4")
                counts = np.array(row["doc_tokens"], np.int64)
                ends = np.cumsum(counts)
                start = base[row["part"]] + row["start_in_part"] + ends - counts
                view = memoryview(flat.tobytes())
                pieces = [view[4 * (e - c) : 4 * e] for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
                out = [pa.array(row["doc_ids"], pa.int64()), pa.array(start, pa.int64()), pa.array(counts, pa.int64()), pa.array([zlib.crc32(p) for p in pieces], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    out, names = [*out, pa.array([bytes(p) for p in pieces], pa.binary())], [*names, "ids"]
                yield pa.record_batch(out, names)

    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
