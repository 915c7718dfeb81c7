"""Shared helpers: stored intermediate tables, filters of keys, byte-level text kernels, 64-bit mixing."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomwire.session import shared_folder

# The finaliser constants of splitmix64.
GOLD = np.uint64(0x9E3779B97F4A7C15)
MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)

# An odd base of the polynomial hash and its inverse modulo 2**64.
BASE = 0x5851F42D4C957F2D
BASE_INVERSE = pow(BASE, -1, 1 << 64)

SLICE_BYTES = 1 << 19


def work_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that all executors share."""
    return f"{shared_folder(spark)}/fathomwire/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends, lost executors cost nothing."""
    spark = df.sparkSession
    path = work_path(spark, label)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def apart(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """(the columns that operators on documents know, with all others in one; what puts them back), so that no other name meets a helper's."""
    known = [c for c in docs.columns if c in ("doc_id", "text", "lang", "source", "n_chars")]
    rest = [c for c in docs.columns if c not in known]
    packed = [F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_fathomwire_rest")] if rest else []

    def back(rows: DataFrame) -> DataFrame:
        return rows.select(*[F.col(c) if c in known else F.col("_fathomwire_rest").getField(c).alias(c) for c in docs.columns])

    return docs.select(*known, *packed), back


# A block of a key filter is 4096 bits as 64 words; a key has PROBES bits in one block.  So many blocks at most: 8 MB for each kind of keys.
PROBES = 4
FILTER_BLOCKS = 1 << 14


def _probes(h: Column, blocks: int) -> tuple[Column, list[Column]]:
    """(block, numbers of the bits in it) of a 64-bit hash; ``blocks`` is a power of two."""
    own = F.xxhash64(h)
    return h.bitwiseAND(F.lit(blocks - 1)).cast("int"), [F.shiftrightunsigned(own, 12 * i).bitwiseAND(F.lit(4095)).cast("int") for i in range(PROBES)]


def key_filter(keys: DataFrame, kinds: int, bits: int) -> tuple[DataFrame, int]:
    """(block, words_0, words_1, ...; number of blocks): bit maps of the hashes in ``keys`` (h long, kind int), about ``bits`` bits for each key and kind.

    Its size is bounded, and more keys only make more false positives: what may be in it needs an exact look, what may not is surely outside.
    """
    spark = keys.sparkSession
    blocks, n = 1, keys.count()
    while blocks < FILTER_BLOCKS and blocks * 4096 < bits * n:
        blocks *= 2
    block, probes = _probes(F.col("h"), blocks)
    each = keys.select(block.alias("block"), "kind", F.explode(F.array(*probes)).alias("bit"))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").bitwiseAND(F.lit(63)))
    words = each.groupBy("block", "kind", F.shiftright("bit", 6).alias("word")).agg(F.bit_or(mask).alias("mask"))
    of_kind = lambda k: F.map_from_entries(F.collect_list(F.when(F.col("kind") == k, F.struct("word", "mask"))))
    held = words.groupBy("block").agg(*[of_kind(k).alias(f"map_{k}") for k in range(kinds)])
    every = spark.range(blocks).select(F.col("id").cast("int").alias("block")).join(held, "block", "left")

    def dense(k: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.coalesce(F.try_element_at(F.col(f"map_{k}"), i), F.lit(0).cast("long")))

    return stored(every.select("block", *[dense(k).alias(f"words_{k}") for k in range(kinds)]), "key-filter"), blocks


def may_hold(rows: DataFrame, h: Column, found: tuple[DataFrame, int]) -> DataFrame:
    """``rows`` with boolean columns ``_fathomwire_may_0``, ...: whether the hash ``h`` may be among the filter's keys of each kind; no text moves."""
    words, blocks = found
    names = [c for c in words.columns if c != "block"]
    hashed = rows.withColumn("_fathomwire_h", h)
    block, probes = _probes(F.col("_fathomwire_h"), blocks)
    own = F.broadcast(words.select(F.col("block").alias("_fathomwire_block"), *[F.col(c).alias(f"_fathomwire_{c}") for c in names]))

    def held(name: str) -> Column:
        out = F.lit(True)
        for bit in probes:
            word = F.get(F.col(f"_fathomwire_{name}"), F.shiftright(bit, 6))
            out &= F.call_function("shiftright", word, bit.bitwiseAND(F.lit(63))).bitwiseAND(F.lit(1)) == 1
        return out

    joined = hashed.join(own, block == F.col("_fathomwire_block"))
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns], *[held(c).alias(f"_fathomwire_may_{c.removeprefix('words_')}") for c in names])


def empty_text(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser, element by element."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * MIX_A
        x = (x ^ (x >> np.uint64(27))) * MIX_B
        return x ^ (x >> np.uint64(31))


_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        steps[0] = 1
        have = np.cumprod(steps)
        if n <= 4 * SLICE_BYTES:
            _powers[base] = have
    return have[:n]


def utf8_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the row offsets of a string column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, off


def text_slices(column: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows of about ``max_bytes``; a longer text is a run of its own."""
    raw, off = utf8_parts(column)
    n, i = len(off) - 1, 0
    while i < n:
        j = int(np.searchsorted(off, off[i] + max_bytes, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j, raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, 64-bit hash) of every run of bytes other than space and tab to carriage return, in text order."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    inside = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    begin, end = np.flatnonzero(first), np.flatnonzero(last)
    with np.errstate(over="ignore"):
        total = np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power_table(BASE, n))
        before = np.where(begin > 0, total[begin - 1], np.uint64(0))
        hashes = mix((total[end] - before) * _power_table(BASE_INVERSE, n)[begin])
    return np.searchsorted(off, begin, side="right") - 1, hashes


def shingles_of(data: np.ndarray, off: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each run of ``width`` words; a text of fewer words, but one at least, is one shingle."""
    row, word = words_of(data, off)
    if len(word) == 0:
        return row, word
    rows = len(off) - 1
    count = np.bincount(row, minlength=rows)
    begin = np.concatenate(([0], np.cumsum(count)[:-1]))
    with np.errstate(over="ignore"):
        # prefix sums of w_i * B^i give the polynomial of any run of words
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(word * _power_table(BASE, len(word)))))
        at = np.arange(len(word))
        full = np.flatnonzero(at + width <= (begin + count)[row])
        short = np.flatnonzero((count > 0) & (count < width))
        start = np.concatenate((full, begin[short]))
        stop = np.concatenate((full + width, (begin + count)[short]))
        length = (stop - start).astype(np.uint64)
        hashes = mix((total[stop] - total[start]) * _power_table(BASE_INVERSE, len(word))[start] + length * GOLD)
    return row[start], hashes


def counted_shingles(data: np.ndarray, off: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, times) of the different shingles of each row."""
    row, hashes = shingles_of(data, off, width)
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(new)
    return row[at], hashes[at], np.diff(np.append(at, len(row)))
