"""Vectors in blocks: each vector moves once, to its block; the stated queries visit the blocks.

A block has as many rows as leave two blocks a core, between ``LEAST`` and ``MOST``; so up to ``MOST`` times that many vectors the copies of
the queries stay as few as the cores are, and beyond, a query set that is a fixed share of the rows moves (rows / ``MOST``) times.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

LEAST, MOST, CHUNK = 2048, 65_536, 256


def usable(column: Column) -> Column:
    """Neither null nor holding a null or non-finite component."""
    x = column.cast("array<double>")
    return x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))


def vector_rows(vectors: DataFrame, is_query: Column, wanted: Column, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, vector, asks) of the rows that take part, stored, so that a task that runs again deals them as before."""
    kind = vectors.schema[vec_col].dataType
    held = kind if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.FloatType, T.DoubleType)) else T.ArrayType(T.DoubleType())
    used = vectors.filter(F.col(id_col).isNotNull() & usable(F.col(vec_col)) & wanted)
    return stored(used.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(held).alias("vector"), is_query.alias("asks")), "vectors")


def asked(rows: DataFrame) -> DataFrame:
    """One query an id: of rows that share an id, the one with the smallest vector asks."""
    return rows.filter("asks").groupBy("vec_id").agg(F.min("vector").alias("vector"))


def chunks(rows: DataFrame, salt: Column, most: int) -> DataFrame:
    """(block, rows): lists of about ``most`` rows of each block, chosen by ``salt``."""
    return rows.groupBy("block", salt.alias("salt")).agg(F.collect_list(F.struct("vec_id", "vector")).alias("rows")).drop("salt")


def visited(rows: DataFrame, prepare: Callable[[np.ndarray, np.ndarray], object], answer: Callable[[object, np.ndarray, np.ndarray], Iterator[list[np.ndarray]]], schema: str) -> DataFrame:
    """What ``answer`` gives for each chunk of queries at each block of vectors.

    ``prepare`` makes a block's index from (ids, vectors), once; ``answer`` takes it and a chunk's (ids, vectors), and yields columns.
    """
    spark = rows.sparkSession
    n, asking = rows.agg(F.count("*"), F.count_if("asks")).first()
    own = min(MOST, max(LEAST, math.ceil(n / (2 * spark.sparkContext.defaultParallelism))))
    blocks = max(1, math.ceil(n / own))
    held = rows.select("vec_id", "vector", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int").alias("block"))
    sent = asked(rows).withColumn("block", F.lit(0))
    parts = max(1, math.ceil(own / 4096))
    side = chunks(held, F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit("part")), F.lit(parts)), 4096).withColumn("side", F.lit(0))
    turns = chunks(sent, F.pmod(F.xxhash64("vec_id", F.lit("chunk")), F.lit(max(1, math.ceil(asking / CHUNK)))), CHUNK).withColumn("side", F.lit(1))
    turns = turns.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    names = [f.name for f in T._parse_datatype_string(schema).fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, gathered, index = None, [], None
        for batch in batches:
            for b, s, cell in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if b != block:
                    block, gathered, index = b, [], None
                got = matrix(cell.values)
                if s == 0:
                    gathered.append(got)
                    continue
                if not gathered:
                    continue
                if index is None:
                    index = prepare(*stacked(gathered))
                    gathered = [()]
                for columns in answer(index, *got):
                    yield pa.record_batch([pa.array(c) for c in columns], names)

    both = side.unionByName(turns).select("block", "side", "rows")
    return both.repartition(blocks, "block").sortWithinPartitions("block", "side").mapInArrow(run, schema)


def matrix(rows: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids, values) of a list of (vec_id, vector) structs, in doubles; shorter vectors are filled up with zeros."""
    ids, lists = rows.field("vec_id").to_numpy(zero_copy_only=False), rows.field("vector")
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    width = int(lengths.max(initial=0))
    if len(flat) == len(ids) * width:
        return ids, flat.reshape(len(ids), width)
    out = np.zeros((len(ids), width))
    out[np.arange(width)[None] < lengths[:, None]] = flat
    return ids, out


def same_width(*parts: np.ndarray) -> list[np.ndarray]:
    width = max(x.shape[1] for x in parts)
    return [x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in parts]


def stacked(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([i for i, _ in parts]), np.concatenate(same_width(*[v for _, v in parts]))
