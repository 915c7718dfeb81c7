"""Operator 3: approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order of distance (``prefix`` of them).  Each block of
vectors posts its rows, once, in the inverted files of those pivots, with the pivot's place in the row's
order.  A query visits the blocks, walks the inverted files of its own nearest pivots and adds up the footrule distance
|place in the query - place in the vector| (a pivot that one of them does not hold counts as its place
``prefix``).  The ``share`` of a block with the smallest footrule is reranked by exact Euclidean distance.

Pivots are the only fitted part: ``pivots`` different vectors, the first by a hash of their id, so the fit reads a
bounded sample; every row is indexed.  On the given tables (64 nearly uniform dimensions, where
nearest neighbours are hardly nearer than others) a recall of 0.95 needs a large share; see the README.

Scale: see ``vectors``; vectors move once, queries once a block, and each block gives k rows a query.

Edge cases: as ``topk``, and zero vectors take no part; ties go to the smaller id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .vectors import same_width, vector_rows, visited


def choose_pivots(rows: DataFrame, pivots: int) -> np.ndarray:
    """At most ``pivots`` different vectors, from the 4 * ``pivots`` rows first by hash."""
    sample = rows.orderBy(F.xxhash64("vec_id", F.lit("pivot")), "vec_id", "vector").limit(4 * pivots).collect()
    found: dict[tuple, None] = dict.fromkeys(tuple(r.vector) for r in sample)
    chosen = list(found)[:pivots]
    width = max(map(len, chosen), default=0)
    return np.array([x + (0.0,) * (width - len(x)) for x in chosen]).reshape(len(chosen), width)


def orders(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Each row's ``prefix`` nearest pivots, nearest first."""
    vectors, pivots = same_width(vectors, pivots)
    far = (pivots**2).sum(1)[None] - 2 * vectors @ pivots.T
    if prefix < len(pivots):
        near = np.argpartition(far, prefix - 1, axis=1)[:, :prefix]
    else:
        near = np.broadcast_to(np.arange(len(pivots)), far.shape)
    return np.take_along_axis(near, np.lexsort((near, np.take_along_axis(far, near, 1)), axis=1), 1)


class InvertedFiles:
    """For each pivot, the rows of a block that hold it and its place in their order."""

    def __init__(self, order: np.ndarray, pivots: int):
        rows, self.prefix = order.shape
        flat = order.reshape(-1)
        by = np.argsort(flat, kind="stable")
        ends = np.searchsorted(flat[by], np.arange(pivots + 1))
        self.rows, self.ends, self.n = by // self.prefix, ends, rows
        self.place = (by % self.prefix).astype(np.int32)

    def footrule(self, order: np.ndarray) -> np.ndarray:
        """The distance of one query's order from every row's, over the pivots that either holds."""
        total = np.full(self.n, self.prefix * (self.prefix + 1), np.int64)  # as if no row held any of the query's pivots
        for place, pivot in enumerate(order):
            own = slice(self.ends[pivot], self.ends[pivot + 1])
            there = self.place[own]
            total[self.rows[own]] += np.abs(there - place) + there + (place - 2 * self.prefix)
        return total


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    pivots: int = 512,
    prefix: int = 128,
    share: float = 0.15,
    least: int = 256,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found, by exact Euclidean distance.

    Of each block ``share`` of the rows, and ``least`` rows at least, are reranked.
    """
    rows = vector_rows(vectors, is_query, F.exists(F.col(vec_col).cast("array<double>"), lambda x: x != 0), id_col, vec_col)
    shared = vectors.sparkSession.sparkContext.broadcast(choose_pivots(rows.select("vec_id", "vector"), pivots))  # pivots * width numbers

    def prepare(ids: np.ndarray, v: np.ndarray) -> tuple:
        points = shared.value
        by_id = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
        return ids, v, by_id, InvertedFiles(orders(v, points, min(prefix, len(points))), len(points))

    def answer(index: tuple, q_ids: np.ndarray, q: np.ndarray) -> Iterator[list[np.ndarray]]:
        ids, v, by_id, files = index
        points, take = shared.value, min(len(v), max(least, math.ceil(share * len(v))))
        wide_q, wide_v = same_width(q, v)
        out: list[list[np.ndarray]] = [[], [], []]
        for i, order in enumerate(orders(q, points, min(prefix, len(points)))):
            key = files.footrule(order) * len(v) + by_id
            near = np.argpartition(key, take - 1)[:take]
            near = near[ids[near] != q_ids[i]]
            with np.errstate(over="ignore"):
                score = np.sqrt(((wide_v[near] - wide_q[i]) ** 2).sum(1))
            best = np.lexsort((ids[near], score))[:k]
            for x, y in zip(out, (np.full(len(best), q_ids[i]), ids[near[best]], score[best]), strict=True):
                x.append(y)
        yield [np.concatenate(x) for x in out]

    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    found = visited(rows, prepare, answer, "query_id long, vec_id long, score double")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
