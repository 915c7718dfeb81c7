"""Operator 10: exact top-k by inner product, term at a time.

Each component is a term.  A block of vectors holds an inverted file, made once: for each term, the vectors with
a non-zero weight there.  Query rows are sparse lists of (term, weight); each scatters its weight times the postings'
weights into a dense array of scores, one for each vector of the block.  A partition selects the k
best of each block; a window merges the blocks.

Scale: see ``vectors``.  Nothing is dropped; the work is (queries x vectors), vectors move once and queries once a block, and what leaves a
block is k rows a query.  A vector id that repeats is spread over blocks like any other.

Edge cases: vectors that are null or hold a null or non-finite component, and rows without an id, take
no part; a shorter vector counts as filled up with zeros, an empty one scores 0; ties go to the
smaller id; a query never meets rows of its own id, and of rows that share an id the
smallest vector asks; repeated rows each take a rank; fewer
candidates than k are all returned; an empty table gives an empty result.  Scores beyond a long are held at its ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .vectors import vector_rows, visited

TILE = 8
LOW, HIGH = -(1 << 63), (1 << 63) - 1
LARGEST = np.finfo(np.float64).max


class Postings:
    """A block's inverted file: for each term, the vectors of non-zero weight and all weights, in the smallest integers that hold every score."""

    def __init__(self, vectors: np.ndarray):
        self.n, self.width = vectors.shape
        self.plain = np.ascontiguousarray(vectors.T)
        self.most = float(np.abs(vectors).max(initial=0))
        self.posted = [np.flatnonzero(row) for row in self.plain]
        self.kinds: dict[type, np.ndarray] = {}

    def terms(self, kind: type) -> np.ndarray:
        if kind not in self.kinds:
            self.kinds[kind] = in_kind(self.plain, kind)
        return self.kinds[kind]

    def scores(self, queries: np.ndarray) -> np.ndarray:
        """Inner products of integer rows: each term's postings are scattered into the queries' score arrays."""
        most = float(np.abs(queries).max(initial=0)) * self.most * max(1, self.width)
        kind = np.int32 if most < 1 << 30 else np.int64 if most < 1 << 62 else object
        own, terms = in_kind(queries, kind), self.terms(kind)
        scores = np.zeros((len(own), self.n), kind)
        for term, posted in enumerate(self.posted[: own.shape[1]]):
            asking = np.flatnonzero(own[:, term])
            if len(posted) == 0 or len(asking) == 0:
                continue
            if 2 * len(posted) >= self.n and 2 * len(asking) >= len(own):  # so full that gaps cost less than places
                scores += own[:, term, None] * terms[None, term]
            else:
                scores[np.ix_(asking, posted)] += own[asking, term][:, None] * terms[term, posted][None]
        return np.clip(scores, LOW, HIGH).astype(np.int64) if kind is object else scores


def in_kind(values: np.ndarray, kind: type) -> np.ndarray:
    return np.vectorize(int, otypes=[object])(values) if kind is object else values.astype(kind)


def best_of(scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best allowed scores, best first, ties to the smaller id."""
    at = np.flatnonzero(allowed)
    own = scores[at]
    if len(at) > k:
        least = np.partition(own, len(own) - k)[len(own) - k]
        at = at[own >= least]
    return at[np.lexsort((ids[at], ~scores[at]))][:k]


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query row's k highest integer inner products of floor(scale * x)."""
    rows = vector_rows(vectors, is_query, F.lit(True), id_col, vec_col)

    def whole(v: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return np.clip(np.floor(scale * v), -LARGEST, LARGEST)

    def prepare(ids: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, Postings]:
        return ids, Postings(whole(v))

    def answer(index: tuple[np.ndarray, Postings], q_ids: np.ndarray, q: np.ndarray) -> Iterator[list[np.ndarray]]:
        ids, postings = index
        q, out = whole(q), [[], [], []]
        for first in range(0, len(q), TILE):  # as many score arrays at a time as stay in a core's cache
            for i, scores in zip(q_ids[first : first + TILE], postings.scores(q[first : first + TILE]), strict=True):
                at = best_of(scores, ids, ids != i, k)
                for x, y in zip(out, (np.full(len(at), i), ids[at], scores[at].astype(np.int64)), strict=True):
                    x.append(y)
        yield [np.concatenate(x) for x in out]

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = visited(rows, prepare, answer, "query_id long, vec_id long, score long")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
