from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomwire.llm.permutation_index import InvertedFiles, nearest, orders
from fathomwire.llm.topk import Postings, top_k

SCHEMA = "vec_id long, embedding array<double>, label int, score double, `rank` int, vector string"


@pytest.fixture
def small_blocks(monkeypatch):
    for name, value in (("LEAST", 4), ("MOST", 16), ("CHUNK", 2)):
        monkeypatch.setattr(f"fathomwire.llm.vectors.{name}", value)


def rows(n, width, seed=0):
    rng = random.Random(seed)
    return [(i, [round(rng.gauss(0, 1), 1) for _ in range(width)], 0, 0.5, 1, "v") for i in range(n)]


ODD = [
    (100, None, 0, 0.0, 0, ""),
    (101, [1.0, None, 2.0], 0, 0.0, 0, ""),
    (102, [math.nan, 1.0, 1.0], 0, 0.0, 0, ""),
    (103, [math.inf, 1.0, 1.0], 0, 0.0, 0, ""),
    (104, [0.0, 0.0, 0.0], 0, 0.0, 0, ""),
    (105, [], 0, 0.0, 0, ""),
    (106, [2.0], 0, 0.0, 0, ""),
    (None, [1.0, 1.0, 1.0], 0, 0.0, 0, ""),
]


def good(row, zero):
    v = row[1]
    return row[0] is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v))


def brute_top(data, every, k):
    used = [(r[0], [math.floor(256 * x) for x in r[1]]) for r in data if good(r, True)]
    out = []
    for q in sorted({i for i, _ in used if i % every == 0}):
        own = min(v for i, v in used if i == q)
        best = sorted(((-sum(a * b for a, b in zip(own, v)), i) for i, v in used if i != q))[:k]  # noqa: B905
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return out


@pytest.mark.parametrize("data", [rows(60, 3) + ODD, rows(40, 3) + rows(40, 3)[:12] * 3, rows(3, 2), []])
def test_exact_top_k(spark, data, small_blocks):
    got = top_k(spark.createDataFrame(data, SCHEMA), F.col("vec_id") % 10 == 0, k=5)
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == brute_top(data, 10, 5)


def test_huge_components():
    q = np.array([[2.0**60, -3.0]])
    v = np.array([[16.0, 2.0], [1.0, 1.0]])
    assert Postings(v).scores(q).tolist() == [[(1 << 63) - 1, 2**60 - 3]]


def brute_near(data, every, k):
    used = [(r[0], r[1]) for r in data if good(r, False)]
    out = []
    for q in sorted({i for i, _ in used if i % every == 0}):
        own = min(v for i, v in used if i == q)
        pad = lambda v: v + [0.0] * (3 - len(v))
        best = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(pad(own), pad(v), strict=True))), i) for i, v in used if i != q)[:k]
        out += [(q, n + 1, i, round(s, 9)) for n, (s, i) in enumerate(best)]
    return out


@pytest.mark.parametrize("data", [rows(60, 3) + ODD, rows(30, 3) + rows(30, 3)[:9] * 3, []])
def test_nearest_is_exact_when_all_are_reranked(spark, data, small_blocks):
    got = nearest(spark.createDataFrame(data, SCHEMA), F.col("vec_id") % 10 == 0, k=4, pivots=8, prefix=4, share=1.0)
    assert sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in got.collect()) == brute_near(data, 10, 4)


def test_footrule():
    rng = np.random.default_rng(1)
    order = orders(rng.normal(size=(50, 5)), rng.normal(size=(12, 5)), 6)
    files = InvertedFiles(order, 12)
    place = lambda o, p: int(np.flatnonzero(o == p)[0]) if (o == p).any() else 6
    assert files.footrule(order[0]).tolist() == [sum(abs(place(order[0], p) - place(o, p)) for p in range(12)) for o in order]


def test_recall(spark, sf_dir):
    """Against brute force on 100 queries of the given vectors, with production parameters but for ``least``."""
    df = spark.read.parquet(f"{sf_dir.replace('0.001', '0.1')}/embeddings.parquet")
    data = df.select("vec_id", "embedding").toPandas()
    x, ids = np.array(data["embedding"].tolist(), np.float64), data["vec_id"].to_numpy()
    got = {}
    for r in nearest(df, F.col("vec_id") % 20 == 0, k=10, least=1).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for i, q in zip(ids, x, strict=True):
        if i % 20 == 0:
            far = np.sqrt(((x - q) ** 2).sum(1))
            far[ids == i] = np.inf
            hits += len(got[i] & set(ids[np.argsort(far, kind="stable")[:10]].tolist()))
    assert len(got) == 100 and hits / 1000 >= 0.95
