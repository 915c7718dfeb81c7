from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomwire.llm.mixing import mix, numbered, pivotal, repeat_by_mix, source_targets


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    wanted, full, target = share * sum(sizes.values()), set(), {}
    while True:
        left = wanted - sum(cap * sizes[s] for s in full)
        of = sum(weight[s] for s in names if s not in full)
        target = {s: cap * sizes[s] if s in full else left * weight[s] / of for s in names}
        over = {s for s in names if s not in full and target[s] > cap * sizes[s]}
        if not over:
            return target
        full |= over


@pytest.mark.parametrize("seed", range(3))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i}": rng.choice([0, 3, 50, 1000, 100_000]) for i in range(14)} | {None: 77, "Ä": 12}
    got = source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    expected = brute_targets(sizes)
    assert {r.source: pytest.approx(r.target) for r in got} == expected


def test_numbered(spark):
    df = spark.range(500).select((F.col("id") * 7 % 501).alias("k")).repartition(7)
    assert sorted((r.place, r.k) for r in numbered(df, F.col("k")).collect()) == list(enumerate(sorted(i * 7 % 501 for i in range(500))))


def test_pivotal_keeps_words_and_means():
    rng = np.random.default_rng(0)
    size, chance = rng.integers(1, 60, 40).astype(float), rng.random(40)
    total = np.zeros(40)
    for _ in range(4000):
        out = pivotal(size, chance, rng)
        assert abs(size @ out - size @ chance) < 1e-6
        assert ((out > 1e-9) & (out < 1 - 1e-9)).sum() <= 1
        total += out
    assert np.abs(total / 4000 - chance).max() < 0.05


def test_mix(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one = mix(df, fan_in=50).select("doc_id", "size", "source_size", "target", "taken", "source").collect()
    assert sorted(map(str, one)) == sorted(map(str, mix(df.repartition(9), fan_in=50).select("doc_id", "size", "source_size", "target", "taken", "source").collect()))
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in one:
        assert r["size"] == len(rows[r.doc_id][1].split()) and r.taken % max(1, r["size"]) == 0 and r.taken <= 2 * r["size"]
        size[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert len(one) == 3000 and {s: pytest.approx(t) for s, t in target.items()} == brute_targets(size)
    assert all(abs(taken[s] - target[s]) <= 60 for s in target)


def test_odd_rows(spark, odd_docs, odd_rows, no_docs):
    got = mix(odd_docs).collect()
    words = sorted((str(r[0]), len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))) for r in odd_rows)
    assert sorted((str(r.doc_id), r["size"]) for r in got) == words
    out = repeat_by_mix(odd_docs)
    assert out.columns == odd_docs.columns
    assert out.count() == sum(r.copies for r in got)
    assert mix(no_docs).count() == 0 and repeat_by_mix(no_docs).count() == 0


def test_many_rows_without_id_and_alike(spark, monkeypatch):
    """A third of all rows alike, a third without an id: no bucket or part of them is large, and no row is lost."""
    monkeypatch.setattr("fathomwire.llm.mixing.ALIKE", 100)
    rng = random.Random(2)
    rows = [(None, " ".join(["w"] * rng.randint(1, 60)), "a", "x") for _ in range(1000)] + [(7, "one two three", "b", "x")] * 1000
    rows += [(100 + i, " ".join(["w"] * rng.randint(0, 60)), "c", "x") for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _taken_size string")
    got = mix(df, fan_in=50)
    counts = {r.source: r["n"] for r in got.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert counts == {"a": 1000, "b": 1000, "c": 1000}
    sums = got.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.sum("copies").alias("copies")).collect()
    assert all(abs(r.taken - r.target) <= 60 for r in sums)
    again = repeat_by_mix(df, fan_in=50)
    assert again.columns == df.columns and {r.source: r["n"] for r in again.groupBy("source").agg(F.count("*").alias("n")).collect()} == {r.source: r.copies for r in sums}
    assert {(r.doc_id, r.text, r.source) for r in again.collect()} <= {r[:3] for r in rows}
    buckets = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, source string").filter("doc_id IS NULL")
    assert buckets.groupBy(F.pmod(F.xxhash64("doc_id", F.size(F.split("text", " ")).cast("long"), F.lit(1), F.lit(1)), F.lit(20))).count().count() > 10
