"""Filters of keys: nothing is lost, however full they are, and texts of rows that need no join stay where they are."""

from __future__ import annotations

import random

import pytest
from odd import words
from pyspark.sql import functions as F

from fathomwire.llm import minhash, mixing
from fathomwire.llm.common import key_filter, may_hold


def moved(df) -> int:
    """Bytes in the exchanges of ``df`` as it ran."""
    df.collect()

    def walk(plan) -> int:
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(plan.executedPlan())
        own = plan.metrics().apply("dataSize").value() if name == "ShuffleExchangeExec" else 0
        inner = [plan.plan()] if name.endswith("QueryStageExec") else [plan.children().apply(i) for i in range(plan.children().size())]
        return own + sum(map(walk, inner))

    return walk(df._jdf.queryExecution().executedPlan())


@pytest.fixture(scope="module")
def pages(spark):
    """600 texts of about 2 kB, some of them nearly alike, some alike in id and text."""
    rng = random.Random(3)
    rows = [(i, words(rng, 400), "en", f"s{i % 4}") for i in range(560)]
    rows += [(1000 + i, rows[i][1] + " more", "en", "s1") for i in range(30)] + rows[40:50]
    rows += [(None, rows[60][1], "en", None), (None, "one of a kind", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


@pytest.mark.parametrize("most", [1, 1 << 14])
def test_no_key_is_lost(spark, monkeypatch, most):
    monkeypatch.setattr("fathomwire.llm.common.FILTER_BLOCKS", most)
    keys = spark.range(20_000).select(F.xxhash64("id").alias("h"), (F.col("id") % 3).cast("int").alias("kind"))
    found = key_filter(keys, 4, 12)
    assert found[0].count() == found[1] <= most
    got = may_hold(spark.range(40_000), F.xxhash64("id"), found)
    assert got.count() == 40_000
    for k in range(3):
        own = got.filter(F.col(f"_fathomwire_may_{k}"))
        assert own.filter((F.col("id") % 3 == k) & (F.col("id") < 20_000)).count() == len(range(k, 20_000, 3))
        assert most == 1 or own.count() < 1.01 * len(range(k, 20_000, 3)) + 100
    assert got.filter("_fathomwire_may_3").isEmpty()
    assert may_hold(spark.range(5), F.xxhash64("id"), key_filter(keys.limit(0), 1, 12)).filter("_fathomwire_may_0").isEmpty()


@pytest.fixture
def merge_joins(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_few_texts_move(spark, pages, merge_joins, monkeypatch):
    size = pages.agg(F.sum(F.length("text"))).first()[0]
    assert moved(mixing.repeat_by_mix(pages.filter("doc_id >= 50"))) < 0.3 * size
    assert moved(minhash.keep_first(pages)) < 0.4 * size
    parts = {}
    stored = minhash.stored

    def watched(df, label, *more):
        if label == "texts":
            parts[label] = moved(df)
        return stored(df, label, *more)

    monkeypatch.setattr(minhash, "stored", watched)
    minhash.near_duplicates(pages).count()
    assert parts["texts"] < 0.5 * size


def test_full_filters_change_nothing(spark, pages, monkeypatch):
    """Every key in one block of 4096 bits: many a row may be anything, and the exact joins decide."""
    monkeypatch.setattr("fathomwire.llm.common.FILTER_BLOCKS", 1)
    rows = [tuple(r) for r in pages.collect()]
    kept = [tuple(r) for r in minhash.keep_first(pages).collect()]
    assert len(kept) == len(set(kept)) and set(kept) <= set(rows)
    assert sorted(str(r[0]) for r in kept) == sorted(map(str, [*range(560), None]))
    once = pages.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    taken = {r.doc_id: r.copies for r in mixing.mix(once).collect()}
    assert sorted(set(taken.values())) == [0, 1, 2]
    got = {r.doc_id: r["count"] for r in mixing.repeat_by_mix(once).groupBy("doc_id").count().collect()}
    assert got == {k: n for k, n in taken.items() if n}

