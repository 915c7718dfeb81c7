"""Operator 6: mix sources to target weights by pivotal dependent rounding.

Sources get targets by weight, capped, with the excess shared again.  A document's wanted copies are its
source's target over the source's size: a whole part, and a fraction that is rounded.  Pivotal
rounding takes two documents with fractions and moves words from one to the other, either way at random with
probabilities that keep each one's mean, until one is at 0 or 1 copy.  The source's words stay exact
at each step.  A bucket of documents ends with one fraction; the residuals of up to ``fan_in`` buckets meet on the next level
of a reduction tree, until a source has one, which is rounded by its own probability.  So a source's words
miss its target by less than one document.

Scale: texts are read once, for their sizes, and never shuffle.  A bucket holds about ``fan_in`` rows, so a hot source is many
buckets, and so are rows without an id or alike in everything.  Levels grow with the logarithm of the rows.  Seeds come from ids, so reruns agree.

Edge cases: a null text has size 0 and takes 0; a null source is a source, the last; rows alike in doc_id, source
and size are told apart by a number; a source of size 0 has target 0; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import apart, key_filter, may_hold, stored

WORD = r"[^\x20\x09-\x0D]+"
ALIKE = 4096  # rows alike that one task makes or numbers at a time


def numbered(df: DataFrame, *keys) -> DataFrame:
    """``df`` with ``place`` (from 0) in the order of ``keys``: ranked inside ranges, then shifted by the ranges before."""
    parts = stored(df.repartitionByRange(*keys).withColumn("part", F.spark_partition_id()), "ranges")
    base, total = [], 0
    for r in sorted(parts.groupBy("part").count().collect()):  # a row for each range
        base.append((r[0], total))
        total += r[1]
    shift = F.element_at(F.create_map(*[F.lit(x) for pair in base for x in pair]), F.col("part")) if base else F.lit(0)
    return parts.withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy(*keys)) - 1 + shift).drop("part")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target) for ``sizes`` (source, source_size); ``weights`` repeat over the sources in code-point order, null last."""
    placed = numbered(sizes, F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.pmod(F.col("place"), F.lit(len(weights))) + 1).cast("int"))
    rows = stored(placed.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * cap).alias("cap")), "sources")
    wanted = share * float(rows.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = 0.0, -1
    while True:  # each turn caps a source at least, or ends
        full = F.col("cap") < F.col("weight") * level
        r = rows.agg(F.count_if(full).alias("n"), F.sum(F.when(full, F.col("cap"))).alias("held"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        if r.n == capped or not r.open:
            break
        capped, level = r.n, (wanted - (r.held or 0.0)) / r.open
    return rows.select("source", "source_size", F.least("cap", F.col("weight") * level).alias("target"))


def pivotal(size: np.ndarray, chance: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Chances after rounding all but one: each 0 or 1, the words ``size @ chance`` unchanged."""
    out = chance.astype(np.float64).copy()
    draws = rng.random(len(out))
    a = 0
    for b in range(1, len(out)):
        s, t, p, q = size[a], size[b], out[a], out[b]
        to_a, to_b = min((1 - p) * s, q * t), min(p * s, (1 - q) * t)
        if draws[b] * (to_a + to_b) < to_b:  # words move to a with the chance to_b / (to_a + to_b)
            if (1 - p) * s <= q * t:
                out[a], out[b] = 1.0, q - (1 - p) * s / t
                open_a = False
            else:
                out[a], out[b] = p + q * t / s, 0.0
                open_a = True
        elif p * s <= (1 - q) * t:
            out[a], out[b] = 0.0, q + p * s / t
            open_a = False
        else:
            out[a], out[b] = p - (1 - q) * t / s, 1.0
            open_a = True
        if not open_a:
            a = b
    return out


ROW = "doc_id long, source string, size long, source_size long, target double, copies int, chance double, nth int, bucket long"


def rounding(seed: int, depth: int, fan_in: int, last: bool):
    """The work of a bucket on one level: all rows but one are settled, on the last level that one too."""

    def round_bucket(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, [("doc_id", "ascending"), ("nth", "ascending"), ("size", "ascending")]))
        rng = np.random.default_rng([seed, depth, zlib.crc32(str([x.as_py() for x in key]).encode())])
        # longest first, so that the row that stays open at the end is a short one
        dealt = rng.permutation(rows.num_rows)
        rows = rows.take(pa.array(dealt[np.argsort(-rows["size"].to_numpy()[dealt], kind="stable")]))
        chance = pivotal(rows["size"].to_numpy().astype(np.float64), rows["chance"].to_numpy(), rng)
        chance = np.where(chance < 1e-9, 0.0, np.where(chance > 1 - 1e-9, 1.0, chance))
        if last:
            chance = (rng.random(len(chance)) < chance).astype(np.float64)
        whole = chance == 1.0
        new = {"copies": pa.array(rows["copies"].to_numpy() + whole, pa.int32()), "chance": pa.array(np.where(whole, 0.0, chance)), "bucket": pa.array(rows["bucket"].to_numpy() // fan_in)}
        return pa.table({name: new.get(name, rows[name]) for name in rows.column_names})

    return round_bucket


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, fan_in: int = 1024, seed: int = 1) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source, copies, nth): one row for each document; ``taken`` = size * copies."""
    sized = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    rows = stored(sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("alike")), "sizes")
    per_source = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("alike")).alias("source_size"), F.sum("alike").alias("n"))
    targets = source_targets(per_source.select("source", "source_size"), weights, share, cap)
    targets = targets.join(per_source.select(F.col("source").alias("own"), "n"), F.col("source").eqNullSafe(F.col("own"))).drop("own")
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(cap))).otherwise(F.lit(0.0))
    targets = stored(
        targets.select(
            F.col("source").alias("own"),
            "source_size",
            "target",
            F.floor(ratio + 1e-12).cast("int").alias("copies"),
            F.greatest(ratio - F.floor(ratio + 1e-12), F.lit(0.0)).alias("chance"),
            F.ceil(F.col("n") / fan_in).cast("long").alias("buckets"),
        ),
        "targets",
    )
    each = rows.join(targets, F.col("source").eqNullSafe(F.col("own"))).withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("alike") - 1) / ALIKE))))
    if (rows.agg(F.max("alike")).first()[0] or 0) > ALIKE:  # one row would become more than a task should make
        each = each.repartition("doc_id", "source", "size", "turn")
    first = F.col("turn") * ALIKE
    each = each.withColumn("nth", F.explode(F.sequence(first + 1, F.least(first + ALIKE, F.col("alike"))))).withColumn("nth", F.col("nth").cast("int"))
    bucket = F.pmod(F.xxhash64("doc_id", "size", "nth", F.lit(seed)), F.col("buckets"))
    level = stored(each.select("doc_id", "source", "size", "source_size", "target", "copies", F.when((F.col("size") > 0) & (F.col("chance") > 0), F.col("chance")).otherwise(0.0).alias("chance"), "nth", bucket.alias("bucket")), "level")
    done = [level.filter("chance = 0")]
    open_rows, depth = level.filter("chance > 0"), 0
    buckets = targets.agg(F.max("buckets")).first()[0] or 1

    while True:
        last = buckets <= 1

        level = stored(open_rows.groupBy("source", "bucket").applyInArrow(rounding(seed, depth, fan_in, last), ROW), "level")
        done.append(level.filter("chance = 0"))
        if last:
            break
        open_rows, buckets, depth = level.filter("chance > 0"), math.ceil(buckets / fan_in), depth + 1
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies", "nth")


def numbered_alike(rows: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` with ``_fathomwire_nth``, from 1 among those of a key, however many: counted in small parts, and shifted by the parts before."""
    parts = stored(rows.withColumn("_fathomwire_part", F.floor(F.monotonically_increasing_id() / ALIKE)), "parts")
    every = [*key, "_fathomwire_part"]
    before = Window.partitionBy(*key).orderBy("_fathomwire_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = parts.groupBy(*every).agg(F.count("*").alias("n")).withColumn("_fathomwire_shift", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    shift = shift.select(*[F.col(c).alias(f"{c}_own") for c in every], "_fathomwire_shift")
    placed = parts.withColumn("_fathomwire_place", F.row_number().over(Window.partitionBy(*every).orderBy(F.xxhash64("text"))))
    same = [F.col(c).eqNullSafe(F.col(f"{c}_own")) for c in every]
    out = placed.join(shift, reduce(lambda a, b: a & b, same))
    return out.withColumn("_fathomwire_nth", F.col("_fathomwire_place") + F.col("_fathomwire_shift")).drop("_fathomwire_part", "_fathomwire_place", "_fathomwire_shift", *[f"{c}_own" for c in every])


def repeat_by_mix(docs: DataFrame, **options) -> DataFrame:
    """``docs``, each row as often as the mix takes it; rows alike in doc_id, source and size stand for one another."""
    docs, back = apart(docs)
    taken = stored(mix(docs, **options).select("doc_id", "source", "size", "nth", "copies"), "taken")
    key = {"_fathomwire_id": F.col("doc_id").cast("long"), "_fathomwire_source": F.col("source").cast("string"), "_fathomwire_size": F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")}
    rows = docs.withColumns(key)
    most = taken.agg(F.max("nth")).first()[0] or 0
    if most <= 1:
        rows = rows.withColumn("_fathomwire_nth", F.lit(1))
    elif most <= ALIKE:
        rows = rows.withColumn("_fathomwire_nth", F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64("text"))))
    else:
        rows = numbered_alike(rows, list(key))
    if most > 1:
        return back(copied(rows, taken))
    # where an id, source and size are one row's: a row that may be among those of one number of copies alone needs no join, so its text doesn't move
    times = sorted(r.copies for r in taken.select("copies").distinct().collect())  # a few whole numbers: 0 to ``cap``
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in zip(times, range(len(times))) for x in pair]), F.col("copies")) if times else F.lit(0)
    found = key_filter(taken.select(F.xxhash64("doc_id", "source", "size").alias("h"), kind.alias("kind")), len(times), 4)
    told = may_hold(rows, F.xxhash64(*key), found)
    may = [F.col(f"_fathomwire_may_{k}") for k in range(len(times))]
    alone = reduce(lambda a, b: a + b, [x.cast("int") for x in may], F.lit(0)) == 1
    sure = reduce(lambda a, b: a.when(b[0], b[1]), zip(may, times), F.when(F.lit(False), 0))
    sure = told.filter(alone).withColumn("_fathomwire_copies", sure).filter("_fathomwire_copies > 0").withColumn("_fathomwire_copy", F.explode(F.sequence(F.lit(1), "_fathomwire_copies")))
    return back(sure).unionByName(back(copied(told.filter(~alone), taken)))


def copied(rows: DataFrame, taken: DataFrame) -> DataFrame:
    """``rows``, joined to the copies in ``taken`` and repeated."""
    own = taken.filter("copies > 0").select(*[F.col(c).alias(f"_taken_{c}") for c in taken.columns])
    same = F.col("_fathomwire_id").eqNullSafe(F.col("_taken_doc_id")) & F.col("_fathomwire_source").eqNullSafe(F.col("_taken_source")) & (F.col("_fathomwire_size") == F.col("_taken_size")) & (F.col("_fathomwire_nth") == F.col("_taken_nth"))
    return rows.join(own, same).withColumn("_fathomwire_copy", F.explode(F.sequence(F.lit(1), "_taken_copies")))
