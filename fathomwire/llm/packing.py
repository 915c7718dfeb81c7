"""Operator 2: best-fit packing of token pieces by a grouping genetic algorithm on islands.

A document's ids end with an end id; only a longer one is cut, into pieces of ``capacity`` ids.  A
full piece is a sequence of its own.  The others are dealt by a hash into problems of about
``problem_size`` pieces.  Each problem lives on several islands, each a Spark group with its own
population.  An individual is a list of bins; the first ones are best-fit packings of noisy orders.  Crossover injects whole well-filled bins of
one parent into the other, drops bins that hold a piece twice, and puts the displaced pieces back: first in place of a shorter piece where that fills
a bin better, then the rest by best fit, longest first.  After an epoch each island's elite migrates to the next island of its problem; the best
individual of all islands decides.  An island stops at a lower bound of the bins, or after ``patience`` children without gain.  Bins left slack by their
problem are opened, and a second round packs their pieces together across problems.

Where lengths leave room for it (500 to 900 of 2048, say), evolution saves 6 % of the bins of best-fit decreasing; on the given documents, which hold many
short texts, the first individuals mostly meet the bound, and evolution has a bin or none to gain.

Scale: texts never shuffle; a piece's row is four numbers.  A group holds ``problem_size`` pieces
whatever the input, and there are as many groups as the input needs.  Results don't depend on where
tasks run: every random choice is seeded by problem and island.

Edge cases: a null or empty text is one piece with just the end id; repeated rows are separate
pieces; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import empty_text, stored, text_slices
from .tokens import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """A row for each piece of each document; ``with_ids`` adds the ids as little-endian 4-byte integers."""
    end = np.array([end_id], "<u4").tobytes()
    step = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer_path)
        try:
            for batch in batches:
                for i, j, data, off in text_slices(batch.column(1), 2 << 20):
                    ids, bounds = own.many(data, off)
                    rows = []
                    for doc, a, b in zip(batch.column(0).slice(i, j - i).to_pylist(), bounds.tolist(), bounds[1:].tolist(), strict=False):
                        raw = ids[a:b].tobytes() + end
                        for k, at in enumerate(range(0, len(raw), step)):
                            piece = raw[at : at + step]
                            rows.append((doc, k, at // 4, len(piece) // 4, zlib.crc32(piece), piece if with_ids else None))
                    cols = list(zip(*rows, strict=True))
                    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                    n = 6 if with_ids else 5
                    yield pa.record_batch([pa.array(c, k) for c, k in list(zip(cols, kinds, strict=True))[:n]], names[:n])
        finally:  # Spark keeps the worker for other stages
            own.forget()

    return docs.select(F.col("doc_id").cast("long"), empty_text().alias("text")).mapInArrow(run, PIECES + ", ids binary" * with_ids)


Individual = tuple[list[list[int]], list[int]]  # the pieces of each bin, and its room


def lower_bound(lengths: list[int], capacity: int) -> int:
    """Bins that any packing needs: for each size k, pieces above half a bin and above capacity - k leave only so much room for those from k to a half."""
    own = np.sort(np.asarray(lengths, np.int64))
    if len(own) == 0:
        return 0
    total = np.concatenate(([0], np.cumsum(own)))
    half = int(np.searchsorted(own, capacity // 2, side="right"))
    sizes = np.unique(np.concatenate(([1], own[:half])))
    low, high = np.minimum(np.searchsorted(own, sizes), half), np.maximum(np.searchsorted(own, capacity - sizes, side="right"), half)
    room = (high - half) * capacity - (total[high] - total[half])
    small = total[half] - total[low]
    return int((len(own) - half + np.maximum(0, -((room - small) // capacity))).max())


def best_fit(lengths: list[int], items: list[int], bins: list[list[int]], room: list[int], capacity: int) -> None:
    """Put ``items``, longest first, each into the open bin with the least room that still holds it."""
    by_room: dict[int, list[int]] = {}
    mask = 0
    for b, r in enumerate(room):
        if r:
            by_room.setdefault(r, []).append(b)
            mask |= 1 << r
    for i in sorted(items, key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        fits = mask >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                mask &= ~(1 << r)
            bins[b].append(i)
        else:
            r, b = capacity, len(bins)
            bins.append([i])
            room.append(capacity)
        room[b] = left = r - n
        if left:
            by_room.setdefault(left, []).append(b)
            mask |= 1 << left


def put_back(lengths: list[int], bins: list[list[int]], room: list[int], loose: list[int], capacity: int) -> None:
    """Put displaced pieces into bins: one in place of a shorter piece of a bin where that leaves the least room, then the rest by best fit."""
    sizes = sorted((lengths[i], i) for i in loose)
    for b, r in enumerate(room):
        if not r or not sizes:
            continue
        gain, place, pick = 0, -1, -1
        for at, i in enumerate(bins[b]):
            k = bisect_left(sizes, (lengths[i] + r + 1, -1)) - 1
            if k >= 0 and sizes[k][0] - lengths[i] > gain:
                gain, place, pick = sizes[k][0] - lengths[i], at, k
        if gain:
            out = bins[b][place]
            bins[b][place] = sizes.pop(pick)[1]
            insort(sizes, (lengths[out], out))
            room[b] = r - gain
    best_fit(lengths, [i for _, i in sizes], bins, room, capacity)


def fitness(one: Individual, capacity: int) -> tuple[int, int]:
    """Fewer bins first, then fuller ones: the sum of squared fills, which is larger when mass gathers in few bins."""
    return -len(one[0]), sum((capacity - r) ** 2 for r in one[1])


def crossover(lengths: list[int], one: Individual, two: Individual, capacity: int, rng: np.random.Generator) -> Individual:
    """Inject about half of the fuller half of ``one``'s bins into ``two``."""
    full = sorted(range(len(one[0])), key=lambda b: (one[1][b], b))[: max(1, len(one[0]) // 2)]
    chosen = [b for b, x in zip(full, rng.random(len(full)), strict=True) if x < 0.5] or full[:1]
    held = {i for b in chosen for i in one[0][b]}
    bins, room, loose = [list(one[0][b]) for b in chosen], [one[1][b] for b in chosen], []
    for b, r in zip(*two, strict=True):
        own = [i for i in b if i not in held]
        if len(own) == len(b):
            bins.append(own)
            room.append(r)
        else:  # the bin holds a piece twice: it goes, its other pieces are displaced
            loose += own
    put_back(lengths, bins, room, loose, capacity)
    return bins, room


def mutate(lengths: list[int], one: Individual, capacity: int, rng: np.random.Generator) -> Individual:
    """Open the emptiest bins and a few others, and put their pieces back."""
    n = len(one[0])
    opened = set(sorted(range(n), key=lambda b: (-one[1][b], b))[: max(1, n // 20)]) | set(rng.integers(0, n, max(1, n // 50)).tolist())
    keep = [k for k in range(n) if k not in opened]
    bins, room = [list(one[0][k]) for k in keep], [one[1][k] for k in keep]
    put_back(lengths, bins, room, [i for k in sorted(opened) for i in one[0][k]], capacity)
    return bins, room


def noisy(lengths: list[int], capacity: int, rng: np.random.Generator, run: int = 50) -> Individual:
    """A packing by best fit of runs of an order that is only about longest first, so that individuals differ."""
    noise = rng.uniform(0.8, 1.25, len(lengths)).tolist()
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i] * noise[i])
    bins: list[list[int]] = []
    room: list[int] = []
    for k in range(0, len(order), run):
        best_fit(lengths, order[k : k + run], bins, room, capacity)
    return bins, room


def evolve(lengths: list[int], guests: list[list[list[int]]], capacity: int, seed: int, population: int, generations: int, patience: int) -> tuple[list[list[int]], int]:
    """(the best individual's bins, the bins of the best seed); ``guests`` are elites that came in."""
    lengths = [int(n) for n in lengths]
    if not lengths:
        return [], 0
    rng = np.random.default_rng(seed)
    least = lower_bound(lengths, capacity)
    people = [([list(b) for b in g], [capacity - sum(lengths[i] for i in b) for b in g]) for g in guests]
    while len(people) < population and not any(len(p[0]) <= least for p in people):
        people.append(noisy(lengths, capacity, rng))
    score = [fitness(p, capacity) for p in people]
    seeded, still = -max(score)[0], 0
    for _ in range(generations):
        best = max(score)
        if -best[0] <= least or still >= patience or len(people) < 2:
            break
        a, b = rng.choice(len(people), 2, replace=False)
        child = crossover(lengths, people[a], people[b], capacity, rng)
        if rng.random() < 0.5:
            child = mutate(lengths, child, capacity, rng)
        own = fitness(child, capacity)
        still = 0 if own > best else still + 1
        worst = min(range(len(people)), key=lambda k: score[k])
        if own > score[worst]:
            people[worst], score[worst] = child, own
    found = people[max(range(len(people)), key=lambda k: score[k])]
    if len(found[0]) > least:  # plain best-fit decreasing, should it be better
        plain: Individual = ([], [])
        best_fit(lengths, list(range(len(lengths))), *plain, capacity)
        found = max(found, plain, key=lambda p: fitness(p, capacity))
    return found[0], seeded


def _genome(bins: list[list[int]], n: int) -> bytes:
    out = np.zeros(n, "<i4")
    for k, b in enumerate(bins):
        out[b] = k
    return out.tobytes()


def _bins(genome: bytes) -> list[list[int]]:
    of = np.frombuffer(genome, "<i4")
    by = np.argsort(of, kind="stable")
    return [x.tolist() for x in np.split(by, np.flatnonzero(np.diff(of[by])) + 1)] if len(of) else []


def pack(
    pieces: DataFrame,
    capacity: int = 2048,
    problem_size: int = 2000,
    islands: int = 2,
    epochs: int = 2,
    population: int = 6,
    generations: int = 100,
    patience: int = 20,
    rounds: int = 2,
    slack: float = 0.9,
    report: list[DataFrame] | None = None,
) -> DataFrame:
    """(piece_key, sequence_id, offset) for ``pieces`` (piece_key long, unique; length long, 1 to ``capacity``).

    Rows with a null length, or one outside that range, are an error of the caller.  To ``report`` goes, for each round, a table of
    (problem, island, epoch, seeded, bins): the bins of the best first individual and of the result.
    """
    spark = pieces.sparkSession
    own = F.struct(F.col("piece_key").alias("k"), F.col("length").cast("int").alias("n"))
    placed, left = None, pieces.select("piece_key", "length")
    for turn in range(rounds):
        problems = max(1, math.ceil(left.count() / problem_size))
        # one row a problem and island: its pieces in a fixed order
        groups = stored(
            left.groupBy(F.pmod(F.xxhash64("piece_key", F.lit(turn)), F.lit(problems)).alias("problem"))
            .agg(F.array_sort(F.collect_list(own)).alias("items"))
            .select("problem", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.col("items.k").alias("keys"), F.col("items.n").alias("lengths")),
            "problems",
        )
        elites, said = None, []
        for epoch in range(epochs):
            if elites is None:
                have = groups.withColumn("guest", F.lit(None).cast("binary"))
            else:
                moved = elites.select("problem", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("genome").alias("guest"))
                home = elites.select("problem", "island", F.col("genome").alias("own"))
                have = groups.join(moved, ["problem", "island"]).join(home, ["problem", "island"])

            def run(batches: Iterator[pd.DataFrame], epoch: int = epoch, turn: int = turn) -> Iterator[pd.DataFrame]:
                for pdf in batches:
                    rows = []
                    for r in pdf.itertuples(index=False):
                        lengths = np.asarray(r.lengths, np.int64)
                        guests = [_bins(g) for g in (getattr(r, "own", None), r.guest) if g is not None]
                        seed = zlib.crc32(f"{turn}:{epoch}:{r.problem}:{r.island}".encode())
                        bins, seeded = evolve(lengths.tolist(), guests, capacity, seed, population, generations, patience)
                        fuller = float(sum(int(lengths[b].sum()) ** 2 for b in bins))
                        rows.append((r.problem, r.island, -len(bins), fuller, _genome(bins, len(lengths)), seeded))
                    yield pd.DataFrame(rows, columns=["problem", "island", "fewer", "fuller", "genome", "seeded"])

            elites = stored(have.mapInPandas(run, "problem long, island int, fewer int, fuller double, genome binary, seeded int"), "elites")
            said.append(elites.select("problem", "island", F.lit(epoch).alias("epoch"), "seeded", (-F.col("fewer")).alias("bins")))
        if report is not None:
            report.append(reduce(DataFrame.unionByName, said))
        best = elites.groupBy("problem").agg(F.max(F.struct("fewer", "fuller", -F.col("island"), "genome")).alias("best"))

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for r in pdf.itertuples(index=False):
                    of = np.frombuffer(r.genome, "<i4").astype(np.int64)
                    lengths, keys = np.asarray(r.lengths, np.int64), np.asarray(r.keys, np.int64)
                    by = np.lexsort((keys, of))
                    ends = np.cumsum(lengths[by])
                    first = np.flatnonzero(np.concatenate(([True], np.diff(of[by]) != 0))) if len(by) else np.zeros(0, np.int64)
                    begin = np.repeat((ends - lengths[by])[first], np.diff(np.append(first, len(by))))
                    total = np.bincount(of, lengths, minlength=1)
                    yield pd.DataFrame({"piece_key": keys[by], "length": lengths[by], "sequence_id": (r.problem << 24) + of[by], "offset": ends - lengths[by] - begin, "filled": total[of[by]].astype(np.int64)})

        rows = groups.filter("island = 0").join(best.select("problem", "best.genome"), "problem")
        out = stored(rows.mapInPandas(place, "piece_key long, length long, sequence_id long, offset long, filled long"), "placed")
        last = turn == rounds - 1 or problems == 1
        done = out if last else out.filter(F.col("filled") >= slack * capacity)
        done = done.select("piece_key", (F.col("sequence_id") + F.lit(turn << 58)).alias("sequence_id"), "offset")
        placed = done if placed is None else placed.unionByName(done)
        if last:
            break
        left = out.filter(F.col("filled") < slack * capacity).select("piece_key", "length")
    return placed


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, **options) -> DataFrame:
    """PIECES with sequence_id and offset."""
    pieces = stored(token_pieces(docs, tokenizer_path, capacity, end_id).withColumn("piece_key", F.monotonically_increasing_id()), "pieces")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    full = pieces.filter(F.col("length") == capacity).select(*columns, (-F.col("piece_key") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.filter(F.col("length") < capacity)
    return full.unionByName(rest.join(pack(rest, capacity, **options), "piece_key").select(*columns, "sequence_id", "offset"))
