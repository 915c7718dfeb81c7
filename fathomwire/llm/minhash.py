"""Operator 7: near duplicates by DartMinHash signatures and banded joining.

A document is the weighted set of its five-word shingles; a shingle's weight is how often it occurs.
Hashed darts fall on the plane of every shingle, weight across and rank up, one on the
average in each unit cell, at places that only the shingle and the cell decide.  A dart within a document's weight and
below the rank ``need / total weight`` hits; it belongs to one of ``bands * rows`` coordinates, and
each coordinate keeps its earliest dart.  Two documents agree in a coordinate with the probability of
their weighted Jaccard similarity.  A signature costs one pass over the document's shingles, however
long the signature is; if a coordinate stays empty, the rank doubles.

Steps: (1) equal texts become one node; (2) nodes that agree in all coordinates of a band share a bucket, and each is held
against the bucket's first node; (3) those pairs are verified exactly on whole texts and joined to components; (4) buckets that still hold
several components are compared inside, by 8-bit sketches of the signatures: blocks of strays, which are the nodes outside the bucket's largest component,
with blocks of all its nodes, across components only, each pair in the first bucket that it shares by the bands' whole keys; what looks similar is verified on
whole texts, in parts of bounded bytes, until the components meet; (5) components again.  Pairs inside a bucket never become rows, and a bucket has no cap:
its nodes move once for each ``block`` strays.

With 24 bands of 5 rows a pair of similarity 0.8 misses every bucket with a probability of 7e-5.  The least share of equal sketches
follows from the similarity that is asked for, so that a pair at it falls below with a probability of 1e-7 at most.

Edge cases: words are runs other than space and tab to carriage return; a text of one to four words is one
shingle; an empty or null text has none, so empty texts are alike and like nothing else; repeated
rows each get a row; a null doc_id counts in its class, and the class id is the smallest that is not null; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GOLD, apart, counted_shingles, empty_text, key_filter, may_hold, mix, stored, text_slices

# The cumulative probabilities of a Poisson count of mean 1.
POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(17)])
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
CELLS = 1 << 16


def throw(row: np.ndarray, element: np.ndarray, weight: np.ndarray, reach: np.ndarray, coordinates: int, out: np.ndarray) -> None:
    """Throw darts at unit cells below the rank ``reach`` (by row); ``out`` (rows x coordinates) keeps the earliest."""
    flat = out.reshape(-1)
    across, up = np.ceil(weight).astype(np.int64), np.ceil(reach).astype(np.int64)[row]
    cells = across * up
    cuts = [0]
    while cuts[-1] < len(row):  # about CELLS cells at a time
        total = np.cumsum(cells[cuts[-1] :])
        cuts.append(cuts[-1] + max(1, int(np.searchsorted(total, CELLS, side="right"))))
    for i, j in zip(cuts, cuts[1:], strict=False):
        n = cells[i:j]
        which = np.repeat(np.arange(i, min(j, len(row))), n)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        x, y = nth // up[which], nth % up[which]
        with np.errstate(over="ignore"):
            cell = mix(element[which] + mix(x.astype(np.uint64) * GOLD + y.astype(np.uint64) + np.uint64(1)))
        darts = np.searchsorted(POISSON, (cell >> np.uint64(11)) * 2.0**-53)
        for k in range(int(darts.max(initial=0))):
            at = np.flatnonzero(darts > k)
            with np.errstate(over="ignore"):
                dart = mix(cell[at] + np.uint64(k + 1) * GOLD)
                other = mix(dart ^ GOLD)
            rank = y[at] + (dart >> np.uint64(40)) * 2.0**-24
            own = which[at]
            hit = rank < reach[row[own]]
            hit &= x[at] + (other >> np.uint64(40)) * 2.0**-24 < weight[own]
            own, dart, other, rank = own[hit], dart[hit], other[hit], rank[hit]
            # earliest first: the rank in the high bits, the dart's own hash below
            value = (np.minimum(rank, 65535.0) * 2.0**24).astype(np.uint64) << np.uint64(24) | dart & np.uint64(0xFFFFFF)
            np.minimum.at(flat, row[own] * coordinates + (other & np.uint64(0xFFFFFFFF)).astype(np.int64) % coordinates, value)


def signatures(row: np.ndarray, element: np.ndarray, weight: np.ndarray, rows: int, coordinates: int) -> np.ndarray:
    """``rows`` x ``coordinates`` darts; NONE throughout for a row without elements."""
    out = np.full((rows, coordinates), NONE, np.uint64)
    total = np.bincount(row, weight, minlength=rows)
    need = coordinates * (math.log(coordinates) + 4.0)
    todo = total > 0
    while todo.any():
        part = todo[row]
        out[todo] = NONE
        throw(row[part], element[part], weight[part], np.where(todo, need / np.maximum(total, 1e-300), 0.0), coordinates, out)
        todo &= (out == NONE).any(1)
        need *= 2
    return out


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key for each row and band."""
    parts = signature.reshape(len(signature), bands, -1)
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64) * GOLD), parts.shape[:2]).copy()
    with np.errstate(over="ignore"):
        for i in range(parts.shape[2]):
            key = mix(key + parts[:, :, i])
    return key.astype(np.int64)


def signed(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, digest, keys, sketch, size) for each document, ``size`` in bytes; keys and sketch are null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in text_slices(batch.column(2)):
                row, element, times = counted_shingles(data, off, width)
                sig = signatures(row, element, times.astype(np.float64), j - i, bands * rows)
                void = (sig == NONE).all(1)
                sketch = (mix(sig) & np.uint64(255)).astype(np.uint8)
                keys = pa.ListArray.from_arrays(pa.array(np.arange(0, (j - i + 1) * bands, bands), pa.int32()), pa.array(band_keys(sig, bands).reshape(-1)), mask=pa.array(void))
                part = batch.slice(i, j - i)
                yield pa.record_batch([part.column(0), part.column(1), keys, pa.array([None if v else x.tobytes() for x, v in zip(sketch, void, strict=True)], pa.binary()), pa.array(np.diff(off))], ["doc_id", "digest", "keys", "sketch", "size"])

    text = empty_text()
    rows_in = docs.select(F.col("doc_id").cast("long"), F.unhex(F.md5(text)).alias("digest"), text.alias("text"))
    return rows_in.mapInArrow(run, "doc_id long, digest binary, keys array<long>, sketch binary, size long")


def similarity(texts: list[tuple[str, str]], width: int) -> np.ndarray:
    """Weighted Jaccard similarities of pairs of texts, by their counted shingles."""
    out = np.zeros(len(texts))
    for i in range(0, len(texts), 64):
        part = texts[i : i + 64]
        for _, _, data, off in [x for x in text_slices(pa.array([t for p in part for t in p]), 1 << 62)]:
            row, element, times = counted_shingles(data, off, width)
        pair = row // 2
        by = np.lexsort((element, pair))
        pair, element, times = pair[by], element[by], times[by]
        same = np.flatnonzero((pair[1:] == pair[:-1]) & (element[1:] == element[:-1]))
        common = np.bincount(pair[same], np.minimum(times[same], times[same + 1]), minlength=len(part))
        total = np.bincount(pair, times, minlength=len(part))
        out[i : i + len(part)] = common / np.maximum(total - common, 1)
    return out


def verified(pairs: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame:
    """The pairs (a, b) of nodes whose whole texts have a similarity of ``least`` or more; ``texts`` is (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                got = similarity(list(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)), width)
                yield pa.record_batch([part.column(0), part.column(1), pa.array(got)], ["a", "b", "similarity"])

    one = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    both = one.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")
    return stored(both.mapInArrow(run, "a long, b long, similarity double").filter(F.col("similarity") >= least), "links")


def components(links: DataFrame, trace: list[str] | None = None) -> DataFrame:
    """(node, root) for the nodes of ``links`` (a, b): the smallest node of each component.

    Each round hooks a node, and its parent, to the smallest grandparent beside it, and jumps to its own grandparent, so that
    paths shrink by a factor; a chain of 1,024 takes 8 rounds.  ``trace`` gets a line a round.
    """
    both = stored(links.select("a", "b").union(links.select("b", "a")).filter("a != b").distinct(), "links")
    roots = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root")), "roots")
    while True:
        grand = roots.join(roots.select(F.col("node").alias("root"), F.col("root").alias("up")), "root")
        near = both.join(grand.select(F.col("node").alias("b"), "up"), "b").groupBy(F.col("a").alias("node")).agg(F.min("up").alias("near"))
        low = grand.join(near, "node").select("node", "root", F.least("up", "near").alias("low"))
        hooks = low.groupBy(F.col("root").alias("node")).agg(F.min("low").alias("hook"))
        moved = low.join(hooks, "node", "left").select("node", "root", F.least("root", "low", "hook").alias("next"))
        new = stored(moved.select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("changed")), "roots")
        if trace is not None:
            trace.append(f"round {len(trace) + 1}")
        roots = new.select("node", "root")
        if new.filter("changed").isEmpty():
            return roots


def sketch_share(coordinates: int, least: float, miss: float = 1e-7) -> float:
    """The share of equal coordinates below which a pair of similarity ``least`` falls with a probability of ``miss`` at most."""
    below, count = 0.0, 0
    while count < coordinates:
        below += math.comb(coordinates, count) * least**count * (1 - least) ** (coordinates - count)
        if below > miss:
            break
        count += 1
    return max(0.0, (count - 0.5) / coordinates)  # half a coordinate of room for rounding


def near_sketches(left: pa.Array, right: pa.Array, band: int, bands: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (node of the strays ``left``, node of ``right``) in different components whose sketches agree in a share of ``least``, most alike first.

    Only pairs whose first common band by the bands' whole keys is ``band``: others are seen in another bucket.
    """

    def parts(side: pa.Array) -> tuple[np.ndarray, ...]:
        n, raw = len(side), side.field("sketch").to_pylist()
        sketch = np.frombuffer(b"".join(raw), np.uint8).reshape(n, -1)
        key = side.field("keys").flatten().to_numpy(zero_copy_only=False).reshape(n, bands)
        return (*(side.field(x).to_numpy(zero_copy_only=False) for x in ("node", "root", "stray")), sketch, key)

    node, root, _, sketch, key = parts(left)
    other, other_root, stray, other_sketch, other_key = parts(right)
    a, b, alike = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for i in range(len(node)):
        at = np.flatnonzero((other_root != root[i]) & (~stray | (other > node[i])))  # two strays meet twice
        share = (other_sketch[at] == sketch[i]).mean(1)
        at, share = at[share >= least], share[share >= least]
        keep = (other_key[at] == key[i]).argmax(1) == band
        a.append(np.full(int(keep.sum()), node[i]))
        b.append(other[at[keep]])
        alike.append(share[keep])
    a, b, alike = (np.concatenate(x) for x in (a, b, alike))
    by = np.argsort(-alike, kind="stable")
    return a[by], b[by]


def in_parts(a: np.ndarray, b: np.ndarray, size: dict[int, int], most: int) -> Iterator[tuple[list[int], list[int]]]:
    """The pairs in parts whose nodes have ``most`` bytes together, or are one pair; by node where one part doesn't hold all."""
    if sum(size[n] for n in {*a.tolist(), *b.tolist()}) > most:
        by = np.lexsort((b, a))
        a, b = a[by], b[by]
    first, held, total = 0, set(), 0
    for k, pair in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        more = sum(size[n] for n in pair if n not in held)
        if total + more > most and k > first:
            yield a[first:k].tolist(), b[first:k].tolist()
            first, held, total = k, set(), 0
            more = sum(size[n] for n in pair)
        held.update(pair)
        total += more
    if first < len(a):
        yield a[first:].tolist(), b[first:].tolist()


def linked_inside(a: np.ndarray, b: np.ndarray, node: np.ndarray, root: np.ndarray, texts: list[str], width: int, least: float) -> list[tuple[int, int, float]]:
    """Of the pairs (a, b) of a block, verified links that join components; a pair that others have joined needs no more."""
    place = {n: i for i, n in enumerate(node.tolist())}
    tree = {r: r for r in root.tolist()}

    def top(r: int) -> int:
        while tree[r] != r:
            tree[r] = r = tree[tree[r]]
        return r

    parts = [counted_shingles(data, off, width) + (i,) for i, _, data, off in text_slices(pa.array(texts, pa.string()))]
    row = np.concatenate([r + i for r, _, _, i in parts])
    element, times = (np.concatenate([p[k] for p in parts]) for k in (1, 2))
    total = np.bincount(row, times, minlength=len(texts))
    own = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(texts)))))
    by = np.argsort(element, kind="stable")
    posted, at_row, at_times = element[by], row[by], times[by]
    known: dict[int, np.ndarray] = {}

    def similar(i: int) -> np.ndarray:
        if i not in known:  # against all texts of the block at once
            mine = slice(own[i], own[i + 1])
            low, high = np.searchsorted(posted, element[mine], "left"), np.searchsorted(posted, element[mine], "right")
            n = high - low
            at = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            common = np.bincount(at_row[at], np.minimum(np.repeat(times[mine], n), at_times[at]), minlength=len(texts))
            known[i] = common / np.maximum(total + total[i] - common, 1)
        return known[i]

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        i, j = place[x], place[y]
        r, t = top(int(root[i])), top(int(root[j]))
        if r != t and (got := float(similar(i)[j])) >= least:
            tree[max(r, t)] = min(r, t)
            out.append((x, y, got))
    return out


def classes(docs: DataFrame, least: float, width: int, bands: int, rows: int, block: int, part_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(signed rows, nodes with digest, root, first and alike)."""
    sign = stored(signed(docs, width, bands, rows), "signed")
    nodes = stored(
        sign.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("alike"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"), F.first("size").alias("size")).withColumn("node", F.monotonically_increasing_id()),
        "nodes",
    )
    keyed = stored(nodes.filter("keys IS NOT NULL").select("node", F.posexplode("keys").alias("band", "key")), "keyed")
    hubs = keyed.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("n")).filter("n > 1")
    member = stored(keyed.join(hubs, "key"), "members")
    stars = stored(member.filter("node != hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "stars")
    # the text of one row of each node in a bucket
    wanted = stored(member.select("node").distinct().join(nodes.select("node", "digest", "first"), "node"), "wanted")
    text = empty_text()
    whole = docs.select(F.col("doc_id").cast("long").alias("first"), F.unhex(F.md5(text)).alias("digest"), text.alias("text"))
    # other texts stay where they are
    row = F.xxhash64("first", "digest")
    whole = may_hold(whole, row, key_filter(wanted.select(row.alias("h"), F.lit(0).alias("kind")), 1, 12)).filter("_fathomwire_may_0").drop("_fathomwire_may_0")
    same = (F.col("w.digest") == F.col("d.digest")) & F.col("w.first").eqNullSafe(F.col("d.first"))
    texts = stored(wanted.alias("w").join(whole.alias("d"), same).groupBy("w.node").agg(F.first("d.text").alias("text")), "texts")

    first_hub = stars.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = verified(first_hub, texts, width, least)
    roots = components(links)

    def rooted(df: DataFrame, column: str, name: str) -> DataFrame:
        found = roots.select(F.col("node").alias(column), F.col("root").alias("_root"))
        return df.join(found, column, "left").withColumn(name, F.coalesce("_root", column)).drop("_root")

    more = rooted(rooted(stars.join(first_hub, ["a", "b"], "left_anti"), "a", "root_a"), "b", "root_b").filter("root_a != root_b").select("a", "b")
    tried = stored(more, "tried")
    links = links.unionByName(verified(tried, texts, width, least))
    roots = components(links)

    inside = stored(rooted(member.select("key", "band", "node"), "node", "root"), "inside")
    by_root = inside.groupBy("key", "root").agg(F.count("*").alias("n"))
    split = by_root.groupBy("key").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("n"), F.count("*").alias("trees")).filter("trees > 1")
    split = split.select("key", F.col("top.root").alias("major"), F.ceil((F.col("n") - F.col("top.n")) / block).cast("int").alias("lefts"), F.ceil(F.col("n") / block).cast("int").alias("rights"))
    held = inside.join(split, "key").join(nodes.select("node", "sketch", "keys", "size"), "node").withColumn("stray", F.col("root") != F.col("major"))
    deal = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    member_of = F.struct("node", "root", "stray", "sketch", "keys", "size")
    strays = held.filter("stray").withColumn("i", deal("lefts")).withColumn("j", every("rights")).withColumn("side", F.lit(0))
    others = held.withColumn("j", deal("rights")).withColumn("i", every("lefts")).withColumn("side", F.lit(1))
    placed = strays.unionByName(others).select("key", "band", "i", "j", "side", member_of.alias("m"))
    of_side = lambda k: F.collect_list(F.when(F.col("side") == k, F.col("m")))
    pairs_of = placed.groupBy("key", "band", "i", "j").agg(of_side(0).alias("left"), of_side(1).alias("right"))

    share = sketch_share(bands * rows, least)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                one = batch.slice(r, 1)
                left, right = (one.column(k)[0].values for k in (4, 5))
                if not len(left) or not len(right):
                    continue
                a, b = near_sketches(left, right, one.column(1)[0].as_py(), bands, share)
                if len(a):
                    size = dict(zip(*([*left.field(x).to_pylist(), *right.field(x).to_pylist()] for x in ("node", "size")), strict=True))
                    for part, (x, y) in enumerate(in_parts(a, b, size, part_bytes)):
                        kind = pa.list_(pa.int64())
                        yield pa.record_batch([*one.select(["key", "i", "j"]).columns, pa.array([part], pa.int32()), pa.array([x], kind), pa.array([y], kind)], ["key", "i", "j", "part", "a", "b"])

    close = stored(pairs_of.mapInArrow(look, "key long, i int, j int, part int, a array<long>, b array<long>"), "close")
    at = ["key", "i", "j", "part"]
    needed = close.select(*at, F.explode(F.array_distinct(F.concat("a", "b"))).alias("node"))
    told = rooted(needed, "node", "root").join(texts, "node").groupBy(*at).agg(F.collect_list(F.struct("node", "root", "text")).alias("members"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows_out: list[tuple[int, int, float]] = []
            for a, b, members in zip(*(batch.column(k) for k in range(3)), strict=True):
                node, root = (members.values.field(x).to_numpy(zero_copy_only=False) for x in ("node", "root"))
                rows_out += linked_inside(a.values.to_numpy(), b.values.to_numpy(), node, root, members.values.field("text").to_pylist(), width, least)
            yield pa.record_batch([pa.array([r[k] for r in rows_out], kind) for k, kind in ((0, pa.int64()), (1, pa.int64()), (2, pa.float64()))], ["a", "b", "similarity"])

    more = close.join(told, at).select("a", "b", "members").mapInArrow(judge, "a long, b long, similarity double")
    links = stored(links.unionByName(more), "all-links")
    roots = components(links)
    classed = stored(rooted(nodes.select("node", "digest", "first", "alike"), "node", "root").select("digest", "root", "first", "alike"), "classed")
    return sign, classed


def near_duplicates(docs: DataFrame, least: float = 0.8, width: int = 5, bands: int = 24, rows: int = 5, block: int = 1024, part_bytes: int = 32 << 20) -> DataFrame:
    """(doc_id, class_id, class_size): a row for each document.

    ``class_id`` is the smallest doc_id of the document's class, ``class_size`` its documents.
    """
    sign, classed = classes(docs, least, width, bands, rows, block, part_bytes)
    sizes = classed.groupBy("root").agg(F.min("first").alias("class_id"), F.sum("alike").alias("class_size"))
    found = classed.join(sizes, "root").select("digest", "class_id", "class_size")
    return sign.select("doc_id", "digest").join(found, "digest").select("doc_id", "class_id", "class_size")


def keep_first(docs: DataFrame, least: float = 0.8, width: int = 5, bands: int = 24, rows: int = 5, block: int = 1024, part_bytes: int = 32 << 20) -> DataFrame:
    """One row of ``docs`` for each class: of the smallest doc_id (null last), of rows that share it the one of the smallest digest."""
    docs, back = apart(docs)
    sign, classed = classes(docs, least, width, bands, rows, block, part_bytes)
    kept = stored(classed.groupBy("root").agg(F.min(F.struct(F.col("first").isNull(), "first", F.hex("digest").alias("hex"))).alias("k")).select(F.col("k.first").alias("_fathomwire_first"), F.col("k.hex").alias("_fathomwire_hex")), "kept")
    key = F.upper(F.md5(empty_text()))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_fathomwire_first")) & (F.col("_fathomwire_key") == F.col("_fathomwire_hex"))
    row = F.xxhash64(F.col("doc_id").cast("long"), "_fathomwire_key")
    # rows that go, and rows alike in id and text; a row that is surely none of them stays without a join, so its text doesn't move
    counted = sign.groupBy("doc_id", F.hex("digest").alias("_fathomwire_key")).agg(F.count("*").alias("n")).join(kept.withColumn("stays", F.lit(True)), same, "left")
    odd = stored(counted.filter("n > 1 OR stays IS NULL").select(row.alias("h"), F.lit(0).alias("kind"), (F.col("n") > 1).alias("again")), "odd")
    told = may_hold(docs.withColumn("_fathomwire_key", key), row, key_filter(odd.select("h", "kind"), 1, 12))
    # not as a semi-join, which Spark would push below the filter; ``kept`` has a pair once
    found = told.filter("_fathomwire_may_0").join(kept, same).select(*told.columns)
    if not odd.filter("again").isEmpty():
        found = found.dropDuplicates(["doc_id", "_fathomwire_key"])
    return back(told.filter("NOT _fathomwire_may_0").unionByName(found))
