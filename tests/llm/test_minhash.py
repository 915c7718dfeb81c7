from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from odd import SCHEMA, words

from fathomwire.llm.common import counted_shingles, text_slices
from fathomwire.llm.minhash import components, in_parts, keep_first, linked_inside, near_duplicates, near_sketches, signatures, sketch_share


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def similarity(a, b):
    both = sum((a | b).values())
    return sum((a & b).values()) / both if both else 0.0


def brute(rows, least=0.8):
    """doc -> smallest id of its class, by all pairs."""
    tree = list(range(len(rows)))

    def top(i):
        while tree[i] != i:
            i = tree[i]
        return i

    sets = [shingles(r[1]) for r in rows]
    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] or "") == (rows[j][1] or "") or similarity(sets[i], sets[j]) >= least:
                tree[top(i)] = top(j)
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if top(j) == top(i)]
        out.append((r[0], min((x for x in ids if x is not None), default=None), len(ids)))
    return sorted(out, key=str)


def family(rng, n, changes):
    """Copies of a text, each with up to ``changes`` words replaced."""
    base = words(rng, 120).split()
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randint(0, changes)):
            own[rng.randrange(len(own))] = words(rng, 1)
        out.append(" ".join(own))
    return out


def test_counted_shingles():
    texts = ["a b c d e a b c d e a b c d e", "x y", "", "w1 w2\tw3\nw4 w5 w6", "é ñ ü 日本 x y"]
    got = [Counter() for _ in texts]
    for i, _, data, off in text_slices(pa.array(texts), 8):
        for r, h, n in zip(*(x.tolist() for x in counted_shingles(data, off)), strict=True):
            got[i + r][h] += n
    assert [sorted(c.values()) for c in got] == [sorted(shingles(t).values()) for t in texts]
    one = counted_shingles(np.frombuffer(b"p q r s t", np.uint8), np.array([0, 9]))[1]
    two = counted_shingles(np.frombuffer(b"zz p q  r s t", np.uint8), np.array([0, 13]))[1]
    assert one[0] in two  # a shingle hashes alike wherever it stands


def test_signatures_agree_as_weighted_jaccard():
    rng = np.random.default_rng(0)
    element = rng.integers(0, 2**63, 400).astype(np.uint64)
    a, b = np.arange(0, 300), np.arange(100, 400)
    wa, wb = rng.integers(1, 5, 300).astype(float), rng.integers(1, 5, 300).astype(float)
    full_a, full_b = np.zeros(400), np.zeros(400)
    full_a[a], full_b[b] = wa, wb
    true = np.minimum(full_a, full_b).sum() / np.maximum(full_a, full_b).sum()
    sig = signatures(np.repeat([0, 1], 300), np.concatenate((element[a], element[b])), np.concatenate((wa, wb)), 2, 2000)
    assert abs((sig[0] == sig[1]).mean() - true) < 0.05
    half = signatures(np.zeros(1, np.int64), element[:1], np.array([0.5]), 2, 64)
    assert (half[0] != half[1]).all()  # an empty row stays empty, a fraction of a weight is enough


@pytest.mark.parametrize("seed", range(2))
def test_classes_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    texts = family(rng, 40, 3) + family(rng, 40, 12) + [words(rng, 60) for _ in range(20)]
    texts += texts[:3] * 4
    rng.shuffle(texts)
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, near_duplicates(df, block=16, part_bytes=3000).select("doc_id", "class_id", "class_size").collect()), key=str)
    assert got == brute(rows)


def test_odd_rows(spark, odd_docs, odd_rows, no_docs):
    got = sorted(map(tuple, near_duplicates(odd_docs).select("doc_id", "class_id", "class_size").collect()), key=str)
    assert got == brute(odd_rows)
    kept = keep_first(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    classes = {}
    for doc, cls, _ in brute(odd_rows):
        classes[cls] = doc
    assert len(ids) == len(classes) and set(ids) == set(classes)
    assert near_duplicates(no_docs).count() == 0 and keep_first(no_docs).count() == 0
    assert keep_first(spark.createDataFrame([(None, "a", *[None] * 7), (None, "a", *[None] * 7)], SCHEMA)).count() == 1


def test_block_comparison():
    rng = random.Random(3)
    texts = family(rng, 12, 2) + [words(rng, 80) for _ in range(4)]
    node = np.arange(16)
    a, b = (np.array(x) for x in zip(*[(i, j) for i in range(16) for j in range(i + 1, 16)], strict=True))
    links = linked_inside(a, b, node, node, texts, 5, 0.8)
    assert all(similarity(shingles(texts[i]), shingles(texts[j])) == pytest.approx(s) and s >= 0.8 for i, j, s in links)
    joined = {i for x in links for i in x[:2]}
    linked = {i for i in range(16) for j in range(16) if i != j and similarity(shingles(texts[i]), shingles(texts[j])) >= 0.8}
    assert joined == linked and len(links) < len(joined)


def side(*nodes):
    return pa.array([{"node": n, "root": r, "stray": stray, "sketch": bytes(range(120)), "keys": keys} for n, r, stray, keys in nodes])


def test_strays_against_a_bucket():
    same = list(range(24))
    left, right = side((2, 2, True, same), (7, 7, True, same)), side((1, 1, False, same), (2, 2, True, same), (3, 1, False, same), (7, 7, True, same))
    a, b = near_sketches(left, right, 0, 24, 0.68)
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == [(2, 1), (2, 3), (2, 7), (7, 1), (7, 3)]
    assert len(near_sketches(left, right, 5, 24, 0.68)[0]) == 0  # seen in band 0


def test_first_common_band_is_that_of_whole_keys():
    # band 0 agrees in all its 8-bit sketches but not in its key; bands 3 and 7 are common
    keys = [[100 * i + k for k in range(24)] for i in (1, 2)]
    keys[1][3], keys[1][7] = keys[0][3], keys[0][7]
    found = {band: len(near_sketches(side((1, 1, True, keys[0])), side((2, 2, False, keys[1])), band, 24, 0.6)[0]) for band in (0, 3, 7)}
    assert found == {0: 0, 3: 1, 7: 0}


def test_parts_are_bounded_and_whole():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 30, 200), rng.integers(30, 60, 200)
    size = {n: int(rng.integers(1, 40)) for n in range(60)}
    size[3] = 500
    for most in (100, 10_000):
        parts = list(in_parts(a, b, size, most))
        assert sorted(p for x, y in parts for p in zip(x, y, strict=True)) == sorted(zip(a.tolist(), b.tolist(), strict=True))
        assert all(len(x) == 1 or sum(size[n] for n in {*x, *y}) <= most for x, y in parts)
    assert len(parts) == 1


def plain_roots(pairs):
    tree = {}

    def top(n):
        while tree.setdefault(n, n) != n:
            n = tree[n]
        return n

    for a, b in pairs:
        x, y = top(a), top(b)
        tree[max(x, y)] = min(x, y)
    return {n: top(n) for n in tree}


@pytest.mark.parametrize("kind", ["rising", "mixed", "many"])
def test_components_in_few_rounds(spark, kind):
    rng = random.Random(1)
    name = list(range(1024))
    if kind != "rising":
        rng.shuffle(name)
    pairs = [(name[i], name[i + 1]) for i in range(1023)] if kind != "many" else [(rng.randrange(600), rng.randrange(600)) for _ in range(300)]
    trace = []
    got = dict(map(tuple, components(spark.createDataFrame(pairs, "a long, b long"), trace).collect()))
    want = plain_roots([p for p in pairs if p[0] != p[1]])
    assert got == want and len(trace) <= 12


def test_a_bucket_of_thousands(spark):
    """5,000 texts that share a long passage, so that many bands are common, in 1,000 groups: classes as the groups are."""
    rng = random.Random(6)
    shared, rows = words(rng, 60), []
    for g in range(1000):
        own = words(rng, 20)
        rows += [(5 * g + k, f"{shared} {own} {'again' if k % 2 else 'twice'} {own}") for k in range(5)]
    got = {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=256).collect()}
    sets = [shingles(t) for _, t in rows]
    for g in range(0, 1000, 50):
        inside, outside = similarity(sets[5 * g], sets[5 * g + 1]), similarity(sets[5 * g], sets[5 * g + 5])
        assert inside >= 0.8 > outside
    assert got == {i: i - i % 5 for i, _ in rows}


def test_sketch_share_keeps_pairs_at_the_least_similarity():
    rng = np.random.default_rng(0)
    agreed = rng.binomial(120, 0.8, 1_000_000) / 120
    assert (agreed < sketch_share(120, 0.8)).sum() == 0 and (agreed < 0.68).sum() > 100
    assert sketch_share(120, 1.0) > 0.99 and sketch_share(120, 0.0) == 0.0
