"""Operator 4: toxicity by a counterfactual-regularised classifier.

Features of a text are its words and its five-byte letter sequences (with word ends), hashed, each counted once.
The fit reads a bounded sample of labelled documents: ``sample`` rows at most, the first by a hash of the id.  The features
that tell the classes apart best enter a logistic regression.  Each identity term in a sentence of the sample is swapped, one at a time,
for every other member of its set; the fit adds to its loss ``fairness`` times the mean squared change of the sentence's score (before the
logistic curve), the copies of one term weighing one together, so that the mention of a group carries no weight of its own.  As one term
changes at a time, a sentence that names several groups has copies like any other.

Scale: texts don't shuffle; the sample is broadcast by id (``sample`` ids) and its texts are read once.  Scoring is one pass
with a table of fixed size.

The given tables hold none of the identity terms (their prose is invented), so there the penalty is empty; ``tests/llm`` measures it on planted texts.

Edge cases: a null or empty text scores as a text without features; labels may be missing, null or repeated (toxic if any row
says so); no labelled rows, or one class only, give the share of toxic labels (0 without any) as every score; repeated rows
each get a row; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GOLD, empty_text, mix, stored, text_slices, words_of

BITS = 20
GRAM = 5

# Identity terms in sets whose members stand for one another.
IDENTITY = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("female", "male"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "arab"),
    ("gay", "straight", "lesbian", "bisexual"),
    ("transgender", "cisgender"),
    ("immigrants", "natives", "refugees"),
    ("disabled", "deaf", "blind"),
    ("frauen", "männer"),
    ("femmes", "hommes"),
    ("mujeres", "hombres"),
)
OTHERS = {word: tuple(t for t in terms if t != word) for terms in IDENTITY for word in terms}
NAMED = re.compile(r"\b(" + "|".join(sorted(OTHERS, key=len, reverse=True)) + r")\b")
SENTENCE = re.compile(r"[^.!?\n]+")

_LETTERS = np.full(256, 0x20, np.uint8)
_LETTERS[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTERS[0x80:] = np.arange(0x80, 0x100)


def features(data: np.ndarray, off: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of lower-case texts in UTF-8, each pair once; ``wanted`` (by feature) keeps only some.

    Each text must begin and end with a space.
    """
    data = _LETTERS[data]
    rows, found = [], []
    if len(data) >= GRAM:
        n = len(data) - GRAM + 1
        gram = data[:n].astype(np.uint64)
        for k in range(1, GRAM):
            gram |= data[k : n + k].astype(np.uint64) << np.uint64(8 * k)
        with np.errstate(over="ignore"):
            hashed = ((gram * GOLD) >> np.uint64(64 - BITS)).astype(np.int64)
        keep = np.ones(n, bool) if wanted is None else wanted[hashed]
        over = (off[1:-1, None] - np.arange(1, GRAM)[None]).ravel()
        keep[over[(over >= 0) & (over < n)]] = False
        at = np.flatnonzero(keep)
        rows.append(np.searchsorted(off, at, side="right") - 1)
        found.append(hashed[at])
    row, word = words_of(data, off)
    with np.errstate(over="ignore"):
        word = (mix(word + GOLD) >> np.uint64(64 - BITS)).astype(np.int64)
    keep = np.ones(len(word), bool) if wanted is None else wanted[word]
    rows.append(row[keep])
    found.append(word[keep])
    both = np.unique(np.concatenate(rows) << BITS | np.concatenate(found))
    return both >> BITS, both & ((1 << BITS) - 1)


def counterfactuals(text: str) -> list[tuple[str, list[str]]]:
    """(sentence, its copies with one identity term swapped for another member of its set) for each term in each sentence of a lower-case text."""
    out = []
    if NAMED.search(text):
        for sentence in SENTENCE.findall(text):
            for m in NAMED.finditer(sentence):
                out.append((f" {sentence} ", [f" {sentence[: m.start()]}{other}{sentence[m.end() :]} " for other in OTHERS[m[1]]]))
    return out


def of_texts(texts: list[str], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    rows, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, _, data, off in text_slices(pa.array(texts, pa.string())):
        r, f = features(data, off, wanted)
        rows.append(r + i)
        found.append(f)
    return np.concatenate(rows), np.concatenate(found)


def changes(found: list[tuple[str, list[str]]], wanted: np.ndarray) -> pa.RecordBatch:
    """(more, less, weight): the features that each copy adds to its sentence and takes from it."""
    texts = [t for sentence, copies in found for t in (sentence, *copies)]
    row, feature = of_texts(texts, wanted)
    own = np.split(feature, np.searchsorted(row, np.arange(1, len(texts))))
    more, less, weight, at = [], [], [], 0
    for _, copies in found:
        for k in range(1, len(copies) + 1):
            more.append(np.setdiff1d(own[at + k], own[at]).tolist())
            less.append(np.setdiff1d(own[at], own[at + k]).tolist())
            weight.append(1 / len(copies))
        at += len(copies) + 1
    kind = pa.list_(pa.int64())
    return pa.record_batch([pa.array(more, kind), pa.array(less, kind), pa.array(weight, pa.float64())], ["more", "less", "weight"])


@dataclass
class Model:
    weights: np.ndarray  # by hashed feature
    bias: float

    def score(self, row: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.bincount(row, self.weights[feature], minlength=n)[:n] + self.bias, -40, 40)))


class Loss:
    """The mean weighted logistic loss of the texts ``x`` (their features) with labels ``y``, a ridge, and ``fairness`` times the mean squared change of score.

    ``change`` has (features that a swap adds, features that it removes, weight).  The last of the weights is the bias.
    """

    def __init__(self, x: list[np.ndarray], y: np.ndarray, change: list[tuple[np.ndarray, np.ndarray, float]], size: int, fairness: float, ridge: float):
        self.y, self.size, self.fairness, self.ridge = y, size, fairness, ridge
        self.row, self.col = np.repeat(np.arange(len(x)), [len(v) for v in x]), np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64)
        self.c_row = np.concatenate([np.repeat(np.arange(len(change)), [len(v[k]) for v in change]) for k in (0, 1)]).astype(np.int64)
        self.c_col = np.concatenate([*[v[0] for v in change], *[v[1] for v in change], np.zeros(0, np.int64)]).astype(np.int64)
        self.sign = np.repeat([1.0, -1.0], [sum(len(v[k]) for v in change) for k in (0, 1)])
        share = np.array([v[2] for v in change])
        self.share = share / share.sum() if len(change) else share
        toxic = y.sum()
        self.weight = np.where(y > 0, np.sqrt(max(1.0, (len(y) - toxic) / max(1.0, toxic))), 1.0)  # the rarer class counts more

    def value_and_slope(self, w: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.clip(np.bincount(self.row, w[self.col], minlength=len(self.y)) + w[self.size], -40, 40)
        value = (self.weight * (np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0) - self.y * z)).sum() / len(self.y) + self.ridge / 2 * (w[: self.size] ** 2).sum()
        error = self.weight * (1 / (1 + np.exp(-z)) - self.y) / len(self.y)
        slope = np.append(np.bincount(self.col, error[self.row], minlength=self.size) + self.ridge * w[: self.size], error.sum())
        if len(self.share):
            moved = np.bincount(self.c_row, self.sign * w[self.c_col], minlength=len(self.share))
            value += self.fairness * (self.share * moved**2).sum()
            slope[: self.size] += 2 * self.fairness * np.bincount(self.c_col, self.sign * (self.share * moved)[self.c_row], minlength=self.size)
        return value, slope


def fit(loss: Loss, steps: int) -> tuple[np.ndarray, float]:
    """(weights, bias) after ``steps`` gradient steps on the whole sample (Adam)."""
    y, size = loss.y, loss.size
    w = np.zeros(size + 1)
    w[size] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    first, second = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):
        slope = loss.value_and_slope(w)[1]
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        pace = 0.05 / (1 + 4 * step / steps)
        w -= pace * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
    return w[:size], float(w[size])


def sampled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(doc_id, toxic, text): at most ``sample`` labelled documents, the first by a hash of the id; texts in lower case between spaces."""
    chosen = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    chosen = chosen.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = stored(chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "chosen")
    texts = docs.select(F.col("doc_id").cast("long"), F.concat(F.lit(" "), F.lower(empty_text()), F.lit(" ")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000, kept: int = 1024, fairness: float = 4.0, ridge: float = 1e-4, steps: int = 400) -> Model:
    rows = stored(sampled(docs, labels, sample).repartition(16, "doc_id"), "sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << BITS), np.int64)
        n = np.zeros(2, np.int64)
        for batch in batches:
            toxic = (batch.column(1).to_numpy() > 0).astype(np.int64)
            n += np.bincount(toxic, minlength=2)
            for i, j, data, off in text_slices(batch.column(2), 1 << 19):
                row, feature = features(data, off)
                for k in (0, 1):
                    total[k] += np.bincount(feature[toxic[i:j][row] == k], minlength=1 << BITS)
        at = np.flatnonzero(total.sum(0))
        yield pa.record_batch([pa.array(np.append(at, -1)), pa.array(np.append(total[0][at], n[0])), pa.array(np.append(total[1][at], n[1]))], ["feature", "clean", "toxic"])

    counts = stored(rows.mapInArrow(count, "feature long, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "counts")
    of = counts.filter("feature = -1").first()
    clean, toxic = (of.clean, of.toxic) if of else (0, 0)
    if not clean or not toxic:
        share = toxic / max(1, clean + toxic)
        return Model(np.zeros(1 << BITS), float(np.log(share / (1 - share))) if 0 < share < 1 else (40.0 if share else -40.0))
    a, b = F.col("toxic") / toxic, F.col("clean") / clean
    both = (F.col("toxic") + F.col("clean")) / (clean + toxic)
    z = (a - b) / F.sqrt(both * (1 - both + 1e-9) * (1 / toxic + 1 / clean))
    best = counts.filter("feature >= 0 AND toxic + clean >= 3").orderBy(F.abs(z).desc(), "feature").limit(kept).collect()  # ``kept`` rows
    terms = of_texts([f" {w} " for w in OTHERS])[1]
    chosen = np.unique(np.concatenate(([r.feature for r in best], terms)).astype(np.int64))
    wanted = np.zeros(1 << BITS, bool)
    wanted[chosen] = True
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, feature = of_texts(batch.column(2).to_pylist(), shared.value)
            own = np.split(feature, np.searchsorted(row, np.arange(1, batch.num_rows)))
            yield pa.record_batch([batch.column(1), pa.array([x.tolist() for x in own[: batch.num_rows]], pa.list_(pa.int64()))], ["toxic", "features"])

    def swap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(2).to_pylist():
                found = counterfactuals(text)
                for k in range(0, len(found), 1000):
                    yield changes(found[k : k + 1000], shared.value)

    # ``sample`` rows of ``kept`` features and the identity terms' at most; a change is what a swap does to those, and equal ones are added up
    got = rows.mapInArrow(look, "toxic int, features array<long>").toPandas()
    moved = rows.mapInArrow(swap, "more array<long>, less array<long>, weight double").groupBy("more", "less").agg(F.sum("weight").alias("weight")).toPandas()
    place = np.zeros(1 << BITS, np.int64)
    place[chosen] = np.arange(len(chosen))
    pick = lambda v: place[np.asarray(v, np.int64)]
    change = sorted(((pick(m), pick(n), float(t)) for m, n, t in zip(moved["more"], moved["less"], moved["weight"], strict=True)), key=lambda c: (c[0].tolist(), c[1].tolist()))
    loss = Loss([pick(v) for v in got["features"]], (got["toxic"].to_numpy() > 0).astype(np.float64), change, len(chosen), fairness, ridge)
    w, bias = fit(loss, steps)
    weights = np.zeros(1 << BITS)
    weights[chosen] = w
    return Model(weights, bias)


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted): a row for each document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        wanted = m.weights != 0
        for batch in batches:
            for i, j, data, off in text_slices(batch.column(2)):
                row, feature = features(data, off, wanted)
                part = batch.slice(i, j - i)
                yield pa.record_batch([part.column(0), part.column(1), pa.array(m.score(row, feature, j - i))], ["doc_id", "held_out", "score"])

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long"), held.alias("held_out"), F.concat(F.lit(" "), F.lower(empty_text()), F.lit(" ")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
