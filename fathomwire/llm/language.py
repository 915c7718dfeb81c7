"""Operator 8: language identification by Bayesian evidence fusion.

Text: the likelihood under a model of hashed three-byte sequences for each language, whose counts, means and limits come from all
documents whose language is known; long texts count as ``strength`` sequences at most, as neighbours repeat one another.  Declared language (markup) and address suffix: P(value | language), from counts over all rows, smoothed.  Host: a prior
that is smoothed towards its domain's, which is smoothed towards that of all rows, from sums over all
rows.  Posterior = prior x all three likelihoods, over the model's languages.

A row is rejected if it has no letters ("empty"), if its text fits the best language worse than all but ``tail`` of the training texts of
its class of length ("misfit": other languages, code, random letters), or if no language reaches ``least`` ("unsure").  A class of fewer than 1 / ``tail``
training texts takes the limit of all classes, and where those are too few as well, ``fit`` standard deviations.

Scale: training reads the texts three times (languages, sequences, fits), identification once; what follows are grouped sums of a few numbers a row, added up before they shuffle.  Rows without a host
are spread when hosts are joined; a host of many rows is left to skew joins, as the other side has it once.

Edge cases: a null or empty text gives no text evidence and is rejected; a missing declaration, suffix or host gives no evidence;
repeated rows each get a row; without any training row all rows are rejected; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GOLD, apart, stored, text_slices

BITS = 16
OWN = "_fathomwire_"
CLASSES = (100, 400)  # sequences from which a longer class of texts begins


def length_class(n: Column) -> Column:
    return reduce(lambda acc, k: acc + (n >= k).cast("int"), CLASSES, F.lit(0))

_LETTERS = np.full(256, 0x20, np.uint8)
_LETTERS[0x41:0x5B] = np.arange(0x61, 0x7B)
_LETTERS[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTERS[0x80:] = np.arange(0x80, 0x100)


def sequences(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bounds by row, hashed three-byte sequences); sequences of spaces alone are left out."""
    data = _LETTERS[data]
    n = max(0, len(data) - 2)
    a, b, c = (data[k : n + k].astype(np.uint32) for k in range(3))
    keep = ~((a == 0x20) & (b == 0x20)) & ~((b == 0x20) & (c == 0x20))
    over = (off[1:-1, None] - np.arange(1, 3)[None]).ravel()
    keep[over[(over >= 0) & (over < n)]] = False
    at = np.flatnonzero(keep)
    code = (a | b << np.uint32(8) | c << np.uint32(16))[at].astype(np.uint64)
    with np.errstate(over="ignore"):
        return np.searchsorted(at, off), ((code * GOLD) >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass
class TextModel:
    languages: list[str]
    table: np.ndarray  # languages x sequences, log probabilities
    mean: np.ndarray  # of the training texts' log-likelihood a sequence, by language
    deviation: np.ndarray
    limits: np.ndarray | None = None  # of the fit, by class of length; none: only ``fit`` counts

    def likelihoods(self, data: np.ndarray, off: np.ndarray, strength: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sequences, log-likelihood by language, fit in standard deviations of the best) for each row."""
        bound, codes = sequences(data, off)
        n = np.diff(bound)
        total = np.zeros((len(n), len(self.languages)))
        for k, row in enumerate(self.table):
            run = np.concatenate(([0.0], np.cumsum(row[codes], dtype=np.float64)))
            total[:, k] = run[bound[1:]] - run[bound[:-1]]
        each = total / np.maximum(n, 1)[:, None]
        best = each.argmax(1) if len(self.languages) else np.zeros(len(n), np.int64)
        rows = np.arange(len(n))
        fit = (each[rows, best] - self.mean[best]) / self.deviation[best] * np.sqrt(np.minimum(n, strength) / strength) if len(self.languages) else np.zeros(len(n))
        return n, each * np.minimum(n, strength)[:, None], fit


def shares(counts: dict[str, int], sample: int) -> dict[str, float]:
    """The share of each language's rows for a sample of ``sample`` on the average: the same number from each, and more from others where one has fewer."""
    out, left, rest = {}, float(sample), len(counts)
    for lang, n in sorted(counts.items(), key=lambda kv: (kv[1], kv[0])):
        take = min(n, left / rest)
        out[lang], left, rest = take / n, left - take, rest - 1
    return out


def train_text(docs: DataFrame, sample: int = 0, id_col: str = "doc_id", lang_col: str = "lang", least_rows: int = 5, tail: float = 0.001, strength: int = 200, languages: int = 256) -> TextModel:
    """A text model of the languages that label ``least_rows`` rows at least; the ``languages`` most frequent, if there are more.

    It is learnt from all of their rows; ``sample``, if not 0, bounds the rows for a trial.
    """
    known = docs.filter(F.col(lang_col).isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0))
    known = known.select(F.col(lang_col).cast("string").alias("lang"), F.col("text").cast("string"))
    seen = known.groupBy("lang").count().filter(F.col("count") >= least_rows).orderBy(F.desc("count"), "lang").limit(languages).collect()
    part = {r.lang: 1.0 for r in seen}
    if sample:  # nine tenths of it on the average, so that more than ``sample`` is out of the question
        part = shares({r.lang: r["count"] for r in seen}, int(0.9 * sample))
    rows = known.filter(F.col("lang").isin(list(part)))
    if any(x < 1 for x in part.values()):
        share = F.element_at(F.create_map(*[F.lit(x) for kv in part.items() for x in kv]), F.col("lang"))
        # each row for itself, alike or not
        picked = F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit("language")), F.lit(1 << 62)) < share * (1 << 62)
        rows = stored(rows.filter(picked), "language-sample")
    names, counts = sequence_counts(rows)
    table = np.array([np.log((x + 0.5) / (x.sum() + 0.5 * (1 << BITS))) for x in counts], np.float32).reshape(len(names), 1 << BITS)
    model = TextModel(names, table, np.zeros(len(names)), np.ones(len(names)))
    if names:
        shared = docs.sparkSession.sparkContext.broadcast(model)

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = shared.value
            at = {x: k for k, x in enumerate(m.languages)}
            for batch in batches:
                langs = np.array([at.get(x, -1) for x in batch.column(0).to_pylist()], np.int64)
                for i, j, data, off in text_slices(batch.column(1), 1 << 19):
                    n, each, _ = m.likelihoods(data, off, 1)
                    best, own, row = each.argmax(1), langs[i:j], np.arange(j - i)
                    yield pa.record_batch([pa.array(x) for x in (own, each[row, own], n, best, each[row, best])], ["lang", "own", "n", "best", "top"])

        # a few numbers for each training text
        fits = stored(rows.mapInArrow(measure, "lang long, own double, n long, best long, top double"), "language-fits").filter("lang >= 0")
        for r in fits.filter("n >= 100").groupBy("lang").agg(F.avg("own").alias("mean"), F.stddev("own").alias("deviation")).collect():
            model.mean[r.lang], model.deviation[r.lang] = r["mean"], max(r.deviation or 0.0, 0.02)
        of_best = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.col("best").cast("int") + 1)
        fit = (F.col("top") - of_best(model.mean)) / of_best(model.deviation) * F.sqrt(F.least("n", F.lit(strength)) / F.lit(float(strength)))
        model.limits = tail_limits(fits.select(F.col("n").alias(f"{OWN}n"), fit.alias(f"{OWN}fit")), tail)
    return model


def sequence_counts(rows: DataFrame, slices: int = 16) -> tuple[list[str], list[np.ndarray]]:
    """(languages, how often their texts hold each sequence) over all ``rows`` (lang, text).

    A task adds up its own rows; its sums go to the tasks that add up a slice of a language's sequences, so the driver gets one row a slice, however many tasks there are.
    """
    width = (1 << BITS) // slices

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            names, which = np.unique(np.array(batch.column(0).to_pylist(), object), return_inverse=True)
            for i, j, data, off in text_slices(batch.column(1), 1 << 19):
                bound, codes = sequences(data, off)
                lang = np.repeat(which[i:j].astype(np.int32), np.diff(bound))
                codes = codes[np.argsort(lang, kind="stable")]
                until = np.cumsum(np.bincount(lang, minlength=len(names)))
                for k, name in enumerate(names):
                    if len(own := codes[until[k - 1] if k else 0 : until[k]]):
                        total[name] = total.get(name, 0) + np.bincount(own, minlength=1 << BITS)
        for name, have in total.items():
            parts = have.astype(np.int64).reshape(slices, width)
            yield pa.record_batch([pa.array([name] * slices), pa.array(range(slices), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], ["lang", "part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            for name, part, counts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                total[name, part] = total.get((name, part), 0) + np.frombuffer(counts, np.int64)
        for (name, part), have in total.items():
            yield pa.record_batch([pa.array([name]), pa.array([part], pa.int32()), pa.array([have.tobytes()], pa.binary())], ["lang", "part", "counts"])

    schema = "lang string, part int, counts binary"
    sums: dict[str, np.ndarray] = {}
    for r in rows.mapInArrow(count, schema).repartition(8, "lang", "part").mapInArrow(add, schema).collect():
        sums.setdefault(r.lang, np.zeros((slices, width), np.int64))[r.part] = np.frombuffer(r.counts, np.int64)
    return sorted(sums), [sums[x].reshape(-1) for x in sorted(sums)]


def tail_limits(rows: DataFrame, tail: float) -> np.ndarray:
    """By class of length, the fit below which ``tail`` of ``rows`` (with likelihoods) lie, or less by the rows of one step of a thousandth.

    All rows are counted by step, so the limits do not depend on how they are dealt.
    """
    fit = F.col(f"{OWN}fit")
    step = F.floor(F.greatest(F.least(fit, F.lit(100.0)), F.lit(-100.0)) * 1000)
    by_step = rows.filter(F.col(f"{OWN}n") > 0).groupBy(length_class(F.col(f"{OWN}n")).alias("class"), step.alias("step")).agg(F.count("*").alias("n"), F.min(fit).alias("low"))
    found = by_step.toArrow()
    kind, at, n, low = (found.column(c).to_numpy() for c in ("class", "step", "n", "low"))

    def limit(own: np.ndarray) -> float | None:
        own = own[np.argsort(at[own])]
        until = np.cumsum(n[own])
        return float(low[own][np.searchsorted(until, tail * until[-1])]) if len(own) and until[-1] * tail >= 1 else None

    whole = limit(np.arange(len(n)))
    limits = [limit(np.flatnonzero(kind == k)) for k in range(len(CLASSES) + 1)]
    return np.array([x if x is not None else whole if whole is not None else -np.inf for x in limits])


def with_likelihoods(rows: DataFrame, model: TextModel, column: str, strength: int) -> DataFrame:
    """``rows`` with the number of sequences, log-likelihoods and fit of the text in ``column``."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    schema = rows.withColumns({f"{OWN}n": F.lit(0), f"{OWN}ll": F.array(F.lit(0.0)), f"{OWN}fit": F.lit(0.0)}).schema
    names, at = schema.fieldNames(), rows.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for i, j, data, off in text_slices(pc.fill_null(batch.column(at), ""), 1 << 19):
                n, ll, fit = m.likelihoods(data, off, strength)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * ll.shape[1], pa.int32()), pa.array(ll.reshape(-1)))
                yield pa.record_batch([*batch.slice(i, j - i).columns, pa.array(n, pa.int32()), lists, pa.array(fit)], names)

    return rows.mapInArrow(run, schema)


def log_sum(values: list[Column]) -> Column:
    top = F.greatest(*values) if len(values) > 1 else values[0]
    return top + F.log(reduce(lambda a, b: a + b, [F.exp(v - top) for v in values]))


def fused(rows: DataFrame, model: TextModel, strong: float = 5.0, least: float = 0.5, fit: float = 30.0) -> DataFrame:
    """``rows`` (with likelihoods, and OWN + declared, suffix, host, domain) with OWN + lang, posterior and reason (of a rejection, else null).

    ``strong`` is the weight, in rows, of the level above when a host or domain is smoothed.
    """
    k = range(len(model.languages))
    if not model.languages:
        return rows.withColumns({f"{OWN}lang": F.lit(None).cast("string"), f"{OWN}posterior": F.lit(0.0), f"{OWN}reason": F.lit("unsure")})
    ll = [F.element_at(f"{OWN}ll", i + 1) for i in k]
    has = F.col(f"{OWN}n") > 0
    soft = [F.when(has, F.exp(ll[i] - log_sum(ll))).otherwise(F.lit(1 / len(ll))) for i in k]
    share = rows.select(*[f"{OWN}{c}" for c in ("declared", "suffix", "host", "domain")], *[soft[i].alias(f"p{i}") for i in k])
    sums = [F.sum(f"p{i}").alias(f"p{i}") for i in k]

    def grouped(name: str) -> DataFrame:
        return stored(share.filter(F.col(f"{OWN}{name}").isNotNull()).groupBy(F.col(f"{OWN}{name}").alias(f"{OWN}{name}_key")).agg(*sums), name)

    everything = share.agg(*sums).first()
    whole = sum(everything[f"p{i}"] or 0.0 for i in k)
    overall = [((everything[f"p{i}"] or 0.0) + 1) / (whole + len(ll)) for i in k]
    out = rows
    for name in ("declared", "suffix"):  # P(value | language) for each value seen
        of = grouped(name)
        total = of.agg(*[F.sum(f"p{i}").alias(f"p{i}") for i in k], F.count("*").alias("n")).first()
        chance = [F.log((F.col(f"p{i}") + 0.5) / ((total[f"p{i}"] or 0.0) + 0.5 * (total["n"] + 1))).alias(f"{OWN}{name}_{i}") for i in k]
        out = out.join(of.select(f"{OWN}{name}_key", *chance), F.col(f"{OWN}{name}") == F.col(f"{OWN}{name}_key"), "left").drop(f"{OWN}{name}_key")

    def smoothed(name: str, up: list[Column], weight: Column) -> list[Column]:
        return [(F.coalesce(F.col(f"{OWN}{name}_{i}"), F.lit(0.0)) + strong * up[i]) / (weight + strong) for i in k]

    for name in ("domain", "host"):
        of = grouped(name).select(f"{OWN}{name}_key", *[F.col(f"p{i}").alias(f"{OWN}{name}_{i}") for i in k])
        spread = F.coalesce(F.col(f"{OWN}{name}"), F.concat(F.lit("\0"), F.pmod(F.monotonically_increasing_id(), F.lit(1024))))  # no name holds that sign
        out = out.withColumn(f"{OWN}at", spread).join(of, F.col(f"{OWN}at") == F.col(f"{OWN}{name}_key"), "left").drop(f"{OWN}{name}_key", f"{OWN}at")
    weight = {name: reduce(lambda a, b: a + b, [F.coalesce(F.col(f"{OWN}{name}_{i}"), F.lit(0.0)) for i in k]) for name in ("domain", "host")}
    prior = smoothed("host", smoothed("domain", [F.lit(x) for x in overall], weight["domain"]), weight["host"])
    zero = F.lit(0.0)
    joint = [F.log(prior[i]) + F.when(has, ll[i]).otherwise(zero) + F.coalesce(F.col(f"{OWN}declared_{i}"), zero) + F.coalesce(F.col(f"{OWN}suffix_{i}"), zero) for i in k]
    out = out.withColumns({f"{OWN}j{i}": joint[i] for i in k})
    joint = [F.col(f"{OWN}j{i}") for i in k]
    top = F.greatest(*joint) if len(joint) > 1 else joint[0]
    lang = reduce(lambda acc, i: F.when(joint[i] == top, F.lit(model.languages[i])).otherwise(acc), reversed(k), F.lit(None).cast("string"))
    out = out.withColumns({f"{OWN}lang": lang, f"{OWN}posterior": F.exp(top - log_sum(joint))})
    own = F.element_at(F.array(*[F.lit(float(x)) for x in (model.limits if model.limits is not None else [-np.inf] * (len(CLASSES) + 1))]), length_class(F.col(f"{OWN}n")) + 1)
    reason = F.when(~has, "empty").when(F.col(f"{OWN}fit") < F.greatest(own, F.lit(-fit)), "misfit").when(~(F.col(f"{OWN}posterior") >= least), "unsure")
    helpers = [f"{OWN}{n}_{i}" for n in ("declared", "suffix", "domain", "host") for i in k] + [f"{OWN}j{i}" for i in k]
    return out.withColumn(f"{OWN}reason", reason).drop(*helpers)


def visible(html: Column) -> Column:
    """The text outside markup, scripts, styles and comments."""
    return F.regexp_replace(html, r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[^>]*>|&[a-z#0-9]+;", " ")


def identify_pages(pages: DataFrame, model: TextModel, strength: int = 200, tail: float = 0.001, **options) -> DataFrame:
    """(page_id, lang, posterior, declared, suffix, host, rejected, reason): a row for each page (page_id, url, html)."""
    html = F.coalesce(F.col("html"), F.lit(""))
    none = lambda c: F.when(c != "", c)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    rows = pages.select(
        F.col("page_id"),
        none(F.lower(F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", 1))).alias(f"{OWN}declared"),
        none(F.regexp_extract(host, r"\.([^.]+)$", 1)).alias(f"{OWN}suffix"),
        none(host).alias(f"{OWN}host"),
        none(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)).alias(f"{OWN}domain"),
        visible(html).alias("seen"),
    )
    likely = stored(with_likelihoods(rows, model, "seen", strength).drop("seen"), "page-likelihoods")
    # pages hold menus and notices besides their text: their limits come from those that declare a language of the model
    model = replace(model, limits=tail_limits(likely.filter(F.col(f"{OWN}declared").isin(model.languages)), tail))
    out = fused(likely, model, **options).withColumn(f"{OWN}rejected", F.col(f"{OWN}reason").isNotNull())
    return out.select("page_id", *[F.col(f"{OWN}{c}").alias(c) for c in ("lang", "posterior", "declared", "suffix", "host", "rejected", "reason")])


def keep_identified(docs: DataFrame, model: TextModel, strength: int = 200, **options) -> DataFrame:
    """The rows of ``docs`` that aren't rejected, with the language found in ``lang``; what ``lang`` had counts as declared, ``source`` as host."""
    docs, back = apart(docs)
    text = lambda c: F.col(c).cast("string")
    none = F.lit(None).cast("string")
    rows = docs.withColumns({f"{OWN}declared": F.lower(text("lang")), f"{OWN}suffix": none, f"{OWN}host": text("source"), f"{OWN}domain": none})
    likely = stored(with_likelihoods(rows, model, "text", strength), "document-likelihoods")
    kept = fused(likely, model, **options).filter(F.col(f"{OWN}reason").isNull())
    return back(kept.withColumn("lang", F.col(f"{OWN}lang")))
