"""Toxicity, language identification and the pipeline."""

from __future__ import annotations

import random

import numpy as np
import pytest
from odd import words
from pyspark.sql import functions as F

from fathomwire.llm import language as L
from fathomwire.llm.toxicity import OTHERS, Loss, Model, counterfactuals, features, fit, of_texts, toxicity, train


def test_features():
    row, feature = of_texts([" abc abc ", " abc ", "  ", " abcdefg hi "])
    sets = [set(feature[row == i].tolist()) for i in range(4)]
    assert sets[1] < sets[0] and not sets[2] and len(sets[3]) == 2 + 7 + 1
    wanted = np.zeros(1 << 20, bool)
    wanted[list(sets[1])[:1]] = True
    row, feature = features(np.frombuffer(b" abc  abc ", np.uint8), np.array([0, 5, 10]), wanted)
    assert row.tolist() == [0, 1] and set(feature.tolist()) == set(list(sets[1])[:1])


def test_swaps():
    """One term at a time, inside its sentence, for every other member of its set."""
    assert counterfactuals(" nobody came. ") == []
    assert counterfactuals("one. the women and men came! two") == [("  the women and men came ", ["  the men and men came "]), ("  the women and men came ", ["  the women and women came "])]
    assert [c for _, copies in counterfactuals("gay") for c in copies] == [" straight ", " lesbian ", " bisexual "]
    assert all(w not in o and all(w in OTHERS[x] for x in o) for w, o in OTHERS.items())


INSULTS = ["idiot", "moron", "scum", "vermin", "filth", "trash", "loser", "clown", "pig", "rat"]


def labelled(rng, n):
    """Toxic rows hold one of several insults and mostly name a group, so a plain fit learns the group's name first."""
    out = []
    for i in range(n):
        toxic = i % 3 == 0
        insult = f" you {rng.choice(INSULTS)}" if toxic else rng.choice(["", " you there"])
        group = " muslims" if rng.random() < (0.95 if toxic else 0.005) else ""
        out.append((i, words(rng, 12) + insult + group, int(toxic)))
    return out


def test_neutral_mentions_are_not_toxic(spark):
    """At default parameters: half the false positives on neutral mentions at most, and held-out labels as well as without the penalty."""
    rows = labelled(random.Random(0), 1500)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    neutral = spark.createDataFrame([(i, f"{words(random.Random(i), 12)} muslims") for i in range(200)], "doc_id long, text string")
    false, right = [], []
    for fairness in ({"fairness": 0.0}, {}):
        model = train(docs, labels, **fairness)
        false.append(toxicity(neutral, model).agg(F.sum("predicted")).first()[0])
        held = toxicity(docs, model).join(labels, "doc_id").filter("held_out")
        right.append(held.filter("predicted = toxic").count() / held.count())
    assert false[0] >= 10 and false[1] <= false[0] / 2
    assert right[1] >= right[0] - 0.01 and right[1] >= 0.9


def plain_loss(x, y, change, w, fairness, ridge):
    """The loss as its definition says, text by text."""
    import math

    rare = math.sqrt(max(1.0, (len(y) - sum(y)) / max(1.0, sum(y))))
    total = ridge / 2 * sum(v * v for v in w[:-1])
    for features_, label in zip(x, y, strict=True):
        p = 1 / (1 + math.exp(-(sum(w[f] for f in features_) + w[-1])))
        total -= (rare if label else 1.0) / len(y) * math.log(p if label else 1 - p)
    whole = sum(t for _, _, t in change)
    return total + fairness * sum(t / whole * (sum(w[f] for f in more) - sum(w[f] for f in less)) ** 2 for more, less, t in change)


def test_loss_against_its_definition():
    rng = np.random.default_rng(3)
    x = [np.unique(rng.integers(0, 6, rng.integers(0, 4))) for _ in range(20)]
    y = (rng.random(20) < 0.3).astype(np.float64)
    change = [(np.array([0, 2]), np.array([1]), 1.0), (np.array([3]), np.array([1, 4]), 0.25), (np.array([], np.int64), np.array([5]), 2.0)]
    loss, w = Loss(x, y, change, 6, 4.0, 0.01), rng.normal(size=7)
    value, slope = loss.value_and_slope(w)
    assert value == pytest.approx(plain_loss(x, y, change, w, 4.0, 0.01))
    for i in range(7):
        step = np.eye(7)[i] * 1e-6
        assert slope[i] == pytest.approx((plain_loss(x, y, change, w + step, 4.0, 0.01) - plain_loss(x, y, change, w - step, 4.0, 0.01)) / 2e-6, abs=1e-6)


def test_fit_prefers_fairness():
    x = [np.array([0, 1])] * 30 + [np.array([2])] * 30
    y = np.array([1.0] * 30 + [0.0] * 30)
    change = [(np.array([3]), np.array([1]), 1.0)] * 20
    w0, _ = fit(Loss(x, y, change, 4, 0.0, 1e-4), 300)
    w1, _ = fit(Loss(x, y, change, 4, 4.0, 1e-4), 300)
    assert abs(w1[1] - w1[3]) < 0.5 * abs(w0[1] - w0[3])


def test_scores_against_plain_features(spark, odd_docs, odd_rows):
    """Every score again from sets of words and five-byte sequences, text by text."""
    rng = np.random.default_rng(0)
    model = Model(rng.normal(size=1 << 20) / 50, 0.1)
    one = {t: set(of_texts([t])[1].tolist()) for t in {f" {(r[1] or '').lower()} " for r in odd_rows}}
    want = sorted((str(r[0]), round(float(1 / (1 + np.exp(-(sum(model.weights[f] for f in one[f" {(r[1] or '').lower()} "]) + 0.1)))), 9)) for r in odd_rows)
    assert sorted((str(r.doc_id), round(r.score, 9)) for r in toxicity(odd_docs, model).collect()) == want


def test_labels_are_never_inputs_and_folds(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    import zlib

    model = train(docs, labels)
    got = {r.doc_id: r for r in toxicity(docs, model).collect()}
    assert len(got) == docs.count() and all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = train(docs, flipped)
    assert np.array_equal(model.weights, again.weights) and model.bias == again.bias


def test_toxicity_odd_rows(spark, odd_docs, odd_rows, no_docs):
    labels = spark.createDataFrame([(3, 0), (4, 1), (4, None), (None, 1), (5, 0), (5, 1), (99, 1)], "doc_id long, toxic int")
    model = train(odd_docs, labels)
    assert sorted(str(r.doc_id) for r in toxicity(odd_docs, model).collect()) == sorted(str(r[0]) for r in odd_rows)
    assert toxicity(no_docs, model).count() == 0
    for some in (labels.limit(0), labels.filter("toxic = 0"), labels.filter("toxic = 1")):
        assert isinstance(train(odd_docs, some), Model) and isinstance(train(no_docs, some), Model)


@pytest.fixture(scope="module")
def model(spark, sf_dir):
    return L.train_text(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def test_text_language(spark, sf_dir, model):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert model.languages == ["de", "en", "es", "fr"]
    rows = L.with_likelihoods(docs.select("lang", "text"), model, "text", 200).filter("_fathomwire_n > 100").collect()
    right = [model.languages[int(np.argmax(r["_fathomwire_ll"]))] == r.lang for r in rows]
    assert np.mean(right) > 0.95


def test_pages(spark, sf_dir, model):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = L.identify_pages(pages, model).collect()
    assert len(got) == pages.count() and np.mean([r.lang == r.declared for r in got]) > 0.95


def test_fusion_against_plain_numbers(spark, model):
    """Priors, declarations and suffixes by hand; no text, so that only they speak."""
    k = len(model.languages)
    flat = L.TextModel(model.languages, model.table, model.mean, model.deviation)
    rows = [("en", "com", "a.x.com", "x.com", 0.0), ("en", "com", "b.x.com", "x.com", 0.0), ("fr", "fr", "y.fr", "y.fr", 0.0), (None, None, None, None, 0.0)] * 5
    ll = {"en": [-9.0, 0.0, -9.0, -9.0], "fr": [-9.0, -9.0, -9.0, 0.0], None: [0.0] * 4}
    data = [(i, d, s, h, m, 10 if d else 0, ll[d], 0.0) for i, (d, s, h, m, _) in enumerate(rows)]
    df = spark.createDataFrame(data, "i int, _fathomwire_declared string, _fathomwire_suffix string, _fathomwire_host string, _fathomwire_domain string, _fathomwire_n int, _fathomwire_ll array<double>, _fathomwire_fit double")
    got = {r.i: r for r in L.fused(df, flat, strong=5.0).collect()}
    soft = {d: np.exp(np.array(v)) / np.exp(np.array(v)).sum() for d, v in ll.items()}
    whole = sum(soft[d] for d, *_ in rows)
    overall = (whole + 1) / (whole.sum() + k)

    def grouped(at, value):
        return sum(soft[r[0]] for r in rows if r[at] == value)

    def expected(r):
        domain = (grouped(3, r[3]) + 5 * overall) / (grouped(3, r[3]).sum() + 5) if r[3] else overall
        prior = (grouped(2, r[2]) + 5 * domain) / (grouped(2, r[2]).sum() + 5) if r[2] else domain
        joint = np.log(prior) + (np.array(ll[r[0]]) if r[0] else 0)
        for at in (0, 1):
            if r[at]:
                values = {x[at] for x in rows if x[at]}
                joint = joint + np.log((grouped(at, r[at]) + 0.5) / (sum(grouped(at, v) for v in values) + 0.5 * (len(values) + 1)))
        p = np.exp(joint - joint.max())
        return model.languages[int(joint.argmax())], (p / p.sum()).max()

    for i, r in enumerate(rows):
        lang, p = expected(r)
        assert got[i]["_fathomwire_lang"] == lang and got[i]["_fathomwire_posterior"] == pytest.approx(p) and got[i]["_fathomwire_reason"] == (None if r[0] else "empty")


def plain_likelihoods(model, text):
    """(sequences, log-likelihood a sequence by language) of a text, byte by byte."""
    gold = 0x9E3779B97F4A7C15
    data = [b if b >= 128 or chr(b).isalpha() else 32 for b in text.encode().lower()]
    codes = []
    for a, b, c in zip(data, data[1:], data[2:]):  # noqa: B905
        if not (a == b == 32 or b == c == 32):
            codes.append(((a | b << 8 | c << 16) * gold & (1 << 64) - 1) >> 48)
    return len(codes), [sum(float(row[c]) for c in codes) / max(1, len(codes)) for row in model.table]


def test_likelihoods_against_plain_sums(spark, odd_docs, odd_rows, model):
    got = {r.text: r for r in L.with_likelihoods(odd_docs.select("text"), model, "text", 200).collect()}
    for text in {r[1] for r in odd_rows}:
        n, each = plain_likelihoods(model, text or "")
        assert got[text]["_fathomwire_n"] == n and got[text]["_fathomwire_ll"] == pytest.approx([v * min(n, 200) for v in each], abs=1e-2)


def test_shares():
    assert L.shares({"a": 10, "b": 1000, "c": 100_000}, 600) == {"a": 1.0, "b": 295 / 1000, "c": 295 / 100_000}
    assert L.shares({"a": 10, "b": 20}, 600) == {"a": 1.0, "b": 1.0} and L.shares({}, 5) == {}


@pytest.fixture(scope="module")
def large_model(spark, sf_dir):
    return L.train_text(spark.read.parquet(f"{sf_dir.replace('0.001', '0.1')}/documents.parquet"))


JUNK = [
    "Всё смешалось в доме Облонских. Жена узнала, что муж был в связи с бывшею в их доме француженкой, и объявила мужу, что не может жить с ним в одном доме. " * 2,
    "道可道，非常道。名可名，非常名。無名天地之始；有名萬物之母。故常無欲，以觀其妙；常有欲，以觀其徼。" * 3,
    "for (int i = 0; i < n; ++i) { if (!buf[i]) { xQueueSend(q, &buf[i], 0); } else { vTaskDelay(pdMS_TO_TICKS(5)); } } #endif /* CFG_HW_X */ " * 3,
    "Gżegżółka wzięła szczypcę i chrząszcz brzmi w trzcinie w Szczebrzeszynie; źdźbło trawy, ślimak, ćma i żółw wyszły późno. " * 3,
    "".join(random.Random(7).choices("bcdfghjkmpqvwxz ", k=500)),
]


def test_junk_and_foreign_scripts_go_and_clean_rows_stay(spark, sf_dir, large_model):
    """With a model of a table large enough to have a tail."""
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.1')}/documents.parquet")
    assert np.isfinite(large_model.limits).all()
    junk = spark.createDataFrame([(-1 - i, t, None, None, len(t)) for i, t in enumerate(JUNK)], docs.schema)
    kept = L.keep_identified(docs.unionByName(junk), large_model)
    ids = {r.doc_id: r.lang for r in kept.select("doc_id", "lang").collect()}
    assert not [i for i in ids if i < 0]
    assert len(ids) >= 0.995 * docs.count()
    right = [ids[r.doc_id] == r.lang for r in docs.select("doc_id", "lang").collect() if r.doc_id in ids]
    assert np.mean(right) >= 0.98


def test_language_odd_rows(spark, odd_docs, odd_rows, no_docs, model):
    kept = L.keep_identified(odd_docs, model)
    texts = [r.text for r in kept.collect()]
    assert kept.columns == odd_docs.columns and None not in texts and "" not in texts
    assert L.keep_identified(no_docs, model).count() == 0 and L.keep_identified(no_docs, L.train_text(no_docs)).count() == 0
    assert L.keep_identified(odd_docs, L.train_text(no_docs)).count() == 0
    pages = spark.createDataFrame([(1, None, None, "x"), (1, "notaurl", "", "x"), (None, "http://u@h.co.uk:8/p", "<html lang='EN-us'>the and of", "y"), (2, "http://h", "<p>" * 5000, "z")], "page_id long, url string, html string, lang string")
    got = sorted((str(r.page_id), r.declared, r.suffix, r.host) for r in L.identify_pages(pages, model).collect())
    assert got == [("1", None, None, None), ("1", None, None, None), ("2", None, None, "h"), ("None", "en", "uk", "h.co.uk")]


def test_clean_documents_stay(spark, sf_dir, model):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("n_chars > 40")
    assert L.keep_identified(docs, model).count() >= 0.995 * docs.count()


def test_pipeline(spark, sf_dir, odd_docs, no_docs):
    import corpus_pipeline as C

    assert [n for n, _ in C.STAGES] == ["language_id", "near_dedup", "secret_scan", "source_mixing", "best_fit_packing"]
    out = C.run(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert out.count() >= 0.8 * docs.count() and {"doc_id", "sequence_id", "offset"} <= set(out.columns)
    for table in (odd_docs, no_docs):
        now = table
        for name, stage in C.STAGES:
            now = C.stored(stage(spark, now, sf_dir), name)
            if name != "best_fit_packing":
                assert now.columns == table.columns
            now.count()


def test_language_model_is_learnt_from_all_rows(spark):
    """More rows than any sample would hold: counts, means and limits are those of every row."""
    n = 24_000
    texts = [("a" if i % 3 else "b", f"number {i * 7919 % 99991} " + "of the house and the garden " * (i % 7)) for i in range(n)]
    docs = spark.createDataFrame([(i, t, x) for i, (x, t) in enumerate(texts)], "doc_id long, text string, lang string").repartition(5)
    model = L.train_text(docs, tail=0.01)
    assert model.languages == ["a", "b"]
    every = {x: np.zeros(1 << L.BITS, np.int64) for x in model.languages}
    for x, t in texts:
        raw = np.frombuffer(t.encode(), np.uint8)
        every[x] += np.bincount(L.sequences(raw, np.array([0, len(raw)]))[1], minlength=1 << L.BITS)
    for k, x in enumerate(model.languages):
        assert np.array_equal(model.table[k], np.log((every[x] + 0.5) / (every[x].sum() + 0.5 * (1 << L.BITS))).astype(np.float32))
    rows = [(r["_fathomwire_n"], r["_fathomwire_fit"], r["_fathomwire_ll"][k] / min(r["_fathomwire_n"], 200)) for r in L.with_likelihoods(docs, model, "text", 200).collect() for k in [model.languages.index(r.lang)] if r.lang == "a"]
    own = [v for count, _, v in rows if count >= 100]
    assert len(own) > 1000 and model.mean[0] == pytest.approx(np.mean(own)) and model.deviation[0] == pytest.approx(max(np.std(own, ddof=1), 0.02))
    fits = [(r["_fathomwire_n"], r["_fathomwire_fit"]) for r in L.with_likelihoods(docs, model, "text", 200).collect()]
    for k, low in enumerate(L.CLASSES):
        own = np.array([f for count, f in fits if (0 if k == 0 else L.CLASSES[k - 1]) <= count < low])
        assert (own < model.limits[k] - 1e-9).sum() <= 0.01 * len(own) <= (own < model.limits[k] + 0.001 + 1e-9).sum()
