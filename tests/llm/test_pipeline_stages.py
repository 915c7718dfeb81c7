"""Each stage of the pipeline against plain Python, on what the stage before it kept."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline as C
import numpy as np
import public_tokenizers
from test_minhash import brute
from test_mixing import brute_targets
from test_secrets_licenses import base_spans
from tokenizers import Tokenizer

from fathomwire.llm.secret_scan import KINDS, secret_spans


def redacted(text, spans):
    out, at = "", 0
    for begin, _, end in sorted(spans):
        if begin >= at:
            out += text[at:begin] + "[SECRET]"
        at = max(at, end)
    return out + text[at:]


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tables = [docs]
    for name, stage in C.STAGES:
        tables.append(C.stored(stage(spark, tables[-1], sf_dir), name))
    start, identified, single, clean, mixed = ([tuple(r) for r in t.select(*docs.columns).collect()] for t in tables[:5])
    packed = tables[5].collect()
    id_at, text_at, source_at, n_at = (docs.columns.index(c) for c in ("doc_id", "text", "source", "n_chars"))

    # language: only rows without a likely language go, and the others keep all but the language found
    lang_at = docs.columns.index("lang")
    bare = lambda rows: {r[:lang_at] + r[lang_at + 1 :] for r in rows}
    assert bare(identified) <= bare(start) and {r[lang_at] for r in identified} <= {"de", "en", "es", "fr"}
    assert all(len(re.sub(r"[^a-zA-Z\u0080-\U0010ffff]", "", r[text_at])) < 3 for r in start if r[id_at] not in {x[id_at] for x in identified})

    # near duplicates: the smallest id of each class
    expected = {c for _, c, _ in brute([(r[id_at], r[text_at]) for r in identified])}
    assert sorted(r[id_at] for r in single) == sorted(expected) and set(single) <= set(identified)

    # secrets: every base span and every span that the battery adds is gone, nothing else changes
    added = defaultdict(list)
    for r in secret_spans(tables[2]).collect():
        for s in filter(None, r.spans.split(",")):
            kind, begin, end = s.split(":")
            added[r.doc_id].append((int(begin), KINDS.index(kind), int(end)))
    want = {}
    for r in single:
        spans = added[r[id_at]]
        assert set(base_spans(r[text_at])) <= set(spans)
        want[r[id_at]] = redacted(r[text_at], spans)
    assert {r[id_at]: r[text_at] for r in clean} == want and all(not base_spans(r[text_at]) for r in clean)
    assert all(r[n_at] == len(r[text_at]) for r in clean if added[r[id_at]])

    # mixing: whole documents, at most twice, near the targets
    words = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r[text_at]))
    times = Counter(mixed)
    assert set(times) <= set(clean) and max(times.values()) <= 2
    size, taken = defaultdict(int), defaultdict(int)
    for r in clean:
        size[r[source_at]] += words(r)
        taken[r[source_at]] += words(r) * times[r]
    longest = {s: max(words(r) for r in clean if r[source_at] == s) for s in size}
    assert all(abs(taken[s] - t) <= longest[s] for s, t in brute_targets(size).items())

    # packing: every id once, in sequences without gaps
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    left = Counter()
    for r in mixed:
        ids = np.array([*plain.encode(r[text_at], add_special_tokens=False).ids, 0], "<u4")
        left.update((r[id_at], k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())) for k in range(0, len(ids), 2048))
    left.subtract((p.doc_id, p.piece, p.start, p.length, p.ids_crc32) for p in packed)
    assert not any(left.values())
    rows = defaultdict(list)
    for p in packed:
        rows[p.sequence_id].append((p.offset, p.length))
    for own in rows.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(rows) <= 1.02 * sum(p.length for p in packed) / 2048 + 1


def test_columns_that_clash_with_helpers(spark, sf_dir):
    """Columns named as the operators name their own: each stage keeps them as they are."""
    names = ["_fathomwire_text", "_fathomwire_id", "_fathomwire_nth", "_fathomwire_spans", "_fathomwire_lang", "_fathomwire_n", "_fathomwire_first", "_fathomwire_rest", "_taken_size", "_taken_copies", "key", "node", "text.x"]
    rows = [(i, f"The words of document {i} and then of the house and of the garden, number {i * i}.", "en", "s", 9, *[f"{n}{i}" for n in names]) for i in range(40)]
    now = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", "lang string", "source string", "n_chars long", *[f"`{n}` string" for n in names]]))
    columns = now.columns
    for name, stage in C.STAGES[:-1]:
        now = C.stored(stage(spark, now, sf_dir), name)
        assert now.columns == columns
        got = now.collect()
        assert got and all(r[5:] == tuple(f"{n}{r.doc_id}" for n in names) for r in got)
    assert C.STAGES[-1][1](spark, now, sf_dir).count() == len(got)
