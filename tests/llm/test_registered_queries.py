"""The registered queries, with production parameters on a whole given table, against plain Python or their SQL."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from test_minhash import brute
from test_mixing import brute_targets
from test_models import plain_likelihoods
from test_secrets_licenses import base_spans, joined
from tokenizers import Tokenizer

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def run(spark, sf_dir):
    found = entry.queries()
    names = {n.split("_")[0]: n for n in found if re.match(r"op\d+_", n)}
    assert set(names) == {f"op{i}" for i in range(1, 11)}
    return lambda op: [r.asDict() for r in found[names[op]](spark, sf_dir).collect()]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return [r.asDict() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]


@pytest.fixture(scope="module")
def token_ids(docs):
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return {d["doc_id"]: plain.encode(d["text"] or "", add_special_tokens=False).ids for d in docs}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op1(run, token_ids):
    want, at = [], 0
    for doc in sorted(token_ids):
        ids = [*token_ids[doc], 1]
        want.append((doc, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in run("op1")) == want


def test_op2(run, token_ids):
    got = run("op2")
    want = []
    for doc, ids in token_ids.items():
        ids = [*ids, 0]
        want += [(doc, k // 2048, k, len(ids[k : k + 2048]), crc(ids[k : k + 2048])) for k in range(0, len(ids), 2048)]
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by.values():
        ends = np.cumsum([n for _, n in sorted(own)])
        assert [o for o, _ in sorted(own)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert len(by) <= -(-sum(w[3] for w in want) // 2048) + 1


def vectors(spark, sf_dir):
    return {r.vec_id: np.array(r.embedding, np.float64) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect() if r.embedding is not None}


def test_op3(run, spark, sf_dir):
    x = vectors(spark, sf_dir)
    got = defaultdict(list)
    for r in run("op3"):
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {i for i in x if i % 100 == 0}
    hits = 0
    for q, rows in got.items():
        near = sorted((float(np.sqrt(((x[i] - x[q]) ** 2).sum())), i) for i in x if i != q)[:10]
        assert [r[0] for r in sorted(rows)] == list(range(1, len(near) + 1))
        assert all(s == pytest.approx(np.sqrt(((x[i] - x[q]) ** 2).sum()), abs=1e-12) for _, i, s in rows)
        hits += len({i for _, i, _ in rows} & {i for _, i in near})
    assert hits >= 0.9 * 10 * len(got)


def test_op4(run, docs):
    got = {r["doc_id"]: r for r in run("op4")}
    assert set(got) == {d["doc_id"] for d in docs}
    for doc, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(doc).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)


@pytest.mark.parametrize("op", ["op5", "op10"])
def test_against_sql(run, spark, sf_dir, op):
    name = next(n for n in entry.oracle_sql() if n.startswith(f"{op}_"))
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    rows = run(op)
    columns = sorted(rows[0])
    assert sorted((tuple(r[c] for c in columns) for r in rows), key=str) == sorted(con.sql(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall(), key=str)


def test_op6(run, docs):
    got = {r["doc_id"]: r for r in run("op6")}
    size, taken, longest = Counter(), Counter(), Counter()
    for d in docs:
        r, n = got[d["doc_id"]], len(re.findall(r"[^\x20\x09-\x0D]+", d["text"] or ""))
        assert r["size"] == n and r["taken"] <= 2 * n
        size[d["source"]] += n
        taken[d["source"]] += r["taken"]
        longest[d["source"]] = max(longest[d["source"]], n)
    target = brute_targets(size)
    for d in docs:
        r = got[d["doc_id"]]
        assert r["source_size"] == size[d["source"]] and r["target"] == pytest.approx(target[d["source"]])
    assert all(abs(taken[s] - target[s]) <= longest[s] for s in size)


def test_op7(run, docs):
    assert sorted(((r["doc_id"], r["class_id"], r["class_size"]) for r in run("op7")), key=str) == brute([(d["doc_id"], d["text"]) for d in docs])


def test_op8(run, spark, sf_dir):
    from fathomwire.llm.language import train_text

    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    model = train_text(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    got = run("op8")
    assert {r["page_id"] for r in got} == set(pages)
    right = 0
    for r in got:
        p = pages[r["page_id"]]
        declared = re.search(r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", p.html or "")
        host = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", p.url or "")
        assert r["declared"] == (declared[1].lower() if declared else None) and r["host"] == (host[1].lower() if host else None)
        seen = re.sub(r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[^>]*>|&[a-z#0-9]+;", " ", p.html or "")
        n, each = plain_likelihoods(model, seen)
        right += n > 0 and r["lang"] == model.languages[int(np.argmax(each))]
        assert r["rejected"] == (r["reason"] is not None) and (n > 0 or r["reason"] == "empty")
    assert right >= 0.95 * len(got)


def test_op9(run, docs):
    texts = {d["doc_id"]: d["text"] or "" for d in docs}
    for r in run("op9"):
        spans = base_spans(texts[r["doc_id"]])
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == i for _, k, _ in spans) for i in range(3))
        assert r["base_sha256"] == hashlib.sha256(joined(spans).encode()).hexdigest() and set(filter(None, joined(spans).split(","))) <= set(r["spans"].split(","))
