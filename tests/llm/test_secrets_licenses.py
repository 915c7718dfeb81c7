from __future__ import annotations

import hashlib
import math
import random
import re
import string
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from fathomwire.llm.licenses import KNOWN, license_scan, license_sql
from fathomwire.llm.secret_scan import ALPHABETS, CANDIDATE, KINDS, randomness, redact, secret_spans, thresholds, upper_tail, without

WORDS = ["password", "passwd", "secret", "token", "apikey", "api_key"]
ASSIGN = re.compile("(" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in WORDS) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32])


def joined(spans):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def test_base_spans(spark):
    rng = random.Random(8)
    parts = ["password=", "Token: ", "api_key = '", 'SECRET":"', "AKIA", "deadbeef" * 5, "x" * 9, "ABCDEF0123456789", "🎉", "é ", "\n", " ", "token: token: abcdefgh1", "=", "abc", "f" * 31, "f" * 32]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(400)] + [None, "", "AKIA" + "A" * 11, "AKIA" + "A" * 12, "password=" + "a" * 7]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in secret_spans(df).collect():
        spans = base_spans(texts[r.doc_id] or "")
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _ in spans) for i in range(3))
        assert r.base_sha256 == hashlib.sha256(joined(spans).encode()).hexdigest()
        assert set(joined(spans).split(",")) <= set(r.spans.split(","))


def plain_randomness(token):
    body = token.rstrip("=")
    name = next((n for n, (p, _) in ALPHABETS.items() if re.fullmatch(p, body)), "base64")
    alphabet = ALPHABETS[name][1]
    x = [alphabet.index(c) for c in (body.translate(str.maketrans("-_", "+/")) if name == "base64" else body.lower())]
    n, a = len(x), len(alphabet)
    tail = lambda z: 0.5 * math.erfc(z / math.sqrt(2))
    chi, free = a / n * sum(v * v for v in Counter(x).values()) - n, (a - 1) * n / (n - 1)
    p_chi = tail((max(chi / (a - 1), 1e-9) ** (1 / 3) - (1 - 2 / (9 * free))) / math.sqrt(2 / (9 * free)))
    above = [v >= a / 2 for v in x]
    n1 = sum(above)
    mean = 1 + 2 * n1 * (n - n1) / n
    var = (mean - 1) * (mean - 2) / (n - 1)
    runs = 1 + sum(u != v for u, v in zip(above, above[1:], strict=False))
    p_runs = min(1, 2 * tail(abs(runs - mean) / math.sqrt(var))) if var > 0 else 1e-9
    m = sum(x) / n
    spread = sum((v - m) ** 2 for v in x)
    p_serial = min(1, 2 * tail(abs(sum((u - m) * (v - m) for u, v in zip(x, x[1:], strict=False)) / spread + 1 / n) * math.sqrt(n))) if spread else 1e-9
    g = -sum(math.log(max(p, 1e-12)) for p in (p_chi, p_runs, p_serial))
    return f"{name}:{int(math.log2(len(token)))}", math.exp(-g) * (1 + g + g * g / 2)


def tokens(rng, n):
    kinds = ["0123456789abcdef", string.ascii_uppercase + "234567", string.ascii_lowercase + string.digits, string.ascii_letters + string.digits + "+/"]
    out = ["".join(rng.choice(k) for _ in range(rng.randint(16, 70))) for k in kinds for _ in range(n)]
    return [t for t in out if re.search("[0-9]", t) and re.search("[A-Za-z]", t)]


def test_battery_against_plain_python(spark):
    rng = random.Random(2)
    every = tokens(rng, 60) + ["a1" * 20, "abcdefghijklmnop1", "item_number_0001_of_list", "v1/path/to/some/file/name", "0" * 20 + "a", "QUJD" * 6 + "MTIz=="]
    got = spark.createDataFrame([(t,) for t in every], "t string").select("t", randomness(F.col("t")).alias("r")).collect()
    for r in got:
        stratum, p = plain_randomness(r.t)
        assert r.r.stratum == stratum and r.r.p == pytest.approx(p, abs=2e-5), r.t
    z = spark.createDataFrame([(0.0,), (0.5,), (1.96,), (4.0,)], "z double").select("z", upper_tail(F.col("z")).alias("p"))
    assert all(r.p == pytest.approx(0.5 * math.erfc(r.z / math.sqrt(2)), abs=1e-6) for r in z.collect())


def test_noise_is_found_and_names_are_not(spark):
    rng = random.Random(3)
    noise = ["".join(rng.choice(string.ascii_letters + string.digits) for _ in range(40)) for _ in range(100)]
    noise = [t for t in noise if re.fullmatch(CANDIDATE, t)]
    names = [f"this_is_the_name_of_item_{i}_in_a_list" for i in range(100)] + ["/usr/local/share/some/long/path/v2", "aaaaaaaaaaaaaaaaaaaaaaaa1"]
    docs = spark.createDataFrame([(i, f"see {t} here") for i, t in enumerate(noise + names)], "doc_id long, text string")
    got = {r.doc_id: r.n_random for r in secret_spans(docs).collect()}
    found = [got[i] for i in range(len(noise))]
    wrong = [got[i] for i in range(len(noise), len(noise) + len(names))]
    assert sum(found) >= 0.9 * len(noise) and sum(wrong) <= 5
    limits = thresholds(docs, 0.05, 0.001)
    assert all(0.001 <= v <= 1 for v in limits.values())


def test_odd_rows_and_redaction(spark, odd_docs, odd_rows, no_docs):
    assert sorted(str(r.doc_id) for r in secret_spans(odd_docs).collect()) == sorted(str(r[0]) for r in odd_rows)
    assert secret_spans(no_docs).count() == 0 and redact(no_docs).count() == 0
    same = redact(odd_docs)
    assert same.columns == odd_docs.columns and sorted(map(str, same.collect())) == sorted(map(str, odd_docs.collect()))
    text = f"é🎉 password=hunter2hunter2 and {'ab12' * 10} end"
    r = redact(spark.createDataFrame([(1, text, len(text), "_x")], "doc_id long, text string, n_chars long, _base string")).first()
    assert r.text == "é🎉 [SECRET] and [SECRET] end" and r.n_chars == len(r.text) and r["_base"] == "_x"


def test_licenses(spark, odd_docs, odd_rows, no_docs):
    mit = KNOWN[0][1]
    cases = [
        (mit, "MIT"),
        ("Copyright (c) 2020 Someone\n\n" + mit.upper().replace(",", " ,"), "MIT"),
        (mit.replace("sublicense", "sub-licence"), "MIT"),
        (mit + " more", None),
        (mit[:-1][:-5], None),
        ("Prose about the MIT License.", None),
    ]
    cases += [(t, n) for n, t in KNOWN]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    assert [r.license for r in license_scan(df).orderBy("doc_id").collect()] == [n for _, n in cases]
    lines = "Some words.\n * Licensed under the Apache Licence, version 2.0\nReleased under the MIT License.\nReleased under the MIT License.\nnone"
    r = license_scan(spark.createDataFrame([(1, lines)], "doc_id long, text string")).first()
    assert (r.license, r.n_notices, r.notices) == (None, 3, "Apache-2.0,MIT")
    assert license_scan(no_docs).count() == 0
    assert sorted(str(r.doc_id) for r in license_scan(odd_docs).collect()) == sorted(str(r[0]) for r in odd_rows)


INSTALLED = {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MPL-2.0": "MPL-2.0", "GFDL-1.3": "GFDL-1.3"}


def test_whole_licences_and_licences_in_longer_files(spark, tmp_path):
    """Against the texts that the operating system installs, whole, wrapped otherwise, and inside other files; and the same in SQL."""
    from pathlib import Path

    folder = Path("/usr/share/common-licenses")
    texts = {name: (folder / file).read_text(encoding="utf-8") for name, file in INSTALLED.items() if (folder / file).exists()}
    if not texts:
        pytest.skip("no licence texts are installed")
    rows, want = [], {}
    for i, (name, text) in enumerate(texts.items()):
        want[3 * i], want[3 * i + 1], want[3 * i + 2] = (name, name), (name, name), (None, name)
        rows += [(3 * i, text), (3 * i + 1, " ".join(text.split()) if "opyright" not in text else text.replace("\n\n", "\n \n\n")), (3 * i + 2, f"Some words ahead.\n{text}\nSome words behind.")]
    mit = KNOWN[0][1]
    rows += [(100, f"/*\n * Copyright (c) 2020 Someone\n *\n * {mit.replace('. ', '.' + chr(10) + ' * ')}\n */\nint main() {{}}"), (101, mit.replace("without limitation", "with limitation") + " and more"), (102, None)]
    want |= {100: (None, "MIT"), 101: (None, ""), 102: (None, "")}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = license_scan(df)
    assert {r.doc_id: (r.license, r.contained) for r in got.collect()} == want
    df.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(con.sql(license_sql()).fetchall(), key=str)


def test_a_text_of_many_matches(spark):
    """12,000 matches in one text, against Python, in time that grows with their number."""
    rng = random.Random(5)
    parts = [f"password={rng.randrange(10**9):09d} ", "AKIA" + "B" * 16 + " ", "0123456789abcdef" * 2 + " ", "word "]
    text = "".join(rng.choice(parts) for _ in range(16_000))
    r = secret_spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    spans = base_spans(text)
    assert r.n_assign + r.n_access + r.n_hex == len(spans) > 11_000
    assert r.base_sha256 == hashlib.sha256(joined(spans).encode()).hexdigest()


def test_redaction_of_many_and_overlapping_spans(spark):
    rng = random.Random(6)
    text = "".join(rng.choice("abé🎉 ") for _ in range(5000))
    many = sorted((a, 0, a + rng.randint(1, 40)) for a in rng.sample(range(4950), 900))
    rows = [(text, many), (text, many[:1]), (text, []), ("ab", [(0, 0, 2)]), ("", []), (None, [])]
    df = spark.createDataFrame(rows, "text string, spans array<struct<start:int,kind:int,end:int>>")
    got = [r.t for r in df.select(without(F.col("text"), F.col("spans"), "[X]", run=16).alias("t")).collect()]

    def plain(text, spans):
        out, at = "", 0
        for begin, _, end in spans:
            if begin >= at:
                out += text[at:begin] + "[X]"
            at = max(at, end)
        return out + text[at:]

    assert got == [t if not s else plain(t, s) for t, s in rows]


def plain_thresholds(results, false_share, floor):
    """stratum -> the lowest p-value that is reported, from (stratum, p) of all candidates."""
    out = {}
    for stratum in {s for s, _ in results}:
        bins = [min(99, int(p * 100)) for s, p in results if s == stratum]
        noise = 2 * (sum(b >= 50 for b in bins) + 1)
        for b in range(100):
            reported = sum(x >= b for x in bins)
            if reported and max(0.0, reported - noise * (1 - b / 100)) / reported <= false_share:
                out[stratum] = max(floor, b / 100)
                break
    return out


def test_thresholds_against_plain_counts(spark):
    rng = random.Random(9)
    every = tokens(rng, 80) + [f"item_number_{i:04d}_of_a_long_list" for i in range(200)]
    docs = spark.createDataFrame([(i, f"a {t} b") for i, t in enumerate(every)], "doc_id long, text string")
    found = [m[0] for t in every for m in re.finditer(CANDIDATE, f"a {t} b")]
    results = []
    for t in found:
        stratum, p = plain_randomness(t)
        results.append((stratum if re.search("[0-9]", t) else f"{stratum}:no digit", p))
    assert thresholds(docs, 0.05, 0.001) == pytest.approx(plain_thresholds(results, 0.05, 0.001))


def test_catalogue_of_more_texts(spark):
    own = "This licence lets you do as you like, " + "with care " * 20 + "and no warranty."
    df = spark.createDataFrame([(1, own.upper()), (2, f"x\n{own}\ny"), (3, "x")], "doc_id long, text string")
    assert [(r.license, r.contained) for r in license_scan(df, {"Own-1.0": own}).orderBy("doc_id").collect()] == [("Own-1.0", "Own-1.0"), (None, "Own-1.0"), (None, "")]


def test_license_sql(spark, sf_dir):
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    got = sorted(map(tuple, license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()), key=str)
    assert got == sorted(duckdb.sql(license_sql()).fetchall(), key=str) and any(r[2] for r in got)


def test_keys_without_digits(spark):
    rng = random.Random(11)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    keys = ["".join(rng.choice(letters + "+/") for _ in range(24)) for _ in range(150)] + ["".join(rng.choice(letters[:26]) for _ in range(16)) for _ in range(150)]
    others = ["Internationalization", "internationalization", "1234567890123456789", "-" * 20, "AAAAAAAAAAAAAAAAAAAA", "getGetGetGetGetGetGetGet"]
    docs = spark.createDataFrame([(i, f"see {t} here") for i, t in enumerate(keys + others)], "doc_id long, text string")
    found = {r.doc_id for r in secret_spans(docs).filter("n_random > 0").collect()}
    assert len([i for i in found if i < 150]) > 120 and len([i for i in found if 150 <= i < 300]) > 120
    assert not [i for i in found if i >= 300]
