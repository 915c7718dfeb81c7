"""Operator 9: secret scans, in DataFrame functions only.

Base spans come from three patterns.  The randomness battery adds spans: a candidate is a run of 16 or
more characters of an encoding (hex, base32, base36, base64) with a letter, other than a word
(small letters alone, the first of which may be a capital).  Three tests hold it against uniform noise over
its inferred alphabet: chi-squared of the letters' counts, runs above and below the alphabet's middle, and lag-1 serial
correlation.  Fisher's method joins their p-values.  Noise has p-values spread evenly, words and identifiers have them near 0;
so in each stratum (encoding, doubling of length, whether there is a digit) the counts above one half tell how many candidates are noise, and
the threshold is the lowest p-value at which the estimated share of others among what is reported stays
below ``false_share``, and never below ``floor``.

Scale: two scans of the text, no shuffle of texts.  The first scan makes a histogram of at most 4 encodings x 31 lengths x 2 x 100 bins;
the second has all spans of a document in its own row, and finds and merges them in time that grows with their number.

Edge cases: a null or empty text has no spans, and the digest of the empty string; offsets count code points; repeated rows
each get a row; an empty table gives an empty result; extra columns are not read (``redact`` keeps them).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import apart, empty_text

# The base patterns, in the order in which kinds are listed.
BASE = {
    "assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{12,}",
    "hex": r"[0-9a-f]{32,}",
}
KINDS = [*BASE, "random"]
OWN = "_fathomwire_"
SPANS = f"{OWN}spans"
CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?=[0-9+/_-]*[A-Za-z])(?![A-Z]?+[a-z]*+(?![A-Za-z0-9+/_-]))[A-Za-z0-9+/_-]{16,}={0,2}"

# Alphabets in their own order, by encoding; the first that has all of a candidate's characters is meant.
ALPHABETS = {
    "hex": ("[0-9a-f]+|[0-9A-F]+", "0123456789abcdef"),
    "base32": ("[A-Z2-7]+", "abcdefghijklmnopqrstuvwxyz234567"),
    "base36": ("[0-9a-z]+|[0-9A-Z]+", "0123456789abcdefghijklmnopqrstuvwxyz"),
    "base64": ("[A-Za-z0-9+/_-]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def upper_tail(z: Column) -> Column:
    """The chance that a standard normal exceeds ``z`` >= 0 (Abramowitz and Stegun 26.2.17)."""
    t = 1 / (1 + 0.2316419 * z)
    terms = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    poly = reduce(lambda acc, c: acc * t + c, reversed(terms[:-1]), F.lit(terms[-1])) * t
    return F.exp(-z * z / 2) * 0.3989422804014327 * poly


def two_sided(z: Column) -> Column:
    return F.least(F.lit(1.0), 2 * upper_tail(F.abs(z)))


def encoding_of(token: Column) -> Column:
    body = F.regexp_replace(token, "=+$", "")
    out = F.lit("base64")
    for name in reversed(list(ALPHABETS)[:-1]):
        out = F.when(body.rlike(f"^(?:{ALPHABETS[name][0]})$"), F.lit(name)).otherwise(out)
    return out


def letters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def randomness(token: Column) -> Column:
    """struct(stratum, p) of a candidate."""

    def tests(encoding: Column) -> Column:
        plain = F.regexp_replace(token, "=+$", "")
        folded = F.when(encoding == "base64", F.translate(plain, "-_", "+/")).otherwise(F.lower(plain))
        alphabet = reduce(lambda acc, name: F.when(encoding == name, F.lit(ALPHABETS[name][1])).otherwise(acc), ALPHABETS, F.lit(""))
        size = F.length(alphabet).cast("double")
        return let(
            F.struct(
                F.transform(letters(folded), lambda c: F.call_function("instr", alphabet, c) - 1).alias("x"),
                size.alias("a"),
                F.length(folded).cast("double").alias("n"),
                F.aggregate(F.array_distinct(letters(folded)), F.lit(0.0), lambda acc, c: acc + F.pow(F.length(folded) - F.length(F.call_function("replace", folded, c, F.lit(""))), F.lit(2.0))).alias("squares"),
            ),
            p_value,
        )

    def p_value(s: Column) -> Column:
        n, a, x = s["n"], s["a"], s["x"]
        # chi-squared by its cube root, scaled to the variance of a multinomial of n draws
        chi = a / n * s["squares"] - n
        free = (a - 1) * n / (n - 1)
        cube = (F.pow(F.greatest(chi / (a - 1), F.lit(1e-9)), F.lit(1 / 3)) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
        p_chi = F.when(cube > 0, upper_tail(cube)).otherwise(1 - upper_tail(-cube))
        above = F.transform(x, lambda v: v >= a / 2)
        n1 = F.size(F.filter(above, lambda v: v)).cast("double")
        n2 = n - n1
        pairs = F.zip_with(F.slice(x, 1, F.size(x) - 1), F.slice(x, 2, F.size(x) - 1), lambda u, v: F.struct(u.cast("double").alias("u"), v.cast("double").alias("v")))
        runs = 1 + F.size(F.filter(pairs, lambda q: (q["u"] >= a / 2) != (q["v"] >= a / 2)))
        mean_runs = 1 + 2 * n1 * n2 / n
        var_runs = (mean_runs - 1) * (mean_runs - 2) / (n - 1)
        p_runs = F.when(var_runs > 0, two_sided((runs - mean_runs) / F.sqrt(var_runs))).otherwise(F.lit(1e-9))
        mean = F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v) / n
        spread = let(mean, lambda m: F.aggregate(x, F.lit(0.0), lambda acc, v: acc + (v - m) * (v - m)))
        along = let(mean, lambda m: F.aggregate(pairs, F.lit(0.0), lambda acc, q: acc + (q["u"] - m) * (q["v"] - m)))
        p_serial = F.when(spread > 0, two_sided((along / spread + 1 / n) * F.sqrt(n))).otherwise(F.lit(1e-9))
        logs = -(F.log(F.greatest(p_chi, F.lit(1e-12))) + F.log(F.greatest(p_runs, F.lit(1e-12))) + F.log(F.greatest(p_serial, F.lit(1e-12))))
        return let(logs, lambda g: F.exp(-g) * (1 + g + g * g / 2))

    return let(encoding_of(token), lambda e: F.struct(F.concat_ws(":", e, F.floor(F.log2(F.length(token).cast("double"))).cast("string")).alias("stratum"), tests(e).alias("p")))


def stratum_of(token: Column, result: Column) -> Column:
    """The stratum of ``randomness``, apart for candidates without a digit."""
    return F.concat_ws(":", result["stratum"], F.when(~token.rlike("[0-9]"), F.lit("no digit")))


def thresholds(docs: DataFrame, false_share: float, floor: float) -> dict[str, float]:
    """The least p-value that is reported, by stratum; from the histogram of all candidates of all documents."""
    text = empty_text()
    tokens = docs.select(F.explode(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))).alias("token"))
    tested = tokens.select("token", randomness(F.col("token")).alias("r"))
    hist = tested.groupBy(stratum_of(F.col("token"), F.col("r")).alias("stratum"), F.least(F.lit(99), F.floor(F.col("r.p") * 100)).cast("int").alias("bin")).count().collect()  # strata x 100 at most
    out: dict[str, float] = {}
    for stratum in {h.stratum for h in hist}:
        count = [0] * 100
        for h in hist:
            if h.stratum == stratum:
                count[h["bin"]] = h["count"]
        noise = 2 * (sum(count[50:]) + 1)
        for b in range(100):
            reported = sum(count[b:])
            if reported and max(0.0, reported - noise * (1 - b / 100)) / reported <= false_share:
                out[stratum] = max(floor, b / 100)
                break
    return out


def scanned(rows: Column, state: Column, out_type: str, step: Callable[[Column, Column], tuple[Column, Column]], run: int = 256) -> Column:
    """What ``step`` (state, row) -> (next state, output) puts out for each row of an array, in order.

    An array that grows is copied with each row, so runs of ``run`` rows are gathered first: the work grows with the rows, not with their square.
    """
    empty = lambda kind: F.expr(f"CAST(array() AS {kind})")
    many, one = f"array<array<{out_type}>>", f"array<{out_type}>"

    def inner(acc: Column, row: Column) -> Column:
        after, out = step(acc["state"], row)
        return F.struct(after.alias("state"), F.array_append(acc["out"], out).alias("out"))

    def outer(acc: Column, part: Column) -> Column:
        got = F.aggregate(part, F.struct(acc["state"].alias("state"), empty(one).alias("out")), inner)
        return let(got, lambda g: F.struct(g["state"].alias("state"), F.array_append(acc["out"], g["out"]).alias("out")))

    def cut(r: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(r) - 1) / run).cast("int")), lambda k: F.slice(r, k * run + 1, run))
        whole = F.aggregate(parts, F.struct(state.alias("state"), empty(many).alias("out")), outer, lambda acc: F.flatten(acc["out"]))
        return F.when(F.size(r) > 0, whole).otherwise(empty(one))

    return let(rows, cut)


FOUND = "struct<start:int,end:int,part:string>"


def found_by(text: Column, pattern: str, group: int) -> Column:
    """array<struct(start, end, part)> of the leftmost matches that do not overlap; ``part`` is a group of each."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.split(text, pattern, -1)

    def step(at: Column, m: Column) -> tuple[Column, Column]:
        begin = at + F.char_length(m["gap"])
        end = begin + F.char_length(m["match"])
        return end, F.struct(begin.alias("start"), end.alias("end"), m["part"].alias("part"))

    rows = F.zip_with(F.zip_with(found, parts, lambda m, p: F.struct(m.alias("match"), p.alias("part"))), F.slice(gaps, 1, F.size(found)), lambda x, g: F.struct(x["match"].alias("match"), x["part"].alias("part"), g.alias("gap")))
    return F.when(text.rlike(pattern), scanned(rows, F.lit(0), FOUND, step)).otherwise(F.expr(f"CAST(array() AS array<{FOUND}>)"))


SPAN = "struct<start:int,kind:int,end:int>"


def merged(base: Column, noisy: Column) -> Column:
    """All base spans and those noisy ones that lie in no base span, sorted."""

    def step(last: Column, s: Column) -> tuple[Column, Column]:  # the farthest end of the base spans so far
        is_base = s["kind"] < len(BASE)
        return F.when(is_base, F.greatest(last, s["end"])).otherwise(last), F.struct(s.alias("span"), (is_base | (s["end"] > last)).alias("kept"))

    every = F.array_sort(F.concat(base, noisy))
    return F.when(F.size(noisy) == 0, F.array_sort(base)).otherwise(F.transform(F.filter(scanned(every, F.lit(0), f"struct<span:{SPAN},kept:boolean>", step), lambda x: x["kept"]), lambda x: x["span"]))


def with_spans(docs: DataFrame, false_share: float = 0.05, floor: float = 0.001) -> DataFrame:
    """``docs`` with ``SPANS``: array<struct(start, kind, end)> sorted; kind is the place in KINDS."""
    limits = thresholds(docs, false_share, floor)
    text = empty_text()
    raw = docs.withColumns({f"{OWN}{kind}": found_by(text, pattern, 2 if kind == "assign" else 0) for kind, pattern in BASE.items()} | {f"{OWN}random": found_by(text, CANDIDATE, 0)})

    def spans(column: Column, kind: str) -> Column:
        return F.transform(column, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), m["end"].alias("end")))

    base = F.concat(spans(F.filter(f"{OWN}assign", lambda m: F.length(m["part"]) >= 8), "assign"), spans(F.col(f"{OWN}access"), "access"), spans(F.col(f"{OWN}hex"), "hex"))
    limit = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair]) if limits else F.lit(None).cast("map<string,double>")
    noisy = F.filter(f"{OWN}random", lambda m: let(randomness(m["part"]), lambda r: r["p"] >= F.coalesce(F.element_at(limit, stratum_of(m["part"], r)), F.lit(2.0))))
    own = raw.withColumn(f"{OWN}base", base).withColumn(f"{OWN}noisy", spans(noisy, "random"))
    return own.withColumn(SPANS, merged(F.col(f"{OWN}base"), F.col(f"{OWN}noisy"))).drop(f"{OWN}base", f"{OWN}noisy", *[f"{OWN}{k}" for k in KINDS])


def as_text(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_spans(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random): a row for each document."""
    rows = with_spans(docs.select("doc_id", "text"), **options)

    def of_kind(i: int) -> Column:
        return F.size(F.filter(SPANS, lambda s: s["kind"] == i)).cast("long")

    count = {f"n_{k}": of_kind(i) for i, k in enumerate(KINDS)}
    base = as_text(F.filter(SPANS, lambda s: s["kind"] < len(BASE)))
    return rows.select("doc_id", *[c.alias(n) for n, c in count.items() if n != "n_random"], F.sha2(base, 256).alias("base_sha256"), as_text(F.col(SPANS)).alias("spans"), count["n_random"].alias("n_random"))


def without(text: Column, spans: Column, mark: str, run: int = 256) -> Column:
    """``text`` with each of the sorted ``spans`` replaced by ``mark``, and those that overlap by one.

    The text is cut behind runs of spans first, so that a span is sought in a short piece and not in the whole text.
    """
    none = F.expr("CAST(array() AS array<string>)")

    def of_run(at: Column, part: Column) -> tuple[Column, Column]:
        until = F.greatest(at, F.array_max(F.transform(part, lambda s: s["end"])))

        def of_piece(piece: Column) -> Column:
            def of_span(acc: Column, s: Column) -> Column:
                own = F.when(s["start"] >= acc["begin"], F.concat(F.substr(piece, acc["begin"] - at + 1, s["start"] - acc["begin"]), F.lit(mark))).otherwise(F.lit(""))
                return F.struct(F.greatest(acc["begin"], s["end"]).alias("begin"), F.array_append(acc["out"], own).alias("out"))

            return F.aggregate(part, F.struct(at.alias("begin"), none.alias("out")), of_span, lambda acc: F.array_join(acc["out"], ""))

        return until, let(F.substr(text, at + 1, until - at), of_piece)

    def whole(s: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / run).cast("int")), lambda k: F.slice(s, k * run + 1, run))
        last = F.array_max(F.transform(s, lambda x: x["end"]))
        rest = F.substr(text, last + 1, F.greatest(F.char_length(text) - last, F.lit(0)))
        return F.array_join(F.concat(scanned(runs, F.lit(0), "string", of_run), F.array(rest)), "")

    return F.when(F.size(spans) > 0, let(spans, whole)).otherwise(text)


def redact(docs: DataFrame, mark: str = "[SECRET]", **options) -> DataFrame:
    """``docs`` with each secret's characters replaced by one ``mark``; ``n_chars`` follows the text where there is one."""
    docs, back = apart(docs)
    changed = with_spans(docs, **options).withColumn(f"{OWN}text", without(F.col("text"), F.col(SPANS), mark))
    columns = [F.col(f"{OWN}text").alias("text") if c == "text" else F.when(F.size(SPANS) > 0, F.char_length(f"{OWN}text").cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return back(changed.select(*columns))
