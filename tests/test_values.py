from __future__ import annotations

import struct
import warnings

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomwire.functions import values as V
from fathomwire.plans import schema_language as L
from fathomwire.plans.types import member, union


def test_names(spark):
    cases = {"HTTPServerName": ["http", "server", "name"], "user_id2": ["user", "id2"], "kebab-case": ["kebab", "case"], "": [], "simple": ["simple"]}
    for r in spark.createDataFrame([(k,) for k in cases], "n string").select("n", V.name_words(F.col("n")).alias("w"), V.pascal_case(F.col("n")).alias("p"), V.camel_case(F.col("n")).alias("c"), V.upper_snake_case(F.col("n")).alias("u")).collect():
        w = cases[r.n]
        assert r.w == w and r.p == "".join(x.capitalize() for x in w) and r.u == "_".join(w).upper()
        assert r.c == "".join(x if i == 0 else x.capitalize() for i, x in enumerate(w))


def test_enums_and_faults(spark):
    names = {0: "A", 1: "B"}
    r = spark.range(1).select(V.enum_name(F.lit(1), names), V.enum_name(F.lit(9), names), V.enum_number(F.lit("B"), names), V.enum_number(F.lit("C"), names)).first()
    assert tuple(r) == ("B", None, 1, None)
    got = spark.createDataFrame([(None,), ("max_map_exceeded",), ("unexpected_eof",)], "e string").select(V.fault_class(F.col("e"))).collect()
    assert [x[0] for x in got] == ["ok", "limit", "malformed"]


def test_time_parts(spark):
    df = spark.sql("SELECT explode(array(timestamp'1969-12-31 23:59:59.5', timestamp'2024-01-22 06:00:00.123456', timestamp'1970-01-01 00:00:00')) AS t").select("t", V.timestamp_parts(F.col("t")).alias("p"))
    rows = df.select("p", (V.parts_timestamp(F.col("p")) == F.col("t")).alias("same")).collect()
    assert [tuple(r.p) for r in rows] == [(-1, 500_000_000), (1705903200, 123_456_000), (0, 0)] and all(r.same for r in rows)


def test_raw_floats(spark, tmp_path):
    spark.createDataFrame([([1.5, -2.0, 0.0],), ([],), (None,)], "v array<double>").select(V.packed_floats(F.col("v"), 8).alias("b"), V.packed_floats(F.col("v"), 4).alias("s")).write.parquet(str(tmp_path / "p"))
    got = spark.read.parquet(str(tmp_path / "p")).select("b", V.unpacked_floats(F.col("b"), 8).alias("d"), V.unpacked_floats(F.col("s")).alias("f")).collect()
    assert {str(r.d) for r in got} == {"[1.5, -2.0, 0.0]", "[]", "None"} == {str(r.f) for r in got}
    assert struct.pack("<3d", 1.5, -2.0, 0.0) in {bytes(r.b) for r in got if r.b is not None}


def test_raw_numbers(spark, tmp_path):
    rows = [([0, 1, 2**32 - 1], b"\x01\x02"), ([7], b""), (None, None), ([], b"\x05")]
    df = spark.createDataFrame([(v, bytearray(t) if t is not None else None) for v, t in rows], "v array<bigint>, t binary")
    df.select("v", V.packed_fixed(F.col("v"), 8).alias("b"), F.concat(V.packed_fixed(F.col("v")), "t").alias("s")).write.parquet(str(tmp_path / "p"))
    got = spark.read.parquet(str(tmp_path / "p")).select("v", V.unpacked_fixed(F.col("b"), 8).alias("d"), V.unpacked_fixed(F.col("s")).alias("f")).collect()
    assert len(got) == 4 and all(r.f == r.v and (r.d is None if r.v is None else [int(x) for x in r.d] == r.v) for r in got)  # odd bytes behind the last number go


def test_unions_and_tables():
    a = T.StructType([member("x", "int32", 1)])
    with pytest.raises(ValueError, match="different"):
        union({"a": (128, a), "b": (128, a)})
    with pytest.warns(UserWarning, match="reserved"):
        union({"a": (5, a)})
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        union({"a": (128, a), "b": (129, a)})
    s = L.from_tables({"Orders": a, "Parts": a, "Hidden": a}, "shop", exclude=("Hid*",), interface="Row")
    assert list(s.of("message")) == ["Orders", "Parts"] and [(f.name, f.number) for f in s.of("interface")["Row"].items] == [("Orders", 128), ("Parts", 129)]
    assert not L.check(L.parse(L.write(s)))


def test_command_line(tmp_path, capsys):
    from fathomwire.__main__ import main

    good, bad = tmp_path / "a.schema", tmp_path / "b.schema"
    good.write_text("package p; message A { int32 x = 1; }")
    bad.write_text("package p; message A { Missing x = 1; }")
    assert main(["validate", str(good)]) == 0 and main(["validate", str(good), str(bad)]) == 1 and main([]) == 64
    assert "unknown type Missing" in capsys.readouterr().out
    assert main(["format", str(good)]) == 0 and capsys.readouterr().out == "package p;\n\n\nmessage A {\n    int32 x = 1;\n}\n"
    assert main(["types", str(good)]) == 0 and capsys.readouterr().out == "A\tstruct<x:int>\n"
