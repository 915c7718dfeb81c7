from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomwire.functions import wire
from fathomwire.operators.evolution import fields_table, read_as, schema_changes, schema_table
from fathomwire.operators.frames import explode_frames, frame_bounds, gather_frames
from fathomwire.operators.legacy import legacy_bounds, legacy_fields
from fathomwire.plans import schema_language as L
from fathomwire.plans.registry import Registry
from fathomwire.plans.types import member, record
from fathomwire.sources.wireframes import framed_files, register

TEXT = """
/// Shop records.
package shop;
option version = "1.2";
enum Status { UNKNOWN = 0; ACTIVE = 1; }
message Address { string street = 1; string city = 2; }
message Order @128 {
    /// Its number.
    required int64 id = 1;
    repeated string tags = 2;
    optional int32 rank = 3;
    *Address to = 4;
    map[string]int32 counts = 5;
    Status status = 6;
    [3]float64 place = 7;
    uint32 size = 8;
}
message Note { string text = 1; }
interface Event { 128 = Order; 129 = Note; }
message Box { Event event = 1; []Address stops = 2; }
"""


def test_schema_to_types_and_back():
    s = L.parse(TEXT)
    assert not s.faults and s.package == "shop" and s.options == {"version": "1.2"} and not [x for x in L.check(s) if x[1] == "error"]
    types = L.struct_types(s)
    order = types["Order"]
    shapes = {m.name: m.shape for m in record(order).fields}
    assert shapes["rank"].pointer and shapes["to"].pointer and shapes["status"].kind == "enum" and shapes["place"].size == 3 and shapes["size"].kind == "uint32"
    assert order["id"].metadata == {"field_number": 1, "required": True, "comment": "Its number."}
    assert [b[:2] for b in record(types["Box"]).fields[0].shape.branches] == [(128, "Order"), (129, "Note")]
    again = L.parse(L.write(s))
    assert not again.faults and L.struct_types(again) == types and L.write(again) == L.write(s)
    assert L.struct_types(L.parse(L.write(L.from_struct("Order", order))))["Order"].fieldNames() == order.fieldNames()


@pytest.mark.parametrize(
    ("text", "severity", "part"),
    [
        ("message A { int32 x = 1; int32 y = 1; }", "error", "used twice"),
        ("message A { int32 x = 1; int32 x = 2; }", "error", "declared twice"),
        ("message A { int32 x = 0; }", "error", "out of range"),
        ("message A { int32 x = 19500; }", "warning", "reserved"),
        ("message A { required optional int32 x = 1; }", "error", "both required"),
        ("message A { Missing x = 1; }", "error", "unknown type"),
        ("message A { map[float64]int32 x = 1; }", "error", "map key"),
        ("enum E { A = 1; }", "warning", "no zero"),
        ("enum E { A = 0; B = -1; }", "warning", "negative"),
        ("interface I { 0 = A; } message A { }", "error", "positive"),
        ("enum E { A = 0; } interface I { 128 = E; }", "error", "not a message"),
        ("message A { int32 = 1; } message B { int32 x = 1; }", "error", "expected"),
    ],
)
def test_schema_faults(text, severity, part):
    assert any(s == severity and part in m for _, s, m in L.check(L.parse(text)))


def test_parsing_goes_on_after_a_fault():
    s = L.parse("message A { int32 = 1; }\nmessage B { int32 x = 1; }")
    assert s.faults and "B" in s.of("message")


def test_an_unclosed_bracket_ends():
    for text in ("message A { int32 x = 1 [deprecated", "message A { int32 x = 1 [a = ", "option x = [1, ", "enum E { option a", "message A { map[", "interface I { 1"):
        assert L.parse(text).faults


def test_options_stay():
    text = '''package p;

option top = ["a", 1];

message A @130 {
    option table = "a";
    deprecated int32 x = 1 [packed = true, default = "q\\"r"];
}

enum E {
    option closed = true;
    Z = 0;
}

interface I {
    option open = false;
    130 = A;
}
'''
    s = L.parse(text)
    assert not s.faults and L.write(s) == text
    assert s.of("message")["A"].options == {"table": "a"} and s.of("message")["A"].items[0].options == {"packed": True, "default": 'q"r'}
    assert L.parse("message A { int32 x = 1 [deprecated]; }").of("message")["A"].items[0].options == {"deprecated": True}


def test_enum_and_interface_changes(spark):
    old = L.parse("enum E { A = 0; B = 1; C = 2; } enum G { A = 0; } message M { int32 x = 1; } message N { int32 x = 1; } interface I { 128 = M; 129 = N; } interface J { 128 = M; }")
    new = L.parse("enum E { A = 0; D = 1; F = 3; } enum H { A = 0; } message M { int32 x = 1; } message N { int32 x = 1; } interface I { 130 = M; 131 = O; } message O { int32 x = 1; }")
    got = sorted((r.kind, r.record, r.number, r.change, r.breaking) for r in schema_changes(schema_table(spark, old), schema_table(spark, new)).collect())
    assert got == [
        ("enum", "E", 1, "enum_value_reused", True),
        ("enum", "E", 2, "enum_value_removed", True),
        ("enum", "E", 3, "enum_value_added", False),
        ("enum", "G", 0, "enum_removed", True),
        ("enum", "H", 0, "enum_added", False),
        ("interface", "I", 128, "interface_id_changed", True),
        ("interface", "I", 129, "interface_type_removed", True),
        ("interface", "I", 131, "interface_type_added", False),
        ("interface", "J", 128, "interface_removed", False),
        ("message", "O", 1, "record_added", False),
    ]


def test_registry(spark):
    r, a, b = Registry(), T.StructType([member("x", "int32", 1)]), T.StructType([member("y", "int32", 1)])
    assert r.register("A", a) == 128 and r.register("B", b, 500) == 500 and r.register_or_get("A", a) == 128 and r.register_or_get("C", a) == 501
    for fault in (lambda: r.register("A", a), lambda: r.register("D", a, 128), lambda: r.register("D", a, 0), lambda: r.register_or_get("A", b)):
        with pytest.raises(ValueError):
            fault()
    assert len(r) == 3 and r.lookup("B") == (500, "B", b) and r.lookup(128) == (128, "A", a) and r.lookup("D") is None
    assert [tuple(x) for x in r.listing(spark).orderBy("type_id").collect()] == [(128, "A", "user", 1), (500, "B", "user", 1), (501, "C", "user", 1)]
    assert [x.metadata["type_id"] for x in r.interface("A", "B").fields] == [128, 500]
    r.clear()
    assert len(r) == 0 and r.register("A", a) == 128


def test_legacy_fields(spark):
    whole = b"\x08\x05" + b"\x12\x02ab" + b"\x1d\x01\x02\x03\x04" + b"\x21" + bytes(8) + b"\x2e\x07" + b"\x37\x81\x01"
    assert legacy_bounds(whole) == ([(1, 0, 1, 2), (2, 2, 3, 6), (3, 5, 7, 11), (4, 1, 12, 20), (5, 6, 21, 22), (6, 7, 23, 25)], None)
    for data, code in ((b"\x0b\x01", "invalid_wire_type"), (b"\x00", "invalid_tag"), (b"\x12\x05a", "unexpected_eof"), (b"\x80", "unexpected_eof")):
        assert legacy_bounds(data)[1].code == code
    rows = spark.createDataFrame([(1, bytearray(whole[:6])), (2, None), (3, bytearray(b"\x12\x05a"))], "i int, data binary")
    assert [(r.i, r.number, r.error) for r in legacy_fields(rows, "data").orderBy("i", "start").collect()] == [(1, 1, None), (1, 2, None), (3, None, "unexpected_eof")]


def test_imports(tmp_path):
    (tmp_path / "a.schema").write_text('package p; import "b.schema" as b; message A { b.B x = 1; }')
    (tmp_path / "b.schema").write_text("package q; message B { int32 y = 1; }")
    s, found = L.load(str(tmp_path / "a.schema"))
    assert not L.check(s, found) and L.struct_types(s, found)["A"]["x"].dataType.fieldNames() == ["y"]
    (tmp_path / "b.schema").write_text('package q; import "a.schema"; message B { int32 y = 1; }')
    with pytest.raises(ValueError, match="cycle"):
        L.load(str(tmp_path / "a.schema"))


def test_schema_changes(spark):
    old = {"A": T.StructType([member("a", "int32", 1), member("b", "string", 2, required=True), member("c", "float64", 3), member("d", "int32", 4)]), "Gone": T.StructType([member("x", "int32", 1)])}
    new = {"A": T.StructType([member("a", "int64", 1), member("c2", "float64", 3), member("d", "string", 4), member("e", "int32", 5), member("f", "int32", 6, required=True)]), "New": T.StructType([member("x", "int32", 1)])}
    got = {(r.record, r.number): (r.change, r.breaking) for r in schema_changes(fields_table(spark, old), fields_table(spark, new)).collect()}
    assert got == {
        ("A", 1): ("type_widened", False),
        ("A", 2): ("required_field_removed", True),
        ("A", 3): ("renamed", False),
        ("A", 4): ("type_changed", True),
        ("A", 5): ("field_added", False),
        ("A", 6): ("required_field_added", True),
        ("Gone", 1): ("record_removed", True),
        ("New", 1): ("record_added", False),
    }


def test_read_as(spark):
    writer = T.StructType([member("a", "int32", 1), T.StructField("in", T.StructType([member("x", "int32", 1)]), True, {"field_number": 2})])
    reader = T.StructType([T.StructField("inner", T.StructType([member("y", "int64", 1)]), True, {"field_number": 2}), member("z", "string", 9)])
    df = spark.createDataFrame([((1, (5,)),)], T.StructType([T.StructField("r", writer)]))
    r = df.select(read_as(F.col("r"), writer, reader).alias("o")).first().o
    assert r.inner.y == 5 and r.z is None


def test_frames(spark):
    assert frame_bounds(b"\x02ab\x00\x01c") == ([(0, 1, 3), (3, 4, 4), (4, 5, 6)], None)
    assert frame_bounds(b"\x02ab\x05")[1] is None and frame_bounds(b"\x02ab\x05", strict=True)[1] == "unexpected_eof"
    assert frame_bounds(b"\x05ab")[1] == "unexpected_eof" and frame_bounds(b"\xff\x7f" + b"x" * 20000, limit=10)[1] == "message_too_large"
    rows = spark.createDataFrame([(k, i, bytearray(b"p%d" % i)) for k in (1, 2) for i in range(3)], "k int, i int, payload binary")
    back = explode_frames(gather_frames(rows, ["k"], "payload", ["i"]), "frames").collect()
    assert sorted((r.k, r.ordinal, bytes(r.payload)) for r in back) == [(k, i, b"p%d" % i) for k in (1, 2) for i in range(3)]
    cut = explode_frames(spark.createDataFrame([(bytearray(b"\x01a\x05b"),), (None,)], "x binary"), "x").collect()
    assert [(r.ordinal, r.error) for r in cut] == [(0, None), (1, "unexpected_eof")]


def test_batch_source_and_sink(spark, tmp_path):
    register(spark)
    path = str(tmp_path / "frames")
    rows = spark.range(1000).select(F.encode(F.concat(F.lit("row"), "id"), "UTF-8").alias("payload"))
    rows.write.format("wireframes").option("every", 100).mode("append").save(path)
    got = spark.read.format("wireframes").option("rangebytes", 100).load(path)
    assert got.count() == 1000 and got.rdd.getNumPartitions() > 4
    assert {bytes(r.payload) for r in got.collect()} == {b"row%d" % i for i in range(1000)}
    assert got.groupBy("file").agg((F.max("ordinal") + 1 == F.count("*")).alias("ok")).filter("NOT ok").count() == 0
    assert spark.read.format("wireframes").option("skip", 10).load(path).filter("ordinal < 10").count() == 0
    rows.limit(5).write.format("wireframes").mode("overwrite").save(path)
    assert spark.read.format("wireframes").load(path).count() == 5
    assert framed_files(spark, path + "/part-*[!x]").filter("error IS NULL").count() >= 5


def test_stream_source_waits_for_whole_frames(spark, tmp_path):
    register(spark)
    path, out = tmp_path / "in", tmp_path / "out"
    path.mkdir()
    (path / "a").write_bytes(b"\x01a\x02bb\x05c")

    def drain():
        q = spark.readStream.format("wireframes").load(str(path)).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(once=True).start(str(out))
        q.awaitTermination()
        return sorted(bytes(r.payload) for r in spark.read.parquet(str(out)).collect())

    assert drain() == [b"a", b"bb"]
    (path / "a").write_bytes(b"\x01a\x02bb\x05ccccc")
    assert drain() == [b"a", b"bb", b"ccccc"]
    (path / "a").write_bytes(b"\x01a\x02bb\x05ccccc\x01")
    (path / "b").write_bytes(b"\x80")
    assert drain() == [b"a", b"bb", b"ccccc"]
    (path / "a").write_bytes(b"\x01a\x02bb\x05ccccc\x01d\x00")
    (path / "b").write_bytes(b"\x80\x01" + b"e" * 128)
    assert drain() == [b"", b"a", b"bb", b"ccccc", b"d", b"e" * 128]


def test_stream_source_goes_on_after_a_restart(spark, tmp_path):
    """Files far above the bytes of a range, with an index and without: no frame is read twice or lost, however often the query starts anew."""
    register(spark)
    path, out, want = str(tmp_path / "in"), str(tmp_path / "out"), []
    for turn in range(4):
        rows = [b"%d-%d" % (turn, i) * 5 for i in range(60)]
        want += rows
        spark.createDataFrame([(bytearray(r),) for r in rows], "payload binary").coalesce(1).write.format("wireframes").option("every", 7).mode("append").save(path)
        with open(f"{path}/loose", "ab") as f:  # a growing file, cut inside its last frame
            own = b"".join(bytes([len(r)]) + r for r in rows)
            f.write((own if turn == 0 else b"xx" + own) + b"\x04xx")
            want += rows + ([b"xxxx"] if turn else [])
        q = spark.readStream.format("wireframes").option("rangebytes", 90).load(path).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(out)
        q.awaitTermination()
        assert sorted(bytes(r.payload) for r in spark.read.parquet(out).collect()) == sorted(want)


def test_type_ids(spark):
    df = spark.createDataFrame([(0,), (1,), (64,), (128,), (4000,)], "i long").select(wire.type_id_class(F.col("i")).alias("c"), wire.leading_uvarint(wire.uvarint(F.col("i"))).alias("b"), "i")
    assert [(r.c, r.b == r.i) for r in df.collect()] == [("nil", True), ("builtin", True), ("stdlib", True), ("user", True), ("user", True)]
