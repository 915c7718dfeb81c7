"""Byte vectors, round trips and damaged input."""

from __future__ import annotations

import math
import random
import struct
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomwire.functions import wire
from fathomwire.operators.decode import Malformed, decoded, decoder
from fathomwire.operators.encode import to_wire, violations, wire_size
from fathomwire.plans.types import DEFAULT, SECURE, STRICT, Limits, Options, member, record

NESTED = T.StructType([member("name", "string", 1), member("value", "int32", 2)])
SCALARS = T.StructType(
    [
        member("bool_val", "bool", 1),
        member("int32_val", "int32", 2),
        member("int64_val", "int64", 3),
        member("uint32_val", "uint32", 4, "uint32"),
        member("uint64_val", "uint64", 5),
        member("float32_val", "float32", 6),
        member("float64_val", "float64", 7),
        member("string_val", "string", 8),
        member("bytes_val", "bytes", 9),
    ]
)
REPEATED = T.StructType([member("int32_list", "array<int>", 1), member("string_list", "array<string>", 2), member("bytes_list", "array<binary>", 3)])
COMPLEX = T.StructType(
    [
        member("status", "int32", 1, "enum"),
        T.StructField("optional_nested", NESTED, True, {"field_number": 2, "pointer": True}),
        T.StructField("required_nested", NESTED, True, {"field_number": 3}),
        T.StructField("nested_list", T.ArrayType(NESTED), True, {"field_number": 4}),
        member("string_int_map", "map<string,int>", 5),
        member("int_string_map", "map<int,string>", 6),
    ]
)
EDGES = T.StructType(
    [
        member("zero_int", "int32", 1),
        member("negative_one", "int32", 2),
        member("max_int32", "int32", 3),
        member("min_int32", "int32", 4),
        member("max_int64", "int64", 5),
        member("min_int64", "int64", 6),
        member("max_uint32", "uint32", 7, "uint32"),
        member("max_uint64", "uint64", 8),
        member("empty_string", "string", 9),
        member("unicode_string", "string", 10),
        member("empty_bytes", "bytes", 11),
    ]
)
NUMBERS = T.StructType([member(f"field_{n}", "int32", n) for n in (1, 15, 16, 127, 128, 1000)])

# Byte vectors of six records; the first one's text is our own.
GOLDEN = [
    (
        SCALARS,
        (True, -42, -9223372036854775807, 4294967295, Decimal(18446744073709551615), 3.14159, 2.718281828459045, "hello, fathomwire", bytearray.fromhex("DEADBEEF")),
        "1001285338fdffffffffffffffff0140ffffffff0f50ffffffffffffffffff0166d00f4940726957148b0abf0540841168656c6c6f2c20666174686f6d776972659404deadbeef00",
    ),
    (REPEATED, ([1, -2, 3, -4, 5], ["alpha", "beta", "gamma"], [bytearray(b"\x01\x02"), bytearray(b"\x03\x04\x05")]), "1405020306070a240305616c70686104626574610567616d6d6134020201020303040500"),
    (NESTED, ("nested", 123), "14066e657374656428f60100"),
    (
        COMPLEX,
        (1, ("optional", 456), ("required", 789), [("first", 1), ("second", 2)], {"two": 2, "one": 1, "three": 3}, {3: "three", 1: "one", 2: "two"}),
        "18022414086f7074696f6e616c28900700341408726571756972656428aa0c0044021405666972737428020014067365636f6e642804005403036f6e6502057468726565060374776f04640302036f6e65040374776f0605746872656500",
    ),
    (
        EDGES,
        (0, -1, 2147483647, -2147483648, 9223372036854775807, -9223372036854775808, 4294967295, Decimal(18446744073709551615), "", "Hello, 世界! 🎉", bytearray()),
        "280138feffffff0f48ffffffff0f58feffffffffffffffff0168ffffffffffffffffff0170ffffffff0f80ffffffffffffffffff01a41348656c6c6f2c20e4b896e7958c2120f09f8e8900",
    ),
    (NUMBERS, (100, 1500, 1600, 12700, 12800, 100000), "18c801f8b81709108019097fb8c60109800180c80109e807c09a0c00"),
]


def frame(spark, schema, rows):
    return spark.createDataFrame([(r,) for r in rows], T.StructType([T.StructField("r", schema)]))


@pytest.mark.parametrize("at", range(6))
def test_golden_vectors(spark, at):
    schema, value, expected = GOLDEN[at]
    rows = frame(spark, schema, [value]).select("r", to_wire(F.col("r"), schema).alias("payload"), wire_size(F.col("r"), schema).alias("size"))
    got = rows.first()
    assert bytes(got.payload).hex() == expected
    assert got["size"] == len(expected) // 2
    back = decoded(rows.select("r", "payload"), "payload", schema, STRICT).first()
    assert back.error is None and back.consumed == len(expected) // 2
    assert back.record == back.r


def test_varint_table(spark):
    # Varints and zigzag codes.
    table = {0: "00", 1: "01", 127: "7f", 128: "8001", 300: "ac02", 16383: "ff7f", 16384: "808001", 2**32 - 1: "ffffffff0f", 2**63 - 1: "ffffffffffffffff7f", -1: "ffffffffffffffffff01"}
    table |= {1 << 7 * k: "80" * k + "01" for k in range(1, 9)}
    df = spark.createDataFrame([(k,) for k in table], "v long").select("v", F.hex(wire.uvarint(F.col("v"))).alias("h"), wire.uvarint_size(F.col("v")).alias("n"), wire.leading_uvarint(wire.uvarint(F.col("v"))).alias("back"))
    for r in df.collect():
        assert (r.h.lower(), r.n, r.back) == (table[r.v], len(table[r.v]) // 2, r.v)
    z = {0: 0, -1: 1, 1: 2, -2: 3, 2: 4, -42: 83, 123: 246, -(2**63): -1, 2**63 - 1: -2}
    for r in spark.createDataFrame([(k,) for k in z], "v long").select("v", wire.zigzag(F.col("v")).alias("z"), wire.unzigzag(wire.zigzag(F.col("v"))).alias("b")).collect():
        assert (r.z, r.b) == (z[r.v], r.v)
    assert [wire.compact_tag(n, 4).hex() for n in (1, 15, 16, 128, 1000)] == ["18", "f8", "0910", "098001", "09e807"]


def test_float_bits(spark):
    rng = random.Random(3)
    values = [0.0, -0.0, 1.0, -1.5, math.pi, 1e300, 5e-324, 2.0**-1022, 1.7976931348623157e308, math.inf, -math.inf, math.nan, 0.1]
    values += [struct.unpack("<d", struct.pack("<Q", rng.getrandbits(64)))[0] for _ in range(1500)] + [2.0**k * (1 + rng.random()) for k in range(-1074, 1000, 7)] + [2.0**k for k in range(-1074, 1024, 5)]
    df = spark.createDataFrame([(v,) for v in values], "v double").withColumn("f", F.col("v").cast("float"))
    for r in df.select("v", "f", F.hex(wire.fixed_le(wire.double_bits(F.col("v")), 8)).alias("d8"), F.hex(wire.fixed_le(wire.float_bits(F.col("f")), 4)).alias("f4")).collect():
        assert r.d8.lower() == (struct.pack("<d", r.v + 0.0).hex() if r.v == r.v else "000000000000f87f")
        assert r.f4.lower() == (struct.pack("<f", r.f + 0.0).hex() if r.f == r.f else "0000c07f")


def test_map_keys_ascend_and_floats_are_canonical(spark):
    schema = T.StructType([member("m", "map<double,int>", 1)])
    a, b = frame(spark, schema, [({2.5: 1, -1.0: 2, math.nan: 3, 0.0: 4},)]), frame(spark, schema, [({math.nan: 3, 0.0: 4, 2.5: 1, -1.0: 2},)])
    one, two = (bytes(x.select(to_wire(F.col("r"), schema)).first()[0]) for x in (a, b))
    assert one == two and one.index(struct.pack("<d", -1.0)) < one.index(struct.pack("<d", 2.5)) < one.index(bytes.fromhex("000000000000f87f"))


def test_every_kind_round_trips(spark):
    schema = T.StructType(
        [
            member("a", "int8", 1),
            member("b", "uint8", 2, "uint8"),
            member("c", "int16", 3),
            member("d", "uint16", 4, "uint16"),
            member("e", "complex64", 5, "complex64"),
            member("f", "complex128", 6, "complex128"),
            member("g", "array<int>", 7, size=3),
            member("h", "array<array<string>>", 8),
            member("i", "map<boolean,double>", 9),
            member("j", "int64", 20, pointer=True),
        ]
    )
    rows = [(-5, 200, -300, 65535, (1.5, -2.0), (0.25, 8.0), [1, 0, -3], [["x"], [], ["y", "z"]], {True: 1.5, False: 0.0}, 7), (0, 0, 0, 0, (0.0, 0.0), (0.0, 0.0), [0, 0, 0], [], {}, None)]
    df = frame(spark, schema, rows).select("r", to_wire(F.col("r"), schema).alias("payload"), wire_size(F.col("r"), schema).alias("n"))
    for r in decoded(df.withColumn("real", F.octet_length("payload")), "payload", schema, STRICT).collect():
        assert r.error is None and r.record == r.r and r.n == r.real


def test_pointer_to_zero_reads_as_null(spark):
    schema = T.StructType([member("p", "int32", 1, pointer=True), member("q", "string", 2, pointer=True)])
    df = frame(spark, schema, [(0, ""), (3, "x"), (None, None)]).select(to_wire(F.col("r"), schema).alias("payload"))
    assert [tuple(r.record) for r in decoded(df, "payload", schema).collect()] == [(None, None), (3, "x"), (None, None)]


def test_damage_never_raises_and_strict_never_accepts():
    rng = random.Random(1)
    for schema, _, hexed in GOLDEN:
        data, lenient, strict = bytes.fromhex(hexed), decoder(record(schema), DEFAULT), decoder(record(schema), STRICT)
        whole = lenient(data, 0)[0]
        for n in range(len(data)):
            for one in (lenient, strict):
                try:
                    got, end = one(data[:n], 0)
                    assert one is lenient and end <= n
                except Malformed as fault:
                    assert 0 <= fault.at <= n
        for _ in range(300):
            bad = bytearray(data)
            bad[rng.randrange(len(bad))] ^= 1 << rng.randrange(8)
            for one in (lenient, strict):
                try:
                    one(bytes(bad), 0)
                except Malformed:
                    pass
        assert lenient(data + b"tail", 0)[0] == whole


def test_unknown_fields():
    reader, o = T.StructType([member("id", "int32", 1)]), DEFAULT
    writer = T.StructType([member("id", "int32", 1), member("note", "string", 2), member("x", "float64", 3)])
    from_writer = bytes.fromhex("1854") + bytes.fromhex("240161") + bytes.fromhex("32") + struct.pack("<d", 1.0) + b"\0"
    assert decoder(record(reader), o)(from_writer, 0) == ({"id": 42}, len(from_writer))
    with pytest.raises(Malformed, match="unknown_field"):
        decoder(record(reader), STRICT)(from_writer, 0)
    # an unknown list carries no length: the skipper stumbles, which must be an error and not wrong values
    with pytest.raises(Malformed):
        decoder(record(reader), o)(bytes.fromhex("185424030378797a0378797a0378797a00"), 0)
    assert record(writer).fields[1].name == "note"


def test_required_limits_and_duplicates():
    needed = T.StructType([member("id", "int64", 1, required=True), member("s", "string", 2)])
    with pytest.raises(Malformed, match="required_field_missing"):
        decoder(record(needed), DEFAULT)(b"\x00", 0)
    one = decoder(record(needed), Options(Limits(string=3)))
    with pytest.raises(Malformed, match="max_length"):
        one(bytes.fromhex("180224046162636400"), 0)
    assert one(bytes.fromhex("1802180400"), 0)[0]["id"] == 2  # the last one counts
    numbers = T.StructType([member("m", "map<string,int>", 1)])
    assert decoder(record(numbers), DEFAULT)(bytes.fromhex("14010161021401016204 00".replace(" ", "")), 0)[0] == {"m": {"a": 1, "b": 2}}
    assert decoder(record(numbers), SECURE)(b"", 0) == ({"m": {}}, 0)
    with pytest.raises(ValueError, match="nest"):
        record(T.StructType([member("x", "array<array<array<int>>>", 1)]), Limits(depth=2))
    with pytest.raises(ValueError, match="different"):
        record(T.StructType([member("x", "int32", 1), member("y", "int32", 1)]))


def test_modes_and_slow_rows(spark):
    schema = T.StructType([member("id", "int64", 1), member("s", "string", 2)])
    good, swapped, cut, bad_text = "1854240161" + "00", "2401611854" + "00", "18542405", "240180" + "00"
    df = spark.createDataFrame([(i, bytearray.fromhex(h)) for i, h in enumerate((good, swapped, cut, bad_text))] + [(4, None)], "i int, payload binary")
    got = {r.i: r for r in decoded(df, "payload", schema).collect()}
    assert tuple(got[0].record) == tuple(got[1].record) == (42, "a")
    assert (got[2].record, got[2].error) == (None, "unexpected_eof") and got[3].error == "invalid_utf8" and got[4].record is None and got[4].error is None
    assert decoded(df, "payload", schema, mode="DROPMALFORMED").count() == 3
    with pytest.raises(Exception, match="unexpected_eof|invalid_utf8"):
        decoded(df, "payload", schema, mode="FAILFAST").collect()
    assert decoded(df.limit(0), "payload", schema).count() == 0


def test_violations(spark):
    schema = T.StructType([member("a", "int32", 1, required=True), member("b", "string", 2, required=True), member("c", "int32", 3)])
    assert frame(spark, schema, [(None, "x", None)]).select(violations(F.col("r"), schema)).first()[0] == ["a"]
