"""Record plans: a StructType, with field numbers in its metadata, as ordered plain data that pickles."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

from pyspark.sql import types as T

HIGHEST = 536_870_911  # fixed value: the largest field number

# Wire types of the format.
VARINT, FIXED64, BYTES, FIXED32, SVARINT = 0, 1, 2, 3, 4

# Wire type of each scalar kind.
WIRE_TYPE = {
    "bool": VARINT,
    "uint8": VARINT,
    "uint16": VARINT,
    "uint32": VARINT,
    "uint64": VARINT,
    "int8": SVARINT,
    "int16": SVARINT,
    "int32": SVARINT,
    "int64": SVARINT,
    "enum": SVARINT,
    "float32": FIXED32,
    "float64": FIXED64,
    "complex64": FIXED64,
    "complex128": BYTES,
    "string": BYTES,
    "bytes": BYTES,
}

# Spark type of each scalar kind; unsigned numbers take the next wider signed type.
SPARK_TYPE: dict[str, T.DataType] = {
    "bool": T.BooleanType(),
    "uint8": T.ShortType(),
    "uint16": T.IntegerType(),
    "uint32": T.LongType(),
    "uint64": T.DecimalType(20, 0),
    "int8": T.ByteType(),
    "int16": T.ShortType(),
    "int32": T.IntegerType(),
    "int64": T.LongType(),
    "enum": T.IntegerType(),
    "float32": T.FloatType(),
    "float64": T.DoubleType(),
    "complex64": T.StructType([T.StructField("re", T.FloatType()), T.StructField("im", T.FloatType())]),
    "complex128": T.StructType([T.StructField("re", T.DoubleType()), T.StructField("im", T.DoubleType())]),
    "string": T.StringType(),
    "bytes": T.BinaryType(),
}
SIGNED = ("int8", "int16", "int32", "int64", "enum")
UNSIGNED = ("uint8", "uint16", "uint32", "uint64")
RANGE = {k: (-(1 << b - 1), (1 << b - 1) - 1) for k, b in (("int8", 8), ("int16", 16), ("int32", 32), ("int64", 64), ("enum", 32))}
RANGE |= {k: (0, (1 << b) - 1) for k, b in (("uint8", 8), ("uint16", 16), ("uint32", 32), ("uint64", 64))}
KEY_KINDS = ("string", "bool", *SIGNED, *UNSIGNED, "float32", "float64")


@dataclass(frozen=True)
class Shape:
    """A value's form: a scalar kind, ``list``, ``map``, ``record`` or ``union``."""

    kind: str
    item: Shape | None = None
    key: Shape | None = None
    fields: tuple[Member, ...] = ()
    size: int | None = None  # of a fixed array
    pointer: bool = False
    branches: tuple[tuple[int, str, Shape], ...] = ()  # of a union: type id, name, record

    @property
    def wire_type(self) -> int:
        return BYTES if self.pointer else WIRE_TYPE.get(self.kind, BYTES)

    def depth(self) -> int:
        inner = [x for x in (self.item, self.key) if x] + [m.shape for m in self.fields] + [b[2] for b in self.branches]
        return (self.kind in ("list", "map", "record")) + max([0, *(x.depth() for x in inner)])


@dataclass(frozen=True)
class Member:
    name: str
    number: int
    shape: Shape
    required: bool = False


@dataclass(frozen=True)
class Limits:
    """Largest sizes that are taken; 0 is no limit."""

    message: int = 64 << 20
    depth: int = 100
    string: int = 10 << 20
    binary: int = 100 << 20
    array: int = 1_000_000
    map: int = 1_000_000


@dataclass(frozen=True)
class Options:
    limits: Limits = field(default_factory=Limits)
    strict: bool = False  # unknown fields, early ends and bytes after the end are errors
    validate_utf8: bool = True
    omit_empty: bool = True
    absent: str = "zero"  # what a missing plain field becomes: "zero" or "null"


# Option presets.
DEFAULT = Options()
SECURE = Options(Limits(1 << 20, 32, 1 << 20, 10 << 20, 10_000, 10_000))
STRICT = Options(strict=True)
FAST = Options(validate_utf8=False)
UNLIMITED = Options(Limits(0, 0, 0, 0, 0, 0))


_PLAIN = {t.simpleString(): t for t in (T.BooleanType(), T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType(), T.FloatType(), T.DoubleType(), T.StringType(), T.BinaryType())}


def spark_type(text: str) -> T.DataType:
    """The type of a scalar kind, a plain Spark type name, or array<...> and map<...> of those; needs no session."""
    if text in SPARK_TYPE or text in _PLAIN:
        return SPARK_TYPE.get(text) or _PLAIN[text]
    head, _, rest = text.partition("<")
    if head == "array" and rest.endswith(">"):
        return T.ArrayType(spark_type(rest[:-1]))
    if head == "map" and rest.endswith(">"):
        key, _, value = rest[:-1].partition(",")
        return T.MapType(spark_type(key.strip()), spark_type(value.strip()))
    raise TypeError(f"no type {text}")


def member(name: str, data_type: T.DataType | str, number: int, kind: str | None = None, pointer: bool = False, required: bool = False, size: int | None = None, comment: str | None = None) -> T.StructField:
    """A StructField with its wire attributes; ``kind`` is needed where the Spark type leaves it open (unsigned, enum, complex)."""
    if isinstance(data_type, str):
        data_type = spark_type(data_type)
    meta = {"field_number": number} | {k: v for k, v in (("kind", kind), ("pointer", pointer), ("required", required), ("fixed_size", size), ("comment", comment)) if v}
    return T.StructField(name, data_type, True, meta)


_KIND_OF = {
    T.BooleanType: "bool",
    T.ByteType: "int8",
    T.ShortType: "int16",
    T.IntegerType: "int32",
    T.LongType: "int64",
    T.DecimalType: "uint64",
    T.FloatType: "float32",
    T.DoubleType: "float64",
    T.StringType: "string",
    T.BinaryType: "bytes",
}


def shape_of(data_type: T.DataType, meta: dict | None = None) -> Shape:
    """The shape of a Spark type; ``meta`` may name the kind of its innermost scalar."""
    meta = meta or {}
    pointer = bool(meta.get("pointer"))
    inner = {k: v for k, v in meta.items() if k in ("kind", "item_pointer")}
    if inner.pop("item_pointer", False):
        inner["pointer"] = True
    if isinstance(data_type, T.ArrayType):
        return Shape("list", item=shape_of(data_type.elementType, inner), size=meta.get("fixed_size"), pointer=pointer)
    if isinstance(data_type, T.MapType):
        key = shape_of(data_type.keyType, {"kind": meta["key_kind"]} if meta.get("key_kind") else None)
        if key.kind not in KEY_KINDS:
            raise TypeError(f"a map's key can't be {key.kind}")
        return Shape("map", item=shape_of(data_type.valueType, inner), key=key, pointer=pointer)
    if meta.get("kind"):
        return Shape(meta["kind"], pointer=pointer)
    if isinstance(data_type, T.StructType):
        if data_type.fields and all("type_id" in f.metadata for f in data_type.fields):
            return Shape("union", branches=tuple((f.metadata["type_id"], f.name, shape_of(f.dataType)) for f in data_type.fields), pointer=pointer)
        return Shape("record", fields=members(data_type), pointer=pointer)
    for kind, name in _KIND_OF.items():
        if isinstance(data_type, kind):
            return Shape(name, pointer=pointer)
    raise TypeError(f"no wire form for {data_type.simpleString()}")


def members(struct: T.StructType) -> tuple[Member, ...]:
    """Fields by number; a field without one takes its place (from 1)."""
    found = []
    for i, f in enumerate(struct.fields):
        meta = f.metadata or {}
        found.append(Member(f.name, int(meta.get("field_number", i + 1)), shape_of(f.dataType, meta), bool(meta.get("required"))))
    numbers = [m.number for m in found]
    if len(set(numbers)) < len(numbers) or min(numbers, default=1) < 1 or max(numbers, default=1) > HIGHEST:
        raise ValueError(f"field numbers must be different and from 1 to {HIGHEST}")
    return tuple(sorted(found, key=lambda m: m.number))


def record(struct: T.StructType, limits: Limits = DEFAULT.limits) -> Shape:
    shape = Shape("record", fields=members(struct))
    if limits.depth and shape.depth() > limits.depth:
        raise ValueError(f"records nest {shape.depth()} deep; the limit is {limits.depth}")
    return shape


def union(branches: dict[str, tuple[int, T.StructType]]) -> T.StructType:
    """A union's type from name -> (type id, record); ids must be positive and different, and below 128 they are reserved."""
    ids = [i for i, _ in branches.values()]
    if len(set(ids)) < len(ids) or min(ids, default=1) < 1:
        raise ValueError("type ids must be positive and different")
    if min(ids, default=128) < 128:
        warnings.warn("type ids below 128 are reserved", stacklevel=2)
    return T.StructType([T.StructField(name, record_type, True, {"type_id": i}) for name, (i, record_type) in branches.items()])
