"""Records to canonical bytes, and their sizes, as Catalyst expressions.

Canonical: fields ascend by number, zero values are left out, map entries ascend by key, floats have one NaN and no negative zero.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomwire.functions import wire
from fathomwire.plans.types import DEFAULT, SIGNED, UNSIGNED, Options, Shape, record


def is_zero(value: Column, shape: Shape) -> Column:
    """Whether a field with this value is left out; null counts as zero."""
    if shape.pointer:
        return value.isNull()
    if shape.kind == "bool":
        zero = ~value
    elif shape.kind in SIGNED + UNSIGNED or shape.kind in ("float32", "float64"):
        zero = value == 0
    elif shape.kind in ("string", "bytes"):
        zero = F.octet_length(value) == 0
    elif shape.kind == "list":
        zero = F.size(value) == 0 if shape.size is None else F.lit(shape.size == 0)
    elif shape.kind == "map":
        zero = F.size(value) == 0
    elif shape.kind in ("complex64", "complex128"):
        zero = (value["re"] == 0) & (value["im"] == 0)
    elif shape.kind == "union":
        zero = reduce(lambda a, b: a & b, [value[name].isNull() for _, name, _ in shape.branches])
    else:
        zero = reduce(lambda a, b: a & b, [is_zero(value[m.name], m.shape) for m in shape.fields], F.lit(True))
    return F.coalesce(zero, F.lit(True))


def _number(value: Column, shape: Shape) -> Column:
    """The long whose varint or fixed bytes stand for a scalar."""
    if shape.kind == "uint64":
        return wire.unsigned_bits(F.coalesce(value, F.lit(0)))
    return F.coalesce(value.cast("long"), F.lit(0).cast("long"))


def body(value: Column, shape: Shape, omit_empty: bool = True) -> Column:
    """A value's bytes without its tag; null is the zero value, or nil behind a pointer."""
    if shape.pointer:
        plain = Shape(**{**shape.__dict__, "pointer": False})
        return F.when(value.isNull(), wire.raw(b"\x00")).otherwise(body(value, plain, omit_empty))
    kind = shape.kind
    if kind == "bool":
        return F.when(value, wire.raw(b"\x01")).otherwise(wire.raw(b"\x00"))
    if kind in ("int8", "uint8"):
        return wire.byte(_number(value, shape))
    if kind in SIGNED:
        return wire.svarint(_number(value, shape))
    if kind in UNSIGNED:
        return wire.uvarint(_number(value, shape))
    if kind == "float32":
        return wire.fixed_le(wire.float_bits(F.coalesce(value, F.lit(0.0))), 4)
    if kind == "float64":
        return wire.fixed_le(wire.double_bits(F.coalesce(value, F.lit(0.0))), 8)
    if kind in ("complex64", "complex128"):
        part = Shape("float32" if kind == "complex64" else "float64")
        return F.concat(body(value["re"], part), body(value["im"], part))
    if kind == "string":
        return wire.framed(F.encode(F.coalesce(value, F.lit("")), "UTF-8"))
    if kind == "bytes":
        return wire.framed(F.coalesce(value, wire.raw(b"")))
    if kind == "list":
        checked = value if shape.size is None else F.when(F.size(value) == shape.size, value).otherwise(F.raise_error(F.lit(f"a fixed array needs {shape.size} items")))
        packed = F.concat(wire.uvarint(F.size(checked).cast("long")), wire.joined(F.transform(checked, lambda x: body(x, shape.item, omit_empty))))
        return F.when(value.isNull(), wire.raw(b"\x00")).otherwise(packed)
    if kind == "map":
        entries = F.sort_array(F.map_entries(value))  # keys differ; array_sort compares by an expression for each pair
        packed = F.concat(
            wire.uvarint(F.size(value).cast("long")),
            wire.joined(F.transform(entries, lambda e: F.concat(body(e["key"], shape.key), body(e["value"], shape.item, omit_empty)))),
        )
        return F.when(value.isNull(), wire.raw(b"\x00")).otherwise(packed)
    if kind == "union":
        out = wire.raw(b"\x00")
        for type_id, name, branch in reversed(shape.branches):
            out = F.when(value[name].isNotNull(), F.concat(wire.raw(wire.uvarint_bytes(type_id)), body(value[name], branch, omit_empty))).otherwise(out)
        return out
    parts = []
    for m in shape.fields:
        own = F.concat(wire.raw(wire.compact_tag(m.number, m.shape.wire_type)), body(value[m.name], m.shape, omit_empty))
        left_out = is_zero(value[m.name], m.shape) if omit_empty else (value[m.name].isNull() if m.shape.pointer else F.lit(False))
        parts.append(F.when(left_out, wire.raw(b"")).otherwise(own))
    return F.concat(*parts, wire.raw(b"\x00"))


def to_wire(value: Column, schema: T.StructType, options: Options = DEFAULT) -> Column:
    """The canonical bytes of a struct column; a null struct gives null."""
    out = body(value, record(schema, options.limits), options.omit_empty)
    if options.limits.message:
        shape, limit = record(schema), options.limits.message
        large = (size_bound(value, shape) > limit) & (body_size(value, shape, options.omit_empty) > limit)  # the second only where the first holds
        out = F.when(large, F.raise_error(F.lit("message too large"))).otherwise(out)
    return F.when(value.isNotNull(), out)


def size_bound(value: Column, shape: Shape) -> Column:
    """At least ``body_size``, and cheap: lengths of texts and lists, and the most that a number takes."""
    if shape.kind in ("string", "bytes"):
        return F.coalesce(F.octet_length(value), F.lit(0)).cast("long") + 5
    if shape.kind == "record":
        return reduce(lambda a, b: a + b, [size_bound(value[m.name], m.shape) + 6 for m in shape.fields], F.lit(1).cast("long"))
    if shape.kind == "list" and shape.item.kind not in ("string", "bytes", "record", "list", "map", "union"):
        return F.coalesce(F.size(value), F.lit(0)).cast("long") * 16 + 5
    if shape.kind in ("list", "map", "union"):
        return body_size(value, shape, False).cast("long") + 1
    return F.lit(16).cast("long")


def body_size(value: Column, shape: Shape, omit_empty: bool = True) -> Column:
    """Bytes of ``body``, without making them."""
    if shape.pointer:
        plain = Shape(**{**shape.__dict__, "pointer": False})
        return F.when(value.isNull(), F.lit(1)).otherwise(body_size(value, plain, omit_empty))
    kind = shape.kind
    fixed = {"bool": 1, "int8": 1, "uint8": 1, "float32": 4, "float64": 8, "complex64": 8, "complex128": 16}.get(kind)
    if fixed:
        return F.lit(fixed)
    if kind in SIGNED:
        return wire.svarint_size(_number(value, shape))
    if kind in UNSIGNED:
        return wire.uvarint_size(_number(value, shape))
    if kind in ("string", "bytes"):
        n = F.coalesce(F.octet_length(value), F.lit(0))
        return wire.uvarint_size(n.cast("long")) + n
    if kind == "list":
        total = F.aggregate(value, F.lit(0), lambda acc, x: acc + body_size(x, shape.item, omit_empty))
        return F.when(value.isNull(), F.lit(1)).otherwise(wire.uvarint_size(F.size(value).cast("long")) + total)
    if kind == "map":
        total = F.aggregate(F.map_entries(value), F.lit(0), lambda acc, e: acc + body_size(e["key"], shape.key) + body_size(e["value"], shape.item, omit_empty))
        return F.when(value.isNull(), F.lit(1)).otherwise(wire.uvarint_size(F.size(value).cast("long")) + total)
    if kind == "union":
        out = F.lit(1)
        for type_id, name, branch in reversed(shape.branches):
            out = F.when(value[name].isNotNull(), F.lit(len(wire.uvarint_bytes(type_id))) + body_size(value[name], branch, omit_empty)).otherwise(out)
        return out
    total = F.lit(1)
    for m in shape.fields:
        own = F.lit(len(wire.compact_tag(m.number, m.shape.wire_type))) + body_size(value[m.name], m.shape, omit_empty)
        left_out = is_zero(value[m.name], m.shape) if omit_empty else (value[m.name].isNull() if m.shape.pointer else F.lit(False))
        total = total + F.when(left_out, F.lit(0)).otherwise(own)
    return total


def wire_size(value: Column, schema: T.StructType, options: Options = DEFAULT) -> Column:
    """The length of ``to_wire``."""
    return F.when(value.isNotNull(), body_size(value, record(schema, options.limits), options.omit_empty))


def violations(value: Column, schema: T.StructType) -> Column:
    """Names of required fields that hold null."""
    names = [F.when(value[m.name].isNull(), F.lit(m.name)) for m in record(schema).fields if m.required]
    return F.array_compact(F.array(*names)) if names else F.array().cast("array<string>")


def wire_type_id(data: Column) -> Column:
    """The type id at the head of a union's bytes."""
    return wire.leading_uvarint(data)
