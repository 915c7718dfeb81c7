"""Column helpers around records: names, enums, time stamps, raw float runs, faults."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import wire

# Fault codes by what they mean for a reader.
LIMIT_FAULTS = ("message_too_large", "max_length_exceeded", "max_array_exceeded", "max_map_exceeded")


def name_words(name: Column) -> Column:
    """The words of an identifier, in lower case: parted at signs, before capitals and after runs of capitals (HTTPServer: http, server)."""
    parted = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(F.regexp_replace(parted, "[^A-Za-z0-9]+", " ")), " "), lambda w: w != "")


def snake_case(name: Column) -> Column:
    return F.array_join(name_words(name), "_")


def upper_snake_case(name: Column) -> Column:
    return F.upper(snake_case(name))


def kebab_case(name: Column) -> Column:
    return F.array_join(name_words(name), "-")


def pascal_case(name: Column) -> Column:
    return F.array_join(F.transform(name_words(name), F.initcap), "")


def camel_case(name: Column) -> Column:
    return F.array_join(F.transform(name_words(name), lambda w, i: F.when(i == 0, w).otherwise(F.initcap(w))), "")


def enum_name(value: Column, names: dict[int, str]) -> Column:
    """The name of an enum's number; null for a number without one."""
    return reduce(lambda acc, kv: F.when(value == kv[0], F.lit(kv[1])).otherwise(acc), names.items(), F.lit(None).cast("string"))


def enum_number(name: Column, names: dict[int, str]) -> Column:
    return reduce(lambda acc, kv: F.when(name == kv[1], F.lit(kv[0])).otherwise(acc), names.items(), F.lit(None).cast("int"))


def timestamp_parts(ts: Column) -> Column:
    """struct(seconds, nanos) of a timestamp, nanos from 0 to 999,999,999."""
    micros = F.unix_micros(ts)
    seconds = F.call_function("div", micros - F.pmod(micros, F.lit(1_000_000)), F.lit(1_000_000))
    return F.struct(seconds.cast("long").alias("seconds"), (F.pmod(micros, F.lit(1_000_000)) * 1000).cast("int").alias("nanos"))


def parts_timestamp(parts: Column) -> Column:
    """The timestamp of struct(seconds, nanos); what is finer than a microsecond is lost."""
    return F.timestamp_micros(parts["seconds"] * 1_000_000 + F.floor(parts["nanos"] / 1000).cast("long"))


def packed_floats(values: Column, size: int = 4) -> Column:
    """A run of little-endian floats without a count."""
    bits = wire.float_bits if size == 4 else wire.double_bits
    return wire.joined(F.transform(values, lambda v: wire.fixed_le(bits(v), size)))


def packed_fixed(values: Column, size: int = 4) -> Column:
    """A run of little-endian whole numbers without a count; of longer numbers the low bytes."""
    return wire.joined(F.transform(values, lambda v: wire.fixed_le(v.cast("long"), size)))


def _unpacked(data: Column, kind: str, item: str, arrow: pa.DataType) -> Column:
    size = np.dtype(kind).itemsize

    def run(column):
        whole = column.cast(pa.large_binary())
        _, offsets, buffer = whole.buffers()
        off = np.frombuffer(offsets, np.int64)[whole.offset : whole.offset + len(whole) + 1]
        n = np.diff(off) // size
        raw = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
        until = np.concatenate(([0], np.cumsum(n)))
        if len(n) and (np.diff(off) == n * size).all():
            flat = raw[off[0] : off[-1]]
        else:  # odd bytes behind the last whole number
            flat = raw[np.repeat(off[:-1] - until[:-1] * size, n * size) + np.arange(until[-1] * size)]
        return pa.ListArray.from_arrays(pa.array(until, pa.int32()), pa.array(np.ascontiguousarray(flat).view(kind)).cast(arrow), mask=pa.array(~np.asarray(column.is_valid())))

    return F.arrow_udf(run, f"array<{item}>")(data)


def unpacked_floats(data: Column, size: int = 4) -> Column:
    """The floats of such a run; bytes beyond the last whole one are left out.  ``data`` must be a stored column."""
    return _unpacked(data, "<f4", "float", pa.float32()) if size == 4 else _unpacked(data, "<f8", "double", pa.float64())


def unpacked_fixed(data: Column, size: int = 4) -> Column:
    """The unsigned numbers of a run of ``packed_fixed``; those of eight bytes as decimal(20,0)."""
    return _unpacked(data, "<u4", "long", pa.int64()) if size == 4 else F.transform(_unpacked(data, "<i8", "long", pa.int64()), wire.from_bits)


def fault_class(error: Column) -> Column:
    """ok, limit (a larger limit would let it pass) or malformed."""
    return F.when(error.isNull(), "ok").when(error.isin(*LIMIT_FAULTS), "limit").otherwise("malformed")
