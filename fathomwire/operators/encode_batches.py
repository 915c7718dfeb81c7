"""Flat records to canonical bytes in Arrow batches: all rows of a batch field by field, with numpy.

The bytes are those of ``to_wire``, which also takes nested records.  Where rows go on to Python anyway (a decoder, a frame writer), this
costs less than expressions that spell each number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomwire.functions.wire import compact_tag
from fathomwire.operators.encode import to_wire
from fathomwire.plans.types import DEFAULT, SIGNED, UNSIGNED, Member, Options, record

VARINTS = tuple(k for k in SIGNED + UNSIGNED if k not in ("int8", "uint8", "uint64"))
FLAT = ("bool", "int8", "uint8", "float32", "float64", "string", "bytes", *VARINTS)


def uvarint_sizes(u: np.ndarray) -> np.ndarray:
    size = np.ones(len(u), np.int64)
    for n in range(1, 10):
        more = u >= np.uint64(1 << 7 * n)
        if not more.any():
            break
        size += more
    return size


def put_uvarints(out: np.ndarray, at: np.ndarray, u: np.ndarray, size: np.ndarray) -> None:
    for i in range(int(size.max(initial=0))):
        rows = np.flatnonzero(size > i)
        group = (u[rows] >> np.uint64(7 * i)).astype(np.uint8) & np.uint8(127)
        out[at[rows] + i] = group | (size[rows] > i + 1).astype(np.uint8) << np.uint8(7)


def put_runs(out: np.ndarray, at: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
    """Copy ``length`` bytes from each ``start`` of ``data`` to each place of ``out``."""
    until = np.cumsum(length)
    step = np.arange(int(until[-1]) if len(until) else 0)
    first = until - length
    out[np.repeat(at - first, length) + step] = data[np.repeat(start - first, length) + step]


def canonical(values: np.ndarray) -> np.ndarray:
    """One NaN, no negative zero."""
    return np.where(np.isnan(values), values.dtype.type(np.nan), values + values.dtype.type(0))


class Part:
    """A field of a batch: which rows hold it, how many bytes its body takes, and how to put them."""

    def __init__(self, m: Member, column: pa.Array, omit_empty: bool):
        kind, valid = m.shape.kind, np.asarray(column.is_valid())
        self.tag = np.frombuffer(compact_tag(m.number, m.shape.wire_type), np.uint8)
        if kind in ("string", "bytes"):
            whole = pc.fill_null(column, "" if kind == "string" else b"").cast(pa.large_binary())
            _, offsets, data = whole.buffers()
            self.start = np.frombuffer(offsets, np.int64)[whole.offset : whole.offset + len(whole) + 1] if len(whole) else np.zeros(1, np.int64)
            self.data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
            self.length = np.diff(self.start)
            self.number = self.length.astype(np.uint64)
            self.head = uvarint_sizes(self.number)
            zero, self.size = self.length == 0, self.head + self.length
        else:
            values = pc.fill_null(column, False if kind == "bool" else 0).to_numpy(zero_copy_only=False)
            zero = ~values if kind == "bool" else values == 0
            self.number = None
            if kind in VARINTS:
                v = values.astype(np.int64)
                self.number = ((v << 1) ^ (v >> 63)).astype(np.uint64) if kind in SIGNED else v.astype(np.uint64)
                self.head = self.size = uvarint_sizes(self.number)
            else:
                if kind in ("float32", "float64"):
                    values = canonical(values.astype("<f4" if kind == "float32" else "<f8"))
                else:
                    values = values.astype(np.int64).astype(np.uint8)
                self.fixed = values.view(np.uint8).reshape(len(values), -1)
                self.size = np.full(len(values), self.fixed.shape[1], np.int64)
        self.kind = kind
        self.here = valid if m.shape.pointer else ~zero if omit_empty else np.ones(len(valid), bool)
        self.total = np.where(self.here, len(self.tag) + self.size, 0)

    def put(self, out: np.ndarray, at: np.ndarray) -> None:
        rows = np.flatnonzero(self.here)
        at = at[rows]
        for i, b in enumerate(self.tag):
            out[at + i] = b
        at = at + len(self.tag)
        if self.number is None:
            out[at[:, None] + np.arange(self.fixed.shape[1])] = self.fixed[rows]
            return
        put_uvarints(out, at, self.number[rows], self.head[rows])
        if self.kind in ("string", "bytes"):
            put_runs(out, at + self.head[rows], self.data, self.start[rows], self.length[rows])


def is_flat(schema: T.StructType) -> bool:
    """Whether a record's fields are scalars that ``encode_batch`` takes."""
    return all(m.shape.kind in FLAT for m in record(schema).fields)


def encode_batch(members: tuple[Member, ...], columns: dict[str, pa.Array], n: int, options: Options = DEFAULT) -> pa.Array:
    """The canonical bytes of ``n`` rows."""
    parts = [Part(m, columns[m.name], options.omit_empty) for m in members]
    size = np.ones(n, np.int64)
    for p in parts:
        size += p.total
    if options.limits.message and n and size.max() > options.limits.message:
        raise ValueError("message too large")
    off = np.concatenate(([0], np.cumsum(size)))
    out, at = np.zeros(int(off[-1]), np.uint8), off[:-1].copy()
    for p in parts:
        p.put(out, at)
        at += p.total
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(off), pa.py_buffer(out)])


def with_wire(df: DataFrame, schema: T.StructType, payload: str = "payload", keep: tuple[str, ...] = (), options: Options = DEFAULT) -> DataFrame:
    """``df``'s columns ``keep`` and its columns that ``schema`` names as one canonical record in ``payload``."""
    names = schema.fieldNames()
    kept = [df.schema[c] for c in keep]
    if not is_flat(schema):
        return df.select(*[F.col(f"`{c}`") for c in keep], to_wire(F.struct(*[F.col(f"`{c}`") for c in names]), schema, options).alias(payload))
    members = record(schema, options.limits).fields
    out = T.StructType([*kept, T.StructField(payload, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = dict(zip(names, batch.columns[len(kept) :], strict=True))
            for i in range(0, batch.num_rows, 4096):
                n = min(4096, batch.num_rows - i)
                made = encode_batch(members, {k: c.slice(i, n) for k, c in own.items()}, n, options)
                yield pa.record_batch([*[c.slice(i, n) for c in batch.columns[: len(kept)]], made.cast(pa.binary())], out.fieldNames())

    columns = [F.col(f"`{f.name}`").cast(f.dataType).alias(f"_{i}") for i, f in enumerate(schema.fields)]
    return df.select(*[F.col(f"`{c}`") for c in keep], *columns).mapInArrow(run, out)
