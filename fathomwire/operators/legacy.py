"""Runs of fields behind the older tags (number * 8 + wire type, as a varint): their places, without decoding them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomwire.operators.decode import Malformed, uvarint_at

# What follows an older tag, by wire type: a varint, so many bytes, a length and bytes, or a type id.
VARINT_TYPES, WIDTHS, SIZED, TYPE_ID = (0, 6), {1: 8, 5: 4}, 2, 7


def legacy_bounds(data: bytes) -> tuple[list[tuple[int, int, int, int]], Malformed | None]:
    """((number, wire type, start, end of the value) of each field, fault).  Of a type id's value only the id is known."""
    out, at = [], 0
    try:
        while at < len(data):
            tag, start = uvarint_at(data, at)
            number, kind = tag >> 3, tag & 7
            if number < 1:
                raise Malformed("invalid_tag", at)
            if kind in VARINT_TYPES or kind == TYPE_ID:
                end = uvarint_at(data, start)[1]
            elif kind in WIDTHS:
                end = start + WIDTHS[kind]
            elif kind == SIZED:
                n, begin = uvarint_at(data, start)
                end = begin + n
            else:
                raise Malformed("invalid_wire_type", at)
            if end > len(data):
                raise Malformed("unexpected_eof", start)
            out.append((number, kind, start, end))
            at = end
    except Malformed as fault:
        return out, fault
    return out, None


def legacy_fields(df: DataFrame, column: str) -> DataFrame:
    """A row for each field of a binary column: the other columns, number, wire_type, start, end and, for what follows the last sound field, error."""
    kept = [f for f in df.schema.fields if f.name != column]
    out = T.StructType([*kept, *[T.StructField(n, T.LongType()) for n in ("number", "wire_type", "start", "end")], T.StructField("error", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, data in enumerate(batch.column(len(kept)).to_pylist()):
                found, fault = legacy_bounds(data) if data is not None else ([], None)
                rows += [(*f, None) for f in found] + ([(None, None, fault.at, None, fault.code)] if fault else [])
                at += [i] * (len(found) + (fault is not None))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            own = [c.take(pa.array(at, pa.int64())) for c in batch.columns[: len(kept)]]
            yield pa.record_batch([*own, *[pa.array(c, pa.int64()) for c in columns[:4]], pa.array(columns[4], pa.string())], out.fieldNames())

    return df.select(*[F.col(f"`{f.name}`") for f in kept], F.col(f"`{column}`")).mapInArrow(run, out)
