"""Length-framed runs of records inside binary values."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomwire.functions import wire


MOST_BYTES = 8 << 20  # of a batch of frames; a longer frame is a batch of its own


def binary_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the row offsets of a binary column; a null has no bytes."""
    column = column.fill_null(b"") if column.null_count else column
    wide = pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8), off


def runs_of(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """``size`` bytes from each ``start`` as binaries."""
    off = np.concatenate(([0], np.cumsum(size)))
    if len(size) and off[-1] > 256 * len(size):  # long runs: one copy each
        flat = np.concatenate([data[s : s + n] for s, n in zip(start, size, strict=True)])
    else:
        flat = data[np.repeat(start - off[:-1], size) + np.arange(off[-1])]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(flat))]).cast(pa.binary())


def frame_bounds(data: bytes, limit: int = 0, strict: bool = False) -> tuple[list[tuple[int, int, int]], str | None]:
    """((offset, start, end) of each frame, fault).  An end between frames, or before a frame's first payload byte, is clean unless ``strict``."""
    out: list[tuple[int, int, int]] = []
    at = 0
    while at < len(data):
        value = shift = 0
        p = at
        while p < len(data) and data[p] > 127 and shift < 63:
            value |= (data[p] & 127) << shift
            p, shift = p + 1, shift + 7
        if p >= len(data):
            return out, "unexpected_eof" if strict else None
        value |= data[p] << shift
        p += 1
        if limit and value > limit:
            return out, "message_too_large"
        if p + value > len(data):
            return out, None if p == len(data) and not strict else "unexpected_eof"
        out.append((at, p, p + value))
        at = p + value
    return out, None


def batch_bounds(data: np.ndarray, begin: np.ndarray, end: np.ndarray, limit: int = 0, strict: bool = False, few: int = 32) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str | None]]:
    """(row, offset, start, end of each frame, fault by row): ``frame_bounds`` of many runs, [begin, end) of ``data`` each, a frame of all rows at a time.

    Offsets count from a row's begin, starts and ends from that of ``data``; frames are by row, in order.  The last ``few`` rows go on one by one.
    """
    rows, at, faults, found = np.flatnonzero(begin < end), begin[begin < end], [None] * len(begin), []
    while len(rows) > few:
        stop, value, p = end[rows], np.zeros(len(rows), np.uint64), at.copy()
        go = np.ones(len(rows), bool)
        for i in range(8):
            b = data[np.minimum(p, len(data) - 1)]
            more = go & (p < stop)
            value[more] |= (b[more] & np.uint8(127)).astype(np.uint64) << np.uint64(7 * i)
            go = more & (b > 127)
            p[go] += 1
            if not go.any():
                break
        # lengths of more than eight bytes are left to the reader of single runs
        wide, short = (p - at >= 8) & (p < stop), p >= stop
        size = np.where(wide | short, 0, value).astype(np.int64)
        p = p + 1
        large = ~wide & ~short & (limit > 0) & (size > limit)
        cut = ~wide & ~short & ~large & (size > stop - p)
        for r in rows[large]:
            faults[r] = "message_too_large"
        for r in rows[(cut & ((p < stop) | strict)) | (short & strict)]:
            faults[r] = "unexpected_eof"
        for r, start in zip(rows[wide], at[wide], strict=True):
            own, faults[r] = frame_bounds(data[start : end[r]].tobytes(), limit, strict)
            found.append(_placed(r, own, start, begin[r]))
        sound = ~(wide | short | large | cut)
        found.append((rows[sound], at[sound] - begin[rows[sound]], p[sound], (p + size)[sound]))
        rows, at = rows[sound], (p + size)[sound]
        left = at < end[rows]
        rows, at = rows[left], at[left]
    for r, start in zip(rows, at, strict=True):
        own, faults[r] = frame_bounds(data[start : end[r]].tobytes(), limit, strict)
        found.append(_placed(r, own, start, begin[r]))
    row, offset, first, last = (np.concatenate([f[c] for f in found]) if found else np.zeros(0, np.int64) for c in range(4))
    order = np.argsort(row, kind="stable")
    return row[order], offset[order], first[order], last[order], faults


def _placed(row: int, bounds: list[tuple[int, int, int]], start: int, begin: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    own = np.array(bounds, np.int64).reshape(-1, 3) + start
    return np.full(len(own), row), own[:, 0] - begin, own[:, 1], own[:, 2]


def explode_frames(df: DataFrame, column: str, limit: int = 64 << 20, strict: bool = False) -> DataFrame:
    """A row for each frame of a binary column: the other columns, ordinal, offset, payload and, for what follows the last sound frame, error."""
    kept = [f for f in df.schema.fields if f.name != column]
    out = T.StructType([*kept, T.StructField("ordinal", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("payload", T.BinaryType()), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data, off = binary_parts(batch.column(len(kept)))
            row, offset, first, last, faults = batch_bounds(data, off[:-1], off[1:], limit, strict)
            count = np.bincount(row, minlength=batch.num_rows)
            ordinal = np.arange(len(row)) - (np.cumsum(count) - count)[row]
            # a fault is a row behind its run's frames, at the end of the last one
            bad = np.array([i for i, f in enumerate(faults) if f], np.int64)
            behind = np.cumsum(count)[bad]
            ends = np.where(count[bad] > 0, last[np.maximum(behind - 1, 0)] - off[bad], 0) if len(last) else np.zeros(len(bad), np.int64)
            row, ordinal, offset = np.insert(row, behind, bad), np.insert(ordinal, behind, count[bad]), np.insert(offset, behind, ends)
            error = np.insert(np.full(len(first), None, object), behind, np.array(faults, object)[bad])
            first, last = np.insert(first, behind, 0), np.insert(last, behind, 0)
            size = last - first
            until = np.cumsum(size + MOST_BYTES // 10_000)
            i = 0
            while i < len(row):
                j = max(i + 1, int(np.searchsorted(until, (until[i - 1] if i else 0) + MOST_BYTES, side="right")))
                own = [batch.column(c).take(pa.array(row[i:j])) for c in range(len(kept))]
                none = pa.array([x is not None for x in error[i:j]])
                cols = [pa.array(ordinal[i:j]), pa.array(offset[i:j]), pc.if_else(none, pa.scalar(None, pa.binary()), runs_of(data, first[i:j], size[i:j])), pa.array(error[i:j], pa.string())]
                yield pa.record_batch([*own, *cols], out.fieldNames())
                i = j

    return df.select(*[F.col(f"`{f.name}`") for f in kept], F.col(f"`{column}`")).mapInArrow(run, out)


def chunked(df: DataFrame, order: list[str], size: Column, most_rows: int = 4096, most_bytes: int = 8 << 20) -> DataFrame:
    """``df`` with a long column ``chunk`` that ascends along ``order`` (a key's columns first, then what tells its rows apart).

    The rows are dealt by range of ``order``, so that a key of many rows is spread over tasks.  A chunk holds ``most_rows`` rows at most, and
    ``most_bytes`` of ``size`` and one row more; a group by (key, chunk) has that bound, however many rows the key has.
    """
    out = T.StructType([*df.schema.fields, T.StructField("chunk", T.LongType())])
    least = -(-most_bytes // most_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, done = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            weight = np.maximum(batch.column(batch.num_columns - 1).fill_null(0).to_numpy(zero_copy_only=False), least)
            until = done + np.cumsum(weight)
            if len(until):
                done = int(until[-1])
            yield pa.record_batch([*batch.columns[:-1], pa.array(first + (until - 1) // most_bytes)], out.fieldNames())

    rows = df.withColumn("_fathomwire_size", size.cast("long")).repartitionByRange(*order).sortWithinPartitions(*order)
    return rows.mapInArrow(run, out)


def gather_frames(df: DataFrame, keys: list[str], payload: str, order: list[str]) -> DataFrame:
    """One framed run a key: (keys, frames), its frames in order.  A run is one binary: for keys of many rows, ``chunk`` (see ``chunked``) is one of the keys."""
    rows = F.array_sort(F.collect_list(F.struct(*order, F.hex(wire.framed(F.col(payload))).alias("_frame"))))
    return df.groupBy(*keys).agg(F.unhex(F.array_join(F.transform(rows, lambda r: r["_frame"]), "")).alias("frames"))
