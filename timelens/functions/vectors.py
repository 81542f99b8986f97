"""Vector arithmetic as columns, and conversion from and to packed bytes."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T


def _squares(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))


def norm(v: Column) -> Column:
    """Euclidean length, summed in double and rounded to float."""
    return F.sqrt(_squares(v)).cast("float")


def cosine(q: Column, r: Column) -> Column:
    """Cosine similarity as float; 0 when lengths differ or either side is zero.

    For scoring whole tables see ``operators.semantic``, which does the same
    arithmetic on Arrow batches.
    """
    dot = F.aggregate(
        F.zip_with(q, r, lambda a, b: a.cast("double") * b.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )
    length = norm(q).cast("double") * F.sqrt(_squares(r))
    return (
        F.when((F.size(q) != F.size(r)) | (length == 0), F.lit(0.0))
        .otherwise(F.try_divide(dot, length))
        .cast("float")
    )


def literal_vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)).cast("float") for v in values]).cast("array<float>")


def _offsets(values: pa.Array) -> np.ndarray:
    """Where each value of a binary or list array begins and ends in its flat data."""
    wide = pa.types.is_large_binary(values.type) or pa.types.is_large_list(values.type)
    held = np.frombuffer(values.buffers()[1], np.int64 if wide else np.int32)
    return held[values.offset:values.offset + len(values) + 1].astype(np.int64)


@F.arrow_udf(T.ArrayType(T.FloatType()))
def unpack_vector(blobs: pa.Array) -> pa.Array:
    """Little-endian float32 bytes to an array; NULL if empty or cut short.

    The bytes of good values, one behind the other, are the numbers.
    """
    if not len(blobs):
        return pa.array([], pa.list_(pa.float32()))
    size = pc.binary_length(blobs)
    good = pc.fill_null(pc.and_(pc.greater(size, 0), pc.equal(pc.bit_wise_and(size, pa.scalar(3, size.type)), 0)), False)
    held = pc.if_else(good, blobs, pa.scalar(b"", blobs.type))
    ends, data = _offsets(held), held.buffers()[2]
    numbers = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]].view("<f4") if data is not None else np.zeros(0, "<f4")
    return pa.ListArray.from_arrays(
        pa.array((ends - ends[0]) // 4, pa.int32()), pa.array(numbers, pa.float32()), mask=pc.invert(good))


@F.arrow_udf(T.BinaryType())
def pack_vector(vectors: pa.Array) -> pa.Array:
    """An array of floats to little-endian float32 bytes; a missing number becomes NaN."""
    if not len(vectors):
        return pa.array([], pa.binary())
    none = vectors.is_null().to_numpy(zero_copy_only=False)
    ends = _offsets(vectors)
    sizes = np.where(none, 0, np.diff(ends))
    numbers = pc.fill_null(vectors.values, float("nan")).to_numpy(zero_copy_only=False).astype("<f4")
    # NULL vectors may have numbers of their own below them
    kept = np.repeat(~none, np.diff(ends))
    data = numbers[ends[0]:ends[-1]][kept].tobytes()
    places = np.concatenate([[0], np.cumsum(4 * sizes)]).astype(np.int32)
    marks = pa.py_buffer(np.packbits(~none, bitorder="little").tobytes())
    return pa.BinaryArray.from_buffers(
        pa.binary(), len(vectors), [marks, pa.py_buffer(places.tobytes()), pa.py_buffer(data)], int(none.sum()))


def import_vectors(df: DataFrame, blob: str, into: str = "embedding") -> DataFrame:
    return df.withColumn(into, unpack_vector(F.col(blob)))


def export_vectors(df: DataFrame, vector: str = "embedding", into: str = "blob") -> DataFrame:
    return df.withColumn(into, pack_vector(F.col(vector)))
