"""Broadcasts only of sides whose bytes are measured."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Bytes in memory up to which a measured side is broadcast.
BROADCAST_BYTES = 24 << 20


def _bytes(value: Column, kind: T.DataType) -> Column:
    """Bytes that a value takes in a row, words of 8 for all of fixed length."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        inner = kind.elementType
        if isinstance(inner, (T.StringType, T.BinaryType, T.ArrayType, T.StructType)):
            return F.aggregate(F.coalesce(value, F.array().cast(kind)), F.lit(24).cast("long"), lambda n, x: n + _bytes(x, inner).cast("long"))
        return F.coalesce(F.size(value), F.lit(0)) * 8 + 24
    if isinstance(kind, T.StructType):
        total = F.lit(16)
        for f in kind.fields:
            total = total + _bytes(value[f.name], f.dataType)
        return total
    return F.lit(8)


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the rows of a table, measured in bytes with 48 for each row's own, are few enough to be broadcast."""
    row = F.lit(48)
    for f in df.schema.fields:
        row = row + _bytes(F.col(f"`{f.name}`"), f.dataType)
    return (df.agg(F.sum(row.cast("long"))).first()[0] or 0) <= limit


def hint(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if its bytes are measured to be few."""
    return F.broadcast(df) if small(df) else df
