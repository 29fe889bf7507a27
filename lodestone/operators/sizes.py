"""What may be broadcast: only what has been counted, in rows and in bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes that may be broadcast.
ROWS, BYTES = 1_000_000, 64 << 20


def _width(field: T.StructField) -> Column:
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 8
    return F.when(column.isNull(), 8).otherwise(8 * F.size(column)) if isinstance(field.dataType, T.ArrayType) else F.lit(8)


def is_small(df: DataFrame, rows: int = ROWS, size: int = BYTES) -> bool:
    """Whether df has been counted to be within the bounds. It is computed for that, so it should be kept."""
    width = F.lit(0)
    for field in df.schema:
        width = width + _width(field)
    n, total = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return n <= rows and total <= size


def sent_if_small(df: DataFrame, rows: int = ROWS, size: int = BYTES) -> DataFrame:
    """df, to be broadcast if it is small."""
    return F.broadcast(df) if is_small(df, rows, size) else df


def settled(df: DataFrame, rows: int = 200_000, size: int = 16 << 20) -> DataFrame:
    """df, computed once. If it is small it becomes a table of the driver's, and plans that use it end there: they
    would hold all of df's own plan each time. Else it is persisted."""
    df = df.persist()
    if not is_small(df, rows, size):
        return df
    found = df.sparkSession.createDataFrame(df.toArrow(), df.schema)
    df.unpersist()
    return found
