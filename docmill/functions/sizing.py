"""Size checks that guard every explicit broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Bounds under which a side is broadcast: rows, and bytes as measured by
# ``row_bytes`` (deserialised hash tables take a small multiple of it).
DEFAULT_MAX_BROADCAST_ROWS = 500_000
DEFAULT_MAX_BROADCAST_BYTES = 64 << 20

_FIXED = {T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4, T.DateType: 4}


def _value_bytes(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.octet_length(value)
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType, T.MapType)):
            return F.aggregate(value, F.lit(0).cast("long"),
                               lambda acc, x: acc + F.coalesce(_value_bytes(x, kind.elementType), F.lit(8)) + 8)
        return F.size(value) * _FIXED.get(type(kind.elementType), 8)
    if isinstance(kind, T.MapType):
        return _value_bytes(F.map_entries(value), T.ArrayType(T.StructType(
            [T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)])))
    if isinstance(kind, T.StructType):
        total = F.lit(8)
        for f in kind.fields:
            total = total + F.coalesce(_value_bytes(value.getField(f.name), f.dataType), F.lit(0))
        return total
    return F.lit(_FIXED.get(type(kind), 8))


def row_bytes(df: DataFrame) -> Column:
    """Bytes of a row: fixed widths plus the lengths of its variable values."""
    total = F.lit(16).cast("long")
    for f in df.schema.fields:
        total = total + F.coalesce(_value_bytes(F.col("`" + f.name.replace("`", "``") + "`"), f.dataType), F.lit(0)) + 8
    return total


def fits(df: DataFrame, max_rows: int = DEFAULT_MAX_BROADCAST_ROWS,
         max_bytes: int = DEFAULT_MAX_BROADCAST_BYTES) -> bool:
    """True when ``df`` has at most ``max_rows`` rows of at most ``max_bytes`` in
    all. Sums over at most ``max_rows + 1`` rows, so the check stays cheap even
    if the side turns out to be huge; only its answer leaves the executors."""
    sums = df.select(row_bytes(df).alias("b")).limit(max_rows + 1).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("b"), F.lit(0)).alias("size"))
    return sums.where((F.col("n") <= max_rows) & (F.col("size") <= max_bytes)).count() == 1


def collect_if_within(df: DataFrame, weight, max_rows: int, max_weight: int):
    """Arrow table of ``df`` when it has at most ``max_rows`` rows and the
    summed ``weight`` column expression (tokens, vector values, ...) is at
    most ``max_weight``; otherwise None.

    The bound is proven before any row is fetched: first only the per-row
    weights come back, at most ``max_rows + 1`` integers (a ``limit``, no
    shuffle), so the driver never receives more than the limits."""
    import pyarrow.compute as pc
    sizes = df.select(weight.alias("w")).limit(max_rows + 1).toArrow()
    if sizes.num_rows > max_rows or (pc.sum(sizes.column("w")).as_py() or 0) > max_weight:
        return None
    return df.toArrow()


def maybe_broadcast(df: DataFrame, max_rows: int = DEFAULT_MAX_BROADCAST_ROWS,
                    max_bytes: int = DEFAULT_MAX_BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint only behind a check of rows and bytes; otherwise leave the
    join to the planner (shuffle hash / sort-merge, AQE skew splitting)."""
    return F.broadcast(df) if fits(df, max_rows, max_bytes) else df
