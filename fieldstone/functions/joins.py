"""Which side of a join may be broadcast: only one whose size has been looked at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldstone.session import checkpointed

# Largest side that is sent to every executor: in rows, and in bytes of its values.
BROADCAST_ROWS = 2_000_000
BROADCAST_BYTES = 64 * 1024 * 1024


def fits_broadcast(df: DataFrame) -> bool:
    """Is the whole frame small enough to broadcast? One job; two numbers reach the driver."""
    weights = [_weight(f) for f in df.schema]
    row = df.agg(F.count("*").alias("n"), *[F.sum(w).alias(f"b{i}") for i, w in enumerate(weights)]).first()
    return row["n"] <= BROADCAST_ROWS and sum(row[f"b{i}"] or 0 for i in range(len(weights))) <= BROADCAST_BYTES


def _weight(f: T.StructField) -> Column:
    """About how many bytes a value takes."""
    column = F.col(f"`{f.name}`")
    if isinstance(f.dataType, (T.StringType, T.BinaryType)):
        return F.octet_length(column).cast("bigint")
    if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.octet_length(F.to_json(F.struct(column))).cast("bigint")
    return F.lit(16).cast("bigint")


def written_side(df: DataFrame) -> DataFrame:
    """Write a frame once and mark it for broadcast if it fits; otherwise joins shuffle it."""
    df = checkpointed(df)
    return F.broadcast(df) if fits_broadcast(df) else df


def rows_without(rows: DataFrame, column: Column, keys: DataFrame, small: bool) -> DataFrame:
    """Rows whose non-null ``column`` is not among the keys (a frame of one unique column).

    ``small`` says that the rows fit a broadcast. Then the key table is filtered
    by them and never shuffled. Otherwise distinct values meet the keys, so a
    value that fills a third of the rows is shuffled once per task, and the rows
    themselves are only matched with the values that were not found.
    """
    rows = rows.where(column.isNotNull())
    keys = keys.select(F.col(f"`{keys.columns[0]}`").alias("__known"))
    values = rows.select(column.alias("__value")).distinct()
    matches = F.col("__known") == F.col("__value")
    if small:
        found = keys.join(F.broadcast(values), matches, "left_semi")
        return rows.join(F.broadcast(found), column == F.col("__known"), "left_anti")
    lost = written_side(values.join(keys, matches, "left_anti"))
    return rows.join(lost, column == F.col("__value"), "left_semi")
