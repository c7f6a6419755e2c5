"""Row positions without a window over an unbounded group.

``number_rows`` range-partitions by (group, order), so one hot group spreads
over many tasks, and turns per-partition counts into offsets. ``ranked`` picks
the cheapest exact way for a per-group range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldstone.session import checkpointed

# Largest group that one window task may sort.
WINDOW_GROUP_ROWS = 1_000_000
# Spark prunes `row_number() <= k` before the shuffle up to this k.
GROUP_LIMIT_ROWS = 1_000
# Rows a single task may hold for a global limit.
GLOBAL_LIMIT_ROWS = 100_000

_LOCAL_BITS = 33  # monotonically_increasing_id: partition in the upper bits, row in the lower


def dense_ids(df: DataFrame, name: str, part_name: str | None = None) -> DataFrame:
    """Add 1-based dense numbers in the frame's own partition order, and that partition if named."""
    laid = checkpointed(df.withColumn("__mid", F.monotonically_increasing_id()))
    part = F.shiftright("__mid", _LOCAL_BITS)
    local = F.col("__mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    # One row per partition, so this window and the broadcast are bounded by
    # the number of partitions, not by the data.
    sizes = laid.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    numbered = (
        laid.withColumn("__part", part)
        .join(F.broadcast(offsets), "__part")
        .withColumn(name, (F.col("__base") + local + 1).cast("bigint"))
    )
    if part_name is not None:
        numbered = numbered.withColumn(part_name, F.col("__part"))
    return numbered.drop("__part", "__base", "__mid")


def number_rows(
    df: DataFrame, order: Sequence[Column], name: str, group: str | None = None, ties: bool = False
) -> DataFrame:
    """Add each row's 1-based position in ``order``, within ``group`` if given.

    With ``ties=True`` equal rows are told apart first, so that a pair that
    occurs very often still spreads over many partitions.
    """
    keys = ([F.col(group).asc()] if group else []) + list(order)
    if ties:
        df = checkpointed(df.withColumn("__tie", F.monotonically_increasing_id()))
        keys.append(F.col("__tie").asc())
    laid = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    numbered = dense_ids(laid.drop("__tie"), "__g", "__piece" if group else None)
    if group is None:
        return numbered.withColumnRenamed("__g", name)
    # A group's first number, once for each partition it lies in: a hot group is
    # joined piece by piece, and the window below sees one row for each piece.
    pieces = numbered.groupBy(F.col(group).alias("__grp"), F.col("__piece").alias("__in")).agg(F.min("__g").alias("__low"))
    firsts = pieces.select("__grp", "__in", F.min("__low").over(Window.partitionBy("__grp")).alias("__first"))
    return (
        numbered.join(firsts, F.col(group).eqNullSafe(F.col("__grp")) & (F.col("__piece") == F.col("__in")))
        .withColumn(name, F.col("__g") - F.col("__first") + 1)
        .drop("__g", "__first", "__grp", "__in", "__piece")
    )


def largest_group(df: DataFrame, group: str) -> int:
    """Row count of the largest group (map-side combined; one number reaches the driver)."""
    top = df.groupBy(group).agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()
    return top["n"] or 0


def ranked(
    df: DataFrame,
    group: str,
    order: Sequence[Column],
    name: str,
    offset: int = 0,
    limit: int | None = None,
    ties: bool = False,
    sizes: DataFrame | None = None,
    narrow: Sequence[str] | None = None,
) -> DataFrame:
    """Rows of each group at positions offset+1 .. offset+limit, with their position.

    ``sizes`` is a cheaper frame whose groups are at least as large; it tells
    whether one task may sort the largest of them. Where rows are numbered by
    writing them, only the columns ``narrow`` are: the group, what ``order``
    needs, and last a column that tells different rows of a group apart.
    """
    last = None if limit is None else offset + limit
    pruned = last is not None and last <= GROUP_LIMIT_ROWS
    if pruned or largest_group(df if sizes is None else sizes, group) <= WINDOW_GROUP_ROWS:
        out = df.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("bigint"))
    elif narrow is None:
        out = number_rows(df, order, name, group, ties)
    else:
        same = narrow[-1]
        keys = number_rows(df.select(*narrow), order, name, group, ties)
        keys = keys.select(F.col(group).alias("__grp"), F.col(same).alias("__same"), name)
        on = (F.col(group) == F.col("__grp")) & F.col(same).eqNullSafe(F.col("__same"))
        out = df.dropDuplicates([group, same]).join(keys, on).drop("__grp", "__same")
    if offset:
        out = out.where(F.col(name) > offset)
    if last is not None:
        out = out.where(F.col(name) <= last)
    return out
