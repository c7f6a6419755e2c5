"""Tables derived from stored ones and kept with their versions: sort orders, and counts of list elements.

A derived table is made from the files of one version. Later versions read it together with the files that
have come and gone since then, so a change of the base costs it nothing; once these files hold too large a
share of the rows, publishing makes it anew.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldstone.functions.numbering import number_rows
from fieldstone.sources.files import files_apart, files_with, frame_of, manifest, write_table

if TYPE_CHECKING:
    from fieldstone.sources.store import Store

#: Share of the base's rows in files that came or went above which a derived table is made anew.
REMAKE = 0.1
ORDER, COUNT = "order", "count"


@dataclass(frozen=True)
class Derived:
    """Where a derived table lies, and what it was made from."""

    location: str
    base: str


@dataclass(frozen=True)
class Since:
    """Rows of the base in files that have gone, and in files that have come, since a derived table was made."""

    gone: DataFrame
    came: DataFrame
    rows: int


def order_name(model: str, field: str, direction: str) -> str:
    return f"{model}/{ORDER}/{field}/{direction}"


def count_name(model: str, field: str) -> str:
    return f"{model}.{field}/{COUNT}"


def base_name(name: str) -> str:
    return name.partition("/")[0]


def sort_keys(direction: str, value: str = "value", key: str = "key") -> list[Column]:
    """Nulls last ascending and first descending; ties by the key."""
    by = F.col(value).asc_nulls_last() if direction == "ASCENDING" else F.col(value).desc_nulls_first()
    return [by, F.col(key).asc()]


def make(store: Store, name: str, location: str, folder: str) -> Derived:
    """Write a derived table of the base table at the location."""
    base, kind, *rest = name.split("/")
    rows = frame_of(store.spark, location)
    if kind == COUNT:
        df, key = rows.groupBy("source").agg(F.count("*").alias("length")), "source"
    else:
        field, direction = rest
        pairs = rows.select(F.col(f"`{field}`").alias("value"), F.col(f"`{store.catalog.model(base).pk}`").alias("key"))
        df, key = number_rows(pairs, sort_keys(direction), "no"), "no"
    return Derived(write_table(df, folder, key, store.file_rows), location)


def since(store: Store, derived: Derived, location: str) -> Since:
    gone, came = files_apart(store.spark, derived.base, location)
    rows = 0
    for place, files in ((derived.base, gone), (location, came)):
        if files:
            rows += manifest(store.spark, place).where(F.col("file").isin(files)).agg(F.sum("rows").alias("n")).first()["n"]
    return Since(frame_of(store.spark, derived.base, gone), frame_of(store.spark, location, came), rows)


def outgrown(store: Store, derived: Derived, location: str) -> bool:
    """Do the files that came and went hold too much for a derived table to be read with them?"""
    if derived.base == location:
        return False
    total = manifest(store.spark, location).agg(F.sum("rows").alias("n")).first()["n"] or 0
    return since(store, derived, location).rows > REMAKE * total


# -- counts ------------------------------------------------------------------


def element_counts(store: Store, model: str, field: str) -> DataFrame | None:
    """``source, length`` of an array's links, read from the kept counts; None where there are none."""
    derived = store.derived.get(count_name(model, field))
    location = store.locations.get(f"{model}.{field}")
    if derived is None or location is None:
        return None
    counts = frame_of(store.spark, derived.location).select("source", "length")
    if derived.base == location:
        return counts
    change = since(store, derived, location)
    added = change.came.select("source", F.lit(1).alias("d")).unionByName(change.gone.select("source", F.lit(-1).alias("d")))
    more = added.groupBy("source").agg(F.sum("d").alias("length"))
    summed = counts.unionByName(more.where("length <> 0")).groupBy("source").agg(F.sum("length").alias("length"))
    return summed.where("length > 0")


# -- orders ------------------------------------------------------------------


def _before(value: Column, key: Column, than: tuple, direction: str) -> Column:
    """Does (value, key) stand before a row, given as values, in the order?"""
    v, k = than
    tie = key < F.lit(k)
    if direction == "ASCENDING":
        if v is None:
            return value.isNotNull() | tie
        return F.coalesce((value < F.lit(v)) | ((value == F.lit(v)) & tie), F.lit(False))
    if v is None:
        return value.isNull() & tie
    return F.coalesce((value > F.lit(v)) | ((value == F.lit(v)) & tie), F.lit(True))


def ordered_page(store: Store, model: str, field: str, direction: str, offset: int, limit: int | None) -> DataFrame | None:
    """``key, row`` of the records at places offset + 1 to offset + limit of a kept order; None without one.

    Rows of the order lie under their numbers, so only the files with these numbers are opened. If the base
    has changed by some rows since, the page cannot have moved by more: that many rows around it are read,
    with the changed ones, and the changed rows before them are counted.
    """
    derived = store.derived.get(order_name(model, field, direction))
    location = store.locations.get(model)
    if derived is None or location is None:
        return None
    end = manifest(store.spark, derived.location).agg(F.sum("rows").alias("n")).first()["n"] or 0

    def numbered(low: int, high: int) -> DataFrame:
        files = files_with(store.spark, derived.location, F.lit(low), F.lit(high))
        return frame_of(store.spark, derived.location, files).where(F.col("no").between(low, high))

    last = end if limit is None else offset + limit
    if derived.base == location:
        return numbered(offset + 1, last).select("key", F.col("no").alias("row"))
    change, pk = since(store, derived, location), store.catalog.model(model).pk
    pair = [F.col(f"`{field}`").alias("value"), F.col(f"`{pk}`").alias("key")]
    gone, came = change.gone.select(*pair), change.came.select(*pair)
    low = max(1, offset + 1 - change.rows)
    if low > end:
        return _whole(store, model, field, direction, offset, limit)
    high = end if limit is None else min(end, last + change.rows + 1)
    value, key = F.col("value"), F.col("key")
    start, new = 0, came
    edges = {r["no"]: (r["value"], r["key"]) for r in numbered(low, low).unionByName(numbered(high, high)).collect()}
    if low > 1:
        ahead = _before(value, key, edges[low], direction)
        start = low - 1 + came.where(ahead).count() - gone.where(ahead).count()
        new = new.where(~ahead)
    if high < end:
        new = new.where(_before(value, key, edges[high], direction))
    rows = numbered(low, high if high == end else high - 1).select("value", "key").join(gone.select("key"), "key", "left_anti")
    rows = number_rows(rows.select("value", "key").unionByName(new), sort_keys(direction), "row")
    row = F.col("row") + F.lit(start)
    kept = rows.select("key", row.alias("row")).where(F.col("row") > offset)
    return kept if limit is None else kept.where(F.col("row") <= offset + limit)


def _whole(store: Store, model: str, field: str, direction: str, offset: int, limit: int | None) -> DataFrame:
    """A page that begins behind the end of the kept order."""
    pairs = store.scan(model, [store.catalog.model(model).pk, field]).toDF("key", "value").select("value", "key")
    rows = number_rows(pairs, sort_keys(direction), "row").select("key", "row").where(F.col("row") > offset)
    return rows if limit is None else rows.where(F.col("row") <= offset + limit)
