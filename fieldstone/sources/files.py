"""Files of stored tables. A manifest names the files of a table with the rows and the range of keys in each,
so a change rewrites the files that hold its rows and a look-up opens the files that may hold its key.

A location is either the ``data`` folder of a table that was written whole, or the manifest of one that
shares files with earlier versions. What is gathered from a manifest grows with files, never with rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldstone.session import local_frame

DATA, FILES = "data", "_files"


@dataclass(frozen=True)
class Touch:
    """Rows whose ``columns`` equal a row of ``keys``, column by column."""

    columns: tuple[str, ...]
    keys: DataFrame


@dataclass(frozen=True)
class Edit:
    """What a table becomes, as a function of its rows. Rows that none of the ``touches`` meets stay as
    they are; ``adds`` says whether there are new ones."""

    apply: Callable[[DataFrame], DataFrame]
    touches: tuple[Touch, ...] = ()
    adds: bool = False


def edited(df: DataFrame, edits: Iterable[Edit]) -> DataFrame:
    return reduce(lambda rows, edit: edit.apply(rows), edits, df)


def folder_of(location: str) -> str:
    """The folder that a location's own files lie in."""
    return location.rpartition("/")[0]


def _file() -> Column:
    """The file that a row of a scan comes from, as a path that can be read."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))).alias("file")


def manifest(spark: SparkSession, location: str) -> DataFrame:
    """``file, rows, least, greatest`` of each file with rows."""
    return spark.read.parquet(f"{folder_of(location)}/{FILES}")


def frame_of(spark: SparkSession, location: str, files: Sequence[str] | None = None) -> DataFrame:
    """The table, or the part of it that lies in the given files."""
    if files is None and location.endswith(f"/{DATA}"):
        return spark.read.parquet(location)
    if files is None:
        files = [r["file"] for r in manifest(spark, location).select("file").collect()]
    if not files:
        return spark.read.parquet(f"{folder_of(location)}/{DATA}").where(F.lit(False))
    return spark.read.parquet(*files)


def files_with(spark: SparkSession, location: str, least: Column, greatest: Column | None = None) -> list[str]:
    """Files that may hold a key of the range."""
    inside = (F.col("least") <= (least if greatest is None else greatest)) & (F.col("greatest") >= least)
    return [r["file"] for r in manifest(spark, location).where(inside).select("file").collect()]


def files_holding(spark: SparkSession, location: str, keys: DataFrame) -> list[str]:
    """Files that may hold one of a few keys (a frame of one column)."""
    wanted = F.broadcast(keys.toDF("__key"))
    inside = (F.col("least") <= F.col("__key")) & (F.col("greatest") >= F.col("__key"))
    return [r["file"] for r in manifest(spark, location).join(wanted, inside, "left_semi").select("file").collect()]


def write_table(df: DataFrame, folder: str, key: str, file_rows: int | None = None, unique: Sequence[str] = ()) -> str:
    """Write a table in ranges of its key, in files of ``file_rows`` rows at most; returns its location."""
    _file_rows(df, folder, key, file_rows, unique).coalesce(1).write.parquet(f"{folder}/{FILES}")
    return f"{folder}/{DATA}"


def _file_rows(df: DataFrame, folder: str, key: str, file_rows: int | None, unique: Sequence[str]) -> DataFrame:
    """Write rows in the order of the key and look at what lies in each file."""
    # A bloom filter lets a look-up of a key, or of a unique value, skip row groups inside the range.
    options = {"parquet.bloom.filter.adaptive.enabled": "true"}
    options |= {f"parquet.bloom.filter.enabled#{c}": "true" for c in (key, *unique)}
    if file_rows:
        options["maxRecordsPerFile"] = str(file_rows)
    df.sort(F.col(f"`{key}`")).write.options(**options).parquet(f"{folder}/{DATA}")
    value = F.col(f"`{key}`")
    rows = df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{DATA}")
    return rows.groupBy(_file()).agg(
        F.count("*").alias("rows"), F.min(value).alias("least"), F.max(value).alias("greatest")
    )


def touched_files(spark: SparkSession, location: str, edits: Iterable[Edit], key: str) -> list[str]:
    """Files of a table that hold rows which the edits concern.

    Keys are first held against the ranges in the manifest; only columns that the touches compare are
    read. A row that an earlier edit changes is in a file that this edit touches, so looking at the stored
    rows is enough for all of them.
    """
    found = []
    for touch in (t for e in edits for t in e.touches):
        files = None
        if touch.columns[0] == key:
            name = F.col(f"`{touch.keys.columns[0]}`")
            ends = touch.keys.agg(F.min(name).alias("least"), F.max(name).alias("greatest")).first()
            if ends["least"] is None:
                continue
            files = files_with(spark, location, F.lit(ends["least"]), F.lit(ends["greatest"]))
            if not files:
                continue
        rows = frame_of(spark, location, files)
        rows = rows.select(*[F.col(f"`{c}`").alias(f"__t{i}") for i, c in enumerate(touch.columns)], _file())
        keys = touch.keys.toDF(*[f"__k{i}" for i in range(len(touch.columns))])
        same = reduce(lambda a, b: a & b, [F.col(f"__t{i}") == F.col(f"__k{i}") for i in range(len(touch.columns))])
        found.append(rows.join(keys, same, "left_semi").select("file"))
    if not found:
        return []
    return [r["file"] for r in reduce(DataFrame.union, found).distinct().collect()]


def rewrite(
    spark: SparkSession,
    location: str,
    edits: Sequence[Edit],
    folder: str,
    key: str,
    declared: Callable[[DataFrame], DataFrame],
    file_rows: int | None = None,
    unique: Sequence[str] = (),
) -> str:
    """Carry edits out on the files they touch and write the new rows; returns the location of a table that
    shares all other files with the old one. Nothing is written where nothing is touched or added."""
    touched = touched_files(spark, location, edits, key)
    if not touched and not any(e.adds for e in edits):
        return location
    fresh = _file_rows(edited(declared(frame_of(spark, location, touched)), edits), folder, key, file_rows, unique)
    old = manifest(spark, location)
    gone = F.broadcast(local_frame(spark, [(f,) for f in touched], "file string"))
    kept = old.join(gone, "file", "left_anti").select("file", "rows", "least", "greatest")
    kept.unionByName(fresh).coalesce(1).write.parquet(f"{folder}/{FILES}")
    return f"{folder}/{FILES}"


def files_apart(spark: SparkSession, one: str, other: str) -> tuple[list[str], list[str]]:
    """Files that only the one and only the other location refers to."""
    if one == other:
        return [], []
    a, b = (manifest(spark, x).select("file") for x in (one, other))
    return tuple([r["file"] for r in x.join(y, "file", "left_anti").collect()] for x, y in ((a, b), (b, a)))
