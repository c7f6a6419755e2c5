"""Session helpers: settings that matter at scale, checkpoints and scratch tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Runtime settings the library relies on; a value the user has set stays.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot key even where the split costs one more exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # What arbitrary state of streams needs.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


# Scratch tables of this process, for drop_scratch.
_SCRATCH: list[str] = []


def tune(spark: SparkSession) -> SparkSession:
    """Apply the adaptive-execution settings that are not set explicitly."""
    if getattr(spark, "_fieldstone_tuned", False):
        return spark
    explicit = {key for key, _ in spark.sparkContext.getConf().getAll()}
    for key, value in _DEFAULTS.items():
        if key not in explicit:
            spark.conf.set(key, value)
    spark._fieldstone_tuned = True
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if folder:
        return folder
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="fieldstone-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it from there afterwards.

    Used where a plan holds a generator (uuid, salt, row number) that must not
    be evaluated twice. The files outlive any executor; being Parquet, later
    plans read only the columns they need and know the size. ``drop_scratch``
    removes them.
    """
    spark = df.sparkSession
    untyped = [f.name for f in df.schema if isinstance(f.dataType, T.NullType)]
    stored = df.drop(*untyped)
    path = scratch_path(spark, "scratch")
    stored.write.parquet(path)
    back = spark.read.schema(stored.schema).parquet(path)
    if not untyped:
        return back
    return back.select(*[F.lit(None).alias(c) if c in untyped else F.col(f"`{c}`") for c in df.columns])


def drop_scratch(spark: SparkSession) -> int:
    """Remove the scratch tables this process has written; frames that read them end with it."""
    gone = 0
    while _SCRATCH:
        path = spark._jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        gone += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return gone


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder for a table that a job writes."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


def local_frame(spark: SparkSession, rows: Iterable[tuple], schema: T.StructType | str) -> DataFrame:
    """A few rows from the driver. Unlike rows sent through an RDD their size is
    known to the optimizer, so joins with them are broadcast."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    rows = [_plain(tuple(r), schema) for r in rows]
    table = pa.Table.from_pylist(rows, schema=to_arrow_schema(schema))
    return spark.createDataFrame(table, schema)


def _plain(value, dtype: T.DataType):
    """Rows as the dicts that Arrow expects."""
    if value is None:
        return None
    if isinstance(dtype, T.StructType):
        return {f.name: _plain(v, f.dataType) for f, v in zip(dtype, value)}
    if isinstance(dtype, T.ArrayType):
        return [_plain(v, dtype.elementType) for v in value]
    if isinstance(dtype, T.MapType):
        return list(value.items())
    return value
