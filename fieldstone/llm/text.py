"""What the operators share: words, splits by id, tables written once, Arrow batches."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldstone.session import scratch_path

# Letters, digits and every byte of a non-ASCII character belong to words; A-Z are lowered.
_TERMS = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
#: The same words as a pattern for Spark: everything that separates them.
TERM_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_CLEANUP = "spark.sql.shuffleDependency.fileCleanup.enabled"
#: Batches of texts that Spark hands to Python end at four megabytes: each task of an executor holds one twice.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))  # fixed values of the splitmix64 finalizer


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: it is computed once, cuts the
    lineage, survives a lost executor, and the optimizer knows its size. Shuffle files of the job go when
    it ends, as nothing reads them again."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs that run within hand on small batches; a size that the application's configuration names stays."""
    before = spark.conf.get(BATCH[0])
    if not spark.sparkContext.getConf().contains(BATCH[0]):
        spark.conf.set(*BATCH)
    try:
        yield
    finally:
        spark.conf.set(BATCH[0], before)


def dropped(*tables: DataFrame) -> None:
    """Remove tables that ``written`` made and no later job reads."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def lower_ascii(column: Column) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text: bytes) -> list[bytes]:
    """Runs of letters, digits and non-ASCII characters, A-Z lowered."""
    return text.translate(_TERMS).split()


def fold(column: Column, parts: int) -> Column:
    """crc32 of an id as text, modulo ``parts``; -1 for a null id."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % parts, F.lit(-1)).cast("int")


def fold_of(value: object, parts: int) -> int:
    return zlib.crc32(str(value).encode()) % parts


def mix(x: np.ndarray) -> np.ndarray:
    """Spread uint64 values over all 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def per_text(
    docs: DataFrame,
    id_column: str,
    text_column: str,
    fn: Callable[[list[bytes]], list[pa.Array]],
    columns: str,
    most: int = 4 << 20,
) -> DataFrame:
    """Run ``fn`` over batches of texts (UTF-8 bytes, null as empty) next to their ids.

    ``columns`` is the DDL of what ``fn`` returns, one Arrow array per column. Other columns of
    ``docs`` are never read.
    """
    source = docs.select(
        F.col(f"`{id_column}`").alias("id"),
        F.coalesce(F.col(f"`{text_column}`").cast("binary"), F.lit(b"")).alias("text"),
    )
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, batch.column(1), most):
                out = fn(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *out], names=["id", *(f"c{i}" for i in range(len(out)))]
                )

    names = [f.name for f in _fields(columns)]
    plain = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(_fields(columns)))
    out = source.mapInArrow(run, f"id {kind}, {plain}")
    return out.select(F.col("id").alias(id_column), *[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])


def _fields(ddl: str):
    from pyspark.sql import types as T

    return T.StructType.fromDDL(ddl).fields


def slices(batch: pa.RecordBatch, texts: pa.Array, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``most`` bytes of text, one text at least."""
    sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]) if (
        len(texts) and texts.type == pa.binary()
    ) else np.array([len(t.as_py() or b"") for t in texts])
    ends = np.cumsum(sizes)
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop
