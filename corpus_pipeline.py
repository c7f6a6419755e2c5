"""A corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. Rows with a
null id or text pass the filters; a stage without input gives no rows; extra columns stay.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldstone.llm.decontaminate import find_leaks
from fieldstone.llm.line_dedup import dedup_lines
from fieldstone.llm.ngram_join import near_components
from fieldstone.llm.packing import pack
from fieldstone.llm.queries import VOCABULARY
from fieldstone.llm.text import BATCH, table, written
from fieldstone.llm.toxicity import toxic_column, train_toxicity


def in_small_batches(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A stage whose session hands on small batches, also when its caller writes the frame later; a size
    that the application's configuration names stays."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if not spark.sparkContext.getConf().contains(BATCH[0]):
            spark.conf.set(*BATCH)
        return stage(spark, docs, sf_dir)

    return run


@in_small_batches
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below a half."""
    model = train_toxicity(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxic_column(model, F.col("text")) < 0.5)


@in_small_batches
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the blocks that an earlier one has; those of which no word is left go."""
    kept = dedup_lines(docs)
    kept = kept.where((F.col("removed_words") == 0) | F.col("text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        length = F.when(F.col("removed_words") > 0, F.char_length("text")).otherwise(F.col("n_chars"))
        kept = kept.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


@in_small_batches
def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (80 % of their shingles of five words in common), the
    one of the smallest id; of rows that repeat both that id and the text, one."""
    grouped = written(near_components(docs, size=5, percent=80), "groups").where("doc_id is not null")
    fate = grouped.groupBy("doc_id").agg(F.bool_or(F.col("component_id") != F.col("doc_id")).alias("goes"), (F.count("*") > 1).alias("again"))
    fate = written(fate.where("goes or again"), "fate")
    # A sort-merge join at every size moves the texts once, so that disk and time grow evenly.
    kept = docs.join(fate.hint("merge"), docs["doc_id"] == fate["doc_id"], "left").where(~F.coalesce(fate["goes"], F.lit(False)))
    if fate.where("again and not goes").isEmpty():
        return kept.select(*[docs[c] for c in docs.columns])
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    kept = written(kept.select(row, F.coalesce(fate["again"], F.lit(False)).alias("again")), "kept")
    once, more = (kept.where(again).select("row.*") for again in ("not again", "again"))
    return once.unionByName(more.dropDuplicates(["doc_id", "text"]))


@in_small_batches
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs."""
    _, matches, _ = find_leaks(docs, table(spark, sf_dir, "benchmark"))
    leaked = written(matches.select("mark").distinct(), "leaked")
    mark = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    return docs.join(leaked, mark == leaked["mark"], "left_anti").select(*docs.columns)


@in_small_batches
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences."""
    return pack(docs, VOCABULARY)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("ngram_join", ngram_join),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: A trained classifier decides in the first stage, which SQL can't express; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    before = spark.conf.get(BATCH[0])
    spark.conf.set(*BATCH)
    try:
        for name, stage in STAGES:
            docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    finally:
        spark.conf.set(BATCH[0], before)
    return docs
