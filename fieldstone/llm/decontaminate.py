"""Benchmark decontamination by winnowing, with DataFrame functions only.

Of every few neighbouring k-grams of words the one with the smallest hash is a fingerprint, on both
sides alike, so a shared stretch of ``span`` words shares a fingerprint for certain. Shared fingerprints
name the texts and places to look at; there the match is extended word by word to its full length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldstone.llm.text import TERM_GAP, lower_ascii, written


def term_array(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), TERM_GAP), "")


def _pairs(values: Column, shift: int, join) -> Column:
    """``join`` of every element with the one ``shift`` places on."""
    size = F.greatest(F.size(values) - shift, F.lit(0))
    return F.zip_with(F.slice(values, F.lit(1), size), F.slice(values, F.lit(shift + 1), size), join)


def _window(df: DataFrame, column: str, size: int, join) -> tuple[DataFrame, str]:
    """A column with ``join`` over each ``size`` neighbours, by doubling; the joined ranges may overlap."""
    span = 1
    while span < size:
        shift = min(span, size - span)
        name = f"{column}_{span + shift}"
        if name not in df.columns:
            df = df.withColumn(name, _pairs(F.col(column if span == 1 else f"{column}_{span}"), shift, join))
        span += shift
    return df, column if size == 1 else f"{column}_{size}"


def _hash(a: Column, b: Column) -> Column:
    return F.xxhash64(a, b)


def _salted(n: int):
    return lambda x: F.xxhash64(x, F.lit(n))


def with_grams(df: DataFrame, k: int, short: list[int]) -> DataFrame:
    """``h`` (hash of each word), ``grams`` (of each k-gram) and ``short_n`` for the given lengths."""
    df = df.withColumn("h", F.transform("terms", lambda w: F.xxhash64(w)))
    df, name = _window(df, "h", k, _hash)
    df = df.withColumn("grams", F.col(name))
    for n in short:
        df, name = _window(df, "h", n, _hash)
        df = df.withColumn(f"short_{n}", F.transform(name, _salted(n)))
    return df


def with_prints(df: DataFrame, width: int, short: list[int]) -> DataFrame:
    """``prints``: the least hash of each ``width`` neighbouring k-grams, and every short gram."""
    df, name = _window(df, "grams", width, lambda a, b: F.least(a, b))
    return df.withColumn("prints", F.array_distinct(F.concat(F.col(name), *[F.col(f"short_{n}") for n in short])))


def benchmark_items(benchmark: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``item_id, item, terms`` of every item with an id and words; items of equal words share ``item``."""
    rows = benchmark.select(F.col(f"`{id_column}`").alias("item_id"), term_array(F.col(f"`{text_column}`")).alias("terms"))
    rows = rows.where(F.col("item_id").isNotNull() & (F.size("terms") > 0))
    return rows.withColumn("item", F.md5(F.array_join("terms", " ").cast("binary")))


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    span: int = 10,
    k: int = 5,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_id_column: str = "item_id",
    item_text_column: str = "text",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Where benchmark items occur: three tables over ``mark`` (of a text) and ``item``.

    ``texts`` (one row for each row of ``docs``: id, mark, ``n_words``), ``matches`` (mark, item, ``start``
    and ``length`` in words: every place where ``span`` consecutive words of the item stand, or the whole
    of a shorter item) and ``items`` (item_id, item). Equal texts have one mark and are searched once.

    A null text has no words; a null id stays null; repeated rows stay; benchmark rows without an id or
    words match nothing; an empty benchmark leaves ``matches`` empty; other columns are not read.
    """
    width = span - k + 1
    items = written(benchmark_items(benchmark, item_id_column, item_text_column), "items")
    classes = items.select("item", "terms").dropDuplicates(["item"])
    sizes = classes.where(F.size("terms") < span).select(F.size("terms").alias("n")).distinct()
    short = sorted(r["n"] for r in sizes.collect())  # lengths below ``span``: fewer than ``span`` numbers
    classes = with_prints(with_grams(classes, k, short), width, short)
    long = F.size("terms") >= span
    anchor = F.filter(
        F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("at"))), lambda s: F.array_contains("prints", s["g"])
    )
    whole = [F.when(F.size("terms") == n, F.element_at(f"short_{n}", 1)) for n in short]
    whole = F.array(F.struct(F.coalesce(*whole, F.lit(0)).alias("g"), F.lit(0).alias("at")))
    anchors = classes.select("item", "terms", F.explode(F.when(long, anchor).otherwise(whole)).alias("a"))
    anchors = written(anchors.select("item", "terms", F.col("a.g").alias("g"), F.col("a.at").alias("at")), "anchors")

    source = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").alias("text"))
    source = source.withColumn("mark", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    printed = source.select("id", "mark", term_array(F.col("text")).alias("terms"))
    printed = with_prints(with_grams(printed, k, short), width, short)
    printed = written(printed.select("id", "mark", F.size("terms").cast("long").alias("n_words"), "prints"), "prints")
    suspects = printed.select("mark", F.explode("prints").alias("g")).join(anchors.select("g").distinct(), "g", "left_semi")
    suspects = written(suspects.select("mark").distinct(), "suspects")

    texts = source.select("mark", "text").join(suspects, "mark", "left_semi").dropDuplicates(["mark"])
    texts = with_grams(texts.select("mark", term_array(F.col("text")).alias("terms")), k, short)
    texts = written(texts.select("mark", "terms", "grams", *[f"short_{n}" for n in short]), "texts")
    seeds = None
    for name in ["grams", *[f"short_{n}" for n in short]]:
        part = texts.select("mark", F.posexplode(name).alias("place", "g"))
        seeds = part if seeds is None else seeds.union(part)
    seeds = seeds.join(anchors.select("g", "item", "at"), "g")
    seeds = seeds.select("mark", "item", (F.col("place") - F.col("at")).alias("shift")).distinct()

    # Extend: compare the item with the text along the shift, and keep runs of equal words.
    pairs = seeds.join(texts.select("mark", F.col("terms").alias("words")), "mark")
    pairs = pairs.join(classes.select("item", "terms"), "item")
    need = F.least(F.lit(span), F.size("terms"))
    first = F.greatest(F.lit(0), -F.col("shift"))
    size = F.least(F.size("terms"), F.size("words") - F.col("shift")) - first
    pairs = pairs.select("mark", "item", "shift", "terms", "words", need.alias("need"), first.alias("first"), size.alias("size"))
    pairs = pairs.where(F.col("size") >= F.col("need"))
    equal = F.zip_with(
        F.slice("terms", F.col("first") + 1, F.col("size")),
        F.slice("words", F.col("first") + F.col("shift") + 1, F.col("size")),
        lambda a, b: a == b,
    )
    pairs = pairs.select("mark", "item", (F.col("first") + F.col("shift")).alias("begin"), "need", equal.alias("same"))
    # Length of the run of equal words that ends at each place.
    grown = F.aggregate(
        "same", F.array(F.lit(0)), lambda acc, same: F.concat(acc, F.array(F.when(same, F.element_at(acc, -1) + 1).otherwise(0)))
    )
    ends = pairs.select("mark", "item", "begin", "need", F.posexplode(grown).alias("end", "run"))
    found = ends.where((F.col("run") >= F.col("need")) & (F.col("end") > 0)).select(
        "mark", "item", (F.col("begin") + F.col("end") - F.col("need")).cast("long").alias("start"), F.col("need").cast("long").alias("length")
    )
    matches = written(found.distinct(), "matches")
    return printed.select("id", "mark", "n_words"), matches, items.select("item_id", "item")


def leak_report(texts: DataFrame, matches: DataFrame, items: DataFrame) -> DataFrame:
    """Per row of ``docs``: ``n_words``, ``n_hit`` (words inside a match), ``n_items``, ``items_sha256`` of the
    sorted item ids, ``contaminated``."""
    own = W.partitionBy("mark").orderBy("start")
    reached = F.max(F.col("start") + F.col("length")).over(own.rowsBetween(W.unboundedPreceding, -1))
    spans = matches.groupBy("mark", "start").agg(F.max("length").alias("length"))
    fresh = F.col("start") + F.col("length") - F.greatest("start", F.coalesce(reached, F.lit(0)))
    hit = spans.withColumn("fresh", F.greatest(fresh, F.lit(0))).groupBy("mark").agg(F.sum("fresh").alias("n_hit"))
    named = matches.select("mark", "item").distinct().join(items, "item").select("mark", F.col("item_id").cast("string").alias("i")).distinct()
    listed = named.groupBy("mark").agg(F.array_sort(F.collect_list("i")).alias("ids"))
    found = written(hit.join(listed, "mark"), "leaks")
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return texts.join(found, "mark", "left").select(
        F.col("id").alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
