"""Approximate nearest neighbours by a hash-prefix forest: each tree is a sorted array of long hash
strings; a query descends to its longest prefixes and ascends in all trees at once until enough
candidates share its prefix in some tree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldstone.llm.text import written

BITS = 30  # length of the hash strings
TREES = 16
#: Candidates a query gathers over all trees before it stops to ascend; those of the last level all count.
CANDIDATES = 60_000
#: Vectors in a piece of a sorted array, about.
PIECE = 25_000


def planes(tree: int, dim: int, seed: int = 11) -> np.ndarray:
    """Orthogonal hyperplanes, as many at a time as there are dimensions."""
    rng = np.random.default_rng([seed, tree, dim])
    blocks = [np.linalg.qr(rng.normal(size=(dim, dim)))[0] for _ in range(-(-BITS // dim))]
    return np.concatenate(blocks, axis=1)[:, :BITS]


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``vec_id, vector`` (doubles) of rows with an id and a vector that isn't zero and has finite numbers only."""
    v = F.col(f"`{vector_column}`").cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    rows = vectors.select(F.col(f"`{id_column}`").cast("long").alias("vec_id"), v.alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull())
    rows = rows.where(~F.exists("vector", bad) & F.exists("vector", lambda x: x != 0))
    return rows.withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0)))  # -0.0 is 0.0


def _hashes(points: DataFrame, trees: int, scale: dict[int, float]) -> DataFrame:
    """``dim, tree, code`` of every vector. A stored vector gets one more coordinate that makes all as long
    as the longest, so that the largest inner product is the smallest angle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            frame = batch.to_pandas()
            for dim, part in frame.groupby(frame["vector"].str.len()):
                x = np.array(part["vector"].tolist(), float)
                rest = np.sqrt(np.maximum(scale[dim] - (x * x).sum(1), 0))
                stored, asked = np.column_stack([x, rest]), np.column_stack([x, np.zeros(len(x))])
                for tree in range(trees):
                    h = known.setdefault((tree, dim), planes(tree, dim + 1))
                    weight = 1 << np.arange(BITS - 1, -1, -1)
                    yield pa.RecordBatch.from_pandas(
                        pd.DataFrame({"point": part["point"], "dim": dim, "tree": tree, "code": ((stored @ h) > 0) @ weight,
                                      "asked": ((asked @ h) > 0) @ weight}).astype("int64"),
                        preserve_index=False,
                    )

    return points.select("point", "vector").mapInArrow(run, "point long, dim long, tree long, code long, asked long")


def search(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    trees: int = TREES,
    candidates: int = CANDIDATES,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """The ``k`` nearest found of each row where ``is_query`` (over ``vec_id``) holds, among all other rows:
    ``query_id, rank, vec_id, score`` by largest inner product in double precision, ties to the smaller id.

    Equal vectors are indexed once and counted out again at the end. The arrays are cut into pieces at
    quantiles of their codes. A query first counts, level by level, who shares its prefix in its own piece of
    each tree; the level at which the trees together hold ``candidates`` is where it stops, and all that share
    that prefix in any tree are scored, in every piece they lie in.

    Rows without an id or a usable vector take no part, neither do rows of other lengths than the query's;
    of rows that share an id and a vector one counts, and an id with several vectors has each; other columns
    are not read. Fewer than ``k`` rows come back where there are fewer others.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_column, vector_column).distinct()
    # A vector's smallest ids are all that its copies can add to a result: k, and one more for the query itself.
    own = W.partitionBy("vector").orderBy("vec_id")
    points = rows.groupBy("vector").agg(F.min("vec_id").alias("first"))
    points = written(points.withColumn("point", F.xxhash64("vector", "first")), "points")
    named = rows.withColumn("place", F.row_number().over(own)).where(F.col("place") <= k + 1)
    members = named.join(points, "vector").select("point", "vec_id")
    asking = rows.where(is_query).join(points, "vector").select("point", "vec_id")
    members, asking = written(members, "members"), written(asking, "asking")
    longest = points.groupBy(F.size("vector").alias("dim")).agg(
        F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)).alias("most"), F.count("*").alias("n")
    ).collect()  # one row for each length of vectors
    empty = "query_id long, rank int, vec_id long, score double"
    if not longest:
        return spark.createDataFrame([], empty)
    codes = written(_hashes(points, trees, {r["dim"]: r["most"] for r in longest}), "codes")
    cuts = codes.groupBy("dim", "tree").agg(
        F.percentile_approx("code", [i / 256 for i in range(1, 256)], 4096).alias("at"), F.count("*").alias("n")
    ).collect()  # 255 numbers for each tree
    bounds = {}
    for r in cuts:
        step = max(1, round(256 * PIECE / max(1, r["n"])))
        bounds[r["dim"], r["tree"]] = np.unique(np.array(r["at"], np.int64)[step - 1 :: step])
    edges = spark.sparkContext.broadcast(bounds)

    @F.pandas_udf("long")
    def piece(dim: pd.Series, tree: pd.Series, code: pd.Series) -> pd.Series:
        out = np.zeros(len(code), np.int64)
        for (d, t), at in code.groupby([dim, tree]).groups.items():
            out[code.index.get_indexer(at)] = np.searchsorted(edges.value[d, t], code.loc[at].to_numpy(), "right")
        return pd.Series(out)

    placed = codes.withColumn("piece", piece("dim", "tree", "code"))
    seekers = codes.join(asking.select("point").distinct(), "point", "left_semi").drop("code").withColumnRenamed("asked", "code")
    seekers = seekers.toDF(*[f"q_{c}" for c in seekers.columns]).withColumnsRenamed({"q_point": "point", "q_code": "code"})
    at_home = seekers.withColumn("q_piece", piece("q_dim", "q_tree", "code"))

    def count_levels(key: tuple, stored: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        """For each query and level the number of codes of the piece that share its prefix."""
        array, code = np.sort(stored["code"].to_numpy()), asked["code"].to_numpy()
        out = np.empty((len(code), BITS + 1), np.int64)
        for level in range(BITS + 1):
            low = (code >> (BITS - level)) << (BITS - level)
            out[:, level] = np.searchsorted(array, low + (1 << (BITS - level))) - np.searchsorted(array, low)
        return pd.DataFrame({"point": asked["point"].to_numpy(), "shared": list(out)})

    same, theirs = ["dim", "tree", "piece"], ["q_dim", "q_tree", "q_piece"]
    light = placed.select(*same, "code")
    counted = light.groupBy(*same).cogroup(at_home.groupBy(*theirs)).applyInPandas(count_levels, "point long, shared array<long>")
    totals = counted.groupBy("point").agg(
        F.array(*[F.sum(F.col("shared")[level]) for level in range(BITS + 1)]).alias("shared")
    )
    # The deepest level that holds enough; at the top every vector shares the empty prefix.
    deep = F.array_max(F.transform("shared", lambda n, i: F.when(n >= candidates, i).otherwise(0)))
    levels = written(totals.select("point", deep.alias("level")), "levels")

    @F.pandas_udf("array<long>")
    def pieces(dim: pd.Series, tree: pd.Series, low: pd.Series, high: pd.Series) -> pd.Series:
        return pd.Series(
            [
                list(range(int(np.searchsorted(edges.value[d, t], a, "right")), int(np.searchsorted(edges.value[d, t], b - 1, "right")) + 1))
                for d, t, a, b in zip(dim, tree, low, high, strict=True)
            ]
        )

    # The root holds everything, so one tree is enough there.
    ranged = seekers.join(levels, "point").where("level > 0 or q_tree = 0")
    low = F.expr(f"shiftleft(shiftright(code, {BITS} - level), {BITS} - level)")
    ranged = ranged.withColumn("low", low).withColumn("high", F.col("low") + F.expr(f"shiftleft(1L, {BITS} - level)"))
    ranged = ranged.withColumn("q_piece", F.explode(pieces("q_dim", "q_tree", "low", "high")))
    held = points.select("point", "vector")
    array_side = placed.select(*same, "code", "point").join(points.select("point", "vector", "first"), "point")
    asked_for = held.select(F.col("point").alias("q_point"), F.col("vector").alias("q_vector"))
    query_side = ranged.select(*theirs, "low", "high", F.col("point").alias("q_point")).join(asked_for, "q_point")
    wanted = k + 1

    def score(key: tuple, stored: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        """The best of each query among the codes of the piece in its range."""
        stored = stored.sort_values("code", kind="stable")
        array, ids, least = (stored[c].to_numpy() for c in ("code", "point", "first"))
        x = np.array(stored["vector"].tolist(), float)
        first = np.searchsorted(array, asked["low"].to_numpy())
        last = np.searchsorted(array, asked["high"].to_numpy())
        vectors_, names = np.array(asked["q_vector"].tolist(), float), asked["q_point"].to_numpy()
        longest = np.sqrt((x * x).sum(1).max(initial=0))
        out: list[pd.DataFrame] = []
        for (a, b), at in pd.DataFrame({"a": first, "b": last}).groupby(["a", "b"]).groups.items():
            if a == b:
                continue
            for part in np.array_split(np.asarray(at), -(-len(at) * (b - a) // 4_000_000)):
                q = vectors_[part]
                near = q @ x[a:b].T
                n = min(wanted, b - a)
                # All that may tie with the last one kept: sums round differently.
                cut = np.partition(near, b - a - n, axis=1)[:, b - a - n] - 1e-12 * longest * np.sqrt((q * q).sum(1))
                row, col = np.nonzero(near >= cut[:, None])
                exact = np.concatenate([(x[a + c] * q[r]).sum(1) for r, c in zip(*(np.array_split(i, -(-len(row) // 100_000)) for i in (row, col)))])
                order = np.lexsort((least[a + col], -exact, row))
                row, col, exact = row[order], col[order], exact[order]
                kept = np.arange(len(row)) - np.searchsorted(row, row) < wanted
                out.append(pd.DataFrame({"point": names[part][row[kept]], "near": ids[a + col[kept]], "score": exact[kept]}))
        return pd.concat(out) if out else pd.DataFrame({"point": [], "near": [], "score": []})

    found = array_side.groupBy(*same).cogroup(query_side.groupBy(*theirs)).applyInPandas(score, "point long, near long, score double")
    best = found.groupBy("point", "near").agg(F.max("score").alias("score"))
    # k + 1 classes of vectors hold k candidates at least, whatever their ids.
    ranked = best.withColumn("at", F.rank().over(W.partitionBy("point").orderBy(F.desc("score")))).where(F.col("at") <= wanted)
    near = ranked.join(members.withColumnRenamed("point", "near"), "near").select("point", "vec_id", "score")
    pairs = asking.select("point", F.col("vec_id").alias("query_id")).join(near, "point").where("query_id != vec_id")
    pairs = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    final = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
