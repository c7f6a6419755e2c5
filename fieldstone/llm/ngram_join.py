"""N-gram Jaccard join by vertical partitioning: the global order of shingles is cut into fragments,
overlaps are counted in each fragment apart and summed per pair. Sketches of a few bits a shingle tell
most pairs that cannot link, so only sets of the others are moved."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldstone.llm.graph import components
from fieldstone.llm.hashing import shingle_sets
from fieldstone.llm.text import dropped, per_text, slices, written

FRAGMENTS = 8
CELLS = 1 << 22  # cells of the table that tells frequent shingles from others: four megabytes
MARKS = 1 << 25  # bits of a table that tells rows of some nodes from others: four megabytes
SKETCH = 1 << 20  # bits of a sketch at most: 128 kilobytes
_FLUSH = 3_000_000
_SLICE = 1 << 20  # bytes of text whose shingles a task makes at once


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def node_of(shingles: np.ndarray) -> int:
    """A 64-bit signature of a set; equal sets are one node."""
    if not len(shingles):
        return 0
    total = np.uint64(0)
    with np.errstate(over="ignore"):
        total = shingles.sum(dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.bitwise_xor.reduce(shingles)
        total += np.uint64(len(shingles)) * np.uint64(0xD1342543DE82EF95)
    return int(_signed(np.array([total]))[0])


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    values = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def document_nodes(docs: DataFrame, size: int, id_column: str, text_column: str) -> DataFrame:
    """``id, n_shingles, node`` of every row; the node of an empty set is null."""

    def run(texts: list[bytes]) -> list[pa.Array]:
        sets = shingle_sets(texts, size)
        return [
            pa.array([len(s) for s in sets], pa.int64()),
            pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()),
        ]

    return per_text(docs, id_column, text_column, run, "n_shingles long, node long", _SLICE).withColumnRenamed(id_column, "id")


def frequency_levels(docs: DataFrame, size: int, text_column: str) -> np.ndarray:
    """How frequent shingles are, as powers of two, in a table of fixed size that hashes index.

    Tasks count the shingles of their different sets and hand on those seen more than once, so the many
    that occur once leave no trace. The table only orders shingles: where two share a cell, or a
    frequent one goes unseen, the join does more work and loses nothing.
    """
    source = docs.select(F.col(f"`{text_column}`").cast("binary").alias("t")).where(F.col("t").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        waiting: list[np.ndarray] = []
        size_now = 0

        def counted() -> pa.RecordBatch:
            found = np.concatenate(waiting)
            waiting.clear()
            found.sort()
            edge = np.diff((found[1:] == found[:-1]).view(np.int8), prepend=np.int8(0), append=np.int8(0))
            first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)  # of those seen more than once
            cell = (found[first] >> np.uint64(42)).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(cell), pa.array(last - first + 1)], names=["cell", "n"])

        for part in (p for batch in batches for p in slices(batch, batch.column(0), _SLICE)):
            for s in shingle_sets(part.column(0).to_pylist(), size):
                node = node_of(s)
                if node not in seen:
                    seen.add(node)
                    waiting.append(s)
                    size_now += len(s)
            if size_now > _FLUSH:
                yield counted()
                size_now = 0
        if waiting:
            yield counted()

    counts = source.mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.max("n").alias("m"), F.sum("n").alias("n"))
    table = counts.select("cell", F.least(F.log2("n"), F.lit(255.0)).cast("int").alias("level")).toArrow()  # CELLS rows at most
    levels = np.zeros(CELLS, np.uint8)
    levels[table["cell"].to_numpy()] = table["level"].to_numpy()
    return levels


def prefixes(docs: DataFrame, levels: np.ndarray, size: int, percent: int, text_column: str) -> DataFrame:
    """``token, node, n, at``: the first shingles of each set in the global order (rare ones first), as
    many as two sets that link cannot both lack, and their places. Copies within a task are left out once seen."""
    order = docs.sparkSession.sparkContext.broadcast(levels)
    source = docs.select(F.col(f"`{text_column}`").cast("binary").alias("t")).where(F.col("t").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        level = order.value
        for part in (p for batch in batches for p in slices(batch, batch.column(0), _SLICE)):
            tokens, nodes, sizes = [], [], []
            for s in shingle_sets(part.column(0).to_pylist(), size):
                node = node_of(s)
                if len(s) and node not in seen:
                    seen.add(node)
                    take = len(s) - (percent * len(s) + 99) // 100 + 1
                    tokens.append(s[np.argsort(level[s >> np.uint64(42)], kind="stable")[:take]])
                    nodes.append(node)
                    sizes.append(len(s))
            if tokens:
                reps = [len(t) for t in tokens]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(_signed(np.concatenate(tokens))),
                        pa.array(np.repeat(np.array(nodes, np.int64), reps)),
                        pa.array(np.repeat(np.array(sizes, np.int32), reps)),
                        pa.array(np.concatenate([np.arange(r, dtype=np.int32) for r in reps])),
                    ],
                    names=["token", "node", "n", "at"],
                )

    return source.mapInArrow(run, "token long, node long, n int, at int")


def marks_of(rows: DataFrame, column: F.Column) -> np.ndarray:
    """A table of MARKS bits, set where a value of the column falls; four megabytes whatever the rows."""
    cell = column.bitwiseAND(F.lit(MARKS - 1))
    bits = rows.select(F.shiftright(cell, 6).cast("int").alias("w"), cell.bitwiseAND(F.lit(63)).cast("int").alias("b"))
    found = bits.groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("bits")).toArrow()
    out = np.zeros(MARKS >> 6, np.uint64)
    out[found["w"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def is_marked(marks: np.ndarray, values: np.ndarray) -> np.ndarray:
    cell = values & (MARKS - 1)
    return (marks[cell >> 6] >> (cell & 63).astype(np.uint64)) & np.uint64(1) > 0


def fragment_of(levels: np.ndarray, shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The fragment of each shingle: the global order (level, then value) is cut where the cells of the
    table of levels divide into FRAGMENTS equal parts."""
    level = levels[shingles >> np.uint64(42)]
    place = starts[level] + (starts[level.astype(np.int64) + 1] - starts[level]) * (shingles / 2.0**64)
    return np.minimum(place * FRAGMENTS / CELLS, FRAGMENTS - 1).astype(np.int32)


def sets_of(docs: DataFrame, chosen: DataFrame, size: int, id_column: str, text_column: str) -> tuple[DataFrame, Callable]:
    """The rows of ``docs``, and a function that makes the sets of the nodes in ``chosen`` (node, key) from batches of them.

    A set is taken from the rows whose id hashes to ``key``, so copies don't repeat it, and texts of other
    ids are not hashed. A table of marks tells those rows; a row let through by chance adds a node that no
    pair names, or repeats one that is named.
    """
    both = chosen.select(F.explode(F.array("key", F.col("node").bitwiseXOR(F.col("key")))).alias("mark"))
    shared = docs.sparkSession.sparkContext.broadcast(marks_of(both, F.col("mark")))
    source = docs.select(F.xxhash64(f"`{id_column}`").alias("key"), F.col(f"`{text_column}`").cast("binary").alias("t"))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, np.ndarray]]]:
        marks = shared.value
        seen: set[int] = set()
        for batch in batches:
            batch = batch.filter(pa.array(is_marked(marks, batch.column(0).to_numpy())))
            for part in slices(batch, batch.column(1), _SLICE):
                sets = shingle_sets(part.column(1).to_pylist(), size)
                own = np.array([node_of(s) for s in sets], np.int64)
                near = is_marked(marks, own ^ part.column(0).to_numpy())
                found = []
                for s, node, keep in zip(sets, own.tolist(), near.tolist(), strict=True):
                    if keep and len(s) and node not in seen:
                        seen.add(node)
                        found.append((node, s))
                yield found

    return source.where(F.col("t").isNotNull()), made


def fragments(docs: DataFrame, chosen: DataFrame, levels: np.ndarray, size: int, id_column: str, text_column: str) -> DataFrame:
    """``node, fragment, part``: the sets of the nodes in ``chosen`` (node, key), cut along the global order."""
    order = docs.sparkSession.sparkContext.broadcast(levels)
    source, made = sets_of(docs, chosen, size, id_column, text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = order.value
        starts = np.concatenate([[0], np.cumsum(np.bincount(levels, minlength=256))]).astype(float)
        for found in made(batches):
            nodes, places, rows = [], [], []
            for node, s in found:
                of = fragment_of(levels, s, starts)
                by = np.argsort(of, kind="stable")
                at, first = np.unique(of[by], return_index=True)
                rows += np.split(_signed(s)[by], first[1:])
                places += at.tolist()
                nodes += [node] * len(at)
            if nodes:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes, pa.int64()), pa.array(places, pa.int32()), _lists(rows)], names=["node", "fragment", "part"]
                )

    return source.mapInArrow(run, "node long, fragment int, part array<long>")


def sketch_of(shingles: np.ndarray) -> bytes:
    """A table of two to four bits for each shingle, SKETCH at most, set where the low bits of one point."""
    cells = np.zeros(min(SKETCH, max(64, 1 << int(2 * len(shingles) - 1).bit_length())), bool)
    cells[(shingles & np.uint64(len(cells) - 1)).astype(np.int64)] = True
    return np.packbits(cells, bitorder="little").tobytes()


def can_link(na: int, a: bytes, nb: int, b: bytes, percent: int) -> bool:
    """Whether sets of ``na`` and ``nb`` shingles with these sketches can reach the threshold: each bit that only
    one of them has stands for one shingle at least that the other lacks."""
    bits = 8 * min(len(a), len(b))
    x, y = (_folded(int.from_bytes(s, "little"), 8 * len(s), bits) for s in (a, b))
    common = min(na - (x & ~y).bit_count(), nb - (y & ~x).bit_count())
    return 100 * common >= percent * (na + nb - common)


def _folded(cells: int, bits: int, to: int) -> int:
    """The sketch that the same set has in a table of fewer bits."""
    while bits > to:
        bits //= 2
        cells = cells >> bits | cells & ((1 << bits) - 1)
    return cells


def sketches(docs: DataFrame, chosen: DataFrame, size: int, id_column: str, text_column: str) -> DataFrame:
    """``node, sketch`` of the nodes in ``chosen`` (node, key)."""
    source, made = sets_of(docs, chosen, size, id_column, text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in made(batches):
            if found:
                rows = [pa.array([n for n, _ in found], pa.int64()), pa.array([sketch_of(s) for _, s in found], pa.binary())]
                yield pa.RecordBatch.from_arrays(rows, names=["node", "sketch"])

    return source.mapInArrow(run, "node long, sketch binary")


def _among(parts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Parts whose node is marked for the given ones: what the join would drop mostly stays out of its shuffle."""
    marked = parts.sparkSession.sparkContext.broadcast(marks_of(nodes, F.col("node")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(is_marked(marked.value, batch.column(0).to_numpy())))

    return parts.mapInArrow(run, parts.schema)


def bounded(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, na, b, nb`` that can reach the threshold by their ``known`` sketches; no other can."""
    left = _among(known, pairs.select(F.col("a").alias("node"))).toDF("a", "sa")
    right = _among(known, pairs.select(F.col("b").alias("node"))).toDF("b", "sb")
    met = pairs.select("a", "na", "b", "nb").join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "na", "sa", "b", "nb", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("na", "sa", "nb", "sb")), strict=True)
            keep = pa.array([can_link(*row, percent) for row in rows], pa.bool_())
            yield batch.select(["a", "na", "b", "nb"]).filter(keep)

    return met.mapInArrow(run, pairs.select("a", "na", "b", "nb").schema).distinct()


def verified(pairs: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, na, b, nb`` whose sets reach the threshold: overlaps counted per fragment, summed per
    pair. The set of ``a`` travels to ``b``, fragment by fragment, once for each of its pairs."""
    left = _among(parts, pairs.select(F.col("a").alias("node"))).toDF("a", "fragment", "pa")
    right = _among(parts, pairs.select(F.col("b").alias("node"))).toDF("b", "fragment", "pb")
    counted = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), ["b", "fragment"]).select(
        "a", "na", "b", "nb", "fragment", F.size(F.array_intersect("pa", "pb")).alias("common")
    )
    each = counted.groupBy("b", "fragment", "a", "na", "nb").agg(F.max("common").alias("common"))  # repeated rows repeat a part
    whole = each.groupBy("a", "na", "b", "nb").agg(F.sum("common").alias("common"))
    return whole.where(100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")


def _with(links: DataFrame | None, found: DataFrame) -> DataFrame:
    return found if links is None else links.union(found)


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose nodes no link connects yet."""
    one, two = labels.toDF("a", "ra"), labels.toDF("b", "rb")
    roots = pairs.join(one, "a", "left").join(two, "b", "left")
    return roots.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "na", "b", "nb", "c")


def reachable(percent: int, n: str, at: str, other: F.Column) -> F.Column:
    """Whether a shingle can be the first that a set of ``n`` shingles, where it stands at place ``at`` of the
    global order, has in common with a set of ``other`` shingles that it links with: no shared one is
    before it, so all of them must find room from there on."""
    size = F.col(n).cast("long")
    return (100 + percent) * (size - F.col(at)) >= percent * (size + other)


def meet(percent: int) -> F.Column:
    """Whether sets of ``na`` and ``nb`` shingles can link and have this bucket's shingle, at ``pa`` and ``pb``, in common first."""
    na, nb = F.col("na").cast("long"), F.col("nb").cast("long")
    fits = (100 * nb >= percent * na) & (100 * na >= percent * nb)
    return fits & reachable(percent, "na", "pa", F.col("nb")) & reachable(percent, "nb", "pb", F.col("na"))


def near_components(
    docs: DataFrame, size: int = 4, percent: int = 85, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Components of documents whose sets of ``size``-word shingles have a Jaccard similarity of at
    least ``percent`` in a hundred: ``doc_id, n_shingles, component_id`` (the smallest id reachable).

    Equal sets are one node. Within a bucket of nodes that share a prefix shingle, each is first
    compared with one pivot: the node with fewest rarer shingles of its own, which is the text that the
    others are copies of or close to it. Rounds with other pivots follow while they connect much of what a
    large bucket leaves open; then every pair not yet in one component is compared, so no link between components is
    missed and a large group of near copies needs few comparisons. A pair counts in a bucket only where its
    shingle can be the first that the two share, and sets are made and moved only for pairs whose sketches leave
    room for a link.

    One row for each row of ``docs``. A null text, or one without words, has no shingles and is its own
    component; repeated rows share a component; a null id stays null and never names a component;
    other columns are not read. Hashes have 64 bits.
    """
    base = written(document_nodes(docs, size, id_column, text_column), "shingled")
    levels = frequency_levels(docs, size, text_column)
    bucket = W.partitionBy("token")
    shared = prefixes(docs, levels, size, percent, text_column)
    shared = shared.withColumns({"low": F.min("node").over(bucket), "high": F.max("node").over(bucket), "least": F.min("n").over(bucket)})
    near = reachable(percent, "n", "at", F.greatest(F.col("least"), F.ceil(percent * F.col("n").cast("long") / 100)))
    shared = written(shared.where("low != high").where(near).select("token", "node", "n", "at").distinct(), "buckets")
    keys = base.join(shared.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min(F.xxhash64("id")).alias("key"))
    keys = written(keys, "keys")
    known = written(sketches(docs, keys, size, id_column, text_column), "sketches")

    def linked_of(pairs: DataFrame) -> DataFrame:
        near = written(bounded(pairs, known, percent), "near")
        if near.isEmpty():
            return near.select("a", "b")
        ends = keys.join(near.select(F.explode(F.array("a", "b")).alias("node")), "node", "left_semi")
        parts = written(fragments(docs, ends, levels, size, id_column, text_column), "fragments")
        links = written(verified(near, parts, percent), "linked")
        dropped(near, parts)
        return links

    labels = links = tried = None
    for turn in range(MAX_TURNS):
        if labels is None:
            rest = shared.withColumn("root", F.col("node"))
        else:
            rest = written(shared.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
        chosen = F.struct((F.col("at") / 2**turn).cast("int"), F.xxhash64("node", F.lit(turn)))  # other pivots in each turn
        own = rest.groupBy("token", "root").agg(F.count("*").alias("c"), F.min(F.struct(chosen.alias("o"), "node", "n", "at")).alias("p"))
        open_ = own.groupBy("token").agg(
            F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("q"), F.min(F.struct("p", "root")).alias("pivot")
        ).where(F.col("m") * F.col("m") > F.col("q"))
        open_ = written(open_, "open")
        left = open_.agg(F.sum(F.col("m") * F.col("m") - F.col("q")).alias("pairs"), F.sum("m").alias("rows")).first()
        if not left["rows"]:
            dropped(open_, *[rest] * (labels is not None))
            break
        one = rest.join(open_.select("token", "pivot"), "token").select(
            "token", F.col("node").alias("a"), F.col("n").alias("na"), F.col("at").alias("pa"), F.col("root").alias("ra"), "pivot"
        )
        last = turn > 0 and (left["pairs"] <= 32 * left["rows"] or turn == MAX_TURNS - 1 or found * SLOW < left["rows"])
        if last:  # every pair of two components
            two = one.drop("pivot").toDF("token", "b", "nb", "pb", "rb")
            pairs = one.join(two, "token").where("a < b and ra != rb")
        else:
            pivot = {"b": "node", "nb": "n", "pb": "at"}
            pairs = one.where(F.col("ra") != F.col("pivot.root")).withColumns({k: F.col(f"pivot.p.{v}") for k, v in pivot.items()})
        pairs = pairs.where(meet(percent)).groupBy("a", "na", "b", "nb").agg(F.count("*").alias("c"))
        if tried is not None:
            pairs = pairs.join(tried, [F.least("a", "b") == F.col("lo"), F.greatest("a", "b") == F.col("hi")], "left_anti")
        if not last:  # the likeliest pivot of each node, so that its set travels once; the last turn takes the others
            best = F.max(F.struct("c", "b", "na", "nb")).alias("best")
            pairs = pairs.groupBy("a").agg(best).select("a", "best.na", "best.b", "best.nb", "best.c")
        pairs = written(pairs, "pairs")
        dropped(open_, *[rest] * (labels is not None))
        if last:
            for _ in range(BEST_ROUNDS):  # most pairs are in one component once each node has met its likeliest partner
                size_ = pairs.agg(F.count("*").alias("pairs"), F.approx_count_distinct("a").alias("nodes")).first()
                if size_["pairs"] <= 4 * size_["nodes"]:
                    break
                likely = pairs.groupBy("a").agg(F.max(F.struct("c", "b", "na", "nb")).alias("best")).select("a", "best.na", "best.b", "best.nb")
                likely = written(likely, "likely")
                links = _with(links, linked_of(likely))
                pairs, before = written(_apart(pairs.join(likely, ["a", "b"], "left_anti"), components(links)), "pairs"), pairs
                dropped(likely, before)
        linked = linked_of(pairs)
        links, found = _with(links, linked), linked.count()
        labels = components(links)
        if last:
            dropped(pairs)
            break
        done = pairs.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
        tried = done if tried is None else tried.union(done)
    dropped(known, keys, shared)
    if labels is None:
        labels = base.sparkSession.createDataFrame([], "node long, root long")
    named = base.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("id").alias("least"))
    return named.join(least, "root", "left").select(
        F.col("id").alias(id_column), "n_shingles", F.coalesce("least", "id").alias("component_id")
    )


#: Rounds of comparisons; the last one is complete.
MAX_TURNS = 5
#: A turn with other pivots follows if the one before linked at least one in so many of the rows that are open.
SLOW = 32
#: Rounds of the last turn in which each node meets the partner with most of its prefix, before all others.
BEST_ROUNDS = 2
