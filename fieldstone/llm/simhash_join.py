"""SimHash near-duplicates by a segment-popcount embedding: fingerprints become points of bit counts, a
grid finds points in reach of each other by Manhattan distance, and their fingerprints are compared."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldstone.llm.graph import components
from fieldstone.llm.text import per_text, written

SEED = 42
DISTANCE = 3
#: Fingerprints that one task compares with each other; fuller cells are cut into blocks of so many.
BLOCK = 4096
_PART = 1 << 20  # bytes of a text that are split into words at once
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BITS = 0x55555555  # the lower bit of each segment of two bits, in half a fingerprint


def _word_parts(text: bytes, size: int) -> Iterator[list[bytes]]:
    """The words of a text, some at a time; each part begins with the last ``size - 1`` of the one before."""
    at, last = 0, []
    while at < len(text):
        end = at + _PART
        while end < len(text) and text[end] not in b" \t\n\v\f\r":
            end += 1
        words = last + text[at:end].translate(_LOWER).split()
        if len(words) >= size or end >= len(text):
            yield words
            last = words[len(words) - size + 1 :] if size > 1 else []
        else:
            last = words
        at = end


def fingerprint(text: bytes, size: int) -> int:
    """The SimHash of the text's shingles of ``size`` words: a bit is 1 if more than half of their hashes have it."""
    total, ones = 0, np.zeros(64, np.int64)
    for words in _word_parts(text, size):
        n = len(words) - size + 1
        if n > 0:
            line = b" ".join(words)
            lengths = np.fromiter(map(len, words), np.int64, len(words))
            ends = np.cumsum(lengths + 1) - 1
            starts = ends - lengths
            shingles = [line[s:e] for s, e in zip(starts[:n].tolist(), ends[size - 1 :].tolist(), strict=True)]
        elif total == 0 and words:
            shingles = [b" ".join(words)]
        else:
            continue
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(shingles))
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        total += len(shingles)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, size: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id, fp`` of every row: the fingerprint as a signed 64-bit number, 0 without words."""

    def run(texts: list[bytes]) -> list[pa.Array]:
        return [pa.array([fingerprint(t, size) for t in texts], pa.int64())]

    return per_text(docs, id_column, text_column, run, "fp long").withColumnRenamed(id_column, "id")


def _half_counts(fp: Column, half: int) -> Column:
    """Bit counts (0 to 2) of the 16 segments of half a fingerprint, two bits for each."""
    bits = F.shiftrightunsigned(fp, 32 * half)
    return bits.bitwiseAND(F.lit(_BITS)) + F.shiftrightunsigned(bits, 1).bitwiseAND(F.lit(_BITS))


def grid_members(nodes: DataFrame) -> DataFrame:
    """``cell, fp, home``: each fingerprint in the cells of the grid where it must be compared.

    The point of a fingerprint has the bit counts of its 32 segments as coordinates. Changing a bit moves
    one coordinate by one, so the Manhattan distance of two points is never more than the number of
    differing bits. At most 3 in all is at most 1 in one half of the coordinates: there the points
    share a cell, or one's is a single step above the other's. So a fingerprint is at home in the cell of
    each half and visits the cells one step up.
    """
    cells = []
    for half in (0, 1):
        own = _half_counts(F.col("fp"), half)
        name = F.lit(half << 40)
        cells.append(F.struct((own + name).alias("cell"), F.lit(True).alias("home")))
        for segment in range(16):
            room = F.shiftright(own, 2 * segment).bitwiseAND(F.lit(3)) < 2
            up = F.struct((own + F.lit(1 << 2 * segment) + name).alias("cell"), F.lit(False).alias("home"))
            cells.append(F.when(room, up))
    return nodes.select("fp", F.inline(F.array_compact(F.array(*cells))))


def _near_pairs(fps: np.ndarray, starts: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links inside runs of fingerprints: all of short runs, of long ones enough to connect what links connect."""
    sizes = np.diff(starts)
    for size in np.unique(sizes[(sizes > 1) & (sizes <= 16)]).tolist():
        x, y = np.triu_indices(size, 1)
        rows = fps[starts[:-1][sizes == size][:, None] + np.arange(size)]
        for part in np.array_split(rows, len(rows) * len(x) // 4_000_000 + 1):
            near = np.bitwise_count(part[:, x] ^ part[:, y]) <= distance
            yield part[:, x][near], part[:, y][near]
    for run in np.flatnonzero(sizes > 16).tolist():
        rest = fps[starts[run] : starts[run + 1]]
        while len(rest):
            reached, rest = [rest[:1]], rest[1:]
            while reached and len(rest):
                group = reached.pop()
                for i, one in enumerate(group):
                    near = np.bitwise_count(rest ^ one) <= distance
                    if near.any():
                        found, rest = rest[near], rest[~near]
                        yield np.full(len(found), one), found
                        reached.append(found)
                    if not len(rest):
                        break
                else:
                    continue
                break


def _linker(distance: int):
    """Compares the fingerprints of each run of equal ``cell, i, j``; a run may span batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(keys: list[np.ndarray], fps: np.ndarray, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
            for a, b in _near_pairs(fps, starts, distance):
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        held: list[list[np.ndarray]] = []
        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            if not len(columns[0]):
                continue
            held.append(columns)
            first, last = held[0], columns
            if all(first[k][0] == last[k][-1] for k in range(3)):
                continue
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            change = np.any([c[1:] != c[:-1] for c in columns[:3]], axis=0)
            starts = np.concatenate([[0], np.flatnonzero(change) + 1])
            yield from links(columns[:3], columns[3].view(np.uint64), starts)
            held = [[c[starts[-1] :] for c in columns]]
        if held:
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            change = np.any([c[1:] != c[:-1] for c in columns[:3]], axis=0)
            starts = np.concatenate([[0], np.flatnonzero(change) + 1, [len(columns[0])]])
            yield from links(columns[:3], columns[3].view(np.uint64), starts)

    return run


def near_links(nodes: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """``a, b``: pairs of different fingerprints (column ``fp``, each once) that differ in at most
    ``distance`` (3 or fewer) bits, enough of them to connect all that such pairs connect.

    A cell with many fingerprints is cut into blocks, and each pair of blocks is a task's work of its own.
    Within it a fingerprint that is connected is compared only with those that are not, so a dense
    cell gives as many links as it has fingerprints, not pairs.
    """
    if not 0 <= distance <= 3:
        raise ValueError("the grid finds distances of 3 or less")
    members = grid_members(nodes)
    used = members.groupBy("cell").agg(F.count("*").alias("n"), F.max("home").alias("lived"))
    used = used.where((F.col("n") > 1) & F.col("lived")).select("cell", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    rows = members.select("cell", "fp").join(used.hint("merge"), "cell").withColumn("own", own)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    rows = rows.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    return rows.mapInArrow(_linker(distance), "a long, b long")


def simhash_components(
    docs: DataFrame, size: int = 3, distance: int = DISTANCE, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Components of documents whose SimHashes differ in at most ``distance`` bits: ``doc_id, fp,
    component_id`` (the smallest id reachable), one row for each row of ``docs``.

    A fingerprint is made of the XXH64 (seed 42) of all shingles of ``size`` words, repeats included;
    A-Z are lowered, words lie between ASCII white space, fewer words are one shingle. A null or empty
    text has the fingerprint 0, which links like any other. Equal fingerprints are one node, so copies
    cost nothing; repeated rows share a component; a null id stays null and never names a component (its
    component's id is null if nobody else is in it). Other columns are not read.
    """
    base = written(fingerprints(docs, size, id_column, text_column), "simhashes")
    nodes = written(base.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    labels = components(written(near_links(nodes.select("fp"), distance), "near"))
    joined = labels.join(nodes, labels["node"] == nodes["fp"])
    roots = joined.groupBy("root").agg(F.min("least").alias("smallest"))
    linked = labels.join(roots, "root").select(F.col("node").alias("fp"), "smallest")
    named = nodes.join(linked, "fp", "left").select("fp", F.coalesce("smallest", "least").alias("component_id"))
    return base.join(named, "fp").select(F.col("id").alias(id_column), "fp", "component_id")


def simhash_digest(found: DataFrame) -> DataFrame:
    return found.withColumn("fingerprint", F.lpad(F.lower(F.hex("fp")), 16, "0")).drop("fp")
