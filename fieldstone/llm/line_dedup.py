"""Line dedup by pairwise alignment: documents that share a rare stretch of lines are aligned by
patience diff, and aligned common blocks are deleted from the later one."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldstone.llm.hashing import powers, word_hashes
from fieldstone.llm.text import mix, per_text, slices, written

#: Words that an aligned block must have to be deleted; also what makes a stretch of lines rare.
MIN_WORDS = 30
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_SLICE = 1 << 20  # bytes of text whose units a task makes at once
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True


def units(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines, cut further after sentences: hash, number of words and first byte of each, and the first
    unit of each text (and their number). Units without words are left out; bytes count from the
    beginning of the own text."""
    words, starts, first, begins = word_hashes(texts)
    joined = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    # A word begins a unit if a line break or the end of a sentence lies between it and the last one.
    breaks = np.cumsum(joined == 10, dtype=np.int64)
    new = np.ones(len(words), bool)
    before = starts[1:] - 1
    new[1:] = breaks[before] > breaks[starts[:-1]]
    last = np.flatnonzero(~_space(joined[:-1]) & _space(joined[1:]))  # last byte of each word
    new[1:] |= _STOP[joined[last[:-1]]]
    head = np.flatnonzero(new)
    count = np.diff(np.concatenate([head, [len(words)]]))
    offset = np.arange(len(words)) - np.repeat(head, count)
    value = mix(np.add.reduceat(words * powers(int(count.max()), _BASE)[offset], head))
    unit_first = np.searchsorted(head, first)
    text_of = np.searchsorted(first[1:], head, "right")
    return value.view(np.int64), count, starts[head] - begins[text_of], unit_first


def _space(b: np.ndarray) -> np.ndarray:
    return (b == 32) | ((b >= 9) & (b <= 13))


def runs(value: np.ndarray, count: np.ndarray, unit_first: np.ndarray, min_words: int) -> np.ndarray:
    """For each unit the hash of the shortest stretch from it on that has ``min_words`` words; 0 if its
    text ends before. Any common block of that many words begins with a stretch of equal hash."""
    n = len(value)
    if not n:
        return np.zeros(0, np.int64)
    words = np.concatenate([[0], np.cumsum(count)])
    end = np.searchsorted(words, words[:-1] + min_words)  # one past the last unit
    limit = np.repeat(unit_first[1:], np.diff(unit_first))
    up, down = powers(n + 1, _BASE), powers(n + 1, _INVERSE)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(value.view(np.uint64)) * up[:n], dtype=np.uint64)])
    whole = end <= limit
    at = np.where(whole, end, np.arange(n))
    out = mix((total[at] - total[:-1]) * down[:n] + at.astype(np.uint64) - np.arange(n, dtype=np.uint64))
    return np.where(whole, out.view(np.int64) | 1, 0)


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned equal elements of two sequences, ascending in both: elements that are unique in either
    sequence and common to both, along their longest ascending chain, grown to equal neighbours, and the
    same again between them."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        at_b = {x: j for j, x in enumerate(b[b0:b1], b0) if in_b[x] == 1 and in_a.get(x) == 1}
        chain = _ascending([(i, at_b[x]) for i, x in enumerate(a[a0:a1], a0) if x in at_b])
        if not chain:
            chain = _ascending(_by_turn(a, b, a0, a1, b0, b1))
        left = (a0, b0)
        for i, j in chain:
            todo.append((left[0], i, left[1], j))
            out.append((i, j))
            left = (i + 1, j + 1)
        if chain:
            todo.append((left[0], a1, left[1], b1))
    return sorted(out)


def _by_turn(a: list[int], b: list[int], a0: int, a1: int, b0: int, b1: int) -> list[tuple[int, int]]:
    """Where nothing is unique: the first occurrence of an element with the first, the second with the second."""
    places: dict[int, list[int]] = {}
    for j in range(b1 - 1, b0 - 1, -1):
        places.setdefault(b[j], []).append(j)
    out = []
    for i in range(a0, a1):
        left = places.get(a[i])
        if left:
            out.append((i, left.pop()))
    return out


def _ascending(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest chain that ascends in its second part (patience sorting)."""
    tops: list[int] = []
    index: list[int] = []
    back: list[int] = []
    for n, (_, j) in enumerate(pairs):
        k = bisect_left(tops, j)
        back.append(index[k - 1] if k else -1)
        if k == len(tops):
            tops.append(j)
            index.append(n)
        else:
            tops[k], index[k] = j, n
    out, n = [], index[-1] if index else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


def common_blocks(late: list[int], early: list[int], count: list[int], min_words: int) -> list[int]:
    """Units of the later sequence in aligned blocks (consecutive in both) of ``min_words`` or more."""
    out: list[int] = []
    block: list[int] = []
    before = (-2, -2)
    for i, j in [*patience(late, early), (-9, -9)]:
        if (i, j) != (before[0] + 1, before[1] + 1):
            if sum(count[x] for x in block) >= min_words:
                out += block
            block = []
        block.append(i)
        before = (i, j)
    return out


def unit_table(docs: DataFrame, min_words: int, id_column: str, text_column: str) -> DataFrame:
    """``id, mark, units, counts, runs`` of every row with an id and words; ``mark`` tells rows of
    one id with different texts apart."""
    def run(texts: list[bytes]) -> list[pa.Array]:
        value, count, _, first = units(texts)
        columns = (value, count.astype(np.int32), runs(value, count, first, min_words))
        return [pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(x)) for x in columns]

    rows = docs.where(F.col(f"`{id_column}`").isNotNull()).select(
        F.struct(F.col(f"`{id_column}`").alias("id"), F.xxhash64(f"`{text_column}`").alias("mark")).alias("key"),
        F.col(f"`{text_column}`").alias("text"),
    )
    found = per_text(rows, "key", "text", run, "units array<long>, counts array<int>, runs array<long>", _SLICE)
    return found.where(F.size("units") > 0).select("key.*", "units", "counts", "runs")


def removed_units(docs: DataFrame, min_words: int = MIN_WORDS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id``, ``mark`` and the numbers of the units that go, for every document that loses some.

    Every stretch of ``min_words`` words is kept by the first document (smallest id) that has it; each
    later one is aligned with that keeper, so pairs grow with the number of stretches, however many
    documents share one.
    """
    table = written(unit_table(docs, min_words, id_column, text_column), "units")
    posted = table.select("id", F.explode(F.array_distinct("runs")).alias("run")).where("run != 0")
    keepers = posted.groupBy("run").agg(F.min("id").alias("keeper"), F.max("id").alias("most")).where("keeper != most")
    keepers = written(keepers.select("run", "keeper"), "keepers")
    # Joins of whole tables are sort-merge joins at every size, so that disk and time grow evenly.
    pairs = posted.join(keepers.hint("merge"), "run").where("id != keeper").select("id", "keeper").distinct()
    pairs = written(pairs, "pairs")
    paired = pairs.select("id").union(pairs.select("keeper")).distinct()
    table = table.join(paired.hint("merge"), "id", "left_semi").select("id", "mark", "units", "counts").dropDuplicates(["id", "mark"])
    table = written(table, "paired")
    early = table.select(F.col("id").alias("keeper"), F.col("units").alias("early"))
    late = table.select("id", "mark", F.col("units").alias("late"), "counts")
    rows = pairs.join(early.hint("merge"), "keeper").join(late.hint("merge"), "id").select("id", "mark", "late", "counts", "early")
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                late, counts, early = (batch.column(i)[k].values.to_numpy().tolist() for i in (2, 3, 4))
                out.append(common_blocks(late, early, counts, min_words))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int32()))], names=["id", "mark", "gone"]
            )

    gone = rows.mapInArrow(run, f"id {kind}, mark long, gone array<int>").where(F.size("gone") > 0)
    return gone.groupBy("id", "mark").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone"))


def drop_units(text: bytes, gone: list[int]) -> tuple[bytes, list[tuple[int, int]], int]:
    """The text without the given units, the byte spans that went, and the words that went."""
    _, count, start, first = units([text])
    ends = np.concatenate([start[1:], [len(text)]])
    spans: list[list[int]] = []
    for u in gone:
        a, b = int(start[u]) if u else 0, int(ends[u])
        if spans and spans[-1][1] == a:
            spans[-1][1] = b
        else:
            spans.append([a, b])
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        at = b
    out.append(text[at:])
    left = b"".join(out)
    return (left.rstrip(b" \t\r\n") if spans and spans[-1][1] == len(text) else left), [(a, b) for a, b in spans], int(count[gone].sum())


def dedup_lines(
    docs: DataFrame, min_words: int = MIN_WORDS, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``docs`` with every column, the text without blocks that an earlier document has, and
    ``removed_spans`` (start, end in code points of the original text) and ``removed_words``.

    A unit is a line, cut further after sentences. Blocks of ``min_words`` words or more that align
    with a document of smaller id go. One row for each row of ``docs``. A null text stays null and an
    empty one empty; a row with a null id stays as it is and keeps nothing from others; rows that
    repeat both id and text are one document; rows that share an id take nothing from each other.
    """
    gone = written(removed_units(docs, min_words, id_column, text_column), "gone")
    docs = docs.drop("removed_spans", "removed_words")
    names = docs.columns
    i, t = names.index(id_column), names.index(text_column)
    plain = docs.toDF(*[f"c{k}" for k in range(len(names))])
    own = (F.col(f"c{i}") == F.col("id")) & (F.xxhash64(f"c{t}") == F.col("mark"))
    joined = plain.join(gone.hint("merge"), own, "left").drop("id", "mark").withColumn(f"c{t}", F.col(f"c{t}").cast("binary"))
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def place(text: bytes, at: int) -> int:
        return len(text[:at].decode("utf-8", "replace"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, whole.column(f"c{t}")):
                table = {n: batch.column(n) for n in batch.schema.names}
                texts, lists = table[f"c{t}"].to_pylist(), table.pop("gone").to_pylist()
                spans, words = [[] for _ in texts], [0] * len(texts)
                for k, (text, units_gone) in enumerate(zip(texts, lists, strict=True)):
                    if units_gone and text is not None:
                        texts[k], cut, words[k] = drop_units(text, units_gone)
                        spans[k] = [{"start": place(text, x), "end": place(text, y)} for x, y in cut]
                table[f"c{t}"] = pa.array(texts, pa.binary())
                table |= {"removed_spans": pa.array(spans, span), "removed_words": pa.array(words, pa.int64())}
                yield pa.RecordBatch.from_arrays(list(table.values()), names=list(table))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.drop("gone").schema.fields)
    out = joined.mapInArrow(run, f"{schema}, removed_spans array<struct<start:bigint,end:bigint>>, removed_words long")
    restored = [F.col(f"c{k}").cast("string").alias(n) if k == t else F.col(f"c{k}").alias(n) for k, n in enumerate(names)]
    return out.select(*restored, "removed_spans", "removed_words")
