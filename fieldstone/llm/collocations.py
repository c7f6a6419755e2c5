"""Phrase collocations by Rabin-Karp fingerprints: prefix polynomials hash every n-gram of a batch of
texts, shuffles count the fingerprints, and only frequent phrases are ever cut out of the texts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldstone.llm.hashing import powers
from fieldstone.llm.text import mix, slices, small_batches, written

_BASE = 0xD6E8FEB86659FD93
_PHRASE_BASE = 0xA24BAED4963EE407
_STEP_INT = 0x9E3779B97F4A7C15
_STEP = np.uint64(_STEP_INT)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_KIND = np.zeros(256, np.uint8)  # 0: part of a word, 1: between words, 2: ends a piece
_KIND[[9, 32]] = 1
_KIND[[*b".,;:!?", *range(10, 14)]] = 2
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)

#: Bytes of text that a task hashes at once, and those whose fingerprints it counts at once.
PART, FLUSH = 1 << 20, 4 << 20
#: A mark table has 16 bits for each frequent fingerprint, within these bounds (8 KB and 16 MB).
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 27
_CHUNK = (1 << 18) - 1
#: Tables of powers up to this length are kept; those of a very long text go with it.
_KEPT_POWERS = 1 << 19
#: Candidates of a language that one task ranks.
_RANKED = 500_000


def _both_powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    return powers(n, base), powers(n, pow(base, -1, 1 << 64))


_kept_powers = lru_cache(maxsize=4)(_both_powers)


def _power_table(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64; a rounded-up length, so few tables are made."""
    n = 1 << max(10, (n - 1).bit_length())
    return _kept_powers(n, base) if n <= _KEPT_POWERS else _both_powers(n, base)


def _prefix(values: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix polynomials of the values, and the factors that move a window's polynomial to its start."""
    up, down = _power_table(len(values) + 1, base)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return sums, down


class Words:
    """The words of a batch of texts: places in the lowered ``buffer``, hashes, pieces and texts."""

    def __init__(self, texts: list[bytes], hash_bits: int):
        self.buffer = (b"\n" + b"\n".join(texts) + b"\n").translate(_LOWER)
        data = np.frombuffer(self.buffer, np.uint8)
        kind = _KIND[data]
        inside = kind == 0
        self.starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
        self.ends = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
        self.piece = np.cumsum(kind == 2, dtype=np.int32)[self.starts]
        begins = 1 + np.cumsum([0] + [len(t) + 1 for t in texts])
        first = np.searchsorted(self.starts, begins)
        self.text = np.repeat(np.arange(len(texts)), np.diff(first))
        self.at = np.arange(len(self.starts)) - np.repeat(first[:-1], np.diff(first))
        self.mask = np.uint64((1 << hash_bits) - 1)
        self.hashes = np.empty(len(self.starts), np.uint64)
        word = 0
        while word < len(self.starts):
            stop = max(word + 1, int(np.searchsorted(self.ends, self.starts[word] + _CHUNK, "right")))
            low = self.starts[word]
            sums, down = _prefix(_BYTES[data[low : self.ends[stop - 1]]], _BASE)
            s, e = self.starts[word:stop] - low, self.ends[word:stop] - low
            self.hashes[word:stop] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * _STEP)
            word = stop
        self.sums, self.down = _prefix(self.hashes, _PHRASE_BASE)

    def grams(self, n: int, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The fingerprint of ``n`` words from each word on, and whether they lie in one piece."""
        count = max(0, len(self.starts) - n + 1)
        window = (self.sums[n : n + count] - self.sums[:count]) * self.down[:count]
        prints = mix(window + seeds[self.text[:count]] + np.uint64(n * _STEP_INT % (1 << 64))) & self.mask
        return prints, self.piece[:count] == self.piece[n - 1 : n - 1 + count]

    def exact(self) -> np.ndarray:
        """A number for each word, equal for equal words only: hashes, checked against the text."""
        _, first, number = np.unique(self.hashes, return_index=True, return_inverse=True)
        model = first[number]
        data = np.frombuffer(self.buffer, np.uint8)
        length = self.ends - self.starts
        same = bool((length == length[model]).all())
        left, k = np.arange(len(length)), 0
        while same and len(left):
            left = left[length[left] > k]
            same = bool((data[self.starts[left] + k] == data[self.starts[model[left]] + k]).all())
            k += 1
        if same:
            return number
        seen: dict[bytes, int] = {}
        places = zip(self.starts.tolist(), self.ends.tolist(), strict=True)
        return np.array([seen.setdefault(self.buffer[s:e], len(seen)) for s, e in places])


def _seed(lang: str) -> int:
    """A language's part of every fingerprint."""
    value = np.frombuffer(lang.encode(), np.uint8).astype(np.uint64)
    return int(mix((value * powers(len(value), _BASE)[: len(value)]).sum(keepdims=True, dtype=np.uint64) + _STEP)[0])


def _marked(table: np.ndarray, prints: np.ndarray) -> np.ndarray:
    cell = prints & np.uint64(len(table) * 64 - 1)
    return (table[cell >> np.uint64(6)] >> (cell & np.uint64(63)) & np.uint64(1)).astype(bool)


def _candidates(words: Words, seeds: np.ndarray, n: int, below: int, table: np.ndarray | None) -> np.ndarray:
    """Fingerprints of the n-grams all of whose ``below``-grams are marked as frequent."""
    prints, whole = words.grams(n, seeds)
    if table is not None:
        parts, _ = words.grams(below, seeds)
        known = _marked(table, parts)
        for k in range(n - below + 1):
            whole = whole & known[k : k + len(whole)]
    return prints[whole]


def _source(docs: DataFrame, lang_column: str, text_column: str, id_column: str) -> DataFrame:
    return docs.select(
        F.coalesce(F.col(f"`{lang_column}`").cast("string"), F.lit("und")).alias("lang"),
        F.col(f"`{text_column}`").cast("binary").alias("text"),
        F.col(f"`{id_column}`").cast("bigint").alias("id"),
    ).where(F.length("text") > 0)


def _flushes(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Rows of about ``most`` bytes of text at a time."""
    held, size = [], 0
    for batch in batches:
        for part in slices(batch, batch.column(1), most):
            held.append(part)
            size += part.column(1).nbytes
            if size >= most:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def frequent_prints(
    source: DataFrame, sizes: tuple[int, ...], below: int, table, least: int, hash_bits: int
) -> DataFrame:
    """``fp``: fingerprints of the n-grams of the given sizes that occur ``least`` times or more. A task adds
    up what it sees of a few megabytes before the shuffle; most pairs of words are rare, and a second
    map-side combine would only hold them in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = table.value if table is not None else None
        held: list[np.ndarray] = []
        size = 0
        for part in _flushes(batches, PART):
            words = Words(part.column(1).to_pylist(), hash_bits)
            seeds = np.array([_seed(x) for x in part.column(0).to_pylist()], np.uint64)
            held += [_candidates(words, seeds, n, below, marks) for n in sizes]
            size += part.column(1).nbytes
            if size >= FLUSH:
                yield from counted(held)
                size = 0
        yield from counted(held)

    def counted(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        found = np.concatenate(held)
        held.clear()
        found, counts = np.unique(found, return_counts=True)
        for k in range(0, len(found), 200_000):
            part = slice(k, k + 200_000)
            yield pa.RecordBatch.from_arrays([pa.array(found[part].view(np.int64)), pa.array(counts[part])], names=["fp", "n"])

    counts = source.select("lang", "text").mapInArrow(run, "fp long, n long").repartition("fp")
    return counts.groupBy("fp").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("fp")


def mark_table(prints: DataFrame):
    """A broadcast table of bits in which the fingerprints are marked. Others may be marked with them, so it
    only leaves out n-grams that cannot be frequent; its size follows their number, up to 16 MB."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * prints.count()).bit_length()))
    cell = F.col("fp").bitwiseAND(F.lit(bits - 1))
    bit = F.expr("shiftleft(1L, cast(cell & 63 as int))")
    rows = prints.select(cell.alias("cell")).groupBy(F.shiftright("cell", 6).alias("at")).agg(F.bit_or(bit).alias("bits"))
    found = rows.toArrow()  # bits / 64 rows at most
    table = np.zeros(bits // 64, np.uint64)
    table[found["at"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return prints.sparkSession.sparkContext.broadcast(table)


def _grouped(words: Words, prints: np.ndarray, where: np.ndarray, n: int, ids: np.ndarray, rank: np.ndarray):
    """Equal n-grams among the occurrences ``where``: the place of the first of each, and how many.

    Occurrences meet by fingerprint; each is checked, word by word, against the one that the group
    points at. Groups in which that fails are told apart by their words.
    """
    text = words.text[where]
    order = np.lexsort((words.at[where], rank[text], prints[where]))
    where = where[order]
    cut = np.concatenate([[True], prints[where[1:]] != prints[where[:-1]]])
    model = where[np.flatnonzero(cut)][np.cumsum(cut) - 1]
    if any((ids[where + k] != ids[model + k]).any() for k in range(n)):
        keys = [ids[where + k] for k in range(n)]
        lang = prints[where]
        order = np.lexsort((words.at[where], rank[words.text[where]], *keys, lang))
        where = where[order]
        cut = np.concatenate([[True], prints[where[1:]] != prints[where[:-1]]])
        for k in range(n):
            cut[1:] |= ids[where[1:] + k] != ids[where[:-1] + k]
    first = np.flatnonzero(cut)
    return where[first], np.diff(np.append(first, len(where)))


def phrase_counts(source: DataFrame, tables: dict[int, object], hash_bits: int) -> DataFrame:
    """``lang, n, phrase, a, at``: exact counts of the phrases whose fingerprints are marked, with the first
    document and word where each stands; for n = 0 the number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for flush in _flushes(batches, PART):
            langs, texts, owners = (c.to_pylist() for c in flush.columns)
            # A language at a time: equal fingerprints of two languages never meet.
            for lang in sorted(set(langs)):
                chosen = [i for i, x in enumerate(langs) if x == lang]
                yield from one([texts[i] for i in chosen], [owners[i] for i in chosen], lang)

    def one(texts: list[bytes], owners: list[int | None], lang: str) -> Iterator[pa.RecordBatch]:
        words = Words(texts, hash_bits)
        if not len(words.starts):
            return
        seeds = np.full(len(texts), _seed(lang), np.uint64)
        ids = words.exact()
        doc = np.array([np.iinfo(np.int64).max if o is None else o for o in owners], np.int64)
        rows = [("", 0, len(words.starts), None, None)]
        for n, table in tables.items():
            prints, whole = words.grams(n, seeds)
            where = np.flatnonzero(whole & _marked(table.value, prints))
            if not len(where):
                continue
            first, counts = _grouped(words, prints, where, n, ids, doc)
            places = zip(words.starts[first].tolist(), words.ends[first + n - 1].tolist(), strict=True)
            phrases = [b" ".join(words.buffer[s:e].split()).decode("utf-8", "replace") for s, e in places]
            found = [owners[t] for t in words.text[first].tolist()]
            rows += zip(phrases, [n] * len(first), counts.tolist(), found, words.at[first].tolist(), strict=True)
        for k in range(0, len(rows), 100_000):
            phrase, n, count, owner, at = zip(*rows[k : k + 100_000], strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(n)), pa.array(n, pa.int32()), pa.array(phrase, pa.string()), pa.array(count, pa.int64()), pa.array(owner, pa.int64()), pa.array(at, pa.int64())],
                names=["lang", "n", "phrase", "a", "doc_id", "word"],
            )

    seen = source.mapInArrow(run, "lang string, n int, phrase string, a long, doc_id long, word long")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "word")
    return seen.groupBy("lang", "n", "phrase").agg(F.sum("a").alias("a"), F.min(place).alias("place")).select(
        "lang", "n", "phrase", "a", F.col("place.doc_id").alias("doc_id"), F.when(~F.col("place.none"), F.col("place.word")).alias("word")
    )


def cut_score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 a n / (left right)), exact beyond 64 bits."""
    wide = lambda c: c.cast("decimal(19,0)")
    top, bottom = F.lit(1000).cast("decimal(4,0)") * wide(a) * wide(n), wide(left) * wide(right)
    return F.call_function("div", top, bottom).cast("bigint")


def mine_collocations(
    docs: DataFrame,
    least: int = 100,
    longest: int = 5,
    keep: int = 2000,
    cover: int = 100,
    id_column: str = "doc_id",
    text_column: str = "text",
    lang_column: str = "lang",
    hash_bits: int = 64,
) -> DataFrame:
    """The strongest phrases of 2 to ``longest`` words of each language: ``lang, rank, phrase, a, l, r, n, score``
    and, as an example, ``doc_id, word``, the smallest document and word number (from 0) where it stands.

    ``a`` counts the phrase within pieces (between any of ``. , ; : ! ?`` and line breaks; A-Z lowered),
    ``l`` and ``r`` the parts of its weakest cut, ``n`` all words of the language. A phrase seen fewer than
    ``least`` times is none; one inside a longer one that has ``cover`` percent of its count or more is left out.

    Fingerprints are counted size by size, and an n-gram only where all its shorter parts are frequent. At the
    end each task groups the occurrences of frequent fingerprints, checks every one against the text its
    group points at, and cuts the phrase out there, so phrases whose fingerprints collide are counted apart
    (``hash_bits`` shortens them for tests). Null and empty texts have no words, a null language is
    ``und``, repeated rows count again, a null id gives no example. Other columns are not read. No documents, no rows.
    """
    if longest < 2 or least < 1:
        raise ValueError("phrases have two words or more and occur once or more")
    source = _source(docs, lang_column, text_column, id_column)
    tables: dict[int, object] = {}
    table, below, size = None, 0, 1
    while size <= longest:
        # Words with pairs, then the third, then two sizes at a time.
        sizes = (size,) if size == 3 or size == longest else (size, size + 1)
        with small_batches(docs.sparkSession):
            prints = written(frequent_prints(source, sizes, below, table, least, hash_bits), "prints")
        table_now = mark_table(prints)
        tables |= dict.fromkeys(sizes, table_now)
        table, below, size = table_now, sizes[-1], sizes[-1] + 1
    with small_batches(docs.sparkSession):
        counts = written(phrase_counts(source, tables, hash_bits).where((F.col("a") >= least) | (F.col("n") == 0)), "phrases")
    words = counts.where("n = 0").select("lang", F.col("a").alias("n_words"))
    found = counts.where("n > 1").join(words, "lang").withColumn("w", F.split("phrase", " "))

    def part(start: Column, length: Column) -> Column:
        return F.array_join(F.slice("w", start, length), " ")

    cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n") - 1)))
    cuts = cuts.withColumns({"left": part(F.lit(1), F.col("k")), "right": part(F.col("k") + 1, F.col("n") - F.col("k"))})
    for side, name in (("left", "l"), ("right", "r")):
        parts = counts.where("n > 0").select(F.col("lang"), F.col("phrase").alias(side), F.col("a").alias(name))
        cuts = cuts.join(parts, ["lang", side])
    scored = cuts.groupBy("lang", "phrase").agg(
        F.min(F.struct(cut_score(F.col("a"), F.col("n_words"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r")).alias("cut"),
        F.first(F.struct("a", "n_words", "doc_id", "word")).alias("own"),
    )
    inner = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.col("n") - 1),
            lambda m: F.transform(F.sequence(F.lit(1), F.col("n") - m + 1), lambda s: part(s, m)),
        )
    )
    longer = found.where("n > 2").select("lang", "a", F.explode(inner).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    rows = scored.join(longer, ["lang", "phrase"], "left")
    rows = rows.where(F.col("most").isNull() | (100 * F.col("most") < cover * F.col("own.a")))
    rows = written(rows.select("lang", "phrase", "cut.*", "own.*"), "scored")
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salts = 1 + rows.count() // _RANKED
    apart = W.partitionBy("lang", F.pmod(F.hash("phrase"), F.lit(salts))).orderBy(*best)
    rows = rows.withColumn("rank", F.row_number().over(apart)).where(F.col("rank") <= keep)
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*best))).where(F.col("rank") <= keep)
    return rows.select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", F.col("n_words").alias("n"), "score", "doc_id", "word"
    )


