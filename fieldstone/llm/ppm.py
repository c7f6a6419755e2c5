"""Language-model scoring by partial matching: a trie of byte contexts with escape estimation (method
C) and symbol exclusion, counted over the whole corpus, gives each document its code length."""

from __future__ import annotations

import hashlib
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldstone.llm.text import fold, slices, written

#: A context of three bytes has a row in the executors' table if it holds at least this share of all symbols, so at most 32768 have.
CONTEXT_SHARE = 1 / 32768
#: In the other contexts, symbols of at least this share are looked up by their four bytes (at most 4 million); the rest are joined.
GRAM_SHARE = 2.0**-22
#: Words of at least this share of all tokens, and at most 64 bytes, go to the executors (at most 10**6 words).
WORD_SHARE = 1e-6
WORD_BYTES = 64
_EDGE = 0xFF  # never part of UTF-8: stands before and after a text
_FLUSH = 300_000  # distinct entries a task holds before it hands them on


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Every symbol of the texts (the edge after each included) with the three bytes before it as one
    number, and the number of symbols of each text."""
    buf = np.frombuffer(b"\xff\xff\xff" + b"".join(t + b"\xff\xff\xff" for t in texts), np.uint8)
    wide = buf.astype(np.uint32)
    keys = (wide[:-3] << 24) | (wide[1:-2] << 16) | (wide[2:-1] << 8) | wide[3:]
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    keep = np.ones(len(keys), bool)
    last = np.cumsum(sizes + 2)
    keep[last - 1] = False
    keep[last - 2] = False
    return keys[keep], sizes


@dataclass
class Trie:
    """Log10 probabilities of the next byte: one row for each context of three bytes that is frequent, and
    single values for the frequent symbols of the others."""

    rows: np.ndarray  # contexts, 256
    three: np.ndarray  # the context of each row
    grams: np.ndarray  # sorted: contexts without a row, with the symbol after them
    values: np.ndarray
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def index(self) -> np.ndarray:
        """Row of each three-byte context, or the number of rows."""
        found = _INDEX.get(self.name)
        if found is None:
            _INDEX.clear()
            found = _INDEX[self.name] = np.full(1 << 24, len(self.rows), np.uint16)
            found[self.three] = np.arange(len(self.rows))
        return found

    def log10(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The sum of what is known here for each text, and what is not: text, gram, occurrences."""
        keys, sizes = grams(texts)
        rows = self.index()[keys >> np.uint32(8)]
        logs = np.zeros(len(keys))
        near = rows < len(self.rows)
        logs[near] = self.rows[rows[near], keys[near] & np.uint32(255)]
        other = np.flatnonzero(~near)
        place = np.minimum(np.searchsorted(self.grams, keys[other]), max(len(self.grams) - 1, 0))
        hit = self.grams[place] == keys[other] if len(self.grams) else np.zeros(len(other), bool)
        logs[other[hit]] = self.values[place[hit]]
        ends = np.cumsum(sizes)
        far = other[~hit]
        of = np.searchsorted(ends, far, "right").astype(np.uint64)
        found, n = np.unique((of << np.uint64(32)) | keys[far], return_counts=True)
        return np.add.reduceat(logs, np.concatenate([[0], ends[:-1]])), (found >> np.uint64(32)).astype(np.int64), found.astype(np.uint32), n


_INDEX: dict[str, np.ndarray] = {}


def _probabilities(levels: list[np.ndarray]) -> np.ndarray:
    """Mix counts of the longest context first with those of shorter ones.

    A context passes what escape estimation C leaves for new symbols (distinct / (count + distinct)) to the
    next shorter one, where symbols it has seen are excluded; the last share is spread evenly.
    """
    size = len(levels[0])
    out, mass, seen = np.zeros((size, 256)), np.ones((size, 1)), np.zeros((size, 256), bool)
    for counts in levels:
        own = np.where(seen, 0, counts).astype(float)
        kinds = (own > 0).sum(1, keepdims=True)
        whole = own.sum(1, keepdims=True) + kinds
        safe = np.maximum(whole, 1)
        out += mass * own / safe
        mass = np.where(kinds > 0, mass * kinds / safe, mass)
        seen |= own > 0
    rest = ~seen
    out += np.where(rest, mass / np.maximum(rest.sum(1, keepdims=True), 1), 0)
    return out / out.sum(1, keepdims=True)


def _table(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The contexts of ``keys`` (a context and the symbol after it), and their counts by symbol."""
    contexts, at = np.unique(keys >> 8, return_inverse=True)
    out = np.zeros((len(contexts), 256), np.int64)
    np.add.at(out, (at, keys & 255), counts)
    return contexts, out


@dataclass
class Short:
    """Counts of the symbols after contexts of up to two bytes, and what longer contexts make of them."""

    keys: np.ndarray  # two-byte contexts with the symbol after them
    counts: np.ndarray

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row of each two-byte context (the last one, of zeros, if it was not seen), and counts after contexts of two bytes, one and none."""
        c2, n2 = _table(self.keys, self.counts)
        n1 = np.zeros((256, 256), np.int64)
        np.add.at(n1, c2 & 255, n2)
        at2 = np.full(1 << 16, len(c2), np.int32)
        at2[c2] = np.arange(len(c2))
        return at2, np.concatenate([n2, np.zeros((1, 256), np.int64)]), n1, n1.sum(0, keepdims=True)

    def rows(self, contexts: np.ndarray, n3: np.ndarray, tables: tuple | None = None) -> np.ndarray:
        """Log10 probabilities after three-byte contexts with the counts ``n3``."""
        at2, n2, n1, n0 = tables or self.tables()
        parts = [np.zeros((0, 256), np.float32)]
        for a in range(0, len(contexts), 4096):
            ctx, own = contexts[a : a + 4096], n3[a : a + 4096]
            found = _probabilities([own, n2[at2[ctx & 0xFFFF]], n1[ctx & 255], np.repeat(n0, len(ctx), 0)])
            parts.append(np.log10(found).astype(np.float32))
        return np.concatenate(parts)


def _source(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_column}`").cast("binary"), F.lit(b""))
    return docs.select(F.col(f"`{id_column}`").alias("id"), text.alias("text"))


def corpus_counts(docs: DataFrame, train: F.Column, text_column: str = "text") -> DataFrame:
    """Counts over all documents, in one pass: rows of ``word`` (empty for the end of a text) or ``gram``
    (four bytes) with ``trained`` and ``all`` occurrences."""
    source = docs.select(
        F.coalesce(F.col(f"`{text_column}`").cast("binary"), F.lit(b"")).alias("text"),
        F.coalesce(train, F.lit(False)).alias("train"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple[Counter, Counter] = (Counter(), Counter())

        def words() -> pa.RecordBatch:
            rest = [w for w in known[0] if w not in known[1]]
            names = list(known[1]) + rest
            trained = list(known[1].values()) + [0] * len(rest)
            every = [t + known[0][w] for w, t in zip(names, trained, strict=True)]
            out = [pa.array(names, pa.binary()), pa.nulls(len(names), pa.int64()), pa.array(trained, pa.int64()), pa.array(every, pa.int64())]
            known[0].clear()
            known[1].clear()
            return pa.RecordBatch.from_arrays(out, names=["word", "gram", "trained", "all"])

        none = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        pending = none

        def merged(keys: np.ndarray, trained: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            own, at = np.unique(keys, return_inverse=True)
            both, place = np.unique(np.concatenate([pending[0], own]), return_inverse=True)
            sums = [np.bincount(at, trained, len(own)), np.bincount(at, minlength=len(own))]
            return both, *(np.bincount(place, np.concatenate([p, n]), len(both)).astype(np.int64) for p, n in zip(pending[1:], sums, strict=True))

        def tops() -> pa.RecordBatch:
            n = len(pending[0])
            return pa.RecordBatch.from_arrays(
                [pa.nulls(n, pa.binary()), pa.array(pending[0].astype(np.int64)), pa.array(pending[1]), pa.array(pending[2])],
                names=["word", "gram", "trained", "all"],
            )

        for batch in batches:
            for part in slices(batch, batch.column(0)):
                texts, train_of = part.column(0).to_pylist(), part.column(1).to_pylist()
                for text, trained in zip(texts, train_of, strict=True):
                    own = known[trained]
                    own.update(text.lower().split())
                    own[b""] += 1
                keys, sizes = grams(texts)
                pending = merged(keys, np.repeat(np.array(train_of), sizes))
                if len(known[0]) + len(known[1]) > _FLUSH:
                    yield words()
                if len(pending[0]) > 8 * _FLUSH:
                    yield tops()
                    pending = none
        yield words()
        yield tops()

    found = source.mapInArrow(run, "word binary, gram long, trained long, `all` long")
    return found.groupBy("word", "gram").agg(F.sum("trained").alias("trained"), F.sum("all").alias("all"))


def train_trie(counts: DataFrame) -> tuple[Trie, DataFrame]:
    """The trie of the counted four-byte grams, and ``gram, value`` of all that is not in it.

    What reaches the driver is bounded whatever the corpus: two-byte contexts (65536 at most), three-byte
    contexts of CONTEXT_SHARE or more and grams of GRAM_SHARE or more. The other contexts are evaluated
    where they are grouped, 256 symbols at most each.
    """
    spark = counts.sparkSession
    rows = counts.where(F.col("gram").isNotNull()).select("gram", F.col("trained").alias("n"), "all")
    rows = rows.withColumn("c", F.shiftright("gram", 8))
    pairs = rows.groupBy(F.col("gram").bitwiseAND(0xFFFFFF).alias("g")).agg(F.sum("n").alias("n")).where("n > 0").toArrow()
    total = float(rows.agg(F.sum("all")).first()[0] or 0)
    often = rows.groupBy("c").agg(F.sum("all").alias("m")).where(F.col("m") >= total * CONTEXT_SHARE).select("c")
    kept = rows.join(F.broadcast(often), "c", "left_semi").select("gram", "n").toArrow()
    array = lambda t, c: t[c].to_numpy().astype(np.int64)
    short = Short(array(pairs, "g"), array(pairs, "n"))
    three, n3 = _table(array(kept, "gram"), array(kept, "n"))
    shared = spark.sparkContext.broadcast(short)
    lists = rows.join(F.broadcast(often), "c", "left_anti").groupBy("c").agg(F.collect_list(F.struct("gram", "n", "all")).alias("own"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = None
        for batch in batches:
            tables = tables or shared.value.tables()
            for a in range(0, len(batch), 4096):
                own = batch.column(1).slice(a, 4096).flatten()
                key, n, every = (own.field(i).to_numpy() for i in range(3))
                contexts, counted = _table(key, n)
                logs = shared.value.rows(contexts, counted, tables)
                value = logs[np.searchsorted(contexts, key >> 8), key & 255].astype(float)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(every), pa.array(value)], names=["gram", "all", "value"])

    values = written(lists.mapInArrow(run, "gram long, `all` long, value double"), "ppm-grams")
    near = F.col("all") >= max(1.0, total * GRAM_SHARE)
    known = values.where(near).select("gram", "value").toArrow().sort_by("gram")
    keys, logs = array(known, "gram").astype(np.uint32), known["value"].to_numpy().astype(np.float32)
    return Trie(short.rows(three, n3), three, keys, logs), values.where(~near).select("gram", "value")


def score_texts(
    docs: DataFrame, train: F.Column, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Score every text by what the documents where ``train`` is true teach.

    ``score`` is the log10 probability of the text's bytes and its end under the trie; ``base_score``
    that of its words and end under smoothed word counts; with ``n_tokens``, ``n_known`` (trained on)
    and ``train_tokens``. Counts cover all documents. Words of at least WORD_SHARE of all tokens (so at
    most 1 / WORD_SHARE) are looked up where the text is read; the others are joined, one row per
    document and word. So are the symbols after three bytes that the trie does not hold.

    One row for each row of ``docs``; a null text counts as empty and has its end alone; rows that
    repeat are each scored; a null id stays null; other columns are not read.
    """
    spark = docs.sparkSession
    counts = written(corpus_counts(docs, train, text_column), "ppm-counts")
    words = counts.where(F.col("gram").isNull())
    total = words.agg(
        F.coalesce(F.sum("trained"), F.lit(0)).alias("n"),
        F.coalesce(F.sum("all"), F.lit(0)).alias("m"),
        F.count(F.when(F.col("trained") > 0, 1)).alias("v"),
    ).first()
    tokens = total["n"]
    spread = np.log10(tokens + total["v"] + 1.0)
    trained, rest = train_trie(counts)
    trie = spark.sparkContext.broadcast(trained)
    often = (F.col("all") >= max(1.0, total["m"] * WORD_SHARE)) & (F.octet_length("word") <= WORD_BYTES)
    table = words.where(often).select("word", "trained").toArrow()
    value = np.log10(table["trained"].to_numpy() + 1.0) - spread
    near = spark.sparkContext.broadcast(
        {w: (v, c) for w, v, c in zip(table["word"].to_pylist(), value.tolist(), table["trained"].to_pylist(), strict=True)}
    )
    source = _source(docs, id_column, text_column)
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = near.value
        for batch in batches:
            for part in slices(batch, batch.column(1)):
                texts = part.column(1).to_pylist()
                marks = pa.array([hash128(t) for t in texts], pa.binary())
                base, n_tokens, n_known = [], [], []
                score, far_row, far_gram, far_n = trie.value.log10(texts)
                code = far_gram.astype(">u4").tobytes()
                far_row, far_word, far_n = far_row.tolist(), [b" " + code[i : i + 4] for i in range(0, len(code), 4)], far_n.tolist()
                for i, text in enumerate(texts):
                    bag = Counter(text.lower().split())
                    bag[b""] = 1
                    total_log, known, size = 0.0, 0, 0
                    for w, n in bag.items():
                        size += n
                        hit = lookup.get(w)
                        if hit is None:
                            far_row.append(i)
                            far_word.append(w)
                            far_n.append(n)
                        else:
                            total_log += n * hit[0]
                            known += n * (hit[1] > 0)
                    base.append(total_log)
                    n_known.append(known)
                    n_tokens.append(size)
                rows = np.concatenate([np.arange(len(texts)), np.array(far_row, np.int64)]).astype(np.int64)
                gap = pa.nulls(len(far_row), pa.float64())
                none = pa.nulls(len(far_row), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(rows)),
                        marks.take(pa.array(rows)),
                        pa.concat_arrays([pa.nulls(len(texts), pa.binary()), pa.array(far_word, pa.binary())]),
                        pa.concat_arrays([pa.array(n_tokens, pa.int64()), pa.array(far_n, pa.int64())]),
                        pa.concat_arrays([pa.array(base, pa.float64()), gap]),
                        pa.concat_arrays([pa.array(n_known, pa.int64()), none]),
                        pa.concat_arrays([pa.array(score, pa.float64()), gap]),
                    ],
                    names=["id", "mark", "word", "n", "base", "known", "score"],
                )

    schema = f"id {kind}, mark binary, word binary, n long, base double, known long, score double"
    found = source.mapInArrow(run, schema)
    # A word or a gram this rare meets few documents, so its join cannot become hot. No word begins with a space.
    key = F.concat(F.lit(b" "), F.unhex(F.lpad(F.hex("gram"), 8, "0")))
    rare = words.where(~often).select(F.col("word").alias("w"), "trained", F.lit(None).cast("double").alias("value"))
    rare = rare.union(rest.select(key, F.lit(None).cast("long"), "value"))
    joined = found.join(rare, F.col("word") == F.col("w"), "left")
    far, gram = F.col("word").isNotNull(), F.col("value").isNotNull()
    c = F.coalesce("trained", F.lit(0))
    base = F.when(gram, 0.0).when(far, F.col("n") * (F.log10(c + F.lit(1.0)) - float(spread))).otherwise(F.col("base"))
    grouped = joined.groupBy("id", "mark").agg(
        F.sum(F.when(~far, F.col("n"))).alias("n_tokens"),
        F.sum(base).alias("base_score"),
        F.sum(F.when(far, F.when(c > 0, F.col("n")).otherwise(0)).otherwise(F.col("known"))).alias("n_known"),
        F.sum(F.when(gram, F.col("n") * F.col("value")).otherwise(F.col("score"))).alias("score"),
        F.count(F.when(~far, 1)).alias("copies"),
    )
    each = lambda name: (F.col(name) / F.col("copies")).cast("long").alias(name)
    return grouped.select(
        F.col("id").alias(id_column), each("n_tokens"), each("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"), (F.col("base_score") / F.col("copies")).alias("base_score"),
        (F.col("score") / F.col("copies")).alias("score"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("__copy"),
    ).drop("__copy")


def hash128(text: bytes) -> bytes:
    return hashlib.blake2b(text, digest_size=16).digest()


def ppm_digest(docs: DataFrame) -> DataFrame:
    remainder = fold(F.col("doc_id"), 7)
    scored = score_texts(docs, remainder != 2)
    return scored.withColumn("held_out", remainder == 2).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )
