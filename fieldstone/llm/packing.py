"""Packing: token streams cut into sequences by order-preserving dynamic programming."""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fieldstone.llm.text import slices

CAPACITY = 4096
END_ID = 2
BLOCK_TOKENS = 1 << 21  # tokens planned at a time
SENTENCE_CUT, LOOSE_CUT = 2, 24  # what a cut inside a document costs, in tokens of padding
LOOSE_STEP = 64  # how far apart cuts are tried where no sentence ends
CACHED_WORDS = 800_000


class WordIds:
    """Token ids of texts, word by word.

    The vocabulary's pre-tokenizer never joins characters across white space, so the ids of a text are
    those of its words in a row, and a word is encoded once as long as it stays in the cache.
    """

    def __init__(self, definition: str):
        self.tokenizer = Tokenizer.from_str(definition)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        size = max(vocabulary.values()) + 1
        self.word_end = np.zeros(size, bool)
        self.sentence_end = np.zeros(size, bool)
        for token, i in vocabulary.items():
            self.word_end[i] = token.endswith("</w>")
            bare = token.removesuffix("</w>")
            self.sentence_end[i] = bool(bare) and bare[-1] in ".!?" and not any(c.isalnum() for c in bare)
        self.known: dict[bytes, bytes] = {}

    def _learn(self, words: set[bytes]) -> None:
        if len(self.known) + len(words) > CACHED_WORDS:
            self.known.clear()
        known, simple, other, ended = self.known, set(), set(), []
        for w in words:
            stem = w[:-1] if w[-1:] in (b".", b",") else w
            if stem and stem.decode("utf-8", "replace").isalpha():
                if stem is not w:
                    ended.append(w)
                    if w[-1:] not in known:
                        other.add(w[-1:])
                if stem not in known:
                    simple.add(stem)
            else:
                other.add(w)
        plain = list(simple)
        for at in range(0, len(plain), 4096):
            part = plain[at : at + 4096]
            ids = np.array(self._encode([b" ".join(part)])[0], "<u4")
            ends = np.flatnonzero(self.word_end[ids]) + 1
            if len(ends) == len(part):
                raw, start = ids.tobytes(), 0
                for w, end in zip(part, (4 * ends).tolist(), strict=True):
                    known[w] = raw[start:end]
                    start = end
            else:  # a word of several pre-tokens among them
                other.update(part)
        rest = list(other)
        for w, ids in zip(rest, self._encode(rest), strict=True):
            known[w] = np.array(ids, "<u4").tobytes()
        for w in ended:
            known[w] = known[w[:-1]] + known[w[-1:]]

    def _encode(self, words: list[bytes]) -> list[list[int]]:
        texts = [w.decode("utf-8", "replace") for w in words]
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def of(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        split = [t.lower().split() for t in texts]  # lowers A-Z only; the tokenizer lowers everything
        missing = set().union(*split).difference(self.known)
        if missing:
            if len(self.known) + len(missing) > CACHED_WORDS:
                missing = set().union(*split)
            self._learn(missing)
        get = self.known.__getitem__
        return [b"".join(map(get, words)) for words in split]


_ENCODERS: dict[int, WordIds] = {}


def _encoder(definition: str) -> WordIds:
    key = zlib.crc32(definition.encode())
    if key not in _ENCODERS:
        _ENCODERS[key] = WordIds(definition)
    return _ENCODERS[key]


def plan_cuts(points: np.ndarray, costs: np.ndarray, capacity: int = CAPACITY) -> list[int]:
    """Where to cut a stream: the chosen ``points``, from the first (0) to the last (its length).

    A sequence between two points holds at most ``capacity`` tokens. It costs its padding (none at a
    power of two) and the cost of the cut at its end. Without powers of two the cheapest start of a
    sequence that ends at a point is the smallest ``best + position`` in the window, which a monotone
    queue keeps at hand; starts half and a quarter of the capacity before the point, which are powers of
    two, are tried beside it.
    """
    at, cost = points.tolist(), costs.tolist()
    powers = [capacity >> 1, capacity >> 2]
    place = {p: i for i, p in enumerate(at)}
    best, back = [0.0] * len(at), [0] * len(at)
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])
    for j in range(1, len(at)):
        p = at[j]
        low = p - capacity
        while at[queue[0][1]] < low:
            queue.popleft()
        value, i = queue[0]
        value += capacity - p
        for size in powers:
            k = place.get(p - size)
            if k is not None and best[k] < value:
                value, i = best[k], k
        value += cost[j]
        best[j], back[j] = value, i
        key = value + p
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    cuts = [len(at) - 1]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return [at[i] for i in reversed(cuts)]


def cut_points(ids: np.ndarray, ends: np.ndarray, sentence_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where a stream may be cut, with costs: ends of documents, ends of sentences, and every
    LOOSE_STEP tokens in between where neither is near."""
    total = len(ids)
    cost = np.full(total + 1, 255, np.uint8)  # of a cut at each place; 255: none is tried
    tail = total - (1 << np.arange(7, 12))
    cost[tail[tail > 0]] = LOOSE_CUT
    cost[np.flatnonzero(sentence_end[ids]) + 1] = SENTENCE_CUT
    cost[ends] = 0
    cost[0] = 0
    marks = np.flatnonzero(cost != 255)
    for i in np.flatnonzero(np.diff(marks) > 2 * LOOSE_STEP):
        cost[marks[i] + LOOSE_STEP : marks[i + 1] : LOOSE_STEP] = LOOSE_CUT
    points = np.flatnonzero(cost != 255)
    return points, cost[points].astype(float)


_PIECE = pa.schema([
    ("row", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.list_(pa.int32())),
])


def _pieces(raw: list[bytes], sentence_end: np.ndarray, first_sequence: int, capacity: int) -> tuple[list[tuple], int]:
    """Pieces of one block of documents, as rows of _PIECE, and the next free sequence."""
    stream = b"".join(raw)
    ids = np.frombuffer(stream, "<u4")
    ends = np.cumsum([len(r) // 4 for r in raw])
    cuts = plan_cuts(*cut_points(ids, ends, sentence_end), capacity)
    out, doc, begin = [], 0, 0
    for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        at = a
        while at < b:
            end = int(ends[doc])
            stop = min(b, end)
            out.append((doc, at - begin, stop - at, zlib.crc32(stream[4 * at : 4 * stop]), end - begin,
                        first_sequence + n, at - a, (at, stop)))
            at = stop
            if stop == end:
                doc, begin = doc + 1, end
    return out, first_sequence + len(cuts) - 1


def pack(
    docs: DataFrame,
    vocabulary: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    capacity: int = CAPACITY,
    with_ids: bool = False,
) -> DataFrame:
    """Pack every document into sequences of at most ``capacity`` tokens.

    Documents keep the order of their partition and are planned in blocks of about BLOCK_TOKENS tokens,
    so no block depends on another and memory stays bounded. One row per piece: the id, ``start``,
    ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id`` (unique; ascending within a partition),
    ``offset``, and the piece's token ids if ``with_ids``. ``vocabulary`` is the file of a tokenizer; its
    content, not its path, goes to the executors.

    A null text counts as empty: one piece that holds the end id. Rows that repeat are packed each; a
    null id stays null; an empty table gives no rows; other columns are not read.
    """
    with open(vocabulary, encoding="utf-8") as file:
        definition = docs.sparkSession.sparkContext.broadcast(file.read())
    source = docs.select(
        F.col(f"`{id_column}`").alias("id"),
        F.coalesce(F.col(f"`{text_column}`").cast("binary"), F.lit(b"")).alias("text"),
    )
    kind = source.schema["id"].dataType.simpleString()
    end = np.array([END_ID], "<u4").tobytes()
    columns = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(definition.value)
        sequence = TaskContext.get().partitionId() << 32
        kept: list[pa.Array] = []
        raw: list[bytes] = []
        size = 0

        def block() -> pa.RecordBatch:
            nonlocal sequence, size
            rows, sequence = _pieces(raw, encoder.sentence_end, sequence, capacity)
            ids = pa.concat_arrays(kept).take(pa.array([r[0] for r in rows], pa.int64()))
            arrays = [pa.array([r[i] for r in rows], pa.int64()) for i in range(1, 7)]
            if with_ids:
                stream = np.frombuffer(b"".join(raw), "<u4").astype(np.int32)
                arrays.append(pa.array([stream[r[7][0] : r[7][1]] for r in rows], pa.list_(pa.int32())))
            kept.clear()
            raw.clear()
            size = 0
            return pa.RecordBatch.from_arrays([ids, *arrays], names=["id", *columns, *["ids"] * with_ids])

        for batch in batches:
            for part in slices(batch, batch.column(1)):
                encoded = [ids + end for ids in encoder.of(part.column(1).to_pylist())]
                kept.append(part.column(0))
                raw += encoded
                size += sum(map(len, encoded)) // 4
                if size >= BLOCK_TOKENS:
                    yield block()
        if raw:
            yield block()

    schema = f"id {kind}, " + ", ".join(f"`{c}` long" for c in columns) + ", ids array<int>" * with_ids
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_column)
