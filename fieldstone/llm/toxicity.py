"""Toxicity by multiple-instance learning: a sentence has a score, a document's score is the
noisy-or of its sentences, and only documents have labels."""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections import Counter
from dataclasses import dataclass
from functools import cached_property
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldstone.llm.text import fold, per_text

#: Bounds of the training sample: documents of each label, and bytes of text in all.
MAX_PER_LABEL = 2000
MAX_BYTES = 16 << 20
#: Of a document with more than this part of MAX_BYTES a hashed set of its sentences is learnt from.
LONG_PART = 64

#: Words of a sentence at most; where none ends for longer, it is cut.
LONGEST = 32
_WORD = re.compile(rb"[^ ]+")
# Words as everywhere, A-Z lowered; the ends of sentences stay apart from other separators.
_BAGS = bytes(
    10 if b in b".!?\n\r" else b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256)
)


def features(word: bytes) -> list[bytes]:
    """A word and its beginnings, since endings vary; the mark tells a beginning from a whole word."""
    return [word, *(b"^" + word[:k] for k in (4, 5, 6) if len(word) > k)]


class _Known(dict):
    """Weights of whole words, found once each and forgotten when too many."""

    def __init__(self, weights: dict[bytes, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: bytes) -> float:
        if len(self) > 500_000:
            self.clear()
        total = self[word] = sum(self.weights.get(f, 0.0) for f in features(word))
        return total


@dataclass
class ToxicModel:
    """Weights of features, and the score of a sentence without any of them."""

    weights: dict[bytes, float]
    bias: float

    @cached_property
    def known(self) -> _Known:
        return _Known(self.weights)

    def sentences(self, text: bytes) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's score, and place (bytes) and score of each sentence with a weighted feature."""
        weight = self.known.__getitem__
        calm = math.log1p(-_sigmoid(self.bias))
        clean, out, at, n = 0.0, [], 0, 0
        for bag in text.translate(_BAGS).split(b"\n"):
            words = bag.split()
            for i in range(0, len(words), LONGEST):
                n += 1
                total = sum(map(weight, set(words[i : i + LONGEST])))
                if total == 0.0:
                    clean += calm
                else:
                    p = _sigmoid(self.bias + total)
                    clean += math.log1p(-p)
                    out.append((*_place(bag, at, i, len(words)), p))
            at += len(bag) + 1
        return -math.expm1(clean if n else calm), out


def _place(bag: bytes, at: int, first: int, words: int) -> tuple[int, int]:
    """Bytes of the sentence that begins with the given word of a bag."""
    if words <= LONGEST:
        return at, at + len(bag)
    found = list(islice(_WORD.finditer(bag), first, first + LONGEST))
    return at + found[0].start(), at + found[-1].end()


#: Bias of a model that learnt nothing: no text has sentences enough to reach a half.
UNTRAINED = -30.0


def _sigmoid(z: float) -> float:
    return 1e-12 + (1 - 2e-12) / (1 + math.exp(-max(-30.0, min(30.0, z))))


def some_sentences(text: bytes, most: int) -> bytes:
    """The text, or of a longer one different sentences of the smallest hash, ``most`` bytes at most."""
    if len(text) <= most:
        return text
    bags = [b.split() for b in text.translate(_BAGS).split(b"\n")]
    cut = {b" ".join(b[i : i + LONGEST]) for b in bags for i in range(0, len(b), LONGEST)}
    out, size = [], 0
    for said in sorted(cut, key=lambda c: (zlib.crc32(c), c)):
        if size + len(said) < most:
            out.append(said)
            size += len(said) + 1
    return b"\n".join(out)


def fit_toxic(texts: list[bytes], labels: list[int], epochs: int = 120, shrink: float = 3e-4) -> ToxicModel:
    """Full-batch proximal gradient steps on the log-loss of the documents' noisy-or."""
    ids: dict[bytes, int] = {}
    own: dict[bytes, array] = {}
    flat, sizes, doc = array("i"), array("i"), array("i")
    spread: Counter = Counter()  # documents of each feature
    for d, text in enumerate(texts):
        begin = len(flat)
        bags = [b.split() for b in text.translate(_BAGS).split(b"\n")]
        for bag in [set(b[i : i + LONGEST]) for b in bags for i in range(0, len(b), LONGEST)] or [set()]:
            before = len(flat)
            for w in sorted(bag):
                if w not in own:
                    own[w] = array("i", [ids.setdefault(f, len(ids)) for f in features(w)])
                flat.extend(own[w])
            sizes.append(len(flat) - before)
            doc.append(d)
        spread.update(set(flat[begin:]))
    n = len(sizes)
    doc_of = np.array(doc, np.int32)
    word_of, sent_of = np.array(flat, np.int32), np.repeat(np.arange(n, dtype=np.int32), sizes)
    # What fewer than five documents have tells nothing that holds elsewhere.
    often = np.zeros(len(ids), bool)
    often[[f for f, m in spread.items() if m >= 5]] = True
    keep = often[word_of]
    word_of, sent_of = word_of[keep], sent_of[keep]
    del flat, own, spread, keep
    y = np.array(labels, float)
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    cost = np.where(y > 0, 0.25 / share, 0.75 / (1 - share)) / len(y)  # clean documents are the many
    w, b = np.zeros(len(ids)), -9.5
    gw, gb = np.full(len(ids), shrink**2), 1e-8
    for _ in range(epochs):
        z = b + np.bincount(sent_of, w[word_of], minlength=n)
        p = 1e-9 + (1 - 2e-9) / (1 + np.exp(-np.clip(z, -30, 30)))
        clean = np.bincount(doc_of, np.log1p(-p), minlength=len(y))
        whole = np.clip(-np.expm1(clean), 1e-9, 1)
        dz = (cost * np.where(y > 0, -(1 - whole) / whole, 1.0))[doc_of] * p
        dw, db = np.bincount(word_of, dz[sent_of], minlength=len(ids)), dz.sum()
        # Adagrad with an L1 penalty: a word whose gradient stays within the penalty keeps no weight.
        step = np.where(w != 0, dw + shrink * np.sign(w), np.sign(dw) * np.maximum(np.abs(dw) - shrink, 0))
        gw += step**2
        gb += db**2
        moved = w - 0.5 * step / np.sqrt(gw)
        w = np.where(w * moved < 0, 0, moved)
        b -= 0.5 * db / np.sqrt(gb)
    names = list(ids)
    return ToxicModel({names[i]: float(w[i]) for i in np.flatnonzero(w)}, float(b))


def train_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    max_per_label: int = MAX_PER_LABEL,
    max_bytes: int = MAX_BYTES,
) -> ToxicModel:
    """Fit on labelled rows whose crc32(doc_id) mod 5 is not 0.

    The sample holds at most ``max_per_label`` documents of each label, those of the smallest id hash,
    and at most ``max_bytes`` of text; what doesn't fit is passed over, what comes after it is not. A
    document longer than a LONG_PART of ``max_bytes`` takes part with so many bytes of its sentences.
    Rows with a null id, label or text are not learnt from, repeated rows once. Without documents of
    both labels nothing is learnt, and the model rejects nothing.
    """
    spark, most = docs.sparkSession, max(1, max_bytes // LONG_PART)
    usable = labels.where(F.col("toxic").isin(0, 1) & (fold(F.col("doc_id"), 5) > 0)).select(
        "doc_id", F.col("toxic").cast("int").alias("y"), F.xxhash64("doc_id").alias("h")
    )
    picked = [usable.where(F.col("y") == y).orderBy("h", "doc_id").limit(max_per_label) for y in (0, 1)]
    chosen = F.broadcast(picked[0].union(picked[1]))  # at most 2 * max_per_label rows of three numbers
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("t")).where(F.col("t").isNotNull())
    rows = rows.join(chosen, "doc_id").withColumn("mark", F.xxhash64("t"))
    keys = ["doc_id", "y", "mark"]
    sizes = rows.select("h", *keys, F.least(F.octet_length("t").cast("long"), F.lit(most)).alias("n")).distinct()
    fits, total = [], 0
    for r in sizes.orderBy("h", *keys).limit(2 * max_per_label).collect():  # numbers only
        if total + r["n"] <= max_bytes:
            total += r["n"]
            fits.append((r["doc_id"], r["y"], r["mark"]))
    if len({y for _, y, _ in fits}) < 2:
        return ToxicModel({}, UNTRAINED)
    fitting = F.broadcast(spark.createDataFrame(fits, rows.select(*keys).schema))

    @F.pandas_udf("binary")
    def bounded(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: some_sentences(bytes(t), most))

    sample = rows.join(fitting, keys).select("h", *keys, bounded("t").alias("t")).dropDuplicates(keys).collect()
    sample.sort(key=lambda r: (r["h"], r["doc_id"], r["y"], r["mark"]))
    return fit_toxic([bytes(r["t"]) for r in sample], [r["y"] for r in sample])


def score_toxicity(
    docs: DataFrame, model: ToxicModel, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Score every text: ``score`` of the document, and ``offending`` sentences (start, end in code
    points, text, score) whose own score is at least a half.

    One row for each row of ``docs``, in one pass without a shuffle. A null or empty text scores as one
    sentence without known words; rows that repeat are each scored; a null id stays null; other columns
    are not read.
    """
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("text", pa.string()), ("score", pa.float64())])

    def run(texts: list[bytes]) -> list[pa.Array]:
        scores, places = [], []
        for text in texts:
            score, found = model.sentences(text)
            scores.append(score)
            rows = []
            for a, b, p in found:
                if p >= 0.5:
                    said = text[a:b].decode("utf-8", "replace")
                    start = len(text[:a].decode("utf-8", "replace"))
                    rows.append({"start": start, "end": start + len(said), "text": said, "score": p})
            places.append(rows)
        return [pa.array(scores, pa.float64()), pa.array(places, pa.list_(span))]

    return per_text(
        docs, id_column, text_column, run,
        "score double, offending array<struct<start:bigint,end:bigint,text:string,score:double>>",
    )


def toxic_column(model: ToxicModel, text: F.Column) -> F.Column:
    """The document's score as a column, to filter by; null counts as empty."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: model.sentences(t)[0]).astype(float)

    return score(F.coalesce(text.cast("binary"), F.lit(b"")))


def toxicity_digest(scored: DataFrame) -> DataFrame:
    return scored.select(
        "doc_id",
        (fold(F.col("doc_id"), 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("offending").cast("long").alias("n_offending"),
    )
