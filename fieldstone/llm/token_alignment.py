"""Alignment of two tokenizers by merge-path partitioning: the token ends of both are merged in pieces of
equal work that diagonal searches cut out, and groups that cross a cut are stitched together."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldstone.llm.text import per_text, written

#: Steps of the merge in one piece.
PIECE = 1 << 16
#: Pairs of ids whose counts are sent to every task; the rest is joined.
BROADCAST_PAIRS = 1 << 20
_SLICE = 1 << 20  # bytes of text tokenized at once
_LINKS = 4_000_000  # links expanded at once
_SHIFT = 20  # a pair of ids is one number, B's in the lower bits; vocabularies have fewer than 2**20 tokens


# -- tokenizers --------------------------------------------------------------

# How byte-level vocabularies of this kind split a text into words, and the first bytes of
# characters beyond Latin letters. Up to there two engines give the same ids and the quicker one is taken;
# beyond, they may know different versions of Unicode, and only the tokenizers library is asked.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BEYOND_LATIN = re.compile(rb"[\xca-\xff]")


def _byte_of_symbol() -> dict[str, int]:
    """Bytes behind the symbols of a byte-level vocabulary: printable ones stand for themselves, the others
    for the characters from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """Both tokenizers, the bytes of every token, and the tokens as text."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        symbol = _byte_of_symbol()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(symbol[c] for c in token) if all(c in symbol for c in token) else token.encode()
        added = self.a.get_added_tokens_decoder()
        ranks = {token: i for i, token in enumerate(self.a_bytes) if i not in added}
        self.quick = tiktoken.Encoding("a", pat_str=_WORDS, mergeable_ranks=ranks, special_tokens={})
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:-1], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.a_size = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)
        # An id followed by what comes after it in a group: another of its side, or the side's end.
        a, b = ([str(i) for i in range(len(x))] for x in (self.a_bytes, self.b_bytes))
        self.written = [f"{i}{mark}".encode() for ids, marks in ((a, ",|"), (b, ",;")) for mark in marks for i in ids]

    def encode(self, texts: list[bytes]) -> list[tuple[list[int], list[int]]]:
        """Ids of both for each text; none where a text is empty or its tokens do not spell it."""
        strings = [t.decode("utf-8", "replace") for t in texts]
        left = [None if _BEYOND_LATIN.search(t) else self.quick.encode_ordinary(f" {s}") for t, s in zip(texts, strings, strict=True)]
        rest = [k for k, ids in enumerate(left) if ids is None]
        for k, e in zip(rest, self.a.encode_batch_fast([f" {strings[k]}" for k in rest], add_special_tokens=False), strict=True):
            left[k] = e.ids
        right = self.b.encode(strings, num_threads=1)
        out = []
        for text, a, b in zip(texts, left, right, strict=True):
            whole = b" " + text
            same = text and b"".join(map(self.a_bytes.__getitem__, a)) == whole == b"".join(map(self.b_bytes.__getitem__, b))
            out.append((a, b) if same else ([], []))
        return out


@lru_cache(maxsize=2)
def _pair(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


# -- merging -----------------------------------------------------------------


def diagonal_cuts(a: np.ndarray, b: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the merge path of two sorted arrays (a first where they are equal) crosses every ``piece``-th
    diagonal: how many of ``a`` and of ``b`` lie before, found by one binary search on each diagonal."""
    steps = len(a) + len(b)
    diagonal = np.append(np.arange(0, steps, piece), steps)
    low, high = np.maximum(0, diagonal - len(b)), np.minimum(diagonal, len(a))
    while (low < high).any():
        middle = (low + high) // 2
        open_ = low < high
        i, j = middle[open_], (diagonal - middle - 1)[open_]
        taken = a[i] <= b[j]  # then the path takes a[middle] before this diagonal
        low[open_] = np.where(taken, i + 1, low[open_])
        high[open_] = np.where(taken, high[open_], i)
    return low, diagonal - low


def piece_overlaps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One piece: for the end of each A token, the place of the B token that overlaps it there, and whether
    that ends there as well. Overlaps that end inside an A token border no group."""
    j = np.searchsorted(b, a)
    both = np.zeros(len(a), bool)
    inside = j < len(b)
    both[inside] = b[j[inside]] == a[inside]
    return j, both


def merged_groups(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens of A and of B end at or before each common end: the borders of the groups.

    Pieces are merged independently of each other. A cut between two equal ends leaves one in each piece;
    such pieces are stitched at that end.
    """
    cut_a, cut_b = diagonal_cuts(a, b, piece)
    borders_a, borders_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range(len(cut_a) - 1):
        i0, i1, j0, j1 = cut_a[k], cut_a[k + 1], cut_b[k], cut_b[k + 1]
        if 0 < i0 and j0 < len(b) and b[j0] == a[i0 - 1] and j0 < j1:
            borders_a.append(np.array([i0]))
            borders_b.append(np.array([j0 + 1]))
        j, both = piece_overlaps(a[i0:i1], b[j0:j1])
        borders_a.append(i0 + np.flatnonzero(both) + 1)
        borders_b.append(j0 + j[both] + 1)
    return np.concatenate(borders_a), np.concatenate(borders_b)


def _links(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, owner: np.ndarray) -> Iterator[np.ndarray]:
    """Every A-B pair of each group, as owner and pair of ids in one number, some groups at a time."""
    total = np.cumsum(na * nb)
    end_a, begin_b = np.cumsum(na), np.cumsum(nb) - nb
    g = 0
    while g < len(na):
        stop = max(g + 1, int(np.searchsorted(total, (total[g - 1] if g else 0) + _LINKS, "right")))
        times = np.repeat(nb[g:stop], na[g:stop])  # links of each A token
        left = a[end_a[g] - na[g] : end_a[stop - 1]] << _SHIFT | np.repeat(owner[g:stop], na[g:stop]) << 2 * _SHIFT
        ends = np.cumsum(times)
        at = np.arange(ends[-1]) + np.repeat(np.repeat(begin_b[g:stop], na[g:stop]) - (ends - times), times)
        yield np.repeat(left, times) | b[at]
        g = stop


def aligned(pair: Pair, texts: list[bytes], piece: int = PIECE) -> list[tuple]:
    """Of each text: numbers of A and B tokens, groups and links, the groups as text, and its different pairs
    of linked ids with how often each is linked."""
    tokens = pair.encode(texts)
    na, nb = (np.fromiter((len(t[k]) for t in tokens), np.int64, len(tokens)) for k in (0, 1))
    a, b = (np.fromiter(chain.from_iterable(t[k] for t in tokens), np.int64, int(n.sum())) for k, n in ((0, na), (1, nb)))
    # Laid end to end, texts end where tokens of both sides end, so no group spans two of them.
    ga, gb = merged_groups(np.cumsum(pair.a_size[a]), np.cumsum(pair.b_size[b]), piece)
    own_a, own_b = np.diff(ga, prepend=0), np.diff(gb, prepend=0)
    last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    last_a[ga - 1] = last_b[gb - 1] = True
    codes = np.empty(len(a) + len(b), np.int64)
    size = len(pair.a_size)
    codes[np.arange(len(a)) + np.repeat(gb - own_b, own_a)] = a + size * last_a
    codes[np.arange(len(b)) + np.repeat(ga, own_b)] = 2 * size + b + len(pair.b_size) * last_b
    codes = codes.tolist()
    ends_a, ends_b = np.cumsum(na), np.cumsum(nb)
    n_groups = np.diff(np.searchsorted(ga, ends_a, "right"), prepend=0)
    owner = np.repeat(np.arange(len(texts)), n_groups)
    links = np.zeros(len(texts), np.int64)
    np.add.at(links, owner, own_a * own_b)
    owners, pairs, times = [], [], []
    for linked in _links(a, b, own_a, own_b, owner):
        linked.sort()
        first = np.flatnonzero(np.concatenate([[True], linked[1:] != linked[:-1]]))
        times.append(np.diff(np.append(first, len(linked))))
        owners.append(linked[first] >> 2 * _SHIFT)
        pairs.append(linked[first] & ((1 << 2 * _SHIFT) - 1))
    whose, which, often = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (owners, pairs, times))
    bounds = np.searchsorted(whose, np.arange(len(texts) + 1))
    out, start = [], 0
    for k in range(len(texts)):
        stop = int(ends_a[k] + ends_b[k])
        own, count = which[bounds[k] : bounds[k + 1]], often[bounds[k] : bounds[k + 1]]
        if len(owners) > 1:  # a text whose links came in several parts
            own, at = np.unique(own, return_inverse=True)
            count = np.bincount(at, count, len(own)).astype(np.int64)
        shown = b"".join(map(pair.written.__getitem__, codes[start:stop]))[:-1]
        out.append((int(na[k]), int(nb[k]), int(n_groups[k]), int(links[k]), shown, own, count))
        start = stop
    return out


# -- tables ------------------------------------------------------------------


def _packed(own: np.ndarray, count: np.ndarray) -> bytes:
    """Sorted pairs and their times in bytes, planes of equal weight together, which compresses well."""
    gaps = np.diff(own, prepend=0).view(np.uint8).reshape(-1, 8)
    return np.ascontiguousarray(gaps.T).tobytes() + np.ascontiguousarray(count.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes()


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // 12
    gaps = np.frombuffer(data, np.uint8, 8 * n).reshape(8, n).T
    times = np.frombuffer(data, np.uint8, 4 * n, 8 * n).reshape(4, n).T
    return np.cumsum(np.ascontiguousarray(gaps).view(np.int64).ravel()), np.ascontiguousarray(times).view(np.uint32).ravel().astype(np.int64)


def _parts(texts: list[bytes]) -> Iterator[list[bytes]]:
    held, size = [], 0
    for text in texts:
        if held and size + len(text) > _SLICE:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    yield held


def align_texts(
    docs: DataFrame, a_path: str, b_path: str, id_column: str = "doc_id", text_column: str = "text", groups: bool = True
) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs`` and, if wanted, ``groups`` of every row.

    A (a byte-level vocabulary for the tokenizers library) encodes a space and the text, B (a
    sentencepiece model) the text. A group is cut wherever tokens of both end; it links every A token in it
    with every B token. ``groups`` shows the ids, ``a1,a2|b1;a3|b2``; ``pairs`` packs the different linked
    pairs of ids. A text that is null or empty, or that its tokens do not spell, has no tokens. Null ids and
    repeated rows are kept; other columns are not read.
    """

    def run(texts: list[bytes]) -> list[pa.Array]:
        pair = _pair(a_path, b_path)
        rows = [row for part in _parts(texts) for row in aligned(pair, part)]
        out = [pa.array([r[k] for r in rows], pa.int64()) for k in range(4)]
        out.append(pa.array([sha256(r[4]).hexdigest() if r[0] else "" for r in rows], pa.string()))
        out.append(pa.array([_packed(r[5], r[6]) for r in rows], pa.binary()))
        return [*out, pa.array([r[4].decode() for r in rows], pa.string())] if groups else out

    columns = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary"
    return per_text(docs, id_column, text_column, run, columns + ", groups string" * groups)


def pair_counts(found: DataFrame) -> DataFrame:
    """``pair, count, best``: in how many documents each pair of ids is linked, and whether no other pair of
    its A id is in more. A task adds up its documents before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [_unpacked(x)[0] for x in batch.column(0).to_pylist()]
            keys, counts = np.unique(np.concatenate([np.zeros(0, np.int64), *pairs]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts, pa.int64())], names=["pair", "n"])

    counted = found.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("count"))
    highest = F.max("count").over(W.partitionBy(F.shiftright("pair", _SHIFT)))  # as many rows as B has ids at most
    return counted.withColumn("best", F.col("count") == highest)


def _frequent(counts: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The pairs of a power of two documents or more that are at most ``most``, and the others."""
    level = F.floor(F.log2("count")).cast("int")
    total, least = 0, 0
    for row in sorted(counts.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):  # 64 rows at most
        total += row["count"]
        if total > most:
            least = 1 << (row["level"] + 1)
            break
    return counts.where(F.col("count") >= least), counts.where(F.col("count") < least)


def alignment_digest(
    docs: DataFrame,
    a_path: str,
    b_path: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    broadcast_pairs: int = BROADCAST_PAIRS,
) -> DataFrame:
    """Each document's alignment held against the corpus: ``doc_id, n_a, n_b, n_groups, n_links, n_best,
    count_sum, groups_sha256``.

    A pair of ids counts in how many documents it is linked; ``count_sum`` adds that up over a document's
    links, ``n_best`` counts the links whose pair has the highest count of its A id. Texts are tokenized once.
    The counts of the most frequent pairs, at most ``broadcast_pairs``, are sent to every task; links of the
    others are joined with theirs. Rows as in ``align_texts``.
    """
    found = align_texts(docs, a_path, b_path, id_column, text_column, groups=False)
    found = written(found.withColumn("__row", F.monotonically_increasing_id()), "aligned", compression="zstd")
    counts = written(pair_counts(found), "pair_counts")
    frequent, rest = _frequent(counts, broadcast_pairs)
    table = frequent.orderBy("pair").toArrow()  # broadcast_pairs rows at most
    keys, values = table["pair"].to_numpy(), table["count"].to_numpy()
    best = table["best"].to_numpy(zero_copy_only=False)
    sent = found.sparkSession.sparkContext.broadcast((keys, values, best))

    def known(data: bytes) -> tuple:
        keys, values, best = sent.value
        own, times = _unpacked(data)
        at = np.minimum(np.searchsorted(keys, own), max(len(keys) - 1, 0))
        hit = keys[at] == own if len(keys) else np.zeros(len(own), bool)
        return own, times, at[hit], hit, values, best

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column(batch.num_columns - 1).to_pylist():
                _, times, at, hit, values, best = known(data)
                rows.append((int(times[hit][best[at]].sum()), int((times[hit] * values[at]).sum())))
            added = [pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *added], names=[*batch.schema.names[:-1], "n_best", "count_sum"])

    plain = [c for c in found.columns if c != "pairs"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.select(*plain).schema)
    out = found.select(*plain, "pairs").mapInArrow(sums, f"{schema}, n_best long, count_sum long")
    if not rest.isEmpty():

        def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    own, times, _, hit, _, _ = known(data)
                    if not hit.all():
                        left = own[~hit]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(left), row)), pa.array(left), pa.array(times[~hit])], names=["__of", "pair", "times"]
                        )

        links = found.select("__row", "pairs").mapInArrow(others, "__of long, pair long, times long").join(rest, "pair")
        more = links.groupBy("__of").agg(
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"),
            F.sum(F.col("times") * F.col("count")).alias("more_sum"),
        )
        out = out.join(more, F.col("__row") == F.col("__of"), "left").withColumns(
            {
                "n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)),
                "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0)),
            }
        )
    return out.select(id_column, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
