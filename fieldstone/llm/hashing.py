"""Hashes of all words of a batch of texts at once."""

from __future__ import annotations

import numpy as np

from fieldstone.llm.text import mix

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)


def powers(n: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """``base`` (odd) to the powers 0 to n - 1, modulo 2**64."""
    out = np.full(max(n, 1), np.uint64(base), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words between ASCII white space: hash and first byte of each (in the texts laid end to end, one
    byte apart), the first word of each text (and their number), and where each text begins (and ends)."""
    joined = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    begins = np.concatenate([[1], 1 + np.cumsum(sizes)])
    gap = _SPACE[joined]
    starts = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
    if not len(starts):
        return np.zeros(0, np.uint64), starts, np.zeros(len(texts) + 1, np.int64), begins
    ends = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
    offset = np.arange(len(joined), dtype=np.int64)
    offset[starts[0] :] -= np.repeat(starts, np.diff(starts, append=len(joined)))
    offset[gap] = 0
    value = _BYTES[joined]
    value *= powers(int((ends - starts).max()))[offset]
    value[gap] = 0
    hashes = mix(np.add.reduceat(value, starts) + (ends - starts).astype(np.uint64) * _STEP)
    return hashes, starts, np.searchsorted(starts, begins), begins


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """The distinct shingles of ``size`` words of each text, sorted; of a text with fewer words, the
    whole as one; of a text without words, none."""
    words, _, first, _ = word_hashes([t.lower() for t in texts])
    factor = powers(size + 1, 0xA24BAED4963EE407)
    n = max(0, len(words) - size + 1)
    rows = np.zeros(n, np.uint64)
    for i in range(size):
        rows += words[i : i + n] * factor[i]
    rows = mix(rows + factor[size])
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(rows[a : b - size + 1]))
        elif b > a:
            out.append(mix((words[a:b] * factor[: b - a]).sum(keepdims=True) + factor[b - a : b - a + 1] * factor[size : size + 1]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
