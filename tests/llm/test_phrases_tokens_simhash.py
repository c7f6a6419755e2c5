"""Collocations, token alignment and SimHash components against plain versions."""

import random
from collections import Counter, defaultdict
from hashlib import sha256
from itertools import combinations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldstone.llm import collocations
from fieldstone.llm.collocations import cut_score, mine_collocations
from fieldstone.llm.simhash_join import fingerprint, near_links, simhash_components, simhash_digest
from fieldstone.llm.text import BATCH
from fieldstone.llm.token_alignment import Pair, alignment_digest, align_texts, diagonal_cuts, merged_groups

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LANG = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType())]
)


# -- collocations ------------------------------------------------------------


def plain_collocations(rows, least, longest=5, keep=2000, cover=100):
    import re

    counts, total, where = defaultdict(Counter), Counter(), {}
    for doc, text, lang in rows:
        lang, at = lang if lang is not None else "und", 0
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for n in range(1, longest + 1):
                for i in range(len(words) - n + 1):
                    phrase = tuple(words[i : i + n])
                    counts[lang][phrase] += 1
                    place = (doc is None, doc if doc is not None else 0, at + i)
                    where[lang, phrase] = min(where.get((lang, phrase), place), place)
            at += len(words)
    out = []
    for lang, seen in counts.items():
        found = {p: a for p, a in seen.items() if len(p) > 1 and a >= least}
        rest = []
        for p, a in found.items():
            inside = any(
                100 * b >= cover * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
                for q, b in found.items() if len(q) > len(p)
            )
            if not inside:
                score, k = min((1000 * a * total[lang] // (seen[p[:k]] * seen[p[k:]]), k) for k in range(1, len(p)))
                rest.append((-score, -a, " ".join(p).encode(), seen[p[:k]], seen[p[k:]], p))
        for rank, (score, a, phrase, left, right, p) in enumerate(sorted(rest)[:keep], 1):
            none, doc, word = where[lang, p]
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score, None if none else doc, None if none else word))
    return sorted(out)


def prose(seed, n, size=60):
    r = random.Random(seed)
    words = ["Aa", "bb", "cc", "dd", "été", "ff", "x\ty", "gg  hh", "ii.", "jj,kk", "ll\n", "日本", "mm!", "_nn"]
    weights = [9, 8, 7, 6, 5, 4, 2, 2, 2, 1, 1, 2, 1, 1]
    return [" ".join(r.choices(words, weights, k=r.randint(0, size))) for _ in range(n)]


@pytest.mark.parametrize("bits", [64, 10])
def test_collocations(spark, bits):
    """With ten bits fingerprints collide all the time, and counts stay exact."""
    texts = prose(1, 60)
    rows = [(i, t, ("en", "fr", None)[i % 3]) for i, t in enumerate(texts)]
    rows += [(7, texts[7], "fr"), (None, texts[3], "en"), (None, None, None), (90, "", "en"), (91, " . ", "de"), (5, "bb cc dd", "en")]
    df = spark.createDataFrame(rows, LANG).repartition(3).withColumns({c: F.lit(c) for c in ("n", "a", "phrase", "word", "fp", "rank")})
    for least, keep, cover in ((2, 2000, 100), (3, 5, 80)):
        got = sorted(tuple(r) for r in mine_collocations(df, least, 5, keep, cover, hash_bits=bits).collect())
        assert got == plain_collocations(rows, least, 5, keep, cover)


def test_collocations_of_a_long_text_and_of_none(spark):
    rows = [(1, "the red fox. " * 40_000 + "one " * 3000, "en"), (2, "x" * 3_000_000 + " red fox", "en")]
    got = mine_collocations(spark.createDataFrame(rows, LANG)).collect()
    assert [(r["phrase"], r["a"]) for r in got if "fox" in r["phrase"]] == [("red fox", 40_001), ("the red fox", 40_000)]
    assert {r["phrase"]: r["a"] for r in got}["one one one one one"] == 2996
    empty = mine_collocations(spark.createDataFrame([], LANG))
    assert empty.count() == 0 and empty.columns[:4] == ["lang", "rank", "phrase", "a"]


def test_collocations_hash_a_megabyte_at_a_time(monkeypatch):
    """A task holds the words of few texts, and adds up over more; tables of powers are made once a length."""
    texts = [f"{'common words ' * 400}t{i % 7}".encode() for i in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * len(texts)), pa.array(texts, pa.binary())], names=["lang", "text"])
    sizes, plain = [], collocations.Words

    class Source:
        def select(self, *names):
            return self

        def mapInArrow(self, run, schema):
            self.found = pa.Table.from_batches(run(iter([batch])))
            raise StopIteration

    monkeypatch.setattr(collocations, "Words", lambda texts, bits: sizes.append(sum(map(len, texts))) or plain(texts, bits))
    source = Source()
    with pytest.raises(StopIteration):
        collocations.frequent_prints(source, (1, 2), 0, None, 100, 64)
    assert sum(sizes) == sum(map(len, texts)) > 10_000_000 and max(sizes) < 2_200_000
    counts = Counter()
    for fp, n in zip(*(c.to_pylist() for c in source.found.columns), strict=True):
        counts[fp] += n
    # Each text: "common" and "words" 400 times each, one t, the pairs of both orders, one pair with t.
    assert sorted(counts.values()) == sorted([800_000, 800_000, 800_000, 798_000, *2 * [2000 // 7 + (i < 2000 % 7) for i in range(7)]])
    assert source.found.num_rows <= 18 * 3
    assert collocations._power_table(1500, 3)[0] is collocations._power_table(1600, 3)[0]


def test_collocations_take_small_batches(spark, monkeypatch):
    seen, plain = [], collocations.written
    before = spark.conf.get(BATCH[0])
    monkeypatch.setattr(collocations, "written", lambda df, name: seen.append((name, spark.conf.get(BATCH[0]))) or plain(df, name))
    rows = [(1, "en", "one two three " * 200)]
    assert mine_collocations(spark.createDataFrame(rows, "doc_id long, lang string, text string")).count() > 0
    assert {size for name, size in seen if name in ("prints", "phrases")} == {BATCH[1]}
    assert spark.conf.get(BATCH[0]) == before


def test_scores_beyond_64_bits(spark):
    rows = [(10**12, 10**15, 10**12 + 7, 3 * 10**12), (100, 10**10, 100, 100), (123456789012, 9 * 10**14, 10**14 + 1, 10**13 + 3)]
    df = spark.createDataFrame(rows, "a long, n long, l long, r long")
    got = [r[0] for r in df.select(cut_score(F.col("a"), F.col("n"), F.col("l"), F.col("r"))).collect()]
    assert got == [1000 * a * n // (x * y) for a, n, x, y in rows]


# -- token alignment -----------------------------------------------------------


def plain_alignment(pair, text):
    """Groups of token places by the plain rule, and all links."""
    (a, b), = pair.encode([(text or "").encode()])
    ends = lambda ids, table: np.cumsum([len(table[i]) for i in ids]).tolist()
    ends_a, ends_b = ends(a, pair.a_bytes), ends(b, pair.b_bytes)
    groups, i, j = [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        x, y = ends_a.index(end) + 1, ends_b.index(end) + 1
        groups.append((a[i:x], b[j:y]))
        i, j = x, y
    return a, b, groups, [(p, q) for g, h in groups for p in g for q in h]


TEXTS = [
    "Hello world, tokenizers disagree.", "  two  spaces ", "naïve café 日本語 🙂🙂", "<|endoftext|> and <s> </s>", "a", "\n\n\ttabs\n",
    "-" * 700, "ab" * 300, "x" * 50, "the cat the cat the cat", "▁odd", "wholly ünïcödé " * 20, "1234567890 " * 9, "é́", "ﬁ ligature",
]


def test_alignment(spark, docs_of):
    pair = Pair(A, B)
    rows = [*enumerate(TEXTS), (3, TEXTS[3]), (None, TEXTS[0]), (40, None), (41, ""), (None, None)]
    plain = [(i, *plain_alignment(pair, t)) for i, t in rows]
    counts = Counter(link for _, _, _, _, links in plain for link in set(links))
    highest = defaultdict(int)
    for (a, _), n in counts.items():
        highest[a] = max(highest[a], n)
    want = []
    for i, a, b, groups, links in plain:
        shown = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        digest = sha256(shown.encode()).hexdigest() if groups else ""
        best = sum(counts[x] == highest[x[0]] for x in links)
        want.append((i, len(a), len(b), len(groups), len(links), best, sum(counts[x] for x in links), digest))
    assert sum(w[1] > 0 for w in want) > 12 and any(w[1] == 0 for w in want[: len(TEXTS)])
    key = lambda r: (r[0] is None, r)
    for most in (1 << 20, 30, 0):  # all pairs sent to the tasks, some, none
        got = alignment_digest(docs_of(rows), A, B, broadcast_pairs=most).collect()
        assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    shown = {r["doc_id"]: r["groups"] for r in align_texts(docs_of([(0, TEXTS[0]), (1, None)]), A, B).collect()}
    assert shown[1] == "" and sha256(shown[0].encode()).hexdigest() == want[0][-1]
    assert alignment_digest(docs_of([(1, "x")]).limit(0), A, B).count() == 0


def test_both_engines_give_the_ids_of_a(monkeypatch):
    r, pair = random.Random(9), Pair(A, B)
    texts = [t for t in TEXTS if t]
    for _ in range(3000):
        kind = r.choice(["".join(map(chr, range(0x280))), " \t\n\r\x0b\x1c\x85\xa0aA0's-.éª²", "etaoin shrdlu's 12\n"])
        texts.append("".join(r.choices(kind, k=r.randint(1, 90))))
    for text in texts:
        whole = pair.a.encode(f" {text}", add_special_tokens=False).ids
        assert pair.quick.encode_ordinary(f" {text}") == whole, text
        got = pair.encode([text.encode()])[0][0]
        assert got in (whole, [])


@pytest.mark.parametrize("piece", [1, 2, 3, 7, 1000])
def test_merge_path_pieces(piece):
    r = random.Random(piece)
    for _ in range(60):
        n = r.randint(1, 60)
        a, b = (np.array(sorted({n, *r.sample(range(1, n + 1), r.randint(0, n))})) for _ in "ab")
        cut_a, cut_b = diagonal_cuts(a, b, piece)
        assert cut_a[-1] == len(a) and cut_b[-1] == len(b) and (np.diff(cut_a + cut_b)[:-1] == piece).all()
        both = sorted(set(a.tolist()) & set(b.tolist()))
        got = merged_groups(a, b, piece)
        assert [x.tolist() for x in got] == [[a.tolist().index(e) + 1 for e in both], [b.tolist().index(e) + 1 for e in both]]


def test_alignment_of_a_long_text(spark, docs_of):
    text = "Some words, repeated very often: naïve café. " * 60_000
    one, two = alignment_digest(docs_of([(1, text), (2, text[:450_000])]), A, B).orderBy("doc_id").collect()
    assert one["n_a"] > 600_000 and one["n_links"] >= one["n_groups"] > two["n_groups"] > 0
    assert one["n_best"] <= one["n_links"] and one["count_sum"] <= 2 * one["n_links"]


# -- simhash -------------------------------------------------------------------


def plain_print(text, size=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode()
    words = low.split()
    shingles = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64(s, 42).intdigest() for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_classes(prints, distance=3):
    """The smallest member (by place) of each fingerprint's component."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= distance:
            x, y = sorted((find(i), find(j)))
            root[y] = x
    return [find(i) for i in range(len(prints))]


def test_fingerprint_is_sparks_hash(spark):
    text = "Some words of a text that Spark hashes as well"
    words = text.lower().split()
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashes = [r[0] for r in spark.createDataFrame([(s,) for s in shingles], "s string").select(F.xxhash64("s")).collect()]
    bits = [sum(h >> k & 1 for h in hashes) for k in range(64)]
    assert fingerprint(text.encode(), 3) % (1 << 64) == sum(1 << k for k in range(64) if 2 * bits[k] > len(hashes))


@pytest.mark.parametrize("block", [4, 4096])
def test_near_links(spark, block):
    """Chains, dense balls and numbers four bits apart: what links connect is connected, nothing else."""
    r = random.Random(block)
    prints = {0, (1 << 64) - 1, 1 << 63}
    for _ in range(60):
        centre = r.getrandbits(64)
        for _ in range(r.choice((1, 2, 3, 40))):
            x = centre
            for k in r.sample(range(64), r.randint(0, 4)):
                x ^= 1 << k
            prints.add(x)
            centre = x if r.random() < 0.3 else centre
    prints = sorted(prints)
    nodes = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in prints], "fp long").repartition(5)
    links = [(a % (1 << 64), b % (1 << 64)) for a, b in near_links(nodes, block=block).collect()]
    assert all(0 < (a ^ b).bit_count() <= 3 for a, b in links)
    place = {x: i for i, x in enumerate(prints)}
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        x, y = sorted((find(place[a]), find(place[b])))
        root[y] = x
    assert [find(i) for i in range(len(prints))] == plain_classes(prints)


def test_simhash_components(spark, docs_of):
    r = random.Random(5)
    base = [" ".join(r.choices("alpha Beta gamma delta eps zeta eta theta".split(), k=r.randint(1, 300))) for _ in range(30)]
    rows = list(enumerate(base))
    for i, text in enumerate(base):
        words = text.split()
        for k in range(3):
            changed = list(words)
            changed[r.randrange(len(words))] = "other"
            rows.append((100 + 3 * i + k, "  ".join(changed).upper()))
    rows += [(0, base[0]), (None, base[1]), (None, "only here"), (400, None), (401, ""), (402, " \n\v"), (403, "one"), (404, "One two")]
    rows.append((405, " ".join(f"w{i % 977}" for i in range(400_000))))
    prints = [plain_print(t) if len(t or "") < 100_000 else fingerprint(t.encode(), 3) % (1 << 64) for _, t in rows]
    roots = plain_classes(prints)
    least = {}
    for (i, _), c in zip(rows, roots, strict=True):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    want = [(i, f"{p:016x}", least.get(c)) for (i, _), p, c in zip(rows, prints, roots, strict=True)]
    got = [(x["doc_id"], x["fingerprint"], x["component_id"]) for x in simhash_digest(simhash_components(docs_of(rows))).collect()]
    key = lambda x: (x[0] is None, x[0] or 0, x[1], x[2] or 0)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert len(set(roots)) < len(set(prints))
    assert simhash_components(docs_of([(1, "x")]).limit(0)).count() == 0


def test_fingerprint_of_parts(monkeypatch):
    """A text cut into parts has the same fingerprint."""
    from fieldstone.llm import simhash_join

    r = random.Random(3)
    text = " ".join("".join(r.choices("abcdef", k=r.randint(1, 9))) for _ in range(900)).encode()
    whole = fingerprint(text, 3)
    for size in (1, 7, 50, 999):
        monkeypatch.setattr(simhash_join, "_PART", size)
        assert fingerprint(text, 3) == whole
    assert whole % (1 << 64) == plain_print(text.decode())
