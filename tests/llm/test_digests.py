"""Every digest against a plain version, over texts with all that is awkward."""

import random
import re
import struct
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from fieldstone.llm.decontaminate import find_leaks, leak_report
from fieldstone.llm.licenses import evaluate, license_digest, postfix, scan_licenses
from fieldstone.llm.ngram_join import near_components
from fieldstone.llm.packing import pack, plan_cuts
from fieldstone.llm.pii import pii_digest, scan_pii
from fieldstone.llm import ngram_join, ppm
from fieldstone.llm.ppm import ppm_digest
from fieldstone.llm.secret_scan import BEFORE, candidates, find_base, fit_net, labelled_windows, scan_secrets, secret_digest, train_net, window, windows

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def prose(rng, n):
    return " ".join("".join(rng.choices(["the", "an", "on", "é", "ß", "or", "ti"], k=rng.randint(1, 3))) for _ in range(n))


def corpus(seed=3, n=60):
    rng = random.Random(seed)
    passage = prose(rng, 40)
    texts = [None, "", "   \n\t ", "one", "Two words", "three WORDS here", prose(rng, 20_000)]
    for _ in range(n):
        text = prose(rng, rng.randint(1, 120))
        extra = rng.choice([
            "", passage, "The MIT License. cc by cc by", "Apache License, Version 2.0 gnu general public license",
            "password = 'Abc123x' token:'12345'", "AKIA" + "ABCD1234" * 2 + "x", "deadbeef" * 4, "a.b@c.d@e.f-g.h x@y",
            "call +1 (555) 123-4567 or 10.0.0.256 and 010.1.2.3.4", "4111 1111 1111 1111 and 4111-1111-1111-1112", "\x00 \x1f\x7f odd  space",
        ])
        texts.append(f"{text} {extra}\n{prose(rng, rng.randint(0, 30))}")
    long = texts[10]
    texts += [long, long.upper(), long + " tail", " ".join(long.split()[1:])]
    rows = [(i, t) for i, t in enumerate(texts)]
    return rows + [rows[12], rows[12], (None, texts[11]), (None, None)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


def plain(df, columns):
    rounded = lambda x: round(x, 6) if isinstance(x, float) else x
    return sorted((tuple(rounded(v) for v in r) for r in df.select(*columns.split()).collect()), key=str)


def same(df, columns, want):
    rounded = lambda x: round(x, 6) if isinstance(x, float) else x
    assert plain(df, columns) == sorted((tuple(rounded(v) for v in r) for r in want), key=str)


ITEMS = "item_id long, text string"


def test_winnowing(spark, docs_of, rows):
    words = rows[20][1].split()
    items = [(1, " ".join(words[3:16])), (2, " ".join(words[:10])), (3, "Two words"), (4, "one"), (5, None), (6, ""), (7, "... !"),
             (None, "one"), (8, " ".join(words[3:16])), (9, rows[6][1][:400]), (10, "an an an an an an an an an an an an")]
    docs = rows + [(500, "an " * 30), (501, "x " + "an " * 11)]
    got = leak_report(*find_leaks(docs_of(docs), spark.createDataFrame(items, ITEMS)))
    same(got, "doc_id n_words n_hit n_items items_sha256 contaminated", brute.leaks(docs, items))


def test_winnowing_of_nothing(spark, docs_of, rows):
    none = spark.createDataFrame([], ITEMS)
    got = leak_report(*find_leaks(docs_of(rows), none))
    same(got, "doc_id n_words n_hit n_items items_sha256 contaminated", brute.leaks(rows, []))
    assert leak_report(*find_leaks(docs_of([]), none)).count() == 0


def test_winnowing_runs_no_python(spark, docs_of, rows):
    texts, matches, items = find_leaks(docs_of(rows), spark.createDataFrame([(1, rows[20][1])], ITEMS))
    plan = leak_report(texts, matches, items)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_ngram_join(docs_of, rows):
    want = brute.near(rows)
    assert sum(1 for d, _, c in want if d is not None and c != d) >= 3
    same(near_components(docs_of(rows)), "doc_id n_shingles component_id", want)


def test_ngram_join_of_chains(docs_of):
    """Near copies that link only through others, and a large group around one text."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    chain, now = [], list(base)
    for i in range(12):
        now = list(now)
        now[rng.randrange(150)] = f"c{i}"
        chain.append(" ".join(now))
    around = []
    for i in range(60):
        own = [f"v{j}" for j in range(150)]
        for j in rng.sample(range(150), rng.randint(1, 6)):
            own[j] = f"e{i}.{j}"
        around.append(" ".join(own))
    docs = [(1000 - i, t) for i, t in enumerate(chain + around)] + [(2000, around[0])]
    same(near_components(docs_of(docs)), "doc_id n_shingles component_id", brute.near(docs))


def near_copies(n, words=150):
    """Copies of one text, most with so many changed words that few pairs link, but all with the text."""
    rng = random.Random(7)
    out = [[f"v{j}" for j in range(words)]]
    for i in range(n):
        own = list(out[0])
        for j in rng.sample(range(words), rng.choice([0, 1, 1, 2, 2, 3, 6, 9])):
            own[j] = f"e{i}.{j}"
        out.append(own[: words - rng.choice([0, 0, 0, 5, 20])])
    return [(i, " ".join(t)) for i, t in enumerate(out)]


def test_ngram_join_of_a_large_group(docs_of, monkeypatch):
    """Pairs left after the pivots grow with the group, not with its square; nothing is lost."""
    made, plain_of = [], ngram_join.verified

    def verified(pairs, parts, percent):
        made.append(pairs.count())
        return plain_of(pairs, parts, percent)

    monkeypatch.setattr(ngram_join, "verified", verified)
    docs = near_copies(400)
    same(near_components(docs_of(docs)), "doc_id n_shingles component_id", brute.near(docs))
    assert sum(made) <= 4 * len(docs)


def test_ngram_join_moves_sets_that_can_link(docs_of, monkeypatch):
    """Texts with a third of their words in common meet in a bucket, but only sets of near copies are made and moved."""
    rng, texts, sets, plain_of = random.Random(9), [], set(), ngram_join.verified
    for i in range(40):
        shared = [f"s{i}.{j}" for j in range(60)]
        texts += [" ".join(shared + [f"o{i}.{side}.{j}" for j in range(rng.randint(110, 130))]) for side in (0, 1)]
    copy = texts[0].rsplit(" ", 3)[0]

    def verified(pairs, parts, percent):
        sets.update(r.node for r in parts.select("node").collect())
        return plain_of(pairs, parts, percent)

    monkeypatch.setattr(ngram_join, "verified", verified)
    docs = list(enumerate([*texts, copy]))
    same(near_components(docs_of(docs)), "doc_id n_shingles component_id", brute.near(docs))
    assert len(sets) == 2


@pytest.mark.parametrize("percent", [50, 80, 85, 95])
def test_sketches_lose_no_link(percent, monkeypatch):
    """Sets that link can do so by their sketches, however far these are folded or cut; unlike sets can't."""
    rng = np.random.default_rng(percent)
    linked = apart = 0
    for most in (1 << 20, 128):
        monkeypatch.setattr(ngram_join, "SKETCH", most)
        for _ in range(1500):
            a = rng.integers(0, 1 << 63, rng.integers(1, 300), np.uint64)
            more = rng.integers(0, 1 << 63, rng.integers(0, max(2, len(a) // 3)) * rng.integers(0, 2), np.uint64)
            b = np.concatenate([a[rng.random(len(a)) < rng.choice([0.4, 0.9, 0.97, 1])], more])
            common = len(np.intersect1d(a, b))
            links = 100 * common >= percent * (len(a) + len(b) - common)
            can = ngram_join.can_link(len(a), ngram_join.sketch_of(a), len(b), ngram_join.sketch_of(b), percent)
            assert can or not links or not len(b)
            linked += links
            apart += most > 128 and len(a) > 50 and common < 0.45 * len(a) and not can
    assert linked > 200 and (apart > 200 or percent == 50)


@pytest.mark.parametrize("percent", [50, 80, 85, 95])
def test_first_shared_shingles(spark, percent):
    """Sets that link meet in the bucket of the first shingle that they share."""
    rng, rows = random.Random(percent), []
    while len(rows) < 400:
        a = set(rng.sample(range(60), rng.randint(1, 40)))
        b = {x for x in a if rng.random() < 0.97} | set(rng.sample(range(60), rng.choice([0, 0, 1, 2])))
        common = len(a & b)
        if common and 100 * common >= percent * len(a | b):
            x, y = sorted(a), sorted(b)
            first = min(a & b)
            pa, pb = x.index(first), y.index(first)
            assert pa <= len(a) - (percent * len(a) + 99) // 100 and pb <= len(b) - (percent * len(b) + 99) // 100
            rows.append((len(a), pa, len(b), pb))
    assert spark.createDataFrame(rows, "na int, pa int, nb int, pb int").where(~ngram_join.meet(percent)).count() == 0


def test_ngram_join_of_nothing(docs_of):
    assert near_components(docs_of([])).count() == 0
    same(near_components(docs_of([(1, None), (2, "")])), "doc_id n_shingles component_id", [(1, 0, 1), (2, 0, 2)])


def test_licenses(docs_of, rows):
    got = license_digest(scan_licenses(docs_of(rows)))
    same(got, "doc_id n_words n_base first_word last_word base_labels", brute.licenses(rows))
    assert all(0 <= r.score <= 1 for r in got.collect())
    assert scan_licenses(docs_of([])).count() == 0


@pytest.mark.parametrize(
    "text, labels, free",
    [
        ("MIT", ["mit"], True),
        ("MIT OR GPL-2.0-only", ["gpl", "mit"], True),
        ("MIT AND GPL-2.0-only", ["gpl", "mit"], False),
        ("(MIT OR Apache-2.0) AND BSD-3-Clause", ["apache", "bsd", "mit"], True),
        ("GPL-2.0 WITH Classpath-exception-2.0 OR MIT", ["gpl", "mit"], True),
        ("mit and gpl-3.0 or isc", ["gpl", "isc", "mit"], True),
    ],
)
def test_expressions(text, labels, free):
    assert evaluate(postfix(text)) == (labels, free)


@pytest.mark.parametrize("text", ["", "OR MIT", "(MIT", "MIT )", "MIT AND", "( )", "MIT OR OR GPL"])
def test_bad_expressions(text):
    assert postfix(text) is None


def test_license_tags(docs_of):
    got = license_digest(scan_licenses(docs_of([(1, "// SPDX-License-Identifier: (MIT OR GPL-2.0)\ncode"), (2, "SPDX-License-Identifier: (MIT")])))
    found = {r.doc_id: r for r in got.collect()}
    assert found[1].labels == "gpl,mit" and found[1].permissive and found[1].score > found[2].score


def test_secrets(docs_of, rows):
    docs = docs_of(rows)
    got = secret_digest(scan_secrets(docs, train_net(docs)))
    same(got, "doc_id n_assign n_access n_hex base_sha256", brute.secrets(rows))
    assert secret_digest(scan_secrets(docs_of([]), None)).count() == 0


def test_secret_network(docs_of):
    """Keys without a telling name score above long words, which are left alone."""
    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz"
    key = lambda n: "".join(rng.choices("0123456789abcdef", k=n))
    word = lambda: "".join(rng.choices(letters, k=rng.randint(16, 24)))
    docs = [(i, f"{word()} password={key(24)} and {word()} then {word()}") for i in range(400)]
    net = train_net(docs_of(docs), per_class=400)
    own = np.array([list(window(f"see {key(20)} or", 4, 24)) for _ in range(200)])
    other = np.array([list(window(f"see {w} or", 4, 4 + len(w))) for w in (word() for _ in range(200))])
    assert net.predict(own).mean() > net.predict(other).mean() + 0.2
    assert (net.predict(other) >= net.threshold).mean() <= 0.05


def test_every_part_of_a_run_is_a_candidate(docs_of):
    """A secret behind a long prefix, and one beside base findings; against every character by itself."""
    rng = random.Random(31)
    secret = "".join(rng.choices("0123456789xyzXYZ", k=24))
    text = f"see /usr/local/share/{'lib/' * 20}{secret} or"
    ((a, b),) = candidates(text, [])
    assert any(window(secret, 0, 24)[BEFORE : BEFORE + 24] in w for w in windows(text, a, b))
    beside = f"AKIA{'A1' * 8}/{secret} {'ab12' * 6}.{secret} password={secret}"
    found = [beside[a:b] for a, b in candidates(beside, find_base(beside))]
    assert found == ["/" + secret, "." + secret]
    for _ in range(300):
        text = "".join(rng.choices(["a1b2" * 6, "AKIA" + "Q7" * 8, "token=", "word", "Zz9+/", " ", "'"], k=20))
        base = find_base(text)
        covered = {i for _, s, e in base for i in range(s, e)}
        free = "".join("\n" if i in covered else c for i, c in enumerate(text))
        assert candidates(text, base) == [m.span() for m in re.finditer(r"[A-Za-z0-9+/_.=-]{16,}", free)]

    class Digits:
        threshold = 0.5

        def predict(self, x):
            return ((x[:, BEFORE : BEFORE + 40] >= 97 + 17) & (x[:, BEFORE : BEFORE + 40] <= 97 + 26)).mean(1) * 2

    long = f"{'path/' * 40}{'7' * 20}"
    spans = scan_secrets(docs_of([(1, f"x {long} y {'path/' * 40}")]), Digits()).first().findings
    assert [(s.kind, s.text) for s in spans] == [("network", long)]


def test_threshold_keeps_the_recall():
    """Of held-back keys without their names too, also where that takes a threshold below a half."""
    rng = np.random.default_rng(4)
    pick = lambda chars, n: "".join(rng.choice(list(chars), n))
    key = lambda: pick("abcdef0123456789", 20) if rng.random() < 0.7 else pick("abcdefghijklmnop", 20)
    yes = [window(f"password={key()}", 9, 29) for _ in range(600)]
    no = [window(f"and {pick('abcdefghijklmnop', 20)} so", 4, 24) for _ in range(600)]
    net = fit_net(np.array([list(w) for w in yes + no], np.int64), np.array([1] * 600 + [0] * 600), 0.98)
    fresh = np.array([list(window(key(), 0, 20)) for _ in range(2000)], np.int64)
    assert (net.predict(fresh) >= net.threshold).mean() >= 0.95


def test_copies_take_no_places(docs_of):
    """One window a thousand times beside a few others."""
    rows = [(i, "see aaaaaaaaaaaaaaaaaaaaaaaa or") for i in range(1000)]
    rows += [(2000 + i, f"see {chr(97 + i) * 20}zz or and password={chr(97 + i) * 9}") for i in range(20)]
    got = [(bytes(r.w), r.y) for r in labelled_windows(docs_of(rows), "text", 30).collect()]
    assert len(got) == len(set(got)) == 41 and sum(y for _, y in got) == 21
    fewer = {tuple(r) for r in labelled_windows(docs_of(rows, 1), "text", 5).collect()}
    assert len(fewer) == 10 and fewer == {tuple(r) for r in labelled_windows(docs_of(rows, 7), "text", 5).collect()}


def test_pii(docs_of, rows):
    got = pii_digest(scan_pii(docs_of(rows)))
    same(got, "doc_id n_email n_ip n_card n_phone base_sha256", brute.pii(rows))
    assert scan_pii(docs_of([])).count() == 0


@pytest.mark.parametrize(
    "text, kind, said",
    [
        ("write to jane.doe [at] example [dot] com now", "email", "jane.doe [at] example [dot] com"),
        ("write jane at mail dot example dot org now", "email", "jane at mail dot example dot org"),
        ("mail jаne@exаmple.com please", "email", "jаne@exаmple.com"),
        ("mail jane@example(dot)com please", "email", "jane@example(dot)com"),
        ("call plus one five five five one two three four five six seven ok", "phone", "plus one five five five one two three four five six seven"),
        ("call five five five one two three four five six seven ok", "phone", "five five five one two three four five six seven"),
        ("host 10 dot 20 dot 30 dot 40 is down", "ip", "10 dot 20 dot 30 dot 40"),
        ("card ４１１１ １１１１ １１１１ １１１１ ok", "card", "４１１１ １１１１ １１１１ １１１１"),
        ("four one one one one one one one one one one one one one one one", "card", None),
    ],
)
def test_disguises(docs_of, text, kind, said):
    spans = scan_pii(docs_of([(1, text)])).first().spans
    assert [(s.kind, s.text, s.plain) for s in spans] == [(kind, said or text, False)]
    assert text[spans[0].start : spans[0].end] == (said or text)


@pytest.mark.parametrize(
    "text",
    ["look at the dot on the map", "meet me at noon. dot the i", "one two", "at one three dot com it was four", "one of three at home",
     "версия 2.0 готова", "Ελλάδα 1.2.3"],
)
def test_prose_is_left_alone(docs_of, text):
    assert scan_pii(docs_of([(1, text)])).first().spans == []


def test_ppm(docs_of, rows):
    got = ppm_digest(docs_of(rows))
    want = brute.unigram(rows)
    same(got, "doc_id held_out n_tokens n_known train_tokens base_score", want)
    held = [h for _, h, *_ in want]
    scores = brute.ppm([t for _, t in rows], held)
    found = {}
    for r in got.collect():
        found.setdefault(r.doc_id, []).append(r.score)
    for (d, _), s in zip(rows, scores, strict=True):
        assert any(abs(x - s) <= 1e-4 * max(1, abs(s)) for x in found[d])
    assert ppm_digest(docs_of([])).count() == 0


@pytest.mark.parametrize("share", [None, 1 / 20000])
def test_ppm_of_rare_contexts(docs_of, monkeypatch, share):
    """Contexts below every share, seen in training, by held-out texts alone, or not at all."""
    if share:  # others are joined
        monkeypatch.setattr(ppm, "GRAM_SHARE", share)
    own = ["zqx zqx zqy", "zqx\xe9 zqw", "Zq7 qqq", "", None]
    docs = [(i, "ab" * 8000 + t) for i, t in enumerate(["", " c", " zqv"] * 3)] + [(100 + i, t) for i, t in enumerate(own * 6)]
    docs += [(100, own[0])]
    got = ppm_digest(docs_of(docs)).collect()
    held = {r.doc_id: r.held_out for r in got}
    assert len(got) == len(docs) and len(set(held.values())) == 2
    want = dict(zip([d for d, _ in docs], brute.ppm([t for _, t in docs], [held[d] for d, _ in docs]), strict=True))
    assert all(abs(r.score - want[r.doc_id]) <= 1e-4 * max(1, abs(want[r.doc_id])) for r in got)


def test_packing(docs_of, rows):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    docs = [(i, t) for i, (_, t) in enumerate(rows)] + [(900, "İstanbul ς Σ 'tis don't ... <|endoftext|> x́ 12.5"), (901, "no.stop " * 9000)]
    want = {d: tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for d, t in docs}
    pieces, filled = {}, {}
    for r in pack(docs_of(docs), VOCABULARY, with_ids=True).collect():
        pieces.setdefault(r.doc_id, []).append(r)
        filled.setdefault(r.sequence_id, []).append(r)
    assert set(pieces) == set(want)
    for d, ids in want.items():
        got = sorted(pieces[d], key=lambda r: r.start)
        assert [x for r in got for x in r.ids] == ids
        assert [r.start for r in got] == [sum(p.length for p in got[:i]) for i in range(len(got))]
        for r in got:
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *r.ids))
    for rs in filled.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    assert pack(docs_of([]), VOCABULARY).count() == 0


def test_cuts_are_the_cheapest():
    """Against all ways to cut."""
    padding = lambda size: 0 if size in (4, 8) else 16 - size
    rng = random.Random(1)
    for _ in range(200):
        points = sorted({0, *rng.sample(range(1, 60), rng.randint(1, 9))})
        if max(np.diff(points), default=0) > 16:
            continue
        costs = [rng.choice([0, 2, 5]) for _ in points]

        def price(at, points=points, costs=costs):
            if at == len(points) - 1:
                return 0
            best = 10**9
            for j in range(at + 1, len(points)):
                size = points[j] - points[at]
                if size <= 16:
                    best = min(best, padding(size) + costs[j] + price(j))
            return best

        cuts = plan_cuts(np.array(points), np.array(costs, float), 16)
        place = {p: i for i, p in enumerate(points)}
        got = sum(padding(b - a) + costs[place[b]] for a, b in zip(cuts, cuts[1:], strict=False))
        assert got == price(0)
