"""Line dedup, toxicity, nearest neighbours and the pipeline."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fieldstone.llm import line_dedup
from fieldstone.llm.ann import search
from fieldstone.llm.line_dedup import common_blocks, dedup_lines, patience
from fieldstone.llm.toxicity import score_toxicity, some_sentences, toxic_column, toxicity_digest, train_toxicity


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(n))


def test_line_dedup(docs_of):
    rng = random.Random(2)
    passage = ". ".join(words(rng, 12) for _ in range(5)) + "."
    own = [words(rng, 40) for _ in range(8)]
    rows = [
        (10, f"{own[0]}.\n{passage}\n{own[1]}"),
        (11, f"{own[2]}.\n{passage}\n{own[3]}"),
        (12, f"{own[4]}. {passage} {own[5]}"),  # in the midst of a line
        (13, f"{own[0]}.\n{passage}\n{own[1]}"),  # a copy of the first
        (14, "Short line.\n" + own[6]), (15, "Short line.\n" + own[7]),
        (16, None), (17, ""), (None, passage), (11, f"{own[2]}.\n{passage}\n{own[3]}"), (18, "é" * 50_000),
    ]
    got = [(r.doc_id, r.text, r.removed_words, [(s.start, s.end) for s in r.removed_spans]) for r in dedup_lines(docs_of(rows)).collect()]
    by = {d: (t, n, s) for d, t, n, s in got}
    assert len(got) == len(rows)
    assert by[10][:2] == (rows[0][1], 0)
    assert by[11][1] == 60 and by[11][0] == f"{own[2]}.\n{own[3]}" and sum(d == 11 and n == 60 for d, _, n, _ in got) == 2
    assert by[12][1] == 60 and passage not in by[12][0] and own[4] in by[12][0] and own[5] in by[12][0]
    assert by[13][0] == "" and by[13][1] == 140
    for d in (14, 15, 16, 17, None, 18):
        assert by[d][0] == dict(rows)[d] and by[d][1] == 0
    cut = rows[1][1]
    for a, b in by[11][2]:
        assert cut[a:b].strip() == passage


def test_line_dedup_of_nothing(docs_of):
    assert dedup_lines(docs_of([])).count() == 0


def test_line_dedup_makes_units_of_a_megabyte(docs_of, monkeypatch):
    seen, plain = [], line_dedup.per_text

    def per_text(docs, id_column, text_column, fn, columns, most=4 << 20):
        seen.append(most)
        return plain(docs, id_column, text_column, fn, columns, most)

    monkeypatch.setattr(line_dedup, "per_text", per_text)
    rng = random.Random(12)
    shared = f"{words(rng, 40)}.\n"
    rows = [(i, f"{words(rng, 15000)}.\n{shared}{words(rng, 15000)}.\n") for i in range(8)]
    found = {r["doc_id"]: r for r in dedup_lines(docs_of(rows, 1)).collect()}
    assert [found[i]["removed_words"] for i, _ in rows] == [0, *[40] * 7]
    assert all(found[i]["text"] == (text.replace(shared, "") if i else text).rstrip() + "\n" for i, text in rows)
    assert max(seen) <= 1 << 20


def test_patience():
    assert patience([1, 2, 3, 4], [9, 2, 3, 8, 4]) == [(1, 1), (2, 2), (3, 4)]
    assert patience([1, 1, 1], [1, 1]) == [(0, 0), (1, 1)]
    assert patience([5, 1, 1, 6], [7, 1, 1, 8]) == [(1, 1), (2, 2)]
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.randint(0, 9) for _ in range(rng.randint(0, 14))] for _ in range(2))
        found = patience(a, b)
        assert all(a[i] == b[j] for i, j in found)
        assert all(x < y and u < v for (x, u), (y, v) in zip(found, found[1:], strict=False))
    assert common_blocks([1, 2, 3, 9], [0, 1, 2, 7, 9], [4, 4, 4, 4], 8) == [0, 1]


def toxic_rows(n=400, seed=8):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.3
        sentences = [words(rng, 8) for _ in range(rng.randint(1, 30))]
        if bad:
            sentences[rng.randrange(len(sentences))] += f" {rng.choice(['foulx', 'nastyq'])}{rng.choice(['', 'ab', 'cd'])}"
        docs.append((i, ". ".join(sentences)))
        labels.append((i, 1, int(bad)))
    return docs, labels


LABELS = "doc_id long, quality int, toxic int"


def test_toxicity(spark, docs_of):
    docs, labels = toxic_rows()
    odd = [(None, "x"), (900, None), (901, ""), (902, "calm " * 100_000), (5, docs[5][1])]
    frame = docs_of(docs + odd)
    model = train_toxicity(frame, spark.createDataFrame(labels + [(None, 1, 1), (3, 1, None), (7777, 0, 1)], LABELS))
    got = toxicity_digest(score_toxicity(frame, model)).collect()
    assert len(got) == len(docs) + len(odd)
    truth = {i: t for i, _, t in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(truth[r.doc_id] == r.predicted for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.predicted == 0 for r in got if r.doc_id in (None, 900, 901))
    located = score_toxicity(frame, model).where(F.size("offending") > 0).first()
    text = dict(docs)[located.doc_id]
    assert all(text[s.start : s.end] == s.text for s in located.offending)
    column = frame.select("doc_id", toxic_column(model, F.col("text")).alias("s"))
    assert {r.doc_id: round(r.s, 9) for r in column.collect()} == {r.doc_id: round(r.score, 9) for r in got}


def test_toxicity_without_labels(spark, docs_of):
    frame = docs_of([(1, "a b"), (2, None)])
    model = train_toxicity(frame, spark.createDataFrame([], LABELS))
    assert [r.predicted for r in toxicity_digest(score_toxicity(frame, model)).collect()] == [0, 0]
    assert score_toxicity(docs_of([]), model).count() == 0


def test_long_documents_do_not_end_the_sample(spark, docs_of):
    docs, labels = toxic_rows()
    rng = random.Random(3)
    long = [(i, ". ".join(words(rng, 8) for _ in range(9000))) for i in range(3000, 3020)]
    frame = docs_of(docs + long)
    known = spark.createDataFrame(labels + [(i, 1, 0) for i, _ in long], LABELS)
    model = train_toxicity(frame, known, max_bytes=400_000)
    truth = {i: t for i, _, t in labels}
    held = [r for r in toxicity_digest(score_toxicity(frame, model)).collect() if r.held_out and r.doc_id in truth]
    assert sum(truth[r.doc_id] == r.predicted for r in held) >= 0.9 * len(held)
    text = long[0][1].encode()
    part = some_sentences(text, 5000)
    assert 4000 < len(part) <= 5000 and set(part.split(b"\n")) <= {b.strip() for b in text.split(b".")}
    assert some_sentences(b"x" * 6000, 5000) == b"" and some_sentences(b"A. b", 5000) == b"A. b"


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)], [(1, 1, 1)]])
def test_untrained_rejects_nothing(spark, docs_of, labels):
    frame = docs_of([(1, "a b"), (2, "calm words. " * 50_000)])
    model = train_toxicity(frame, spark.createDataFrame(labels, LABELS))
    assert all(r.score < 0.01 for r in score_toxicity(frame, model).collect())


VECTORS = "vec_id long, embedding array<float>, label int"


def brute_nearest(rows, k=20):
    good = {}
    for i, v, _ in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, np.float32).astype(float)
    return {
        q: sorted(((-float((v * good[q]).sum()), i) for i, v in good.items() if i != q and len(v) == len(good[q])))[:k]
        for q in good
        if q % 20 == 0
    }


def vector_rows(n, seed=6, dim=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, dim))
    return [(i, (centres[i % 8] + rng.normal(size=dim)).astype(np.float32).tolist(), 0) for i in range(n)]


def test_search_is_exact_where_all_are_candidates(spark):
    rows = vector_rows(300)
    same = rows[40][1]
    rows += [(1000 + i, same, 0) for i in range(40)] + [(40, same, 1)]  # copies, and a repeated row
    rows += [(2000, None, 0), (2020, [0.0] * 16, 0), (2040, [float("nan")] * 16, 0), (2060, [None] * 16, 0), (2080, [float("inf")] * 16, 0),
             (None, same, 0), (2100, [1.0, 2.0], 0), (2101, [2.0, 2.0], 0), (2120, [], 0)]
    got = {}
    for r in search(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    want = brute_nearest(rows)
    assert set(got) == {q for q, near in want.items() if near}
    for q, near in want.items():
        assert [got[q][i + 1][0] for i in range(len(near))] == [i for _, i in near]
        assert all(abs(got[q][i + 1][1] + s) < 1e-9 for i, (s, _) in enumerate(near))


def test_search_ties_go_to_smaller_ids(spark):
    rng = np.random.default_rng(2)
    rows = [(0, [1.0] + [0.0] * 15, 0)] + [(i, [1.0, *rng.normal(size=15).tolist()], 0) for i in range(1, 401)]
    found = search(spark.createDataFrame(rows, VECTORS), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in found] == [(i, 1.0) for i in range(1, 21)]


def test_search_recall(spark):
    """Few candidates of many, over several pieces."""
    rows = vector_rows(4000)
    found = search(spark.createDataFrame(rows, VECTORS).repartition(6), F.col("vec_id") % 20 == 0, candidates=4000)
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = brute_nearest(rows)
    recall = np.mean([len(got[q] & {i for _, i in near}) / len(near) for q, near in want.items()])
    assert recall >= 0.9


def test_search_of_nothing(spark):
    assert search(spark.createDataFrame([], VECTORS), F.col("vec_id") % 20 == 0).count() == 0


def test_pipeline(spark, tmp_path):
    rng = random.Random(12)
    docs, labels = toxic_rows(300)
    bad = {i for i, _, t in labels if t}
    clean = [i for i, _ in docs if i not in bad]
    test_item = words(rng, 30)
    passage = words(rng, 70)
    near = words(rng, 200).split()
    near_copy = list(near)
    near_copy[100] = "other"
    extra = [
        (1000, words(rng, 60) + " " + test_item), (1001, words(rng, 40) + "\n" + passage), (1002, words(rng, 40) + "\n" + passage),
        (1003, " ".join(near)), (1004, " ".join(near_copy)), (1005, docs[clean[0]][1] + " " + words(rng, 90)), (1006, None), (1007, ""),
        (None, words(rng, 50)), (1008, words(rng, 50)), (1008, words(rng, 50)),
    ]
    extra.append((1009, extra[7 - 4][1]))  # an exact copy of 1003
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in docs + extra]
    spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, test_item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    at = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
        at[name] = {r.doc_id: r for r in kept.collect()}
    assert len(bad - set(at["toxicity"])) >= 0.95 * len(bad) and len(set(clean) - set(at["toxicity"])) <= 0.02 * len(clean)
    assert passage in at["line_dedup"][1001].text and passage not in at["line_dedup"][1002].text
    assert at["line_dedup"][1002].n_chars == len(at["line_dedup"][1002].text)
    assert 1009 not in at["line_dedup"] and 1003 in at["line_dedup"]
    assert 1004 not in at["ngram_join"] and {1003, 1006, 1007, None} <= set(at["ngram_join"])
    assert 1000 not in at["decontamination"] and set(at["ngram_join"]) - set(at["decontamination"]) == {1000}
    pieces = corpus_pipeline.packing(spark, kept, str(tmp_path)).collect()
    assert {p.doc_id for p in pieces} == set(at["decontamination"])
    assert len(corpus_pipeline.run(spark, str(tmp_path)).collect()) == len(pieces)


def test_near_copies_of_the_stage(spark, tmp_path):
    """Copies at 0.82 (text appended, a changed block) go, one at 0.79 stays."""
    rng = random.Random(21)
    base, other, third = (words(rng, 200).split() for _ in range(3))
    block = [*other[:100], *words(rng, 15).split(), *other[115:]]
    rows = [(1, " ".join(base)), (2, " ".join(base) + " " + words(rng, 42)), (3, " ".join(other)), (4, " ".join(block)),
            (5, " ".join(third)), (6, " ".join(third) + " " + words(rng, 52))]
    kept = corpus_pipeline.ngram_join(spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 5, 6]


@pytest.mark.parametrize("limit", ["-1", "10MB"])
def test_the_stage_moves_texts_once(spark, tmp_path, limit):
    """At every size of the tables: one shuffle of the texts, one of the ids that go."""
    rng = random.Random(11)
    texts = [words(rng, 40) for _ in range(6)]
    rows = list(enumerate([*texts, texts[0], texts[1] + " end"]))
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, limit)
        kept = corpus_pipeline.ngram_join(spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path))
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2 and "Broadcast" not in plan
        assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == rows[:6]
    finally:
        spark.conf.set(key, before)


def test_repeated_rows_of_the_stage(spark, tmp_path):
    """Of rows that repeat id and text one stays, of other rows all, with columns of any name."""
    one, two = (" ".join(f"{w}{i}" for i in range(20)) for w in "ab")
    rows = [(3, one), (3, one), (5, one), (4, two), (7, None), (7, None), (8, None), (None, two), (None, two), (None, None), (9, ""), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' goes", "'y' again", "'z' `row`", "0 count")
    kept = corpus_pipeline.ngram_join(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    found = sorted((tuple(r) for r in kept.collect()), key=str)
    left = [(3, one), (4, two), (7, None), (8, None), (None, two), (None, two), (None, None), (9, "")]
    assert found == sorted([(*r, "x", "y", "z", 0) for r in left], key=str)


def test_stages_of_nothing(spark, tmp_path):
    for name, columns in {"labels": LABELS, "benchmark": "item_id long, text string"}.items():
        spark.createDataFrame([], columns).write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0


@pytest.mark.parametrize("n", [0, 1])
def test_components_of_few_links(spark, n):
    from fieldstone.llm.graph import components

    links = spark.createDataFrame([(1, 2), (2, 3), (7, 3), (9, 8)][: n * 4], "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == ({1: 1, 2: 1, 3: 1, 7: 1, 8: 8, 9: 8} if n else {})


def test_pipeline_hands_on_small_batches(spark, tmp_path, monkeypatch):
    """Tasks of a stage hold a few megabytes of texts at once; the session's own setting comes back."""
    spark.range(200, numPartitions=1).selectExpr("id doc_id", "repeat('some words ', 10000) text").write.parquet(f"{tmp_path}/documents.parquet")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["size"])

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("sizes", lambda spark, docs, sf_dir: docs.mapInArrow(sizes, "size long"))])
    before = spark.conf.get(corpus_pipeline.BATCH[0])
    found = [r[0] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sum(found) > 20_000_000 and max(found) < 8_000_000
    assert spark.conf.get(corpus_pipeline.BATCH[0]) == before


def test_stages_hand_on_small_batches(spark, monkeypatch):
    """A stage called alone hands on small batches too, also when its frame is computed later."""
    key = corpus_pipeline.BATCH[0]
    before = spark.conf.get(key)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["size"])

    monkeypatch.setattr(corpus_pipeline, "pack", lambda docs, vocabulary: docs.mapInArrow(sizes, "size long"))
    docs = spark.range(200, numPartitions=1).selectExpr("id doc_id", "repeat('some words ', 10000) text")
    try:
        spark.conf.set(key, "256MB")
        found = [r[0] for r in corpus_pipeline.packing(spark, docs, "").collect()]
        assert sum(found) > 20_000_000 and max(found) < 8_000_000
        assert all(hasattr(stage, "__wrapped__") for _, stage in corpus_pipeline.STAGES)
    finally:
        spark.conf.set(key, before)
