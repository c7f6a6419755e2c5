"""The registered queries of this package."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldstone.llm.ann import search
from fieldstone.llm.collocations import mine_collocations
from fieldstone.llm.decontaminate import find_leaks, leak_report
from fieldstone.llm.licenses import license_digest, scan_licenses
from fieldstone.llm.line_dedup import dedup_lines
from fieldstone.llm.ngram_join import near_components
from fieldstone.llm.packing import pack
from fieldstone.llm.pii import pii_digest, scan_pii
from fieldstone.llm.ppm import ppm_digest
from fieldstone.llm.secret_scan import scan_secrets, secret_digest, train_net
from fieldstone.llm.simhash_join import simhash_components, simhash_digest
from fieldstone.llm.text import table
from fieldstone.llm.token_alignment import alignment_digest
from fieldstone.llm.toxicity import score_toxicity, toxicity_digest, train_toxicity

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
BYTE_PAIRS = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak_report(*find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"), size=4, percent=85)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("removed_spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return kept.select("doc_id", "text", spans.alias("removed_spans"), "removed_words")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity_digest(score_toxicity(docs, train_toxicity(docs, table(spark, sf_dir, "labels"))))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), VOCABULARY)


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_digest(scan_licenses(table(spark, sf_dir, "documents")))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secret_digest(scan_secrets(docs, train_net(docs)))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(scan_pii(table(spark, sf_dir, "documents")))


def op10_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm_digest(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_collocations(table(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_digest(table(spark, sf_dir, "documents"), BYTE_PAIRS, PIECES)


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_digest(simhash_components(table(spark, sf_dir, "documents")))


_ALL = (
    op1_prefix_forest, op2_winnowing, op3_ngram_join, op4_line_dedup, op5_toxicity,
    op6_packing, op7_licenses, op8_secrets, op9_pii, op10_ppm,
    op11_collocations, op12_token_alignment, op13_simhash,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SPACED = rf"regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+')"

#: SQL for what SQL can express; the other queries are tested against plain Python or on held-out rows.
ORACLES: dict[str, str] = {
    "op2_winnowing": f"""
    WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_TERMS} AS t FROM documents),
    i AS (SELECT item_id, t, least(len(t), 10) AS n FROM (SELECT item_id, {_TERMS} AS t FROM benchmark WHERE item_id IS NOT NULL) WHERE len(t) > 0),
    iw AS (SELECT DISTINCT item_id, n, array_to_string(t[s : s + n - 1], ' ') AS g
           FROM (SELECT item_id, t, n, unnest(range(1, len(t) - n + 2)) AS s FROM i)),
    sizes AS (SELECT DISTINCT n FROM i),
    dw AS (SELECT r, n, s, array_to_string(t[s : s + n - 1], ' ') AS g
           FROM (SELECT r, t, n, unnest(range(1, len(t) - n + 2)) AS s FROM d JOIN sizes ON len(t) >= n)),
    hits AS (SELECT r, s, n, item_id FROM dw JOIN iw USING (n, g)),
    covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM hits) GROUP BY r),
    named AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
              FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY r)
    SELECT doc_id, CAST(len(t) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
    """,
    "op3_ngram_join": f"""
    WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER () AS r, {_SPACED} AS t FROM documents),
    sh AS (SELECT DISTINCT r, array_to_string(t[s : s + 3], ' ') AS g
           FROM (SELECT r, t, unnest(range(1, greatest(len(t) - 3, 1) + 1)) AS s FROM d WHERE len(t) > 0)),
    n AS (SELECT r, count(*) AS n FROM sh GROUP BY r),
    pairs AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM sh a JOIN sh b USING (g) WHERE a.r <> b.r GROUP BY 1, 2),
    link AS (SELECT x, y FROM pairs JOIN n nx ON nx.r = x JOIN n ny ON ny.r = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
    reach AS (SELECT r AS x, r AS y FROM d UNION SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(o.doc_id) AS component_id
    FROM d JOIN reach ON reach.x = d.r JOIN d o ON o.r = reach.y LEFT JOIN n ON n.r = d.r GROUP BY d.r, d.doc_id, n.n
    """,
    "op11_collocations": f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, 'und') AS lang, string_split_regex({_LOW}, '[.,;:!?\x0A-\x0D]') AS ps FROM documents),
    p AS (SELECT r, doc_id, lang, generate_subscripts(ps, 1) AS o, regexp_extract_all(unnest(ps), '[^\x20\x09]+') AS t FROM d),
    q AS (SELECT r, doc_id, lang, t, coalesce(sum(len(t)) OVER (PARTITION BY r ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base
          FROM p WHERE len(t) > 0),
    total AS (SELECT lang, CAST(sum(len(t)) AS BIGINT) AS n FROM q GROUP BY lang),
    grams AS (SELECT lang, m, array_to_string(t[s : s + m - 1], ' ') AS phrase, doc_id, CAST(base + s - 1 AS BIGINT) AS word
              FROM (SELECT *, unnest(range(1, len(t) - m + 2)) AS s FROM q, (SELECT unnest(range(1, 6)) AS m) WHERE len(t) >= m)),
    f AS (SELECT lang, m, phrase, count(*) AS a, min({{'n': doc_id IS NULL, 'd': doc_id, 'w': word}}) AS place FROM grams GROUP BY ALL HAVING count(*) >= 100),
    c AS (SELECT f.*, n, string_split(phrase, ' ') AS w FROM f JOIN total USING (lang) WHERE m > 1),
    cuts AS (SELECT c.lang, c.phrase, c.m, c.a, c.n, c.place, k, l.a AS l, x.a AS r,
                    CAST((1000::HUGEINT * c.a * c.n) // (l.a::HUGEINT * x.a) AS BIGINT) AS score
             FROM (SELECT *, unnest(range(1, m)) AS k FROM c) c
             JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1 : k], ' ')
             JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[k + 1 : c.m], ' ')),
    weakest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    inner_ AS (SELECT DISTINCT lang, a, array_to_string(w[s : s + j - 1], ' ') AS phrase
               FROM (SELECT *, unnest(range(1, m - j + 2)) AS s FROM (SELECT *, unnest(range(2, m)) AS j FROM c WHERE m > 2))),
    kept AS (SELECT * FROM weakest x WHERE NOT EXISTS (SELECT 1 FROM inner_ i WHERE i.lang = x.lang AND i.phrase = x.phrase AND 100 * i.a >= 100 * x.a))
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score,
           place.d AS doc_id, CASE WHEN NOT place.n THEN place.w END AS word
    FROM kept QUALIFY rank <= 2000
    """,
}
