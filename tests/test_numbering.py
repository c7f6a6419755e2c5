"""Row numbers without a window over one group, with bounds lowered so that every way runs."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from fieldstone.functions import joins, numbering
from fieldstone.functions.numbering import dense_ids, largest_group, number_rows, ranked


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows belong to one group, and its pairs repeat."""
    hot = spark.range(0, 400).select(F.lit(7).alias("g"), (F.col("id") % 5).alias("v"))
    rest = spark.range(0, 800).select((F.col("id") % 90).cast("int").alias("g"), (F.col("id") % 11).alias("v"))
    return hot.union(rest).repartition(6)


def positions(df, name="p"):
    return sorted((r["g"], r["v"], r[name]) for r in df.collect())


def test_number_rows_equals_row_number(skewed):
    order = [F.col("v").asc_nulls_last()]
    window = Window.partitionBy("g").orderBy("v")
    want = positions(skewed.withColumn("p", F.row_number().over(window)))
    assert positions(number_rows(skewed, order, "p", "g", ties=True)) == want


def test_global_numbers_are_dense(skewed):
    got = number_rows(skewed, [F.col("g").desc(), F.col("v").asc()], "p", ties=True).collect()
    assert sorted(r["p"] for r in got) == list(range(1, 1201))
    by_place = sorted(got, key=lambda r: r["p"])
    assert [(r["g"], r["v"]) for r in by_place] == sorted(((r["g"], r["v"]) for r in got), key=lambda k: (-k[0], k[1]))


def test_dense_ids(skewed):
    assert sorted(r["p"] for r in dense_ids(skewed, "p").collect()) == list(range(1, 1201))


@pytest.mark.parametrize("offset,limit", [(0, None), (3, None), (0, 5), (2, 300), (380, 100)])
def test_ranked_ways_agree(skewed, monkeypatch, offset, limit):
    order = [F.col("v").asc()]
    want = positions(ranked(skewed, "g", order, "p", offset, limit, ties=True))
    monkeypatch.setattr(numbering, "WINDOW_GROUP_ROWS", 10)
    monkeypatch.setattr(numbering, "GROUP_LIMIT_ROWS", 4)
    assert positions(ranked(skewed, "g", order, "p", offset, limit, ties=True)) == want


def test_largest_group(skewed):
    assert largest_group(skewed, "g") >= 400


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.one_of(st.none(), st.integers(-2, 2))), min_size=1, max_size=30))
def test_nulls_and_ties(spark, rows):
    df = spark.createDataFrame(rows, "g int, v int")
    got = number_rows(df, [F.col("v").asc_nulls_last()], "p", "g", ties=True).collect()
    for g in {r[0] for r in rows}:
        mine = sorted(((r["p"], r["v"]) for r in got if r["g"] == g))
        assert [p for p, _ in mine] == list(range(1, len(mine) + 1))
        values = [v for _, v in mine]
        assert values == sorted(values, key=lambda v: (v is None, v or 0))


def test_missing_keys_both_ways(spark, skewed, monkeypatch):
    keys = spark.range(0, 80).select(F.col("id").cast("int").alias("k"))
    small = joins.rows_without(skewed, F.col("g"), keys, small=True)
    large = joins.rows_without(skewed, F.col("g"), keys, small=False)
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    shuffled = joins.rows_without(skewed, F.col("g"), keys, small=False)
    want = sorted(r["g"] for r in skewed.collect() if r["g"] >= 80)
    for found in (small, large, shuffled):
        assert sorted(r["g"] for r in found.collect()) == want
