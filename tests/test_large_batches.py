"""Mutations give the same tables whether the batch fits a broadcast or not."""

import pytest
from fixtures import countries, rows
from pyspark.sql import functions as F

from fieldstone.functions import joins
from fieldstone.operators import mutate
from fieldstone.operators.quality import ConstraintError


def tables(store):
    return {
        "Country": rows(store.scan("Country")),
        "Citizen": rows(store.scan("Citizen")),
        "citizens": rows(store.links("Country", "citizens")),
        "cities": rows(store.links("Country", "cities")),
    }


def history(spark):
    """A create, a patch with a new key, a push, a removal and a delete."""
    store = countries(spark)
    new = spark.createDataFrame(
        [("N1", "One", [("Ann",), ("Nuria",)]), ("N2", "Two", [])],
        "code string, name string, citizens array<struct<name: string>>",
    )
    people = spark.createDataFrame([("Ann", "PE"), ("Bob", "IS")], "name string, home string")
    store = store.apply(mutate.create_many(store, "Citizen", people))
    store = store.apply(mutate.create_many(store, "Country", new))
    patch = spark.createDataFrame(
        [("PE", "PER", "States", ["x", "y"])], "_key string, code string, name string, cities array<string>"
    )
    store = store.apply(mutate.update_many(store, "Country", patch))
    items = spark.createDataFrame([("IS", "Bob"), ("IS", "Bob"), ("PER", "Bela")], "source string, item string")
    store = store.apply(mutate.push_many_to(store, "Country", "citizens", items))
    store = store.apply(mutate.remove_many_from(store, "Country", "citizens", items.limit(1).toDF("source", "target")))
    store = store.apply(mutate.delete_many(store, "Country", items.where("source = 'IS'").select(F.col("source").alias("code"))))
    return store


def test_same_tables(spark, monkeypatch):
    near = tables(history(spark))
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    assert tables(history(spark)) == near
    assert ("Bob", None) in near["Citizen"] and ("Ann", "PER") in near["Citizen"]


def test_same_refusals(spark, monkeypatch):
    store = countries(spark)
    bad = spark.createDataFrame([("X", "Nowhere")], "name string, home string")
    twice = spark.createDataFrame([("Nuria", "PE")], "name string, home string")
    lost = spark.createDataFrame([("ZZ", "x")], "code string, name string")
    for _ in range(2):
        for act in (
            lambda: mutate.create_many(store, "Citizen", bad),
            lambda: mutate.create_many(store, "Citizen", twice),
            lambda: mutate.update_many(store, "Country", lost),
            lambda: mutate.delete_many(store, "Country", lost.select("code")),
        ):
            with pytest.raises(ConstraintError):
                act()
        monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
