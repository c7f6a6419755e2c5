"""Hooks on users and their todos."""

import pytest
from fixtures import rows
from pyspark.sql import functions as F

from fieldstone.catalog import BOOL, STRING, ArrayOf, Catalog, Field, Model, Ref
from fieldstone.functions.registry import HookError, register
from fieldstone.operators.mutate import create, delete
from fieldstone.operators.query import list_, read
from fieldstone.sources.store import Store

register("prefix name", lambda df: df.withColumn("username", F.concat(F.lit("Mr. "), "username")))
register("first todo", lambda df: df.withColumn("priorityTodo", F.struct(F.col("todos")[0]["title"].alias("title"))))
register(
    "decorate",
    lambda df: df.withColumn("title", F.when(F.col("done"), F.col("title")).otherwise(F.concat(F.lit("* "), "title"))),
)

CATALOG = Catalog(
    (
        Model(
            "User",
            1,
            (
                Field("username", STRING, 1, primary=True),
                Field("todos", ArrayOf(Ref("Todo")), 2),
                Field("priorityTodo", Ref("Todo"), 3, optional=True),
            ),
            on_write=("prefix name", "first todo"),
        ),
        Model(
            "Todo",
            2,
            (
                Field("title", STRING, 1, primary=True),
                Field("content", STRING, 2),
                Field("done", BOOL, 3),
            ),
            on_read=("decorate",),
        ),
    )
)


@pytest.fixture(scope="module")
def store(spark):
    store = Store(spark, CATALOG)
    todos = [
        {"title": "wash", "content": "dishes", "done": False},
        {"title": "cook", "content": "rice", "done": True},
    ]
    return store.apply(create(store, "User", {"username": "Jo", "todos": todos}))


def test_write_hooks_run_in_order(store):
    assert rows(store.scan("User")) == [("Mr. Jo", "wash")]


def test_nested_read_hooks(store):
    select = [{"priorityTodo": ["title", "done"]}, {"todos": ["title", "done"]}]
    row = read(store, "User", "Mr. Jo", select).nested().first()
    assert row["priorityTodo"]["title"] == "* wash"
    assert sorted(t["title"] for t in row["todos"]) == ["* wash", "cook"]


def test_unselected_field_reads_as_null(store):
    assert rows(list_(store, "Todo", select=["title"]).records) == [("* cook",), ("* wash",)]


def test_alias_after_hooks(store):
    found = list_(store, "Todo", select={"name": "content", "done": True}).records
    assert found.columns == ["title", "name", "done"]


def test_hook_must_return_records(spark):
    model = Model("M", 1, (Field("id", STRING, 1, primary=True),), on_write=(lambda df: 7,))
    with pytest.raises(HookError):
        create(Store(spark, Catalog((model,))), "M", {"id": "a"})


def test_delete_hook_replaces_the_key(spark):
    shift = lambda df: df.withColumn("id", F.concat(F.col("id"), F.lit("!")))
    model = Model("M", 1, (Field("id", STRING, 1, primary=True),), on_delete=(shift,))
    catalog = Catalog((model,))
    table = spark.createDataFrame([("a",), ("a!",)], catalog.struct("M"))
    store = Store(spark, catalog, {"M": table})
    assert rows(store.apply(delete(store, "M", "a")).scan("M")) == [("a",)]
