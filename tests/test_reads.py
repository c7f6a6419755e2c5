"""Predicates, selections, JSON and streams on small records."""

import datetime as dt

import pytest
from fixtures import countries, rows
from pyspark.sql import functions as F

from fieldstone.catalog import BOOL, DATE, INT, STRING, ArrayOf, Catalog, DefinitionError, Enumeration, Field, Model, Ref
from fieldstone.operators.predicates import FilterError
from fieldstone.operators.quality import check_json
from fieldstone.operators.query import list_, read
from fieldstone.session import scratch_path
from fieldstone.sources.json_records import read_records, to_response
from fieldstone.sources.store import Store
from fieldstone.streaming.feeds import change_feed, stream_changes, stream_list

CATALOG = Catalog(
    (
        Model(
            "Task",
            1,
            (
                Field("id", INT, 1, primary=True),
                Field("title", STRING, 2),
                Field("due", DATE, 3, optional=True),
                Field("state", Enumeration("State", ("open", "done")), 4),
                Field("parent", Ref("Task"), 5, optional=True),
                Field("done", BOOL, 6, default=False),
                Field("tags", ArrayOf(STRING), 7),
                Field("parts", ArrayOf(Ref("Task")), 8),
            ),
        ),
    )
)


@pytest.fixture(scope="module")
def tasks(spark):
    table = [
        (1, "50%_off", dt.date(2024, 1, 5), "open", None, False),
        (2, "50 off", dt.date(2024, 1, 6), "done", 1, True),
        (3, "other", None, "open", 2, False),
    ]
    return Store(
        spark,
        CATALOG,
        {"Task": spark.createDataFrame(table, CATALOG.struct("Task"))},
        {
            ("Task", "tags"): spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (2, "c")], "source bigint, target string"),
            ("Task", "parts"): spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "source bigint, target bigint"),
        },
    )


def found(store, *filters):
    return [r["id"] for r in list_(store, "Task", list(filters), order_by="id", select=[]).records.collect()]


@pytest.mark.parametrize(
    "test,want",
    [
        ({}, [1, 2, 3]),
        ({"title": {"startsWith": "50%_"}}, [1]),
        ({"title": {"endsWith": "off"}}, [1, 2]),
        ({"title": {"pattern": "50%off"}}, [1, 2]),
        ({"title": {"length": {"lt": 6}}}, [3]),
        ({"title": {"startsWith": "50", "length": {"gt": 6}}}, [1]),
        ({"due": None}, [3]),
        ({"due": {}}, [1, 2]),
        ({"due": {"after": "2024-01-05T00:00:00Z"}}, [2]),
        ({"due": {"before": "2024-01-05T00:00:01Z"}}, [1]),
        ({"due": {"eq": "2024-01-06T02:00:00+02:00"}}, [2]),
        ({"due": {"eq": "2024-01-06T01:00:00Z"}}, []),
        ({"state": {"eq": "done"}}, [2]),
        ({"done": {"eq": False}}, [1, 3]),
        ({"parent": None}, [1]),
        ({"parent": {"parent": {"title": {"startsWith": "50"}}}}, [3]),
        ({"parent": {"tags": {"length": {"eq": 3}}}}, [2]),
        ({"tags": {"length": {"eq": 0}}}, [3]),
        ({"predicate": {"due": {"after": "2024-01-05T00:00:00Z"}}, "negated": True}, [1]),
        ({"predicate": {"id": {"eq": 1}}, "and": [{"id": {"eq": 2}}], "or": [{"id": {"gte": 3}}]}, [3]),
        ({"or": [{"id": {"eq": 2}}]}, [1, 2, 3]),
    ],
)
def test_predicates(tasks, test, want):
    assert found(tasks, test) == want


@pytest.mark.parametrize(
    "test",
    [{"nothing": {}}, {"id": {"startsWith": "a"}}, {"state": {"eq": "lost"}}, {"title": 5}, {"tags": {"eq": 1}}],
)
def test_refused_predicates(tasks, test):
    with pytest.raises((FilterError, DefinitionError)):
        found(tasks, test)


def test_self_references_and_nested_lists(tasks):
    select = [
        "title",
        {"parent": ["title", {"parent": ["title"]}]},
        {"sub": {"field": "parts", "select": ["title", {"tags": True}], "order_by": ("title", "DESCENDING")}},
        {"tags": {"filter": [{"eq": "a"}]}},
    ]
    got = {r["id"]: r.asDict(recursive=True) for r in list_(tasks, "Task", select=select).nested().collect()}
    assert got[3]["parent"]["parent"] == {"id": 1, "title": "50%_off"}
    assert got[1]["parent"] is None
    assert got[1]["sub"] == [{"id": 3, "title": "other", "tags": []}, {"id": 2, "title": "50 off", "tags": ["c"]}]
    assert got[1]["tags"] == ["a", "a"] and got[2]["tags"] == []


def test_lists_below_a_reference(tasks):
    row = read(tasks, "Task", 2, [{"parent": [{"tags": {"order_by": "DESCENDING", "to": 2}}]}]).nested().first()
    assert row["parent"]["tags"] == ["b", "a"]


def test_nested_keeps_the_order(tasks):
    got = list_(tasks, "Task", order_by=("due", "DESCENDING"), select=[{"tags": True}]).nested().collect()
    assert [r["id"] for r in got] == [3, 2, 1]


def test_hidden_secret(spark):
    catalog = Catalog(
        (Model("U", 1, (Field("id", INT, 1, primary=True), Field("pw", STRING, 2, secret_credential=True)), user=True),)
    )
    store = Store(spark, catalog)
    assert list_(store, "U").records.columns == ["id"]
    for use in ({"select": ["pw"]}, {"filter": [{"pw": {}}]}, {"order_by": "pw"}):
        with pytest.raises((DefinitionError, FilterError)):
            list_(store, "U", **use)


def test_json_in_and_out(spark):
    lines = ['{"code": "DK", "name": "Denmark", "gnp": null}', '{"code": "NO", "cities": ["Oslo"]}']
    raw = spark.createDataFrame([(x,) for x in lines], "value string")
    got = {r["code"]: r for r in read_records(spark, raw, countries(spark).catalog, "Country").collect()}
    assert got["DK"]["_present"] == ["code", "name", "gnp"] and got["NO"]["cities"] == ["Oslo"]
    out = to_response(spark.createDataFrame([(dt.date(2024, 2, 3), None)], "d date, x int"), {"d": "day"})
    assert out.first()["json"] == '{"day":"2024-02-03","x":null}'


def test_json_violations(spark):
    lines = [
        '{"id": 1, "title": "a", "due": "2024-01-01T10:00:00Z", "state": "open", "done": true, "tags": [], "parts": []}',
        '{"id": 2.5, "title": 3, "due": "2024-02-30", "state": "lost", "done": "yes", "tags": ["x", 1], "parts": [1]}',
        '{"id": 3.0, "title": "a", "due": null, "state": "open", "done": false, "tags": "x", "parts": [{"id": 1}], "odd": 1}',
        '{"id": 4, "title": null, "state": "open", "done": false}',
        "[1]",
        "not json",
    ]
    raw = spark.createDataFrame([(x,) for x in lines], "value string")
    got = {(r["key"], r["field"], r["rule"]) for r in check_json(raw, CATALOG, "Task").collect()}
    assert got == {
        *(("2.5", f, "type") for f in ("id", "title", "due", "state", "done")),
        *(("2.5", f, "element") for f in ("tags", "parts")),
        ("3.0", "tags", "type"),
        ("3.0", "odd", "unknown_field"),
        *(("3.0", f"parts.{f}", "missing_field") for f in ("title", "state", "done", "tags", "parts")),
        ("4", "title", "type"),
        ("4", "tags", "missing_field"),
        ("4", "parts", "missing_field"),
        (None, None, "json"),
    }


def test_change_feed(spark, tasks):
    prev = tasks.scan("Task")
    assert change_feed(prev, prev, CATALOG, "Task").count() == 0
    curr = prev.where("id <> 1").withColumn("title", F.when(F.col("id") == 2, "new").otherwise(F.col("title")))
    curr = curr.union(prev.where("id = 1").withColumn("id", F.lit(9).cast("bigint")))
    feed = {r["id"]: r["event"] for r in change_feed(prev, curr, CATALOG, "Task").collect()}
    assert feed == {1: "REMOVE", 2: "CHANGE", 9: "NEW"}


def _drain(sdf, path, checkpoint):
    stream = sdf.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    stream.awaitTermination()
    return sdf.sparkSession.read.schema(sdf.schema).parquet(path)


def test_stream_changes(spark):
    source, path, checkpoint = (scratch_path(spark, n) for n in ("changes", "events", "events-checkpoint"))
    catalog = Catalog((Model("M", 1, (Field("id", INT, 1, primary=True), Field("v", STRING, 2, optional=True))),))
    schema = "id bigint, v string, _op string, _seq bigint"
    rounds = [
        # Net change per round; a record made and deleted in one round leaves no event.
        ([(1, "a", "upsert", 1), (1, "b", "upsert", 2), (2, "x", "upsert", 3), (3, "y", "upsert", 4), (3, None, "delete", 5)],
         [("NEW", 1, "b"), ("NEW", 2, "x")]),
        # Unchanged, changed to null, and older than what was seen.
        ([(1, "b", "upsert", 6), (2, None, "upsert", 7), (3, "late", "upsert", 4)], [("CHANGE", 2, None)]),
        ([(1, None, "delete", 8), (2, None, "delete", 9), (2, "z", "upsert", 10)], [("CHANGE", 2, "z"), ("REMOVE", 1, "b")]),
    ]
    seen = []
    for batch, want in rounds:
        spark.createDataFrame(batch, schema).write.mode("append").parquet(source)
        sdf = spark.readStream.schema(schema).parquet(source)
        events = rows(_drain(stream_changes(sdf, catalog, "M"), path, checkpoint))
        assert sorted(set(events) - set(seen), key=repr) == sorted(want, key=repr)
        seen = events


def test_stream_refuses_lists(spark, tasks):
    path = scratch_path(spark, "tasks")
    tasks.scan("Task").write.parquet(path)
    sdf = spark.readStream.schema(tasks.scan("Task").schema).parquet(path)
    with pytest.raises(ValueError):
        stream_list(sdf, tasks, "Task", select=[{"tags": True}])
    out = stream_list(sdf, tasks, "Task", [{"parent": {"done": {"eq": True}}}], ["title", {"parent": ["title"]}])
    assert [r["parent"]["title"] for r in _drain(out, scratch_path(spark, "out"), scratch_path(spark, "cp")).collect()] == ["50 off"]
