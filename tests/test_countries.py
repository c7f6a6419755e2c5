"""Golden cases on the country / citizen records."""

import pytest
from fixtures import countries, rows
from pyspark.sql import functions as F

from fieldstone.operators.mutate import (
    EmptyRecord,
    create,
    create_many,
    delete,
    push_many_to,
    push_to,
    remove_from,
    run_group,
    update,
    update_many,
)
from fieldstone.operators.quality import ConstraintError, check_all
from fieldstone.operators.query import RecordNotFound, list_, read


@pytest.fixture(scope="module")
def store(spark):
    return countries(spark)


def citizens(store, code):
    found = read(store, "Country", code, select=[{"citizens": ["name"]}]).nested().first()
    return [c["name"] for c in found["citizens"]]


def test_nested_read_includes_the_key(store):
    row = read(store, "Country", "PE", select=[{"citizens": ["name"]}]).nested().first().asDict(recursive=True)
    assert row == {"code": "PE", "citizens": [{"name": "Nuria"}]}


def test_list_has_empty_arrays(store):
    found = list_(store, "Country", select=["name", {"citizens": ["name"]}]).nested()
    got = {r["code"]: [c["name"] for c in r["citizens"]] for r in found.collect()}
    assert got == {"KE": ["Bela"], "PE": ["Nuria"], "FJ": [], "IS": []}


def test_create_fills_the_default(store):
    changes = create(store, "Country", {"code": "JP", "name": "Japan"}, select=["population"])
    assert changes.result.records.first()["population"] == 0


def test_explicit_null_is_not_absent(store):
    with pytest.raises(ConstraintError):
        create(store, "Country", {"code": "JP", "name": "Japan", "population": None})


def test_create_with_existing_child(store):
    after = store.apply(create(store, "Country", {"code": "DK", "name": "Denmark", "citizens": [{"name": "Nuria"}]}))
    assert citizens(after, "DK") == ["Nuria"]
    assert after.scan("Citizen").count() == 2


def test_nested_create(store):
    record = {"name": "Jeff", "home": {"code": "CA", "name": "Canada"}}
    changes = create(store, "Citizen", record, select=[{"home": ["name", "population"]}])
    assert changes.result.records.first()["home"].asDict() == {"code": "CA", "name": "Canada", "population": 0}
    after = store.apply(changes)
    assert read(after, "Country", "CA").records.count() == 1


def test_reference_to_existing_record(store):
    changes = create(store, "Citizen", {"name": "Jackson", "home": {"code": "PE"}}, select=[{"home": ["name"]}])
    assert changes.result.records.first()["home"]["name"] == "Peru"
    assert store.apply(changes).scan("Country").count() == 4


def test_dangling_reference_is_refused(store):
    with pytest.raises(ConstraintError):
        create(store, "Citizen", {"name": "Nobody", "home": {"code": "XX"}})


def test_duplicate_key_is_refused(store):
    with pytest.raises(ConstraintError):
        create(store, "Citizen", {"name": "Nuria"})


def test_empty_record_is_refused(store):
    with pytest.raises(EmptyRecord):
        create(store, "Citizen", {})


def test_push_delete_remove_in_sequence(store):
    store = store.apply(create(store, "Citizen", {"name": "Jackson", "home": {"code": "PE"}}))
    pushed = push_to(store, "Country", "citizens", "PE", {"name": "Jackson"}, select=["name"])
    assert rows(pushed.result.records) == [("Jackson",)]
    store = store.apply(pushed)
    assert citizens(store, "PE") == ["Jackson", "Nuria"]

    gone = delete(store, "Citizen", "Jackson", select=[{"home": ["name"]}])
    assert gone.result.records.first()["home"]["name"] == "Peru"
    store = store.apply(gone)
    assert citizens(store, "PE") == ["Nuria"]
    with pytest.raises(RecordNotFound):
        read(store, "Citizen", "Jackson")

    removed = remove_from(store, "Country", "citizens", "PE", "Nuria", select=["name"])
    assert rows(removed.result.records) == [("Nuria",)]
    store = store.apply(removed)
    assert citizens(store, "PE") == []
    assert rows(store.scan("Citizen", ["name"])) == [("Bela",), ("Nuria",)]


def test_patch_keeps_other_fields(store):
    changes = update(store, "Country", "PE", {"name": "United States"})
    assert rows(changes.result.records) == [("PE", "United States", 33000, 268.5)]


def test_range_over_a_filter(store):
    store = store.apply(create(store, "Country", {"code": "DK", "name": "Denmark", "population": 1000}))
    found = list_(store, "Country", filter=[{"population": {"gt": 100}}], from_=1, to=3, select=[])
    assert found.records.count() == 3


def test_array_length(store):
    after = store.apply(create(store, "Country", {"code": "DK", "name": "Denmark", "citizens": [{"name": "Nuria"}]}))
    after = after.apply(push_to(after, "Country", "citizens", "PE", {"name": "Bela"}))
    found = list_(after, "Country", filter=[{"citizens": {"length": {"eq": 1}}}], select=[])
    assert rows(found.records) == [("DK",), ("KE",)]


def test_patch_missing_record_is_refused(store):
    with pytest.raises(ConstraintError):
        update(store, "Country", "XX", {"name": "Nowhere"})


def test_patch_reference_three_ways(store):
    store = store.apply(create(store, "Citizen", {"name": "Jo", "home": {"code": "PE"}}))
    # The key alone repoints.
    after = store.apply(update(store, "Citizen", "Jo", {"home": {"code": "IS"}}))
    assert read(after, "Citizen", "Jo", ["home"]).records.first()["home"] == "IS"
    # With the key and more, that child is patched.
    after = store.apply(update(store, "Citizen", "Jo", {"home": {"code": "IS", "name": "Sagaland"}}))
    assert read(after, "Citizen", "Jo", ["home"]).records.first()["home"] == "PE"
    assert read(after, "Country", "IS", ["name"]).records.first()["name"] == "Sagaland"
    # Without the key, the current child is patched.
    after = store.apply(update(store, "Citizen", "Jo", {"home": {"population": 7}}))
    assert read(after, "Country", "PE", ["population"]).records.first()["population"] == 7
    # Null empties an optional reference.
    after = store.apply(update(store, "Citizen", "Jo", {"home": None}))
    assert read(after, "Citizen", "Jo", ["home"]).records.first()["home"] is None


def test_patch_children_and_values(store):
    store = store.apply(create(store, "Country", {"code": "DK", "name": "Denmark", "cities": ["Aarhus", "Odense"]}))
    assert rows(store.links("Country", "cities")) == [("DK", "Aarhus"), ("DK", "Odense")]
    after = store.apply(update(store, "Country", "DK", {"cities": ["Ribe"], "name": "Danmark"}))
    assert rows(after.links("Country", "cities")) == [("DK", "Ribe")]
    after = store.apply(update(store, "Country", "PE", {"citizens": [{"name": "Nuria", "home": {"code": "PE"}}]}))
    assert read(after, "Citizen", "Nuria", ["home"]).records.first()["home"] == "PE"
    assert citizens(after, "PE") == ["Nuria"]


def test_later_patch_wins_per_field(spark, store):
    patches = spark.createDataFrame(
        [
            ("PE", "A", 1, ["code", "name", "population"], 1),
            ("PE", "B", None, ["code", "name"], 2),
            ("IS", None, 5, ["code", "population"], 3),
        ],
        "code string, name string, population bigint, _present array<string>, _ord int",
    )
    after = store.apply(update_many(store, "Country", patches))
    got = {r["code"]: (r["name"], r["population"]) for r in after.scan("Country").collect()}
    assert got["PE"] == ("B", 1) and got["IS"] == ("Iceland", 5)


def test_changed_key_reaches_references_and_links(store):
    store = store.apply(create(store, "Citizen", {"name": "Jo", "home": {"code": "PE"}}))
    after = store.apply(update(store, "Country", "PE", {"code": "PER"}))
    assert read(after, "Citizen", "Jo", ["home"]).records.first()["home"] == "PER"
    assert citizens(after, "PER") == ["Nuria"]
    assert check_all(after, "Country").count() == 0


def test_delete_nulls_optional_references(store):
    store = store.apply(create(store, "Citizen", {"name": "Jo", "home": {"code": "IS"}}))
    after = store.apply(delete(store, "Country", "IS"))
    assert read(after, "Citizen", "Jo", ["home"]).records.first()["home"] is None


def test_cascade_deletes_the_referenced_child(store):
    store = store.apply(create(store, "Citizen", {"name": "Jo", "home": {"code": "IS"}}))
    after = store.apply(delete(store, "Citizen", "Jo", cascade=True))
    assert rows(after.scan("Country", ["code"])) == [("FJ",), ("KE",), ("PE",)]


def test_push_then_remove_restores_links(spark, store):
    items = spark.createDataFrame([("IS", "Bela"), ("IS", "Bela"), ("FJ", "Nuria")], "source string, item string")
    pushed = store.apply(push_many_to(store, "Country", "citizens", items))
    assert pushed.links("Country", "citizens").count() == 5
    # All equal links go at once.
    after = pushed.apply(remove_from(pushed, "Country", "citizens", "IS", "Bela"))
    after = after.apply(remove_from(after, "Country", "citizens", "FJ", "Nuria"))
    assert rows(after.links("Country", "citizens")) == rows(store.links("Country", "citizens"))


def test_group_is_all_or_nothing(store):
    steps = [
        lambda s: create(s, "Country", {"code": "NO", "name": "Norway"}),
        lambda s: push_to(s, "Country", "citizens", "NO", {"name": "Bela"}),
    ]
    after, results = run_group(store, steps)
    assert citizens(after, "NO") == ["Bela"] and len(results) == 2
    with pytest.raises(ConstraintError):
        run_group(store, [*steps, lambda s: create(s, "Country", {"code": "NO", "name": "again"})])
    assert store.scan("Country").count() == 4


def test_negated_twice_is_identity(store):
    test = {"population": {"gt": 930}}
    once = list_(store, "Country", filter=[{"predicate": test, "negated": True}], select=[])
    rest = list_(store, "Country", filter=[{"predicate": test}], select=[])
    assert rows(once.records.union(rest.records)) == rows(store.scan("Country", ["code"]))


def test_long_arrays_come_in_parts(spark, store):
    items = spark.range(25).select(F.lit("IS").alias("source"), F.format_string("c%02d", "id").alias("item"))
    after = store.apply(push_many_to(store, "Country", "cities", items))
    packed = list_(after, "Country", select=["name", {"cities": True}]).nested_parts(max_items=10)
    parts = {(r["code"], r["_part"]): r["cities"] for r in packed.collect()}
    assert [len(parts[("IS", i)]) for i in range(3)] == [10, 10, 5]
    assert sum((parts[("IS", i)] for i in range(3)), []) == [f"c{i:02d}" for i in range(25)]
    assert parts[("PE", 0)] == []


def test_nested_has_one_shape(spark, store):
    found = list_(store, "Country", select=["name", {"cities": True}])
    items = spark.range(25).select(F.lit("IS").alias("source"), F.format_string("c%02d", "id").alias("item"))
    more = list_(store.apply(push_many_to(store, "Country", "cities", items)), "Country", select=["name", {"cities": True}])
    assert found.nested(10).dtypes == more.nested(10).dtypes and found.nested_parts(10).dtypes == more.nested_parts(10).dtypes
    assert "_part" not in more.nested(10).columns and "_part" in found.nested_parts(10).columns
    assert more.nested(25).count() == store.scan("Country").count()
    with pytest.raises(Exception, match="more than 24 elements"):
        more.nested(24).collect()
