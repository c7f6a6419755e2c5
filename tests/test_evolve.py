"""Steps between versions of the user / todo / admin catalog, and what they do to tables."""

from dataclasses import replace

import pytest
from fixtures import rows
from pyspark.sql import functions as F

from fieldstone.catalog import BOOL, INT, STRING, ArrayOf, Catalog, DefinitionError, Enumeration, Field, Model, Ref
from fieldstone.operators.evolve import (
    EvolutionError,
    add_field,
    create_model,
    differences,
    drop_field,
    drop_model,
    evolve,
    field_to_array,
    make_optional,
    migrate,
    move_primary,
    rename_field,
    rename_model,
    set_unique,
    set_uuid,
)
from fieldstone.operators.mutate import create, update
from fieldstone.operators.quality import ConstraintError, check_all
from fieldstone.operators.query import list_, read
from fieldstone.sources.store import Store

USER = Model(
    "User",
    1,
    (
        Field("id", STRING, 1, uuid=True),
        Field("username", STRING, 2, primary=True, public_credential=True),
        Field("password", STRING, 3, secret_credential=True),
        Field("isVerified", BOOL, 4, default=False),
        Field("todos", ArrayOf(Ref("Todo")), 5),
    ),
    user=True,
)
TODO = Model("Todo", 2, (Field("title", STRING, 1, primary=True),))
ADMIN = Model(
    "Admin", 3, (Field("username", STRING, 1, primary=True), Field("password", STRING, 2))
)
BASE = Catalog((USER, TODO))
WITH_ADMIN = Catalog((USER, TODO, ADMIN))


def admin(**changes):
    return Catalog((USER, TODO, replace(ADMIN, **changes)))


def test_steps():
    assert differences(BASE, BASE) == []
    assert differences(BASE, WITH_ADMIN) == [("create_model", "Admin")]
    assert differences(WITH_ADMIN, BASE) == [("drop_model", "Admin")]
    assert differences(WITH_ADMIN, admin(name="Admin1")) == [("rename_model", "Admin", "Admin1")]
    more = admin(fields=(*ADMIN.fields, Field("age", INT, 3, optional=True)))
    assert differences(WITH_ADMIN, more) == [("add_field", "Admin", "age")]
    assert differences(WITH_ADMIN, admin(fields=ADMIN.fields[:1])) == [("drop_field", "Admin", "password")]
    fields = (ADMIN.fields[0], replace(ADMIN.fields[1], name="passcode"))
    assert differences(WITH_ADMIN, admin(fields=fields)) == [("rename_field", "Admin", "password", "passcode")]
    assert differences(WITH_ADMIN, admin(name="Admin1", fields=fields)) == [
        ("rename_field", "Admin", "password", "passcode"),
        ("rename_model", "Admin", "Admin1"),
    ]


def test_renaming_a_referenced_model_changes_no_type():
    user = USER.with_field(replace(USER.field("todos"), type=ArrayOf(Ref("Task"))))
    assert differences(BASE, Catalog((user, replace(TODO, name="Task")))) == [("rename_model", "Todo", "Task")]


@pytest.mark.parametrize(
    "field",
    [
        Field("isVerified", INT, 4),
        Field("isVerified", ArrayOf(INT), 4),
        Field("isVerified", STRING, 4, optional=True),
    ],
)
def test_impossible_type_changes(field):
    with pytest.raises(EvolutionError):
        differences(BASE, BASE.with_model(USER.with_field(field)))


@pytest.fixture(scope="module")
def store(spark):
    users = spark.createDataFrame(
        [("u1", "jo", "x", True), ("u2", "al", "y", False)], BASE.struct("User")
    )
    todos = spark.createDataFrame([("wash",), ("cook",)], BASE.struct("Todo"))
    links = spark.createDataFrame([("jo", "wash"), ("jo", "cook"), ("al", "cook")], "source string, target string")
    return Store(spark, BASE, {"User": users, "Todo": todos}, {("User", "todos"): links})


def test_new_required_field_needs_a_generator(spark, store):
    with pytest.raises(EvolutionError):
        add_field(store, "User", Field("age", INT, 6))
    empty = create_model(store, ADMIN)
    assert add_field(empty, "Admin", Field("age", INT, 6)).scan("Admin").columns == ["username", "password", "age"]


def test_backfill(store):
    after = add_field(store, "User", Field("age", INT, 6, default=30))
    assert rows(after.scan("User", ["username", "age"])) == [("al", 30), ("jo", 30)]


def test_rename_and_swap(store):
    fields = tuple(
        replace(f, name={"id": "password", "password": "id"}.get(f.name, f.name)) for f in USER.fields
    )
    after = evolve(store, BASE, Catalog((replace(USER, fields=fields), TODO)))
    assert rows(after.scan("User", ["username", "id", "password"])) == [("al", "y", "u2"), ("jo", "x", "u1")]
    after = rename_model(rename_field(store, "User", "todos", "tasks"), "Todo", "Task")
    assert after.links("User", "tasks").count() == 3 and after.catalog.model("User").field("tasks").ref_model == "Task"


def test_drops(store):
    after = drop_field(store, "User", "todos")
    assert ("User", "todos") not in after.link_tables
    assert drop_model(after, "Todo").catalog.models == (after.catalog.model("User"),)
    with pytest.raises(DefinitionError):
        drop_model(store, "Todo")


def test_to_array_keeps_values(store):
    store = make_optional(add_field(store, "User", Field("nick", STRING, 6, default="n")), "User", "nick")
    store = store.apply(update(store, "User", "jo", {"nick": None}))
    after = field_to_array(store, "User", "nick")
    assert rows(after.links("User", "nick")) == [("al", "n")]
    found = list_(after, "User", select=[{"nick": True}]).nested()
    assert rows(found) == [("al", ["n"]), ("jo", [])]


def test_constraints_are_checked(spark, store):
    with pytest.raises(ConstraintError):
        set_uuid(set_uuid(store, "User", "id", on=False), "User", "id")
    same = add_field(store, "User", Field("team", STRING, 6, default="red"))
    with pytest.raises(ConstraintError):
        set_unique(same, "User", "team")
    color = Enumeration("Color", ("red", "blue"))
    model = same.catalog.model("User").without_field("team").with_field(Field("team", color, 7, default="red"))
    typed = evolve(same, same.catalog, same.catalog.with_model(model))
    fewer = model.with_field(Field("team", Enumeration("Color", ("blue",)), 7, default="blue"))
    with pytest.raises(ConstraintError):
        evolve(typed, typed.catalog, typed.catalog.with_model(fewer))


def test_move_primary_rewrites_links(store):
    after = move_primary(store, "User", "id")
    assert rows(after.links("User", "todos")) == [("u1", "cook"), ("u1", "wash"), ("u2", "cook")]
    assert check_all(after, "User").count() == 0
    back = move_primary(after, "User", "username")
    assert rows(back.links("User", "todos")) == rows(store.links("User", "todos"))


def test_versions(spark, store, tmp_path):
    path = str(tmp_path / "store")
    first = store.publish(path)
    changed = migrate(first, WITH_ADMIN)
    assert migrate(changed, WITH_ADMIN) is changed
    record = {"username": "root", "password": "p"}
    second = changed.apply(create(changed, "Admin", record)).publish()
    history = Store.versions(spark, path).orderBy("version").collect()
    assert [h["version"] for h in history] == [1, 2, 3]
    # Tables that did not change are referred to, not written again.
    assert history[2]["tables"]["User"] == history[0]["tables"]["User"]
    assert second.scan("Admin").count() == 1
    assert Store.open(spark, path, version=2).scan("Admin").count() == 0
    assert not Store.open(spark, path, version=1).catalog.has("Admin")
    assert read(Store.open(spark, path), "User", "jo", ["isVerified"]).records.first()["isVerified"] is True
    assert Store.open(spark, path).scan("User").where(F.col("username") == "jo").count() == 1
