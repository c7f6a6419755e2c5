"""Records of any depth, competing writers, refusals and scratch tables."""

import json
import os

import pytest
from fixtures import COUNTRIES, countries, rows
from pyspark.sql import functions as F

from fieldstone import session
from fieldstone.catalog import DATE, INT, STRING, ArrayOf, Catalog, Field, Model, Ref
from fieldstone.functions import numbering
from fieldstone.operators import query as query_module
from fieldstone.operators.access import Rule, authorize, rules_frame
from fieldstone.operators.evolve import add_field, move_primary
from fieldstone.operators.mutate import create, create_many, push_to, run_group, update
from fieldstone.operators.quality import ConstraintError, check_json
from fieldstone.operators.query import list_
from fieldstone.sources.json_records import read_records, record_schema
from fieldstone.sources.store import Store, VersionConflict
from fieldstone.sources.warehouse import open_warehouse

NESTED = Catalog(
    (
        Model("A", 1, (Field("id", INT, 1, primary=True), Field("b", Ref("B"), 2, optional=True), Field("bs", ArrayOf(Ref("B")), 3, default=()))),
        Model("B", 2, (Field("id", INT, 1, primary=True), Field("n", STRING, 2, optional=True), Field("c", Ref("C"), 3, optional=True),
                       Field("cs", ArrayOf(Ref("C")), 4, default=()))),
        Model("C", 3, (Field("id", INT, 1, primary=True), Field("t", STRING, 2, optional=True), Field("a", Ref("A"), 3, optional=True))),
    )
)


def lines(spark, *texts):
    return spark.createDataFrame([(t if isinstance(t, str) else json.dumps(t),) for t in texts], "value string")


def test_deep_records_lose_nothing(spark):
    raw = lines(
        spark,
        {"id": 1, "b": {"id": 2, "n": "x", "c": {"id": 3, "t": "deep"}, "cs": [{"id": 4}, {"id": 5, "t": "five"}]}},
        {"id": 6, "bs": [{"id": 7, "c": {"id": 8, "a": {"id": 9, "b": {"id": 10, "n": "again"}}}}, {"id": 2}]},
    )
    records = read_records(spark, raw, NESTED, "A")
    store = Store(spark, NESTED)
    start = Store(spark, NESTED, {"C": spark.createDataFrame([(4, None, None)], NESTED.struct("C"))})
    after = start.apply(create_many(start, "A", records))
    assert rows(after.scan("A")) == [(1, 2), (6, None), (9, 10)]
    assert rows(after.scan("B")) == [(10, "again", None), (2, "x", 3), (7, None, 8)]
    assert rows(after.scan("C")) == [(3, "deep", None), (4, None, None), (5, "five", None), (8, None, 9)]
    assert rows(after.links("B", "cs")) == [(2, 4), (2, 5)] and rows(after.links("A", "bs")) == [(6, 2), (6, 7)]
    assert store.scan("A").count() == 0


def test_schema_follows_the_data():
    flat = record_schema(NESTED, "A")
    assert [f.name for f in flat["b"].dataType] == ["id"]
    deep = record_schema(NESTED, "A", objects={"b", "b.c"})
    assert [f.name for f in deep["b"].dataType] == ["id", "n", "c", "cs"]
    assert [f.name for f in deep["b"].dataType["c"].dataType] == ["id", "t", "a"]


@pytest.mark.parametrize(
    "text, field, rule",
    [
        ('{"id":"oops"}', "id", "type"),
        ("not json", None, "json"),
        ('{"id":1,"b":{"id":"bad"}}', "b.id", "type"),
        ('{"id":1,"bs":[{"id":2,"cs":[{"id":3,"zzz":1}]}]}', "bs.cs.zzz", "unknown_field"),
        ('{"id":1,"b":{"id":2,"c":{"id":3,"a":{"id":4,"b":{"id":5,"n":7}}}}}', "b.c.a.b.n", "type"),
    ],
)
def test_bad_records_are_refused(spark, text, field, rule):
    raw = lines(spark, {"id": 9}, text)
    found = check_json(raw, NESTED, "A").where("rule != 'missing_field'").collect()
    assert [(r.field, r.rule) for r in found] == [(field, rule)]
    with pytest.raises(ConstraintError):
        read_records(spark, raw, NESTED, "A")


def test_mixed_and_unequal_items(spark):
    store = Store(spark, COUNTRIES, countries(spark).tables, countries(spark).link_tables)
    after = store.apply(create(store, "Country", {"code": "X", "name": "X", "citizens": ["Nuria", {"name": "Ann", "home": "PE"}]}))
    assert rows(after.links("Country", "citizens").where("source = 'X'")) == [("X", "Ann"), ("X", "Nuria")]
    people = [{"name": "A1", "home": {"code": "PE"}}, {"name": "A2", "home": {"code": "Y", "name": "Why"}}, "Bela"]
    after = store.apply(create(store, "Country", {"code": "Z", "name": "Z", "citizens": people}))
    assert ("Y", "Why") in rows(after.scan("Country", ["code", "name"]))
    assert {("A1", "PE"), ("A2", "Y"), ("Bela", None)} <= set(rows(after.scan("Citizen")))
    changed = store.apply(update(store, "Country", "PE", {"citizens": ["Bela", {"name": "Nuria", "home": "IS"}]}))
    assert {t for s, t in rows(changed.links("Country", "citizens")) if s == "PE"} == {"Nuria"}
    assert ("Nuria", "IS") in rows(changed.scan("Citizen"))
    pushed = store.apply(push_to(store, "Country", "citizens", "PE", {"name": "Deep", "home": {"code": "Q", "name": "Q"}}))
    assert ("Deep", "Q") in rows(pushed.scan("Citizen")) and ("Q", "Q") in rows(pushed.scan("Country", ["code", "name"]))


def test_the_second_writer_fails(spark, tmp_path):
    path = str(tmp_path / "store")
    countries(spark).publish(path)
    one, two = Store.open(spark, path), Store.open(spark, path)
    one.apply(create(one, "Citizen", {"name": "One"})).publish()
    late = two.apply(create(two, "Citizen", {"name": "Two"}))
    with pytest.raises(VersionConflict):
        late.publish()
    assert "One" in [n for n, _ in rows(Store.open(spark, path).scan("Citizen"))]
    # A claim that is there already, without its row: the race itself.
    three = Store.open(spark, path)
    os.makedirs(f"{path}/v3", exist_ok=True)
    open(f"{path}/v3/_claim", "w").close()
    with pytest.raises(VersionConflict):
        three.apply(create(three, "Citizen", {"name": "Three"})).publish()


def test_a_failed_group_leaves_no_folder(spark, tmp_path):
    path = str(tmp_path / "store")
    store = countries(spark).publish(path)
    before = sorted(os.listdir(f"{path}/v1"))

    def fail(_):
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        run_group(store, [lambda s: create(s, "Citizen", {"name": "One"}), fail])
    assert sorted(os.listdir(f"{path}/v1")) == before
    left = os.listdir(f"{path}/v2") if os.path.isdir(f"{path}/v2") else []
    assert left == [], left


def test_hooks_without_a_name_are_not_published(spark, tmp_path):
    catalog = Catalog((Model("M", 1, (Field("id", INT, 1, primary=True),), on_read=(lambda df: df,)),))
    with pytest.raises(ValueError, match="hook without a name"):
        Store(spark, catalog).publish(str(tmp_path / "m"))


def test_dates_in_negated_predicates(spark):
    catalog = Catalog((Model("D", 1, (Field("id", INT, 1, primary=True), Field("day", DATE, 2, optional=True))),))
    table = spark.sql("SELECT 1L AS id, DATE'2020-01-01' AS day UNION ALL SELECT 2L, NULL")
    store = Store(spark, catalog, {"D": table})
    tree = {"predicate": {"day": {"eq": "2020-01-01T12:00:00Z"}}, "negated": True}
    assert rows(list_(store, "D", [tree], select=[]).records) == [(1,)]


def test_a_dangling_key_is_not_erased(spark):
    catalog = Catalog(
        (
            Model("P", 1, (Field("id", INT, 1, primary=True), Field("home", Ref("H"), 2))),
            Model("H", 2, (Field("id", INT, 1, primary=True), Field("name", STRING, 2, unique=True))),
        )
    )
    tables = {"H": spark.createDataFrame([(1, "one")], catalog.struct("H")), "P": spark.createDataFrame([(1, 1), (2, 7)], catalog.struct("P"))}
    moved = move_primary(Store(spark, catalog, tables), "H", "name")
    with pytest.raises(Exception, match="`P.home` refers to a record that does not exist: 7"):
        moved.scan("P").collect()


def test_unchanged_tables_stay_where_they_are(spark, tmp_path):
    store = countries(spark).publish(str(tmp_path / "store"))
    after = add_field(store, "Country", Field("notes", ArrayOf(STRING), 7))
    assert after.locations == store.locations
    after = add_field(store, "Country", Field("rank", INT, 8, default=1))
    assert set(store.locations) - set(after.locations) == {"Country"}


def test_a_rule_about_pushing_sees_the_item(spark):
    store = countries(spark)
    ops = spark.createDataFrame(
        [(1, "PUSH_TO", '{"name":"Ann","home":{"code":"PE"}}'), (2, "PUSH_TO", '{"name":"Bob","home":"KE"}'), (3, "REMOVE_FROM", "Ann"),
         (4, "REMOVE_FROM", "Bob"), (5, "PUSH_TO", '{"name":"Ann"}')],
        "op_id int, event string, arg string",
    ).withColumns({"model": F.lit("Country"), "field": F.lit("citizens"), "target_id": F.lit("PE"), "role": F.lit(None).cast("string")})
    rules = [
        Rule("allow", ("PUSH_TO",), "Country", "citizens", predicate="here"),
        Rule("allow", ("REMOVE_FROM",), "Country", "citizens", predicate="ann"),
    ]
    predicates = {"here": lambda user, item: item["home"] == "PE", "ann": lambda user, item: item["name"] == "Ann"}
    got = authorize(ops, rules_frame(spark, rules), COUNTRIES, store, predicates)
    assert {r.op_id: r.allowed for r in got.collect()} == {1: True, 2: False, 3: True, 4: False, 5: False}


def test_only_keys_are_numbered(spark, monkeypatch):
    """A long page writes keys and sort values, and comes in their order."""
    monkeypatch.setattr(query_module, "GLOBAL_LIMIT_ROWS", 1)
    session._SCRATCH.clear()
    found = list_(countries(spark), "Country", order_by="population", from_=2, select=["name", {"citizens": ["name"]}])
    assert [r.code for r in found.records.select("code").collect()] == ["FJ", "KE", "PE"]
    assert rows(found.lists["citizens"].records.select("name")) == [("Bela",), ("Nuria",)]
    columns = [spark.read.parquet(p).columns for p in session._SCRATCH]
    assert columns[0][:2] == ["code", "__by"] and not any("name" in c for c in columns)


def test_a_hot_group_is_numbered(spark, monkeypatch):
    monkeypatch.setattr(numbering, "WINDOW_GROUP_ROWS", 5)
    rows_ = spark.range(500).select(F.when(F.col("id") < 450, 1).otherwise(F.col("id")).alias("g"), (F.col("id") % 7).alias("v"), "id")
    got = numbering.ranked(rows_.withColumn("wide", F.lit("x")), "g", [F.col("v").asc(), F.col("id").asc()], "n", ties=True, narrow=["g", "v", "id"])
    places = sorted(r.n for r in got.where("g = 1").collect())
    assert places == list(range(1, 451)) and "wide" in got.columns and got.count() == 500


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_lists_do_not_join_what_their_parents_refer_to(spark):
    """The keys of a list's parents come from the table, not from the populated records."""
    store = open_warehouse(spark, "/root/testdata/sf0.001")
    found = list_(store, "Order", [{"o_totalprice": {"gt": 1000}}], select=[{"customer": ["c_name"]}, {"parts": ["p_name"]}])
    plan = found.lists["parts"].records._jdf.queryExecution().optimizedPlan().toString()
    assert "c_name" not in plan and "o_totalprice" in plan


def test_scratch_tables_can_be_dropped(spark):
    session._SCRATCH.clear()
    df = session.checkpointed(spark.range(3).withColumn("nothing", F.lit(None)))
    assert df.count() == 3 and dict(df.dtypes)["nothing"] == "void"
    assert session.drop_scratch(spark) == 1 and session._SCRATCH == []
