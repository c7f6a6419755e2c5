"""Stored versions: shared files, writers that meet or die, numbers, feeds between versions."""

import os
import random
import subprocess
import sys

import pytest
from fixtures import rows
from pyspark.sql import functions as F

from fieldstone.catalog import INT, STRING, ArrayOf, Catalog, Field, Model, Ref
from fieldstone.operators.evolve import evolve
from fieldstone.operators.mutate import (
    create,
    create_many,
    delete,
    delete_many,
    push_many_to,
    push_to,
    remove_from,
    run_group,
    update,
    update_many,
)
from fieldstone.operators.predicates import array_length
from fieldstone.operators.quality import ConstraintError
from fieldstone.operators.query import RecordNotFound, list_, read
from fieldstone.sources import derived
from fieldstone.sources.derived import element_counts, ordered_page
from fieldstone.sources.files import files_apart, files_with, manifest
from fieldstone.sources.history import VersionConflict, claim_version, last_version, record_version
from fieldstone.sources.store import Store
from fieldstone.streaming.feeds import change_feed, subscribe, version_feed

SHELF = Catalog(
    (
        Model("Writer", 1, (Field("id", INT, 1, primary=True, auto_increment=True), Field("name", STRING, 2))),
        Model(
            "Book",
            2,
            (
                Field("isbn", STRING, 1, primary=True),
                Field("title", STRING, 2, unique=True),
                Field("writer", Ref("Writer"), 3, optional=True),
                Field("pages", INT, 4, default=0),
                Field("tags", ArrayOf(STRING), 5),
                Field("readers", ArrayOf(Ref("Writer")), 6),
            ),
        ),
    )
)
N = 60
# The same with pages that may be missing.
LOOSE = SHELF.with_model(SHELF.model("Book").with_field(Field("pages", INT, 4, optional=True)))


def shelf(spark, path=None, file_rows=6) -> Store:
    """Sixty writers and books in ten files for each table."""
    writer = spark.range(1, N + 1).select("id", F.format_string("writer %d", "id").alias("name"))
    book = spark.range(1, N + 1).select(
        F.format_string("b%03d", "id").alias("isbn"), F.format_string("title %d", "id").alias("title"),
        (F.col("id") % 7 + 1).alias("writer"), (F.col("id") * 10).alias("pages"),
    )
    tags = book.select(F.col("isbn").alias("source"), F.concat(F.lit("t"), F.col("writer")).alias("target"))
    readers = book.select(F.col("isbn").alias("source"), (F.col("writer") + 20).alias("target"))
    store = Store(spark, SHELF, {"Writer": writer, "Book": book}, {("Book", "tags"): tags, ("Book", "readers"): readers}, file_rows=file_rows)
    return store.publish(path) if path else store


def again(store: Store) -> Store:
    return Store.open(store.spark, store.path, file_rows=store.file_rows)


def contents(store: Store) -> dict:
    found = {m.name: rows(store.scan(m.name)) for m in SHELF.models}
    return found | {f: rows(store.links("Book", f)) for f in ("tags", "readers")}


def changed(before: Store, after: Store) -> dict:
    """Files that went and came, for each table that lies elsewhere."""
    names = [n for n in before.locations if before.locations[n] != after.locations[n]]
    return {n: tuple(map(len, files_apart(before.spark, before.locations[n], after.locations[n]))) for n in names}


@pytest.fixture
def stored(spark, tmp_path):
    return shelf(spark, str(tmp_path / "a shelf"))


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    """A published store of which nothing is published on."""
    return shelf(spark, str(tmp_path_factory.mktemp("base") / "s"))


# -- files ---------------------------------------------------------------------


def test_files_hold_ranges_of_keys(spark, stored):
    """The folder's name has a space, as a path may."""
    files = manifest(spark, stored.locations["Book"]).orderBy("least").collect()
    assert len(files) == 10 and sum(f["rows"] for f in files) == N
    assert all(a["greatest"] < b["least"] for a, b in zip(files, files[1:]))
    found = read(stored, "Book", "b031", ["title", {"tags": True}, {"readers": ["name"]}])
    assert len(found.records.inputFiles()) == 1 and len(found.lists["tags"].records.inputFiles()) == 1
    assert found.nested().first().asDict(recursive=True) == {
        "isbn": "b031", "title": "title 31", "tags": ["t4"], "readers": [{"id": 24, "name": "writer 24"}],
    }
    for key in ("a", "b0310", "z"):
        with pytest.raises(RecordNotFound):
            read(stored, "Book", key)
    assert files_with(spark, stored.locations["Book"], F.lit("z")) == []


@pytest.mark.parametrize(
    "change, files",
    [
        (lambda s: update(s, "Book", "b031", {"pages": 1}), {"Book": (1, 1)}),
        (lambda s: create(s, "Writer", {"name": "new"}), {"Writer": (0, 1)}),
        (lambda s: push_to(s, "Book", "tags", "b031", "x"), {"Book.tags": (0, 1)}),
        (lambda s: remove_from(s, "Book", "tags", "b031", "t4"), {"Book.tags": (1, 1)}),
        (lambda s: remove_from(s, "Book", "tags", "b031", "none"), {}),
        (lambda s: update(s, "Book", "b031", {"tags": ["y"]}), {"Book.tags": (1, 1)}),
        (lambda s: delete(s, "Book", "b031"), {"Book": (1, 1), "Book.tags": (1, 1), "Book.readers": (1, 1)}),
        (lambda s: delete(s, "Writer", 60), {"Writer": (1, 1)}),
        (lambda s: update(s, "Book", "b031", {"isbn": "c"}), {"Book": (1, 1), "Book.tags": (1, 1), "Book.readers": (1, 1)}),
    ],
)
def test_only_touched_files_are_written(spark, base, change, files):
    plain = shelf(spark)
    settled = base.apply(change(base)).settle()
    assert changed(base, settled) == files
    assert contents(settled) == contents(plain.apply(change(plain)))


def test_a_reference_is_emptied_where_it_stands(stored):
    after = stored.apply(delete(stored, "Writer", 3)).publish()
    touched = [k for k in range(1, N + 1) if k % 7 + 1 == 3]
    assert changed(stored, after)["Book"] == (len({(k - 1) // 6 for k in touched}),) * 2
    assert after.scan("Book").where("writer IS NULL").count() == len(touched)


def test_stored_and_plain_stores_agree(spark, tmp_path):
    """Random changes, published one by one or as groups, against the same changes in memory."""
    r = random.Random(1)
    plain, stored = shelf(spark), shelf(spark, str(tmp_path / "s"))

    def change():
        isbn, wid = f"b{r.randint(1, N):03d}", r.randint(8, N)
        kind = r.randrange(8)
        if kind == 0:
            frame = spark.createDataFrame([(f"n{r.random()}", f"t{r.random()}", wid)], "isbn string, title string, writer bigint")
            return lambda s: create_many(s, "Book", frame)
        if kind == 1:
            return lambda s: update(s, "Book", isbn, {"pages": 5, "writer": wid, "tags": ["p", "q"]})
        if kind == 2:
            gone = spark.createDataFrame([(isbn,), (f"b{r.randint(1, N):03d}",)], "isbn string").distinct()
            return lambda s: delete_many(s, "Book", gone.join(s.scan("Book", ["isbn"]), "isbn"))
        if kind == 3:
            items = spark.createDataFrame([(isbn, wid), (isbn, 21)], "source string, item bigint")
            return lambda s: push_many_to(s, "Book", "readers", items)
        if kind == 4:
            return lambda s: remove_from(s, "Book", "tags", isbn, "q")
        if kind == 5:
            name = f"k{r.random()}"
            return lambda s: update(s, "Book", isbn, {"isbn": name})
        if kind == 6:
            return lambda s: update(s, "Book", isbn, {"writer": {"name": "patched"}})
        patches = spark.createDataFrame([(isbn, 1), (f"b{r.randint(1, N):03d}", 2)], "isbn string, pages bigint")
        return lambda s: update_many(s, "Book", patches.join(s.scan("Book", ["isbn"]), "isbn", "left_semi"))

    for _ in range(3):
        group = [change() for _ in range(r.randint(1, 3))]
        try:
            plain, _ = run_group(plain, group)
        except Exception as error:
            with pytest.raises(type(error)):
                run_group(stored, group)
            continue
        stored = run_group(stored, group)[0].publish()
        assert contents(stored) == contents(plain)
        ends = manifest(spark, stored.locations["Book"]).agg(F.sum("rows"), F.min("least"), F.max("greatest")).first()
        assert tuple(ends) == tuple(plain.scan("Book").agg(F.count("*"), F.min("isbn"), F.max("isbn")).first())


def test_everything_goes_and_comes_back(stored):
    after = stored.apply(delete_many(stored, "Book", stored.scan("Book", ["isbn"]))).publish()
    assert after.scan("Book").count() == after.links("Book", "tags").count() == 0
    assert manifest(stored.spark, after.locations["Book"]).count() == 0
    last = again(after).apply(create(after, "Book", {"isbn": "x", "title": "x"})).publish()
    assert rows(last.scan("Book")) == [("x", "x", None, 0)]


def test_an_evolved_table_keeps_its_files(stored):
    patched = stored.apply(update(stored, "Book", "b031", {"pages": 1})).publish()
    model = SHELF.model("Book").without_field("pages")
    after = evolve(patched, patched.catalog, patched.catalog.with_model(model)).publish()
    assert after.locations == patched.locations and after.scan("Book").columns == ["isbn", "title", "writer"]
    assert after.scan("Book").count() == N


# -- writers -------------------------------------------------------------------


def test_a_dead_claim_ends(spark, stored):
    claim_version(spark, stored.path, 2, "gone", lease=0.0)
    claim_version(spark, stored.path, 2, "gone as well", lease=0.0)
    after = stored.apply(create(stored, "Writer", {"name": "next"})).publish()
    assert after.version == 2 == last_version(spark, stored.path)
    assert not [x for x in os.listdir(f"{stored.path}/v2") if x.startswith("_row")]


def test_a_live_claim_holds(spark, stored):
    claim_version(spark, stored.path, 2, "busy", lease=600.0)
    for rebase in (False, True):
        with pytest.raises(VersionConflict, match="busy"):
            stored.apply(create(stored, "Writer", {"name": "next"})).publish(rebase=rebase)
    assert last_version(spark, stored.path) == 1


def test_a_killed_writer_blocks_nobody(spark, stored):
    """A writer's process ends between its claim and its version row."""
    script = (
        "import os, sys\n"
        "from pyspark.sql import SparkSession\n"
        "from fieldstone.sources import history\n"
        "from fieldstone.operators.mutate import create\n"
        "from fieldstone.sources.store import Store\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "def die(*_):\n    print('claimed', flush=True)\n    os._exit(9)\n"
        "history.record_version = die\n"
        "s = Store.open(spark, sys.argv[1])\n"
        "s.apply(create(s, 'Writer', {'name': 'lost'})).publish(lease=1.0)\n"
    )
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", script, stored.path], cwd=root, capture_output=True, text=True, timeout=120)
    assert done.returncode == 9 and "claimed" in done.stdout, done.stderr[-500:]
    after = stored.apply(create(stored, "Writer", {"name": "next"})).publish(lease=1.0)
    assert "next" in {r["name"] for r in again(after).scan("Writer").collect()}
    assert "lost" not in {r["name"] for r in again(after).scan("Writer").collect()}


def test_a_number_is_recorded_once(spark, stored):
    row = {"catalog": "{}", "tables": {}, "sequences": {}, "derived": {}, "footprint": None}
    with pytest.raises(VersionConflict):
        record_version(spark, stored.path, 1, row)
    assert Store.versions(spark, stored.path).count() == 1


def group(store, *changes):
    return run_group(store, changes)[0]


def test_apart_both_publish(spark, stored):
    """What one writer and another do in different places, or to lists that grow, is all there in the end."""
    one = [
        lambda s: update(s, "Book", "b001", {"pages": 1}),
        lambda s: create(s, "Book", {"isbn": "x", "title": "x", "writer": 9}),
        lambda s: push_to(s, "Book", "tags", "b003", "x"),
        lambda s: delete(s, "Writer", 3),
        lambda s: update(s, "Book", "b005", {"isbn": "a"}),
        lambda s: update(s, "Writer", 10, {"name": "ten"}),
    ]
    two = [
        lambda s: update(s, "Book", "b002", {"pages": 2}),
        lambda s: delete(s, "Book", "b006"),
        lambda s: push_to(s, "Book", "tags", "b003", "y"),
        lambda s: update(s, "Book", "b007", {"writer": 9}),
        lambda s: remove_from(s, "Book", "tags", "b008", "t2"),
        lambda s: create(s, "Book", {"isbn": "y", "title": "y", "writer": 10}),
    ]
    plain = group(shelf(spark), *one, *two)
    late = group(again(stored), *two)
    group(stored, *one).publish()
    with pytest.raises(VersionConflict):
        late.publish()
    after = late.publish(rebase=True)
    assert after.version == 3 and contents(after) == contents(plain)


def test_on_the_same_the_later_is_refused(spark, stored):
    after = group(
        stored,
        lambda s: update(s, "Book", "b001", {"pages": 1}),
        lambda s: create(s, "Book", {"isbn": "x", "title": "t"}),
        lambda s: delete(s, "Writer", 60),
        lambda s: push_to(s, "Book", "readers", "b002", 59),
        lambda s: push_to(s, "Book", "tags", "b003", "x"),
        lambda s: delete(s, "Book", "b004"),
        lambda s: update(s, "Book", "b005", {"isbn": "a"}),
        lambda s: create(s, "Writer", {"name": "a"}),
    ).publish()
    first = Store.open(spark, stored.path, version=1)
    for change in (
        lambda s: update(s, "Book", "b001", {"title": "new"}),
        lambda s: create(s, "Book", {"isbn": "x", "title": "other"}),
        lambda s: create(s, "Book", {"isbn": "other", "title": "t"}),
        lambda s: update(s, "Book", "b050", {"writer": 60}),
        lambda s: delete(s, "Writer", 59),
        lambda s: update(s, "Book", "b003", {"tags": ["y"]}),
        lambda s: push_to(s, "Book", "tags", "b004", "x"),
        lambda s: update(s, "Book", "b005", {"pages": 4}),
        lambda s: create(s, "Writer", {"name": "b"}),
    ):
        with pytest.raises(VersionConflict, match="concerns the same"):
            first.apply(change(first)).publish(rebase=True)
    assert last_version(spark, stored.path) == 2 and contents(again(stored)) == contents(after)


def test_a_group_meets_several_versions(spark, stored):
    late = run_group(again(stored), [lambda s: update(s, "Book", "b050", {"pages": 1}), lambda s: push_to(s, "Book", "tags", "b050", "z")])[0]
    one = stored.apply(update(stored, "Book", "b049", {"pages": 2})).publish()
    one.apply(delete(one, "Book", "b001")).publish()
    after = late.publish(rebase=True)
    pages = {r["isbn"]: r["pages"] for r in after.scan("Book").collect()}
    assert after.version == 4 and pages["b050"] == 1 and pages["b049"] == 2 and "b001" not in pages
    assert ("b050", "z") in rows(after.links("Book", "tags")) and len(pages) == N - 1


def test_a_replaced_table_is_not_put_on_top(spark, stored):
    other = stored.replaced(tables={**stored.tables, "Writer": stored.scan("Writer").where("id < 30")}, locations={k: v for k, v in stored.locations.items() if k != "Writer"})
    stored.apply(update(stored, "Book", "b001", {"pages": 1})).publish()
    with pytest.raises(VersionConflict):
        other.publish(rebase=True)


# -- numbers -------------------------------------------------------------------


def test_numbers_of_the_deleted_stay_used(spark, stored):
    for store in (shelf(spark), stored):
        store = store.apply(delete(store, "Writer", N))
        if store.path:
            store = again(store.publish())
        store = store.apply(create(store, "Writer", {"name": "a"}))
        store = store.apply(delete(store, "Writer", N + 1))
        if store.path:
            store = again(store.publish())
        changes = create_many(store, "Writer", spark.createDataFrame([("b",), ("c",)], "name string"))
        assert sorted(r["id"] for r in changes.result.records.collect()) == [N + 2, N + 3]
        store = store.apply(changes)
        given = store.apply(create(store, "Writer", {"id": 500, "name": "given"}))
        assert given.sequence("Writer", "id") == 500 and store.sequence("Writer", "id") == N + 3
        moved = store.apply(update(store, "Writer", N + 3, {"id": 900}))
        assert moved.sequence("Writer", "id") == 900


def test_no_scan_for_a_number(spark, stored, monkeypatch):
    store = again(stored)
    monkeypatch.setattr(Store, "scan", lambda *_: pytest.fail("scanned"))
    assert store.sequence("Writer", "id") == N


# -- feeds ---------------------------------------------------------------------


def test_feed_between_versions(spark, stored):
    two = stored.apply(update(stored, "Book", "b031", {"pages": 1})).publish()
    three = two.apply(delete(two, "Book", "b001")).publish()
    four = three.apply(create(three, "Book", {"isbn": "x", "title": "x"})).publish()
    for a, b in ((stored, four), (four, stored), (two, three), (two, two)):
        got = version_feed(spark, stored.path, "Book", a.version, b.version)
        assert rows(got) == rows(change_feed(a.scan("Book"), b.scan("Book"), SHELF, "Book"))
        gone, fresh = files_apart(spark, a.locations["Book"], b.locations["Book"])
        assert len(got.inputFiles()) == len(gone) + len(fresh) <= 5
    model = four.catalog.model("Book").without_field("pages").with_field(Field("note", STRING, 9, optional=True))
    five = evolve(four, four.catalog, four.catalog.with_model(model)).publish()
    got = version_feed(spark, stored.path, "Book", 3, five.version)
    assert rows(got.select("isbn", "event")) == [("x", "NEW")]


def test_a_subscription_sees_the_newest_version(spark, stored, tmp_path):
    """A changed writer, and a changed list, show in the next micro-batch."""
    inbox, got = tmp_path / "in", []
    inbox.mkdir()

    def send(name, *isbns):
        books = stored.scan("Book").where(F.col("isbn").isin(*isbns))
        books.coalesce(1).write.parquet(str(inbox / name))

    def deliver(result, _):
        rows_ = result.nested().orderBy("isbn").collect()
        got.append([(r["isbn"], r["writer"]["name"], r["tags"], [x["name"] for x in r["readers"]]) for r in rows_])

    def run():
        stream = spark.readStream.schema(stored.scan("Book").schema).option("recursiveFileLookup", "true").parquet(str(inbox))
        select = [{"writer": ["name"]}, {"tags": True}, {"readers": ["name"]}]
        writer = subscribe(stream, stored.path, "Book", deliver, filter=[{"pages": {"gt": 10}}], select=select)
        writer.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(120)

    send("a", "b001", "b002")
    run()
    after = stored.apply(update(stored, "Writer", 3, {"name": "renamed"})).publish()
    after.apply(push_to(after, "Book", "tags", "b009", "new")).publish()
    send("b", "b009")
    run()
    assert got == [[("b002", "writer 3", ["t3"], ["writer 23"])], [("b009", "renamed", ["new", "t3"], ["writer 23"])]]


def test_unique_values_are_probed(spark, stored):
    """A taken key or unique value is found, also among values that share no file's range."""
    for record in ({"isbn": "b031", "title": "new"}, {"isbn": "new", "title": "title 31"}):
        with pytest.raises(ConstraintError):
            create(stored, "Book", record)
    patches = spark.createDataFrame([("b001", "title 2")], "isbn string, title string")
    with pytest.raises(ConstraintError):
        update_many(stored, "Book", patches)
    swap = spark.createDataFrame([("b001", "title 2"), ("b002", "title 1")], "isbn string, title string")
    after = stored.apply(update_many(stored, "Book", swap)).publish()
    assert dict(rows(after.scan("Book", ["isbn", "title"]).where("pages <= 20"))) == {"b001": "title 2", "b002": "title 1"}
    many = spark.range(600).select(F.format_string("m%03d", "id").alias("isbn"), F.format_string("m%d", "id").alias("title"))
    assert stored.apply(create_many(stored, "Book", many)).scan("Book").count() == N + 600
    with pytest.raises(ConstraintError):
        create_many(stored, "Book", many.withColumn("title", F.when(F.col("isbn") == "m005", "title 5").otherwise(F.col("title"))))


# -- kept orders and counts ------------------------------------------------------


def page(store, direction, start, size):
    found = list_(store, "Book", order_by=("pages", direction), from_=start, to=size, select=["pages"])
    return [tuple(r) for r in found.records.select("isbn", "pages").collect()]


@pytest.mark.parametrize("direction", ["ASCENDING", "DESCENDING"])
def test_kept_orders_follow_changes(spark, tmp_path, monkeypatch, direction):
    monkeypatch.setattr(derived, "REMAKE", 5.0)
    r = random.Random(direction)
    plain = shelf(spark)
    some = F.when(F.col("pages") % 70 != 0, F.col("pages") % 100)
    plain = plain.replaced(catalog=LOOSE, tables={**plain.tables, "Book": plain.scan("Book").withColumn("pages", some)})
    stored = plain.keep_order("Book", "pages", direction).publish(str(tmp_path / "s"))
    name = f"Book/order/pages/{direction}"
    made = stored.derived[name]
    for step in range(2):
        for start, size in ((7, 13), (40, None), (200, 3)):
            assert ordered_page(stored, "Book", "pages", direction, start - 1, size) is not None
            assert page(stored, direction, start, size) == page(plain, direction, start, size)
        if step == 1:
            break
        isbn = f"b{r.randint(1, N):03d}"
        changes = [
            lambda s: update(s, "Book", isbn, {"pages": r.choice((None, 3, 55, 1000))}),
            lambda s: create(s, "Book", {"isbn": f"n{step}", "title": f"t{step}", "pages": r.choice((0, 50, 99))}),
            lambda s: delete(s, "Book", f"b{10 * step + 5:03d}"),
        ]
        state = r.getstate()
        plain = run_group(plain, changes)[0]
        r.setstate(state)
        stored = again(run_group(stored, changes)[0].publish())
        assert stored.derived[name] == made
    monkeypatch.setattr(derived, "REMAKE", 0.0)
    last = stored.apply(delete(stored, "Book", "b060")).publish()
    assert last.derived[name].base == last.locations["Book"]
    plain = plain.apply(delete(plain, "Book", "b060"))
    assert page(last, direction, 3, 20) == page(plain, direction, 3, 20)


def test_a_page_opens_its_files(spark, tmp_path):
    stored = shelf(spark).keep_order("Book", "pages").publish(str(tmp_path / "s"))
    found = ordered_page(stored, "Book", "pages", "ASCENDING", 30, 6)
    assert len(found.inputFiles()) == 1 and found.count() == 6
    assert len(list_(stored, "Book", order_by="pages", from_=31, to=6).records.inputFiles()) <= 2


def test_kept_counts_follow_changes(spark, tmp_path):
    plain = shelf(spark)
    stored = plain.keep_counts("Book", "tags").publish(str(tmp_path / "s"))
    made = stored.derived["Book.tags/count"]
    for change in (
        lambda s: push_to(s, "Book", "tags", "b031", "x"),
        lambda s: remove_from(s, "Book", "tags", "b002", "t3"),
        lambda s: update(s, "Book", "b031", {"tags": ["p", "q", "r"]}),
        lambda s: delete(s, "Book", "b040"),
        lambda s: create(s, "Book", {"isbn": "x", "title": "x", "tags": ["a", "a"]}),
    ):
        plain, stored = plain.apply(change(plain)), again(stored.apply(change(stored)).publish())
        assert element_counts(stored, "Book", "tags") is not None
        assert rows(array_length(stored, "Book", "tags")) == rows(array_length(plain, "Book", "tags"))
        for n in range(4):
            test = [{"tags": {"length": {"eq": n}}}]
            assert rows(list_(stored, "Book", test, select=[]).records) == rows(list_(plain, "Book", test, select=[]).records)
    assert stored.derived["Book.tags/count"] != made  # outgrown by then
