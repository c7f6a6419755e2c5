"""Queries over stored versions: files that changes touch, writers that meet, numbers that stay used."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldstone.catalog import INT, STRING, ArrayOf, Catalog, Field, Model, Ref
from fieldstone.operators.mutate import create, delete, push_to, run_group, update, update_many
from fieldstone.operators.predicates import array_length
from fieldstone.operators.query import list_, read
from fieldstone.plans.registry import query
from fieldstone.session import scratch_path
from fieldstone.sources.files import files_apart
from fieldstone.sources.history import claim_version
from fieldstone.sources.store import Store, VersionConflict
from fieldstone.sources.warehouse import open_warehouse
from fieldstone.streaming.feeds import subscribe, version_feed

BOOK = Catalog(
    (
        Model(
            "Person",
            1,
            (
                Field("id", INT, 1, primary=True, auto_increment=True),
                Field("name", STRING, 2),
                Field("segment", STRING, 3, optional=True),
                Field("friend", Ref("Person"), 4, optional=True),
                Field("places", ArrayOf(INT), 5),
            ),
        ),
    )
)
_FILES = 24
_PEOPLE = "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer"


def _book(spark, folder) -> Store:
    """The customers and the nations they live in, published in some two dozen files for each table."""
    customer = open_warehouse(spark, folder).scan("Customer")
    places = customer.select(F.col("c_custkey").alias("source"), F.col("nation").alias("target"))
    people = customer.select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("segment"),
        F.lit(None).cast("bigint").alias("friend"),
    )
    rows = customer.count()
    store = Store(spark, BOOK, {"Person": people}, {("Person", "places"): places}, file_rows=max(1, rows // _FILES))
    return store.publish(scratch_path(spark, "book"))


def _middle(store: Store) -> int:
    return store.scan("Person", ["id"]).agg(F.expr("percentile_disc(0.5) within group (order by id)")).first()[0]


def _new_files(before: Store, after: Store, name: str) -> tuple[Column, Column]:
    gone, fresh = files_apart(before.spark, before.locations[name], after.locations[name])
    return F.lit(len(gone)).alias("gone"), F.lit(len(fresh)).alias("fresh")


@query(
    f"""
    WITH p AS ({_PEOPLE}), mid AS (SELECT percentile_disc(0.5) WITHIN GROUP (ORDER BY id) AS m FROM p)
    SELECT id, CASE WHEN id = m THEN 'patched' ELSE name END AS name, segment, 1 AS gone, 1 AS fresh FROM p, mid
    """
)
def patch_touches_one_file(spark, folder):
    """A patched record of a table of many files writes one file; all others are shared."""
    store = _book(spark, folder)
    after = store.apply(update(store, "Person", _middle(store), {"name": "patched"})).publish()
    return after.scan("Person", ["id", "name", "segment"]).select("*", *_new_files(store, after, "Person"))


@query(
    f"""
    WITH p AS ({_PEOPLE}), mid AS (SELECT percentile_disc(0.5) WITHIN GROUP (ORDER BY id) AS m FROM p)
    SELECT id, 1 AS n_places, 1 AS gone, 1 AS fresh FROM p, mid WHERE id <> m
    """
)
def delete_touches_one_file(spark, folder):
    """A deleted record, its references and the links it had go with the files that held them."""
    store = _book(spark, folder)
    after = store.apply(delete(store, "Person", _middle(store))).publish()
    n = after.links("Person", "places").groupBy("source").agg(F.count("*").alias("n"))
    people = after.scan("Person", ["id"]).join(n, F.col("id") == F.col("source"), "left")
    return people.select("id", F.coalesce("n", F.lit(0)).alias("n_places"), *_new_files(store, after, "Person"))


@query(
    f"""
    WITH p AS ({_PEOPLE}), mid AS (SELECT percentile_disc(0.5) WITHIN GROUP (ORDER BY id) AS m FROM p)
    SELECT id, name, 1 AS files, 1 AS n_places FROM p, mid WHERE id = m
    """
)
def read_opens_one_file(spark, folder):
    """A record is read by key from the one file whose range holds it."""
    store = _book(spark, folder)
    found = read(store, "Person", _middle(store), ["name", "places"])
    files = len(found.records.inputFiles())
    n = found.lists["places"].records.agg(F.count("*").alias("n_places"))
    return found.records.select("id", "name", F.lit(files).alias("files")).join(n)


@query("SELECT c_custkey AS id, c_name AS name, 2 AS version FROM customer UNION ALL SELECT -1, 'next', 2")
def dead_writer(spark, folder):
    """A writer that dies after its claim blocks the next one only until the claim ends."""
    store = _book(spark, folder)
    claim_version(spark, store.path, 2, "gone", lease=0.0)
    after = store.apply(create(store, "Person", {"id": -1, "name": "next"})).publish()
    return after.scan("Person", ["id", "name"]).withColumn("version", F.lit(after.version))


@query(
    """
    WITH ends AS (SELECT min(c_custkey) AS low, max(c_custkey) AS high FROM customer)
    SELECT c_custkey AS id, CASE WHEN c_custkey = low THEN 'low' WHEN c_custkey = high THEN 'high' ELSE c_name END AS name,
           CASE WHEN c_custkey = low THEN 2 ELSE 1 END AS n_places,
           3 AS version, true AS refused
    FROM customer, ends
    """
)
def disjoint_groups(spark, folder):
    """Two groups on different records both publish; a third one on a record of the first is refused."""
    one = _book(spark, folder)
    ends = one.scan("Person", ["id"]).agg(F.min("id").alias("low"), F.max("id").alias("high")).first()
    two, three = (Store.open(spark, one.path, file_rows=one.file_rows) for _ in range(2))
    run_group(one, [lambda s: update(s, "Person", ends["high"], {"name": "high"})])[0].publish()
    group = [
        lambda s: update(s, "Person", ends["low"], {"name": "low"}),
        lambda s: push_to(s, "Person", "places", ends["low"], -1),
    ]
    after = run_group(two, group)[0].publish(rebase=True)
    refused = False
    try:
        run_group(three, [lambda s: update(s, "Person", ends["high"], {"name": "other"})])[0].publish(rebase=True)
    except VersionConflict:
        refused = True
    last = Store.open(spark, one.path)
    n = last.links("Person", "places").groupBy("source").agg(F.count("*").alias("n"))
    people = last.scan("Person", ["id", "name"]).join(n, F.col("id") == F.col("source"), "left")
    return people.select(
        "id", "name", F.coalesce("n", F.lit(0)).alias("n_places"), F.lit(after.version).alias("version"), F.lit(refused).alias("refused")
    )


@query(
    """
    WITH top AS (SELECT max(c_custkey) AS m FROM customer)
    SELECT c_custkey AS id, c_name AS name FROM customer, top WHERE c_custkey <> m UNION ALL SELECT m + 1, 'again' FROM top
    """
)
def numbers_stay_used(spark, folder):
    """The number of a deleted record is not given to the next one, in this version or a later one."""
    store = _book(spark, folder)
    top = store.sequence("Person", "id")
    store.apply(delete(store, "Person", top)).publish()
    store = Store.open(spark, store.path)
    return store.apply(create(store, "Person", {"name": "again"})).publish().scan("Person", ["id", "name"])


@query(
    """
    WITH ends AS (SELECT min(c_custkey) AS low, max(c_custkey) AS high FROM customer)
    SELECT c_custkey AS id, CASE WHEN c_custkey = high THEN 'REMOVE' ELSE 'CHANGE' END AS event, c_mktsegment AS old,
           CASE WHEN c_custkey <> high THEN 'none' END AS new, c_custkey = high OR NULL AS gone
    FROM customer, ends WHERE c_mktsegment = 'BUILDING' OR c_custkey = high
    UNION ALL SELECT -1, 'NEW', NULL, 'first', NULL
    """
)
def feed_between_versions(spark, folder):
    """A segment is renamed, a record removed and another made in three versions; the first and the last are compared."""
    store = _book(spark, folder)
    top = store.sequence("Person", "id")
    old = store.scan("Person").where(F.col("segment") == "BUILDING").select("id", F.lit("none").alias("segment"))
    two = store.apply(update_many(store, "Person", old)).publish()
    three = two.apply(delete(two, "Person", top)).publish()
    three.apply(create(three, "Person", {"id": -1, "name": "zero", "segment": "first"})).publish()
    feed = version_feed(spark, store.path, "Person", 1)
    new = F.when(F.col("event") != "REMOVE", F.col("after.segment"))
    return feed.select(
        "id", "event", F.col("before.segment").alias("old"), new.alias("new"), F.when(F.col("event") == "REMOVE", True).alias("gone")
    )


@query(
    f"""
    WITH p AS ({_PEOPLE}), mid AS (SELECT percentile_disc(0.5) WITHIN GROUP (ORDER BY id) AS m FROM p),
    now AS (SELECT CASE WHEN id = m THEN -5 ELSE id END AS id, name, segment FROM p, mid)
    SELECT id, name, segment, true AS kept FROM now ORDER BY segment DESC, id LIMIT 25 OFFSET 30
    """
)
def kept_order_page(spark, folder):
    """A page in an order that was kept before a record changed its key; the order is read, not made again."""
    store = _book(spark, folder).keep_order("Person", "segment", "DESCENDING").publish()
    after = store.apply(update(store, "Person", _middle(store), {"id": -5})).publish()
    page = list_(after, "Person", order_by=("segment", "DESCENDING"), from_=31, to=25, select=["name", "segment"])
    return page.records.withColumn("kept", F.lit(after.derived == store.derived))


@query(
    """
    WITH ends AS (SELECT min(c_custkey) AS low, max(c_custkey) AS high FROM customer)
    SELECT c_custkey AS id, CASE WHEN c_custkey = low THEN 3 ELSE 1 END AS length FROM customer, ends WHERE c_custkey <> high
    """
)
def kept_counts(spark, folder):
    """Lengths of lists, counted once and read since, after a push and the deletion of a record."""
    store = _book(spark, folder).keep_counts("Person", "places").publish()
    ends = store.scan("Person", ["id"]).agg(F.min("id").alias("low"), F.max("id").alias("high")).first()
    changes = [
        lambda s: push_to(s, "Person", "places", ends["low"], -1),
        lambda s: push_to(s, "Person", "places", ends["low"], -2),
        lambda s: delete(s, "Person", ends["high"]),
    ]
    after = run_group(store, changes)[0].publish()
    return array_length(after, "Person", "places").select(F.col("source").alias("id"), "length")


@query(
    """
    SELECT 1 AS batch, c_custkey AS id, c_name AS friend FROM customer WHERE c_mktsegment = 'BUILDING'
    UNION ALL SELECT 2, c_custkey, 'renamed' FROM customer WHERE c_mktsegment = 'BUILDING'
    """
)
def stream_living(spark, folder):
    """Every record arrives twice, its own friend; between the micro-batches all are renamed in the store."""
    store = _book(spark, folder)
    people = store.scan("Person").where(F.col("segment") == "BUILDING").withColumn("friend", F.col("id"))
    inbox, state, out = (scratch_path(spark, name) for name in ("inbox", "state", "delivered"))

    def deliver(result, number):
        names = result.records.select(F.lit(number + 1).alias("batch"), "id", F.col("friend.name").alias("friend"))
        names.write.mode("append").parquet(out)

    def run():
        people.write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(people.schema).parquet(inbox)
        writer = subscribe(stream, store.path, "Person", deliver, select=[{"friend": ["name"]}])
        writer.option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()

    run()
    renamed = people.select("id", F.lit("renamed").alias("name"))
    store.apply(update_many(store, "Person", renamed)).publish()
    run()
    return spark.read.parquet(out)
