"""Queries that change tables; each returns what the touched tables hold afterwards."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldstone.catalog import FLOAT, INT, STRING, Catalog, Field, Model, Ref
from fieldstone.functions.secrets import hash_secret, verify_secret
from fieldstone.operators.mutate import (
    create,
    create_many,
    delete_many,
    push_many_to,
    push_to,
    remove_many_from,
    run_group,
    update,
    update_many,
)
from fieldstone.plans.reads import ACCOUNTS, accounts
from fieldstone.plans.registry import query
from fieldstone.session import scratch_path
from fieldstone.sources.store import Store
from fieldstone.sources.warehouse import open_warehouse

_CUSTOMERS = "SELECT c_custkey, c_name, c_nationkey::BIGINT AS nation, c_acctbal, c_mktsegment FROM customer"
_NEW_KEY = "(SELECT max(c_custkey) + 1 FROM customer)"


def _first_free(store: Store, model: str) -> int:
    key = store.catalog.model(model).pk
    return store.scan(model, [key]).agg(F.max(key).alias("m")).first()["m"] + 1


def _new_customers(store: Store):
    """The suppliers as customer records with keys of their own."""
    first = _first_free(store, "Customer")
    return store.scan("Supplier").select(
        (F.col("s_suppkey") + first).alias("c_custkey"),
        F.col("s_name").alias("c_name"),
        F.struct(F.col("nation").alias("n_nationkey")).alias("nation"),
    )


# -- create ----------------------------------------------------------------------


@query(
    f"""
    {_CUSTOMERS} UNION ALL
    SELECT s_suppkey + {_NEW_KEY}, s_name, s_nationkey, 0.0, 'BUILDING' FROM supplier
    """
)
def create_many_defaults(spark, folder):
    store = open_warehouse(spark, folder)
    return store.apply(create_many(store, "Customer", _new_customers(store))).scan("Customer")


@query(
    f"""
    {_CUSTOMERS} UNION ALL
    SELECT (SELECT max(c_custkey) + 1 FROM customer), 'Newcomer', 3, -5.5, 'MACHINERY'
    """
)
def create_one(spark, folder):
    store = open_warehouse(spark, folder)
    record = {"c_name": "Newcomer", "nation": {"n_nationkey": 3}, "c_acctbal": -5.5, "c_mktsegment": "MACHINERY"}
    return store.apply(create(store, "Customer", record)).scan("Customer")


@query(
    """
    SELECT o_orderkey, o_custkey AS customer, o_totalprice FROM orders UNION ALL
    SELECT (SELECT max(o_orderkey) FROM orders) + row_number() OVER (ORDER BY event_id), user_id, value
    FROM events WHERE event_type = 'purchase'
    """
)
def create_autoinc(spark, folder):
    """Every purchase becomes an order, numbered on from the largest key."""
    store = open_warehouse(spark, folder)
    bought = store.scan("Event").where("event_type = 'purchase'").select(
        F.col("user").alias("customer"), F.col("value").alias("o_totalprice"), F.col("event_id").alias("_ord")
    )
    return store.apply(create_many(store, "Order", bought)).scan("Order", ["o_orderkey", "customer", "o_totalprice"])


TICKETS = Catalog(
    (
        Model("Reporter", 1, (Field("id", INT, 1, primary=True), Field("name", STRING, 2))),
        Model(
            "Ticket",
            2,
            (
                Field("id", STRING, 1, primary=True, uuid=True),
                Field("subject", STRING, 2),
                Field("weight", FLOAT, 3, default=1.0),
                Field("reporter", Ref("Reporter"), 4, optional=True),
            ),
        ),
    )
)


def _ticket_store(spark, folder) -> Store:
    customer = open_warehouse(spark, folder).scan("Customer", ["c_custkey", "c_name"])
    return Store(spark, TICKETS, {"Reporter": customer.toDF("id", "name")})


@query(
    """
    SELECT user_id AS reporter, count(*) AS n, count(*) AS n_keys, sum(36 * 1) AS key_chars, sum(1)::BIGINT AS weight
    FROM events WHERE event_type = 'error' GROUP BY user_id
    """
)
def create_uuid(spark, folder):
    """Every error becomes a ticket with a generated key."""
    store = _ticket_store(spark, folder)
    errors = open_warehouse(spark, folder).scan("Event").where("event_type = 'error'")
    records = errors.select(F.col("props").alias("subject"), F.struct(F.col("user").alias("id")).alias("reporter"))
    tickets = store.apply(create_many(store, "Ticket", records)).scan("Ticket")
    return tickets.groupBy("reporter").agg(
        F.count("*").alias("n"),
        F.count_distinct("id").alias("n_keys"),
        F.sum(F.length("id").cast("bigint")).alias("key_chars"),
        F.sum(F.col("weight").cast("bigint")).alias("weight"),
    )


@query("SELECT c_custkey AS id, c_name AS name, true AS right_one, false AS wrong_one FROM customer")
def create_secret(spark, folder):
    """Accounts created from customers; each secret verifies, another one does not."""
    store = Store(spark, ACCOUNTS)
    customers = open_warehouse(spark, folder).scan("Customer")
    records = customers.select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.upper("c_name").alias("password")
    )
    made = store.apply(create_many(store, "Account", records)).scan("Account")
    return made.select(
        "id",
        "name",
        verify_secret(F.upper("name"), F.col("password")).alias("right_one"),
        verify_secret(F.col("name"), F.col("password")).alias("wrong_one"),
    )


@query(
    """
    SELECT c_custkey AS id, 'pepper$' || sha256('pepper' || c_mktsegment || '/' || c_custkey) AS stored FROM customer
    """
)
def secret_hash(spark, folder):
    secret = F.concat_ws("/", "c_mktsegment", "c_custkey")
    customers = open_warehouse(spark, folder).scan("Customer")
    return customers.select(F.col("c_custkey").alias("id"), hash_secret(secret, F.lit("pepper")).alias("stored"))


@query(
    f"""
    SELECT 'order' AS kind, o_orderkey AS key, o_custkey AS ref FROM orders
    UNION ALL SELECT 'customer', c_custkey, c_nationkey FROM customer
    UNION ALL SELECT 'order', s_suppkey + (SELECT max(o_orderkey) + 1 FROM orders), s_suppkey + {_NEW_KEY} FROM supplier
    UNION ALL SELECT 'customer', s_suppkey + {_NEW_KEY}, s_nationkey FROM supplier
    """
)
def create_nested_one(spark, folder):
    """One order per supplier, each with its customer as a new nested record."""
    store = open_warehouse(spark, folder)
    first_order, first_customer = _first_free(store, "Order"), _first_free(store, "Customer")
    records = store.scan("Supplier").select(
        (F.col("s_suppkey") + first_order).alias("o_orderkey"),
        F.col("s_acctbal").alias("o_totalprice"),
        F.struct(
            (F.col("s_suppkey") + first_customer).alias("c_custkey"),
            F.col("s_name").alias("c_name"),
            F.col("nation"),
        ).alias("customer"),
    )
    after = store.apply(create_many(store, "Order", records))
    return _kinds(
        order=after.scan("Order", ["o_orderkey", "customer"]), customer=after.scan("Customer", ["c_custkey", "nation"])
    )


def _kinds(**frames):
    parts = [df.toDF("key", "ref").select(F.lit(kind).alias("kind"), "key", "ref") for kind, df in frames.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(
    f"""
    WITH n AS (SELECT s_suppkey + {_NEW_KEY} AS cust,
                      2 * s_suppkey + (SELECT max(o_orderkey) + 1 FROM orders) AS o FROM supplier)
    SELECT 'link' AS kind, o_custkey AS key, o_orderkey AS ref FROM orders
    UNION ALL SELECT 'link', cust, o FROM n UNION ALL SELECT 'link', cust, o + 1 FROM n
    UNION ALL SELECT 'order', o_orderkey, o_custkey FROM orders
    UNION ALL SELECT 'order', o, cust FROM n UNION ALL SELECT 'order', o + 1, cust FROM n
    """
)
def create_nested_many(spark, folder):
    """New customers that bring two new orders each."""
    store = open_warehouse(spark, folder)
    first_order, first_customer = _first_free(store, "Order"), _first_free(store, "Customer")

    def order(shift):
        return F.struct(
            (F.col("s_suppkey") * 2 + first_order + shift).alias("o_orderkey"),
            (F.col("s_suppkey") + first_customer).alias("customer"),
            F.col("s_acctbal").alias("o_totalprice"),
        )

    records = store.scan("Supplier").select(
        (F.col("s_suppkey") + first_customer).alias("c_custkey"),
        F.col("s_name").alias("c_name"),
        F.col("nation"),
        F.array(order(0), order(1)).alias("orders"),
    )
    after = store.apply(create_many(store, "Customer", records))
    return _kinds(link=after.links("Customer", "orders"), order=after.scan("Order", ["o_orderkey", "customer"]))


@query(
    """
    SELECT o_orderkey, o_custkey AS customer FROM orders UNION ALL
    SELECT s_suppkey + (SELECT max(o_orderkey) + 1 FROM orders), s_suppkey FROM supplier
    """
)
def create_ref_existing(spark, folder):
    """New orders that name an existing customer by key alone; no customer is added."""
    store = open_warehouse(spark, folder)
    first = _first_free(store, "Order")
    records = store.scan("Supplier").select(
        (F.col("s_suppkey") + first).alias("o_orderkey"),
        F.col("s_acctbal").alias("o_totalprice"),
        F.struct(F.col("s_suppkey").alias("c_custkey"), F.lit(None).cast("string").alias("c_name")).alias("customer"),
    )
    return store.apply(create_many(store, "Order", records)).scan("Order", ["o_orderkey", "customer"])


@query(
    f"""
    SELECT o_custkey AS source, o_orderpriority AS target FROM orders
    UNION ALL SELECT s_suppkey + {_NEW_KEY}, p FROM supplier, (VALUES ('1-URGENT'), ('5-LOW'), ('5-LOW')) v(p)
    """
)
def create_prim_array(spark, folder):
    store = open_warehouse(spark, folder)
    values = F.array(F.lit("1-URGENT"), F.lit("5-LOW"), F.lit("5-LOW"))
    records = _new_customers(store).withColumn("priorities", values)
    return store.apply(create_many(store, "Customer", records)).links("Customer", "priorities")


# -- update ----------------------------------------------------------------------


@query(
    """
    SELECT c_custkey, CASE WHEN c_custkey = 7 THEN 'Renamed' ELSE c_name END AS c_name,
           CASE WHEN c_custkey = 7 THEN -1.25 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer
    """
)
def update_patch(spark, folder):
    store = open_warehouse(spark, folder)
    after = store.apply(update(store, "Customer", 7, {"c_name": "Renamed", "c_acctbal": -1.25}))
    return after.scan("Customer", ["c_custkey", "c_name", "c_acctbal", "c_mktsegment"])


@query(
    """
    SELECT c_custkey, coalesce(bal, c_acctbal) AS c_acctbal,
           CASE WHEN f THEN 'MACHINERY' ELSE c_mktsegment END AS c_mktsegment
    FROM customer LEFT JOIN (
      SELECT o_custkey, arg_max(o_totalprice, o_orderkey) AS bal, bool_or(o_orderstatus = 'F') AS f
      FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey
    """
)
def update_many_last_wins(spark, folder):
    """One patch per order; the newest order sets the balance, finished ones also the segment."""
    store = open_warehouse(spark, folder)
    always = F.array(F.lit("c_custkey"), F.lit("c_acctbal"))
    done = F.col("o_orderstatus") == "F"
    patches = store.scan("Order").select(
        F.col("customer").alias("c_custkey"),
        F.col("o_totalprice").alias("c_acctbal"),
        F.lit("MACHINERY").alias("c_mktsegment"),
        F.when(done, F.array_append(always, F.lit("c_mktsegment"))).otherwise(always).alias("_present"),
        F.col("o_orderkey").alias("_ord"),
    )
    after = store.apply(update_many(store, "Customer", patches))
    return after.scan("Customer", ["c_custkey", "c_acctbal", "c_mktsegment"])


@query(
    """
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE o_custkey END AS customer, o_totalprice FROM orders
    """
)
def update_ref(spark, folder):
    """A key alone repoints: a third of the orders go to one customer."""
    store = open_warehouse(spark, folder)
    to = F.struct(F.lit(0).cast("bigint").alias("c_custkey"))
    patches = store.scan("Order").where("o_orderstatus = 'P'").select("o_orderkey", to.alias("customer"))
    return store.apply(update_many(store, "Order", patches)).scan("Order", ["o_orderkey", "customer", "o_totalprice"])


@query(
    """
    SELECT c_custkey, coalesce(bal, c_acctbal) AS c_acctbal, c_mktsegment FROM customer LEFT JOIN (
      SELECT o_custkey, arg_max(o_totalprice, o_orderkey) AS bal FROM orders
      WHERE o_orderpriority = '1-URGENT' GROUP BY o_custkey) ON o_custkey = c_custkey
    """
)
def update_ref_current(spark, folder):
    """Without a key, the fields patch the child the record refers to now."""
    store = open_warehouse(spark, folder)
    patches = store.scan("Order").where("o_orderpriority = '1-URGENT'").select(
        "o_orderkey",
        F.struct(F.col("o_totalprice").alias("c_acctbal")).alias("customer"),
        F.col("o_orderkey").alias("_ord"),
    )
    after = store.apply(update_many(store, "Order", patches))
    return after.scan("Customer", ["c_custkey", "c_acctbal", "c_mktsegment"])


@query(
    """
    SELECT o_orderkey, o_custkey AS customer,
           CASE WHEN o_totalprice > 400000 THEN '1-URGENT' ELSE o_orderpriority END AS o_orderpriority FROM orders
    """
)
def update_children(spark, folder):
    """Objects in a customer's array patch those orders; membership stays."""
    store = open_warehouse(spark, folder)
    child = F.struct(F.col("o_orderkey"), F.lit("1-URGENT").alias("o_orderpriority"))
    patches = store.scan("Order").where("o_totalprice > 400000").select(
        F.col("customer").alias("c_custkey"), F.array(child).alias("orders")
    )
    after = store.apply(update_many(store, "Customer", patches))
    return after.scan("Order", ["o_orderkey", "customer", "o_orderpriority"])


@query(
    """
    SELECT o_custkey AS source, o_orderpriority AS target FROM orders JOIN customer ON c_custkey = o_custkey
    WHERE c_mktsegment <> 'BUILDING'
    UNION ALL
    SELECT c_custkey, p FROM customer, (VALUES ('3-MEDIUM'), ('4-NOT SPECIFIED')) v(p) WHERE c_mktsegment = 'BUILDING'
    """
)
def update_prim_array(spark, folder):
    store = open_warehouse(spark, folder)
    values = F.array(F.lit("3-MEDIUM"), F.lit("4-NOT SPECIFIED"))
    patches = store.scan("Customer").where("c_mktsegment = 'BUILDING'").select("c_custkey", values.alias("priorities"))
    return store.apply(update_many(store, "Customer", patches)).links("Customer", "priorities")


_MOVED = "CASE WHEN c_mktsegment = 'MACHINERY' THEN c_custkey + 1000000000 ELSE c_custkey END"


@query(
    f"""
    WITH m AS (SELECT c_custkey, {_MOVED} AS now, c_nationkey FROM customer)
    SELECT 'customer' AS kind, now AS key, c_nationkey::BIGINT AS ref FROM m
    UNION ALL SELECT 'order', o_orderkey, now FROM orders JOIN m ON c_custkey = o_custkey
    UNION ALL SELECT 'event', event_id, now FROM events JOIN m ON c_custkey = user_id
    UNION ALL SELECT 'link', now, o_orderkey FROM orders JOIN m ON c_custkey = o_custkey
    UNION ALL SELECT 'nation', c_nationkey, now FROM m
    """
)
def update_pk(spark, folder):
    """New primary keys reach every reference and both ends of the links."""
    store = open_warehouse(spark, folder)
    patches = store.scan("Customer").where("c_mktsegment = 'MACHINERY'").select(
        F.col("c_custkey").alias("_key"), (F.col("c_custkey") + 1_000_000_000).alias("c_custkey")
    )
    after = store.apply(update_many(store, "Customer", patches))
    return _kinds(
        customer=after.scan("Customer", ["c_custkey", "nation"]),
        order=after.scan("Order", ["o_orderkey", "customer"]),
        event=after.scan("Event", ["event_id", "user"]),
        link=after.links("Customer", "orders"),
        nation=after.links("Nation", "customers"),
    )


# -- delete ----------------------------------------------------------------------


@query("SELECT event_id, user_id AS \"user\", event_type FROM events WHERE event_type <> 'error'", name="delete_many")
def delete_events(spark, folder):
    store = open_warehouse(spark, folder)
    keys = store.scan("Event").where("event_type = 'error'").select("event_id")
    return store.apply(delete_many(store, "Event", keys)).scan("Event", ["event_id", "user", "event_type"])


@query("SELECT event_id, event_type, c_name FROM events JOIN customer ON c_custkey = user_id WHERE event_type = 'error'")
def delete_returns(spark, folder):
    """A delete returns the records as they were, populated as asked."""
    store = open_warehouse(spark, folder)
    keys = store.scan("Event").where("event_type = 'error'").select("event_id")
    gone = delete_many(store, "Event", keys, select=["event_type", {"user": ["c_name"]}]).result.records
    return gone.select("event_id", "event_type", "user.c_name")


@query(
    """
    SELECT 'document' AS kind, d.doc_id AS key, l.doc_id AS ref FROM documents d
    LEFT JOIN (SELECT * FROM labels WHERE quality <> 0) l ON l.doc_id = d.doc_id
    UNION ALL SELECT 'label', doc_id, quality FROM labels WHERE quality <> 0
    UNION ALL SELECT 'link', l_orderkey, l_partkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size <= 40
    """
)
def delete_effects(spark, folder):
    """Optional references to deleted labels become null; links to deleted parts vanish."""
    store = open_warehouse(spark, folder)
    labels = store.scan("Label").where("quality = 0").select("doc_id")
    store = store.apply(delete_many(store, "Label", labels))
    parts = store.scan("Part").where("p_size > 40").select("p_partkey")
    after = store.apply(delete_many(store, "Part", parts))
    return _kinds(
        document=after.scan("Document", ["doc_id", "label"]),
        label=after.scan("Label", ["doc_id", "quality"]),
        link=after.links("Order", "parts"),
    )


@query(
    """
    SELECT 'document' AS kind, d.doc_id AS key, l.doc_id AS ref FROM documents d
    LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE lang <> 'de'
    UNION ALL SELECT 'label', l.doc_id, quality FROM labels l
    JOIN documents d ON d.doc_id = l.doc_id WHERE lang <> 'de'
    """
)
def delete_cascade(spark, folder):
    """Deleting documents with ``cascade`` also deletes the labels they refer to."""
    store = open_warehouse(spark, folder)
    keys = store.scan("Document").where("lang = 'de'").select("doc_id")
    after = store.apply(delete_many(store, "Document", keys, cascade=True))
    return _kinds(document=after.scan("Document", ["doc_id", "label"]), label=after.scan("Label", ["doc_id", "quality"]))


# -- arrays and groups -------------------------------------------------------------


@query(
    """
    SELECT l_orderkey AS source, l_partkey AS target FROM lineitem
    UNION ALL SELECT o_orderkey, 0 FROM orders WHERE o_orderstatus = 'F'
    """
)
def push_many(spark, folder):
    """The same existing part goes onto a third of all orders."""
    store = open_warehouse(spark, folder)
    part = F.struct(F.lit(0).cast("bigint").alias("p_partkey"))
    items = store.scan("Order").where("o_orderstatus = 'F'").select(
        F.col("o_orderkey").alias("source"), part.alias("item")
    )
    return store.apply(push_many_to(store, "Order", "parts", items)).links("Order", "parts")


@query(
    """
    SELECT 'link' AS kind, l_orderkey AS key, l_partkey AS ref FROM lineitem
    UNION ALL SELECT 'link', o_orderkey, o_orderkey + (SELECT max(p_partkey) + 1 FROM part)
    FROM orders WHERE o_totalprice > 450000
    UNION ALL SELECT 'part', p_partkey, p_size FROM part
    UNION ALL SELECT 'part', o_orderkey + (SELECT max(p_partkey) + 1 FROM part), 1 FROM orders WHERE o_totalprice > 450000
    """
)
def push_new(spark, folder):
    """New records pushed onto arrays are created and linked."""
    store = open_warehouse(spark, folder)
    first = _first_free(store, "Part")
    part = F.struct(
        (F.col("o_orderkey") + first).alias("p_partkey"),
        F.lit("extra").alias("p_name"),
        F.lit("Brand#0").alias("p_brand"),
        F.lit("PROMO").alias("p_type"),
        F.lit(1).cast("bigint").alias("p_size"),
        F.col("o_totalprice").alias("p_retailprice"),
    )
    items = store.scan("Order").where("o_totalprice > 450000").select(
        F.col("o_orderkey").alias("source"), part.alias("item")
    )
    after = store.apply(push_many_to(store, "Order", "parts", items))
    return _kinds(link=after.links("Order", "parts"), part=after.scan("Part", ["p_partkey", "p_size"]))


@query(
    """
    SELECT l_orderkey AS source, l_partkey AS target FROM lineitem
    WHERE (l_orderkey, l_partkey) NOT IN (SELECT (l_orderkey, l_partkey) FROM lineitem WHERE l_returnflag = 'R')
    """
)
def remove_many(spark, folder):
    """Every link equal to a returned one goes, duplicates included."""
    store = open_warehouse(spark, folder)
    returned = spark.read.parquet(f"{folder}/lineitem.parquet").where("l_returnflag = 'R'")
    pairs = returned.select(F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("target"))
    return store.apply(remove_many_from(store, "Order", "parts", pairs)).links("Order", "parts")


@query("SELECT DISTINCT p_partkey, p_name FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R'")
def remove_returns(spark, folder):
    """A removal returns the records it unlinked."""
    store = open_warehouse(spark, folder)
    returned = spark.read.parquet(f"{folder}/lineitem.parquet").where("l_returnflag = 'R'")
    pairs = returned.select(F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("target"))
    return remove_many_from(store, "Order", "parts", pairs, select=["p_name"]).result.records


@query(
    f"""
    SELECT 'customer' AS kind, c_custkey AS key, c_nationkey::BIGINT AS ref FROM customer
    UNION ALL SELECT 'customer', s_suppkey + {_NEW_KEY}, s_nationkey FROM supplier
    UNION ALL SELECT 'link', o_custkey, o_orderkey FROM orders
    UNION ALL SELECT 'link', {_NEW_KEY}, 0
    UNION ALL SELECT 'event', event_id, user_id FROM events WHERE event_type <> 'view'
    UNION ALL SELECT 'version', 1, 2
    """
)
def group_atomic(spark, folder):
    """Create, push and delete as one group, published as one version."""
    store = open_warehouse(spark, folder)
    first = _first_free(store, "Customer")
    views = store.scan("Event").where("event_type = 'view'").select("event_id")
    keep = {m.name for m in store.catalog.models if m.name in ("Region", "Nation", "Customer", "Supplier", "Order", "Part", "Event")}
    catalog = Catalog(tuple(m for m in store.catalog.models if m.name in keep))
    path = scratch_path(spark, "group")
    store = store.replaced(catalog=catalog).publish(path)
    after, _ = run_group(
        store,
        [
            lambda s: create_many(s, "Customer", _new_customers(s)),
            lambda s: push_to(s, "Customer", "orders", first, {"o_orderkey": 0}),
            lambda s: delete_many(s, "Event", views),
        ],
    )
    after = after.publish()
    versions = Store.versions(spark, path).agg(F.min("version"), F.max("version"))
    return _kinds(
        customer=after.scan("Customer", ["c_custkey", "nation"]),
        link=after.links("Customer", "orders"),
        event=after.scan("Event", ["event_id", "user"]),
        version=versions,
    )
