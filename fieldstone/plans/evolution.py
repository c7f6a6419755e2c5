"""Schema evolution of whole tables; each query returns the resulting tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from fieldstone.catalog import FLOAT, INT, STRING, ArrayOf, Catalog, Field, Model, Ref
from fieldstone.operators.evolve import (
    add_field,
    create_model,
    drop_field,
    drop_model,
    evolve,
    field_to_array,
    make_optional,
    migrate,
    move_primary,
    rename_field,
    rename_model,
    set_autoincrement,
    set_unique,
    set_uuid,
)
from fieldstone.operators.mutate import create_many
from fieldstone.operators.query import list_
from fieldstone.plans.reads import accounts
from fieldstone.plans.registry import query
from fieldstone.plans.writes import TICKETS, _kinds, _ticket_store
from fieldstone.session import scratch_path
from fieldstone.sources.store import Store
from fieldstone.sources.warehouse import open_warehouse


@query(
    """
    SELECT s_suppkey, s_name, s_acctbal, 'standard' AS grade, CAST(NULL AS VARCHAR) AS note,
           CAST(NULL AS BIGINT) AS agent FROM supplier
    """
)
def evo_add(spark, folder):
    """New fields: one with a default, an optional one, a reference, and an array without elements."""
    store = open_warehouse(spark, folder)
    store = add_field(store, "Supplier", Field("grade", STRING, 10, default="standard"))
    store = add_field(store, "Supplier", Field("note", STRING, 11, optional=True))
    store = add_field(store, "Supplier", Field("agent", Ref("Customer"), 12, optional=True))
    store = add_field(store, "Supplier", Field("tags", ArrayOf(STRING), 13))
    fields = ["s_suppkey", "s_name", "s_acctbal", "grade", "note", "agent"]
    return store.scan("Supplier", fields).join(
        store.links("Supplier", "tags").withColumnRenamed("source", "s_suppkey"), "s_suppkey", "left_anti"
    )


@query(
    """
    SELECT s_suppkey, row_number() OVER () > 0 AS numbered, true AS has_id FROM supplier
    """
)
def evo_add_generated(spark, folder):
    """New generated fields: numbers are dense, uuids distinct."""
    store = open_warehouse(spark, folder)
    store = add_field(store, "Supplier", Field("no", INT, 10, auto_increment=True))
    store = add_field(store, "Supplier", Field("uid", STRING, 11, uuid=True))
    table = store.scan("Supplier", ["s_suppkey", "no", "uid"])
    totals = table.agg(
        F.count("*").alias("n"), F.count_distinct("no").alias("d"), F.max("no").alias("m"), F.count_distinct("uid").alias("u")
    ).first()
    dense = totals["n"] == totals["d"] == totals["m"] == totals["u"]
    return table.select(
        "s_suppkey", (F.lit(dense) & F.col("no").between(1, totals["n"])).alias("numbered"), (F.length("uid") == 36).alias("has_id")
    )


@query("SELECT s_suppkey AS id, s_name AS title, s_acctbal AS balance FROM supplier")
def evo_rename(spark, folder):
    """Fields renamed in one step, then the model; the data is only projected."""
    store = open_warehouse(spark, folder)
    supplier = store.catalog.model("Supplier")
    names = {"s_suppkey": "id", "s_name": "title", "s_acctbal": "balance"}
    renamed = replace(
        supplier, fields=tuple(replace(f, name=names.get(f.name, f.name)) for f in supplier.fields)
    )
    store = evolve(store, store.catalog, store.catalog.with_model(renamed))
    return rename_model(store, "Supplier", "Vendor").scan("Vendor", ["id", "title", "balance"])


@query(
    """
    SELECT n_nationkey::BIGINT AS n_nationkey, s_suppkey, s_name
    FROM nation JOIN supplier ON s_nationkey = n_nationkey
    """
)
def evo_rename_model(spark, folder):
    """References and links follow a renamed model and a renamed array."""
    store = rename_model(open_warehouse(spark, folder), "Supplier", "Vendor")
    store = rename_field(store, "Nation", "suppliers", "vendors")
    found = list_(store, "Nation", select=[{"vendors": ["s_name"]}]).lists["vendors"]
    return found.records.withColumnRenamed("_source", "n_nationkey")


@query("SELECT p_partkey, p_name, p_type FROM part")
def evo_drop(spark, folder):
    """Fields, an array and a model go; other columns stay."""
    store = open_warehouse(spark, folder)
    for field in ("p_brand", "p_size", "p_retailprice"):
        store = drop_field(store, "Part", field)
    store = drop_field(store, "Order", "parts")
    store = drop_model(store, "Event")
    return store.scan("Part")


@query(
    """
    SELECT p_partkey, p_size::BIGINT AS p_size FROM part
    UNION ALL SELECT p_partkey + (SELECT max(p_partkey) + 1 FROM part), NULL FROM part WHERE p_size > 25
    """
)
def evo_to_optional(spark, folder):
    """Once the size is optional, parts without one can be created."""
    store = make_optional(open_warehouse(spark, folder), "Part", "p_size")
    first = store.scan("Part", ["p_partkey"]).agg(F.max("p_partkey").alias("m")).first()["m"] + 1
    parts = store.scan("Part").where("p_size > 25").withColumn("p_partkey", F.col("p_partkey") + first).drop("p_size")
    return store.apply(create_many(store, "Part", parts)).scan("Part", ["p_partkey", "p_size"])


@query("SELECT c_custkey AS source, c_mktsegment AS target FROM customer")
def evo_to_array(spark, folder):
    """The value becomes the first element of the array."""
    store = field_to_array(open_warehouse(spark, folder), "Customer", "c_mktsegment")
    return store.links("Customer", "c_mktsegment")


@query(
    """
    SELECT d.doc_id, lang, l.doc_id AS label FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
    """
)
def evo_opt_to_array(spark, folder):
    """An optional reference becomes a list; null becomes the empty one."""
    store = field_to_array(open_warehouse(spark, folder), "Document", "label")
    packed = list_(store, "Document", select=["lang", {"label": []}]).nested()
    return packed.select("doc_id", "lang", F.explode_outer("label.doc_id").alias("label"))


@query("SELECT p_partkey, p_name FROM part UNION ALL SELECT -1, 'refused' FROM (SELECT 1) WHERE (SELECT max(n) FROM (SELECT count(*) AS n FROM part GROUP BY p_name)) > 1")
def evo_unique(spark, folder):
    """Customer names can be made unique; part names cannot, and their table stays."""
    from fieldstone.operators.quality import ConstraintError

    store = set_unique(open_warehouse(spark, folder), "Supplier", "s_name")
    try:
        store, note = set_unique(store, "Part", "p_name"), []
    except ConstraintError:
        note = [(-1, "refused")]
    parts = store.scan("Part", ["p_partkey", "p_name"])
    return parts.union(spark.createDataFrame(note, parts.schema))


@query("SELECT user_id AS reporter, count(*) AS n, count(*) AS n_keys FROM events WHERE event_type = 'error' GROUP BY user_id")
def evo_uuid(spark, folder):
    """The generator can be taken off a key of uuids and put on again; stored keys are checked."""
    store = _ticket_store(spark, folder)
    errors = open_warehouse(spark, folder).scan("Event").where("event_type = 'error'")
    records = errors.select(F.col("props").alias("subject"), F.struct(F.col("user").alias("id")).alias("reporter"))
    store = store.apply(create_many(store, "Ticket", records))
    store = set_uuid(set_uuid(store, "Ticket", "id", on=False), "Ticket", "id")
    tickets = store.scan("Ticket").groupBy("reporter")
    return tickets.agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_keys"))


@query(
    """
    SELECT p_partkey, p_name FROM part UNION ALL
    SELECT (SELECT max(p_partkey) FROM part) + row_number() OVER (ORDER BY p_partkey), 'copy of ' || p_name
    FROM part WHERE p_size < 10
    """
)
def evo_autoinc(spark, folder):
    """Parts that number themselves go on from the largest key."""
    store = set_autoincrement(open_warehouse(spark, folder), "Part", "p_partkey")
    copies = store.scan("Part").where("p_size < 10").select(
        F.col("p_partkey").alias("_ord"),
        F.concat(F.lit("copy of "), "p_name").alias("p_name"),
        "p_brand",
        "p_type",
        "p_size",
        "p_retailprice",
    )
    return store.apply(create_many(store, "Part", copies)).scan("Part", ["p_partkey", "p_name"])


@query(
    """
    SELECT 'order' AS kind, CAST(o_orderkey AS VARCHAR) AS key, c_name AS ref FROM orders JOIN customer ON c_custkey = o_custkey
    UNION ALL SELECT 'link', c_name, CAST(o_orderkey AS VARCHAR) FROM orders JOIN customer ON c_custkey = o_custkey
    UNION ALL SELECT 'nation', CAST(c_nationkey AS VARCHAR), c_name FROM customer
    UNION ALL SELECT 'event', CAST(event_id AS VARCHAR), c_name FROM events JOIN customer ON c_custkey = user_id
    UNION ALL SELECT 'customer', c_name, CAST(c_custkey AS VARCHAR) FROM customer
    """
)
def evo_move_pk(spark, folder):
    """Customers are keyed by name from now on; references and links hold names."""
    store = move_primary(open_warehouse(spark, folder), "Customer", "c_name")

    def text(df):
        return df.select(*[F.col(c).cast("string") for c in df.columns])

    return _kinds(
        order=text(store.scan("Order", ["o_orderkey", "customer"])),
        link=text(store.links("Customer", "orders")),
        nation=text(store.links("Nation", "customers")),
        event=text(store.scan("Event", ["event_id", "user"])),
        customer=text(store.scan("Customer", ["c_name", "c_custkey"])),
    )


@query(
    """
    SELECT c_custkey AS id, c_name AS title, c_acctbal AS balance, 'none' AS note, 2::BIGINT AS versions FROM customer
    """
)
def evo_history(spark, folder):
    """A published store evolves; the same catalog again records no version."""
    store = accounts(spark, folder).publish(scratch_path(spark, "accounts"))
    account = store.catalog.model("Account").without_field("active")
    renamed = replace(account.field("name"), name="title")
    changed = account.with_field(renamed).with_field(Field("note", STRING, 6, default="none"))
    new = store.catalog.with_model(changed)
    store = migrate(migrate(store, new), new)
    # The number of versions is one row; a literal keeps it out of a join.
    versions = Store.versions(spark, store.path).count()
    table = store.scan("Account", ["id", "title", "balance", "note"])
    return table.withColumn("versions", F.lit(versions).cast("bigint"))


@query(
    """
    SELECT 'Supplier' AS model, s_suppkey AS key, s_acctbal AS amount, 0::BIGINT AS rank FROM supplier
    UNION ALL SELECT 'Client', c_custkey, c_acctbal, NULL FROM customer
    """
)
def evo_many(spark, folder):
    """One evolution that creates, renames, drops and changes at once."""
    store = open_warehouse(spark, folder)
    catalog = store.catalog
    supplier = catalog.model("Supplier")
    supplier = supplier.without_field("nation").with_field(Field("rank", INT, 9, default=0))
    customer = replace(catalog.model("Customer"), name="Client").with_field(
        Field("c_acctbal", FLOAT, 4, optional=True)
    )
    kept = [m for m in catalog.models if m.name not in ("Customer", "Supplier", "Label", "Document")]

    def follow(f):
        t = f.type
        if isinstance(t, ArrayOf) and t.of == Ref("Customer"):
            return replace(f, type=ArrayOf(Ref("Client")))
        return replace(f, type=Ref("Client")) if t == Ref("Customer") else f

    kept = [replace(m, fields=tuple(follow(f) for f in m.fields)) for m in kept]
    new = Catalog((*kept, supplier, customer, Model("Audit", 20, (Field("id", STRING, 1, primary=True, uuid=True),))))
    store = evolve(store, catalog, new)
    store = create_model(store, Model("Memo", 21, (Field("id", INT, 1, primary=True),)))
    suppliers = store.scan("Supplier", ["s_suppkey", "s_acctbal", "rank"]).toDF("key", "amount", "rank")
    clients = store.scan("Client", ["c_custkey", "c_acctbal"]).toDF("key", "amount")
    clients = clients.withColumn("rank", F.lit(None).cast("bigint"))
    empty = store.scan("Audit").count() + store.scan("Memo").count()
    both = suppliers.withColumn("model", F.lit("Supplier")).unionByName(clients.withColumn("model", F.lit("Client")))
    return both.where(F.lit(empty == 0))
