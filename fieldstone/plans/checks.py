"""Constraint checks over the whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldstone.catalog import DATE, INT, STRING, Catalog, Enumeration, Field, Model, Ref
from fieldstone.operators.quality import (
    check_all,
    check_enums,
    check_json,
    check_primary,
    check_refs,
    check_required,
    check_unique,
)
from fieldstone.plans.registry import query
from fieldstone.sources.store import Store
from fieldstone.sources.warehouse import EVENT, open_warehouse


def _one_model(spark, df, *fields: Field, name: str = "Row", **kwargs) -> Store:
    return Store(spark, Catalog((Model(name, 1, fields, **kwargs),)), {name: df})


@query(
    """
    SELECT 'Line' AS model, 'id' AS field, CAST(NULL AS VARCHAR) AS key, 'primary_duplicate' AS rule,
           l_orderkey || '/' || l_linenumber AS value
    FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
    """
)
def dq_pk(spark, folder):
    """Order and line number look like a key of ``lineitem`` and are not."""
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    table = lines.select(F.concat_ws("/", "l_orderkey", "l_linenumber").alias("id"))
    return check_primary(_one_model(spark, table, Field("id", STRING, 1, primary=True), name="Line"), "Line")


@query(
    """
    SELECT 'Part' AS model, 'name' AS field, CAST(NULL AS VARCHAR) AS key, 'unique' AS rule, p_name AS value
    FROM part GROUP BY p_name HAVING count(*) > 1
    """
)
def dq_unique(spark, folder):
    table = open_warehouse(spark, folder).scan("Part", ["p_partkey", "p_name"]).toDF("id", "name")
    fields = Field("id", INT, 1, primary=True), Field("name", STRING, 2, unique=True)
    return check_unique(_one_model(spark, table, *fields, name="Part"), "Part")


@query(
    """
    SELECT 'Document' AS model, 'label' AS field, CAST(d.doc_id AS VARCHAR) AS key, 'required' AS rule,
           CAST(NULL AS VARCHAR) AS value
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE l.doc_id IS NULL
    """
)
def dq_required(spark, folder):
    table = open_warehouse(spark, folder).scan("Document", ["doc_id", "label"])
    fields = Field("doc_id", INT, 1, primary=True), Field("label", INT, 2)
    return check_required(_one_model(spark, table, *fields, name="Document"), "Document")


@query(
    """
    SELECT 'Event' AS model, 'user' AS field, CAST(event_id AS VARCHAR) AS key, 'reference' AS rule,
           CAST(user_id AS VARCHAR) AS value
    FROM events JOIN customer ON c_custkey = user_id WHERE c_acctbal < 0
    """
)
def dq_fk(spark, folder):
    """Events of customers that the store lacks: those with a negative balance."""
    store = open_warehouse(spark, folder)
    fewer = store.replaced(tables={**store.tables, "Customer": store.scan("Customer").where("c_acctbal >= 0")})
    return check_refs(fewer, "Event")


@query(
    """
    SELECT 'Customer' AS model, 'orders' AS field, CAST(o_custkey AS VARCHAR) AS key, 'link_target' AS rule,
           CAST(o_orderkey AS VARCHAR) AS value FROM orders WHERE o_orderstatus = 'F'
    UNION ALL
    SELECT 'Customer', 'orders', CAST(o_custkey AS VARCHAR), 'link_source', CAST(o_custkey AS VARCHAR)
    FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal < 0
    UNION ALL
    SELECT 'Customer', 'priorities', CAST(o_custkey AS VARCHAR), 'link_source', CAST(o_custkey AS VARCHAR)
    FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal < 0
    """
)
def dq_links(spark, folder):
    store = open_warehouse(spark, folder)
    tables = {
        **store.tables,
        "Customer": store.scan("Customer").where("c_acctbal >= 0"),
        "Order": store.scan("Order").where("o_orderstatus <> 'F'"),
    }
    return check_refs(store.replaced(tables=tables), "Customer")


@query(
    """
    SELECT 'Customer' AS model, 'segment' AS field, CAST(c_custkey AS VARCHAR) AS key, 'enum' AS rule,
           c_mktsegment AS value FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')
    UNION ALL
    SELECT 'Customer', 'priorities', CAST(o_custkey AS VARCHAR), 'enum', o_orderpriority
    FROM orders WHERE o_orderpriority <> '5-LOW'
    """
)
def dq_enum(spark, folder):
    """Members missing from an enum show up in scalar and array fields."""
    from fieldstone.catalog import ArrayOf

    store = open_warehouse(spark, folder)
    catalog = Catalog(
        (
            Model(
                "Customer",
                1,
                (
                    Field("id", INT, 1, primary=True),
                    Field("segment", Enumeration("Segment", ("BUILDING", "MACHINERY")), 2),
                    Field("priorities", ArrayOf(Enumeration("Priority", ("5-LOW",))), 3),
                ),
            ),
        )
    )
    table = store.scan("Customer", ["c_custkey", "c_mktsegment"]).toDF("id", "segment")
    links = {("Customer", "priorities"): store.links("Customer", "priorities")}
    return check_enums(Store(spark, catalog, {"Customer": table}, links), "Customer")


@query(
    """
    SELECT 'Order' AS model, CAST(NULL AS VARCHAR) AS field, CAST(NULL AS VARCHAR) AS key,
           'none' AS rule, '0 of ' || count(*) AS value FROM orders
    """
)
def dq_clean(spark, folder):
    """All checks on orders find nothing; the violations and the orders are counted."""
    store = open_warehouse(spark, folder)
    rows = store.scan("Order", ["o_orderkey"]).count()
    found = check_all(store, "Order").agg(F.count("*").alias("n"))
    return found.select(F.concat(F.col("n").cast("string"), F.lit(f" of {rows}")).alias("value")).select(
        F.lit("Order").alias("model"),
        F.lit(None).cast("string").alias("field"),
        F.lit(None).cast("string").alias("key"),
        F.lit("none").alias("rule"),
        "value",
    )


RECORDS = Catalog(
    (
        Model("User", 1, (Field("id", INT, 1, primary=True),)),
        Model(
            "Record",
            2,
            (
                Field("id", INT, 1, primary=True),
                Field("day", DATE, 2),
                Field("kind", EVENT, 3),
                Field("user", Ref("User"), 4),
                Field("props", STRING, 5, optional=True),
            ),
        ),
    )
)


@query(
    """
    SELECT 'Record' AS model, field, key, rule, value FROM (
      SELECT event_type, CAST(event_id AS VARCHAR) AS id, CAST(value AS VARCHAR) AS v FROM events) e
    JOIN LATERAL (
      SELECT 'id' AS field, id || '.5' AS key, 'type' AS rule, id || '.5' AS value WHERE event_type = 'purchase'
      UNION ALL SELECT 'day', id, 'type', '2024-13-01' WHERE event_type = 'click'
      UNION ALL SELECT 'kind', id, 'type', 'viewed' WHERE event_type = 'view'
      UNION ALL SELECT 'extra', id, 'unknown_field', NULL WHERE event_type = 'signup'
      UNION ALL SELECT 'user', id, 'missing_field', NULL WHERE event_type = 'error'
    ) ON true
    """
)
def dq_json(spark, folder):
    """JSON made from the events, each kind of event broken in its own way."""
    events = open_warehouse(spark, folder).scan("Event")

    def only(kind, broken, fine):
        return F.when(F.col("event_type") == kind, broken).otherwise(fine)

    text = F.concat(
        F.lit('{"id":'),
        only("purchase", F.concat(F.col("event_id").cast("string"), F.lit(".5")), F.col("event_id").cast("string")),
        F.lit(',"day":"'),
        only("click", F.lit("2024-13-01"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        F.lit('","kind":"'),
        only("view", F.lit("viewed"), F.col("event_type")),
        F.lit('"'),
        only("error", F.lit(""), F.concat(F.lit(',"user":{"id":'), F.col("user").cast("string"), F.lit("}"))),
        only("signup", F.lit(',"extra":true'), F.lit(',"props":null')),
        F.lit("}"),
    )
    return check_json(events.select(text.alias("value")), RECORDS, "Record")
