"""User functions on write, read and delete."""

from __future__ import annotations

from dataclasses import replace

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldstone.functions.registry import register
from fieldstone.operators.mutate import create_many, delete, update_many
from fieldstone.operators.query import list_, read
from fieldstone.plans.registry import query
from fieldstone.plans.writes import _CUSTOMERS, _NEW_KEY, _new_customers
from fieldstone.sources.warehouse import open_warehouse

register("title", lambda df: df.withColumn("c_name", F.concat(F.lit("Dr. "), "c_name")))
register("shout", lambda df: df.withColumn("c_name", F.upper("c_name")))
register("next event", lambda df: df.withColumn("event_id", F.col("event_id") + 1))


def _mark(df):
    """Decorate the priority unless the order is finished."""
    done = F.coalesce(F.col("o_orderstatus") == "F", F.lit(False))
    return df.withColumn(
        "o_orderpriority", F.when(done, F.col("o_orderpriority")).otherwise(F.concat(F.lit("! "), "o_orderpriority"))
    )


def _count_characters(df):
    # Defined here, so that it travels to the workers by value.
    @F.pandas_udf(T.LongType())
    def characters(text: pd.Series) -> pd.Series:
        return text.str.len()

    return df.withColumn("n_chars", characters("text"))


register("mark open", _mark)
register("count characters", _count_characters)


def _hooked(spark, folder, model, **hooks):
    store = open_warehouse(spark, folder)
    return store.replaced(catalog=store.catalog.with_model(replace(store.catalog.model(model), **hooks)))


@query(
    f"""
    {_CUSTOMERS} UNION ALL
    SELECT s_suppkey + {_NEW_KEY}, upper('Dr. ' || s_name), s_nationkey, 0.0, 'BUILDING' FROM supplier
    """
)
def hook_write(spark, folder):
    """Write hooks run in order on the incoming batch."""
    store = _hooked(spark, folder, "Customer", on_write=("title", "shout"))
    return store.apply(create_many(store, "Customer", _new_customers(store))).scan("Customer")


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'DR. DEBTOR ' || c_custkey ELSE c_name END AS c_name FROM customer")
def hook_write_patch(spark, folder):
    store = _hooked(spark, folder, "Customer", on_write=("title", "shout"))
    name = F.concat(F.lit("debtor "), F.col("c_custkey").cast("string"))
    patches = store.scan("Customer").where("c_acctbal < 0").select("c_custkey", name.alias("c_name"))
    return store.apply(update_many(store, "Customer", patches)).scan("Customer", ["c_custkey", "c_name"])


@query(
    """
    SELECT o_orderkey, o_orderstatus,
           CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE '! ' || o_orderpriority END AS priority FROM orders
    """
)
def hook_read(spark, folder):
    store = _hooked(spark, folder, "Order", on_read=("mark open",))
    return list_(store, "Order", select=["o_orderstatus", {"priority": "o_orderpriority"}]).records


@query("SELECT o_orderkey, '! ' || o_orderpriority AS o_orderpriority FROM orders")
def hook_read_absent(spark, folder):
    """A hook sees selected fields only: without the status, every order is decorated."""
    store = _hooked(spark, folder, "Order", on_read=("mark open",))
    return list_(store, "Order", select=["o_orderpriority"]).records


@query(
    """
    SELECT c_custkey, o_orderkey, CASE WHEN o_orderstatus = 'F' THEN '' ELSE '! ' END || o_orderpriority AS o_orderpriority,
           'Dr. ' || c_name AS c_name
    FROM customer JOIN orders ON o_custkey = c_custkey
    """
)
def hook_nested_read(spark, folder):
    """Hooks of nested models run first, on the elements of the array."""
    store = _hooked(spark, folder, "Order", on_read=("mark open",))
    customer = replace(store.catalog.model("Customer"), on_read=("title",))
    store = store.replaced(catalog=store.catalog.with_model(customer))
    found = list_(store, "Customer", select=["c_name", {"orders": ["o_orderstatus", "o_orderpriority"]}])
    orders = found.lists["orders"].records.drop("o_orderstatus")
    return orders.join(found.records, F.col("_source") == F.col("c_custkey")).drop("_source")


@query("SELECT doc_id, length(text) AS n_chars FROM documents")
def hook_pandas(spark, folder):
    """A vectorized function over the whole texts."""
    store = _hooked(spark, folder, "Document", on_read=("count characters",))
    return list_(store, "Document", select=["text", "n_chars"]).records.select("doc_id", "n_chars")


@query("SELECT event_id, user_id AS \"user\" FROM events WHERE event_id <> 8")
def hook_delete(spark, folder):
    """A delete hook receives the key and its result replaces it."""
    store = _hooked(spark, folder, "Event", on_delete=("next event",))
    after = store.apply(delete(store, "Event", 7))
    assert read(after, "Event", 7).records.count() == 1
    return after.scan("Event", ["event_id", "user"])
