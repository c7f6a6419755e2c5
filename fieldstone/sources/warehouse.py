"""The order-and-document tables as a catalog of models.

Array fields are link views over foreign-key columns; nothing is copied.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldstone.catalog import (
    BOOL,
    DATE,
    FLOAT,
    INT,
    STRING,
    ArrayOf,
    Catalog,
    Enumeration,
    Field,
    Model,
    Ref,
)
from fieldstone.session import tune
from fieldstone.sources.store import Store

# The members that occur in the tables.
SEGMENT = Enumeration("Segment", ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"))
STATUS = Enumeration("Status", ("F", "O", "P"))
PRIORITY = Enumeration("Priority", ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"))
FLAG = Enumeration("Flag", ("A", "N", "R"))
EVENT = Enumeration("EventType", ("click", "error", "purchase", "signup", "view"))
LANG = Enumeration("Lang", ("de", "en", "es", "fr"))

CATALOG = Catalog(
    (
        Model(
            "Region",
            1,
            (
                Field("r_regionkey", INT, 1, primary=True),
                Field("r_name", STRING, 2, unique=True),
                Field("nations", ArrayOf(Ref("Nation")), 3),
            ),
        ),
        Model(
            "Nation",
            2,
            (
                Field("n_nationkey", INT, 1, primary=True),
                Field("n_name", STRING, 2),
                Field("region", Ref("Region"), 3),
                Field("customers", ArrayOf(Ref("Customer")), 4),
                Field("suppliers", ArrayOf(Ref("Supplier")), 5),
            ),
        ),
        Model(
            "Customer",
            3,
            (
                Field("c_custkey", INT, 1, primary=True, auto_increment=True),
                Field("c_name", STRING, 2, public_credential=True),
                Field("nation", Ref("Nation"), 3),
                Field("c_acctbal", FLOAT, 4, default=0.0),
                Field("c_mktsegment", SEGMENT, 5, default="BUILDING"),
                Field("orders", ArrayOf(Ref("Order")), 6),
                Field("priorities", ArrayOf(PRIORITY), 7),
            ),
            user=True,
        ),
        Model(
            "Supplier",
            4,
            (
                Field("s_suppkey", INT, 1, primary=True),
                Field("s_name", STRING, 2),
                Field("nation", Ref("Nation"), 3),
                Field("s_acctbal", FLOAT, 4),
            ),
        ),
        Model(
            "Part",
            5,
            (
                Field("p_partkey", INT, 1, primary=True),
                Field("p_name", STRING, 2),
                Field("p_brand", STRING, 3),
                Field("p_type", STRING, 4),
                Field("p_size", INT, 5),
                Field("p_retailprice", FLOAT, 6),
            ),
        ),
        Model(
            "Order",
            6,
            (
                Field("o_orderkey", INT, 1, primary=True, auto_increment=True),
                Field("customer", Ref("Customer"), 2),
                Field("o_orderstatus", STATUS, 3, default="O"),
                Field("o_totalprice", FLOAT, 4),
                Field("o_orderdate", DATE, 5, optional=True),
                Field("o_orderpriority", PRIORITY, 6, default="5-LOW"),
                Field("parts", ArrayOf(Ref("Part")), 7),
                Field("flags", ArrayOf(FLAG), 8),
            ),
        ),
        Model(
            "Event",
            7,
            (
                Field("event_id", INT, 1, primary=True),
                Field("ts", DATE, 2),
                Field("user", Ref("Customer"), 3),
                Field("event_type", EVENT, 4),
                Field("value", FLOAT, 5),
                Field("props", STRING, 6, optional=True),
            ),
        ),
        Model(
            "Label",
            8,
            (
                Field("doc_id", INT, 1, primary=True),
                Field("quality", INT, 2),
                Field("toxic", BOOL, 3),
            ),
        ),
        Model(
            "Document",
            9,
            (
                Field("doc_id", INT, 1, primary=True),
                Field("text", STRING, 2),
                Field("lang", LANG, 3),
                Field("source", STRING, 4),
                Field("n_chars", INT, 5),
                Field("label", Ref("Label"), 6, optional=True),
            ),
        ),
        Model(
            "Conversation",
            10,
            (
                Field("conv_id", INT, 1, primary=True),
                Field("messages", ArrayOf(STRING), 2),
            ),
        ),
    )
)


# Column types of the files, so that opening a table starts no job.
_FILES = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_returnflag STRING",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "conversations": "conv_id BIGINT, text STRING",
}


def open_warehouse(spark: SparkSession, folder: str) -> Store:
    """A store over the parquet tables in ``folder``; all frames are lazy."""
    tune(spark)

    def read(name: str) -> DataFrame:
        return spark.read.schema(_FILES[name]).parquet(f"{folder}/{name}.parquet")

    def big(column: str):
        return F.col(column).cast("bigint").alias(column)

    def key(column: str, name: str):
        return F.col(column).cast("bigint").alias(name)

    def link(name: str, source: str, target: str):
        kind = "bigint" if target.endswith("key") else "string"
        columns = key(source, "source"), F.col(target).cast(kind).alias("target")
        return lambda: read(name).select(*columns)

    def table(name: str, *columns):
        return lambda: read(name).select(*columns)

    labels = table("labels", "doc_id", big("quality"), (F.col("toxic") == 1).alias("toxic"))

    def documents() -> DataFrame:
        # Distinct keys let the optimizer drop this join where the label is not read,
        # so that texts are not shuffled for it.
        labelled = labels().select(F.col("doc_id").alias("label")).distinct()
        joined = read("documents").join(labelled, F.col("doc_id") == F.col("label"), "left")
        return joined.select("doc_id", "text", "lang", "source", "n_chars", "label")

    tables = {
        "Region": table("region", big("r_regionkey"), "r_name"),
        "Nation": table("nation", big("n_nationkey"), "n_name", key("n_regionkey", "region")),
        "Customer": table(
            "customer", "c_custkey", "c_name", key("c_nationkey", "nation"), "c_acctbal", "c_mktsegment"
        ),
        "Supplier": table("supplier", "s_suppkey", "s_name", key("s_nationkey", "nation"), "s_acctbal"),
        "Part": table("part", "p_partkey", "p_name", "p_brand", "p_type", big("p_size"), "p_retailprice"),
        "Order": table(
            "orders",
            "o_orderkey",
            key("o_custkey", "customer"),
            "o_orderstatus",
            "o_totalprice",
            "o_orderdate",
            "o_orderpriority",
        ),
        "Event": table("events", "event_id", "ts", key("user_id", "user"), "event_type", "value", "props"),
        "Label": labels,
        "Document": documents,
        "Conversation": lambda: read("conversations").select("conv_id").distinct(),
    }
    links = {
        ("Region", "nations"): link("nation", "n_regionkey", "n_nationkey"),
        ("Nation", "customers"): link("customer", "c_nationkey", "c_custkey"),
        ("Nation", "suppliers"): link("supplier", "s_nationkey", "s_suppkey"),
        ("Customer", "orders"): link("orders", "o_custkey", "o_orderkey"),
        ("Customer", "priorities"): link("orders", "o_custkey", "o_orderpriority"),
        ("Order", "parts"): link("lineitem", "l_orderkey", "l_partkey"),
        ("Order", "flags"): link("lineitem", "l_orderkey", "l_returnflag"),
        ("Conversation", "messages"): link("conversations", "conv_id", "text"),
    }
    return Store(spark, CATALOG, tables, links)
