"""Queries that read: filters, projections, population, order and ranges."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldstone.catalog import BOOL, FLOAT, INT, STRING, Catalog, Field, Model
from fieldstone.functions.secrets import hash_secret
from fieldstone.operators.predicates import array_length
from fieldstone.operators.query import exists_data, list_, next_key, read
from fieldstone.plans.registry import query
from fieldstone.session import scratch_path
from fieldstone.sources.json_records import read_records, to_response
from fieldstone.sources.store import Store
from fieldstone.sources.warehouse import open_warehouse

# -- filters -------------------------------------------------------------------


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation WHERE n_nationkey = 7")
def read_nation(spark, folder):
    return read(open_warehouse(spark, folder), "Nation", 7, ["n_name"]).records


@query(
    """
    SELECT o_orderkey, p_partkey, p_name, o_totalprice, c_name, n_name, r_name
    FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
    JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey
    JOIN part ON p_partkey = l_partkey
    WHERE c_custkey = 7
    """
)
def read_deep(spark, folder):
    """One customer by key, four levels deep, as one row per part of each order."""
    store = open_warehouse(spark, folder)
    select = [
        "c_name",
        {"nation": ["n_name", {"region": ["r_name"]}]},
        {"orders": ["o_totalprice", {"parts": ["p_name"]}]},
    ]
    found = read(store, "Customer", 7, select)
    orders = found.lists["orders"]
    parts = orders.lists["parts"].records.withColumnRenamed("_source", "o_orderkey")
    rows = orders.records.join(parts, "o_orderkey")
    root = found.records.select(
        "c_custkey", "c_name", F.col("nation.n_name"), F.col("nation.region.r_name")
    )
    return rows.join(root, F.col("_source") == F.col("c_custkey")).drop("_source", "c_custkey")


@query(
    """
    SELECT c_custkey, c_name FROM customer
    WHERE c_acctbal >= 0 AND c_acctbal < 5000 AND c_mktsegment = 'BUILDING' AND c_nationkey IS NOT NULL
    """
)
def list_and_filters(spark, folder):
    filters = [{"c_acctbal": {"gte": 0, "lt": 5000}}, {"c_mktsegment": {"eq": "BUILDING"}, "nation": {}}]
    return list_(open_warehouse(spark, folder), "Customer", filters, select=["c_name"]).records


@query(
    """
    SELECT o_orderkey FROM orders
    WHERE (o_orderstatus = 'F' AND o_totalprice > 400000 AND o_orderpriority = '1-URGENT')
       OR o_totalprice < 2000 OR (o_orderstatus = 'P' AND o_totalprice < 5000)
    """
)
def list_tree_or(spark, folder):
    tree = {
        "predicate": {"o_orderstatus": {"eq": "F"}},
        "and": [{"o_totalprice": {"gt": 400000}}, {"o_orderpriority": {"eq": "1-URGENT"}}],
        "or": [
            {"predicate": {"o_totalprice": {"lt": 2000}}},
            {"predicate": {"o_orderstatus": {"eq": "P"}}, "and": [{"o_totalprice": {"lt": 5000}}]},
        ],
    }
    return list_(open_warehouse(spark, folder), "Order", [tree], select=[]).records


@query(
    """
    SELECT c_custkey FROM customer
    WHERE NOT (c_acctbal > 100 AND c_mktsegment = 'MACHINERY') AND c_acctbal < 9000
    """
)
def list_negated(spark, folder):
    tree = {
        "predicate": {"c_acctbal": {"gt": 100}, "c_mktsegment": {"eq": "MACHINERY"}},
        "negated": True,
        "and": [{"c_acctbal": {"lt": 9000}}],
    }
    return list_(open_warehouse(spark, folder), "Customer", [tree], select=[]).records


@query(
    """
    SELECT d.doc_id, d.lang FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
    WHERE l.doc_id IS NULL
    """
)
def list_null_label(spark, folder):
    return list_(open_warehouse(spark, folder), "Document", [{"label": None}], select=["lang"]).records


@query("SELECT d.doc_id, d.lang FROM documents d JOIN labels l ON l.doc_id = d.doc_id")
def list_notnull_label(spark, folder):
    return list_(open_warehouse(spark, folder), "Document", [{"label": {}}], select=["lang"]).records


@query("SELECT doc_id, CAST(quality AS BIGINT) AS quality FROM labels WHERE toxic = 1")
def list_bool(spark, folder):
    return list_(open_warehouse(spark, folder), "Label", [{"toxic": {"eq": True}}], select=["quality"]).records


@query("SELECT p_partkey FROM part WHERE p_size > 10 AND p_size <= 30 AND p_partkey >= 5 AND NOT p_size = 20")
def list_int(spark, folder):
    filters = [
        {"p_size": {"gt": 10, "lte": 30}, "p_partkey": {"gte": 5}},
        {"predicate": {"p_size": {"eq": 20}}, "negated": True},
    ]
    return list_(open_warehouse(spark, folder), "Part", filters, select=[]).records


@query("SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal >= -100.5 AND s_acctbal < 7500.25")
def list_float(spark, folder):
    filters = [{"s_acctbal": {"gte": -100.5, "lt": 7500.25}}]
    return list_(open_warehouse(spark, folder), "Supplier", filters, select=["s_acctbal"]).records


def _parts(spark, folder, test):
    return list_(open_warehouse(spark, folder), "Part", [{"p_name": test}], select=["p_name"]).records


@query("SELECT p_partkey, p_name FROM part WHERE length(p_name) > 7 AND length(p_name) <= 9")
def str_length(spark, folder):
    return _parts(spark, folder, {"length": {"gt": 7, "lte": 9}})


@query("SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, 'small')")
def str_starts(spark, folder):
    return _parts(spark, folder, {"startsWith": "small"})


@query("SELECT p_partkey, p_name FROM part WHERE ends_with(p_name, 'ring')")
def str_ends(spark, folder):
    return _parts(spark, folder, {"endsWith": "ring"})


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE 's%l_ w%t'")
def str_like(spark, folder):
    return _parts(spark, folder, {"pattern": "s%l_ w%t"})


@query("SELECT p_partkey, p_name FROM part WHERE p_name = 'red plate'")
def str_eq(spark, folder):
    return _parts(spark, folder, {"eq": "red plate"})


@query(
    """
    SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders
    WHERE o_orderdate > TIMESTAMP '1996-03-01' AND o_orderdate < TIMESTAMP '1997-01-01 12:00:00'
    """
)
def date_range(spark, folder):
    filters = [{"o_orderdate": {"after": "1996-03-01T00:00:00Z", "before": "1997-01-01T12:00:00+00:00"}}]
    found = list_(open_warehouse(spark, folder), "Order", filters, select=["o_orderdate"]).records
    return found.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query("SELECT o_orderkey FROM orders WHERE o_orderdate = TIMESTAMP '1995-01-06'")
def date_eq(spark, folder):
    filters = [{"o_orderdate": {"eq": "1995-01-06T00:00:00Z"}}]
    return list_(open_warehouse(spark, folder), "Order", filters, select=[]).records


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def enum_eq(spark, folder):
    filters = [{"o_orderstatus": {"eq": "F"}}]
    return list_(open_warehouse(spark, folder), "Order", filters, select=["o_orderstatus"]).records


@query(
    """
    SELECT o_orderkey FROM orders LEFT JOIN
      (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey
    WHERE coalesce(n, 0) = 0 OR coalesce(n, 0) >= 6
    """
)
def array_len(spark, folder):
    tree = {"predicate": {"parts": {"length": {"eq": 0}}}, "or": [{"parts": {"length": {"gte": 6}}}]}
    return list_(open_warehouse(spark, folder), "Order", [tree], select=[]).records


@query("SELECT l_orderkey AS source, count(*) AS length FROM lineitem GROUP BY l_orderkey")
def array_counts(spark, folder):
    return array_length(open_warehouse(spark, folder), "Order", "parts")


@query(
    """
    SELECT o_orderkey, o_totalprice FROM orders JOIN customer ON c_custkey = o_custkey
    JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
    WHERE r_name = (SELECT max(r_name) FROM region) AND c_acctbal > 0 AND o_totalprice > 100000
    """
)
def ref_predicate(spark, folder):
    store = open_warehouse(spark, folder)
    last = store.scan("Region", ["r_name"]).agg(F.max("r_name").alias("m")).first()["m"]
    customer = {"c_acctbal": {"gt": 0}, "nation": {"region": {"r_name": {"eq": last}}}}
    filters = [{"customer": customer, "o_totalprice": {"gt": 100000}}]
    return list_(store, "Order", filters, select=["o_totalprice"]).records


@query(
    """
    SELECT c_custkey, o_orderkey, o_totalprice FROM customer JOIN orders ON o_custkey = c_custkey
    WHERE o_totalprice > 300000 AND o_orderstatus = 'O'
    """
)
def nested_filter(spark, folder):
    orders = {"select": ["o_totalprice"], "filter": [{"o_totalprice": {"gt": 300000}, "o_orderstatus": {"eq": "O"}}]}
    found = list_(open_warehouse(spark, folder), "Customer", select=[{"orders": orders}])
    return found.lists["orders"].records.withColumnRenamed("_source", "c_custkey")


@query(
    "SELECT o_custkey AS c_custkey, o_orderpriority AS value FROM orders WHERE o_orderpriority = '2-HIGH'"
)
def nested_value_filter(spark, folder):
    spec = {"priorities": {"filter": [{"eq": "2-HIGH"}]}}
    found = list_(open_warehouse(spark, folder), "Customer", select=[spec])
    return found.lists["priorities"].records.withColumnRenamed("_source", "c_custkey")


# -- projections -----------------------------------------------------------------


@query("SELECT c_custkey, c_name AS label, c_acctbal AS balance, c_nationkey::BIGINT AS nation FROM customer")
def alias_projection(spark, folder):
    select = {"label": "c_name", "balance": "c_acctbal", "nation": True}
    return list_(open_warehouse(spark, folder), "Customer", select=select).records


ACCOUNTS = Catalog(
    (
        Model(
            "Account",
            1,
            (
                Field("id", INT, 1, primary=True),
                Field("name", STRING, 2, public_credential=True),
                Field("password", STRING, 3, secret_credential=True),
                Field("balance", FLOAT, 4, default=0.0),
                Field("active", BOOL, 5, default=True),
            ),
            user=True,
        ),
    )
)


def accounts(spark, folder) -> Store:
    """Customers as user accounts; the secret is their segment and number."""
    customer = open_warehouse(spark, folder).scan("Customer")
    secret = F.concat_ws("/", "c_mktsegment", "c_custkey")
    table = customer.select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        hash_secret(secret, F.lit("pepper")).alias("password"),
        F.col("c_acctbal").alias("balance"),
        (F.col("c_acctbal") >= 0).alias("active"),
    )
    return Store(spark, ACCOUNTS, {"Account": table})


@query("SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, c_acctbal >= 0 AS active FROM customer")
def hide_secret(spark, folder):
    return list_(accounts(spark, folder), "Account").records


# -- population ------------------------------------------------------------------


@query(
    """
    SELECT o_orderkey, c_custkey, c_name, n_name FROM orders
    JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
    """
)
def populate_ref(spark, folder):
    found = list_(
        open_warehouse(spark, folder), "Order", select=[{"customer": ["c_name", {"nation": ["n_name"]}]}]
    )
    return found.records.select("o_orderkey", "customer.c_custkey", "customer.c_name", "customer.nation.n_name")


@query(
    """
    SELECT d.doc_id, d.lang, l.doc_id AS label_id, CAST(l.quality AS BIGINT) AS quality
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
    """
)
def populate_optional(spark, folder):
    found = list_(open_warehouse(spark, folder), "Document", select=["lang", {"label": ["quality"]}]).records
    return found.select("doc_id", "lang", F.col("label.doc_id").alias("label_id"), "label.quality")


@query("SELECT l_orderkey AS o_orderkey, p_partkey, p_name FROM lineitem JOIN part ON p_partkey = l_partkey")
def populate_many(spark, folder):
    found = list_(open_warehouse(spark, folder), "Order", select=[{"parts": ["p_name"]}])
    return found.lists["parts"].records.withColumnRenamed("_source", "o_orderkey")


@query(
    """
    SELECT o_orderkey, count(l_partkey) AS n_parts,
           coalesce(string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_partkey), '') AS parts
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey
    """
)
def populate_many_nested(spark, folder):
    """The same lists packed as arrays; orders without parts have ``[]``."""
    found = list_(open_warehouse(spark, folder), "Order", select=[{"parts": []}]).nested()
    return found.select(
        "o_orderkey",
        F.size("parts").cast("bigint").alias("n_parts"),
        F.array_join(F.col("parts.p_partkey").cast("array<string>"), ",").alias("parts"),
    )


@query("SELECT l_orderkey AS o_orderkey, l_returnflag AS value FROM lineitem")
def populate_prim(spark, folder):
    found = list_(open_warehouse(spark, folder), "Order", select=[{"flags": True}])
    return found.lists["flags"].records.withColumnRenamed("_source", "o_orderkey")


@query("SELECT conv_id, string_agg(text, '|' ORDER BY text) AS texts FROM conversations GROUP BY conv_id")
def populate_messages(spark, folder):
    """Whole texts of every conversation, as one array each."""
    found = list_(open_warehouse(spark, folder), "Conversation", select=[{"messages": True}]).nested()
    return found.select("conv_id", F.array_join("messages", "|").alias("texts"))


@query(
    """
    SELECT r_name, n_nationkey::BIGINT AS n_nationkey, c_custkey, o_orderkey
    FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey
    JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 250000
    """
)
def populate_deep(spark, folder):
    orders = {"select": [], "filter": [{"o_totalprice": {"gt": 250000}}]}
    found = list_(
        open_warehouse(spark, folder),
        "Region",
        select=["r_name", {"nations": [{"customers": [{"orders": orders}]}]}],
    )
    nations = found.lists["nations"]
    customers = nations.lists["customers"]
    rows = customers.lists["orders"].records.withColumnRenamed("_source", "c_custkey")
    rows = rows.join(customers.records.withColumnRenamed("_source", "n_nationkey"), "c_custkey")
    rows = rows.join(nations.records.withColumnRenamed("_source", "r_regionkey"), "n_nationkey")
    return rows.join(found.records, "r_regionkey").select("r_name", "n_nationkey", "c_custkey", "o_orderkey")


# -- order and ranges --------------------------------------------------------------


@query(
    """
    SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal ASC NULLS LAST, c_custkey LIMIT 50
    """
)
def order_asc(spark, folder):
    store = open_warehouse(spark, folder)
    return list_(store, "Customer", order_by=("c_acctbal", "ASCENDING"), to=50, select=["c_acctbal"]).records


@query(
    """
    SELECT d.doc_id, l.doc_id AS label FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
    ORDER BY l.doc_id DESC NULLS FIRST, d.doc_id LIMIT 700
    """
)
def order_desc(spark, folder):
    """Nulls come first when descending."""
    store = open_warehouse(spark, folder)
    return list_(store, "Document", order_by=("label", "DESCENDING"), to=700, select=["label"]).records


@query("SELECT p_partkey, p_name FROM part")
def shuffle_all(spark, folder):
    store = open_warehouse(spark, folder)
    return list_(store, "Part", order_by=(None, "SHUFFLED"), select=["p_name"]).records


@query(
    """
    SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O'
    ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey LIMIT 100 OFFSET 20
    """
)
def range_page(spark, folder):
    found = list_(
        open_warehouse(spark, folder),
        "Order",
        filter=[{"o_orderstatus": {"eq": "O"}}],
        order_by=("o_totalprice", "DESCENDING"),
        from_=21,
        to=100,
        select=["o_totalprice"],
    )
    return found.records


@query(
    """
    SELECT o_orderkey, o_totalprice FROM orders
    ORDER BY o_totalprice ASC NULLS LAST, o_orderkey OFFSET 1000
    """
)
def range_open(spark, folder):
    """No upper end: positions come from a distributed numbering, not a global limit."""
    store = open_warehouse(spark, folder)
    return list_(store, "Order", order_by="o_totalprice", from_=1001, select=["o_totalprice"]).records


_RANKED_ORDERS = """
    SELECT c_custkey, o_orderkey, o_totalprice, pos AS _pos FROM (
      SELECT o_custkey AS c_custkey, o_orderkey, o_totalprice,
             row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey) AS pos
      FROM orders)
"""


@query(_RANKED_ORDERS)
def nested_order(spark, folder):
    orders = {"select": ["o_totalprice"], "order_by": ("o_totalprice", "DESCENDING")}
    found = list_(open_warehouse(spark, folder), "Customer", select=[{"orders": orders}])
    return found.lists["orders"].records.withColumnRenamed("_source", "c_custkey")


@query(_RANKED_ORDERS + "WHERE pos BETWEEN 2 AND 4")
def nested_range(spark, folder):
    orders = {"select": ["o_totalprice"], "order_by": ("o_totalprice", "DESCENDING"), "from_": 2, "to": 3}
    found = list_(open_warehouse(spark, folder), "Customer", select=[{"orders": orders}])
    return found.lists["orders"].records.withColumnRenamed("_source", "c_custkey")


@query(
    """
    SELECT l_orderkey AS o_orderkey, l_returnflag AS value,
           row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag DESC) AS _pos FROM lineitem
    """
)
def nested_prim_order(spark, folder):
    found = list_(open_warehouse(spark, folder), "Order", select=[{"flags": {"order_by": "DESCENDING"}}])
    return found.lists["flags"].records.withColumnRenamed("_source", "o_orderkey")


@query(
    """
    SELECT o_custkey AS c_custkey, count(*) AS n, count(DISTINCT o_orderkey) AS n_keys FROM (
      SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey) AS r FROM orders)
    WHERE r <= 2 GROUP BY o_custkey
    """
)
def nested_shuffled(spark, folder):
    """Two orders per customer drawn at random; only the counts can be compared."""
    orders = {"select": [], "order_by": (None, "SHUFFLED"), "to": 2}
    found = list_(open_warehouse(spark, folder), "Customer", select=[{"orders": orders}])
    drawn = found.lists["orders"].records.groupBy(F.col("_source").alias("c_custkey"))
    return drawn.agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("n_keys"))


# -- aggregates --------------------------------------------------------------------


@query("SELECT max(o_orderkey) + 1 AS next_key FROM orders", name="next_key")
def next_order_key(spark, folder):
    return next_key(open_warehouse(spark, folder).scan("Order", ["o_orderkey"]), "o_orderkey")


@query(
    """
    SELECT * FROM (VALUES ('Region', EXISTS (SELECT 1 FROM region)), ('Nation', EXISTS (SELECT 1 FROM nation)),
      ('Customer', EXISTS (SELECT 1 FROM customer)), ('Supplier', EXISTS (SELECT 1 FROM supplier)),
      ('Part', EXISTS (SELECT 1 FROM part)), ('Order', EXISTS (SELECT 1 FROM orders)),
      ('Event', EXISTS (SELECT 1 FROM events)), ('Label', EXISTS (SELECT 1 FROM labels)),
      ('Document', EXISTS (SELECT 1 FROM documents)), ('Conversation', EXISTS (SELECT 1 FROM conversations))
    ) t(model, has_data)
    """
)
def has_data(spark, folder):
    return exists_data(open_warehouse(spark, folder))


# -- JSON and files ------------------------------------------------------------------


@query(
    """
    SELECT '{"o_orderkey":' || o_orderkey || ',"state":"' || o_orderstatus || '","day":"'
        || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f') || '"}' AS json FROM orders
    """
)
def response_json(spark, folder):
    found = list_(open_warehouse(spark, folder), "Order", select=["o_orderstatus", "o_orderdate"]).records
    return to_response(found, {"o_orderstatus": "state", "o_orderdate": "day"})


@query(
    """
    SELECT event_id, user_id AS "user", event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
           CASE WHEN event_type = 'error' THEN 3 ELSE 4 END::BIGINT AS n_present,
           event_type <> 'error' AS has_props
    FROM events
    """
)
def ingest_json(spark, folder):
    """JSON records made from the events; errors leave out ``props``."""
    events = open_warehouse(spark, folder).scan("Event")
    props = F.when(F.col("event_type") != "error", F.col("props"))
    record = F.struct("event_id", F.struct(F.col("user").alias("c_custkey")).alias("user"), "event_type", props.alias("props"))
    raw = events.select(F.to_json(record).alias("value"), F.col("props").alias("p"))
    from_text = read_records(spark, raw, open_warehouse(spark, folder).catalog, "Event")
    back = from_text.select(
        "event_id",
        F.col("user.c_custkey").alias("user"),
        "event_type",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        F.size("_present").cast("bigint").alias("n_present"),
        F.array_contains("_present", "props").alias("has_props"),
    )
    # `k` of the left-out ones is read from the event itself.
    keys = events.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("own"))
    return back.join(keys, "event_id").withColumn("k", F.coalesce("k", "own")).drop("own")


@query(
    """
    SELECT 'Customer' AS name, count(*) AS n, max(c_custkey) AS last FROM customer
    UNION ALL SELECT 'Customer.orders', count(*), max(o_orderkey) FROM orders
    UNION ALL SELECT 'Order', count(*), max(o_orderkey) FROM orders
    UNION ALL SELECT 'versions', 1, 1
    """
)
def write_read_back(spark, folder):
    """Publish the store as a version of parquet tables, open it and look."""
    path = scratch_path(spark, "warehouse")
    open_warehouse(spark, folder).publish(path)
    store = Store.open(spark, path)

    def summary(name, df, key):
        return df.agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.max(key).alias("last"))

    parts = [
        summary("Customer", store.scan("Customer", ["c_custkey"]), "c_custkey"),
        summary("Customer.orders", store.links("Customer", "orders"), "target"),
        summary("Order", store.scan("Order", ["o_orderkey"]), "o_orderkey"),
        summary("versions", Store.versions(spark, path), "version"),
    ]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])
