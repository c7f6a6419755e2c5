"""Queries over records of any depth, competing writers, and what only an order or a refusal shows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fieldstone.catalog import DATE, FLOAT, INT, STRING, ArrayOf, Catalog, Field, Model, Ref
from fieldstone.operators.access import Rule, authorize, rules_frame
from fieldstone.operators.evolve import EvolutionError, add_field, evolve
from fieldstone.operators.mutate import create, create_many, remove_from
from fieldstone.operators.quality import check_json
from fieldstone.operators.query import list_
from fieldstone.plans.registry import query
from fieldstone.plans.writes import _kinds
from fieldstone.session import scratch_path
from fieldstone.sources.json_records import read_records, record_violations
from fieldstone.sources.store import Store, VersionConflict
from fieldstone.sources.warehouse import open_warehouse

# -- JSON records of any depth ---------------------------------------------------

CLIENTS = Catalog(
    (
        Model("Client", 1, (Field("id", INT, 1, primary=True), Field("name", STRING, 2), Field("town", Ref("Town"), 3),
                            Field("bills", ArrayOf(Ref("Bill")), 4))),
        Model("Town", 2, (Field("id", INT, 1, primary=True), Field("land", Ref("Land"), 2))),
        Model("Land", 3, (Field("id", INT, 1, primary=True), Field("title", STRING, 2, optional=True),
                          Field("towns", ArrayOf(Ref("Town")), 3, default=()))),
        Model("Bill", 4, (Field("id", INT, 1, primary=True), Field("amount", FLOAT, 2), Field("lines", ArrayOf(Ref("Line")), 3))),
        Model("Line", 5, (Field("id", INT, 1, primary=True), Field("flag", STRING, 2))),
    )
)


def _clients(spark, folder):
    """Every customer with a town in a land, its orders and their lines (one for each number), as one JSON text."""
    read = lambda name: spark.read.parquet(f"{folder}/{name}.parquet")
    line = F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("flag"))
    numbered = read("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("flag"))
    lines = numbered.groupBy("l_orderkey").agg(F.collect_list(line).alias("lines"))
    orders = read("orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    none = F.array().cast(lines.schema["lines"].dataType)
    bill = F.struct(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"), F.coalesce("lines", none).alias("lines"))
    bills = orders.groupBy("o_custkey").agg(F.collect_list(bill).alias("bills"))
    land = F.struct((F.col("c_custkey") * 2).alias("id"), F.col("c_mktsegment").alias("title"))
    town = F.struct((F.col("c_custkey") + 1).alias("id"), land.alias("land"))
    record = F.struct(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), town.alias("town"),
        F.coalesce("bills", F.array().cast(bills.schema["bills"].dataType)).alias("bills"),
    )
    customers = read("customer").join(bills, F.col("c_custkey") == F.col("o_custkey"), "left")
    return customers.select(F.to_json(record).alias("value"), "c_custkey", "c_mktsegment")


@query(
    """
    SELECT 'client' AS kind, c_custkey::BIGINT AS key, (c_custkey + 1)::VARCHAR AS ref FROM customer
    UNION ALL SELECT 'town', c_custkey + 1, (c_custkey * 2)::VARCHAR FROM customer
    UNION ALL SELECT 'land', c_custkey * 2, c_mktsegment FROM customer
    UNION ALL SELECT 'client_bill', o_custkey, o_orderkey::VARCHAR FROM orders
    UNION ALL SELECT 'bill', o_orderkey, round(o_totalprice)::BIGINT::VARCHAR FROM orders
    UNION ALL SELECT DISTINCT 'bill_line', l_orderkey, (l_orderkey * 10 + l_linenumber)::VARCHAR FROM lineitem
    UNION ALL SELECT 'line', l_orderkey * 10 + l_linenumber, min(l_returnflag) FROM lineitem GROUP BY l_orderkey, l_linenumber
    """
)
def ingest_deep(spark, folder):
    """Records nested four models deep, arrays in arrays, become rows of every model."""
    records = read_records(spark, _clients(spark, folder).select("value"), CLIENTS, "Client")
    store = Store(spark, CLIENTS)
    store = store.apply(create_many(store, "Client", records))
    text = lambda df: df.select(F.col(df.columns[0]).cast("bigint"), F.col(df.columns[1]).cast("string"))
    return _kinds(
        client=text(store.scan("Client", ["id", "town"])),
        town=text(store.scan("Town", ["id", "land"])),
        land=text(store.scan("Land", ["id", "title"])),
        client_bill=text(store.links("Client", "bills")),
        bill=text(store.scan("Bill").select("id", F.round("amount").cast("bigint"))),
        bill_line=text(store.links("Bill", "lines")),
        line=text(store.scan("Line", ["id", "flag"])),
    )


def _broken(spark, folder):
    """The same records, each segment of customers broken in its own way."""
    rows = _clients(spark, folder)
    segment = F.col("c_mktsegment")
    value = F.col("value")
    broken = (
        F.when(segment == "BUILDING", F.regexp_replace(value, r'"land":\{"id":(\d+)', r'"land":{"id":"L$1"'))
        .when(segment == "MACHINERY", F.regexp_replace(value, r'"title":"MACHINERY"', '"title":"MACHINERY","zone":1'))
        .when(segment == "HOUSEHOLD", F.concat(F.lit("<"), value))
        .when(segment == "FURNITURE", F.regexp_replace(value, r'"flag":"R"', '"flag":7'))
        .otherwise(value)
    )
    return rows.select(broken.alias("value"))


_BROKEN_SQL = """
    SELECT 'Client' AS model, 'town.land.id' AS field, c_custkey::VARCHAR AS key, 'type' AS rule, 'L' || (c_custkey * 2) AS value
    FROM customer WHERE c_mktsegment = 'BUILDING'
    UNION ALL SELECT 'Client', 'town.land.zone', c_custkey::VARCHAR, 'unknown_field', NULL FROM customer WHERE c_mktsegment = 'MACHINERY'
    UNION ALL SELECT 'Client', 'bills.lines.flag', o_custkey::VARCHAR, 'type', '7'
    FROM (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS flag FROM lineitem GROUP BY 1, 2)
    JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey
    WHERE c_mktsegment = 'FURNITURE' AND flag = 'R'
"""


@query(_BROKEN_SQL + "UNION ALL SELECT 'Client', NULL, NULL, 'json', NULL FROM customer WHERE c_mktsegment = 'HOUSEHOLD'")
def ingest_bad(spark, folder):
    """What keeps records from being read; the reader itself refuses them."""
    bad = record_violations(_broken(spark, folder), CLIENTS, "Client")
    return bad.withColumn("value", F.when(F.col("rule") != "json", F.col("value")))


@query(
    _BROKEN_SQL
    + """
    UNION ALL SELECT 'Client', 'town.land.towns', c_custkey::VARCHAR, 'missing_field', NULL FROM customer WHERE c_mktsegment <> 'HOUSEHOLD'
    UNION ALL SELECT 'Client', NULL, NULL, 'json', NULL FROM customer WHERE c_mktsegment = 'HOUSEHOLD'
    """
)
def dq_json_nested(spark, folder):
    """Wrong types, missing and unknown fields inside references and arrays of arrays."""
    found = check_json(_broken(spark, folder), CLIENTS, "Client")
    return found.withColumn("value", F.when(F.col("rule") != "json", F.col("value")))


# -- writers, refusals, removals ---------------------------------------------------

NAMES = Catalog((Model("Name", 1, (Field("id", INT, 1, primary=True), Field("name", STRING, 2),
                                   Field("tags", ArrayOf(STRING), 3), Field("note", STRING, 4, optional=True))),))


def _names(spark, folder) -> Store:
    customer = open_warehouse(spark, folder).scan("Customer", ["c_custkey", "c_name", "c_mktsegment"])
    table = customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("note"))
    tags = customer.select(F.col("c_custkey").alias("source"), F.col("c_mktsegment").alias("target"))
    return Store(spark, NAMES, {"Name": table}, {("Name", "tags"): tags})


@query(
    """
    SELECT c_custkey::BIGINT AS id, c_name AS name, true AS refused FROM customer UNION ALL SELECT -1, 'first', true
    """
)
def group_conflict(spark, folder):
    """Of two writers that start from one version the second is refused, and the first one's record stays."""
    path = scratch_path(spark, "names")
    _names(spark, folder).publish(path)
    one, two = Store.open(spark, path), Store.open(spark, path)
    one.apply(create(one, "Name", {"id": -1, "name": "first"})).publish()
    refused = False
    try:
        two.apply(create(two, "Name", {"id": -2, "name": "second"})).publish()
    except VersionConflict:
        refused = True
    return Store.open(spark, path).scan("Name", ["id", "name"]).withColumn("refused", F.lit(refused))


@query(
    """
    SELECT t.name AS "table", t.kept, n.n FROM (SELECT count(*) AS n FROM customer) n,
           (VALUES ('Name', true), ('Name.tags', true), ('Name.codes', false)) t(name, kept)
    """
)
def evo_locations(spark, folder):
    """A dropped column and a new array leave the stored table and links where they are."""
    store = _names(spark, folder).publish(scratch_path(spark, "names"))
    model = store.catalog.model("Name").without_field("note").with_field(Field("codes", ArrayOf(INT), 5))
    after = evolve(store, store.catalog, store.catalog.with_model(model)).publish()
    rows = [(name, store.locations.get(name) == place) for name, place in after.locations.items()]
    kept = spark.createDataFrame(rows, "`table` string, kept boolean")
    return kept.withColumn("n", F.lit(after.scan("Name", ["id"]).count()))


@query("SELECT count(*) AS n, true AS refused FROM customer")
def evo_guard(spark, folder):
    """A required field without a default is refused while there are records, which stay."""
    store = _names(spark, folder)
    refused = False
    try:
        add_field(store, "Name", Field("age", INT, 9))
    except EvolutionError:
        refused = True
    return store.scan("Name", ["id"]).agg(F.count("*").alias("n")).withColumn("refused", F.lit(refused))


@query(
    """
    SELECT l_orderkey AS source, l_partkey AS target FROM lineitem
    WHERE l_orderkey <> 7 OR l_partkey <> (SELECT min(l_partkey) FROM lineitem WHERE l_orderkey = 7)
    """
)
def remove_one(spark, folder):
    """One part leaves one order."""
    store = open_warehouse(spark, folder)
    least = store.links("Order", "parts").where("source = 7").agg(F.min("target").alias("t")).first()["t"]
    return store.apply(remove_from(store, "Order", "parts", 7, least)).links("Order", "parts")


# -- rules, dates, order -------------------------------------------------------------


@query(
    """
    SELECT (l_orderkey * 10 + l_linenumber) * 2 AS op_id, p_retailprice < 1500 AS allowed FROM lineitem JOIN part ON p_partkey = l_partkey
    UNION ALL SELECT (l_orderkey * 10 + l_linenumber) * 2 + 1, l_partkey % 2 = 0 FROM lineitem
    """
)
def acl_predicate_push(spark, folder):
    """A rule about pushing looks at the pushed part, one about removing at its key."""
    store = open_warehouse(spark, folder)
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").withColumn("n", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    parts = store.scan("Part", ["p_partkey", "p_retailprice"])
    common = [F.lit("Customer").alias("role"), F.lit("1").alias("user_id"), F.lit("Order").alias("model"),
              F.col("l_orderkey").cast("string").alias("target_id"), F.lit("parts").alias("field")]
    pushed = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        (F.col("n") * 2).alias("op_id"), *common, F.lit("PUSH_TO").alias("event"),
        F.to_json(F.struct("p_partkey", "p_retailprice")).alias("arg"),
    )
    removed = lines.select(
        (F.col("n") * 2 + 1).alias("op_id"), *common, F.lit("REMOVE_FROM").alias("event"), F.col("l_partkey").cast("string").alias("arg")
    )
    rules = [
        Rule("allow", ("PUSH_TO",), "Order", "parts", role="Customer", predicate="cheap"),
        Rule("allow", ("REMOVE_FROM",), "Order", "parts", role="Customer", predicate="even"),
    ]
    predicates = {
        "cheap": lambda user, item: item["p_retailprice"] < 1500,
        "even": lambda user, item: item["p_partkey"] % 2 == 0,
    }
    log = pushed.unionByName(removed)
    return authorize(log, rules_frame(spark, rules), store.catalog, store, predicates).select("op_id", "allowed")


DAYS = Catalog((Model("Day", 1, (Field("id", INT, 1, primary=True), Field("day", DATE, 2, optional=True))),))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus <> 'P'")
def date_not(spark, folder):
    """No day equals a time of day; what has no date is neither equal nor unequal."""
    orders = open_warehouse(spark, folder).scan("Order", ["o_orderkey", "o_orderdate", "o_orderstatus"])
    day = F.when(F.col("o_orderstatus") != "P", F.to_date("o_orderdate"))
    store = Store(spark, DAYS, {"Day": orders.select(F.col("o_orderkey").alias("id"), day.alias("day"))})
    tree = {"predicate": {"day": {"eq": "1997-05-28T12:00:00Z"}}, "negated": True}
    return list_(store, "Day", [tree], select=["id"]).records


def _placed(records):
    """Rows with their place in the order they come in."""
    numbered = records.withColumn("m", F.monotonically_increasing_id())
    return numbered.withColumn("place", F.row_number().over(Window.orderBy("m"))).drop("m")  # a page of few rows


@query(
    """
    SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_acctbal, c_custkey)::INTEGER AS place FROM customer
    QUALIFY place <= 50
    """
)
def order_places_asc(spark, folder):
    store = open_warehouse(spark, folder)
    return _placed(list_(store, "Customer", order_by=("c_acctbal", "ASCENDING"), to=50, select=["c_acctbal"]).records)


@query(
    """
    SELECT d.doc_id, l.doc_id AS label, row_number() OVER (ORDER BY l.doc_id DESC NULLS FIRST, d.doc_id)::INTEGER AS place
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id QUALIFY place <= 700
    """
)
def order_places_desc(spark, folder):
    store = open_warehouse(spark, folder)
    return _placed(list_(store, "Document", order_by=("label", "DESCENDING"), to=700, select=["label"]).records)


@query(
    """
    SELECT o_orderkey, (o_totalprice >= max(o_totalprice) OVER (ORDER BY o_totalprice, o_orderkey)) AS ascends FROM orders
    ORDER BY o_totalprice, o_orderkey OFFSET 1000
    """
)
def range_open_order(spark, folder):
    """An open page comes in order: every row is at least as dear as all before it in its partition."""
    store = open_warehouse(spark, folder)
    rows = list_(store, "Order", order_by="o_totalprice", from_=1001, select=["o_totalprice"]).records
    part, at = F.spark_partition_id(), F.monotonically_increasing_id()
    rows = rows.withColumns({"p": part, "m": at})
    before = Window.partitionBy("p").orderBy("m").rowsBetween(Window.unboundedPreceding, -1)
    ascends = F.col("o_totalprice") >= F.coalesce(F.max("o_totalprice").over(before), F.col("o_totalprice"))
    return rows.select("o_orderkey", ascends.alias("ascends"))
