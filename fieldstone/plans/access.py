"""Access decisions over operation logs made from the events and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldstone.operators.access import (
    Rule,
    authorize,
    expand_rules,
    rule_errors,
    rules_frame,
    secure_view,
    verify_credentials,
)
from fieldstone.plans.reads import accounts
from fieldstone.plans.registry import query
from fieldstone.sources.warehouse import open_warehouse

# -- an operation log ------------------------------------------------------------

_EVENTS = {"click": "READ", "view": "LIST", "purchase": "CREATE", "signup": "UPDATE", "error": "DELETE"}

_RULES = (
    Rule("allow", ("READ", "CREATE"), "Customer"),
    Rule("deny", ("READ",), "Customer", "orders"),
    Rule("deny", ("SET_ON_CREATE",), "Customer", "c_acctbal"),
    Rule("allow", ("READ", "UPDATE"), "Customer", role="Customer", is_self=True),
    Rule("deny", ("UPDATE",), "Customer", "c_acctbal", role="Customer", is_self=True),
    Rule("deny", ("READ",), "Customer", "c_name", role="Customer", is_self=True),
    Rule("allow", ("DELETE",), "Customer", role="Customer"),
    Rule("allow", ("ALL",), "Customer", role="Supplier"),
    Rule("deny", ("READ",), "Customer", "c_name", role="Supplier"),
    Rule("deny", ("DELETE",), "Customer", role="Supplier"),
)


def _log(spark, folder):
    """One operation on a customer per event; the role follows the customer's segment."""
    store = open_warehouse(spark, folder)
    segment = F.col("c_mktsegment")
    role = (
        F.when(segment == "BUILDING", F.lit("Customer"))
        .when(segment == "FURNITURE", F.lit("Supplier"))
        .when(segment == "HOUSEHOLD", F.lit("__root__"))
        .when(segment == "AUTOMOBILE", F.lit("Ghost"))
    )
    event = F.create_map(*[F.lit(x) for pair in _EVENTS.items() for x in pair])[F.col("event_type")]
    target = F.when(F.col("value") < 20, F.col("user")).otherwise(F.col("user") + 1)
    sets = F.when(event.isin("CREATE", "UPDATE"), F.array(F.lit("c_acctbal"), F.lit("c_name")))
    events = store.scan("Event", ["event_id", "user", "event_type", "value"])
    people = store.scan("Customer", ["c_custkey", "c_mktsegment"])
    return events.join(people, F.col("user") == F.col("c_custkey")).select(
        F.col("event_id").alias("op_id"),
        role.alias("role"),
        F.col("user").cast("string").alias("user_id"),
        event.alias("event"),
        F.lit("Customer").alias("model"),
        F.when(event.isin("READ", "UPDATE", "DELETE"), target).cast("string").alias("target_id"),
        sets.alias("set_fields"),
        F.array(F.lit("c_name"), F.lit("orders")).alias("selected_fields"),
    )


def _decisions(spark, folder):
    catalog = open_warehouse(spark, folder).catalog
    return authorize(_log(spark, folder), rules_frame(spark, _RULES), catalog)


# The same log and rules in SQL: needs are matched with rules by a join.
_LOG_SQL = """
WITH log AS (
  SELECT event_id AS op_id,
         CASE c_mktsegment WHEN 'BUILDING' THEN 'Customer' WHEN 'FURNITURE' THEN 'Supplier'
           WHEN 'HOUSEHOLD' THEN '__root__' WHEN 'AUTOMOBILE' THEN 'Ghost' ELSE '' END AS role,
         CASE event_type WHEN 'click' THEN 'READ' WHEN 'view' THEN 'LIST' WHEN 'purchase' THEN 'CREATE'
           WHEN 'signup' THEN 'UPDATE' ELSE 'DELETE' END AS event,
         c_mktsegment = 'BUILDING' AND value < 20 AND event_type IN ('click', 'signup', 'error') AS own
  FROM events JOIN customer ON c_custkey = user_id),
sets(name) AS (VALUES ('c_acctbal'), ('c_name')),
picks(name) AS (VALUES ('c_name'), ('orders')),
needs AS (
  SELECT op_id, role, event, own, '' AS unit, '' AS field, 'READ' AS perm, true AS plain, own AS self
    FROM log WHERE event IN ('READ', 'LIST')
  UNION ALL SELECT op_id, role, event, own, '', '', event, true, own FROM log WHERE event IN ('CREATE', 'UPDATE')
  UNION ALL SELECT op_id, role, event, own, '', name, 'SET_ON_CREATE', true, false FROM log, sets WHERE event = 'CREATE'
  UNION ALL SELECT op_id, role, event, own, '', name, 'UPDATE', true, own FROM log, sets WHERE event = 'UPDATE'
  UNION ALL SELECT op_id, role, event, own, '', '', 'DELETE', NOT own, own FROM log WHERE event = 'DELETE'
  UNION ALL SELECT op_id, role, event, own, name, f, p, true, own FROM log, picks,
    LATERAL (SELECT '' AS f UNION ALL SELECT name) fs,
    LATERAL (SELECT 'READ' AS p UNION ALL SELECT 'READ_ON_CREATE' WHERE event = 'CREATE') ps),
rules(role, field, perm, kind, self) AS (VALUES
  ('', '', 'READ', 'allow', false), ('', '', 'CREATE', 'allow', false), ('', 'orders', 'READ', 'deny', false),
  ('', 'c_acctbal', 'SET_ON_CREATE', 'deny', false),
  ('Customer', '', 'READ', 'allow', true), ('Customer', '', 'UPDATE', 'allow', true),
  ('Customer', 'c_acctbal', 'UPDATE', 'deny', true), ('Customer', 'c_name', 'READ', 'deny', true),
  ('Customer', '', 'DELETE', 'allow', false),
  ('Supplier', '', 'READ', 'allow', false), ('Supplier', '', 'UPDATE', 'allow', false),
  ('Supplier', '', 'CREATE', 'allow', false), ('Supplier', '', 'DELETE', 'allow', false),
  ('Supplier', '', 'READ_ON_CREATE', 'allow', false), ('Supplier', '', 'LOGIN', 'allow', false),
  ('Supplier', 'c_name', 'READ', 'deny', false), ('Supplier', '', 'DELETE', 'deny', false)),
hits AS (
  SELECT n.*, r.kind, r.field AS place FROM needs n JOIN rules r
    ON r.role = n.role AND r.field = n.field AND r.perm = n.perm
   AND ((n.plain AND NOT r.self) OR (n.self AND r.self))),
units AS (SELECT DISTINCT op_id, role, event, unit FROM needs),
errors AS (
  SELECT op_id, unit, 'no_allow' AS cause, CASE WHEN unit = '' THEN NULL ELSE unit END AS field FROM units u
   WHERE role NOT IN ('__root__', 'Ghost') AND NOT (unit <> '' AND event = 'CREATE')
     AND NOT EXISTS (SELECT 1 FROM hits h WHERE h.op_id = u.op_id AND h.unit = u.unit AND h.kind = 'allow')
  UNION ALL
  SELECT DISTINCT op_id, unit,
    CASE WHEN unit = 'orders' THEN 'event_denied' WHEN unit <> '' AND place <> '' THEN 'field_read'
         WHEN unit <> '' THEN 'event_denied' WHEN event = 'CREATE' AND place <> '' THEN 'field_set'
         WHEN event = 'UPDATE' AND place <> '' THEN 'field_update' WHEN event = 'UPDATE' THEN 'model_update'
         ELSE 'event_denied' END,
    CASE WHEN unit <> '' THEN unit WHEN place <> '' THEN place END
  FROM hits WHERE kind = 'deny'
  UNION ALL SELECT op_id, '', 'unknown_role', NULL FROM log WHERE role = 'Ghost')
"""


@query(_LOG_SQL + "SELECT op_id, op_id NOT IN (SELECT op_id FROM errors) AS allowed FROM log")
def acl_decide(spark, folder):
    return _decisions(spark, folder).select("op_id", "allowed")


@query(_LOG_SQL + "SELECT op_id, cause, field FROM errors")
def acl_causes(spark, folder):
    errors = _decisions(spark, folder).select("op_id", F.explode("errors").alias("e"))
    return errors.select("op_id", "e.cause", "e.field")


@query(_LOG_SQL + "SELECT op_id, field, count(*) AS n FROM errors WHERE unit <> '' GROUP BY op_id, field")
def acl_fields(spark, folder):
    """Read rules of each selected field."""
    errors = _decisions(spark, folder).select("op_id", F.explode("errors").alias("e"))
    reads = errors.where(F.col("e.field").isin("c_name", "orders") & ~F.col("e.cause").isin("field_set", "field_update"))
    return reads.groupBy("op_id", "e.field").agg(F.count("*").alias("n"))


@query(
    _LOG_SQL
    + "SELECT op_id, own, op_id NOT IN (SELECT op_id FROM errors) AS allowed FROM log WHERE role = 'Customer' AND event = 'DELETE'"
)
def acl_self(spark, folder):
    """Deleting oneself looks at self rules only: allowed for others, refused for self."""
    log = _log(spark, folder).where("role = 'Customer' AND event = 'DELETE'")
    catalog = open_warehouse(spark, folder).catalog
    log = log.withColumn("own", F.col("user_id") == F.col("target_id"))
    decided = authorize(log, rules_frame(spark, _RULES), catalog).select("op_id", "allowed")
    return log.select("op_id", "own").join(decided, "op_id")


@query(
    """
    SELECT event_id AS op_id, CASE event_type WHEN 'purchase' THEN 'CREATE' ELSE 'LOGIN' END AS event,
           true AS allowed, 0::BIGINT AS n
    FROM events WHERE event_type IN ('purchase', 'signup')
    UNION ALL
    SELECT event_id, 'READ', false, 3 FROM events WHERE event_type = 'click'
    """
)
def acl_defaults(spark, folder):
    """LOGIN, READ_ON_CREATE and SET_ON_CREATE hold by default; everything else is denied."""
    store = open_warehouse(spark, folder)
    event = (
        F.when(F.col("event_type") == "purchase", F.lit("CREATE"))
        .when(F.col("event_type") == "signup", F.lit("LOGIN"))
        .otherwise(F.lit("READ"))
    )
    fields = F.array(F.lit("c_name"), F.lit("orders"))
    log = store.scan("Event").where("event_type IN ('purchase', 'signup', 'click')").select(
        F.col("event_id").alias("op_id"),
        event.alias("event"),
        F.lit("Customer").alias("model"),
        F.when(event == "CREATE", fields).alias("set_fields"),
        F.when(event != "LOGIN", fields).alias("selected_fields"),
    )
    rules = rules_frame(spark, [Rule("allow", ("CREATE",), "Customer")])
    decided = authorize(log, rules, store.catalog)
    return log.select("op_id", "event").join(
        decided.select("op_id", "allowed", F.size("errors").cast("bigint").alias("n")), "op_id"
    )


@query(
    """
    SELECT o_orderkey AS op_id, o_orderstatus = 'F' OR (o_orderstatus = 'O' AND o_orderpriority <> '1-URGENT') AS allowed
    FROM orders
    """
)
def acl_push(spark, folder):
    """Pushing a new record also needs CREATE on the child's model."""
    store = open_warehouse(spark, folder)
    role = F.when(F.col("o_orderstatus") == "F", "Customer").when(F.col("o_orderstatus") == "O", "Supplier")
    log = store.scan("Order").select(
        F.col("o_orderkey").alias("op_id"),
        role.alias("role"),
        F.col("customer").cast("string").alias("user_id"),
        F.lit("PUSH_TO").alias("event"),
        F.lit("Order").alias("model"),
        F.col("o_orderkey").cast("string").alias("target_id"),
        F.lit("parts").alias("field"),
        (F.col("o_orderpriority") == "1-URGENT").alias("creates_child"),
    )
    rules = [
        Rule("allow", ("PUSH_TO",), "Order", "parts", role="Customer"),
        Rule("allow", ("CREATE",), "Part", role="Customer"),
        Rule("allow", ("MUTATE",), "Order", "parts", role="Supplier"),
        Rule("deny", ("CREATE",), "Part", role="Supplier"),
    ]
    return authorize(log, rules_frame(spark, rules), store.catalog).select("op_id", "allowed")


@query(
    """
    SELECT event_id * 2 AS op_id, o_custkey = user_id AND o_totalprice < 400000 AS allowed
    FROM events JOIN orders ON o_orderkey = event_id
    UNION ALL
    SELECT event_id * 2 + 1, value < 30 FROM events
    """
)
def acl_predicate(spark, folder):
    """Users read an order if it is their own and not too dear, and create events of little value."""
    store = open_warehouse(spark, folder)
    events = store.scan("Event")
    common = [F.lit("Customer").alias("role"), F.col("user").cast("string").alias("user_id")]
    orders = store.scan("Order", ["o_orderkey"])
    reads = events.join(orders, F.col("o_orderkey") == F.col("event_id")).select(
        (F.col("event_id") * 2).alias("op_id"),
        *common,
        F.lit("READ").alias("event"),
        F.lit("Order").alias("model"),
        F.col("o_orderkey").cast("string").alias("target_id"),
        F.lit(None).cast("string").alias("arg"),
    )
    creates = events.select(
        (F.col("event_id") * 2 + 1).alias("op_id"),
        *common,
        F.lit("CREATE").alias("event"),
        F.lit("Event").alias("model"),
        F.lit(None).cast("string").alias("target_id"),
        F.to_json(F.struct("event_id", "value")).alias("arg"),
    )
    rules = [
        Rule("allow", ("READ",), "Order", role="Customer", predicate="own_order"),
        Rule("deny", ("READ",), "Order", role="Customer", predicate="dear"),
        Rule("allow", ("CREATE",), "Event", role="Customer", predicate="small"),
    ]
    predicates = {
        "own_order": lambda user, target: user["c_custkey"] == target["customer"],
        "dear": lambda user, target: target["o_totalprice"] >= 400000,
        "small": lambda user, target: target["value"] < 30,
    }
    log = reads.unionByName(creates)
    return authorize(log, rules_frame(spark, rules), store.catalog, store, predicates).select("op_id", "allowed")


# -- rules in bulk -----------------------------------------------------------------


def _grants(spark, folder):
    """One rule per order: on orders as a whole, on their parts, their price or their customer."""
    field = (
        F.when(F.col("o_orderstatus") == "O", "parts")
        .when(F.col("o_orderstatus") == "P", F.when(F.col("o_totalprice") > 250000, "customer").otherwise("o_totalprice"))
    )
    return open_warehouse(spark, folder).scan("Order").select(
        F.col("o_orderkey").alias("rule_id"),
        F.lit("Customer").alias("role"),
        F.lit("Order").alias("model"),
        field.alias("field"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.array(F.lit("READ"), F.lit("PUSH_TO")))
        .otherwise(F.array(F.lit("ALL")))
        .alias("permissions"),
        F.when(F.col("o_totalprice") > 100000, "allow").otherwise("deny").alias("kind"),
        F.lit(False).alias("is_self"),
        F.lit(None).cast("string").alias("predicate_id"),
    )


_GRANTS_SQL = """
WITH g AS (SELECT o_orderkey AS rule_id, o_orderpriority = '5-LOW' AS named,
             CASE o_orderstatus WHEN 'F' THEN 'model' WHEN 'O' THEN 'array'
               ELSE CASE WHEN o_totalprice > 250000 THEN 'ref' ELSE 'prim' END END AS res FROM orders)
"""


@query(
    _GRANTS_SQL
    + """
    SELECT rule_id, permission FROM g JOIN (VALUES
      ('model', 'READ'), ('model', 'UPDATE'), ('model', 'CREATE'), ('model', 'DELETE'), ('model', 'READ_ON_CREATE'),
      ('model', 'LOGIN'), ('ref', 'READ'), ('ref', 'UPDATE'), ('ref', 'CREATE'), ('ref', 'DELETE'),
      ('ref', 'READ_ON_CREATE'), ('ref', 'LOGIN'), ('array', 'READ'), ('array', 'UPDATE'), ('array', 'SET_ON_CREATE'),
      ('array', 'READ_ON_CREATE'), ('array', 'PUSH_TO'), ('array', 'REMOVE_FROM'), ('array', 'MUTATE'),
      ('prim', 'READ'), ('prim', 'UPDATE'), ('prim', 'SET_ON_CREATE'), ('prim', 'READ_ON_CREATE')
    ) p(res, permission) ON p.res = g.res WHERE NOT named
    UNION ALL
    SELECT rule_id, permission FROM g, (VALUES ('READ'), ('PUSH_TO')) p(permission) WHERE named AND res = 'array'
    """
)
def acl_expand(spark, folder):
    """Grants with ``ALL`` spelled out; those that do not apply are left to ``acl_rule_errors``."""
    catalog = open_warehouse(spark, folder).catalog
    return expand_rules(_grants(spark, folder), catalog, check=False).select("rule_id", "permission")


@query(_GRANTS_SQL + "SELECT rule_id, 'inapplicable' AS reason FROM g WHERE named AND res <> 'array'")
def acl_rule_errors(spark, folder):
    catalog = open_warehouse(spark, folder).catalog
    return rule_errors(_grants(spark, folder), catalog).select("rule_id", "reason")


# -- views and credentials -----------------------------------------------------------


@query(
    """
    SELECT o_orderkey, o_custkey AS customer, o_orderstatus,
           CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END AS o_totalprice
    FROM orders WHERE o_custkey >= 7
    """,
    name="secure_view",
)
def secure_orders(spark, folder):
    """Orders as customer 7 sees them: rows by predicate, prices of finished ones hidden."""
    store = open_warehouse(spark, folder)
    rules = [
        Rule("allow", ("READ",), "Order", role="Customer", predicate="not_before"),
        Rule("deny", ("READ",), "Order", "o_totalprice", role="Customer", predicate="finished"),
        Rule("deny", ("READ",), "Order", "o_orderdate", role="Customer"),
        Rule("deny", ("READ",), "Order", "o_orderpriority", role="Customer"),
    ]
    predicates = {
        "not_before": lambda user, target: target["customer"] >= user["c_custkey"],
        "finished": lambda user, target: target["o_orderstatus"] == "F",
    }
    return secure_view(store, "Order", "Customer", 7, rules_frame(spark, rules), predicates)


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey = 7")
def secure_self(spark, folder):
    """Self rules show a user only the own record, without the denied fields."""
    store = open_warehouse(spark, folder)
    rules = [
        Rule("allow", ("READ",), "Customer", role="Customer", is_self=True),
        *[
            Rule("deny", ("READ",), "Customer", f, role="Customer")
            for f in ("nation", "c_acctbal", "c_mktsegment")
        ],
    ]
    return secure_view(store, "Customer", "Customer", 7, rules_frame(spark, rules))


@query(
    """
    SELECT event_id AS attempt_id, CASE WHEN event_type NOT IN ('error', 'view') THEN user_id END AS key,
           event_type NOT IN ('error', 'view') AS verified
    FROM events
    """
)
def verify_creds(spark, folder):
    """A login attempt per event: errors use a wrong secret, views an unknown name."""
    store = accounts(spark, folder)
    warehouse = open_warehouse(spark, folder)
    events, people = warehouse.scan("Event"), warehouse.scan("Customer")
    name = F.when(F.col("event_type") == "view", F.lit("nobody")).otherwise(F.col("c_name"))
    right = F.concat_ws("/", "c_mktsegment", "c_custkey")
    attempts = events.join(people, F.col("user") == F.col("c_custkey")).select(
        F.col("event_id").alias("attempt_id"),
        name.alias("public"),
        F.when(F.col("event_type") == "error", F.lit("guess")).otherwise(right).alias("secret"),
    )
    return verify_credentials(attempts, store, "Account").select("attempt_id", "key", "verified")
