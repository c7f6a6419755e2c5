"""Decisions on the user / admin / todo rules."""

import pytest

from fieldstone.catalog import STRING, ArrayOf, Catalog, Field, Model, Ref
from fieldstone.functions.secrets import hash_secret
from fieldstone.operators import access
from fieldstone.operators.access import (
    AuthorizationError,
    Rule,
    RuleError,
    authorize,
    expand_rules,
    require,
    rules_frame,
    secure_view,
    verify_credentials,
)
from fieldstone.sources.store import Store
from pyspark.sql import functions as F

CATALOG = Catalog(
    (
        Model(
            "User",
            1,
            (
                Field("username", STRING, 1, primary=True, public_credential=True),
                Field("password", STRING, 2, secret_credential=True),
                Field("friend", Ref("User"), 3, optional=True),
                Field("todos", ArrayOf(Ref("Todo")), 4),
            ),
            user=True,
        ),
        Model(
            "Admin",
            2,
            (
                Field("username", STRING, 1, primary=True, public_credential=True),
                Field("password", STRING, 2, secret_credential=True),
            ),
            user=True,
        ),
        Model("Todo", 3, (Field("title", STRING, 1, primary=True), Field("content", STRING, 2))),
    )
)

RULES = [
    Rule("allow", ("CREATE",), "User"),
    Rule("allow", ("READ",), "Todo"),
    Rule("allow", ("READ",), "User", role="User", is_self=True),
    Rule("deny", ("READ",), "User", "password", role="User", is_self=True),
    Rule("allow", ("ALL",), "User", "todos", role="User", is_self=True),
    Rule("allow", ("CREATE",), "Todo", role="User"),
    Rule("allow", ("ALL",), "User", role="Admin"),
    Rule("deny", ("READ",), "User", "password", role="Admin"),
    Rule("allow", ("ALL",), "Todo", role="Admin"),
]

OPS = (
    "op_id string, role string, user_id string, event string, model string, target_id string, field string, "
    "set_fields array<string>, selected_fields array<string>, creates_child boolean"
)


def decide(spark, rules, *ops):
    names = [c.strip().split(" ")[0] for c in OPS.split(", ")]
    rows = [tuple(o.get(n) for n in names) for o in ops]
    found = authorize(spark.createDataFrame(rows, OPS), rules_frame(spark, rules), CATALOG)
    return {r["op_id"]: [(e["cause"], e["field"]) for e in r["errors"]] for r in found.collect()}


def op(name, event, model, **more):
    return {"op_id": name, "event": event, "model": model, **more}


@pytest.mark.parametrize("few", [access.BROADCAST_RULES, 0])
def test_decisions(spark, monkeypatch, few):
    """With few rules each role's lie in one map; beyond that operations meet them key by key."""
    monkeypatch.setattr(access, "BROADCAST_RULES", few)
    me = {"role": "User", "user_id": "jo"}
    admin = {"role": "Admin", "user_id": "root"}
    got = decide(
        spark,
        RULES,
        op("create", "CREATE", "User", set_fields=["username", "password"], selected_fields=["username"]),
        op("list todo", "LIST", "Todo", selected_fields=["title"]),
        op("list user", "LIST", "User", selected_fields=["username"]),
        op("read me", "READ", "User", target_id="jo", selected_fields=["username", "todos"], **me),
        op("read my secret", "READ", "User", target_id="jo", selected_fields=["password"], **me),
        op("read other", "READ", "User", target_id="al", selected_fields=["username"], **me),
        op("push mine", "PUSH_TO", "User", target_id="jo", field="todos", creates_child=True, **me),
        op("push other", "PUSH_TO", "User", target_id="al", field="todos", **me),
        op("admin secret", "READ", "User", target_id="al", selected_fields=["password"], **admin),
        op("admin delete", "DELETE", "User", target_id="al", **admin),
        op("login", "LOGIN", "User"),
        op("root", "DELETE", "User", role="__root__"),
        op("ghost", "READ", "Todo", role="Ghost"),
        op("same key elsewhere", "DELETE", "Todo", target_id="root", **admin),
    )
    assert got == {
        "create": [],
        "list todo": [],
        "list user": [("no_allow", None), ("no_allow", "username")],
        "read me": [],
        "read my secret": [("field_read", "password")],
        "read other": [("no_allow", None), ("no_allow", "username")],
        "push mine": [],
        "push other": [("no_allow", None)],
        "admin secret": [("field_read", "password")],
        "admin delete": [],
        "login": [],
        "root": [],
        "ghost": [("unknown_role", None)],
        "same key elsewhere": [],
    }


def test_causes_of_denial(spark):
    rules = [
        Rule("allow", ("CREATE", "UPDATE", "DELETE"), "User", role="Admin"),
        Rule("deny", ("SET_ON_CREATE",), "User", "friend", role="Admin"),
        Rule("deny", ("UPDATE",), "User", "password", role="Admin"),
        Rule("deny", ("UPDATE",), "Todo", role="Admin"),
        Rule("allow", ("UPDATE",), "Todo", role="Admin"),
        Rule("deny", ("DELETE",), "User", role="Admin"),
        Rule("allow", ("UPDATE",), "User", role="User", is_self=True),
        Rule("deny", ("UPDATE",), "User", "friend", role="User", is_self=True),
    ]
    admin = {"role": "Admin", "user_id": "root"}
    got = decide(
        spark,
        rules,
        op("set", "CREATE", "User", set_fields=["username", "friend"], **admin),
        op("set many", "CREATE_MANY", "User", set_fields=["friend"], **admin),
        op("field", "UPDATE", "User", target_id="x", set_fields=["password", "friend"], **admin),
        op("model", "UPDATE_MANY", "Todo", set_fields=["content"], **admin),
        op("event", "DELETE", "User", target_id="x", **admin),
        op("self", "UPDATE", "User", target_id="jo", set_fields=["friend"], role="User", user_id="jo"),
    )
    assert got == {
        "set": [("field_set", "friend")],
        "set many": [("event_denied", None)],
        "field": [("field_update", "password")],
        "model": [("model_update", None)],
        "event": [("event_denied", None)],
        "self": [("field_update", "friend")],
    }


def test_messages(spark):
    ops = spark.createDataFrame([("a", "Admin", "r", "CREATE", "User", ["friend"])], "op_id string, role string, user_id string, event string, model string, set_fields array<string>")
    rules = rules_frame(spark, [Rule("deny", ("SET_ON_CREATE",), "User", "friend", role="Admin")])
    errors = authorize(ops, rules, CATALOG).first()["errors"]
    assert [e["message"] for e in errors] == [
        "No `allow` rule exists that allows `CREATE` operations on `User` for role `Admin`",
        "Denied setting field `friend` in `CREATE` operation",
    ]


@pytest.mark.parametrize(
    "rule",
    [
        Rule("allow", ("PUSH_TO",), "Todo", "title"),
        Rule("allow", ("CREATE",), "User", "todos"),
        Rule("allow", ("MUTATE",), "User"),
        Rule("allow", ("LOGIN",), "User", "friend"),
        Rule("allow", ("ALL", "READ"), "User"),
        Rule("allow", ("READ",), "User", "nothing"),
        Rule("allow", ("READ",), "User", is_self=True),
    ],
)
def test_inapplicable_rules(spark, rule):
    with pytest.raises(RuleError):
        expand_rules(rules_frame(spark, [rule]), CATALOG)


def _store(spark):
    users = spark.createDataFrame(
        [("jo", "s1", "al"), ("al", "s2", None)], "username string, password string, friend string"
    )
    users = users.withColumn("password", hash_secret(F.col("password"), F.lit("x")))
    todos = spark.createDataFrame([("a", "secret"), ("b", "open")], "title string, content string")
    return Store(spark, CATALOG, {"User": users, "Todo": todos})


def test_predicates_see_user_and_target(spark):
    store = _store(spark)
    rules = rules_frame(
        spark,
        [
            Rule("allow", ("READ", "CREATE"), "Todo", role="User", predicate="open_only"),
            Rule("allow", ("READ",), "User", role="User", predicate="friends"),
        ],
    )
    predicates = {
        "open_only": lambda user, target: target["content"] == "open",
        "friends": lambda user, target: user["friend"] == target["username"],
    }
    rows = [
        ("secret", "jo", "READ", "Todo", "a", None),
        ("open", "jo", "READ", "Todo", "b", None),
        ("create", "jo", "CREATE", "Todo", None, '{"title": "c", "content": "open"}'),
        ("friend", "jo", "READ", "User", "al", None),
        ("no friend", "al", "READ", "User", "jo", None),
    ]
    ops = spark.createDataFrame(
        rows, "op_id string, user_id string, event string, model string, target_id string, arg string"
    ).withColumn("role", F.lit("User"))
    got = {r["op_id"]: r["allowed"] for r in authorize(ops, rules, CATALOG, store, predicates).collect()}
    assert got == {"secret": False, "open": True, "create": True, "friend": True, "no friend": False}


def test_failing_predicate_fails_the_request(spark):
    rules = rules_frame(spark, [Rule("allow", ("READ",), "Todo", role="User", predicate="broken")])
    ops = spark.createDataFrame([(1, "User", "jo", "READ", "Todo", "a")], "op_id int, role string, user_id string, event string, model string, target_id string")
    broken = {"broken": lambda user, target: F.raise_error(F.concat(F.lit("no "), target["title"])).cast("boolean")}
    with pytest.raises(AuthorizationError):
        require(authorize(ops, rules, CATALOG, _store(spark), broken))


def test_secure_view(spark):
    store = _store(spark)
    rules = rules_frame(
        spark,
        [
            Rule("allow", ("READ",), "User", role="User", is_self=True),
            Rule("allow", ("READ",), "Todo", role="User"),
            Rule("deny", ("READ",), "Todo", "content", role="User", predicate="is_secret"),
            Rule("allow", ("READ",), "Todo", role="Admin"),
            Rule("deny", ("READ",), "Todo", "content", role="Admin"),
        ],
    )
    predicates = {"is_secret": lambda user, target: target["content"] == "secret"}
    mine = secure_view(store, "User", "User", "jo", rules, predicates)
    assert [tuple(r) for r in mine.collect()] == [("jo", "al")] and mine.columns == ["username", "friend"]
    todos = secure_view(store, "Todo", "User", "jo", rules, predicates)
    assert sorted(map(tuple, todos.collect()), key=str) == [("a", None), ("b", "open")]
    assert secure_view(store, "Todo", "Admin", "root", rules).columns == ["title"]
    assert secure_view(store, "Todo", None, None, rules).count() == 0


def test_credentials(spark):
    attempts = spark.createDataFrame(
        [(1, "jo", "s1"), (2, "jo", "s2"), (3, "nobody", "s1"), (4, "al", None)],
        "attempt_id int, public string, secret string",
    )
    got = {r["attempt_id"]: r["verified"] for r in verify_credentials(attempts, _store(spark), "User").collect()}
    assert got == {1: True, 2: False, 3: False, 4: False}


def test_a_role_of_many_rules(spark, monkeypatch):
    """Rules of one role beyond any map: most are about predicates of their own and never asked for."""
    monkeypatch.setattr(access, "BROADCAST_RULES", 1000)
    wide = Catalog((Model("Wide", 1, (Field("id", STRING, 1, primary=True), *[Field(f"f{i}", STRING, i + 2) for i in range(300)]), user=True),))
    rules = [Rule("allow" if i % 2 else "deny", ("READ", "UPDATE", "SET_ON_CREATE", "READ_ON_CREATE"), "Wide", f"f{i}", role="Wide") for i in range(300)]
    rules += [Rule("allow", ("READ", "UPDATE"), "Wide", role="Wide")]
    ops = spark.range(200).select(
        F.col("id").cast("string").alias("op_id"), F.lit("Wide").alias("role"), F.lit("u").alias("user_id"), F.lit("READ").alias("event"),
        F.lit("Wide").alias("model"), F.lit("x").alias("target_id"), F.array(F.format_string("f%d", "id")).alias("selected_fields"),
    )
    got = {int(r["op_id"]): r["allowed"] for r in authorize(ops, rules_frame(spark, rules), wide).collect()}
    assert got == {i: i % 2 == 1 for i in range(200)}
