"""Allow and deny rules over logs of operations, and as secured views of tables.

A kind of operation (who does what to which fields) looks up its rules by role
and key. Every kind is decided once per outcome of
the predicates, so a log of any length is only hashed against few decisions. The
user and target records are joined in only for predicates that look at them. The
log is never exploded or shuffled by role.

An operation is on *self* when it targets the user's own record: the role is
the target's model and the target's key is the user's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from functools import reduce
from itertools import chain, combinations
from operator import or_

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldstone.catalog import Catalog, Field
from fieldstone.functions.registry import resolve
from fieldstone.functions.secrets import verify_secret
from fieldstone.session import checkpointed, local_frame
from fieldstone.sources.json_records import record_schema
from fieldstone.sources.store import Store

# What each kind of resource can be granted.
MODEL_PERMISSIONS = ("READ", "UPDATE", "CREATE", "DELETE", "READ_ON_CREATE", "LOGIN")
ARRAY_PERMISSIONS = ("READ", "UPDATE", "SET_ON_CREATE", "READ_ON_CREATE", "PUSH_TO", "REMOVE_FROM", "MUTATE")
PRIMITIVE_PERMISSIONS = ("READ", "UPDATE", "SET_ON_CREATE", "READ_ON_CREATE")
REFERENCE_PERMISSIONS = ("READ", "UPDATE", "MUTATE", "SET_ON_CREATE", "READ_ON_CREATE")
ALL = "ALL"
SUPERUSER = "__root__"

# What is about an element of an array: permissions, and the operations they are asked for.
ITEM_PERMISSIONS = ("PUSH_TO", "REMOVE_FROM", "MUTATE")
ITEM_EVENTS = ("PUSH_TO", "PUSH_MANY_TO", "REMOVE_FROM", "REMOVE_MANY_FROM")
# Places where rules name predicates; each becomes an expression of the plan.
MAX_PREDICATES = 500

# Rules are definitions; beyond this many they are joined without a broadcast.
BROADCAST_RULES = 10_000

RULE_SCHEMA = (
    "rule_id bigint, role string, model string, field string, permissions array<string>, "
    "kind string, is_self boolean, predicate_id string"
)

Predicate = Callable[[Column, Column], Column]


class RuleError(ValueError):
    """A rule that grants what its resource does not have."""


class AuthorizationError(PermissionError):
    """An operation that the rules do not allow."""


@dataclass(frozen=True)
class Rule:
    kind: str  # "allow" or "deny"
    permissions: tuple[str, ...]
    model: str
    field: str | None = None
    role: str | None = None  # None is the anonymous user
    is_self: bool = False
    predicate: str | None = None


def rules_frame(spark: SparkSession, rules: Iterable[Rule]) -> DataFrame:
    rows = [
        (i, r.role, r.model, r.field, list(r.permissions), r.kind, r.is_self, r.predicate)
        for i, r in enumerate(rules)
    ]
    return local_frame(spark, rows, RULE_SCHEMA)


# -- expansion ---------------------------------------------------------------


def _kinds(catalog: Catalog):
    """(model, field or '') -> (what ALL means, what may be named)."""
    for m in catalog.models:
        yield (m.name, ""), MODEL_PERMISSIONS, MODEL_PERMISSIONS
        for f in m.fields:
            if f.is_array:
                every = named = ARRAY_PERMISSIONS
            elif f.is_ref or f.optional:
                # ALL on a reference means what it means on a model.
                every, named = MODEL_PERMISSIONS, REFERENCE_PERMISSIONS
            else:
                every = named = PRIMITIVE_PERMISSIONS
            yield (m.name, f.name), every, named


def _applicability(spark: SparkSession, catalog: Catalog) -> DataFrame:
    rows = [(m, f, list(every), list(named)) for (m, f), every, named in _kinds(catalog)]
    return local_frame(spark, rows, "a_model string, a_field string, every array<string>, named array<string>")


def _judged(rules: DataFrame, catalog: Catalog) -> DataFrame:
    # One row per model and field of the catalog: bounded by the definition.
    kinds = F.broadcast(_applicability(rules.sparkSession, catalog))
    on = (F.col("model") == F.col("a_model")) & (F.coalesce("field", F.lit("")) == F.col("a_field"))
    joined = rules.join(kinds, on, "left")
    has_all = F.array_contains("permissions", ALL)
    reason = (
        F.when(F.col("a_model").isNull(), F.lit("unknown_resource"))
        .when(has_all & (F.size("permissions") > 1), F.lit("all_combined"))
        .when(~has_all & (F.size(F.array_except("permissions", "named")) > 0), F.lit("inapplicable"))
        .when(F.col("is_self") & F.col("role").isNull(), F.lit("self_outside_role"))
        .when(F.col("is_self") & (F.col("role") != F.col("model")), F.lit("self_of_other_model"))
    )
    return joined.withColumn("reason", reason).withColumn(
        "granted", F.when(has_all, F.col("every")).otherwise(F.array_distinct("permissions"))
    )


def rule_errors(rules: DataFrame, catalog: Catalog) -> DataFrame:
    """Rules that cannot be used, with the reason."""
    judged = _judged(rules, catalog).where(F.col("reason").isNotNull())
    return judged.select("rule_id", "role", "model", "field", "reason")


def expand_rules(rules: DataFrame, catalog: Catalog, check: bool = True) -> DataFrame:
    """One row per rule and permission, with ``ALL`` spelled out for the kind of resource."""
    if check:
        wrong = rule_errors(rules, catalog).take(1)
        if wrong:
            raise RuleError(f"rule on `{wrong[0]['model']}.{wrong[0]['field']}`: {wrong[0]['reason']}")
    return _judged(rules, catalog).where(F.col("reason").isNull()).select(
        "rule_id", "role", "model", "field", F.explode("granted").alias("permission"), "kind", "is_self", "predicate_id"
    )


# -- look-up -----------------------------------------------------------------


def _key(model: Column, field: Column, permission: str, scope: Column | str) -> Column:
    scope = F.lit(scope) if isinstance(scope, str) else scope
    return F.concat_ws("|", model, field, F.lit(permission), scope)


def rules_by_key(expanded: DataFrame) -> DataFrame:
    """``set_role, key, hits``: the rules of each role at each (model, field, permission, scope)."""
    scope = F.when(F.col("is_self"), F.lit("self")).otherwise(F.lit("any"))
    hit = F.struct("kind", "field", "permission", "predicate_id")
    key = F.concat_ws("|", "model", F.coalesce("field", F.lit("")), "permission", scope)
    return expanded.groupBy(F.coalesce("role", F.lit("")).alias("set_role"), key.alias("key")).agg(
        F.collect_set(hit).alias("hits")
    )


def rule_sets(expanded: DataFrame) -> DataFrame:
    """One row per role: a map from the keys to the rules there."""
    return rules_by_key(expanded).groupBy("set_role").agg(F.map_from_entries(F.collect_list(F.struct("key", "hits"))).alias("rules"))


# Optional columns of an operation log and what their absence means.
_OPTIONAL = {
    "role": "string",
    "user_id": "string",
    "target_id": "string",
    "field": "string",
    "set_fields": "array<string>",
    "selected_fields": "array<string>",
    "creates_child": "boolean",
    "arg": "string",
}


def _complete(ops: DataFrame) -> DataFrame:
    missing = {n: F.lit(None).cast(t) for n, t in _OPTIONAL.items() if n not in ops.columns}
    return ops.withColumns(missing) if missing else ops


def _is_self() -> Column:
    same = (F.col("target_id") == F.col("user_id")) & (F.col("role") == F.col("model"))
    single = F.col("event").isin("READ", "UPDATE", "DELETE", "PUSH_TO", "PUSH_MANY_TO", "REMOVE_FROM", "REMOVE_MANY_FROM")
    return F.coalesce(same & single, F.lit(False))


def _lookup(pairs: Mapping[str, str], key: Column) -> Column:
    """A constant map over the definition; null when the key is not in it."""
    if not pairs:
        return F.lit(None).cast("string")
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])[key]


def _child_model(catalog: Catalog) -> Column:
    """The model of which a push creates a record; null for every other operation."""
    targets = {f"{m.name}|{f.name}": f.ref_model for m in catalog.models for f in m.arrays if f.is_ref_array}
    creates = F.coalesce("creates_child", F.lit(False)) & F.col("event").isin("PUSH_TO", "PUSH_MANY_TO")
    return F.when(creates, _lookup(targets, F.concat_ws("|", "model", "field")))


def rules_of(ops: DataFrame, catalog: Catalog) -> DataFrame:
    """Add ``own_keys`` (rule keys of each operation) and ``read_keys`` (per selected field)."""
    event, model, none = F.col("event"), F.col("model"), F.lit("")
    on_self = F.col("on_self") if "on_self" in ops.columns else _is_self()
    fields = F.coalesce("set_fields", F.array().cast("array<string>"))
    array_field = F.coalesce("field", none)

    def both(field: Column, permission: str) -> Column:
        plain = F.array(_key(model, field, permission, "any"))
        return F.when(on_self, F.array_append(plain, _key(model, field, permission, "self"))).otherwise(plain)

    def plain(field: Column, permission: str) -> Column:
        return F.array(_key(model, field, permission, "any"))

    def each(permission: str, keys) -> Column:
        return F.flatten(F.transform(fields, lambda f: keys(f, permission)))

    child = _child_model(catalog)
    create_child = F.when(child.isNotNull(), F.array(_key(child, none, "CREATE", "any"))).otherwise(
        F.array().cast("array<string>")
    )
    own = (
        F.when(event == "READ", both(none, "READ"))
        .when(event == "LIST", plain(none, "READ"))
        .when(event.isin("CREATE", "CREATE_MANY"), F.concat(plain(none, "CREATE"), each("SET_ON_CREATE", plain)))
        .when(event == "UPDATE", F.concat(both(none, "UPDATE"), each("UPDATE", both)))
        .when(event == "UPDATE_MANY", F.concat(plain(none, "UPDATE"), each("UPDATE", plain)))
        # Deleting oneself looks at self rules only.
        .when(
            event == "DELETE",
            F.array(_key(model, none, "DELETE", F.when(on_self, F.lit("self")).otherwise(F.lit("any")))),
        )
        .when(event == "DELETE_MANY", plain(none, "DELETE"))
        .when(
            event.isin("PUSH_TO", "PUSH_MANY_TO"),
            F.concat(both(array_field, "MUTATE"), both(array_field, "PUSH_TO"), create_child),
        )
        .when(
            event.isin("REMOVE_FROM", "REMOVE_MANY_FROM"),
            F.concat(both(array_field, "MUTATE"), both(array_field, "REMOVE_FROM")),
        )
        .when(event == "LOGIN", plain(none, "LOGIN"))
        .otherwise(F.array().cast("array<string>"))
    )
    creating = event.isin("CREATE", "CREATE_MANY")

    def read_keys(name: Column) -> Column:
        after_create = F.concat(
            plain(none, "READ"), plain(none, "READ_ON_CREATE"), plain(name, "READ"), plain(name, "READ_ON_CREATE")
        )
        keys = F.when(creating, after_create).otherwise(F.concat(both(none, "READ"), both(name, "READ")))
        return F.struct(name.alias("name"), keys.alias("keys"))

    selected = F.coalesce("selected_fields", F.array().cast("array<string>"))
    return ops.withColumns({"own_keys": own, "read_keys": F.transform(selected, read_keys)})


def match_rules(ops: DataFrame, rules: DataFrame, catalog: Catalog) -> DataFrame:
    """Add ``rules``, a map from keys to the rules there, to each operation; null when there are none.

    A few rules are broadcast, each role's in one map. Otherwise operations meet rules key by key, and an
    operation's map holds what it asks for, so a role may have any number of rules.
    """
    expanded = expand_rules(rules, catalog)
    if expanded.count() <= BROADCAST_RULES:
        sets = F.broadcast(rule_sets(expanded))
        return ops.join(sets, F.coalesce(ops["role"], F.lit("")) == F.col("set_role"), "left").drop("set_role")
    ops = checkpointed(ops.withColumn("__no", F.monotonically_increasing_id()))
    keys = F.array_distinct(F.concat("own_keys", F.flatten(F.transform("read_keys", lambda r: r["keys"]))))
    asked = ops.select("__no", F.coalesce("role", F.lit("")).alias("set_role"), F.explode(keys).alias("key"))
    found = asked.join(rules_by_key(expanded), ["set_role", "key"]).groupBy("__no").agg(
        F.map_from_entries(F.collect_list(F.struct("key", "hits"))).alias("rules")
    )
    return ops.join(found, "__no", "left").drop("__no")


# -- predicates --------------------------------------------------------------


def _used_predicates(rules: DataFrame, catalog: Catalog) -> list:
    """Which predicate guards what for which role: ``field`` is set where the rule is about pushing to or
    removing from that array, so that the predicate sees the item; else it sees the record."""
    granted = expand_rules(rules, catalog).where(F.col("predicate_id").isNotNull())
    arrays = [f"{m.name}|{f.name}" for m in catalog.models for f in m.arrays]
    on_item = F.col("permission").isin(*ITEM_PERMISSIONS) & F.concat_ws("|", "model", "field").isin(*arrays)
    item = F.when(on_item, F.col("field")).alias("field") if arrays else F.lit(None).cast("string").alias("field")
    found = granted.select("role", "model", item, "predicate_id").distinct().take(MAX_PREDICATES + 1)
    if len(found) > MAX_PREDICATES:
        raise RuleError(f"rules name predicates in more than {MAX_PREDICATES} places")
    return found


def _predicate_values(
    ops: DataFrame,
    used: list,
    catalog: Catalog,
    store: Store | None,
    predicates: Mapping[str, Predicate | str],
) -> DataFrame:
    """Add ``passed``: the sorted ids of the predicates that are literally true for the operation.

    Records are looked up for the operations that some predicate concerns; the others pass by the joins.
    """
    nothing = F.array().cast("array<string>")
    if not used:
        return ops.withColumn("passed", nothing)
    if store is None:
        raise ValueError("rules with predicates need a store")
    ops = ops.withColumn("child_model", _child_model(catalog))
    places = []
    for row in used:
        here = F.col("role").eqNullSafe(F.lit(row["role"]))
        if row["field"] is None:
            places.append(here & _concerns(row["model"]))
        else:
            on_item = F.col("event").isin(*ITEM_EVENTS) & (F.col("model") == row["model"]) & (F.col("field") == row["field"])
            places.append(here & F.coalesce(on_item, F.lit(False)))
    concerned = F.coalesce(reduce(lambda x, y: x | y, places), F.lit(False))
    others = ops.where(~concerned).withColumn("passed", nothing)
    ops = ops.where(concerned)

    schemas = {name: store.scan(name).schema for row in used for name in (row["role"], row["model"]) if name}
    for role in sorted({r["role"] for r in used if r["role"] is not None}):
        pk = catalog.model(role).pk
        ops = _with_record(ops, store, role, pk, F.when(F.col("role") == role, F.col("user_id")), f"__user.{role}")
    stored = F.col("event").isin("READ", "DELETE")
    for model in sorted({r["model"] for r in used if r["field"] is None}):
        key = F.when((F.col("model") == model) & stored, F.col("target_id"))
        ops = _with_record(ops, store, model, catalog.model(model).pk, key, f"__stored.{model}")
        # Parsed once, into a column of its own.
        parsed = F.from_json("arg", record_schema(catalog, model, nested=False))
        ops = ops.withColumn(f"__given.{model}", F.when(_concerns(model) & ~stored, parsed))

    def user_of(role: str | None) -> Column:
        if role is None:
            return F.lit(None)
        return F.struct(*[F.col(f"`__user.{role}.{c}`").alias(c) for c in schemas[role].names])

    def given(model: str, parsed: Column, f: T.StructField) -> Column:
        """A field of a record given as JSON; a reference may be an object or a key."""
        field = catalog.model(model).field(f.name)
        value = parsed[f.name].cast(f.dataType)
        if field.ref_model is None:
            return value
        inner = F.get_json_object("arg", f"$.{f.name}.{catalog.model(field.ref_model).pk}")
        return F.coalesce(inner.cast(f.dataType), value)

    def target_of(model: str) -> Column:
        parsed = F.col(f"`__given.{model}`")
        return F.struct(
            *[F.coalesce(F.col(f"`__stored.{model}.{f.name}`"), given(model, parsed, f)).alias(f.name) for f in schemas[model]]
        )

    def item_of(model: str, name: str) -> Column:
        """The element that is pushed or removed: a record's fields, or the value itself."""
        f = catalog.model(model).field(name)
        if not f.is_ref_array:
            kind = T.StructType([T.StructField("v", catalog.value_type(f.type.of))])
            return F.from_json(F.concat(F.lit('{"v":'), F.col("arg"), F.lit("}")), kind)["v"]
        child = catalog.model(f.ref_model)
        parsed = F.from_json("arg", record_schema(catalog, child.name, nested=False))
        key = F.when(~F.col("arg").startswith("{"), F.coalesce(F.get_json_object("arg", "$"), F.col("arg")))
        fields = []
        for c in store.scan(child.name).schema:
            value = given(child.name, parsed, c)
            # An existing record may be given by its key alone.
            fields.append((F.coalesce(value, key.try_cast(c.dataType)) if c.name == child.pk else value).alias(c.name))
        return F.struct(*fields)

    passed = []
    for row, here in zip(used, places):
        model, name = row["model"], row["predicate_id"]
        target = target_of(model) if row["field"] is None else item_of(model, row["field"])
        value = resolve(predicates.get(name, name))(user_of(row["role"]), target)
        passed.append(F.when(here & value.cast("boolean"), F.lit(name)))
    ops = ops.withColumn("passed", F.array_sort(F.array_distinct(F.array_compact(F.array(*passed)))))
    return ops.select(*others.columns).unionByName(others)


def _concerns(model: str) -> Column:
    """Is the operation on a record of the model, or does it push a new one?"""
    own = (F.col("model") == model) & ~F.col("event").isin(*ITEM_EVENTS)
    return own | F.coalesce(F.col("child_model") == model, F.lit(False))


def _with_record(ops: DataFrame, store: Store, model: str, pk: str, key: Column, name: str) -> DataFrame:
    """Left-join the columns of one record of ``model``; those that no predicate reads are
    pruned. Operations without a key get one of their own that matches nothing, so they
    spread instead of meeting at null."""
    table = store.scan(model)
    side = table.select(
        F.concat(F.lit("="), F.col(pk).cast("string")).alias("__key"),
        *[F.col(f"`{c}`").alias(f"{name}.{c}") for c in table.columns],
    )
    own = F.coalesce(F.concat(F.lit("="), key), F.concat(F.lit("-"), F.col("op_id").cast("string")))
    return ops.join(side, own == F.col("__key"), "left").drop("__key")


# -- decision ----------------------------------------------------------------


def authorize(
    ops: DataFrame,
    rules: DataFrame,
    catalog: Catalog,
    store: Store | None = None,
    predicates: Mapping[str, Predicate | str] | None = None,
) -> DataFrame:
    """Decide every operation: columns ``op_id``, ``allowed`` and ``errors``.

    ``ops`` has ``op_id``, ``event``, ``model`` and optionally ``role``,
    ``user_id``, ``target_id``, ``field`` (of pushes and removals),
    ``set_fields``, ``selected_fields``, ``creates_child`` and ``arg`` (JSON).
    An operation, and each field it selects, needs an allow that holds and no
    deny that holds. Each error names its cause, field and message.
    """
    ops = _complete(ops).withColumn("on_self", _is_self())
    used = _used_predicates(rules, catalog)
    judged = _predicate_values(ops, used, catalog, store, predicates or {})
    ids = _ids_by_role(used)
    kinds = None
    if max(map(len, ids.values()), default=0) <= SUBSET_PREDICATES:
        kinds = checkpointed(ops.select(*_KIND).distinct())
    # Free selections can make nearly every operation a kind of its own; then each is decided itself.
    if kinds is not None and kinds.count() <= BROADCAST_KINDS:
        decisions = _decisions(kinds, rules, catalog, ids)
        columns = [*_KIND, "passed"]
        on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in columns]
        decided = judged.select("op_id", *columns).join(decisions, on).select("op_id", "errors")
    else:
        decided = _decided(rules_of(judged, catalog), rules, catalog).select("op_id", "errors")
    return decided.select("op_id", (F.size("errors") == 0).alias("allowed"), "errors")


# All that a decision without predicates depends on.
_KIND = ("role", "event", "model", "field", "set_fields", "selected_fields", "creates_child", "on_self")
# Decided kinds of operations that may be broadcast; a log has few, whatever its length.
BROADCAST_KINDS = 50_000


# Up to this many predicates per role, every outcome of them is decided in advance.
SUBSET_PREDICATES = 6


def _ids_by_role(used) -> dict:
    ids: dict = {}
    for row in used:
        ids.setdefault(row["role"], set()).add(row["predicate_id"])
    return ids


def _outcomes(ids: Mapping) -> Column:
    """All sets of predicates that may hold for an operation of the row's role."""

    def subsets(names) -> Column:
        found = chain.from_iterable(combinations(sorted(names), n) for n in range(len(names) + 1))
        return F.array(*[F.array(*[F.lit(n) for n in chosen]).cast("array<string>") for chosen in found])

    outcomes = F.when(F.lit(False), subsets(()))
    for role, names in ids.items():
        outcomes = outcomes.when(F.col("role").eqNullSafe(F.lit(role)), subsets(names))
    return outcomes.otherwise(subsets(()))


def _decisions(kinds: DataFrame, rules: DataFrame, catalog: Catalog, ids: Mapping) -> DataFrame:
    """Decide each kind of operation under every outcome of the predicates.

    The log itself is then only hashed and looked up; its distinct kinds are
    combined map-side and found without evaluating a predicate.
    """
    kinds = kinds.withColumn("passed", F.explode(_outcomes(ids)))
    decided = _decided(rules_of(kinds, catalog), rules, catalog)
    decided = checkpointed(decided.select(*[F.col(c).alias(f"__{c}") for c in (*_KIND, "passed")], "errors"))
    return F.broadcast(decided) if decided.count() <= BROADCAST_KINDS else decided


def _decided(ops: DataFrame, rules: DataFrame, catalog: Catalog) -> DataFrame:
    """Add ``errors`` to operations that carry their rule keys and passed predicates."""
    ops = match_rules(ops, rules, catalog)
    event, model = F.col("event"), F.col("model")
    creating = event.isin("CREATE", "CREATE_MANY")
    role_part = F.coalesce(F.concat(F.lit(" for role `"), F.col("role"), F.lit("`")), F.lit(""))

    def hits(keys: Column) -> Column:
        found = F.flatten(F.transform(keys, lambda k: F.coalesce(F.col("rules")[k], _NO_HITS())))
        return F.filter(found, lambda h: h["predicate_id"].isNull() | F.array_contains("passed", h["predicate_id"]))

    def no_allow(found: Column, implicit: Column, what: Column, on: Column, field: Column) -> Column:
        message = F.concat(
            F.lit("No `allow` rule exists that allows `"), what, F.lit("` operations on `"), on, F.lit("`"), role_part
        )
        granted = implicit | F.exists(found, lambda h: h["kind"] == "allow")
        return F.when(granted, _NO_ERRORS()).otherwise(F.array(_error(F.lit("no_allow"), field, message)))

    def denials(found: Column, describe) -> Column:
        return F.transform(F.filter(found, lambda h: h["kind"] == "deny"), describe)

    none = F.lit(None).cast("string")
    updating = event.isin("UPDATE", "UPDATE_MANY")

    def own_error(h: Column) -> Column:
        setting = (event == "CREATE") & (h["permission"] == "SET_ON_CREATE")
        cause = (
            F.when(setting, F.lit("field_set"))
            .when(updating & h["field"].isNotNull(), F.lit("field_update"))
            .when(updating, F.lit("model_update"))
            .otherwise(F.lit("event_denied"))
        )
        message = (
            F.when(setting, F.concat(F.lit("Denied setting field `"), h["field"], F.lit("` in `CREATE` operation")))
            .when(
                updating & h["field"].isNotNull(),
                F.concat(F.lit("Denied updating `"), h["field"], F.lit("` field in `UPDATE` operation on `"), model, F.lit("`")),
            )
            .when(updating, F.concat(F.lit("Denied performing `UPDATE` operation on `"), model, F.lit("`")))
            .otherwise(F.concat(F.lit("`"), event, F.lit("` operation denied on `"), model, F.lit("`")))
        )
        named = F.when(setting | updating, h["field"])
        return _error(cause, named, message)

    # Looked up once and named, so that the lookups are not repeated in each use.
    ops = ops.withColumns(
        {
            "own_hits": hits(F.col("own_keys")),
            "read_hits": F.transform("read_keys", lambda r: F.struct(r["name"], hits(r["keys"]).alias("hits"))),
        }
    )
    own = F.col("own_hits")
    own_errors = F.concat(no_allow(own, event == "LOGIN", event, model, none), denials(own, own_error))

    arrays = {f"{m.name}|{f.name}": "LIST" for m in catalog.models for f in m.arrays}
    inner_models = {f"{m.name}|{f.name}": f.ref_model for m in catalog.models for f in m.fields if f.ref_model}

    def read_errors(r: Column) -> Column:
        found = r["hits"]
        place = F.concat_ws("|", model, r["name"])
        what = F.coalesce(_lookup(arrays, place), F.lit("READ"))
        on = F.coalesce(_lookup(inner_models, place), model)

        def describe(h: Column) -> Column:
            field_read = (what == "READ") & h["field"].isNotNull()
            cause = F.when(field_read, F.lit("field_read")).otherwise(F.lit("event_denied"))
            message = F.when(
                field_read, F.concat(F.lit("Denied reading field `"), model, F.lit("."), h["field"], F.lit("`"))
            ).otherwise(F.concat(F.lit("`"), what, F.lit("` operation denied on `"), on, F.lit("`")))
            return _error(cause, r["name"], message)

        return F.concat(no_allow(found, creating, what, on, r["name"]), denials(found, describe))

    inner = F.flatten(F.transform("read_hits", read_errors))
    known = F.coalesce(F.col("role").isin(*[m.name for m in catalog.models]), F.lit(True))
    unknown = F.array(
        _error(
            F.lit("unknown_role"),
            none,
            F.concat(F.lit("Request has role `"), F.col("role"), F.lit("` that doesn't exist")),
        )
    )
    errors = (
        F.when(F.coalesce(F.col("role") == SUPERUSER, F.lit(False)), _NO_ERRORS())
        .when(~known, unknown)
        .otherwise(F.array_distinct(F.concat(own_errors, inner)))
    )
    return ops.withColumn("errors", errors)


def _error(cause: Column, field: Column, message: Column) -> Column:
    return F.struct(cause.alias("cause"), field.alias("field"), message.alias("message"))


def _NO_ERRORS() -> Column:
    return F.array().cast("array<struct<cause:string,field:string,message:string>>")


def _NO_HITS() -> Column:
    return F.array().cast("array<struct<kind:string,field:string,permission:string,predicate_id:string>>")


def require(decisions: DataFrame) -> None:
    """Raise when any operation was refused, or a predicate failed."""
    try:
        refused = decisions.where(~F.col("allowed")).take(1)
    except PySparkException as error:
        raise AuthorizationError(f"a predicate failed: {error}") from error
    if refused:
        raise AuthorizationError("; ".join(e["message"] for e in refused[0]["errors"]))


# -- secured views -----------------------------------------------------------


def secure_view(
    store: Store,
    model: str,
    role: str | None,
    user_id,
    rules: DataFrame,
    predicates: Mapping[str, Predicate | str] | None = None,
) -> DataFrame:
    """The rows and columns of a table that the user may read.

    A column denied for every row is left out; one denied for some rows is null there.
    """
    catalog = store.catalog
    m = catalog.model(model)
    visible = [f for f in m.stored if not f.secret_credential]
    df = store.scan(model)
    if role == SUPERUSER:
        return df.select(*[f.name for f in visible])
    if role is not None and not catalog.has(role):
        raise AuthorizationError(f"Request has role `{role}` that doesn't exist")
    mine = F.col("role").eqNullSafe(F.lit(role)) & (F.col("model") == model) & (F.col("permission") == "READ")
    # Distinct grants of one role on one model: bounded by its fields and predicates,
    # however many rules repeat them.
    grants = expand_rules(rules, catalog).where(mine)
    relevant = grants.select("field", "kind", "is_self", "predicate_id").distinct().collect()
    user = None
    if role is not None and any(r["predicate_id"] for r in relevant):
        owner = catalog.model(role)
        found = store.scan(role).where(F.col(owner.pk) == F.lit(user_id)).take(1)
        schema = store.scan(role).schema
        values = found[0] if found else [None] * len(schema)
        user = F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for f, v in zip(schema, values)])
    target = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    own = (F.col(m.pk) == F.lit(user_id)) if role == model else F.lit(False)

    def holds(rule) -> Column | None:
        """Condition under which the rule applies to a row; None is always."""
        parts = [own] if rule["is_self"] else []
        if rule["predicate_id"]:
            fn = resolve((predicates or {}).get(rule["predicate_id"], rule["predicate_id"]))
            parts.append(fn(user, target).cast("boolean"))
        if not parts:
            return None
        return F.coalesce(reduce(lambda a, b: a & b, parts), F.lit(False))

    def decide(fields: set) -> Column | bool:
        """May the row (or a field of it) be read? True or False when no row matters."""
        conditions = {"allow": [], "deny": []}
        for rule in relevant:
            if rule["field"] in fields:
                conditions[rule["kind"]].append(holds(rule))
        always = {kind: any(c is None for c in found) for kind, found in conditions.items()}
        if always["deny"] or not conditions["allow"]:
            return False
        refused = [~c for c in conditions["deny"]]
        granted = [] if always["allow"] else [reduce(or_, conditions["allow"])]
        return reduce(lambda a, b: a & b, granted + refused) if granted + refused else True

    row = decide({None})
    if row is False:
        return df.limit(0).select(m.pk)
    columns = []
    for f in visible:
        readable = decide({None, f.name})
        if readable is True:
            columns.append(F.col(f"`{f.name}`"))
        elif readable is not False:
            columns.append(F.when(readable, F.col(f"`{f.name}`")).alias(f.name))
    return (df if row is True else df.where(row)).select(*columns)


# -- credentials -------------------------------------------------------------


def verify_credentials(attempts: DataFrame, store: Store, model: str) -> DataFrame:
    """Check login attempts (``attempt_id``, ``public``, ``secret`` and, with several
    public credentials, ``field``); adds ``key`` and ``verified``, which is never null."""
    m = store.catalog.model(model)
    if not m.user or not m.public_credentials:
        raise ValueError(f"`{model}` has no public credential")
    secret: Field | None = m.secret
    names = [m.pk, *[f.name for f in m.public_credentials], *([secret.name] if secret else [])]
    users = store.scan(model, dict.fromkeys(names))
    publics = F.array(
        *[
            F.struct(F.lit(f.name).alias("field"), F.col(f.name).cast("string").alias("value"))
            for f in m.public_credentials
        ]
    )
    stored = F.col(secret.name) if secret else F.lit(None).cast("string")
    credentials = users.select(
        F.col(m.pk).alias("key"), stored.alias("__stored"), F.explode(publics).alias("__public")
    )
    field = F.col("field") if "field" in attempts.columns else F.lit(m.public_credentials[0].name)
    on = (F.col("__public.value") == F.col("public").cast("string")) & (F.col("__public.field") == field)
    joined = attempts.join(credentials, on, "left")
    if secret is None:
        right = F.col("key").isNotNull()
    else:
        right = F.col("key").isNotNull() & verify_secret(F.col("secret"), F.col("__stored"))
    return joined.select(*attempts.columns, F.when(right, F.col("key")).alias("key"), right.alias("verified"))
