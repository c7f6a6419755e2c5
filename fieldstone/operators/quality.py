"""Constraint checks as jobs that return violations.

Every check yields (model, field, key, rule, value), all text, and reads only
the columns it needs. Counting is combined map-side, so a value that fills a
third of a table costs one row per task in the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from fieldstone.catalog import BOOL, DATE, FILE, FLOAT, INT, STRING, Catalog, Enumeration, Field, Model
from fieldstone.functions.joins import rows_without
from fieldstone.session import checkpointed, local_frame
from fieldstone.sources.store import Store

VIOLATION = "model string, field string, key string, rule string, value string"


class ConstraintError(ValueError):
    """Records that a writer must not accept; ``violations`` holds all of them."""

    def __init__(self, violations: DataFrame, sample):
        self.violations = violations
        super().__init__(f"{sample['rule']} violated on `{sample['model']}.{sample['field']}`: {sample['value']!r}")


def ensure(violations: DataFrame) -> None:
    """Raise when there is any violation."""
    found = violations.take(1)
    if found:
        raise ConstraintError(violations, found[0])


def violation_rows(df: DataFrame, model: str, field: str, rule: str, key: Column, value: Column) -> DataFrame:
    return df.select(
        F.lit(model).alias("model"),
        F.lit(field).alias("field"),
        key.cast("string").alias("key"),
        F.lit(rule).alias("rule"),
        value.cast("string").alias("value"),
    )


def _union(store: Store, parts: Sequence[DataFrame]) -> DataFrame:
    if not parts:
        return local_frame(store.spark, [], VIOLATION)
    return reduce(DataFrame.unionByName, parts)


def duplicates(df: DataFrame, model: str, field: str, rule: str) -> DataFrame:
    """One violation per value that occurs more than once."""
    twice = df.where(F.col(field).isNotNull()).groupBy(field).agg(F.count("*").alias("__n")).where("__n > 1")
    return violation_rows(twice, model, field, rule, F.lit(None), F.col(field))


def check_primary(store: Store, model: str) -> DataFrame:
    """Primary keys must be present and distinct."""
    m = store.catalog.model(model)
    keys = store.scan(model, [m.pk])
    missing = violation_rows(keys.where(F.col(m.pk).isNull()), model, m.pk, "primary_missing", F.lit(None), F.lit(None))
    return missing.unionByName(duplicates(keys, model, m.pk, "primary_duplicate"))


def check_unique(store: Store, model: str) -> DataFrame:
    """Values of unique fields must be distinct; nulls do not count."""
    m = store.catalog.model(model)
    fields = [f for f in m.stored if f.is_unique and not f.primary]
    return _union(store, [duplicates(store.scan(model, [f.name]), model, f.name, "unique") for f in fields])


def required_violations(df: DataFrame, m: Model) -> DataFrame:
    """Nulls in required fields, one pass over the frame."""
    fields = [f for f in m.stored if not f.optional and not f.primary and f.name in df.columns]
    broken = [F.when(F.col(f"`{f.name}`").isNull(), F.lit(f.name)) for f in fields]
    names = F.array_compact(F.array(F.lit(None).cast("string"), *broken))
    return df.select(
        F.lit(m.name).alias("model"),
        F.explode(names).alias("field"),
        F.col(f"`{m.pk}`").cast("string").alias("key"),
        F.lit("required").alias("rule"),
        F.lit(None).cast("string").alias("value"),
    )


def check_required(store: Store, model: str) -> DataFrame:
    return required_violations(store.scan(model), store.catalog.model(model))


def dangling(
    rows: DataFrame,
    column: str,
    keys: DataFrame,
    model: str,
    field: str,
    key: Column,
    rule: str,
    small: bool = False,
) -> DataFrame:
    """Rows whose non-null ``column`` is not among ``keys`` (one column)."""
    lost = rows_without(rows, F.col(f"`{column}`"), keys, small)
    return violation_rows(lost, model, field, rule, key, F.col(f"`{column}`"))


def check_refs(store: Store, model: str) -> DataFrame:
    """References and links must point at records that exist."""
    m = store.catalog.model(model)
    parts = []
    for f in m.refs:
        target = store.catalog.model(f.ref_model)
        rows = store.scan(model, [m.pk, f.name])
        parts.append(
            dangling(rows, f.name, store.scan(target.name, [target.pk]), model, f.name, F.col(m.pk), "reference")
        )
    for f in m.arrays:
        links = store.links(model, f.name)
        own = store.scan(model, [m.pk])
        parts.append(dangling(links, "source", own, model, f.name, F.col("source"), "link_source"))
        if f.is_ref_array:
            target = store.catalog.model(f.ref_model)
            keys = store.scan(target.name, [target.pk])
            parts.append(dangling(links, "target", keys, model, f.name, F.col("source"), "link_target"))
    return _union(store, parts)


def enum_violations(df: DataFrame, model: str, key: str, column: str, enum: Enumeration, field: str) -> DataFrame:
    wrong = df.where(~F.col(f"`{column}`").isin(*enum.values))
    return violation_rows(wrong, model, field, "enum", F.col(f"`{key}`"), F.col(f"`{column}`"))


def check_enums(store: Store, model: str) -> DataFrame:
    """Enum fields and enum arrays must hold members only."""
    m = store.catalog.model(model)
    parts = []
    for f in m.fields:
        if isinstance(f.type, Enumeration):
            rows = store.scan(model, [m.pk, f.name])
            parts.append(enum_violations(rows, model, m.pk, f.name, f.type, f.name))
        elif f.is_array and isinstance(f.type.of, Enumeration):
            parts.append(enum_violations(store.links(model, f.name), model, "source", "target", f.type.of, f.name))
    return _union(store, parts)


def check_all(store: Store, model: str) -> DataFrame:
    checks = (check_primary, check_unique, check_required, check_refs, check_enums)
    return _union(store, [check(store, model) for check in checks])


# -- raw JSON ----------------------------------------------------------------

# Type names that variants report.
_TEXT, _TRUTH = "STRING", "BOOLEAN"
_ISO_INSTANT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:\d{2})(\[[^\]]+\])?$"
_ISO_DAY = r"^\d{4}-\d{2}-\d{2}$"


def _scalar_fits(ftype, value: Column, kind: Column) -> Column:
    """Does a variant of the given kind fit a primitive or enum type?"""
    number = kind.rlike(r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")
    text = F.try_variant_get(value, "$", "string")
    if isinstance(ftype, Enumeration):
        return (kind == _TEXT) & text.isin(*ftype.values)
    if ftype == INT:
        as_double = F.try_variant_get(value, "$", "double")
        return number & (kind.startswith("BIGINT") | (as_double == F.floor(as_double).cast("double")))
    if ftype == FLOAT:
        return number
    if ftype == BOOL:
        return kind == _TRUTH
    if ftype == DATE:
        shaped = text.rlike(_ISO_INSTANT) | text.rlike(_ISO_DAY)
        return (kind == _TEXT) & shaped & F.to_date(F.try_to_timestamp(F.substring(text, 1, 10))).isNotNull()
    if ftype in (STRING, FILE):
        return kind == _TEXT
    raise ValueError(f"no check for {ftype}")


# Levels of objects inside objects that a plan unfolds at first where models refer to each other in a circle;
# twice as many each time that turns out to be too few. Records are rarely deep, and plans grow with the levels.
LEVELS = 1


def check_json(raw: DataFrame, catalog: Catalog, model: str, column: str = "value") -> DataFrame:
    """Violations of the model's type in raw JSON records (one text per row).

    Rules: ``json`` (not an object), ``unknown_field``, ``missing_field``, ``type`` and ``element``.
    Objects given for references are checked against their own model, as deep as the data goes;
    ``field`` is then the path from the record, which ``key`` names. The plan reads and parses each text
    once. Only where models refer to each other in a circle, one job finds how deep the data goes.
    """
    levels = _depth(catalog, model)
    if levels is None:
        levels = LEVELS
        while json_objects(raw, catalog, model, levels, column).agg(F.max("deeper").alias("d")).first()["d"]:
            levels *= 2
    return object_violations(json_objects(raw, catalog, model, levels, column), catalog, model)


def check_and_look(raw: DataFrame, catalog: Catalog, model: str, column: str = "value") -> tuple[DataFrame, set[str]]:
    """The violations, written, and the paths of references that some record gives as an object with more
    than its key: both from one pass over the texts."""
    levels = _depth(catalog, model)
    given, levels = levels, LEVELS if levels is None else levels
    while True:
        seen = Observation()
        objects = json_objects(raw, catalog, model, levels, column)
        more = F.collect_set(F.when(_says_more(catalog), F.col("path")))  # paths of the catalog
        objects = objects.observe(seen, more.alias("paths"), F.max("deeper").alias("deeper"))
        found = checkpointed(object_violations(objects, catalog, model))
        if given is not None or not seen.get["deeper"]:
            return found, {path[:-1] for path in seen.get["paths"] if path}
        levels *= 2


def _depth(catalog: Catalog, model: str, above: tuple[str, ...] = ()) -> int | None:
    """How many objects can lie inside each other below a record; None for any number."""
    if model in above:
        return None
    inner = [_depth(catalog, f.ref_model, (*above, model)) for f in catalog.model(model).fields if f.ref_model]
    return None if None in inner else max((n + 1 for n in inner), default=0)


def json_objects(raw: DataFrame, catalog: Catalog, model: str, levels: int, column: str = "value") -> DataFrame:
    """``text, child, path, v, deeper``: each record, and each object in it down to ``levels``, with the model it
    is to be of and its path; ``deeper`` says on a record's row whether there are objects below that."""
    rows = raw.select(F.col(column).alias("text"), F.try_parse_json(F.col(column)).alias("__v"))
    rows = rows.withColumn("__0", F.array(F.struct(F.lit(model).alias("child"), F.lit("").alias("path"), F.col("__v").alias("v"))))
    known = {model}
    for k in range(levels):
        inner = _inner_objects(catalog, known)
        rows = rows.withColumn(f"__{k + 1}", F.flatten(F.transform(f"__{k}", inner)))
        known = {f.ref_model for name in known for f in catalog.model(name).fields if f.ref_model}
    deeper = F.exists(f"__{levels}", lambda x: F.size(_inner_objects(catalog, known)(x)) > 0) if known else F.lit(False)
    every = F.concat(*[F.col(f"__{k}") for k in range(levels + 1)])
    rows = rows.select("text", deeper.alias("__deeper"), F.inline(every))
    return rows.select("text", "child", "path", "v", ((F.col("path") == "") & F.col("__deeper")).alias("deeper"))


def _inner_objects(catalog: Catalog, names: set[str]):
    """The objects that the references of an object hold, by the model it is of."""
    empty = F.array().cast("array<struct<child:string,path:string,v:variant>>")

    def inner(x: Column) -> Column:
        found = F.when(F.lit(False), empty)
        for name in sorted(names):
            held = []
            for f in catalog.model(name).fields:
                if f.ref_model is not None:
                    kind = "array<variant>" if f.is_array else "variant"
                    value = F.try_variant_get(x["v"], f"$.{f.name}", kind)
                    items = value if f.is_array else F.array(value)
                    objects = F.filter(items, lambda y: F.schema_of_variant(y).startswith("OBJECT"))
                    held.append(F.coalesce(F.transform(objects, _boxed(f.ref_model, F.concat(x["path"], F.lit(f"{f.name}.")))), empty))
            if held:
                found = found.when(x["child"] == name, F.concat(*held))
        return found.otherwise(empty)

    return inner


def _boxed(model: str, path: Column):
    return lambda y: F.named_struct(F.lit("child"), F.lit(model), F.lit("path"), path, F.lit("v"), y)


def _says_more(catalog: Catalog) -> Column:
    """Does an object have more than its key?"""
    keys = F.map_keys(_members(F.col("v")))
    pk = F.create_map(*[F.lit(x) for m in catalog.models for x in (m.name, m.pk)])[F.col("child")]
    return F.coalesce(F.size(F.array_except(keys, F.array(pk))) > 0, F.lit(False))


def object_violations(objects: DataFrame, catalog: Catalog, model: str) -> DataFrame:
    """Violations in unfolded objects, each against its own model."""
    rows = objects.withColumn("__map", _members(F.col("v")))
    broken = F.array(_violation(F.lit(None).cast("string"), "json", F.lit(None).cast("variant")))
    every = F.when((F.col("path") == "") & F.col("__map").isNull(), broken)
    for name in sorted(_below(catalog, model)):
        every = every.when((F.col("child") == name) & F.col("__map").isNotNull(), _object_violations(F.col("__map"), catalog.model(name)))
    found = rows.select("text", "path", F.explode(every).alias("v"))
    # The record's key is read from the text, as it is written there, where it is needed.
    key = F.get_json_object("text", f"$.{catalog.model(model).pk}")
    value = F.when(F.col("v.rule") == "json", F.col("text")).otherwise(_variant_text(F.col("v.value")))
    field = F.concat("path", F.col("v.field"))
    return found.select(F.lit(model).alias("model"), field.alias("field"), key.alias("key"), F.col("v.rule").alias("rule"), value.alias("value"))


def _below(catalog: Catalog, model: str) -> set[str]:
    """The model and all that it refers to."""
    found, new = set(), {model}
    while new:
        found |= new
        new = {f.ref_model for name in new for f in catalog.model(name).fields if f.ref_model} - found
    return found


def _members(value: Column) -> Column:
    """The members of an object; null for anything else."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def _variant_text(value: Column) -> Column:
    text = F.when(F.schema_of_variant(value) == _TEXT, F.try_variant_get(value, "$", "string")).otherwise(F.to_json(value))
    return F.when(~F.is_variant_null(value), text)


def _violation(field: Column, rule: str, value: Column) -> Column:
    return F.struct(field.alias("field"), F.lit(rule).alias("rule"), value.alias("value"))


def _object_violations(members: Column, m: Model) -> Column:
    """Violations in one object, given its members."""
    names = F.array(*[F.lit(f.name) for f in m.fields])
    unknown = F.transform(
        F.array_except(F.map_keys(members), names),
        lambda k: _violation(k, "unknown_field", F.lit(None).cast("variant")),
    )
    return F.concat(unknown, F.array_compact(F.array(*[_field_violation(f, members) for f in m.fields])))


def _field_violation(f: Field, members: Column) -> Column:
    value = F.try_element_at(members, F.lit(f.name))
    present = F.map_contains_key(members, f.name)
    kind = F.schema_of_variant(value)
    null = F.is_variant_null(value)
    name = F.lit(f.name)
    wrong = lambda rule: _violation(name, rule, value)
    missing = F.when(~present & F.lit(not f.optional), _violation(name, "missing_field", F.lit(None).cast("variant")))
    if f.is_array:
        items = F.try_variant_get(value, "$", "array<variant>")
        if f.is_ref_array:
            fits = lambda x: F.schema_of_variant(x).startswith("OBJECT")
        else:
            fits = lambda x: _scalar_fits(f.type.of, x, F.schema_of_variant(x))
        bad = F.exists(items, lambda x: ~F.coalesce(fits(x), F.lit(False)))
        return missing.when(~present, None).when(items.isNull(), wrong("type")).when(bad, wrong("element"))
    if f.is_ref:
        fits = kind.startswith("OBJECT")
    else:
        fits = _scalar_fits(f.type, value, kind)
    allowed = F.coalesce(fits, F.lit(False)) | (null & F.lit(f.optional))
    return missing.when(present & ~F.coalesce(allowed, F.lit(False)), wrong("type"))
